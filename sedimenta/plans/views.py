"""Analyst views over the star schema (a dict of DataFrames: facts and dimensions by name).

Views hold no e-mail, phone or date of birth. Facts meet dimensions by surrogate key in inner joins, so rows on a
member that the dimension lacks do not show; with_members adds the members for missing keys. Ratios are rounded half
up from whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Star = dict[str, DataFrame]


#: The members for what is missing, by dimension and surrogate key. A calendar day or month has none.
MEMBERS: dict[str, tuple[str, dict[int, dict[str, object]]]] = {
    "subscription_plan": ("subscription_plan_key", {0: {"plan_name": "No active plan"}, -1: {"plan_name": "Unknown"}}),
    "warehouse": ("warehouse_key", {-1: {"warehouse_name": "Unknown", "city": "Unknown", "country": "Unknown"}}),
    "content": ("content_key", {-1: {"title": "Unknown", "content_type": "Unknown"}}),
    "customer": ("customer_key", {-1: {"full_name": "Unknown", "customer_status": "Unknown", "is_current": True}}),
    "inventory_item": ("inventory_key", {-1: {"barcode": "Unknown", "item_status": "Unknown", "is_current": True}}),
}


def with_members(dimension: DataFrame, surrogate: str, members: dict[int, dict[str, object]]) -> DataFrame:
    """The dimension with special members that it lacks: values by column for each key, null elsewhere; numbers by surrogate key."""
    spark, rows = dimension.sparkSession, None
    for key, values in members.items():
        one = spark.range(1).select(*[F.lit(key if c == surrogate else values.get(c)).cast(t).alias(c) for c, t in dimension.dtypes])
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return dimension
    there = dimension.where(F.col(surrogate).isin(list(members))).select(surrogate)  # a row for each member at most
    return dimension.unionByName(rows.join(F.broadcast(there), surrogate, "left_anti").select(dimension.columns))


def _ratio(total: Column, n: Column, scale: int) -> Column:
    """total / n with `scale` digits, rounded half up; null where n is 0. Both are whole and not negative."""
    units = F.call_function("div", (total * 2 * 10**scale + n).cast("decimal(38,0)"), (n * 2).cast("decimal(38,0)"))
    return F.when(n > 0, (units / 10**scale).cast(f"decimal(18,{scale})"))


def customer_daily_activity_view(star: Star) -> DataFrame:
    """A row for each customer and active day with labels of the calendar, the customer as of that day, and the plan."""
    f = star["customer_daily_activity"].drop("customer_id")
    d = star["date"].select("date_key", F.col("full_date").alias("activity_date"), F.col("year_month_label").alias("activity_month"), "day_name", "is_weekend")
    c = star["customer"].select("customer_key", "customer_id", "customer_no", "customer_status", "home_city", "home_country", "gender", "age_band", F.col("registration_month").alias("customer_cohort"))
    p = star["subscription_plan"].select("subscription_plan_key", F.col("plan_name").alias("subscription_plan"))
    both = (F.col("streaming_session_count") > 0) & (F.col("rental_count") > 0)
    return f.join(d, "date_key").join(c, "customer_key").join(p, "subscription_plan_key").withColumn("streamed_and_rented_same_day", both).drop("date_key", "customer_key", "subscription_plan_key")


def content_monthly_performance_view(star: Star) -> DataFrame:
    """A row for each title and month, ranked within the month by streams and rentals."""
    f = star["content_monthly_performance"].drop("content_id")
    m = star["month"].select("month_key", F.col("year_month_label").alias("performance_month"), "year_number", "quarter_number")
    c = star["content"].select("content_key", "content_id", "title", "content_type", "availability", "primary_genre", "genre_list", "primary_artist", "language", "age_rating", "release_year")
    place = F.rank().over(Window.partitionBy("month_key").orderBy(F.desc(F.col("stream_count") + F.col("rental_count"))))
    return f.join(m, "month_key").join(c, "content_key").withColumn("popularity_rank_in_month", place).drop("month_key", "content_key", "rating_sum")


def _snapshot(star: Star) -> DataFrame:
    """Snapshot rows with month, title and warehouse; the keys stay."""
    d = star["date"].select("date_key", F.col("full_date").alias("snapshot_date"), F.col("year_month_label").alias("snapshot_month"))
    c = star["content"].select("content_key", "title", "content_type")
    w = star["warehouse"].select("warehouse_key", "warehouse_name", F.col("city").alias("warehouse_city"), F.col("country").alias("warehouse_country"))
    return star["inventory_daily_snapshot"].join(d, "date_key").join(c, "content_key").join(w, "warehouse_key")


def inventory_daily_utilisation_view(star: Star) -> DataFrame:
    i = star["inventory_item"].select("inventory_key", "barcode", "item_condition", "item_status")
    return _snapshot(star).join(i, "inventory_key").drop("date_key", "inventory_key", "content_key", "warehouse_key")


def warehouse_utilisation_monthly_view(star: Star) -> DataFrame:
    """Warehouse, content type and month; an item counts once for each of its versions."""
    sums = {"item_days_in_service": "days_in_service", "item_days_rented": "days_rented", "item_days_available": "days_available", "rentals": "rental_count", "returns": "return_count", "overdue_item_days": "is_overdue"}
    by = ["snapshot_month", "warehouse_name", "warehouse_city", "warehouse_country", "content_type"]
    g = _snapshot(star).groupBy(*by).agg(F.countDistinct("inventory_key").alias("items_in_service"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return g.withColumn("utilisation_pct", _ratio(F.col("item_days_rented") * 100, F.col("item_days_in_service"), 2))


def customer_bitmaps(groups: dict[str, Column]) -> list[Column]:
    """For rows grouped by F.bitmap_bucket_number("customer_key"): who is in each group, a bit for each customer. Bitmaps of
    days can be put together to those of months (F.bitmap_or_agg) and counted exactly, where distinct counts can not."""
    return [F.bitmap_construct_agg(F.when(cond, F.bitmap_bit_position("customer_key"))).alias(name) for name, cond in groups.items()]


def monthly_business_kpis_view(star: Star) -> DataFrame:
    """A row for each month with activity. Customers are counted by surrogate key: two versions in a month count twice."""
    d = star["date"].select("date_key", F.col("year_month_label").alias("month"))
    streams, rents = F.col("streaming_session_count") > 0, F.col("rental_count") > 0
    groups = {"active_customers": streams | rents, "streaming_customers": streams, "renting_customers": rents}
    sums = {"streaming_sessions": "streaming_session_count", "_minutes": "streaming_minutes", "rentals": "rental_count", "returns": "returned_item_count", "late_returns": "late_return_count", "subscription_revenue": "subscription_amount_spent", "rental_revenue": "rental_amount_spent", "total_revenue": "total_amount_spent", "refunds": "refunded_amount", "support_tickets": "support_ticket_count"}
    fact = star["customer_daily_activity"].join(d, "date_key").withColumn("_bucket", F.bitmap_bucket_number("customer_key"))
    part = fact.groupBy("month", "_bucket").agg(*customer_bitmaps(groups), *[F.sum(c).alias(n) for n, c in sums.items()])
    a = part.groupBy("month").agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in groups], *[F.sum(n).cast(part.schema[n].dataType).alias(n) for n in sums])
    i = star["inventory_daily_snapshot"].join(d, "date_key").groupBy("month").agg(_ratio(F.sum("days_rented") * 100, F.sum("days_in_service"), 2).alias("inventory_utilisation_pct"))
    cents = (F.col("total_revenue") * 100).cast("decimal(20,0)")
    out = a.withColumn("streaming_hours", _ratio(F.col("_minutes"), F.lit(60), 1)).drop("_minutes").join(i, "month", "left")
    return out.withColumn("revenue_per_active_customer", _ratio(cents, F.col("active_customers") * 100, 2))


VIEWS = {
    "customer_daily_activity": customer_daily_activity_view,
    "content_monthly_performance": content_monthly_performance_view,
    "inventory_daily_utilisation": inventory_daily_utilisation_view,
    "warehouse_utilisation_monthly": warehouse_utilisation_monthly_view,
    "monthly_business_kpis": monthly_business_kpis_view,
}

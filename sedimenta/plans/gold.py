"""The star schema: seven dimensions and three facts as plans over the silver tables (a dict of DataFrames by name).

Dimension builders take the current dimension (None: first load) and give the new one; fact builders give rows for the
keys asked for, which merges.delete_insert puts in place of the old ones. Missing members have key -1, no subscription
has plan key 0. Rows of the daily facts move once, to their customer or item, and are added up there; the
monthly fact is built from branches that are aggregated before they meet.

Where a rebuild could leave stale or colliding rows, the safe side is taken: a session without completion counts as
not completed, and facts on key -1 are rebuilt with the rest because deletion goes by natural key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions.text import full_years
from sedimenta.operators import joins, merges

OPEN_END = "9999-12-31"
#: Writes rows that several steps read, and gives them as they were written.
Keep = Callable[[DataFrame], DataFrame] | None
#: Credited roles by rank, and what can be streamed and rented.
ROLES = ("Director", "Lead Actor", "Performer", "Author", "Composer", "Writer", "Producer", "Supporting Actor")
STREAMABLE = ("Movie", "TV Series", "Documentary", "Music")
RENTABLE = ("Movie", "Music", "Book", "Video Game")


def date_key(c: Column) -> Column:
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def month_key(c: Column) -> Column:
    return (F.year(c) * 100 + F.month(c)).cast("int")


def _money(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(12,2)")


# --- calendar ---


def dim_date(spark: SparkSession, first, last) -> DataFrame:
    day = F.col("full_date")
    days = spark.range(1).select(F.explode(joins.days_between(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("full_date"))
    return days.select(
        date_key(day).alias("date_key"), "full_date", F.dayofmonth(day).alias("day_of_month"), (F.weekday(day) + 1).alias("day_of_week"), F.date_format(day, "EEEE").alias("day_name"), (F.weekday(day) >= 5).alias("is_weekend"), F.weekofyear(day).alias("iso_week"),
        month_key(day).alias("month_key"), F.month(day).alias("month_number"), F.date_format(day, "MMMM").alias("month_name"), F.quarter(day).alias("quarter_number"), F.year(day).alias("year_number"), F.date_format(day, "yyyy-MM").alias("year_month_label"),
    )


def dim_month(dates: DataFrame) -> DataFrame:
    """Months in full, also where the calendar begins or ends within one."""
    whole = [F.last_day(F.max("full_date")).alias("month_end_date"), F.dayofmonth(F.last_day(F.max("full_date"))).alias("days_in_month")]
    same = ["month_number", "month_name", "quarter_number", "year_number", "year_month_label"]
    return dates.where("date_key > 0").groupBy("month_key").agg(F.trunc(F.min("full_date"), "month").alias("month_start_date"), *whole, *[F.first(c).alias(c) for c in same])


# --- type 1 ---


def _scd1(current: DataFrame | None, incoming: DataFrame, key: str, surrogate: str, keep: Keep = None) -> DataFrame:
    if current is None:
        current = incoming.limit(0).withColumn(surrogate, F.lit(None).cast("long"))
    return merges.scd1(current, incoming, key, surrogate, keep)


def dim_subscription_plan(s: dict[str, DataFrame], current: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    """Tiers rank the distinct fees. Plans are a price list, so the one-partition window is small."""
    p = s["subscription_plan"]
    incoming = p.select("plan_id", "plan_name", "monthly_fee", "video_quality", "max_devices", F.expr("CAST(dense_rank() OVER (ORDER BY monthly_fee) AS INT)").alias("plan_tier"))
    return _scd1(current, incoming, "plan_id", "subscription_plan_key", keep)


def dim_warehouse(s: dict[str, DataFrame], current: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    w = s["warehouse"].join(s["city"].select("city_id", "city_name", "country_id"), "city_id", "left").join(s["country"].select("country_id", "country_name", "country_code"), "country_id", "left")
    incoming = w.select("warehouse_id", "warehouse_name", F.coalesce("city_name", F.lit("Unknown")).alias("city"), F.coalesce("country_name", F.lit("Unknown")).alias("country"), F.coalesce("country_code", F.lit("??")).alias("country_code"))
    return _scd1(current, incoming, "warehouse_id", "warehouse_key", keep)


def duration_band(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "Not applicable").when(minutes < 30, "Under 30 min").when(minutes < 90, "30-89 min").when(minutes < 150, "90-149 min").otherwise("150+ min")


def dim_content(s: dict[str, DataFrame], current: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    g = s["content_genre"].join(s["genre"].select("genre_id", "genre_name"), "genre_id")
    genres = g.groupBy("content_id").agg(F.min_by("genre_name", "genre_id").alias("primary_genre"), F.array_join(F.array_sort(F.collect_set("genre_name")), ", ").alias("genre_list"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int"), F.lit(0)), F.lit(len(ROLES) + 1))
    a = s["content_artist"].join(s["artist"].select("artist_id", "artist_name"), "artist_id")
    artists = a.groupBy("content_id").agg(F.min_by(F.struct("artist_name", "role"), F.struct(rank, F.col("artist_id"))).alias("_a"))
    c = s["content"].join(s["content_type"].select("content_type_id", "content_type"), "content_type_id", "left").join(genres, "content_id", "left").join(artists, "content_id", "left")
    kind = F.coalesce("content_type", F.lit("Unknown"))
    streams, rents = kind.isin(*STREAMABLE), kind.isin(*RENTABLE)
    incoming = c.select(
        "content_id", "title", kind.alias("content_type"), streams.alias("is_streamable"), rents.alias("is_rentable"),
        F.when(streams & rents, "Streaming & Rental").when(streams, "Streaming only").otherwise("Rental only").alias("availability"),
        F.coalesce("primary_genre", F.lit("Unclassified")).alias("primary_genre"), F.coalesce("genre_list", F.lit("Unclassified")).alias("genre_list"),
        F.coalesce("_a.artist_name", F.lit("Not credited")).alias("primary_artist"), F.coalesce("_a.role", F.lit("Not credited")).alias("primary_artist_role"),
        "language", F.coalesce("age_rating", F.lit("Unrated")).alias("age_rating"), "release_date", F.year("release_date").alias("release_year"), "duration_minutes", duration_band(F.col("duration_minutes")).alias("duration_band"),
    )
    return _scd1(current, incoming, "content_id", "content_key", keep)


# --- type 2 ---


def _scd2(current: DataFrame | None, incoming: DataFrame, key: str, surrogate: str, tracked: list[str], type1: list[str], keep: Keep = None) -> DataFrame:
    """Versions with surrogate keys: a version keeps the key that it has under its start date."""
    if current is None:
        current = incoming.limit(0).select(key, *tracked, *type1, F.lit(None).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit(True).alias("is_current"), F.lit(None).cast("long").alias(surrogate))
    versions = merges.scd2(current.drop(surrogate), incoming, key, tracked, type1, "change_date")
    keyed = versions.join(current.select(key, "effective_from", surrogate), [key, "effective_from"], "left")
    return merges.with_surrogates(keyed, current, [key, "effective_from"], surrogate, keep).withColumn("effective_to", F.coalesce("effective_to", F.lit(OPEN_END).cast("date")))


def age_band(years: Column) -> Column:
    return F.when(years.isNull(), "Unknown").when(years < 18, "Under 18").when(years < 25, "18-24").when(years < 35, "25-34").when(years < 45, "35-44").when(years < 55, "45-54").when(years < 65, "55-64").otherwise("65+")


def dim_customer(s: dict[str, DataFrame], current: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    """Versions by status and home; the home is the address of type Home, else the one updated last."""
    order = F.struct((F.col("address_type") == "Home").cast("int"), "updated_at", "address_id")
    home = s["customer_address"].groupBy("customer_id").agg(F.max_by(F.struct("city_id", F.col("updated_at").alias("moved_at")), order).alias("_h"))
    home = home.select("customer_id", "_h.*").join(s["city"].select("city_id", "city_name", "country_id"), "city_id", "left").join(s["country"].select("country_id", "country_name", "country_code"), "country_id", "left")
    c = s["customer"].where("NOT is_duplicate").join(home, "customer_id", "left")
    incoming = c.select(
        "customer_id", "customer_no", F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"), "email", "phone", "gender", "date_of_birth",
        age_band(full_years(F.col("date_of_birth"), F.col("registration_date"))).alias("age_band"), "registration_date", F.date_format("registration_date", "yyyy-MM").alias("registration_month"),
        F.col("status").alias("customer_status"), F.coalesce("city_name", F.lit("Unknown")).alias("home_city"), F.coalesce("country_name", F.lit("Unknown")).alias("home_country"), F.coalesce("country_code", F.lit("??")).alias("home_country_code"),
        F.greatest("updated_at", "moved_at").cast("date").alias("change_date"),
    )
    type1 = ["customer_no", "full_name", "email", "phone", "gender", "date_of_birth", "age_band", "registration_date", "registration_month"]
    return _scd2(current, incoming, "customer_id", "customer_key", ["customer_status", "home_city", "home_country", "home_country_code"], type1, keep)


def _in_service(s: dict[str, DataFrame]) -> DataFrame:
    """Items with the first day they could be lent: the purchase, or a rental booked before it."""
    use = s["rental"].groupBy("inventory_id").agg(F.min("rental_date").alias("first_rental"), (F.date_add(F.max(F.greatest("rental_date", "return_date")), 1)).alias("after_last"))
    return s["inventory_item"].join(use, "inventory_id", "left").withColumn("in_service_date", F.least("purchase_date", "first_rental"))


def dim_inventory_item(s: dict[str, DataFrame], current: DataFrame | None = None, keep: Keep = None) -> DataFrame:
    i = _in_service(s)
    incoming = i.select(
        "inventory_id", F.coalesce("barcode", F.concat(F.lit("NO-BARCODE-"), F.col("inventory_id"))).alias("barcode"), "content_id", "purchase_date", "in_service_date",
        F.coalesce("item_condition", F.lit("Unknown")).alias("item_condition"), F.col("status").alias("item_status"), "warehouse_id", F.col("updated_at").cast("date").alias("change_date"),
    )
    return _scd2(current, incoming, "inventory_id", "inventory_key", ["item_condition", "item_status", "warehouse_id"], ["barcode", "content_id", "purchase_date", "in_service_date"], keep)


# --- facts ---

ACTIVITY = ("streaming_session_count", "streaming_minutes", "distinct_titles_streamed", "completed_stream_count", "rental_count", "returned_item_count", "late_return_count", "total_amount_spent", "subscription_amount_spent", "rental_amount_spent", "refunded_amount", "failed_payment_count", "support_ticket_count", "review_count", "wishlist_add_count")
AMOUNTS = ("total_amount_spent", "subscription_amount_spent", "rental_amount_spent", "refunded_amount", "rental_revenue", "pool")


def _branches(keys: list[str], measures: tuple[str, ...], parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """Each part is aggregated by the keys, padded with zeros and added up with the others."""
    padded = []
    for df, aggs in parts:
        one = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
        padded.append(one.select(*keys, *[(F.coalesce(F.col(m), F.lit(0)) if m in aggs else F.lit(0)).cast("decimal(18,2)" if m in AMOUNTS else "long").alias(m) for m in measures]))
    both = reduce(DataFrame.unionByName, padded)
    return both.groupBy(*keys).agg(*[F.sum(m).cast("decimal(18,2)" if m in AMOUNTS else "long").alias(m) for m in measures])


def _count(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def plans_asof(days: DataFrame, subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """days (customer_id, activity_date and more) with plan_id and subscription_plan_key: of the subscriptions that cover the day
    the one begun last, then the highest id. A customer's subscriptions come to the days as one list."""
    own = ("start_date", "subscription_id", "plan_id", "subscription_plan_key")
    sub = subscriptions.join(plans.select("plan_id", "subscription_plan_key"), "plan_id", "left").withColumn("_e", F.coalesce("end_date", F.lit(OPEN_END).cast("date")))
    listed = sub.groupBy(F.col("customer_id").alias("_c")).agg(F.collect_list(F.struct(*own, "_e")).alias("_s"))
    day = F.col("activity_date")
    j = days.join(listed.hint("shuffle_hash"), F.col("customer_id") == F.col("_c"), "left")
    j = j.withColumn("_s", F.array_max(F.filter("_s", lambda x: day.between(x["start_date"], x["_e"]))))
    return j.select(*days.columns, "_s.plan_id", "_s.subscription_plan_key")


def customer_daily_activity(s: dict[str, DataFrame], customers: DataFrame, plans: DataFrame, dates: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row for each customer and day with activity; `only` (customer_id, or that and month_key) restricts it.

    customer_id is kept besides the surrogate key, so that a rebuild can delete rows of unknown customers as well;
    month_key is that of the activity, also where the calendar lacks the day.
    """

    def on(name: str, day: str) -> DataFrame:
        d = s[name].withColumn("month_key", month_key(F.col(day)))
        d = d if only is None else d.join(only, only.columns, "left_semi")
        d = d.where("NOT is_duplicate") if name in ("streaming_session", "payment") else d
        return d.withColumn("activity_date", F.col(day).cast("date"))

    no, amount = F.lit(False), F.col("amount")
    status, kind = F.col("status"), F.col("payment_type")
    paid = F.when(kind == "Subscription", "subscription").when(kind == "Rental", "rental fee").otherwise("other fee")
    of_payment = F.when(status == "Completed", paid).when(status == "Refunded", "refund").when(status == "Failed", "failed").otherwise("no payment")

    def act(d: DataFrame, what: Column | str, hit: Column = no, title: Column | None = None, minutes: Column | None = None, amount: Column | None = None) -> DataFrame:
        rest = {"title": (title, "long"), "minutes": (minutes, "long"), "amount": (amount, "decimal(18,2)")}
        return d.select("customer_id", "activity_date", (F.lit(what) if isinstance(what, str) else what).alias("what"), F.coalesce(hit, no).alias("hit"), *[(F.lit(None) if c is None else c).cast(t).alias(n) for n, (c, t) in rest.items()])

    acts = reduce(DataFrame.unionByName, [
        act(on("streaming_session", "start_time"), "session", F.col("completion_percentage") >= 90, F.col("content_id"), F.col("watch_duration")),
        act(on("rental", "rental_date"), "rental"),
        act(on("rental", "return_date").where("return_date IS NOT NULL"), "return", F.col("return_date") > F.col("due_date")),
        act(on("payment", "payment_date"), of_payment, amount=amount),
        act(on("support_ticket", "opened_date"), "ticket"),
        act(on("review", "review_date"), "review"),
        act(on("wishlist", "added_date"), "wish"),
    ])
    # rows move once, to the task of their customer, where they are added up by day and meet the customer's versions and plans
    what = F.col("what")
    sum_of = lambda *names: F.sum(F.when(what.isin(*names), amount))
    measures = {
        "streaming_session_count": _count(what == "session"), "streaming_minutes": F.sum("minutes"), "distinct_titles_streamed": F.countDistinct("title"), "completed_stream_count": _count((what == "session") & F.col("hit")),
        "rental_count": _count(what == "rental"), "returned_item_count": _count(what == "return"), "late_return_count": _count((what == "return") & F.col("hit")),
        "total_amount_spent": sum_of("subscription", "rental fee", "other fee"), "subscription_amount_spent": sum_of("subscription"), "rental_amount_spent": sum_of("rental fee"), "refunded_amount": sum_of("refund"), "failed_payment_count": _count(what == "failed"),
        "support_ticket_count": _count(what == "ticket"), "review_count": _count(what == "review"), "wishlist_add_count": _count(what == "wish"),
    }
    daily = acts.repartition("customer_id").groupBy("customer_id", "activity_date").agg(*[F.coalesce(measures[m], F.lit(0)).cast("decimal(18,2)" if m in AMOUNTS else "long").alias(m) for m in ACTIVITY])
    known = joins.asof_listed(daily, customers.select("customer_id", "effective_from", "effective_to", "customer_key"), "customer_id", "activity_date")
    keyed = plans_asof(known, s["customer_subscription"], plans).join(F.broadcast(dates.select(F.col("full_date").alias("activity_date"), "date_key")), "activity_date", "left")
    return keyed.select(
        F.coalesce("date_key", F.lit(-1)).alias("date_key"), F.coalesce("customer_key", F.lit(-1)).alias("customer_key"), F.coalesce("subscription_plan_key", F.when(F.col("plan_id").isNull(), 0).otherwise(-1)).alias("subscription_plan_key"), "customer_id", *[_money(m).alias(m) if m in AMOUNTS else m for m in ACTIVITY], month_key(F.col("activity_date")).alias("month_key"),
    )


CONTENT = ("stream_count", "unique_viewer_count", "streaming_minutes", "completed_stream_count", "rental_count", "unique_renter_count", "rental_revenue", "review_count", "rated_review_count", "rating_sum", "wishlist_add_count", "completion_n", "completion_hundredths")


def content_monthly_performance(s: dict[str, DataFrame], contents: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row for each title and month. Rentals count in the month of the rental, their revenue in that of the payment.

    A month's subscription revenue is shared by watch minutes; a month without any shares none.
    """

    def on(df: DataFrame, day: str) -> DataFrame:
        d = df.withColumn("month_key", month_key(F.col(day)))
        return d if only is None else d.join(F.broadcast(only), "month_key", "left_semi")  # a row for each month

    items = s["inventory_item"].select("inventory_id", "content_id")
    streams, pay = s["streaming_session"].where("NOT is_duplicate"), s["payment"].where("NOT is_duplicate AND status = 'Completed'")
    rented = s["rental"].select("rental_id", "inventory_id").join(items, "inventory_id").select("rental_id", "content_id")
    one, done = F.count("*"), F.col("completion_percentage")
    parts = _branches(["content_id", "month_key"], CONTENT, [
        (on(streams, "start_time"), {"stream_count": one, "unique_viewer_count": F.countDistinct("customer_id"), "streaming_minutes": F.sum("watch_duration"), "completed_stream_count": _count(done >= 90), "completion_n": F.count(done), "completion_hundredths": F.sum(done * 100)}),
        (on(s["rental"].join(items, "inventory_id"), "rental_date"), {"rental_count": one, "unique_renter_count": F.countDistinct("customer_id")}),
        (on(pay.where("payment_type = 'Rental'").join(rented, "rental_id"), "payment_date"), {"rental_revenue": F.sum("amount")}),
        (on(s["review"], "review_date"), {"review_count": one, "rated_review_count": F.count("rating"), "rating_sum": F.sum("rating")}),
        (on(s["wishlist"], "added_date"), {"wishlist_add_count": one}),
    ])
    pool = on(pay.where("payment_type = 'Subscription'"), "payment_date").groupBy("month_key").agg(F.sum("amount").alias("pool"))
    minutes = on(streams, "start_time").groupBy("month_key").agg(F.sum("watch_duration").alias("all_minutes"))
    months = F.broadcast(pool.join(minutes, "month_key"))  # a row for each month
    cents = joins.allocate((F.col("pool") * 100).cast("decimal(20,0)"), F.col("streaming_minutes"), F.col("all_minutes"))
    share = _money(cents / 100)

    def mean(total: str, n: str, scale: int) -> Column:
        """total / n in hundredths, rounded half up; total is in units of 1 / scale."""
        return F.when(F.col(n) > 0, F.expr(f"(2 * {100 // scale} * {total} + {n}) div (2 * {n})") / 100)

    j = parts.join(months, "month_key", "left").join(contents.select("content_id", "content_key"), "content_id", "left").withColumn("allocated_subscription_revenue", share)
    return j.select(
        "month_key", F.coalesce("content_key", F.lit(-1)).alias("content_key"), "content_id", *[m for m in CONTENT if not m.startswith("completion_") and m != "rental_revenue"], _money("rental_revenue").alias("rental_revenue"), "allocated_subscription_revenue",
        (_money("rental_revenue") + F.col("allocated_subscription_revenue")).cast("decimal(12,2)").alias("total_revenue"),
        mean("completion_hundredths", "completion_n", 100).cast("decimal(5,2)").alias("avg_completion_pct"), mean("rating_sum", "rated_review_count", 1).cast("decimal(3,2)").alias("avg_customer_rating"),
    )


def inventory_daily_snapshot(s: dict[str, DataFrame], items: DataFrame, contents: DataFrame, warehouses: DataFrame, first, last, targets: DataFrame | None = None) -> DataFrame:
    """One row for each item and day in service from `first` to `last`.

    `targets` (inventory_id, from_date) gives the items to build and the day from which; None: all from `first`.
    An item that was neither bought on a known day nor ever lent is not in service.
    An item is on loan from the rental day up to the day before the return, one day at least; overlapping loans count once.

    Items are followed by the days on which something changes: a loan begins, ends or becomes overdue, a version of the
    item begins, the item goes. Between two of them every day is alike, so all joins and the shuffle by item see a row for
    each change only, and days are spread out last.
    """
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    base = _in_service(s).withColumn("from_date", lo) if targets is None else _in_service(s).join(targets, "inventory_id")
    gone = F.when(F.col("status") == "Retired", F.coalesce("after_last", "in_service_date")).alias("gone_from")
    base = base.select("inventory_id", "content_id", gone, F.when(F.col("in_service_date").isNotNull(), F.greatest("from_date", "in_service_date")).alias("begin")).where(F.col("begin") <= hi)
    loans = s["rental"].join(base.select("inventory_id"), "inventory_id", "left_semi") if targets is not None else s["rental"]
    titled = base.join(contents.select("content_id", "content_key"), "content_id", "left").drop("content_id")
    housed = items.where("inventory_id IS NOT NULL").join(warehouses.select("warehouse_id", "warehouse_key"), "warehouse_id", "left")
    until = F.least(F.greatest(F.date_sub(F.coalesce("return_date", F.date_add(hi, 1)), 1), F.col("rental_date")), hi)
    deltas = ("loan", "over", "starts", "returns")

    def change(day: Column, **by: int) -> Column:
        return F.struct(day.alias("day"), *[F.lit(by.get(d, 0)).alias(d) for d in deltas])

    due = F.greatest(F.date_add("due_date", 1), "rental_date")
    none = F.array(change(F.lit(None).cast("date"), loan=0))
    of_loan = F.concat(
        F.array(change(F.col("rental_date"), loan=1, starts=1), change(F.date_add("rental_date", 1), starts=-1), change(F.date_add(until, 1), loan=-1)),
        F.when(due <= until, F.array(change(due, over=1), change(F.date_add(until, 1), over=-1))).otherwise(none),
        F.when(F.col("return_date").isNotNull(), F.array(change(F.col("return_date"), returns=1), change(F.date_add("return_date", 1), returns=-1))).otherwise(none),
    )
    of_mark = F.array(change(F.col("rental_date")), change(F.col("due_date")))
    # loans, an item's first and last day, and its versions move once, to the task of their item, and make changes there
    dated = lambda d, a, b, c, loan: d.where("inventory_id IS NOT NULL").select("inventory_id", *[x.cast("date").alias(n) for x, n in ((a, "rental_date"), (b, "due_date"), (c, "return_date"))], F.lit(loan).alias("_loan"))
    none_such = F.lit(None)
    events = dated(loans, F.col("rental_date"), F.col("due_date"), F.col("return_date"), True).unionByName(dated(base, F.col("begin"), F.col("gone_from"), none_such, False)).unionByName(dated(items, F.col("effective_from"), none_such, none_such, False))
    moves = events.repartition("inventory_id").select("inventory_id", F.explode(F.when(F.col("_loan"), of_loan).otherwise(of_mark)).alias("_")).select("inventory_id", "_.*")
    changes = moves.where("day IS NOT NULL").groupBy("inventory_id", "day").agg(*[F.sum(d).alias(d) for d in deltas])
    by_day = Window.partitionBy("inventory_id").orderBy("day")
    runs = changes.select("inventory_id", "day", F.lead("day").over(by_day).alias("next"), *[F.sum(d).over(by_day).alias(d) for d in deltas])
    runs = runs.join(titled.hint("shuffle_hash"), "inventory_id").withColumns({"start": F.greatest("day", "begin"), "end": F.least(F.coalesce(F.date_sub("next", 1), hi), hi)}).where(F.col("start") <= F.col("end"))
    v = joins.asof_listed(runs, housed.select("inventory_id", "effective_from", "effective_to", "inventory_key", "item_status", "warehouse_key"), "inventory_id", "start")
    later = F.col("effective_from") > F.lit(merges.FIRST_DATE).cast("date")
    retired = F.coalesce((F.col("item_status") == "Retired") & (later | (F.col("start") >= F.col("gone_from"))) & (F.col("loan") <= 0), F.lit(False))
    j = v.where(~retired)
    key = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    loan, over = (F.col("loan") > 0).cast("int"), (F.col("over") > 0).cast("int")
    days = j.select(
        key("inventory_key"), key("content_key"), key("warehouse_key"), "inventory_id", F.col("starts").cast("int").alias("rental_count"), F.col("returns").cast("int").alias("return_count"), F.lit(1).alias("days_in_service"), loan.alias("days_rented"), (1 - loan).alias("days_available"),
        over.alias("is_overdue"), (loan * 100).cast("decimal(5,2)").alias("utilisation_pct"), F.explode(joins.days_between(F.col("start"), F.col("end"))).alias("day"),
    )
    return days.select(date_key(F.col("day")).alias("date_key"), *[c for c in days.columns if c != "day"])


def snapshot_targets(items: DataFrame, changed: DataFrame, first, previous_end, last) -> DataFrame:
    """inventory_id, from_date: changed items (inventory_id, from_date; null: from `first`) anew from there, or from the day
    after the last snapshot where that is earlier; the others only from that day."""
    new, end = F.date_add(F.lit(previous_end).cast("date"), 1), F.lit(last).cast("date")
    begin = F.greatest(F.coalesce("from_date", F.lit(first).cast("date")), F.lit(first).cast("date"))
    whole = changed.join(items.select("inventory_id"), "inventory_id", "left_semi").select("inventory_id", F.least(begin, new).alias("from_date"))
    tail = items.join(changed, "inventory_id", "left_anti").select("inventory_id", new.alias("from_date"))
    return whole.unionByName(tail).where(F.col("from_date") <= end)

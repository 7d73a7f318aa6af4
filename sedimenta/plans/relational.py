"""Relational operators over the driver's tables as SQL that Catalyst plans; the same text, per dialect, is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


class Spark:
    idiv = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    days = staticmethod(lambda a, b: f"datediff({b}, {a})")
    add = staticmethod(lambda d, n: f"date_add({d}, {n})")
    json = staticmethod(lambda c, k: f"get_json_object({c}, '$.{k}')")
    agg_list = staticmethod(lambda c, o: f"listagg({c}, ', ') WITHIN GROUP (ORDER BY {o})")
    first = staticmethod(lambda c, o: f"min_by({c}, {o})")
    ymd = staticmethod(lambda d: f"date_format({d}, 'yyyyMMdd')")
    weekday = staticmethod(lambda d: f"(weekday({d}) + 1)")
    minutes = staticmethod(lambda a, b: f"timestampdiff(MINUTE, {a}, {b})")
    dayname = staticmethod(lambda d: f"date_format({d}, 'EEEE')")
    series = staticmethod(lambda a, b: f"explode(sequence({a}, {b}, interval 1 day))")


class Duck:
    idiv = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    days = staticmethod(lambda a, b: f"date_diff('day', {a}, {b})")
    add = staticmethod(lambda d, n: f"CAST({d} + INTERVAL ({n}) DAY AS DATE)")
    json = staticmethod(lambda c, k: f"json_extract_string({c}, '$.{k}')")
    agg_list = staticmethod(lambda c, o: f"string_agg({c}, ', ' ORDER BY {o})")
    first = staticmethod(lambda c, o: f"arg_min({c}, {o})")
    ymd = staticmethod(lambda d: f"strftime({d}, '%Y%m%d')")
    weekday = staticmethod(lambda d: f"isodow({d})")
    minutes = staticmethod(lambda a, b: f"date_sub('minute', {a}, {b})")
    dayname = staticmethod(lambda d: f"dayname({d})")
    series = staticmethod(lambda a, b: f"CAST(unnest(generate_series({a}, {b}, INTERVAL 1 DAY)) AS DATE)")


def cents(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18,2)) * 100) AS BIGINT)"


def pct(d, a: str, b: str) -> str:
    """100.00 * a / b in hundredths of a percent, rounded half up; null for b = 0."""
    return f"CASE WHEN ({b}) > 0 THEN CAST({d.idiv(f'2 * 10000 * ({a}) + ({b})', f'2 * ({b})')} AS BIGINT) END"


ODATE = "CAST(o_orderdate AS DATE)"
MONTH = "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT)"



def told(value: str) -> str:
    """A value as text with its length ahead; null is apart from all text and keeps its place."""
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE concat(CAST(length(CAST({value} AS STRING)) AS STRING), ':', CAST({value} AS STRING)) END"


QUERIES = {
    "scan_project_rename": lambda d: "SELECT c_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment, 'ops' AS record_source FROM customer",
    "inline_values": lambda d: "SELECT r_regionkey, r_name, coalesce(label, 'Unknown') AS label FROM region LEFT JOIN (VALUES (0, 'South'), (2, 'East'), (3, 'North')) AS t(k, label) ON k = r_regionkey",
    "empty_source": lambda d: "SELECT c_custkey AS customer_id FROM customer WHERE 1 = 0",
    "text_staged_cast": lambda d: "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(CAST(l_quantity AS VARCHAR(30)) AS DECIMAL(20,4)) AS BIGINT) AS quantity FROM lineitem",
    "case_banding": lambda d: "SELECT p_partkey, CASE WHEN nullif(p_size, 1) IS NULL THEN 'Not applicable' WHEN p_size < 10 THEN 'Small' WHEN p_size < 30 THEN 'Medium' ELSE 'Large' END AS size_band, CASE WHEN p_size > 45 THEN 'Extra' END AS extra FROM part",
    "bool_projection": lambda d: "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS is_final, (o_totalprice > 100000 AND o_orderstatus <> 'F') AS big_open FROM orders",
    "default_and_nullif": lambda d: "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'Unknown') AS priority FROM orders",
    "star_expansion": lambda d: "SELECT n.*, r.r_name AS region_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "filter_between_in": lambda d: "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('1-URGENT', '5-LOW') AND NOT (o_custkey BETWEEN 10 AND 20)",
    "filter_in_subquery": lambda d: "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)",
    "filter_not_in_subquery": lambda d: "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)" if d is Duck else "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND o_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey IS NULL)",  # a null-aware anti join broadcasts all keys, whatever their size
    "filter_or_subquery": lambda d: "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "exists_not_exists": lambda d: "SELECT CAST(count(*) FILTER (WHERE has_big) AS BIGINT) AS with_big, CAST(count(*) FILTER (WHERE NOT has_big) AS BIGINT) AS without_big FROM (SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_big FROM customer) t",
    "ilike_filter": lambda d: "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_type ILIKE '%e%'",
    "const_in_columns": lambda d: "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE 7 IN (l_partkey, l_suppkey, l_orderkey)",
    "watermark_window": lambda d: "SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-12 00:00:00'",
    "formatted_month_filter": lambda d: f"SELECT o_orderkey FROM orders WHERE {MONTH} IN (199503, 199504) AND o_orderdate >= TIMESTAMP '1995-03-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-05-01 00:00:00'",
    "join_star_labels": lambda d: "SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_left_unknown_key": lambda d: "SELECT o_orderkey, coalesce(l.supp, -1) AS supplier_key FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey",
    "join_left_multi_key": lambda d: "WITH a AS (SELECT l_partkey AS k, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT l_partkey AS k, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT a.k AS part_id, a.y AS ship_year, CAST(n AS BIGINT) AS n_lines, CAST(coalesce(m, 0) AS BIGINT) AS n_returned FROM a LEFT JOIN b ON a.k = b.k AND a.y = b.y",
    "asof_latest_lateral": lambda d: "SELECT c_custkey, o_orderkey FROM (SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-06-30 00:00:00') t WHERE rn = 1" if d is Spark else "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderdate <= TIMESTAMP '1996-06-30 00:00:00' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) t ON true",
    "lateral_first_event": lambda d: f"SELECT c_custkey, f.first_day FROM customer LEFT JOIN (SELECT o_custkey, min({ODATE}) AS first_day FROM orders GROUP BY o_custkey) f ON o_custkey = c_custkey",
    "overlap_self_join": lambda d: f"WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, {ODATE} AS b, {d.add(ODATE, 7)} AS e FROM orders) SELECT a.k AS left_key, b.k AS right_key FROM o a JOIN o b ON a.c = b.c AND a.k < b.k AND a.b < b.e AND b.b < a.e",
    "first_payment_scalar": lambda d: "SELECT o_orderkey, f.first_line, CAST(coalesce(f.n, 0) AS BIGINT) AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linenumber) AS first_line, count(*) AS n FROM lineitem GROUP BY l_orderkey) f ON l_orderkey = o_orderkey",
    "snowflake_left_chain": lambda d: "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'",
    "correlated_count": lambda d: "SELECT p_partkey, CAST(coalesce(n, 0) AS BIGINT) AS n_lines FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey) t ON l_partkey = p_partkey" if d is Spark else "SELECT p_partkey, CAST((SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 25) AS BIGINT) AS n_lines FROM part",
    "scalar_max_minus_30d": lambda d: f"SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT event_type) AS BIGINT) AS n_types FROM events WHERE CAST(ts AS DATE) > {d.add('(SELECT max(CAST(ts AS DATE)) FROM events)', -30)} GROUP BY user_id",
    "one_row_window_join": lambda d: f"SELECT {'/*+ BROADCAST(w) */ ' if d is Spark else ''}o_orderkey FROM orders JOIN (SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders WHERE o_orderstatus = 'P') w ON o_orderdate > lo AND o_orderdate < hi WHERE o_orderstatus = 'O'",
    "agg_multi_distinct": lambda d: f"SELECT {MONTH} AS month_key, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS final_customers, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities FROM orders GROUP BY 1",
    "agg_pivot_sum": lambda d: f"SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN {cents('o_totalprice')} ELSE 0 END) AS BIGINT) AS final_cents, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN {cents('o_totalprice')} ELSE 0 END) AS BIGINT) AS open_cents, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS n_pending FROM orders GROUP BY 1",
    "agg_bool_or_minmax": lambda d: f"SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, min({ODATE}) AS first_day, max({ODATE}) FILTER (WHERE o_orderstatus = 'F') AS last_final, max(greatest(o_custkey, o_orderkey)) AS top_key FROM orders GROUP BY 1",
    "agg_ordered_list": lambda d: f"SELECT r_name, {d.agg_list('n_name', 'n_name')} AS nations, {d.first('n_name', 'n_nationkey')} AS first_nation FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "agg_having": lambda d: "SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_open FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_orderstatus = 'O') > 5",
    "agg_global": lambda d: f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents, max({ODATE}) AS last_day FROM orders",
    "select_distinct": lambda d: "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "distinct_on_first": lambda d: "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) t WHERE rn = 1" if d is Spark else "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM orders ORDER BY o_custkey, (o_orderstatus = 'P') DESC, o_orderdate DESC, o_orderkey DESC",
    "ratio_and_weighted_avg": lambda d: f"SELECT p_brand, {pct(d, 'sum(CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN 1 ELSE 0 END)', 'count(*)')} AS returned_bp, CASE WHEN sum(CAST(l_quantity AS BIGINT)) > 0 THEN CAST({d.idiv('2 * sum(CAST(p_size AS BIGINT) * CAST(l_quantity AS BIGINT)) * 100 + sum(CAST(l_quantity AS BIGINT))', '2 * sum(CAST(l_quantity AS BIGINT))')} AS BIGINT) END AS weighted_size FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "avg_in_cents": lambda d: f"SELECT c_mktsegment, CAST({d.idiv('2 * sum(' + cents('c_acctbal + 10000') + ') + count(*)', '2 * count(*)')} AS BIGINT) AS avg_cents FROM customer GROUP BY 1",
    "two_level_reaggregation": lambda d: f"WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, CAST(count(*) AS BIGINT) AS active_days, CAST(max(n) AS BIGINT) AS busiest, CAST(sum(n) AS BIGINT) AS n_events FROM daily GROUP BY user_id",
    "pool_allocation": lambda d: f"WITH part_m AS (SELECT {MONTH} AS month_key, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2), pool AS (SELECT {MONTH} AS month_key, sum({cents('o_totalprice')}) AS cents FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), tot AS (SELECT month_key, sum(q) AS tq FROM part_m GROUP BY 1) SELECT p.month_key, p.l_partkey, CAST({d.idiv('2 * CAST(cents AS DECIMAL(30,0)) * q + tq', '2 * tq') if d is Spark else 'CAST((2 * CAST(cents AS HUGEINT) * q + tq) // (2 * tq) AS BIGINT)'} AS BIGINT) AS allocated_cents FROM part_m p JOIN tot USING (month_key) LEFT JOIN pool USING (month_key)",
    "table_fingerprint": lambda d: f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(CAST(sum({'CAST(conv({0}, 16, 10) AS DECIMAL(20,0))' if d is Spark else "CAST('0x' || {0} AS BIGINT)"}) AS DECIMAL(38,0)) AS STRING) AS fingerprint FROM lineitem".format(f"substr(md5(concat_ws('|', {', '.join(told(c) for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', cents('l_extendedprice'), cents('l_quantity'), 'l_returnflag', 'l_linestatus', 'CAST(l_shipdate AS DATE)'))})), 1, 15)"),
    "rank_in_month": lambda d: f"SELECT * FROM (SELECT month_key, n_name, cents, CAST(rank() OVER (PARTITION BY month_key ORDER BY cents DESC) AS BIGINT) AS rnk FROM (SELECT {MONTH} AS month_key, n_name, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) t) u WHERE rnk <= 3",
    "dense_rank_global": lambda d: f"SELECT p_brand, CAST(dense_rank() OVER (ORDER BY top_cents) AS BIGINT) AS tier FROM (SELECT p_brand, max({cents('p_retailprice')}) AS top_cents FROM part GROUP BY p_brand) t",
    "lag_contiguity": lambda d: f"SELECT o_custkey, o_orderkey, CAST({d.days('prev', 'day')} AS BIGINT) AS gap_days FROM (SELECT o_custkey, o_orderkey, {ODATE} AS day, lag({ODATE}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders) t",
    "first_value_named_window": lambda d: "SELECT o_orderkey, row_number() OVER w AS n, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)" if d is not Spark else "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS n, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "topk": lambda d: f"SELECT c_custkey, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY cents DESC, c_custkey LIMIT 10",
    "limit_latest": lambda d: "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "union_event_stream": lambda d: f"SELECT who, day, CAST(sum(ordered) AS BIGINT) AS ordered, CAST(sum(shipped) AS BIGINT) AS shipped, CAST(sum(seen) AS BIGINT) AS seen FROM (SELECT o_custkey AS who, {ODATE} AS day, count(*) AS ordered, 0 AS shipped, 0 AS seen FROM orders GROUP BY 1, 2 UNION ALL SELECT o_custkey, CAST(l_shipdate AS DATE), 0, count(*), 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 UNION ALL SELECT user_id, CAST(ts AS DATE), 0, 0, count(*) FROM events GROUP BY 1, 2) t GROUP BY who, day",
    "union_distinct_keys": lambda d: "SELECT o_custkey AS customer_id FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT user_id FROM events WHERE event_type = 'error'",
    "string_functions": lambda d: "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, trim(concat('  ', n_name, ' ')) AS tr, trim(TRAILING ',' FROM concat(n_name, ',')) AS tt, nullif(trim(' '), '') AS blank, concat_ws('|', n_name, CAST(NULL AS VARCHAR(1)), n_nationkey) AS cw, replace(n_name, 'A', 'x') AS rp, md5(n_name) AS h FROM nation" if d is Spark else "SELECT n_nationkey, lower(n_name) AS lo, upper(n_name) AS up, trim('  ' || n_name || ' ') AS tr, rtrim(n_name || ',', ',') AS tt, nullif(trim(' '), '') AS blank, concat_ws('|', n_name, NULL, n_nationkey) AS cw, replace(n_name, 'A', 'x') AS rp, md5(n_name) AS h FROM nation",
    "date_functions": lambda d: f"SELECT o_orderkey, CAST({d.ymd('o_orderdate')} AS BIGINT) AS ymd, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS dd, CAST({d.weekday('o_orderdate')} AS BIGINT) AS dow, CAST(weekofyear(o_orderdate) AS BIGINT) AS wk, {d.dayname('o_orderdate')} AS day_name, {d.add(ODATE, 30)} AS due, CAST({d.days(ODATE, 'DATE ' + chr(39) + '2000-01-01' + chr(39))} AS BIGINT) AS to_2000, CAST({d.minutes('o_orderdate', 'TIMESTAMP ' + chr(39) + '2000-01-01 00:00:00' + chr(39))} AS BIGINT) AS mins FROM orders",
    "full_years": lambda d: f"SELECT o_orderkey, CAST(2010 - year(o_orderdate) - CAST(2 * 100 + 28 < month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS BIGINT) AS age FROM orders" if d is Spark else "SELECT o_orderkey, CAST(date_part('year', age(TIMESTAMP '2010-02-28', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP))) AS BIGINT) AS age FROM orders",
    "math_functions": lambda d: f"SELECT c_custkey, abs({cents('c_acctbal')}) AS ab, greatest(c_custkey, CAST(c_nationkey AS BIGINT), CAST(NULL AS BIGINT)) AS g, least(c_custkey, CAST(c_nationkey AS BIGINT), CAST(NULL AS BIGINT)) AS l, CAST({d.idiv('c_custkey', '7')} AS BIGINT) AS dv, {pct(d, 'c_custkey', 'c_nationkey')} AS bp FROM customer",
    "array_json_functions": lambda d: f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k, coalesce(nullif(CAST({'array_position(array(' if d is Spark else 'list_position(['}'click', 'view', 'signup'{')' if d is Spark else ']'}, event_type) AS INT), 0), 99) AS pos FROM events",
    "calendar_dim": lambda d: f"SELECT CAST({d.ymd('day')} AS BIGINT) AS date_key, day, CAST(year(day) * 100 + month(day) AS BIGINT) AS month_key, CAST({d.weekday('day')} AS BIGINT) AS dow, {d.dayname('day')} AS day_name, CAST(weekofyear(day) AS BIGINT) AS wk, {d.weekday('day')} >= 6 AS is_weekend FROM (SELECT {d.series('lo', 'hi')} AS day FROM (SELECT min({ODATE}) AS lo, max({ODATE}) AS hi FROM orders) b) t",
    "calendar_month": lambda d: f"SELECT CAST(year(day) * 100 + month(day) AS BIGINT) AS month_key, min(day) AS first_day, max(day) AS last_day, CAST(count(*) AS BIGINT) AS n_days FROM (SELECT {d.series('lo', 'hi')} AS day FROM (SELECT min({ODATE}) AS lo, max({ODATE}) AS hi FROM orders) b) t GROUP BY 1",
    "customer_daily_activity": lambda d: "SELECT e.user_id, day, c_mktsegment, n_events, n_purchases, n_types, spent, viewed_and_bought FROM (SELECT user_id, CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_events, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS n_purchases, CAST(count(DISTINCT event_type) AS BIGINT) AS n_types, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE 0 END) AS DECIMAL(28,4)) AS spent, bool_or(event_type = 'view') AND bool_or(event_type = 'purchase') AS viewed_and_bought FROM events GROUP BY 1, 2) e JOIN customer ON c_custkey = user_id",
    "content_monthly_performance": lambda d: f"SELECT k AS part_id, m AS month_key, p_brand, CAST(sum(n_orders) AS BIGINT) AS n_orders, CAST(sum(n_shipped) AS BIGINT) AS n_shipped, CAST(sum(units) AS BIGINT) AS units FROM (SELECT l_partkey AS k, {MONTH} AS m, count(*) AS n_orders, 0 AS n_shipped, 0 AS units FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 UNION ALL SELECT l_partkey, CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT), 0, count(*), sum(CAST(l_quantity AS BIGINT)) FROM lineitem GROUP BY 1, 2) b JOIN part ON p_partkey = k GROUP BY 1, 2, 3",
    "monthly_business_kpis": lambda d: f"WITH a AS (SELECT {MONTH} AS month_key, count(*) AS n_orders, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_customers, sum({cents('o_totalprice')}) AS cents FROM orders GROUP BY 1), b AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS month_key, count(*) AS n_lines, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned FROM lineitem GROUP BY 1) SELECT a.month_key, CAST(n_orders AS BIGINT) AS n_orders, CAST(customers AS BIGINT) AS customers, CAST(urgent_customers AS BIGINT) AS urgent_customers, CAST(cents AS BIGINT) AS revenue_cents, CAST({d.idiv('2 * cents + customers', '2 * customers')} AS BIGINT) AS cents_per_customer, {pct(d, 'urgent_customers', 'customers')} AS urgent_bp, CAST(n_lines AS BIGINT) AS n_lines, {pct(d, 'n_returned', 'n_lines')} AS returned_bp FROM a LEFT JOIN b ON a.month_key = b.month_key",
    "weekday_weekend": lambda d: f"SELECT CASE WHEN {d.weekday('o_orderdate')} >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CAST(count(*) AS BIGINT) AS n, {pct(d, 'count(*) FILTER (WHERE o_orderstatus = ' + chr(39) + 'F' + chr(39) + ')', 'count(*)')} AS final_bp FROM orders GROUP BY 1",
    "top_titles_of_month": lambda d: f"SELECT p_partkey, p_name, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-02-01 00:00:00' GROUP BY 1, 2 ORDER BY n DESC, p_partkey LIMIT 10",
    "format_text": lambda d: f"SELECT o_orderkey, {'format_string' if d is Spark else 'printf'}('%s/%05d; %s changed', o_orderstatus, o_orderkey, o_orderpriority) AS note FROM orders",
    "epoch_seconds": lambda d: f"SELECT event_id, CAST({'unix_seconds(CAST(ts AS TIMESTAMP))' if d is Spark else 'floor(epoch(ts))'} AS BIGINT) AS seconds FROM events",
    "filter_regex": lambda d: f"SELECT p_partkey FROM part WHERE {'regexp_like' if d is Spark else 'regexp_matches'}(p_name, '^(red|old) [a-z]+$')",
    "order_by_array_position": lambda d: f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {'array_position(array(' if d is Spark else 'list_position(['}'3-MEDIUM', '1-URGENT', '5-LOW'{')' if d is Spark else ']'}, o_orderpriority) DESC, o_orderkey LIMIT 50",
    "latest_first": lambda d: "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 40",
    "revenue_by_country": lambda d: f"SELECT n_name, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(sum({cents('o_totalprice')}) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY cents DESC, n_name LIMIT 10",
}


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(text: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return spark.sql(text)

    return query


def queries() -> dict:
    return {name: run(make(Spark)) for name, make in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: make(Duck) for name, make in QUERIES.items()}

"""The engine's own queries on the star-schema and event tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import consensus, evaluation, joins, models, pricing, priors, windows
from tidemark.plans import cards, feeds, games, markets, snapshots  # noqa: F401  their queries register themselves
from tidemark.plans.registry import ORACLE_SQL, QUERIES, query, r6, read
from tidemark.sources import tables

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "pregame_roll"


def orders(spark, sf):
    """Customers' orders as dated sequences; money in whole cents keeps sums exact."""
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.withColumn("season", F.year("o_orderdate"))


ORDERS = "(SELECT o_custkey, o_orderkey, o_orderdate, round(o_totalprice * 100)::BIGINT AS cents, year(o_orderdate)::INT AS season FROM orders)"
SEQ = ["o_orderdate", "o_orderkey"]


@query(f"""
SELECT o_custkey, o_orderkey, (row_number() OVER w - 1)::BIGINT AS sequence, (row_number() OVER s - 1)::BIGINT AS season_sequence,
  round(avg(cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS cents_all_mean,
  count(cents) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cents_all_n,
  round(avg(cents) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS cents_last4_mean,
  count(cents) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS cents_last4_n,
  round(avg(cents) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), 6) AS cents_last8_mean,
  count(cents) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS cents_last8_n,
  round(avg(cents) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS cents_season_mean,
  count(cents) OVER (s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cents_season_n
FROM {ORDERS}
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), s AS (PARTITION BY o_custkey, season ORDER BY o_orderdate, o_orderkey)""")
def pregame_roll(spark, sf):
    out = windows.prior_features(orders(spark, sf), ["o_custkey"], SEQ, ["cents"], "season")
    return out.select("o_custkey", "o_orderkey", "sequence", "season_sequence", *[r6(c).alias(c) if c.endswith("_mean") else F.col(c) for c in out.columns if c.startswith("cents_")])


@query(f"""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM {ORDERS}),
f AS (
  SELECT o_custkey, o_orderkey, i, NULL::DOUBLE AS ewm, cents::DOUBLE AS y FROM o WHERE i = 1
  UNION ALL
  SELECT o.o_custkey, o.o_orderkey, o.i, f.y, ((1 - (1 - 0.5 ** 0.25)) * f.y + (1 - 0.5 ** 0.25) * o.cents) / ((1 - (1 - 0.5 ** 0.25)) + (1 - 0.5 ** 0.25))
  FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1
) SELECT o_custkey, o_orderkey, round(ewm, 3) AS ewm FROM f""")
def pregame_ewm(spark, sf):
    return windows.ewm_prior(orders(spark, sf), ["o_custkey"], SEQ, "cents", 4.0, "ewm").select("o_custkey", "o_orderkey", F.round("ewm", 3).alias("ewm"))


@query(f"""
SELECT o_custkey, o_orderkey, round(d, 6) AS rest_days, CASE WHEN d < 6 THEN 1 ELSE 0 END::INT AS short_rest
FROM (SELECT *, (epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))) / 86400000000.0::DOUBLE AS d FROM {ORDERS})""")
def rest_days_short_week(spark, sf):
    return windows.rest_days(orders(spark, sf), ["o_custkey"], SEQ, "o_orderdate").select("o_custkey", "o_orderkey", r6(F.col("rest_days")).alias("rest_days"), "short_rest")


def lines(spark, sf):
    return read(spark, sf, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("long"))


LINES = "(SELECT *, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)"


@query(f"""
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
  (coalesce(sum(cents) FILTER (WHERE l_returnflag = 'R'), 0) / 100.0::DOUBLE) AS returned_value,
  round(avg(l_quantity) FILTER (WHERE l_linestatus = 'O'), 6) AS open_quantity,
  round(CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') > 0 THEN count(*) FILTER (WHERE l_linestatus = 'F' AND l_returnflag = 'R')::DOUBLE / count(*) FILTER (WHERE l_linestatus = 'F') END, 6) AS return_rate
FROM {LINES} GROUP BY l_suppkey""")
def masked_order_agg(spark, sf):
    back, done = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return lines(spark, sf).groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_if(back).alias("returned"), (F.coalesce(F.sum(F.when(back, F.col("cents"))), F.lit(0)) / 100).alias("returned_value"),
        r6(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")))).alias("open_quantity"), r6(F.try_divide(F.count_if(done & back), F.count_if(done))).alias("return_rate"),
    )


@query(f"""
SELECT l_suppkey, count(*) AS drives, sum(gain)::BIGINT AS gain, max(lines) AS most_lines
FROM (SELECT l_suppkey, l_orderkey, greatest(max(cents) - min(cents), 0) AS gain, count(*) AS lines FROM {LINES} GROUP BY 1, 2) GROUP BY 1""")
def two_level_drive_agg(spark, sf):
    drive = lines(spark, sf).groupBy("l_suppkey", "l_orderkey").agg(F.greatest(F.max("cents") - F.min("cents"), F.lit(0)).alias("gain"), F.count("*").alias("lines"))
    return drive.groupBy("l_suppkey").agg(F.count("*").alias("drives"), F.sum("gain").alias("gain"), F.max("lines").alias("most_lines"))


FLOW = f"""(SELECT s.s_nationkey AS seller, c.c_nationkey AS buyer, sum(l.cents)::BIGINT AS value, count(*) AS n
FROM {LINES} l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY 1, 2)"""


def flow(spark, sf):
    l = lines(spark, sf).select("l_orderkey", "l_suppkey", "cents")  # noqa: E741
    o = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("seller"))
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("seller", "buyer").agg(F.sum("cents").alias("value"), F.count("*").alias("n"))


@query(f"WITH f AS {FLOW} SELECT a.seller, a.buyer, a.value, a.n, b.value AS back_value, b.n AS back_n FROM f a LEFT JOIN f b ON b.seller = a.buyer AND b.buyer = a.seller")
def mirror_flow(spark, sf):
    return joins.mirrored(flow(spark, sf), "seller", "buyer", [], ["value", "n"], "back_")


@query("""
SELECT o_orderkey, max(cents) FILTER (WHERE side = 'A') AS home, max(cents) FILTER (WHERE side = 'R') AS away, max(cents) FILTER (WHERE side = 'A') - max(cents) FILTER (WHERE side = 'R') AS edge
FROM (SELECT l_orderkey AS o_orderkey, l_returnflag AS side, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem) GROUP BY 1""")
def home_away_pivot(spark, sf):
    p = lines(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("side"), "cents").groupBy("o_orderkey").pivot("side", ["A", "R"]).agg(F.max("cents"))
    return p.select("o_orderkey", F.col("A").alias("home"), F.col("R").alias("away"), (F.col("A") - F.col("R")).alias("edge"))


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id, ts AS rts FROM events WHERE event_type = 'click'),
j AS (SELECT l.event_id, r.rid, abs(epoch_us(l.ts) - epoch_us(r.rts)) AS g FROM l LEFT JOIN r USING (user_id)),
a AS (SELECT event_id, count(rid) AS k, count(*) FILTER (WHERE g <= 21600000000) AS c, min((g, rid)) FILTER (WHERE g <= 21600000000) AS b FROM j GROUP BY 1)
SELECT event_id, b[2] AS match_id, c AS candidates, CASE WHEN k = 0 THEN 'key_not_found' WHEN c = 0 THEN 'outside_tolerance' WHEN c = 1 THEN 'matched' ELSE 'matched_nearest_ambiguous' END AS status FROM a""")
def nearest_match_status(spark, sf):
    e = read(spark, sf, "events")
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("rid"), F.col("ts").alias("rts"))
    return joins.nearest_within(e.where("event_type = 'purchase'"), right, ["user_id"], "event_id", "rid", "ts", "rts", 6 * 3600)


@query("""
WITH d AS (SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1)
SELECT s.day, count(h.day) AS days, sum(h.n)::BIGINT AS rows, round(sum(h.cents * 0.55 ** (date_diff('day', h.day, s.day) / 7.0::DOUBLE)) / sum(h.n * 0.55 ** (date_diff('day', h.day, s.day) / 7.0::DOUBLE)), 4) AS weighted
FROM d s LEFT JOIN d h ON h.day < s.day GROUP BY 1""")
def strictly_before_day(spark, sf):
    d = read(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    w = F.pow(F.lit(0.55), F.datediff("day", "_hday") / 7)
    agg = {"days": F.count("_hday"), "rows": F.sum("n"), "weighted": F.round(F.sum(F.col("cents") * w) / F.sum(F.col("n") * w), 4)}
    return joins.strictly_before(d.select("day"), d, "day", "day", agg)


@query("""
SELECT 'null_value' AS problem, 'l_orderkey' AS "column", count(*) FILTER (WHERE l_orderkey IS NULL) AS n FROM lineitem
UNION ALL SELECT 'null_value', 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem
UNION ALL SELECT 'not_allowed', 'l_returnflag', count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
UNION ALL SELECT 'missing_column', 'l_nothing', 1
UNION ALL SELECT 'surplus_rows', 'l_orderkey,l_linenumber', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def contract_report(spark, sf):
    return tables.contract_report(read(spark, sf, "lineitem"), ["l_orderkey", "l_quantity", "l_nothing"], ["l_orderkey", "l_linenumber"], {"l_returnflag": ["A", "N"]})


@query("SELECT l_orderkey, l_linenumber, l_shipdate, o_orderdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate <= o_orderdate")
def availability_violations(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")  # noqa: E741
    return l.join(o, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") <= F.col("o_orderdate"))).drop("o_orderkey")


@query("""
SELECT c_custkey, CASE WHEN n = 'CUSTOMER 000000007' THEN 'LUCKY' ELSE n END AS name FROM (SELECT c_custkey, nullif(trim(regexp_replace(upper(c_name), '[^A-Z0-9]+', ' ', 'g')), '') AS n FROM customer)""")
def canonical_names(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", S.canonical_name("c_name", {"CUSTOMER 000000007": "LUCKY"}).alias("name"))


@query("SELECT event_type, (json_extract(props, '$.k')::INT % 5)::INT AS bucket, count(*) AS n, sum(json_extract(props, '$.k')::INT)::BIGINT AS total FROM events GROUP BY 1, 2")
def props_json(spark, sf):
    k = F.from_json("props", "k int")["k"]
    return read(spark, sf, "events").groupBy("event_type", (k % 5).alias("bucket")).agg(F.count("*").alias("n"), F.sum(k).alias("total"))


QUOTE = "(SELECT *, date_trunc('day', ts)::DATE AS day, round(value * 100)::BIGINT AS cents FROM events)"


def quotes(spark, sf):
    return read(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query(f"SELECT event_id, round(cents / sum(cents) OVER w, 9) AS fair_probability, (sum(cents) OVER w - 1)::BIGINT AS overround FROM {QUOTE} WINDOW w AS (PARTITION BY user_id, day)")
def devig_group(spark, sf):
    return consensus.devig(quotes(spark, sf), ["user_id", "day"], "cents").select("event_id", F.round("fair_probability", 9).alias("fair_probability"), "overround")


@query(f"""
SELECT day, event_type, median(cents)::DOUBLE AS median_value, round(stddev_pop(cents), 4) AS dispersion, count(DISTINCT user_id) AS sources FROM {QUOTE} GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3""")
def window_consensus(spark, sf):
    c = consensus.consensus(quotes(spark, sf), ["day", "event_type"], "cents", "user_id", 3)
    return c.withColumn("median_value", F.col("median_value").cast("double")).withColumn("dispersion", F.round("dispersion", 4))


@query(f"""
WITH m AS (SELECT *, median(cents) OVER (PARTITION BY day, event_type) AS med FROM {QUOTE}), d AS (SELECT *, abs(cents - med) AS dev FROM m),
x AS (SELECT *, median(dev) OVER (PARTITION BY day, event_type) AS mad, count(*) OVER (PARTITION BY day, event_type) AS n FROM d)
SELECT event_id, (CASE WHEN n >= 5 AND CASE WHEN mad <= 1e-12 THEN dev > 1 ELSE 0.67448975::DOUBLE * dev / mad > 3.5 END THEN 1 ELSE 0 END)::INT AS is_outlier FROM x""")
def mad_outliers(spark, sf):
    return consensus.mad_outliers(quotes(spark, sf), ["day", "event_type"], "cents", 3.5, 1.0, 5).select("event_id", "is_outlier")


@query("""
WITH a AS (SELECT event_id, value, date_diff('second', ts, TIMESTAMP '2024-01-20 00:00:00') AS age FROM events)
SELECT event_id, reasons, (reasons = '')::INT AS eligible FROM (SELECT event_id, array_to_string(list_sort(list_filter([
  CASE WHEN age > 864000 THEN 'STALE' END, CASE WHEN age < 0 THEN 'FUTURE' END, CASE WHEN value IS NULL THEN 'MISSING' END, CASE WHEN value < 5 THEN 'TOO_LOW' END, CASE WHEN value > 200 THEN 'TOO_HIGH' END], lambda x: x IS NOT NULL)), '|') AS reasons FROM a)""")
def freshness_reasons(spark, sf):
    seconds = lambda t: F.unix_seconds(t.cast("timestamp"))  # noqa: E731  whole seconds of the clock: date_diff counts those passed, not 1000 ms each
    e = read(spark, sf, "events").withColumn("age", seconds(F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")) - seconds(F.col("ts")))
    return consensus.freshness(e, "age", "value", 864_000, 5, 200).select("event_id", "reasons", "eligible")


@query("""
SELECT user_id, arg_min(event_id, ts) AS open_id, arg_max(event_id, ts) AS close_id, (round(arg_max(value, ts) * 100)::BIGINT - round(arg_min(value, ts) * 100)::BIGINT) AS moved, count(*) AS n FROM events GROUP BY 1""")
def open_close_movement(spark, sf):
    return quotes(spark, sf).groupBy("user_id").agg(F.min_by("event_id", "ts").alias("open_id"), F.max_by("event_id", "ts").alias("close_id"), (F.max_by("cents", "ts") - F.min_by("cents", "ts")).alias("moved"), F.count("*").alias("n"))


@query("""
WITH m AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS least FROM (SELECT event_id, user_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-20 00:00:00') AS t FROM events) WHERE t > 0)
SELECT event_id, user_id, t AS micros_left FROM m WHERE t = least""")
def closing_snapshot(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, ts, TIMESTAMP_NTZ '2024-01-20 00:00:00')").alias("micros_left")).where("micros_left > 0")
    return e.withColumn("least", F.min("micros_left").over(Window.partitionBy("user_id"))).where("micros_left = least").drop("least")


@query("""
SELECT event_type, arg_min(v, (-n, v))::BIGINT AS mode_value, max(n) AS n FROM (SELECT event_type, round(value)::BIGINT AS v, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def reference_point_mode(spark, sf):
    return consensus.modal(read(spark, sf, "events").withColumn("v", F.round("value").cast("long")), ["event_type"], "v")


@query("""
SELECT CASE WHEN value < 3 THEN '0-3' WHEN value < 7 THEN '3-7' WHEN value < 14 THEN '7-14' ELSE '14+' END AS bucket, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1""")
def line_buckets(spark, sf):
    v = F.col("value")
    return quotes(spark, sf).groupBy(F.when(v < 3, "0-3").when(v < 7, "3-7").when(v < 14, "7-14").otherwise("14+").alias("bucket")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""
WITH e AS (SELECT l_returnflag AS unit, l_suppkey, sum(l_quantity * l_linenumber) AS s, sum(l_linenumber)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT *, s / n AS entity_mean FROM e),
g AS (SELECT unit, sum(s) / sum(n) AS group_mean, greatest(coalesce(var_samp(entity_mean), 0.01), 0.01) AS between_var FROM m GROUP BY 1)
SELECT unit, l_suppkey, round(n / (n + 25) * entity_mean + (1 - n / (n + 25)) * group_mean, 6) AS prior_mean, round(between_var, 6) AS between_var FROM m JOIN g USING (unit)""")
def eb_prior(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("unit"), "l_suppkey", "l_quantity", F.col("l_linenumber").cast("double").alias("w"))  # noqa: E741
    return priors.empirical_bayes(l, "l_suppkey", ["unit"], "l_quantity", "w", 25.0, 0.01).select("unit", "l_suppkey", r6(F.col("prior_mean")).alias("prior_mean"), r6(F.col("between")).alias("between_var"))


@query("""
WITH p AS (SELECT user_id, event_type, count(*)::DOUBLE AS w, avg(round(value * 100)::BIGINT) AS m FROM events GROUP BY 1, 2),
t AS (SELECT user_id, count(*) AS parts, sum(w) AS s, sum(w * m) AS sm, sum(w * (100.0::DOUBLE + m * m)) AS q, sum(w * ln(w)) AS h FROM p GROUP BY 1)
SELECT user_id, parts, round(sm / s, 4) AS mixture_mean, round(greatest(0, q / s - (sm / s) * (sm / s)), 2) AS mixture_variance, round(ln(s) - h / s, 6) AS entropy FROM t""")
def mixture_entropy(spark, sf):
    p = quotes(spark, sf).groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("w"), F.avg("cents").alias("m")).withColumn("sd", F.lit(10.0))
    m = priors.mixture(p, ["user_id"], "w", "m", "sd")
    return m.select("user_id", "parts", F.round("mixture_mean", 4).alias("mixture_mean"), F.round("mixture_variance", 2).alias("mixture_variance"), r6(F.col("entropy")).alias("entropy"))


@query(f"""
WITH x AS (SELECT o_custkey, o_orderkey, cents::DOUBLE AS c, coalesce(sum(cents::DOUBLE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM {ORDERS})
SELECT o_custkey, o_orderkey, later, greatest(0, least(c, 50000000 - later)) AS counted FROM x""")
def recency_cap(spark, sf):
    o = orders(spark, sf).withColumn("cents", F.col("cents").cast("double"))
    return windows.recency_exposure(o, ["o_custkey"], SEQ, "cents", 50_000_000.0).select("o_custkey", "o_orderkey", "later", "counted")


@query(f"""
SELECT o_custkey, o_orderkey, round((coalesce(sum(f) OVER w, 0) + 2) / (coalesce(count(f) OVER w, 0) + 40.0::DOUBLE), 9) AS posterior
FROM (SELECT o.*, (cents > 40000000)::INT AS f FROM {ORDERS} o) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rare_posterior(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(*SEQ).rowsBetween(Window.unboundedPreceding, -1)
    hit = (F.col("cents") > 40_000_000).cast("int")
    return orders(spark, sf).select("o_custkey", "o_orderkey", F.round((F.coalesce(F.sum(hit).over(w), F.lit(0)) + 2) / (F.count(hit).over(w) + 40.0), 9).alias("posterior"))


@query(f"""
WITH g AS (SELECT p_partkey, p_size - 25.0::DOUBLE AS m, unnest(generate_series(-20, 20))::INT AS margin FROM part)
SELECT p_partkey, margin, round(({S.normal_cdf_sql('((margin + 0.5::DOUBLE - m) / 12.75::DOUBLE)')} - {S.normal_cdf_sql('((margin - 0.5::DOUBLE - m) / 12.75::DOUBLE)')})
  / ({S.normal_cdf_sql('((20.5::DOUBLE - m) / 12.75::DOUBLE)')} - {S.normal_cdf_sql('((-20.5::DOUBLE - m) / 12.75::DOUBLE)')}), 6) AS p FROM g""")
def pmf_grid(spark, sf):
    g = pricing.margin_grid(read(spark, sf, "part").withColumn("m", F.col("p_size") - F.lit(25.0)), ["p_partkey"], "m", 12.75, -20, 20)
    return g.withColumn("p", r6(F.col("p")))


KELLY = """(SELECT event_id, date_trunc('week', ts)::DATE AS week, (event_id % 97) / 97.0::DOUBLE AS p, 1 + value / 50 AS d FROM events)"""


@query(f"""
WITH k AS (SELECT *, CASE WHEN d - 1 > 0 THEN greatest(0, (p * (d - 1) - (1 - p - 0.02)) / (d - 1)) ELSE 0 END * 0.25 AS stake FROM {KELLY}), t AS (SELECT *, sum(stake) OVER (PARTITION BY week) AS s FROM k)
SELECT event_id, round(stake, 6) AS stake, round(stake * least(1, CASE WHEN s = 0 THEN 1 ELSE 5 / s END), 6) AS capped FROM t""")
def kelly_cap(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), ((F.col("event_id") % 97) / 97.0).alias("p"), (1 + F.col("value") / 50).alias("d"))
    k = e.withColumn("stake", pricing.kelly(F.col("p"), F.col("d"), F.lit(0.02)) * 0.25)
    return windows.capped_share(k, ["week"], "stake", 5.0, "capped").select("event_id", r6(F.col("stake")).alias("stake"), r6(F.col("capped")).alias("capped"))


@query(f"""
SELECT event_id, CASE WHEN e IS NULL OR NOT coalesce(event_id % 7 <> 0, false) THEN 'ABSTAIN' WHEN e >= 0.1 THEN 'BET' ELSE 'NO_BET' END AS decision, round(e, 6) AS edge
FROM (SELECT *, CASE WHEN d > 1.1 THEN p - 1 / d END AS e FROM {KELLY})""")
def price_decision(spark, sf):
    d = 1 + F.col("value") / 50
    e = F.when(d > 1.1, (F.col("event_id") % 97) / 97.0 - 1 / d)
    return read(spark, sf, "events").select("event_id", pricing.decision(e, F.col("event_id") % 7 != 0, 0.1).alias("decision"), r6(e).alias("edge"))


PROBS = "(SELECT l.doc_id, l.toxic AS y, l.quality, (d.n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


def probs(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("p"))
    return read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), "quality").join(d, "doc_id")


@query(f"""
SELECT quality, count(*) AS n, round(avg((p - y) ** 2), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss
FROM {PROBS} GROUP BY GROUPING SETS ((), (quality))""")
def prob_metrics(spark, sf):
    m = evaluation.metrics(probs(spark, sf), "p", "y", "quality")
    return m.select("quality", "n", r6(F.col("brier")).alias("brier"), r6(F.col("log_loss")).alias("log_loss"))


@query(f"""
WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM {PROBS} GROUP BY 1) SELECT sum(n)::BIGINT AS n, count(*) AS bins, round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b""")
def ece_width(spark, sf):
    return evaluation.ece(probs(spark, sf), "p", "y", 10).withColumn("ece", r6(F.col("ece")))


@query(f"""
WITH r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM {PROBS}), t AS (SELECT count(*) FILTER (WHERE y = 1) AS ups, count(*) FILTER (WHERE y = 0) AS downs, sum(r) FILTER (WHERE y = 1) AS s FROM r)
SELECT ups, downs, round((s - ups * (ups + 1) / 2.0::DOUBLE) / (ups * downs), 6) AS auc FROM t""")
def auc_rank(spark, sf):
    return evaluation.auc(probs(spark, sf), "p", "y").withColumn("auc", r6(F.col("auc")))


@query("""
SELECT o_custkey, o_orderkey, n AS place, round(w / sum(w) OVER (PARTITION BY o_custkey), 6) AS share
FROM (SELECT *, CASE n WHEN 1 THEN 0.85 WHEN 2 THEN 0.12 WHEN 3 THEN 0.03 ELSE 0.01 END::DOUBLE AS w FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 4)""")
def depth_rank_share(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long").alias("place")).where("place <= 4")
    w = F.element_at(F.array(*map(F.lit, (0.85, 0.12, 0.03, 0.01))), F.col("place").cast("int"))
    return o.select("o_custkey", "o_orderkey", "place", r6(w / F.sum(w).over(Window.partitionBy("o_custkey"))).alias("share"))


@query("""
SELECT l_suppkey, metric, value FROM (SELECT l_suppkey, count(*) AS lines, sum(l_quantity)::BIGINT AS quantity, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1) UNPIVOT (value FOR metric IN (lines, quantity, orders))""")
def team_history_unpivot(spark, sf):
    a = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"), F.count_distinct("l_orderkey").alias("orders"))
    return a.unpivot("l_suppkey", ["lines", "quantity", "orders"], "metric", "value")


@query(f"""
WITH RECURSIVE o AS (SELECT o_custkey, cents / 10000000.0::DOUBLE - 2 AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM {ORDERS}),
f AS (SELECT o_custkey, 0::BIGINT AS i, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0::BIGINT AS alarms FROM o WHERE i = 1
 UNION ALL SELECT o_custkey, i, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE u END, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE d END, alarms + CASE WHEN u > 3 OR d > 3 THEN 1 ELSE 0 END
 FROM (SELECT o.o_custkey, o.i, greatest(0, f.up + o.r - 0.25) AS u, greatest(0, f.down - o.r - 0.25) AS d, f.alarms FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.i = f.i + 1))
SELECT o_custkey, max(i) AS n, max(alarms)::BIGINT AS alarms, round(arg_max(up, i), 6) AS up, round(arg_max(down, i), 6) AS down FROM f GROUP BY 1""")
def cusum_drift(spark, sf):
    o = orders(spark, sf).withColumn("r", F.col("cents") / 10_000_000.0 - 2)
    c = windows.cusum_alarms(o, ["o_custkey"], SEQ, "r", 0.25, 3.0)
    return c.withColumn("up", r6(F.col("up"))).withColumn("down", r6(F.col("down")))


@query("""
WITH s AS (SELECT b, sum(w * y)::BIGINT AS ys, sum(w)::BIGINT AS ws FROM (SELECT b, toxic AS y, ('0x' || substr(md5(b || ':' || doc_id), 1, 8))::BIGINT % 3 AS w FROM labels, (SELECT unnest(generate_series(1, 50)) AS b)) GROUP BY 1)
SELECT count(*) AS draws, round(quantile_cont(ys / ws, 0.05), 6) AS low, round(quantile_cont(ys / ws, 0.95), 6) AS high FROM s""")
def hash_bootstrap_ci(spark, sf):
    l = read(spark, sf, "labels").select("doc_id", "toxic", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("b"))  # noqa: E741
    w = F.conv(F.substring(F.md5(F.concat_ws(":", "b", "doc_id")), 1, 8), 16, 10).cast("long") % 3
    s = l.withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("toxic")) / F.sum("w")).alias("rate"))
    return s.agg(F.count("*").alias("draws"), r6(F.percentile("rate", 0.05)).alias("low"), r6(F.percentile("rate", 0.95)).alias("high"))


@query("""
WITH g AS (SELECT l_returnflag AS model, l_linestatus AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2), m AS (SELECT model, avg(loss) AS loss, stddev_samp(loss) / sqrt(count(*)) AS se, min(model) AS complexity FROM g GROUP BY 1),
b AS (SELECT loss + coalesce(se, 0) AS cut FROM m ORDER BY loss, model LIMIT 1) SELECT model, round(loss, 6) AS loss FROM m, b WHERE loss <= cut ORDER BY complexity LIMIT 1""")
def one_se_select(spark, sf):
    g = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model"), "l_linestatus").agg(F.avg("l_discount").alias("loss"))
    m = g.groupBy("model").agg(F.avg("loss").alias("loss"), (F.stddev_samp("loss") / F.sqrt(F.count("*"))).alias("se"))
    best = m.agg(F.min(F.struct("loss", "model", "se")).alias("b")).select((F.col("b.loss") + F.coalesce("b.se", F.lit(0.0))).alias("cut"))
    return m.join(F.broadcast(best), F.col("loss") <= F.col("cut")).groupBy().agg(F.min(F.struct("model", "loss")).alias("b")).select("b.model", r6(F.col("b.loss")).alias("loss"))


@query()
def ridge_ratings(spark, sf):
    return models.ridge(read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", 1.0)


@query()
def elo_fold(spark, sf):
    e = read(spark, sf, "events").select("event_type", "event_id", F.col("user_id").alias("a"), F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id")).alias("b"))
    return models.elo(e.where("b IS NOT NULL AND a <> b"), "event_type", "event_id", "a", "b")

"""Queries of price, calibration, prior and selection operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import prices as P
from tidemark.functions import scalars as S
from tidemark.operators import consensus, evaluation, fits, folds, joins, pricing, priors, resampling, walkforward
from tidemark.plans.registry import query, r6, read
from tidemark.sources import tables
from tidemark.streaming import consensus as streams

QUOTE = "(SELECT *, date_trunc('day', ts)::DATE AS day, round(value * 100)::BIGINT AS cents FROM events)"
PROBS = "(SELECT l.doc_id, l.toxic AS y, l.quality, d.source, d.n_chars, (d.n_chars % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


def quotes(spark, sf):
    return read(spark, sf, "events").withColumn("day", F.to_date("ts")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


def probs(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars", ((F.col("n_chars") % 1000) / 1000.0).alias("p"))
    return read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y"), "quality").join(d, "doc_id")


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


# prices

_PAIR = "(SELECT p_partkey, p_size, 0.5::DOUBLE + ((p_size % 40) - 20) / 50.0::DOUBLE AS a, 1.05::DOUBLE - (0.5::DOUBLE + ((p_size % 40) - 20) / 50.0::DOUBLE) AS b FROM part)"


@query(f"""
WITH RECURSIVE pair AS (SELECT DISTINCT p_size, a, b FROM {_PAIR}),
k AS (SELECT p_size, a, b, 1.0::DOUBLE AS lo, 64.0::DOUBLE AS hi, 0 AS i FROM pair
 UNION ALL SELECT p_size, a, b, CASE WHEN a ** ((lo + hi) / 2) + b ** ((lo + hi) / 2) > 1 THEN (lo + hi) / 2 ELSE lo END,
   CASE WHEN a ** ((lo + hi) / 2) + b ** ((lo + hi) / 2) > 1 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM k WHERE i < 60),
f AS (SELECT p_size, a ** ((lo + hi) / 2) AS power, ((a + b) - 1) * ((a - b) ** 2 - (a + b)) / ((a + b) * ((a - b) ** 2 - 1)) AS z, a, b FROM k WHERE i = 60)
SELECT p_partkey, round(power, 6) AS power, round((sqrt(z * z + 4 * (1 - z) * f.a * f.a / (f.a + f.b)) - z) / (2 * (1 - z)), 6) AS shin, round(f.a / (f.a + f.b), 6) AS proportional
FROM part JOIN f USING (p_size)""")
def devig_methods(spark, sf):
    a = F.lit(0.5) + ((F.col("p_size") % 40) - 20) / 50.0
    t = read(spark, sf, "part").select("p_partkey", a.alias("a"), (1.05 - a).alias("b"))
    return t.select("p_partkey", r6(P.power_devig(F.col("a"), F.col("b"))).alias("power"), r6(P.shin_devig(F.col("a"), F.col("b"))).alias("shin"), r6(F.col("a") / (F.col("a") + F.col("b"))).alias("proportional"))


def _regions_sql(edge: str, sd: str, line: str) -> tuple[str, str, str]:
    whole = f"abs({line} - round({line})) <= 1e-8::DOUBLE"
    above, below, plain = (S.normal_cdf_sql(f"(({c} - {edge}) / {sd})") for c in ("0.5::DOUBLE", "(-0.5::DOUBLE)", "0::DOUBLE"))
    plain = S.normal_cdf_sql(f"({edge} / {sd})")
    return f"CASE WHEN {whole} THEN 1 - {above} ELSE {plain} END", f"CASE WHEN {whole} THEN {above} - {below} ELSE 0::DOUBLE END", f"CASE WHEN {whole} THEN {below} ELSE 1 - {plain} END"


_WIN, _PUSH, _LOSS = _regions_sql("(m + rung)", "12.75::DOUBLE", "rung")


@query(f"""
WITH g AS (SELECT p_partkey, p_size - 25.0::DOUBLE AS m, (p_size % 13) / 2.0::DOUBLE - 3 + unnest(generate_series(-14, 14)) AS rung FROM part),
w AS (SELECT p_partkey, rung, {_WIN} AS win, {_PUSH} AS push, {_LOSS} AS loss FROM g)
SELECT p_partkey, rung, round(win, 6) AS win, round(push, 6) AS push, round(loss, 6) AS loss,
  CASE WHEN win > 0.01 THEN round(1 / least(win / (win + loss) * 1.045::DOUBLE, 1 - 1e-9::DOUBLE), 4) END AS offered FROM w""")
def alternate_ladder(spark, sf):
    t = read(spark, sf, "part").select("p_partkey", (F.col("p_size") - 25.0).alias("m"), ((F.col("p_size") % 13) / 2.0 - 3).alias("line"))
    return rounded(pricing.ladder(t, ["p_partkey"], "m", "line", 12.75), "win", "push", "loss").withColumn("offered", F.round("offered", 4))


_GRID = f"""(SELECT p_partkey, margin, CASE WHEN margin = 75 THEN 1 ELSE {S.normal_cdf_sql('((margin + 0.5::DOUBLE - m) / 12.75::DOUBLE)')} END - CASE WHEN margin = -75 THEN 0 ELSE {S.normal_cdf_sql('((margin - 0.5::DOUBLE - m) / 12.75::DOUBLE)')} END AS p
FROM (SELECT p_partkey, p_size - 25.0::DOUBLE AS m, unnest(generate_series(-75, 75))::INT AS margin FROM part))"""


@query(f"""
SELECT p_partkey, round(sum(p) FILTER (WHERE margin > 3) / sum(p), 6) AS cover, round(sum(p) FILTER (WHERE margin = 3) / sum(p), 6) AS push, round(sum(p) FILTER (WHERE margin < 3) / sum(p), 6) AS fail FROM {_GRID} GROUP BY 1""")
def cover_probabilities(spark, sf):
    g = pricing.folded_grid(read(spark, sf, "part").withColumn("m", F.col("p_size") - F.lit(25.0)), ["p_partkey"], "m", 12.75, -75, 75)
    return rounded(pricing.covers(g, ["p_partkey"], "margin", "p", F.lit(-3)), "cover", "push", "fail")


_CURVE = f"""(CASE WHEN margin = 25 THEN 1 ELSE {S.normal_cdf_sql('((margin + 0.5::DOUBLE) / 14.0::DOUBLE)')} END - CASE WHEN margin = -25 THEN 0 ELSE {S.normal_cdf_sql('((margin - 0.5::DOUBLE) / 14.0::DOUBLE)')} END)"""


@query(f"""
WITH h AS (SELECT l_linenumber, l_quantity::INT - 25 AS margin, count(*) AS k FROM lineitem GROUP BY 1, 2), n AS (SELECT l_linenumber, sum(k) AS n FROM h WHERE margin BETWEEN -25 AND 25 GROUP BY 1),
g AS (SELECT l_linenumber, n, unnest(generate_series(-25, 25))::INT AS margin FROM n)
SELECT l_linenumber, margin, round((coalesce(k, 0) + 200 * {_CURVE}) / (n + 200), 6) AS p FROM g LEFT JOIN h USING (l_linenumber, margin)""")
def empirical_pmf(spark, sf):
    l = read(spark, sf, "lineitem").select("l_linenumber", (F.col("l_quantity").cast("int") - 25).alias("m"))  # noqa: E741
    return rounded(pricing.shrunk_grid(l, "l_linenumber", "m", 14.0, -25, 25), "p")


_BET = "(SELECT event_id, user_id, date_trunc('week', ts)::DATE AS week, (event_id % 97 + 1) / 99.0::DOUBLE AS p, 1 / (1 + value / 50) AS q, 1 + value / 50 AS d FROM events)"


def _bets(spark, sf):
    d = 1 + F.col("value") / 50
    return read(spark, sf, "events").select("event_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), ((F.col("event_id") % 97 + 1) / 99.0).alias("p"), (1 / d).alias("q"), d.alias("d"))


def _kl_sql(p: str, q: str) -> str:
    a, b = (f"least(greatest({x}, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE)" for x in (p, q))
    return f"({a} * ln({a} / {b}) + (1 - {a}) * ln((1 - {a}) / (1 - {b})))"


@query(f"""
WITH e AS (SELECT *, p - q - {_kl_sql('p', 'q')} / 2 AS edge FROM {_BET}),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN d <= 1.2 THEN 'PRICE_TOO_SHORT' END, CASE WHEN edge < 0.02 THEN 'EDGE_TOO_SMALL' END, CASE WHEN p < 0.1 THEN 'TOO_UNLIKELY' END], lambda x: x IS NOT NULL), ';') AS reasons FROM e),
s AS (SELECT *, CASE WHEN reasons = '' THEN greatest(0, (p * (d - 1) - (1 - p)) / (d - 1)) * 0.25 ELSE 0 END AS stake FROM r), t AS (SELECT *, sum(stake) OVER (PARTITION BY week) AS total FROM s)
SELECT event_id, round(edge, 6) AS edge, reasons, round(stake * least(1, CASE WHEN total = 0 THEN 1 ELSE 5 / total END), 6) AS stake FROM t""")
def staking_reasons(spark, sf):
    from tidemark.operators import windows

    e = _bets(spark, sf).withColumn("edge", P.penalized_edge(F.col("p"), F.col("q")))
    why = F.array_compact(F.array(F.when(F.col("d") <= 1.2, "PRICE_TOO_SHORT"), F.when(F.col("edge") < 0.02, "EDGE_TOO_SMALL"), F.when(F.col("p") < 0.1, "TOO_UNLIKELY")))
    e = e.withColumn("reasons", F.array_join(why, ";")).withColumn("stake", F.when(F.col("reasons") == "", pricing.kelly(F.col("p"), F.col("d")) * 0.25).otherwise(0.0))
    return rounded(windows.capped_share(e, ["week"], "stake", 5.0, "stake").select("event_id", "edge", "reasons", "stake"), "edge", "stake")


@query("""
SELECT p_partkey, round(1 / (1 + 10 ** (-g / 400)), 6) AS chance, round(g / 25, 6) AS margin, round(CASE WHEN g * 0.001 + 2.2 > 0 THEN ln(m + 1) * 2.2::DOUBLE / (g * 0.001::DOUBLE + 2.2::DOUBLE) END, 6) AS multiplier
FROM (SELECT p_partkey, (p_size - 25) * 20.0::DOUBLE AS g, p_size % 15 AS m FROM part)""")
def elo_formulas(spark, sf):
    g = (F.col("p_size") - 25) * 20.0
    return read(spark, sf, "part").select("p_partkey", r6(P.elo_chance(g)).alias("chance"), r6(g / 25).alias("margin"), r6(P.margin_multiplier(F.col("p_size") % 15, g)).alias("multiplier"))


@query(f"""
SELECT doc_id, CASE WHEN quality > 2 THEN 2 ELSE 1 END * round((25 - 100 * (p - y) ** 2)::DECIMAL(18, 9), 1)::DOUBLE AS points FROM {PROBS}""")
def contest_scores(spark, sf):
    return probs(spark, sf).select("doc_id", P.contest_points(F.col("p"), F.col("y"), F.col("quality") + 15).alias("points"))


@query("""
WITH l AS (SELECT l_suppkey, l_quantity - 25 AS m, l_linenumber * 500 AS t FROM lineitem)
SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE abs(m) <= CASE WHEN t > 1800 THEN 24 WHEN t > 900 THEN 20 WHEN t > 300 THEN 16 ELSE 8 END) AS competitive FROM l GROUP BY 1""")
def competitive_masks(spark, sf):
    mask = P.competitive(F.col("l_linenumber") * 500, F.col("l_quantity") - 25)
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(mask).alias("competitive"))


@query("""
SELECT CASE WHEN k = 0 THEN 'GLOBAL' WHEN x IS NULL THEN 'MISSING' WHEN x <> round(x) THEN 'NO_PUSH' ELSE 'INT_' || round(CASE WHEN k = 1 THEN abs(x) ELSE x END)::BIGINT END AS bucket, count(*) AS n
FROM (SELECT p_partkey % 3 AS k, CASE WHEN p_partkey % 50 <> 7 THEN (p_size - 25) / 2.0::DOUBLE END AS x FROM part) GROUP BY 1""")
def push_buckets(spark, sf):
    market = F.element_at(F.array(F.lit("moneyline"), F.lit("spread"), F.lit("total")), (F.col("p_partkey") % 3 + 1).cast("int"))
    line = F.when(F.col("p_partkey") % 50 != 7, (F.col("p_size") - 25) / 2.0)
    return read(spark, sf, "part").groupBy(P.push_bucket(market, line).alias("bucket")).agg(F.count("*").alias("n"))


# quotes and consensus

_OUT = "SELECT o_orderkey::VARCHAR AS id, l_suppkey::VARCHAR AS book, l_returnflag AS market, CASE WHEN l_linestatus = 'F' THEN 'home' ELSE 'under' END AS side, l_extendedprice AS price, l_quantity::DOUBLE AS point"


@query(f"{_OUT} FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def quote_flatten(spark, sf):
    """Nested quote payloads, written as JSON from the lines of each order, and flattened again."""
    l = read(spark, sf, "lineitem")  # noqa: E741
    outcome = F.struct(F.when(F.col("l_linestatus") == "F", "Ayes").otherwise("Under").alias("name"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("double").alias("point"))
    m = l.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.collect_list(outcome).alias("outcomes"))
    b = m.groupBy("l_orderkey", "l_suppkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("key"), "outcomes")).alias("markets"))
    e = b.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").cast("string").alias("key"), "markets")).alias("bookmakers"))
    e = e.join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    payload = F.to_json(F.array(F.struct(F.col("l_orderkey").cast("string").alias("id"), F.lit("Ayes").alias("home_team"), F.lit("Noes").alias("away_team"), "bookmakers")))
    return tables.flatten_quotes(e.select(payload.alias("payload"))).select("id", "book", "market", "side", "price", "point")


_PAIRS = f"""(SELECT day, a / (a + b)::DOUBLE AS p, a + b AS h FROM (SELECT day, user_id, max(cents) FILTER (WHERE event_type = 'click') AS a, max(cents) FILTER (WHERE event_type = 'purchase') AS b FROM {QUOTE} GROUP BY 1, 2) WHERE a > 0 AND b > 0)"""


@query(f"SELECT day, round(median(p), 6) AS fair_probability, round(stddev_pop(p), 6) AS dispersion, median(h)::DOUBLE AS hold, count(*) AS sources FROM {_PAIRS} GROUP BY 1")
def book_pair_consensus(spark, sf):
    c = consensus.paired_consensus(quotes(spark, sf), ["day"], "user_id", "event_type", ("click", "purchase"), "cents")
    return rounded(c, "fair_probability", "dispersion").withColumn("hold", F.col("hold").cast("double"))


@query(f"""
WITH d AS (SELECT DISTINCT day FROM {QUOTE}), c AS (SELECT day, median(p) AS fair, count(*) AS k FROM (SELECT day, a / (a + b)::DOUBLE AS p FROM (
  SELECT day, user_id, max(cents) FILTER (WHERE event_type = 'click') AS a, max(cents) FILTER (WHERE event_type = 'purchase') AS b FROM {QUOTE} WHERE value BETWEEN 5 AND 200 AND day <= DATE '2024-01-20' GROUP BY 1, 2) WHERE a > 0 AND b > 0) GROUP BY 1)
SELECT day, round(fair, 6) AS fair_probability, coalesce(k, 0) AS sources, CASE WHEN k IS NULL THEN 'NO_QUOTE' WHEN k < 3 THEN 'INDICATIVE_ONLY' ELSE 'PRICED' END AS status FROM d LEFT JOIN c USING (day)""")
def market_pricing(spark, sf):
    """Quotes to prices: valid and timely quotes, both sides of a source, fair shares, consensus, status."""
    q = quotes(spark, sf).withColumn("age", F.datediff(F.lit("2024-01-20").cast("date"), "day") * 86_400)
    ok = consensus.freshness(q, "age", "value", 10**9, 5, 200).where("eligible = 1")
    c = consensus.paired_consensus(ok, ["day"], "user_id", "event_type", ("click", "purchase"), "cents")
    j = q.select("day").distinct().join(c, "day", "left")
    status = F.when(F.col("sources").isNull(), "NO_QUOTE").when(F.col("sources") < 3, "INDICATIVE_ONLY").otherwise("PRICED")
    return j.select("day", r6(F.col("fair_probability")).alias("fair_probability"), F.coalesce("sources", F.lit(0)).alias("sources"), status.alias("status"))


@query(f"""
WITH a AS (SELECT user_id, day, median(cents)::DOUBLE AS v FROM {QUOTE} WHERE event_type = 'click' GROUP BY 1, 2), b AS (SELECT user_id, day, median(cents)::DOUBLE AS v FROM {QUOTE} WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT user_id, day, a.v AS old, b.v AS new, b.v - a.v AS change, CASE WHEN b.v IS NULL THEN 'old_only' WHEN a.v IS NULL THEN 'new_only' ELSE 'both' END AS found FROM a FULL JOIN b USING (user_id, day)""")
def consensus_diff(spark, sf):
    q = quotes(spark, sf)
    of = lambda t: q.where(F.col("event_type") == t).groupBy("user_id", "day").agg(F.median("cents").cast("double").alias("v"))
    return consensus.compared(of("click"), of("purchase"), ["user_id", "day"], "v")


@query(f"SELECT epoch_us(date_trunc('day', ts)) AS start, event_type, count(*) AS n, min(user_id) AS first_source, max(user_id) AS last_source, sum(cents)::BIGINT AS total FROM {QUOTE} GROUP BY 1, 2")
def stream_consensus(spark, sf):
    """The events file read as a stream, drained once into a table."""
    schema = read(spark, sf, "events").schema
    live = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100))
    out = streams.drained(streams.windowed(live, "ts", "event_type", "user_id", "cents", "1 day", "1 hour"))
    return out.select(F.unix_micros("start").alias("start"), "event_type", "n", "first_source", "last_source", F.round(F.col("mean_value") * F.col("n")).cast("long").alias("total"))


# joins and checks

@query("""
WITH l AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT'), r AS (SELECT o_orderkey AS rid, o_custkey, o_orderdate AS rt FROM orders WHERE o_orderpriority <> '1-URGENT'),
j AS (SELECT l.o_orderkey, r.rid, abs(epoch_us(l.o_orderdate) - epoch_us(r.rt)) AS g FROM l LEFT JOIN r USING (o_custkey)),
a AS (SELECT o_orderkey, count(rid) AS k, count(*) FILTER (WHERE g <= 2592000000000) AS c, min((g, rid)) FILTER (WHERE g <= 2592000000000) AS b FROM j GROUP BY 1)
SELECT o_orderkey, b[2] AS match_id, c AS candidates, CASE WHEN k = 0 THEN 'key_not_found' WHEN c = 0 THEN 'outside_tolerance' WHEN c = 1 THEN 'matched' ELSE 'matched_nearest_ambiguous' END AS status FROM a""")
def crosswalk_counts(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    right = o.where(~urgent).select("o_custkey", F.col("o_orderkey").alias("rid"), F.col("o_orderdate").alias("rt"))
    return joins.nearest_within(o.where(urgent), right, ["o_custkey"], "o_orderkey", "rid", "o_orderdate", "rt", 30 * 86_400)


@query("""
SELECT 'customer_without_order' AS gap, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
UNION ALL SELECT 'order_without_line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)""")
def coverage_gaps(spark, sf):
    c, o, l = (read(spark, sf, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    one = c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("customer_without_order").alias("gap"), "n")
    two = o.join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("n")).select(F.lit("order_without_line").alias("gap"), "n")
    return one.unionByName(two)


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_nationkey > 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS missing,
  ((c_mktsegment = 'BUILDING')::INT + (c_acctbal < 0)::INT + (c_nationkey > 20)::INT) AS n_missing FROM customer""")
def missing_features(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("nation"))
    gone = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in ("segment", "balance", "nation")]))
    return c.select("c_custkey", F.array_join(gone, ",").alias("missing"), F.size(gone).alias("n_missing"))


@query("""
SELECT side, nation, count(*) AS n FROM (SELECT 'seller' AS side, s_nationkey AS nation FROM supplier UNION ALL SELECT 'buyer', c_nationkey FROM customer) GROUP BY 1, 2""")
def long_sides(spark, sf):
    s = read(spark, sf, "supplier").select(F.lit("seller").alias("side"), F.col("s_nationkey").alias("nation"))
    c = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("buyer").alias("side"))
    return s.unionByName(c).groupBy("side", "nation").agg(F.count("*").alias("n"))


# priors

_EXPERIENCE = "CASE WHEN y = 12 THEN 'unknown' WHEN y <= 0 THEN 'rookie' WHEN y <= 2 THEN 'years_1_2' WHEN y <= 5 THEN 'years_3_5' WHEN y <= 9 THEN 'years_6_9' ELSE 'years_10_plus' END"


@query(f"""
WITH l AS (SELECT l_suppkey, l_discount AS v, l_quantity * 0.5::DOUBLE ** ((2002 - year(l_shipdate)) / 2.0::DOUBLE) AS w FROM lineitem),
e AS (SELECT l_suppkey, {_EXPERIENCE} AS bucket, w, s / w AS m, s FROM (SELECT l_suppkey, l_suppkey % 13 AS y, sum(w) AS w, sum(w * v) AS s FROM l GROUP BY 1, 2)),
b AS (SELECT bucket, sum(s) / sum(w) AS mu, sum(w * m * m) / sum(w) AS q FROM e GROUP BY 1)
SELECT l_suppkey, bucket, round(w, 4) AS weight, round(w / (w + 200) * m + 200 / (w + 200) * mu, 6) AS prior_mean, round(greatest(0, q - mu * mu), 9) AS bucket_variance FROM e JOIN b USING (bucket)""")
def qb_style_prior(spark, sf):
    y = F.when(F.col("l_suppkey") % 13 != 12, F.col("l_suppkey") % 13)
    l = read(spark, sf, "lineitem").select("l_suppkey", "l_discount", F.col("l_quantity").cast("double").alias("amount"), (2002 - F.year("l_shipdate")).alias("age"))  # noqa: E741
    p = priors.aged(l, "l_suppkey", "l_discount", "amount", "age", 2.0, P.experience(y), 200.0)
    return p.select("l_suppkey", "bucket", F.round("weight", 4).alias("weight"), r6(F.col("prior_mean")).alias("prior_mean"), F.round("bucket_variance", 9).alias("bucket_variance"))


@query("""
WITH h AS (SELECT round(value * 2) / 2 AS line, (event_id % 11 = 0)::INT AS push FROM events), k AS (SELECT line, count(*) AS n, sum(push) AS k FROM h WHERE line = round(line) GROUP BY 1), g AS (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS g FROM k)
SELECT line, n, round(least(0.25, (k + 50 * g) / (n + 50)), 6) AS rate FROM k, g""")
def push_prior(spark, sf):
    h = read(spark, sf, "events").select((F.round(F.col("value") * 2) / 2).alias("line"), (F.col("event_id") % 11 == 0).cast("int").alias("push"))
    return rounded(priors.push_rates(h, "line", "push"), "rate")


@query("""
WITH g AS (SELECT o_custkey, o_orderkey, round(o_totalprice * 100)::BIGINT AS c FROM orders), s AS (SELECT o_custkey, o_orderkey, c / sum(c) OVER (PARTITION BY o_custkey)::DOUBLE AS p, o_orderkey % 10 = 0 AS o FROM g),
t AS (SELECT *, count(*) FILTER (WHERE o) OVER (PARTITION BY o_custkey) * 0.02::DOUBLE AS given, sum(p) FILTER (WHERE NOT o) OVER (PARTITION BY o_custkey) AS rest FROM s)
SELECT o_custkey, o_orderkey, round(CASE WHEN o THEN 0.02::DOUBLE WHEN given = 0 THEN p ELSE p / rest * (1 - given) END, 6) AS p, CASE WHEN o THEN 'override' ELSE 'generated' END AS origin FROM t""")
def override_redistribution(spark, sf):
    from pyspark.sql import Window

    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    g = o.select("o_custkey", "o_orderkey", (F.col("c") / F.sum("c").over(Window.partitionBy("o_custkey"))).alias("p"))
    given = o.where("o_orderkey % 10 = 0").select("o_custkey", "o_orderkey", F.lit(0.02).alias("p"))
    return rounded(priors.overridden(g, given, "o_custkey", "o_orderkey", "p"), "p")


# calibration and selection

@query(f"""
WITH n AS (SELECT *, count(*) OVER () AS n FROM {PROBS} WHERE p IS NOT NULL AND y IS NOT NULL), k AS (SELECT *, greatest(3, least(10, n // 12)) AS k, row_number() OVER (ORDER BY p, doc_id) - 1 AS r FROM n),
b AS (SELECT CASE WHEN r < (n % k) * (n // k + 1) THEN r // (n // k + 1) ELSE n % k + (r - (n % k) * (n // k + 1)) // (n // k) END AS bin, n, count(*) AS c, abs(avg(p) - avg(y)) AS gap FROM k GROUP BY 1, 2)
SELECT coalesce(max(n), 0) AS n, count(*) AS bins, round(CASE WHEN max(n) >= 36 THEN sum(c * gap) / max(n) END, 6) AS ece FROM b""")
def ece_mass(spark, sf):
    return rounded(evaluation.equal_mass_ece(probs(spark, sf), "p", "y", "doc_id"), "ece")


@query("""
WITH e AS (SELECT event_id, user_id, (event_id % 97) / 97.0::DOUBLE AS p, (event_id % 7 < 2)::INT AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT a.event_id, a.i, least(floor(e.p * 10), 9) AS b, abs(sum(e.p - e.y)) AS gap FROM e a JOIN e ON e.user_id = a.user_id AND e.i BETWEEN a.i - 63 AND a.i GROUP BY 1, 2, 3)
SELECT event_id, CASE WHEN i >= 64 THEN round(sum(gap) / 64, 6) END AS trailing_ece FROM b GROUP BY event_id, i""")
def rolling_ece64(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", ((F.col("event_id") % 97) / 97.0).alias("p"), (F.col("event_id") % 7 < 2).cast("int").alias("y"))
    return rounded(evaluation.trailing_ece(e, ["user_id"], ["ts", "event_id"], "p", "y").select("event_id", "trailing_ece"), "trailing_ece")


@query("SELECT round(regr_slope(r, t), 6) AS slope, round(regr_intercept(r, t), 6) AS intercept FROM (SELECT abs(l_quantity - 25.5::DOUBLE) * 1.2533141373155001::DOUBLE AS r, l_linenumber::DOUBLE AS t FROM lineitem)")
def linear_sigma(spark, sf):
    r, t = F.abs(F.col("l_quantity") - 25.5) * 1.2533141373155001, F.col("l_linenumber").cast("double")
    return read(spark, sf, "lineitem").select(r.alias("r"), t.alias("t")).agg(r6(F.regr_slope("r", "t")).alias("slope"), r6(F.regr_intercept("r", "t")).alias("intercept"))


_SEASON = "(SELECT year(l_shipdate)::INT AS season, l_suppkey, l_quantity - 25 AS r FROM lineitem)"


@query(f"""
WITH s AS (SELECT season, count(*) AS n, sum(r * r) AS q FROM {_SEASON} GROUP BY 1), w AS (SELECT season, sum(n) OVER b AS n, sum(q) OVER b AS q FROM s WINDOW b AS (ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT season, n, sigma, round(ln(sigma) + 0.9189385332046727::DOUBLE + q / (n * 2 * sigma * sigma), 9) AS loss FROM w, (SELECT unnest([10.0, 12.0, 13.0, 14.0, 14.25, 14.5, 15.0, 16.0])::DOUBLE AS sigma) WHERE n > 0)
SELECT season, n::BIGINT AS n, min((loss, sigma))[2] AS sigma, min(loss) AS loss FROM g GROUP BY 1, 2""")
def sigma_by_season(spark, sf):
    l = read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("season"), (F.col("l_quantity") - 25).cast("double").alias("r"))  # noqa: E741
    return folds.spread_by_season(l, "season", "r", [10.0, 12.0, 13.0, 14.0, 14.25, 14.5, 15.0, 16.0])


_BOOK = "(SELECT year(o_orderdate)::INT AS season, (o_custkey % 20)::INT AS book, (o_orderkey % 89 + 1) / 91.0::DOUBLE AS p, (o_orderstatus = 'F')::INT AS y FROM orders)"


@query(f"""
WITH s AS (SELECT season, book, count(*) AS k, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) AS l FROM {_BOOK} GROUP BY 1, 2), e AS (SELECT * FROM (SELECT DISTINCT season FROM s), (SELECT DISTINCT book FROM s)),
t AS (SELECT season, book, sum(k) OVER b AS k, sum(l) OVER b AS l, count(k) OVER b AS seasons FROM e LEFT JOIN s USING (season, book) WINDOW b AS (PARTITION BY book ORDER BY season RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, min((round(l / k, 9), book))[2] AS anchor, min(round(l / k, 9)) AS loss FROM t WHERE k >= 5 AND seasons >= 2 GROUP BY 1""")
def sharp_anchor(spark, sf):
    o = read(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), (F.col("o_custkey") % 20).cast("int").alias("book"), ((F.col("o_orderkey") % 89 + 1) / 91.0).alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return folds.anchor_source(o, "book", "season", "p", "y", 5, 2)


_FOLD = "(SELECT l_linenumber::INT AS model, year(l_shipdate)::INT AS fold, avg(l_discount) AS loss FROM lineitem GROUP BY 1, 2)"


@query(f"""
WITH f AS {_FOLD}, g AS (SELECT f.model, f.fold, b.loss - f.loss AS gain FROM f LEFT JOIN (SELECT fold, loss FROM f WHERE model = 1) b USING (fold) WHERE f.model <> 1),
a AS (SELECT model, count(DISTINCT fold) AS folds, avg(gain) AS mean_gain, min(gain) AS worst_gain, count(*) FILTER (WHERE gain > 1e-12) AS won FROM g GROUP BY 1),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT coalesce(mean_gain > 0, false) THEN 'MEAN_NOT_BETTER' END, CASE WHEN won < 4 THEN 'TOO_FEW_FOLDS_WON' END, CASE WHEN NOT coalesce(worst_gain >= -0.003, false) THEN 'ONE_FOLD_TOO_BAD' END], lambda x: x IS NOT NULL), '|') AS why FROM a)
SELECT model, folds, round(mean_gain, 9) AS mean_gain, round(worst_gain, 9) AS worst_gain, won, (why = '')::INT AS qualifies, CASE WHEN why = '' THEN 'PASS' ELSE why END AS reasons FROM r""")
def fold_stability(spark, sf):
    f = read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("model"), F.year("l_shipdate").alias("fold")).agg(F.avg("l_discount").alias("loss"))
    s = folds.stability(f, "model", "fold", "loss", 1, 0.0, 4, 0.003)
    return s.withColumn("mean_gain", F.round("mean_gain", 9)).withColumn("worst_gain", F.round("worst_gain", 9)).select("model", "folds", "mean_gain", "worst_gain", "won", "qualifies", "reasons")


@query(f"""
WITH s AS (SELECT l_suppkey, season, sum(r) AS s, count(*) AS n FROM {_SEASON} GROUP BY 1, 2), t AS (SELECT *, sum(s) OVER w AS ts, sum(n) OVER w AS tn FROM s WINDOW w AS (PARTITION BY l_suppkey))
SELECT l_suppkey, season, round((ts - s) / CASE WHEN tn > n THEN tn - n END, 6) AS mean_without, (sign((ts - s) / CASE WHEN tn > n THEN tn - n END) = sign(ts))::INT AS same_sign FROM t""")
def leave_one_season_out(spark, sf):
    l = read(spark, sf, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("season"), (F.col("l_quantity") - 25).cast("double").alias("r"))  # noqa: E741
    return rounded(folds.leave_one_out(l, ["l_suppkey"], "season", "r"), "mean_without")


def _bootstrap_sql(cluster: str, label: str, stratum: str) -> str:
    return f"""
WITH c AS (SELECT {cluster} AS c, {stratum} AS g, sum(cents) AS s, count(*) AS n FROM {QUOTE} GROUP BY 1, 2), d AS (SELECT b, g, s, n, {resampling.draws_of_sql('b', label)} AS k FROM c, (SELECT unnest(generate_series(1, 50)) AS b)),
p AS (SELECT b, g, sum(k * s) AS s, sum(k * n) AS n, sum(n) AS w, sum(s) AS t FROM d GROUP BY 1, 2 HAVING sum(k * n) > 0), m AS (SELECT b, sum(s / n::DOUBLE * w) / sum(w) AS m, sum(t) / sum(w)::DOUBLE AS mean FROM p GROUP BY 1)
SELECT count(*) AS draws, round(max(mean), 4) AS mean, round(quantile_cont(m, 0.05), 4) AS low, round(quantile_cont(m, 0.95), 4) AS high FROM m"""


def _four(df):
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "low", "high")})


@query(_bootstrap_sql("user_id", "c", "1"))
def bootstrap_clusters(spark, sf):
    return _four(resampling.bootstrap(quotes(spark, sf), "cents", ["user_id"], 50, 0.05, 0.95))


@query(_bootstrap_sql("event_id", "c", "event_type"))
def bootstrap_strata(spark, sf):
    return _four(resampling.bootstrap(quotes(spark, sf), "cents", ["event_id"], 50, 0.05, 0.95, ["event_type"]))


def _weights(spark, fit):
    return spark.createDataFrame(sorted(fit.items()), "term string, weight double")


@query()
def calibration_slope(spark, sf):
    """Slope and intercept of outcomes on the logit of probabilities."""
    p = probs(spark, sf).withColumn("logit", F.log(S.clipped("p")) - F.log(1 - S.clipped("p")))
    return _weights(spark, fits.logistic(p, ["logit"], "y"))


@query()
def offset_logistic(spark, sf):
    """A fit that starts from the market's logit and learns what to add."""
    p = probs(spark, sf).withColumn("logit", F.log(S.clipped("p")) - F.log(1 - S.clipped("p"))).withColumn("size", F.log1p("n_chars"))
    return _weights(spark, fits.logistic(p, ["size", "quality"], "y", 1.0, "logit"))


@query()
def side_ratings(spark, sf):
    """Ridge effects of sellers' and buyers' nations on quantities, per year."""
    l = read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", F.year("l_shipdate").alias("season"))  # noqa: E741
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("seller"))
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = read(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("buyer"))
    return fits.side_ratings(l.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "c_custkey"), ["season"], "seller", "buyer", "l_quantity", 20.0)


@query()
def walkforward_logistic(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), "o_totalprice", F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return walkforward.expanding(o, "season", ["o_totalprice", "month"], "y", ["o_orderkey"])


@query()
def walkforward_trees(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"), "o_totalprice", F.month("o_orderdate").alias("month"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return walkforward.expanding(o, "season", ["o_totalprice", "month"], "y", ["o_orderkey"], "trees", calibrate=True, rounds=5)

"""Queries of feeds' normalisers, checks, gates, scans and scorecards, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.functions import scalars as S
from tidemark.operators import evaluation, gates, prefix, pricing, priors, scans
from tidemark.plans.registry import query, r6, read


@query("""
SELECT o_orderkey, CASE lower(trim(m)) WHEN 'h2h' THEN 'moneyline' WHEN 'spreads' THEN 'ats' WHEN 'totals' THEN 'total' WHEN 'pregame_total' THEN 'total' END AS market,
  CASE WHEN lower(trim(m)) = 'h2h' AND s IN ('home', 'tie') THEN s WHEN lower(trim(m)) = 'spreads' AND s = 'home' THEN s WHEN lower(trim(m)) IN ('totals', 'pregame_total') AND s = 'over' THEN s END AS selection,
  CASE o_orderstatus WHEN 'P' THEN 'NO_DESIGNATION' WHEN 'F' THEN 'OUT_FOR_SEASON' ELSE 'QUESTIONABLE' END AS status,
  CASE WHEN o_orderkey % 23 = 0 THEN 22 ELSE o_orderkey % 23 - 1 END::INT AS week_order,
  CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END::BIGINT AS status_order, trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug,
  printf('%.2f', o_totalprice) AS shown, regexp_matches(o_orderpriority, 'URGENT|HIGH') AS hot, date_trunc('day', o_orderdate)::DATE AS day
FROM (SELECT *, CASE o_orderkey % 5 WHEN 0 THEN ' H2H' WHEN 1 THEN 'spreads' WHEN 2 THEN 'Totals ' WHEN 3 THEN 'pregame_total' ELSE 'props' END AS m, CASE o_orderkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'over' ELSE 'tie' END AS s FROM orders)""")
def label_rules(spark, sf):
    k = F.col("o_orderkey")
    feed = F.element_at(F.array(*[F.lit(x) for x in (" H2H", "spreads", "Totals ", "pregame_total", "props")]), (k % 5 + 1).cast("int"))
    pick = F.element_at(F.array(F.lit("Home"), F.lit("over "), F.lit("tie")), (k % 3 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "out for season").when(F.col("o_orderstatus") == "O", " questionable").otherwise("")
    week = F.when(k % 23 >= 19, F.element_at(F.array(*[F.lit(r) for r in L.ROUNDS]), F.greatest(F.lit(1), (k % 23 - 18)).cast("int"))).when(k % 23 == 0, "bye").otherwise((k % 23).cast("string"))
    o = read(spark, sf, "orders").withColumns({"m": feed, "week": week})
    return o.select(
        "o_orderkey", L.market("m").alias("market"), L.selection(L.market("m"), pick).alias("selection"), L.status(status).alias("status"), L.week_order("week").cast("int").alias("week_order"), L.in_order("o_orderstatus", ["O", "F"]).alias("status_order"),
        L.slug("o_orderpriority").alias("slug"), L.shown("o_totalprice", 2).alias("shown"), F.col("o_orderpriority").rlike("URGENT|HIGH").alias("hot"), F.to_date(F.date_trunc("day", "o_orderdate")).alias("day"),
    )



_EDGE = "abs(p_size - 25.0::DOUBLE) / 2"


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 0 WHEN p_partkey % 4 = 0 THEN -({_EDGE}) WHEN p_partkey % 4 = 1 THEN {_EDGE} WHEN {_EDGE} = 0 THEN 0 END AS home_spread,
  (45 - ({_EDGE})) / 2 AS home_points, (45 + {_EDGE}) / 2 AS away_points, {_EDGE} AS magnitude, abs({_EDGE} - 3) AS to_three, abs({_EDGE} - 7) AS to_seven, CASE WHEN p_size % 2 = 1 THEN 1 ELSE 0 END::INT AS is_whole, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END::INT AS is_half,
  p_size <= CASE WHEN p_partkey % 200 <= 120 THEN 15 ELSE 1440 END AS fresh, round((p_size / 22.0::DOUBLE + 20 / 24.0::DOUBLE) / 2, 6) AS attack, round(greatest(0, (45.973::DOUBLE - 0.3787::DOUBLE * p_size) / 45.973::DOUBLE), 6) AS wind,
  round(p_size * 0.7::DOUBLE + 40 * 0.3::DOUBLE, 6) AS blended, CASE WHEN p_size >= 20 AND p_size >= p_partkey % 50 THEN 'size' WHEN 20 >= p_partkey % 50 THEN 'flat' ELSE 'key' END AS top, (p_type = 'ECONOMY')::INT AS economy,
  sha256('{{"p_name":"' || p_name || '","p_partkey":' || p_partkey || '}}') AS digest,
  round(-2.2::DOUBLE * 30 + 3.7::DOUBLE * (p_size % 30) + p_size * 0.2::DOUBLE * 10 + 11.3::DOUBLE * (p_size % 4) - 14.1::DOUBLE * (p_size % 3) - 8.0::DOUBLE * (p_size % 5) - 1.1::DOUBLE * 4 + 0.6::DOUBLE * 11 + 15.9::DOUBLE * (p_size % 2), 6) AS passer_value
FROM part""")
def line_rules(spark, sf):
    p, k = read(spark, sf, "part"), F.col("p_partkey")
    size = F.abs(F.col("p_size") - 25.0) / 2
    side = F.when(k % 4 == 3, "pick ").when(k % 4 == 0, "H").when(k % 4 == 1, "A").otherwise("other")
    home, away = L.implied_points(F.lit(45.0), size)
    box = {"attempts": F.lit(30), "completions": F.col("p_size") % 30, "passing_yards": F.col("p_size") * 10, "passing_tds": F.col("p_size") % 4, "interceptions": F.col("p_size") % 3, "sacks": F.col("p_size") % 5, "rush_attempts": F.lit(4), "rush_yards": F.lit(11), "rush_tds": F.col("p_size") % 2}
    p = p.withColumns({**box, "s": F.col("p_size").cast("double")})
    top = L.arg_max({"size": F.col("p_size").cast("long"), "flat": F.lit(20).cast("long"), "key": k % 50})
    return p.select(
        "p_partkey", L.home_spread(side, size, F.lit("H"), F.lit("A")).alias("home_spread"), home.alias("home_points"), away.alias("away_points"), *[c.alias(n) for n, c in L.line_shape(size).items()],
        L.fresh(F.col("s"), k % 200).alias("fresh"), r6(L.strength(F.col("s"), F.lit(20.0), F.lit(22.0), F.lit(24.0))).alias("attack"), r6(L.wind_factor(F.col("s"))).alias("wind"), r6(L.blend(F.col("s"), F.lit(40.0))).alias("blended"),
        top.alias("top"), L.one_hot("p_type", ["ECONOMY"])["ECONOMY"].alias("economy"), L.json_digest("p_partkey", "p_name").alias("digest"), r6(L.passer_value()).alias("passer_value"),
    )


_CARD = "(SELECT event_id, (event_id % 50) / 100.0::DOUBLE AS win, CASE WHEN event_id % 11 = 0 THEN 0.02 ELSE 0 END::DOUBLE AS push, CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1 - (event_id % 50) / 100.0::DOUBLE END AS other, (event_id % 9) / 2.0::DOUBLE AS line, 1 + value / 50 AS d, CASE WHEN event_id % 2 = 0 THEN round(value * 2) END AS a FROM events)"


@query(f"""
SELECT * FROM (SELECT count(*) FILTER (WHERE win < 0 OR win > 1) AS win_in_range, count(*) FILTER (WHERE push < 0 OR push > 1) AS push_in_range, count(*) FILTER (WHERE other IS NULL OR other < 0 OR other > 1) AS other_in_range,
  count(*) FILTER (WHERE other IS NULL OR abs(win + push + other - 1) > 0.0001) AS sum_is_one, count(*) FILTER (WHERE line <> round(line) AND push > 0.000000001) AS no_push_on_half,
  count(*) FILTER (WHERE d <= 1) AS decimal_over_one, count(*) FILTER (WHERE NOT coalesce(a <> 0 AND abs(d - (1 + a / 100)) <= 0.000001, false)) AS prices_agree FROM {_CARD}) UNPIVOT (n FOR rule IN (COLUMNS(*)))""")
def probability_rules(spark, sf):
    k = F.col("event_id")
    card = read(spark, sf, "events").select(
        k, ((k % 50) / 100.0).alias("win"), F.when(k % 11 == 0, 0.02).otherwise(0.0).alias("push"), F.when(k % 17 != 0, 1 - (k % 50) / 100.0).alias("other"), ((k % 9) / 2.0).alias("line"),
        (1 + F.col("value") / 50).alias("d"), F.when(k % 2 == 0, F.round(F.col("value") * 2)).alias("a"),
    )
    return gates.broken_rules(card, gates.identity_rules("win", "push", "other", "line") | gates.odds_rules("d", "a"))


@query("SELECT l_orderkey, total FROM (SELECT l_orderkey, round(sum(l_discount * 4)::DOUBLE, 6) AS total FROM lineitem GROUP BY 1) WHERE abs(total - 1) > 0.001")
def off_share_sums(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_discount") * 4).alias("p"))
    return gates.off_sums(df, ["l_orderkey"], "p", 0.001).withColumn("total", r6(F.col("total")))


@query("""
SELECT o_orderkey, "column" FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN a IS DISTINCT FROM b AND NOT coalesce(abs(a - b) <= 0.005, false) THEN 'a' END, CASE WHEN c IS DISTINCT FROM d THEN 'c' END], lambda x: x IS NOT NULL)) AS "column"
FROM (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(o_totalprice) END AS b, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 3 END AS c, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 2 END AS d FROM orders))""")
def target_audit(spark, sf):
    k = F.col("o_orderkey")
    one = read(spark, sf, "orders").select(k, F.col("o_totalprice").alias("a"), F.when(k % 5 != 0, k % 3).alias("c"))
    two = read(spark, sf, "orders").select(k, F.when(k % 7 != 0, F.round("o_totalprice")).alias("a"), F.when(k % 5 != 0, k % 2).alias("c"))
    return gates.mismatches(one, two, ["o_orderkey"], ["a", "c"], 0.005)


@query("""
WITH g AS (SELECT o_orderkey, o_orderdate AS ko, CASE o_orderkey % 6 WHEN 0 THEN 'final ' WHEN 1 THEN 'Live' WHEN 2 THEN 'CLOSED' ELSE '' END AS st, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL 3 HOUR END AS done, CASE WHEN o_orderkey % 10 = 7 THEN o_orderdate + INTERVAL 4 HOUR END AS play FROM orders),
s AS (SELECT *, TIMESTAMP '1999-06-01 02:00:00' AS t, CASE WHEN ko > TIMESTAMP '1999-06-01 02:00:00' THEN 'POST_ASOF_KICKOFF' WHEN st = 'Live' THEN 'EXPLICIT_NON_FINAL' WHEN done <= TIMESTAMP '1999-06-01 02:00:00' THEN 'FINAL_BEFORE_ASOF' WHEN done IS NOT NULL THEN 'IN_PROGRESS_AT_ASOF'
  WHEN play <= TIMESTAMP '1999-06-01 02:00:00' THEN 'FINAL_BEFORE_ASOF' ELSE 'UNKNOWN_FINALITY' END AS f FROM g)
SELECT o_orderkey, f = 'FINAL_BEFORE_ASOF' AS verified, f <> 'FINAL_BEFORE_ASOF' AND ko + INTERVAL 5 HOUR <= t AS assumed, CASE WHEN f = 'UNKNOWN_FINALITY' AND ko + INTERVAL 5 HOUR <= t THEN 'HISTORICAL_AVAILABILITY_ASSUMPTION' ELSE f END AS finality,
  CASE f WHEN 'FINAL_BEFORE_ASOF' THEN '' WHEN 'POST_ASOF_KICKOFF' THEN 'kickoff_after_asof' WHEN 'EXPLICIT_NON_FINAL' THEN 'status=LIVE' WHEN 'IN_PROGRESS_AT_ASOF' THEN 'completion_after_asof' ELSE 'no_finality_evidence' END AS reason FROM s""")
def finality_replay(spark, sf):
    k, at = F.col("o_orderkey"), F.col("o_orderdate")
    hours = lambda n: F.make_dt_interval(F.lit(0), F.lit(n))
    g = read(spark, sf, "orders").select(
        k, at.alias("ko"), F.when(k % 6 == 0, "final ").when(k % 6 == 1, "Live").when(k % 6 == 2, "CLOSED").otherwise("").alias("st"), F.when(k % 4 == 0, at + hours(3)).alias("done"), F.when(k % 10 == 7, at + hours(4)).alias("play")
    )
    as_of = F.lit("1999-06-01 02:00:00").cast(dict(g.dtypes)["ko"])
    return gates.finality(g, as_of, "ko", "st", "done", "play", replay=True).select("o_orderkey", "verified", "assumed", "finality", "reason")


_STREAM = "(SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, (event_id % 97) / 97.0::DOUBLE AS p, (event_id % 7 < 2)::INT AS y FROM events)"


@query(f"""
WITH RECURSIVE e AS {_STREAM}, f AS (SELECT event_type, 0::BIGINT AS i, NULL::BIGINT AS event_id, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM e WHERE i = 1
 UNION ALL SELECT event_type, i, event_id, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE u END, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE d END, u, d
 FROM (SELECT e.event_type, e.i, e.event_id, greatest(0, f.a + (e.p - e.y) - 0.02) AS u, greatest(0, f.b - (e.p - e.y) - 0.02) AS d FROM f JOIN e ON e.event_type = f.event_type AND e.i = f.i + 1)),
g AS (SELECT a.event_id, least(floor(e.p * 10), 9) AS b, abs(sum(e.p - e.y)) AS gap FROM e a JOIN e ON e.event_type = a.event_type AND e.i BETWEEN a.i - 63 AND a.i WHERE a.i >= 64 GROUP BY 1, 2), t AS (SELECT event_id, sum(gap) / 64 AS ece FROM g GROUP BY 1),
r AS (SELECT f.*, t.ece, i >= 32 AND (up > 3 OR down > 3 OR coalesce(t.ece, 0) > 0.3) AS alarm FROM f LEFT JOIN t USING (event_id) WHERE i > 0)
SELECT event_id, round(ece, 6) AS trailing_ece, round(up, 6) AS cusum_up, round(down, 6) AS cusum_down, alarm AS drift_alarm, bool_or(alarm) OVER (PARTITION BY event_type) AS triggered FROM r""")
def drift_rows(spark, sf):
    e = read(spark, sf, "events").select("event_id", "event_type", "ts", ((F.col("event_id") % 97) / 97.0).alias("p"), (F.col("event_id") % 7 < 2).cast("int").alias("y"))
    out = evaluation.drift(e, ["event_type"], ["ts", "event_id"], "p", "y", most_ece=0.3)
    return out.select("event_id", *[r6(F.col(c)).alias(c) for c in ("trailing_ece", "cusum_up", "cusum_down")], "drift_alarm", "triggered")


@query(f"""
WITH g AS (SELECT p_partkey, p_size - 25.0::DOUBLE AS m, unnest(generate_series(-20, 20))::INT AS margin FROM part)
SELECT p_partkey, margin, round(CASE WHEN margin = 20 THEN 1 ELSE {S.normal_cdf_sql('((margin + 0.5::DOUBLE - m) / 12.75::DOUBLE)')} END - CASE WHEN margin = -20 THEN 0 ELSE {S.normal_cdf_sql('((margin - 0.5::DOUBLE - m) / 12.75::DOUBLE)')} END, 6) AS p FROM g""")
def folded_pmf(spark, sf):
    g = pricing.folded_grid(read(spark, sf, "part").withColumn("m", F.col("p_size") - F.lit(25.0)), ["p_partkey"], "m", 12.75, -20, 20)
    return g.withColumn("p", r6(F.col("p")))


@query("""
WITH c AS (SELECT DISTINCT (p_size % 9) * 5.0::DOUBLE AS center FROM part)
SELECT p_partkey, p_size::DOUBLE AS spread, (SELECT min((abs(center - p_size), center))[2] FROM c) AS center FROM part""")
def nearest_bucket(spark, sf):
    p = read(spark, sf, "part").withColumn("spread", F.col("p_size").cast("double"))
    centers = p.select(((F.col("p_size") % 9) * 5.0).alias("center"))
    return pricing.nearest_center(p.select("p_partkey", "spread"), "spread", centers, "center")


_WEEKS = "(SELECT l_suppkey AS market, year(l_shipdate) * 12 + month(l_shipdate) AS week, l_linenumber::BIGINT AS n, l_quantity / 100 AS market_ll, l_tax * 2 AS model_ll, l_discount AS market_b, l_tax AS model_b, least(l_linenumber, (l_partkey % 4))::BIGINT AS correct FROM lineitem)"
_WILSON = "(accuracy + 1.920729410347062::DOUBLE / n - 1.959963984540054::DOUBLE * sqrt(accuracy * (1 - accuracy) / n + 0.960364705173531::DOUBLE / n / n)) / (1 + 3.841458820694124::DOUBLE / n)"


@query(f"""
WITH s AS (SELECT market, count(DISTINCT week) AS weeks, sum(n)::BIGINT AS n, sum((market_ll::DECIMAL(18, 9) - model_ll::DECIMAL(18, 9)) * n::INT)::DOUBLE / sum(n) AS gain, sum((market_b::DECIMAL(18, 9) - model_b::DECIMAL(18, 9)) * n::INT)::DOUBLE / sum(n) AS brier_gain, sum(correct) / sum(n)::DOUBLE AS accuracy FROM {_WEEKS} GROUP BY 1),
c AS (SELECT *, {_WILSON} AS low FROM s)
SELECT market, weeks, n, gain, brier_gain, round(accuracy, 6) AS accuracy, round(low, 6) AS low,
  CASE WHEN market % 10 = 0 THEN 'DEMOTE_TO_RETAIN_BASELINE' WHEN weeks >= 60 AND gain > 0 AND low > 0.35 THEN 'PROMOTE_TO_LIVE_STAKE' ELSE 'HOLD_PROVISIONAL_STAKE_ZERO' END AS decision,
  CASE WHEN market % 10 = 0 THEN 'DRIFT_ALARM' WHEN weeks >= 60 AND gain > 0 AND low > 0.35 THEN 'LIVE_GATE_PASSED' ELSE concat_ws(';', CASE WHEN weeks < 60 THEN 'weeks<60' END, CASE WHEN gain <= 0 THEN 'log_loss_gain<=0' END, CASE WHEN low <= 0.35 THEN 'pick_acc_ci_lower<=0.35' END) END AS reason FROM c""")
def live_scorecard(spark, sf):
    f = F.col
    l = read(spark, sf, "lineitem").select(  # noqa: E741
        f("l_suppkey").alias("market"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("week"), f("l_linenumber").cast("long").alias("n"), (f("l_quantity") / 100).alias("market_ll"), (f("l_tax") * 2).alias("model_ll"),
        f("l_discount").alias("market_b"), f("l_tax").alias("model_b"), F.least(f("l_linenumber").cast("long"), f("l_partkey") % 4).alias("correct"),
    )
    s = evaluation.weighted_scorecard(l, ["market"], "n", "week", {"gain": ("market_ll", "model_ll"), "brier_gain": ("market_b", "model_b")}, "correct")
    s = s.withColumn("low", evaluation.share_interval("accuracy", "n")[0]).withColumn("drift", f("market") % 10 == 0)
    out = gates.promotion(s, "weeks", "gain", "low", "drift", 60, 0.35).drop("drift")
    return out.withColumns({c: r6(f(c)) for c in ("accuracy", "low")})


@query("""
WITH d AS (SELECT l_suppkey, count(*) AS n, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE round(avg(l_tax), 6) END AS ece, round(sum(l_quantity) / 1000, 6) AS slope, round(avg(l_discount) - 0.05, 6) AS intercept, round(avg(l_tax) - 0.035, 6) AS gap FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN l_suppkey % 13 = 0 THEN 'WITHHOLD_SHADOW_OUTPUT' WHEN n < 100 OR ece IS NULL THEN 'INCONCLUSIVE_SMALL_SAMPLE' WHEN ece > 0.05 OR slope NOT BETWEEN 0.8 AND 20 OR intercept NOT BETWEEN -0.1 AND 0.1 OR gap > 0.02 OR l_suppkey % 8 = 0 THEN 'CALIBRATION_CONCERN' ELSE 'SUPPORTED_FOR_SHADOW_MONITORING' END AS status FROM d""")
def reliability_status(spark, sf):
    f = F.col
    d = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), r6(F.avg("l_tax")).alias("e"), r6(F.sum("l_quantity") / 1000).alias("slope"), r6(F.avg("l_discount") - 0.05).alias("intercept"), r6(F.avg("l_tax") - 0.035).alias("gap"))
    d = d.withColumns({"ece": F.when(f("l_suppkey") % 9 != 0, f("e")), "valid": f("l_suppkey") % 13 != 0, "stable": f("l_suppkey") % 8 != 0, "low": F.lit(None).cast("double")})
    return gates.reliability(d, "valid", "n", "ece", "slope", "intercept", "low", "gap", "stable", slopes=(0.8, 20)).select("l_suppkey", "status")


@query("""
SELECT count(*) AS n, round(avg(abs(l_quantity - l_linenumber * 7)), 6) AS mae, round(sqrt(avg((l_quantity - l_linenumber * 7) ** 2)), 6) AS rmse FROM lineitem""")
def regression_scores(spark, sf):
    df = read(spark, sf, "lineitem").select("l_quantity", (F.col("l_linenumber") * 7).alias("guess"))
    return evaluation.regression(df, "guess", "l_quantity").withColumns({c: r6(F.col(c)) for c in ("mae", "rmse")})


@query("""
WITH r AS (SELECT k, p, (y = k)::INT AS hit, least(floor(p * 10), 9) AS b FROM (SELECT o_orderstatus AS y, unnest(['F', 'O', 'P']) AS k, unnest([(o_custkey % 50) / 100.0::DOUBLE, 0.3::DOUBLE, 0.7 - (o_custkey % 50) / 100.0::DOUBLE]) AS p FROM orders)),
e AS (SELECT k, sum(n * gap) / sum(n) AS ece FROM (SELECT k, b, count(*) AS n, abs(avg(p) - avg(hit)) AS gap FROM r GROUP BY 1, 2) GROUP BY 1) SELECT count(*) AS classes, round(avg(ece), 6) AS ece FROM e""")
def three_way_ece(spark, sf):
    a = (F.col("o_custkey") % 50) / 100.0
    df = read(spark, sf, "orders").select(F.col("o_orderstatus").alias("y"), a.alias("f"), F.lit(0.3).alias("o"), (0.7 - a).alias("p"))
    return evaluation.classwise_ece(df, {"F": "f", "O": "o", "P": "p"}, "y").withColumn("ece", r6(F.col("ece")))


@query("""
SELECT count(*) AS n, round(avg(a.loss - b.loss), 6) AS gain, round(stddev_samp(a.loss - b.loss) / sqrt(count(*)), 6) AS se FROM (SELECT o_orderkey AS id, o_totalprice AS loss FROM orders WHERE o_orderkey % 3 > 0) a JOIN (SELECT o_orderkey AS id, round(o_totalprice) - 1 AS loss FROM orders WHERE o_orderkey % 5 > 0) b USING (id)""")
def paired_losses(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("loss"))
    out = evaluation.paired_gains(o.where("id % 3 > 0"), o.where("id % 5 > 0").withColumn("loss", F.round("loss") - 1), ["id"], "loss")
    return out.withColumns({c: r6(F.col(c)) for c in ("gain", "se")})


@query("SELECT l_quantity AS value, n FROM (SELECT l_quantity, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_quantity DESC LIMIT 1")
def modal_choice(spark, sf):
    return gates.modal(read(spark, sf, "lineitem").select(F.col("l_quantity").alias("value")), "value")


@query("""
WITH now AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'), j AS (SELECT b.*, n.l_partkey IS NOT NULL AS stays FROM lineitem b LEFT JOIN now n USING (l_suppkey, l_partkey) WHERE b.l_returnflag <> 'N')
SELECT l_suppkey, round(coalesce(sum(l_quantity) FILTER (WHERE stays), 0) / sum(l_quantity), 6) AS returning_l_quantity, round(coalesce(sum(l_linenumber) FILTER (WHERE stays), 0) / sum(l_linenumber), 6) AS returning_l_linenumber,
  round(coalesce(sum(l_quantity + l_linenumber) FILTER (WHERE stays AND l_linestatus = 'F'), 0) / sum(l_quantity + l_linenumber) FILTER (WHERE l_linestatus = 'F'), 6) AS returning_f,
  round(coalesce(sum(l_quantity + l_linenumber) FILTER (WHERE stays AND l_linestatus = 'O'), 0) / sum(l_quantity + l_linenumber) FILTER (WHERE l_linestatus = 'O'), 6) AS returning_o FROM j GROUP BY 1""")
def roster_continuity(spark, sf):
    l = read(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double"))  # noqa: E741
    out = gates.continuity(l.where("l_returnflag <> 'N'"), l.where("l_returnflag = 'N'"), "l_suppkey", "l_partkey", "l_linestatus", ["l_quantity", "l_linenumber"], ["F", "O"])
    return out.withColumns({c: r6(F.col(c)) for c in out.columns[1:]})


@query("""
WITH e AS (SELECT l_returnflag AS unit, l_suppkey AS coach, sum(l_tax * l_quantity) AS s, sum(l_quantity) AS n FROM lineitem WHERE l_suppkey % 3 > 0 GROUP BY 1, 2), g AS (SELECT unit, sum(s) / sum(n) AS mu, greatest(coalesce(var_samp(s / n), 0.0001), 0.0001) AS b FROM e GROUP BY 1),
t AS (SELECT DISTINCT l_returnflag AS unit, l_suppkey AS coach FROM lineitem)
SELECT t.unit, t.coach, round(coalesce(n / (n + 40) * (s / n) + (1 - n / (n + 40)) * mu, mu), 6) AS prior_mean, round(coalesce(n, 0), 6) AS n FROM t LEFT JOIN e USING (unit, coach) LEFT JOIN g ON g.unit = t.unit""")
def coach_prior(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("unit"), F.col("l_suppkey").alias("coach"), "l_tax", "l_quantity")  # noqa: E741
    e = priors.empirical_bayes(l.where("coach % 3 > 0"), "coach", ["unit"], "l_tax", "l_quantity", 40.0, 0.0001)
    means = e.groupBy("unit").agg(F.first("group_mean").alias("mu"))
    t = l.select("unit", "coach").distinct().join(e.select("unit", "coach", "prior_mean", "n"), ["unit", "coach"], "left").join(means, "unit", "left")
    return t.select("unit", "coach", r6(F.coalesce("prior_mean", "mu")).alias("prior_mean"), r6(F.coalesce("n", F.lit(0.0))).alias("n"))


@query("""
WITH p AS (SELECT l_suppkey AS k, round(avg(l_tax), 6) AS m, round(stddev_samp(l_tax), 6) AS s, count(*)::DOUBLE AS w FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY 1), g AS (SELECT sum(m * w) / sum(w) AS mu, quantile_cont(s, 0.5) AS sd FROM p)
SELECT s_suppkey AS k, round(coalesce(m, mu), 6) AS m, round(CASE WHEN p.k IS NULL THEN 2 * sd ELSE s END, 6) AS s, CASE WHEN p.k IS NULL THEN 'fallback' ELSE 'prior' END AS origin FROM supplier LEFT JOIN p ON p.k = s_suppkey CROSS JOIN g""")
def fallback_prior(spark, sf):
    p = read(spark, sf, "lineitem").where("l_suppkey % 4 > 0").groupBy(F.col("l_suppkey").alias("k")).agg(r6(F.avg("l_tax")).alias("m"), r6(F.stddev_samp("l_tax")).alias("s"), F.count("*").cast("double").alias("w"))
    out = gates.with_fallback(read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), p, "k", "m", "s", "w")
    return out.withColumns({c: r6(F.col(c)) for c in ("m", "s")})


@query("""
SELECT user_id, day, count(hday) AS days, sum(n)::BIGINT AS rows FROM (SELECT DISTINCT user_id, date_trunc('day', ts)::DATE AS day FROM events) s
LEFT JOIN (SELECT user_id AS hu, date_trunc('day', ts)::DATE AS hday, count(*) AS n FROM events GROUP BY 1, 2) h ON hu = user_id AND hday < day GROUP BY 1, 2""")
def earlier_days_by_user(spark, sf):
    d = read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = prefix.sums_before(d.select("user_id", "day"), d, ["user_id"], "day", "day", {"days": F.count("*"), "rows": F.sum("n")})
    return out.withColumn("rows", F.when(F.col("days") > 0, F.col("rows")))


@query("""
WITH f AS (SELECT o_custkey, min(year(o_orderdate)) AS first_season FROM orders GROUP BY 1)
SELECT o_orderkey, first_season::INT AS first_season, o_orderdate + INTERVAL 5 HOUR AS available_at, coalesce(o_totalprice, 0) AS price FROM orders JOIN f USING (o_custkey)""")
def feature_matrix(spark, sf):
    o = gates.first_seen(read(spark, sf, "orders").withColumn("season", F.year("o_orderdate")), ["o_custkey"], "season", "first_season")
    o = gates.available_after(o, "o_orderdate", 5).withColumn("price", gates.first_column(o, ["total_price", "o_totalprice"]))
    return gates.feature_matrix(o, ["o_orderkey"], "price", gates.allowed_columns(["first_season", "available_at"], ["o_totalprice"], [r"_post$"]))


@query("""
SELECT o_orderkey, l_linenumber, round(CASE WHEN l_returnflag = 'A' THEN l_discount * 100 WHEN l_returnflag = 'N' THEN 0 ELSE -100 END, 6) AS profit FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def settled_bets(spark, sf):
    bets = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag", "l_discount")
    done = bets.join(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    profit = F.when(F.col("l_returnflag") == "A", F.col("l_discount") * 100).when(F.col("l_returnflag") == "N", 0.0).otherwise(-100.0)
    return done.select("o_orderkey", "l_linenumber", r6(profit).alias("profit"))


@query()
def elo_before_games(spark, sf):
    from pyspark.sql import Window

    e = read(spark, sf, "events").select("event_type", "event_id", F.col("user_id").alias("a"), F.lead("user_id").over(Window.partitionBy("event_type").orderBy("ts", "event_id")).alias("b"))
    out = scans.elo_rows(e.where("b IS NOT NULL AND a <> b"), "event_type", ["event_id"], "a", "b")
    return out.select("event_id", *[F.round(c, 4).alias(c) for c in ("winner_before", "loser_before")])

"""Queries of betting cards, scores against the market and availability reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import evaluation, fits, pricing
from tidemark.plans.registry import query, r6, read
from tidemark.sources import injuries


def _three_sql(edge: str, sd: str, line: str, at: str) -> tuple[str, str, str]:
    """SQL of the line's win, push and other; null without `at`."""
    above, below, plain = (S.normal_cdf_sql(z) for z in (f"((0.5::DOUBLE - {edge}) / {sd})", f"((-0.5::DOUBLE - {edge}) / {sd})", f"({edge} / {sd})"))
    whole = f"abs({line} - round({line})) <= 1e-8::DOUBLE"
    cases = (f"1 - {above}", plain), (f"{above} - {below}", "0::DOUBLE"), (below, f"1 - {plain}")
    return tuple(f"(CASE WHEN {at} IS NOT NULL THEN CASE WHEN {whole} THEN {a} ELSE {b} END END)" for a, b in cases)  # type: ignore[return-value]


_MONEY = _three_sql("(-spread)", "13.0::DOUBLE", "0::DOUBLE", "spread")
_ATS = _three_sql("0::DOUBLE", "13.0::DOUBLE", "spread", "spread")
_TOTAL = _three_sql("0::DOUBLE", "10.0::DOUBLE", "total", "total")


@query(f"""
WITH g AS (SELECT o_orderkey AS game_id, o_orderstatus || ' @ ' || o_orderpriority AS matchup, CASE WHEN o_orderkey % 31 > 0 THEN (o_custkey % 29 - 14) / 2.0::DOUBLE END AS spread, CASE WHEN o_orderkey % 37 > 0 THEN (76 + o_orderkey % 25) / 2.0::DOUBLE END AS total,
  CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 97) / 97.0::DOUBLE END AS model_m, CASE WHEN o_orderkey % 4 = 0 THEN 0.25::DOUBLE + (o_custkey % 50) / 100.0::DOUBLE END AS market_t, CASE WHEN o_orderkey % 5 = 0 THEN 1.5::DOUBLE + (o_custkey % 20) / 10.0::DOUBLE END AS odds_a FROM orders),
c AS (SELECT game_id, matchup, spread, 'moneyline' AS market, 'PROVISIONAL_ONLY' AS readiness, spread AS line, {_MONEY[0]} AS win, CASE WHEN spread IS NOT NULL THEN 0::DOUBLE END AS push, {_MONEY[2]} AS other, NULL::DOUBLE AS fair0, model_m AS model0, NULL::DOUBLE AS odds0 FROM g
  UNION ALL SELECT game_id, matchup, spread, 'ats', 'RETAIN_BASELINE', spread, {_ATS[0]}, {_ATS[1]}, {_ATS[2]}, NULL, NULL, odds_a FROM g
  UNION ALL SELECT game_id, matchup, spread, 'total', 'RETAIN_BASELINE', total, {_TOTAL[0]}, {_TOTAL[1]}, {_TOTAL[2]}, market_t, NULL, NULL FROM g),
d AS (SELECT *, coalesce(fair0, win) AS fair, coalesce(model0, fair0, win) AS model, coalesce(odds0, 1 + 100::DOUBLE / 110) AS odds FROM c)
SELECT game_id, matchup, market, readiness, line, round(win, 6) AS win, round(push, 6) AS push, round(other, 6) AS other, round(fair, 6) AS fair, round(model, 6) AS model, round(odds, 6) AS odds, round(model - fair, 6) AS edge,
  round(CASE WHEN model IS NULL OR push IS NULL THEN 0 ELSE greatest(0, (model * (odds - 1) - (1 - model - push)) / (odds - 1)) END, 6) AS stake FROM d""")
def betting_card(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    g = read(spark, sf, "orders").select(
        k.alias("game_id"), F.col("o_orderstatus").alias("away_team"), F.col("o_orderpriority").alias("home_team"), F.when(k % 31 > 0, (c % 29 - 14) / 2.0).alias("home_spread"), F.when(k % 37 > 0, (76 + k % 25) / 2.0).alias("total_line"),
        F.when(k % 3 == 0, (k % 97) / 97.0).alias("model_moneyline"), F.when(k % 4 == 0, 0.25 + (c % 50) / 100.0).alias("market_total"), F.when(k % 5 == 0, 1.5 + (c % 20) / 10.0).alias("odds_ats"),
    )
    out = pricing.card(g, ["game_id"], 13.0, 10.0, {"moneyline": "PROVISIONAL_ONLY"})
    return out.select("game_id", "matchup", "market", "readiness", "line", *[r6(F.col(x)).alias(x) for x in ("win", "push", "other", "fair", "model", "odds", "edge", "stake")])


_ROWS = """(SELECT d.source, l.toxic AS y1, CASE WHEN l.quality IS NOT NULL AND d.doc_id % 11 > 0 THEN (d.n_chars % 2)::INT END AS y2, (d.n_chars % 1000) / 1000.0::DOUBLE AS p, CASE WHEN d.doc_id % 9 > 0 THEN (d.doc_id % 100) / 100.0::DOUBLE END AS q FROM labels l JOIN documents d USING (doc_id))"""
_CLIP = lambda p: f"least(greatest({p}, 0.000001::DOUBLE), 0.999999::DOUBLE)"
_LOSS = lambda p: f"(-(y * ln({_CLIP(p)}) + (1 - y) * ln(1 - {_CLIP(p)})))"


@query(f"""
WITH r AS (SELECT 'first' AS market, source AS season, y1::DOUBLE AS y, p, q FROM {_ROWS} UNION ALL SELECT 'second', source, y2::DOUBLE, q, p FROM {_ROWS}),
g AS (SELECT market, season, count(*) AS n, avg((p - y) ** 2) AS mb, avg((q - y) ** 2) AS kb, avg({_LOSS('p')}) AS ml, avg({_LOSS('q')}) AS kl, avg(CASE WHEN abs(p - y) < abs(q - y) THEN 1 ELSE 0 END) AS better
  FROM r WHERE y IN (0, 1) AND p IS NOT NULL AND q IS NOT NULL AND season IS NOT NULL GROUP BY GROUPING SETS ((market), (market, season)))
SELECT market, season, n, round(mb, 6) AS model_brier, round(kb, 6) AS market_brier, round(ml, 6) AS model_log_loss, round(kl, 6) AS market_log_loss, round(better, 6) AS better, round(kb - mb, 6) AS brier_gain, round(kl - ml, 6) AS log_loss_gain FROM g""")
def market_relative(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "n_chars")
    r = read(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y1"), "quality").join(d, "doc_id").withColumns({
        "p": (F.col("n_chars") % 1000) / 1000.0, "q": F.when(F.col("doc_id") % 9 > 0, (F.col("doc_id") % 100) / 100.0), "y2": F.when(F.col("quality").isNotNull() & (F.col("doc_id") % 11 > 0), (F.col("n_chars") % 2).cast("int")),
    })
    out = evaluation.against_market(r, {"first": ("y1", "p", "q"), "second": ("y2", "q", "p")}, "source")
    return out.select("market", "season", "n", *[r6(F.col(c)).alias(c) for c in out.columns if c not in ("market", "season", "n")])


@query("""
WITH r AS (SELECT l_returnflag AS season, abs(l_discount * 100 - l_quantity) AS a, abs(-(l_tax * 100 - 30) - l_quantity) AS b FROM lineitem)
SELECT season, count(*) AS n, round(avg(a), 6) AS model_mae, round(avg(b), 6) AS market_mae, round(avg(CASE WHEN a < b THEN 1 ELSE 0 END), 6) AS better, round(avg(b) - avg(a), 6) AS gain FROM r GROUP BY GROUPING SETS ((), (season))""")
def margin_relative(spark, sf):
    l = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_quantity", (F.col("l_discount") * 100).alias("guess"), (F.col("l_tax") * 100 - 30).alias("spread"))  # noqa: E741
    out = evaluation.margins_against_market(l, "l_quantity", "guess", "spread", "flag")
    return out.select("season", "n", *[r6(F.col(c)).alias(c) for c in ("model_mae", "market_mae", "better", "gain")])


@query("""
SELECT 2025 AS season, '3' AS week, trim(regexp_replace(upper(c_mktsegment), '[^A-Z0-9]+', ' ', 'g')) AS team_id, c_custkey::VARCHAR AS player_id, c_name AS player_name, NULL::VARCHAR AS position, NULL::VARCHAR AS injury,
  CASE c_custkey % 4 WHEN 0 THEN 'DNP' WHEN 1 THEN 'LIMITED' WHEN 2 THEN 'NOT_LISTED' ELSE 'REST_DAY' END AS practice_status, CASE c_custkey % 3 WHEN 0 THEN 'OUT' WHEN 1 THEN 'NO_DESIGNATION' ELSE 'QUESTIONABLE' END AS game_status FROM customer""")
def injury_report(spark, sf):
    """Customers as lines of a report whose headers need cleaning."""
    k = F.col("c_custkey")
    practice = F.when(k % 4 == 0, " Did not participate in practice").when(k % 4 == 1, "Limited Participation").when(k % 4 == 3, "rest day")
    raw = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("Club"), k.alias("NFL Player-ID"), F.col("c_name").alias("Player"), practice.alias("Practice Status"), F.when(k % 3 == 0, "out").when(k % 3 == 1, "").otherwise("Questionable ").alias("Game/Status"))
    return injuries.report(raw, 2025, 3).select("season", "week", "team_id", "player_id", "player_name", "position", "injury", "practice_status", "game_status")


@query("""
SELECT 2024 AS season, (s_suppkey % 18)::VARCHAR AS week, trim(regexp_replace(upper(n_name), '[^A-Z0-9]+', ' ', 'g')) AS team_id, s_suppkey::VARCHAR AS player_id, s_name AS player_name, CASE WHEN s_suppkey % 2 = 0 THEN 'ankle' END AS injury,
  CASE WHEN s_suppkey % 2 = 0 THEN 'FULL' ELSE 'NOT_LISTED' END AS practice_status, CASE WHEN s_suppkey % 2 = 0 THEN 'OUT' ELSE 'ACTIVE' END AS game_status FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def injury_feed(spark, sf):
    """Suppliers as players in nested JSON, with teams at the top or under a wrapper."""
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    hurt = F.when(k % 2 == 0, F.struct(F.lit("ankle").alias("primary"), F.lit("Out").alias("status"), F.struct(F.lit("Full participation").alias("status")).alias("practice")))
    player = F.array(F.struct(k.cast("string").alias("id"), F.col("s_name").alias("name"), F.lit("Active").alias("status"), hurt.alias("injury")))
    team = F.array(F.struct(F.col("n_name").alias("alias"), F.when(k % 3 > 0, player).alias("players"), F.when(k % 3 == 0, player).alias("injuries")))
    season, sequence = F.struct(F.lit(2024).alias("year")).alias("season"), (k % 18).cast("string").alias("sequence")
    top = F.to_json(F.struct(season, F.struct(sequence).alias("week"), team.alias("teams")))
    wrapped = F.to_json(F.struct(season, F.struct(sequence, team.alias("teams")).alias("week")))
    out = injuries.flatten(s.select(F.when(k % 5 > 0, top).otherwise(wrapped).alias("payload")))
    return out.select("season", "week", "team_id", "player_id", "player_name", "injury", "practice_status", "game_status")


@query()
def snapshot_ratings(spark, sf):
    """Lines as games between 32 sides, rated before the first day of each month."""
    l = read(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))  # noqa: E741
    h = l.select("day", F.year("day").alias("season"), (F.col("l_suppkey") % 32).alias("a"), (F.col("l_partkey") % 32).alias("b"), "l_discount", "l_quantity")
    s = h.select(F.to_date(F.trunc("day", "month")).alias("day")).distinct().withColumn("season", F.year("day"))
    out = fits.snapshot_ratings(h, s, h.select("a").union(h.select("b")), "day", "season", "a", "b", "l_discount", "l_quantity", prior_mean=0.05, prior_sd=0.03, prior_exposure=200.0)
    return out.select("day", "season", "side", *[r6(F.col(c)).alias(c) for c in ("league_mean", "residual_sd", "own_effect", "other_effect", "own_reliability", "other_reliability")], "own_n", "other_n")

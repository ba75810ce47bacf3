"""Queries on what was known before a moment: cut-offs, snapshots, folds and live rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import cutoffs, entities, gates, ledger, live, pregame, roster, threeway
from tidemark.operators.stages import shared_folder
from tidemark.plans.registry import query, r6, read
from tidemark.sources import discovery
from tidemark.streaming import stateful

_CUTS = {"t10": 10.0, "open_50d": 50 * 1440.0, "open_30d": 30 * 1440.0, "open_12d": 12 * 1440.0}


@query(f"""
WITH q AS (SELECT l_orderkey AS game, l_suppkey % 5 AS book, l_shipdate + to_hours(l_linenumber) AS taken, l_quantity AS line, 0.45 + l_discount AS own, 0.5 + l_tax AS other FROM lineitem),
c AS (SELECT unnest({list(_CUTS)}) AS cutoff, unnest({list(_CUTS.values())}) AS minutes),
s AS (SELECT o_orderkey AS game, book, cutoff, o_orderdate + INTERVAL 75 DAY - to_minutes(minutes::INT) AS due FROM orders JOIN (SELECT DISTINCT game, book FROM q) ON game = o_orderkey CROSS JOIN c),
m AS (SELECT s.*, arg_max(struct_pack(taken := q.taken, line := q.line, own := q.own, other := q.other), (q.taken, q.line, q.own, q.other)) AS v FROM s LEFT JOIN q ON q.game = s.game AND q.book = s.book AND q.taken <= s.due GROUP BY ALL),
e AS (SELECT game, cutoff, v.line AS line, v.own / (v.own + v.other) AS p, v.own + v.other - 1 AS hold, (epoch_us(due) - epoch_us(v.taken)) / 60000000.0::DOUBLE AS lag, v.taken IS NOT NULL AS there FROM m),
g AS (SELECT game, cutoff, count(*) FILTER (there AND lag <= 30000) AS n, count(*) FILTER (there AND lag > 30000) AS stale, count(*) FILTER (NOT there) AS late, median(p) FILTER (lag <= 30000) AS p, stddev_pop(p) FILTER (lag <= 30000) AS psd,
  median(line) FILTER (lag <= 30000) AS line, stddev_pop(line) FILTER (lag <= 30000) AS lsd, median(hold) FILTER (lag <= 30000) AS hold, max(lag) FILTER (lag <= 30000) AS lag FROM e GROUP BY ALL),
t AS (SELECT *, n >= 2 AS ok FROM g),
o AS (SELECT game, arg_min(struct_pack(cutoff, line, p), list_position(['open_50d', 'open_30d', 'open_12d'], cutoff)) AS o FROM t WHERE ok AND cutoff <> 't10' GROUP BY 1)
SELECT o_orderkey, round(CASE WHEN ok THEN line END, 6) AS line, round(CASE WHEN ok THEN lsd END, 6) AS line_sd, round(CASE WHEN ok THEN t.p END, 6) AS probability, round(CASE WHEN ok THEN psd END, 6) AS probability_sd, round(CASE WHEN ok THEN hold END, 6) AS hold,
  round(CASE WHEN ok THEN lag END, 6) AS lag_minutes, n AS eligible_sources, o.o.cutoff AS opening, round(o.o.line, 6) AS opening_line, round(o.o.p, 6) AS opening_probability,
  round(CASE WHEN ok THEN line END - o.o.line, 6) AS line_movement, round(CASE WHEN ok THEN t.p END - o.o.p, 6) AS probability_movement,
  CASE WHEN t.game IS NULL THEN 'no_quotes' WHEN ok THEN 'accepted' ELSE 'refused:' || concat_ws(';', CASE WHEN stale > 0 THEN 'stale_sources' END, CASE WHEN late > 0 THEN 'late_sources' END, 'too_few_sources') END AS status,
  (o_totalprice * 100)::BIGINT AS cents
FROM orders LEFT JOIN (SELECT * FROM t WHERE cutoff = 't10') t ON t.game = o_orderkey LEFT JOIN o ON o.game = o_orderkey""")
def odds_at_cutoff(spark, sf):
    """Orders as games that start 75 days on, their lines as quotes of five books, attached to the orders one to one."""
    games = read(spark, sf, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL 75 DAY").alias("start"))
    quotes = read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 5).alias("book"), F.expr("l_shipdate + make_dt_interval(0, l_linenumber)").alias("taken"),
        F.col("l_quantity").alias("line"), (0.45 + F.col("l_discount")).alias("own"), (0.5 + F.col("l_tax")).alias("other"),
    )
    met = cutoffs.quotes_at(games, quotes, _CUTS, game="o_orderkey", start="start", source="book", taken="taken", columns=["line", "own", "other"], ties=["line", "own", "other"])
    rows = cutoffs.consensus_at(met, game="o_orderkey", line="line", own="own", other="other", most_lag=30_000, least_sources=2)
    moved = cutoffs.movements(rows, games, game="o_orderkey", closing="t10", openings=["open_50d", "open_30d", "open_12d"])
    base = read(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    out = cutoffs.attached(base, moved, "o_orderkey", "market features")
    return out.withColumns({c: r6(F.col(c)) for c, k in out.dtypes if k == "double"})


_PRIOR_SQL = """
WITH e AS (SELECT event_id, user_id::VARCHAR AS player, event_type AS team, ts::DATE AS day, week(ts)::INT AS season, value / 100 AS v, (1 + event_id % 30)::DOUBLE AS x FROM events),
s AS (SELECT DISTINCT day, season FROM e),
b AS (SELECT *, 'player' AS kind, player AS entity FROM e UNION ALL BY NAME SELECT *, 'team' AS kind, team AS entity FROM e),
k AS (SELECT s.day, s.season, kind, entity, v, x, s.season - b.season AS age, coalesce(sum(x) OVER (PARTITION BY s.day, kind, entity ORDER BY b.day DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later
  FROM s JOIN b ON b.day < s.day AND s.season - b.season BETWEEN 0 AND 1),
w AS (SELECT *, greatest(0, least(x, 150 - later)) * 0.6::DOUBLE ** age * 0.5::DOUBLE ** (later / 60) AS w, x * 0.6::DOUBLE ** age AS lw FROM k),
n AS (SELECT day, kind, entity, sum(w) AS n, sum(w * v) / sum(w) AS m FROM w WHERE w > 0 GROUP BY ALL),
g AS (SELECT day, kind, sum(w * v) / sum(w) AS mu, greatest(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2, 0.0004) AS var FROM w WHERE w > 0 GROUP BY ALL),
l AS (SELECT day, sum(lw) / (sum(lw) + 320) AS known, sum(lw * v) / sum(lw) AS m, greatest(sum(lw * v * v) / sum(lw) - (sum(lw * v) / sum(lw)) ** 2, 0.0004) AS var FROM w WHERE kind = 'player' GROUP BY 1),
lg AS (SELECT s.day, coalesce(0.3 + known * (m - 0.3), 0.3) AS mean, CASE WHEN m IS NULL THEN 0.3 ELSE greatest(sqrt(known * var + (1 - known) * 0.09), 0.02) END AS sd FROM s LEFT JOIN l USING (day)),
c AS (SELECT day, season, team, player, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY day, season, team) AS p FROM e GROUP BY day, season, team, player),
r AS (SELECT c.day, c.season, kind, entity, coalesce(n.n, 0) AS eff, coalesce(n.n / (n.n + 40), 0) AS share, CASE WHEN n.n > 0 THEN g.mu + n.n / (n.n + 40) * (n.m - g.mu) ELSE lg.mean END AS mean, CASE WHEN n.n > 0 THEN greatest(sqrt(g.var * (1 - n.n / (n.n + 40))), 0.02) ELSE lg.sd END AS sd, lg.mean AS league
  FROM (SELECT DISTINCT day, season, 'player' AS kind, player AS entity FROM c UNION SELECT DISTINCT day, season, 'team', team FROM c) c LEFT JOIN n USING (day, kind, entity) LEFT JOIN g USING (day, kind) JOIN lg USING (day))
SELECT c.day, c.team, count(*) AS candidates, arg_min(c.player, (-c.p, c.player)) AS expected, round(-sum(c.p * ln(c.p)), 6) AS entropy, round(sum(c.p * a.mean), 6) AS mean, round(greatest(sqrt(greatest(sum(c.p * (a.sd ** 2 + a.mean ** 2)) - sum(c.p * a.mean) ** 2, 0)), 0.02), 6) AS sd, round(sum(c.p * a.eff), 6) AS effective,
  round(sum(c.p * a.share), 6) AS weight, round(any_value(t.mean), 6) AS team_mean, round(any_value(greatest(t.sd, 0.02)), 6) AS team_sd, CASE WHEN abs(sum(c.p * a.mean) - any_value(t.mean)) < 5e-7 THEN 0 ELSE round(sum(c.p * a.mean) - any_value(t.mean), 6) END AS delta, round(any_value(t.league), 6) AS league_mean
FROM c JOIN r a ON a.day = c.day AND a.kind = 'player' AND a.entity = c.player JOIN r t ON t.day = c.day AND t.kind = 'team' AND t.entity = c.team GROUP BY c.day, c.team"""


@query(_PRIOR_SQL)
def starter_snapshots(spark, sf):
    """Users as players of the event types they act in, known before each day; weeks are the seasons."""
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.weekofyear("ts").alias("season"), (F.col("value") / 100).alias("v"), (1 + F.col("event_id") % 30).cast("double").alias("x"))
    c = e.groupBy("day", "season", "event_type", "user_id").agg(F.count("*").cast("double").alias("p"))
    metric = entities.Metric("v", "x", 0.3, 0.3, strength=40.0)
    out = entities.starter_features(e, c, [metric], entities.Fading(60.0, 150.0, 2, 0.6), game="day", team="event_type", player="user_id", probability="p", day="day", season="season", order=["day", "event_id"])
    cols = ("entropy", "mean", "sd", "effective", "weight", "team_mean", "team_sd", "delta", "league_mean")
    return out.select("day", "team", "candidates", "expected", *[r6(F.col(x)).alias(x) for x in cols])


def _games(spark, sf):
    """Orders as games of two leagues: 40 sides, seasons by year, one game in 29 not played."""
    k = F.col("o_orderkey")
    home = F.col("o_custkey") % 40
    o = read(spark, sf, "orders").select(
        k.alias("game"), (k % 2).alias("league"), F.year("o_orderdate").alias("season"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400_000_000).cast("int").alias("game_index"), home.alias("home"), ((home + 1 + k % 39) % 40).alias("away"),
        F.when(k % 29 > 0, F.floor(F.col("o_totalprice")) % 45).alias("home_score"), F.when(k % 29 > 0, F.floor(F.col("o_totalprice") / 50) % 41).alias("away_score"), (k % 17 == 0).alias("neutral"), (F.month("o_orderdate") == 12).alias("playoff"),
        F.when(k % 5 > 0, (k % 13 - 6) / 2).alias("home_spread"), F.when(k % 7 > 0, (k % 21 + 70) / 2).alias("total_line"),
    )
    return o


_GAMES = """g AS (SELECT o_orderkey AS game, o_orderkey % 2 AS league, year(o_orderdate)::INT AS season, (epoch_us(o_orderdate) // 86400000000)::INT AS game_index, o_custkey % 40 AS home, (o_custkey % 40 + 1 + o_orderkey % 39) % 40 AS away,
  CASE WHEN o_orderkey % 29 > 0 THEN floor(o_totalprice)::BIGINT % 45 END AS hs, CASE WHEN o_orderkey % 29 > 0 THEN floor(o_totalprice / 50)::BIGINT % 41 END AS aws FROM orders)"""


@query(f"""
WITH {_GAMES},
s AS (SELECT game, league, season, game_index, home AS side, 'home' AS venue, hs AS pf, aws AS pa FROM g UNION ALL SELECT game, league, season, game_index, away, 'away', aws, hs FROM g),
b AS (SELECT *, sum(CASE WHEN venue = 'home' THEN pf END) OVER w AS hpf, sum(CASE WHEN venue = 'home' THEN pa END) OVER w AS hpa, count(CASE WHEN venue = 'home' THEN pf END) OVER w AS hn,
  sum(CASE WHEN venue = 'away' THEN pf END) OVER w AS apf, sum(CASE WHEN venue = 'away' THEN pa END) OVER w AS apa, count(CASE WHEN venue = 'away' THEN pf END) OVER w AS an, count(pf) OVER w AS n
  FROM s WINDOW w AS (PARTITION BY league, side ORDER BY season, game_index, game, venue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT x.game, x.venue, sum(0.18 * y.pf * 0.82::DOUBLE ** (x.n - y.n - 1)) AS f, sum(0.18 * y.pa * 0.82::DOUBLE ** (x.n - y.n - 1)) AS a FROM b x JOIN b y ON x.league = y.league AND x.side = y.side AND y.pf IS NOT NULL AND (y.season, y.game_index, y.game, y.venue) < (x.season, x.game_index, x.game, x.venue) GROUP BY ALL),
t AS (SELECT b.*, coalesce(f, 0) + 22 * 0.82::DOUBLE ** n AS ff, coalesce(a, 0) + 22 * 0.82::DOUBLE ** n AS fa FROM b LEFT JOIN f USING (game, venue)),
l AS (SELECT *, coalesce(avg(hs) OVER w, 22) AS lh, coalesce(avg(aws) OVER w, 20.5) AS la, count(hs) OVER m AS meetings, avg(hs + aws) OVER m AS mt FROM g
  WINDOW w AS (PARTITION BY league ORDER BY season, game_index, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), m AS (PARTITION BY league, least(home, away), greatest(home, away) ORDER BY season, game_index, game ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT l.game, venue, lh, la, meetings, mt, n, ff, fa, ((coalesce(hpf, 0) + 8 * lh) / (hn + 8) / lh + (coalesce(apf, 0) + 8 * la) / (an + 8) / la) / 2 AS attack, ((coalesce(hpa, 0) + 8 * la) / (hn + 8) / la + (coalesce(apa, 0) + 8 * lh) / (an + 8) / lh) / 2 AS weak FROM l JOIN t USING (game))
SELECT h.game, round(h.lh, 6) AS league_home, round(h.la, 6) AS league_away, round(h.attack, 6) AS home_attack, round(h.weak, 6) AS home_weakness, round(a.attack, 6) AS away_attack, round(a.weak, 6) AS away_weakness, round(h.lh * h.attack * a.weak, 6) AS expected_home, round(h.la * a.attack * h.weak, 6) AS expected_away,
  round(h.lh * h.attack * a.weak + h.la * a.attack * h.weak, 6) AS expected_total, h.meetings, round(h.mt, 6) AS meetings_total, h.n AS home_games, round(h.ff, 6) AS home_fading_for, round(h.fa, 6) AS home_fading_against, CASE WHEN abs(h.ff - h.fa) < 5e-7 THEN 0 ELSE round(h.ff - h.fa, 6) END AS home_fading_margin,
  a.n AS away_games, round(a.ff, 6) AS away_fading_for, round(a.fa, 6) AS away_fading_against, CASE WHEN abs(a.ff - a.fa) < 5e-7 THEN 0 ELSE round(a.ff - a.fa, 6) END AS away_fading_margin
FROM r h JOIN r a ON h.game = a.game AND h.venue = 'home' AND a.venue = 'away'""")
def pregame_states(spark, sf):
    out = pregame.pregame_states(_games(spark, sf), ["league"])
    return out.withColumns({c: r6(F.col(c)) for c, k in out.dtypes if k == "double"})


@query()
def pregame_fold(spark, sf):
    """All states and ratings of every game; the ratings have no SQL that reads the whole table."""
    out = pregame.pregame(_games(spark, sf), ["league"])
    return out.withColumns({c: r6(F.col(c)) for c, k in out.dtypes if k == "double"})


_LIVE_SQL = """
WITH o AS (SELECT o_orderkey AS game_id, year(o_orderdate)::INT AS season, o_custkey % 30 AS home, (o_custkey % 30 + 1 + o_orderkey % 29) % 30 AS away, o_orderdate AS kickoff, o_orderkey % 50 = 0 AS open, o_orderkey % 31 = 0 AS bare, (o_orderkey % 21 - 10) / 2.0::DOUBLE AS home_spread, (o_orderkey % 30 + 70) / 2.0::DOUBLE AS total_line FROM orders),
h AS (SELECT * FROM o WHERE kickoff + INTERVAL 4 HOUR <= TIMESTAMP '2001-07-01' AND NOT open AND NOT bare), t AS (SELECT * FROM o WHERE kickoff > TIMESTAMP '2001-07-01'),
p AS (SELECT l_orderkey AS game_id, CASE WHEN (l_linenumber + l_partkey) % 2 = 0 THEN home ELSE away END AS own, CASE WHEN (l_linenumber + l_partkey) % 2 = 0 THEN away ELSE home END AS other, l_quantity >= 25 AS dropback, round(l_discount * 100) - 5 AS epa, (l_tax > 0.04)::INT AS success
  FROM lineitem JOIN h ON h.game_id = l_orderkey WHERE l_partkey % 13 <> 0 AND l_shipdate <= TIMESTAMP '2001-07-01'),
g AS (SELECT DISTINCT l_orderkey AS game_id, CASE WHEN (l_linenumber + l_partkey) % 2 = 0 THEN home ELSE away END AS team, CASE WHEN (l_linenumber + l_partkey) % 2 = 0 THEN away ELSE home END AS other FROM lineitem JOIN h ON h.game_id = l_orderkey WHERE l_shipdate <= TIMESTAMP '2001-07-01'),
m AS (SELECT game_id, own AS team, avg(epa) AS e, avg(success) AS s, avg(epa) FILTER (dropback) AS d, avg(epa) FILTER (NOT dropback) AS r FROM p GROUP BY ALL),
q AS (SELECT g.game_id, g.team, x.e, x.s, x.d, x.r, y.e AS a FROM g LEFT JOIN m x ON x.game_id = g.game_id AND x.team = g.team LEFT JOIN m y ON y.game_id = g.game_id AND y.team = g.other),
b AS (SELECT q.*, season, kickoff FROM q JOIN h USING (game_id) UNION ALL SELECT game_id, unnest([home, away]), NULL, NULL, NULL, NULL, NULL, season, kickoff FROM t),
f AS (SELECT game_id, team, avg(e) OVER l AS e4, avg(s) OVER l AS s4, avg(d) OVER l AS d4, avg(r) OVER l AS r4, avg(a) OVER l AS a4, avg(e) OVER y AS ey, avg(s) OVER y AS sy, avg(d) OVER y AS dy, avg(r) OVER y AS ry, avg(a) OVER y AS ay FROM b
  WINDOW l AS (PARTITION BY team ORDER BY kickoff, game_id ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), y AS (PARTITION BY team, season ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT game_id, team, (epoch_us(kickoff) - epoch_us(lag(kickoff) OVER (PARTITION BY team ORDER BY kickoff, game_id))) / 86400000000.0::DOUBLE AS rest FROM (SELECT game_id, unnest([home, away]) AS team, kickoff FROM h UNION ALL SELECT game_id, unnest([home, away]), kickoff FROM t))
SELECT t.game_id, home_spread, total_line, round(x.e4 - z.a4, 6) AS epa_matchup_home_last4_mean, round(z.e4 - x.a4, 6) AS epa_matchup_away_last4_mean, round(x.e4 - z.a4 - (z.e4 - x.a4), 6) AS epa_net_edge_last4_mean, round(x.s4 - z.s4, 6) AS success_rate_net_last4_mean, round(x.d4 - z.d4, 6) AS dropback_epa_net_last4_mean, round(x.r4 - z.r4, 6) AS rush_epa_net_last4_mean,
  round(x.ey - z.ay, 6) AS epa_matchup_home_season_mean, round(z.ey - x.ay, 6) AS epa_matchup_away_season_mean, round(x.ey - z.ay - (z.ey - x.ay), 6) AS epa_net_edge_season_mean, round(x.sy - z.sy, 6) AS success_rate_net_season_mean, round(x.dy - z.dy, 6) AS dropback_epa_net_season_mean, round(x.ry - z.ry, 6) AS rush_epa_net_season_mean,
  round(u.rest, 6) AS home_rest_days, round(v.rest, 6) AS away_rest_days, round(u.rest - v.rest, 6) AS rest_diff, (coalesce(u.rest < 6, false))::INT::DOUBLE AS home_short_week, (coalesce(v.rest < 6, false))::INT::DOUBLE AS away_short_week
FROM t JOIN f x ON x.game_id = t.game_id AND x.team = home JOIN f z ON z.game_id = t.game_id AND z.team = away JOIN s u ON u.game_id = t.game_id AND u.team = home JOIN s v ON v.game_id = t.game_id AND v.team = away"""
for _c in ("epa_matchup_home", "epa_matchup_away", "epa_net_edge", "success_rate_net", "dropback_epa_net", "rush_epa_net"):
    for _w in live.WINDOWS:  # SQL's rounding keeps the sign of a zero
        _LIVE_SQL = _LIVE_SQL.replace(f" AS {_c}_{_w}_mean", f" + 0.0::DOUBLE AS {_c}_{_w}_mean")


@query(_LIVE_SQL)
def live_slate(spark, sf):
    """Orders after the first of July 2001 as games to come, those before as history, lines as plays."""
    k = F.col("o_orderkey")
    home = F.col("o_custkey") % 30
    o = read(spark, sf, "orders").select(
        k.alias("game_id"), F.year("o_orderdate").alias("season"), home.alias("home_team_id"), ((home + 1 + k % 29) % 30).alias("away_team_id"), F.col("o_orderdate").alias("scheduled_kickoff_utc"), F.when(k % 50 == 0, "in_progress").otherwise("Final ").alias("game_status"),
        F.when(k % 31 > 0, F.expr("o_orderdate + INTERVAL 4 HOUR")).alias("completion_timestamp_utc"), ((k % 21 - 10) / 2).alias("home_spread"), ((k % 30 + 70) / 2).alias("total_line"),
    )
    even = (F.col("l_linenumber") + F.col("l_partkey")) % 2 == 0
    plays = read(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("game_id")).select(
        "game_id", F.when(even, F.col("home_team_id")).otherwise(F.col("away_team_id")).alias("posteam"), F.when(even, F.col("away_team_id")).otherwise(F.col("home_team_id")).alias("defteam"), (F.col("l_partkey") % 13 == 0).cast("int").alias("no_play"),
        (F.col("l_quantity") >= 25).cast("int").alias("qb_dropback"), (F.col("l_quantity") < 25).cast("int").alias("rush_attempt"), (F.round(F.col("l_discount") * 100) - 5).alias("epa"), (F.col("l_tax") > 0.04).cast("int").alias("success"), F.col("l_shipdate").alias("start_time"),
    )
    moment = "2001-07-01T00:00:00"
    out, _ = live.live_features(o, o.where(f"scheduled_kickoff_utc > timestamp_ntz '{moment}'"), plays, moment)
    return out.withColumns({c: r6(F.col(c)) for c in live.features() if not c.endswith(("spread", "line", "week"))})


def _three_way_sql(steps: int = 9) -> str:
    """The curves' Newton steps written out, one CTE each."""
    newton = "w0 AS (SELECT variant, season, n, up, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM n WHERE n >= 100 AND up > 0 AND up < n)"
    for i in range(1, steps + 1):
        newton += f""",
s{i} AS (SELECT w.variant, w.season, any_value(a) AS a, any_value(b) AS b, sum(y - q) AS ga, sum((y - q) * x) - 5 * any_value(b) AS gb, sum(q * (1 - q)) AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q) * x * x) + 5 AS hbb
  FROM (SELECT w.*, x, y, 1 / (1 + exp(-(a + b * x))) AS q FROM w{i - 1} w JOIN t ON t.variant = w.variant AND t.season < w.season) w GROUP BY 1, 2),
w{i} AS (SELECT variant, season, a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM s{i})"""
    return f"""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS variant, year(l_shipdate)::INT AS season, CASE l_returnflag WHEN 'A' THEN 'spread' ELSE 'total' END AS market, (l_quantity - 25) / 2 AS line, (0.5 + l_quantity) / 51 AS p, l_tax AS q, (l_partkey % 23 = 0)::INT AS push, (l_discount * 300 + l_quantity > 45)::INT AS y FROM lineitem),
b AS (SELECT *, CASE WHEN abs(line - round(line)) > 1e-9 THEN 'NO_PUSH' ELSE 'INT_' || round(CASE WHEN market = 'spread' THEN abs(line) ELSE line END)::BIGINT END AS bucket FROM r),
t AS (SELECT variant, season, ln(p) - ln(1 - p) AS x, y FROM r WHERE push = 0), d AS (SELECT DISTINCT variant, season FROM r),
n AS (SELECT d.variant, d.season, count(x) AS n, sum(y) AS up FROM d LEFT JOIN t ON t.variant = d.variant AND t.season < d.season GROUP BY 1, 2),
{newton},
g AS (SELECT d.variant, d.season, count(push) AS n, sum(push) AS k, avg(q) AS m FROM d LEFT JOIN b ON b.variant = d.variant AND b.season < d.season GROUP BY 1, 2),
e AS (SELECT d.variant, d.season, d.bucket, count(b.push) AS n, sum(b.push) AS k, avg(b.q) AS m FROM (SELECT DISTINCT variant, season, bucket FROM b) d LEFT JOIN b ON b.variant = d.variant AND b.bucket = d.bucket AND b.season < d.season GROUP BY 1, 2, 3),
c AS (SELECT b.*, g.n AS rows, CASE WHEN g.n = 0 THEN q ELSE least(q * CASE WHEN b.bucket = 'NO_PUSH' THEN 0 WHEN e.n > 0 THEN (e.k + 40 * (g.k + 0.5) / (g.n + 1)) / (e.n + 40) / greatest(e.m, 1e-6) ELSE (g.k + 0.5) / (g.n + 1) / greatest(g.m, 1e-6) END, 0.25) END AS pq,
  CASE WHEN g.n = 0 OR w.a IS NULL THEN p ELSE greatest(least(1 / (1 + exp(-(w.a + w.b * (ln(p) - ln(1 - p))))), 1 - 1e-6), 1e-6) END AS pu FROM b JOIN g USING (variant, season) JOIN e USING (variant, season, bucket) LEFT JOIN w{steps} w USING (variant, season))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN rows = 0 THEN 'identity_no_prior_oof' ELSE 'expanding_prior_seasons_only' END AS calibration_method, round((1 - pq) * (1 - pu), 6) AS calibrated_lower, round(pq, 6) AS calibrated_push, round((1 - pq) * pu, 6) AS calibrated_upper FROM c"""


@query(_three_way_sql())
def three_way_calibration(spark, sf):
    """Lines as forecasts of two variants, every year calibrated by the years before it."""
    k = F.col("l_partkey") % 23 == 0
    r = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("variant"), F.year("l_shipdate").alias("season"), F.when(F.col("l_returnflag") == "A", "spread").otherwise("total").alias("market"), ((F.col("l_quantity") - 25) / 2).alias("line"),
        ((0.5 + F.col("l_quantity")) / 51).alias("p"), F.col("l_tax").alias("q"), k.cast("int").alias("push"), (F.col("l_discount") * 300 + F.col("l_quantity") > 45).cast("int").alias("y"),
    )
    r = r.withColumn("scored", F.col("push") == 0)
    out = threeway.three_way(r, ["variant"], market="market", season="season", line="line", conditional="p", raw_push="q", scored="scored", target="y", push="push")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "calibration_method", *[r6(F.col(f"calibrated_{c}")).alias(f"calibrated_{c}") for c in ("lower", "push", "upper")])


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, (event_id % 97) / 97.0::DOUBLE - (event_id % 7 < 2)::INT AS r FROM events),
f AS (SELECT event_type, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM e WHERE i = 1
 UNION ALL SELECT event_type, i, event_id, ts, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE u END, CASE WHEN u > 3 OR d > 3 THEN 0 ELSE d END, u, d
 FROM (SELECT e.event_type, e.i, e.event_id, e.ts, greatest(0, f.a + e.r - 0.02) AS u, greatest(0, f.b - e.r - 0.02) AS d FROM f JOIN e ON e.event_type = f.event_type AND e.i = f.i + 1))
SELECT event_id, event_type, i AS seen, round(up, 6) AS up, round(down, 6) AS down, up > 3 OR down > 3 AS alarm FROM f WHERE i > 0 AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_drift(spark, sf):
    """The events file as a stream into the drift monitor: the rows that its watermark has passed."""
    schema = read(spark, sf, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").withColumn("r", (F.col("event_id") % 97) / 97.0 - (F.col("event_id") % 7 < 2).cast("int"))
    root = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    stateful.drain_into(stateful.drift_monitor(e, "event_type", "ts", "event_id", "r", "1 hour", 0.02, 3.0), f"{root}/rows", f"{root}/state")
    out = spark.read.schema("k string, id long, up double, down double, alarm boolean, seen long").parquet(f"{root}/rows")
    return out.select(F.col("id").alias("event_id"), F.col("k").alias("event_type"), "seen", r6(F.col("up")).alias("up"), r6(F.col("down")).alias("down"), "alarm")


@query()
def roster_ridge(spark, sf):
    """Suppliers' mean tax from what of their lines returns, by a ridge that chooses its penalty."""
    l = read(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("double"))  # noqa: E741
    shares = gates.continuity(l.where("l_returnflag <> 'N'"), l.where("l_returnflag = 'N'"), "l_suppkey", "l_partkey", "l_linestatus", ["l_quantity", "l_linenumber"], ["F", "O"])
    rows = shares.join(l.groupBy("l_suppkey").agg(F.avg("l_tax").alias("y")), "l_suppkey")
    model = roster.fit_ridge(rows, [c for c in shares.columns if c != "l_suppkey"], "y", ["l_suppkey"], least_sd=0.001)
    return roster.adjusted(rows, model).select("l_suppkey", r6(F.col("adjustment_mean")).alias("adjustment_mean"), r6(F.col("adjustment_sd")).alias("adjustment_sd"), F.lit(model.penalty).alias("penalty"))


@query("""
SELECT l_orderkey::VARCHAR AS game, l_suppkey::VARCHAR AS player, sum(l_quantity)::DOUBLE AS attempts, sum(l_linenumber)::DOUBLE AS yards, 0.0::DOUBLE AS sacks FROM lineitem GROUP BY ALL""")
def discovered_totals(spark, sf):
    """The table that has the columns, found by its footer among all there are, and its sums."""
    path = discovery.discover(spark, sf, [["game_id", "l_orderkey"], ["player_id", "l_suppkey"], ["attempts", "l_quantity"]], "lineitem")
    found = spark.read.parquet(path if path.endswith("lineitem.parquet") else path.rsplit("/", 1)[0])  # a table may be a folder of files
    return discovery.totals(found, {"game": ["game_id", "l_orderkey"], "player": ["player_id", "l_suppkey"]}, {"attempts": ["attempts", "l_quantity"], "yards": ["yards", "l_linenumber"], "sacks": ["sacks"]}, ["sacks"])


_LEDGER_SQL = """
WITH r AS (SELECT year(l_shipdate)::INT AS season, month(l_shipdate)::INT AS week, (0.5 + l_quantity) / 51 AS p1, CASE WHEN l_partkey % 11 > 0 THEN (0.5 + l_quantity + l_linenumber) / 60 END AS q1, (l_suppkey % 50 < l_quantity)::INT AS y1, l_partkey % 17 = 0 AS x1, 0.05 + l_discount * 9 AS p2, 0.06 + l_tax * 11 AS q2, (l_orderkey % 3 = 0)::INT AS y2 FROM lineitem),
o AS (SELECT *, unnest(list_filter([CASE WHEN season = 2001 AND week = 1 THEN 'locked' END, CASE WHEN season < 2001 AND week = 1 THEN 'first' END, CASE WHEN season < 2001 AND week <= 2 THEN 'early' END, CASE WHEN season < 2001 AND week >= 3 THEN 'late' END], lambda x: x IS NOT NULL)) AS population FROM r),
m AS (SELECT population, 'spread' AS market, season, p1 AS p, q1 AS q, CASE WHEN NOT x1 THEN y1 END AS y, x1 AS excluded FROM o UNION ALL SELECT population, 'total', season, p2, q2, y2, false FROM o),
l AS (SELECT *, y IS NOT NULL AND q IS NOT NULL AS g, -ln(CASE WHEN y = 1 THEN p ELSE 1 - p END) AS lp, -ln(CASE WHEN y = 1 THEN q ELSE 1 - q END) AS lq FROM m),
b AS (SELECT population, market, least(floor(p * 10), 9) AS b, count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM l WHERE g GROUP BY ALL), c AS (SELECT population, market, least(floor(q * 10), 9) AS b, count(*) AS n, abs(avg(q) - avg(y)) AS gap FROM l WHERE g GROUP BY ALL)
SELECT population, market, count(*) AS rows, count(*) FILTER (excluded) AS excluded, count(*) FILTER (q IS NULL) AS unmatched, count(*) FILTER (g) AS graded, round(avg(lp) FILTER (g), 6) AS model_log_loss, round(avg(lq) FILTER (g), 6) AS market_log_loss, round(avg((p - y) ** 2) FILTER (g), 6) AS model_brier, round(avg((q - y) ** 2) FILTER (g), 6) AS market_brier,
  round(avg(lq - lp) FILTER (g), 6) AS gain, round(stddev_samp(lq - lp) FILTER (g) / sqrt(count(*) FILTER (g)), 6) AS gain_se, round(avg((lq > lp)::INT) FILTER (g), 6) AS better, round(avg(y) FILTER (g), 6) AS base_rate,
  (SELECT round(sum(n * gap) / sum(n), 6) FROM b WHERE b.population = l.population AND b.market = l.market) AS model_ece, (SELECT round(sum(n * gap) / sum(n), 6) FROM c WHERE c.population = l.population AND c.market = l.market) AS market_ece
FROM l GROUP BY population, market"""


@query(_LEDGER_SQL)
def reliability_ledger(spark, sf):
    """Lines as out-of-fold forecasts of two markets in four overlapping populations."""
    f = F.col
    r = read(spark, sf, "lineitem").select(
        F.year("l_shipdate").alias("season"), F.month("l_shipdate").alias("week"), ((0.5 + f("l_quantity")) / 51).alias("p1"), F.when(f("l_partkey") % 11 > 0, (0.5 + f("l_quantity") + f("l_linenumber")) / 60).alias("q1"), (f("l_suppkey") % 50 < f("l_quantity")).cast("int").alias("y1"),
        (f("l_partkey") % 17 == 0).alias("x1"), (0.05 + f("l_discount") * 9).alias("p2"), (0.06 + f("l_tax") * 11).alias("q2"), (f("l_orderkey") % 3 == 0).cast("int").alias("y2"),
    )
    old = f("season") < 2001
    where = {"locked": (f("season") == 2001) & (f("week") == 1), "first": old & (f("week") == 1), "early": old & (f("week") <= 2), "late": old & (f("week") >= 3)}
    rows = ledger.ledger(r, where, {"spread": ("p1", "q1", f("y1"), f("x1")), "total": ("p2", "q2", f("y2"), F.lit(False))}, ["season", "week"])
    out = ledger.paired_scores(rows)
    return out.withColumns({c: r6(f(c)) for c, k in out.dtypes if k == "double"})

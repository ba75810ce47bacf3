"""Quotes at cut-offs against a plain loop, with one game that has most of the quotes."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cutoffs

T0 = datetime(2024, 3, 1)
CUTS = {"close": 10.0, "day": 1440.0, "hour": 60.0}


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    games = [(g, T0 + timedelta(days=g % 5, hours=r.randrange(24))) for g in range(12)] + [(99, None)]
    quotes = []
    for _ in range(1200):
        g = 0 if r.random() < 0.7 else r.randrange(1, 10)  # game 0 is hot, 10 and 11 have no quotes
        price = lambda: r.choice([None, 0.0, *[0.5, 0.55, 0.48] * 5])
        quotes.append((g, r.choice(["a", "b", "c", "d", None]), T0 + timedelta(minutes=r.randrange(-3000, 7 * 1440)), r.choice([None, *[1.5, 3.0, -2.5] * 4]), price(), price()))
    g = spark.createDataFrame(games, "game long, start timestamp")
    q = spark.createDataFrame(quotes, "game long, book string, taken timestamp, line double, own double, other double").repartition(6)
    return games, quotes, g, q


def last_quotes(games, quotes):
    out = {}
    for g, start in games:
        for b in {q[1] for q in quotes if q[0] == g and q[1] is not None}:
            for name, minutes in CUTS.items():
                cut = start and start - timedelta(minutes=minutes)
                may = [q for q in quotes if q[0] == g and q[1] == b and start and q[2] <= cut]
                out[g, b, name] = max(may, key=lambda q: (q[2], *[(x is not None, x or 0) for x in q[3:]])) if may else None
    return out


def test_last_quote_of_each_source(tables):
    games, quotes, g, q = tables
    met = cutoffs.quotes_at(g, q, CUTS, game="game", start="start", source="book", taken="taken", columns=["line", "own", "other"], ties=["line", "own", "other"])
    got = {(r.game, r.book, r.cutoff): r for r in met.collect()}
    want = last_quotes(games, quotes)
    assert got.keys() == want.keys() and met.count() == len(want)
    for k, quote in want.items():
        assert (quote and quote[2:]) == ((got[k].taken_at, got[k].line, got[k].own, got[k].other) if got[k].taken_at else None)
        assert got[k].lag_minutes is None or got[k].lag_minutes >= 0


def test_quotes_are_shuffled_once(spark, tables):
    """Quotes and games meet by game, and only sums of the consensus may move after that."""
    import io
    from contextlib import redirect_stdout

    _, _, g, q = tables
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = cutoffs.quotes_at(g, q, CUTS, game="game", start="start", source="book", taken="taken", columns=["line", "own", "other"], ties=["line", "own", "other"])
        text = io.StringIO()
        with redirect_stdout(text):
            cutoffs.consensus_at(met, game="game", line="line", own="own", other="other", most_lag=600.0, least_sources=2).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert text.getvalue().count("Exchange") <= 3


def test_refusals_and_movement(tables):
    games, quotes, g, q = tables
    met = cutoffs.quotes_at(g, q, CUTS, game="game", start="start", source="book", taken="taken", columns=["line", "own", "other"], ties=["line", "own", "other"])
    rows = cutoffs.consensus_at(met, game="game", line="line", own="own", other="other", most_lag=600.0, least_sources=2)
    starts = dict(games)
    good, reasons = {}, {}
    for (game, _, name), quote in last_quotes(games, quotes).items():
        key = (game, name)
        good.setdefault(key, [])
        reasons.setdefault(key, set())
        if quote is None:
            reasons[key].add("late_sources")
        elif (starts[game] - timedelta(minutes=CUTS[name]) - quote[2]).total_seconds() / 60 > 600:
            reasons[key].add("stale_sources")
        elif None in quote[3:] or not quote[4] or not quote[5]:
            reasons[key].add("incomplete_sources")
        else:
            good[key].append(quote)
    seen = 0
    for r in rows.collect():
        mine = good[r.game, r.cutoff]
        assert r.eligible_sources == len(mine)
        if len(mine) < 2:
            assert r.probability is None and r.line is None and set(r.reasons.split(";")) == reasons[r.game, r.cutoff] | {"too_few_sources"}
        else:
            seen += 1
            assert r.reasons == "" and r.line == statistics.median(x[3] for x in mine)
            assert r.probability == pytest.approx(statistics.median(x[4] / (x[4] + x[5]) for x in mine))
    assert seen
    moved = {r.game: r for r in cutoffs.movements(rows, g, game="game", closing="close", openings=["day", "hour"]).collect()}
    assert moved.keys() == starts.keys() and moved[10].status == "no_quotes" == moved[11].status
    for game, r in moved.items():
        first = next((n for n in ("day", "hour") if len(good.get((game, n), [])) >= 2), None)
        assert r.opening == first
        ok = len(good.get((game, "close"), [])) >= 2
        assert (r.status == "accepted") == ok and (r.line_movement is None) == (not (ok and first))


def test_later_quotes_change_nothing(tables):
    _, _, g, q = tables
    args = dict(game="game", start="start", source="book", taken="taken", columns=["line"], ties=["line"])
    before = cutoffs.quotes_at(g, q, {"day": 1440.0}, **args)
    starts = q.join(g, "game", "left")
    late = starts.withColumn("line", F.when(F.col("taken") > F.col("start") - F.expr("INTERVAL 1 DAY"), 1000.0).otherwise(F.col("line"))).select(*q.columns)
    assert sorted(map(str, before.collect())) == sorted(map(str, cutoffs.quotes_at(g, late, {"day": 1440.0}, **args).collect()))


def test_attachment_is_one_to_one(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k long, name string, season int")
    b = spark.createDataFrame([(1, 0.5, 9), (2, None, 9)], "k long, p double, season int")
    assert {tuple(r) for r in cutoffs.attached(a, b, "k").collect()} == {(1, "x", 5, 0.5), (2, "y", 6, None)}
    for one, other, word in ((a, b.where("k = 1"), "missing"), (a.where("k = 1"), b, "extra"), (a.union(a), b, "duplicate")):
        with pytest.raises(Exception, match=f"features: {word} key"):
            cutoffs.attached(one, other, "k").collect()

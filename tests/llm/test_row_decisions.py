"""Rows with null or repeated ids get decisions of their own."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from tidemark.llm import decontaminate, ngram_join, suffix_dedup, warc
from tidemark.llm.queries import ORACLE_SQL


def words(seed, n):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def frame(spark):
    return lambda rows: spark.createDataFrame([(*r, "en", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, n_chars int")


def test_one_of_each_row(frame):
    a, b, c, d = (words(s, 60) for s in range(4))
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (None, a), (None, c), (None, c + " end"), (5, d), (None, None), (None, ""), (6, "..."), (6, "...")]
    got = rows_of(ngram_join.one_of_each(frame(rows)))
    assert got == Counter([(1, a), (1, b), (5, d), (None, None), (None, ""), (6, "..."), (6, "...")]) + Counter([r for r in got if r[0] is None and r[1] in (c, c + " end")])
    assert sum(n for (i, t), n in got.items() if i is None and t) == 1


def test_contaminated_rows_go(spark, frame):
    item = words(9, 30)
    leak, clean = words(1, 40) + " " + item, words(2, 40)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert rows_of(decontaminate.without_contaminated(frame([(None, leak), (None, clean), (3, leak), (3, clean), (4, None)]), bench)) == Counter([(None, clean), (3, clean), (4, None)])


def test_repeats_are_cut_in_all_rows(spark, frame):
    shared = words(7, 100)
    lone = [words(s, 20) for s in range(4)]
    rows = [(None, f"{lone[0]} A{shared}B {lone[1]}"), (3, f"{lone[2]} C{shared}D"), (3, lone[3]), (3, lone[3]), (4, None)]
    got = suffix_dedup.without_repeats(frame(rows), 400, "byte", "n_chars")
    assert got.columns == ["doc_id", "text", "lang", "n_chars"]
    assert rows_of(got) == Counter([(None, f"{lone[0]} AB {lone[1]}"), (3, f"{lone[2]} CD"), (3, lone[3]), (3, lone[3]), (4, None)])
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_a_page_id_with_two_payloads(spark):
    one, two = "<p>one</p>" * 20, "<p>two</p>" * 30
    pages = [(1, "http://a", one), (1, "http://a", two), (2, "http://b", two), (2, "http://b", "short"), (3, None, one), (3, None, one)]
    got = warc.capture_digests(spark.createDataFrame(pages, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    rel = con.sql(ORACLE_SQL["op6_warc"])
    assert Counter(tuple(r[c] for c in rel.columns) for r in got.collect()) == Counter(rel.fetchall())
    assert {r.payload_digest for r in got.where("page_id = 1").collect()} == {hashlib.sha256(x.encode()).hexdigest() for x in (one, two)}

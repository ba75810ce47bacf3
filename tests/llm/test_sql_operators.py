"""Operators that SQL can express: awkward tables here, whole tables against DuckDB."""

import hashlib
import io
import json
from collections import Counter

import duckdb
import pytest

from tidemark.llm import licenses, tool_calls, warc
from tidemark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    cols = rel.columns
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(rel.fetchall())


def test_archives_round_trip(spark):
    long = "<p>" + "long é " * 40
    pages = [(5, "http://a", long), (3, "http://b", long), (9, None, long), (4, "u v\r\nX: y", "short"), (6, "", "short"), (7, "http://n", None), (8, "http://e", ""), (None, "http://x", long), (None, "http://y", long), (None, None, None), (10, "WARC/1.1", "WARC/1.1\r\n\r\n" * 20 + "page-id: 77")]
    df = spark.createDataFrame([(*p, "a", 1) for p in pages], "page_id long, url string, html string, digest string, first int")
    rows = warc.capture_digests(df).collect()
    got = {r.page_id: r for r in rows if r.page_id is not None}
    assert Counter(r.page_id for r in rows) == Counter(p[0] for p in pages)
    unnamed = Counter((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows if r.page_id is None)
    assert unnamed == Counter((len(b), hashlib.sha256(b).hexdigest(), "response", None) for b in (long.encode(), long.encode(), b""))
    for i, _, html in pages:
        if i is not None:
            b = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    captured = warc.captures(df).collect()
    assert Counter(r.url for r in captured if r.page_id is None) == Counter(["http://x", "http://y", None])
    nested = {r.page_id: r for r in captured if r.page_id is not None}
    assert nested[9].url is None and nested[5].url == "http://a"
    assert all(r.request.id and r.metadata.page == i for i, r in nested.items())
    assert warc.capture_digests(df.limit(0)).count() == 0


def test_plain_archives_and_cut_members():
    import gzip


    records = warc.capture_records(1, "http://a", b"x" * 300_000, "00", 1)
    packed = b"".join(map(gzip.compress, records))
    assert [f["warc-type"] for f, _ in warc.split_records(io.BytesIO(packed))] == ["request", "response", "metadata"]
    assert [b for _, b in warc.split_records(io.BytesIO(packed))] == [b for _, b in warc.split_records(io.BytesIO(b"".join(records)))]
    with pytest.raises(ValueError):
        list(warc.split_records(io.BytesIO(packed[:-5])))


CALLS = "conv_id long, call_id string, position long, name string, arguments string, after array<string>, content string"
SCHEMAS = [("find", "q", "string", True), ("find", "n", "integer", False), ("add", "x", "number", True), ("add", "y", "number", True), ("add", "on", "boolean", False)]


def linked(spark, calls, results):
    c = spark.createDataFrame([(*r, "clash") for r in calls], CALLS)
    r = spark.createDataFrame(results, "conv_id long, call_id string, position long, content string")
    s = spark.createDataFrame(SCHEMAS, "name string, argument string, kind string, required boolean")
    return {(x.conv_id, x.call_id): x for x in tool_calls.link(c, r, s).collect()}


def test_tool_calls(spark):
    calls = [
        (1, "a", 1, "find", '{ "q": "x", "n": 3 }', []), (1, "b", 2, "add", '{"y": 2.50, "x": 1}', ["d", "a"]), (1, "c", 3, "find", '{"n": 1}', ["b"]), (1, "d", 4, "add", "not json", ["gone"]),
        (2, "a", 1, "find", '{"q": 5}', None), (2, "b", 2, "none", None, ["b"]), (2, "x", 5, "find", '{"q": "1", "z": 0}', ["y", None]), (2, "y", 4, "find", '{"q": "é\\u0041"}', ["x"]),
        (3, "a", 1, "find", '{"q": "late"}', []), (3, "a", 0, "find", '{"q": "early"}', []), (None, "a", 1, "find", "{}", []), (3, None, 1, "find", "{}", []), (4, "n", None, None, "{}", []),
    ]
    results = [(1, "a", 5, 'say "hi"\n'), (1, "a", 4, "first"), (1, "zz", 1, "no call"), (2, "x", 6, None), (None, "a", 1, "x")]
    got = linked(spark, calls, results)
    assert len(got) == 10
    step = {k: r.step for k, r in got.items()}
    assert step[1, "a"] < step[1, "b"] and step[1, "d"] < step[1, "b"] < step[1, "c"]
    assert sorted(s for (c, _), s in step.items() if c == 1) == [1, 2, 3, 4]
    assert {k for k, r in got.items() if r.valid} == {(1, "a"), (1, "b"), (2, "y"), (3, "a")}
    assert {k for k, r in got.items() if r.cyclic} == {(2, "b"), (2, "x"), (2, "y")}
    assert {k for k, r in got.items() if r.missing} == {(1, "d")}
    assert {k for k, r in got.items() if r.linked} == {(1, "a"), (2, "x")}
    assert got[1, "a"].message == '{"arguments":{"n":3,"q":"x"},"id":"a","name":"find","result":"first"}'
    assert json.loads(got[2, "y"].message)["arguments"] == {"q": "éA"}
    assert json.loads(got[1, "d"].message)["arguments"] is None
    assert json.loads(got[3, "a"].message)["arguments"] == {"q": "early"}
    assert linked(spark, [], []) == {}


def test_calls_in_reverse_order(spark):
    n = 12
    calls = [(1, f"c{i:02}", n - i, "find", '{"q": "x"}', [f"c{i - 1:02}"] if i else []) for i in range(n)]
    got = linked(spark, calls, [])
    assert [got[1, f"c{i:02}"].step for i in range(n)] == list(range(1, n + 1))
    assert not any(r.cyclic for r in got.values())


def test_licence_rules(spark):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.'
    notice = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [
        (1, f"Code.\n{mit} Something else! {notice}", "MIT"), (2, f"{notice} {mit}", ""), (3, mit, ""), (4, "x\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", "CC-BY-NC-4.0,MIT"),
        (5, None, ""), (6, "", ""), (7, "we are not released under the mit license", ""), (8, "Licensed under the Apache License, Version 2.0. " * 500, "Apache-2.0"), (None, "LICENSED UNDER CC BY 4.0", "CC-BY-4.0"),
        (9, f"{mit}\nReleased under the MIT License.\n{notice}", "MIT"), (9, "none", ""),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in texts], "doc_id long, text string, ids string")
    got = licenses.scan(df)
    assert Counter((r.doc_id, r.licences) for r in got.collect()) == Counter((i, want) for i, _, want in texts)
    assert {r.n_known for r in got.where("doc_id = 8").collect()} == {500}
    assert licenses.scan(df.limit(0)).count() == 0

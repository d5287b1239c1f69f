"""Exact top-k, shard table and WARC assembly against brute force."""

import base64
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from check import canonical
from ridgeline.llm import topk
from ridgeline.llm.folders import opened, shared_folder
from ridgeline.llm.queries import ORACLES, QUERIES
from ridgeline.llm.sharding import filled, placed, preference, write_shards
from ridgeline.llm.topk import nearest, top_k
from ridgeline.llm.warc import assembled, captures, page_digests, read_records, write_archives
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def brute(rows, queries, k):
    out = []
    for q, x in queries:
        scored = sorted((-int(np.dot(x, y)), i) for i, y in rows if i != q and len(y) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 8192])
def test_top_k_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-9, 10, 5).tolist()) for k in range(300)] + [(400 + k, [3, 3, 3, 3, 3]) for k in range(40)]
    rows += [(500, [0] * 5), (501, [1, 2]), (502, [2, 1]), (503, [])]
    df = spark.createDataFrame([*rows, (None, [1] * 5), (600, None)], "vec_id long, vector array<long>")
    queries = [r for r in rows if r[0] % 50 == 0 or r[0] in (501, 503)]
    asked = df.where(F.col("vec_id").isin([q for q, _ in queries]))
    for k in (1, 10):
        assert sorted(map(tuple, top_k(df, asked, k, 5).collect())) == brute(rows, queries, k)
    assert top_k(df, df.where("false")).count() == 0 and top_k(df.where("false"), asked).count() == 0


def test_vectors_with_holes_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25], 1), (1, [0.1, None], 1), (2, [nan, 0.0], 1), (3, [inf, 0.0], 1), (4, None, 1), (5, [1.0, 1.0], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    assert [tuple(r) for r in nearest(df).collect()] == [(0, 1, 5, 512 * 1024 - 256 * 1024)]


def test_shards_take_turns():
    shards, slots = ["b", "a", "c"], 101
    owner, order = filled(shards, slots), sorted(range(3), key=lambda k: shards[k])
    table, step = [None] * slots, Counter()
    while None in table:
        for k in order:
            offset, skip = preference(shards[k], slots)
            while None in table:
                slot = (offset + step[k] * skip) % slots
                step[k] += 1
                if table[slot] is None:
                    table[slot] = k
                    break
    assert owner == table and max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    names = [f"n{k}" for k in range(20)]
    before, after = filled(names, 10007), filled(names[:-1], 10007)
    assert sum(b != a for b, a in zip(before, after) if b != 19) < 0.1 * 10007
    for bad in ((shards, 100), ([], 101), (["a", "a"], 101)):
        with pytest.raises(ValueError):
            filled(*bad)


def test_placement(spark, documents, tmp_path):
    docs = documents([(k, "t") for k in range(500)] + [(None, "t"), (3, "again")])
    got = placed(docs, "doc_id", ["x", "y", "z"], 101).collect()
    owner = filled(["x", "y", "z"], 101)
    assert len(got) == 502
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard) == (slot, ["x", "y", "z"][owner[slot]])
    assert placed(documents([]), "doc_id").count() == 0
    with pytest.raises(ValueError):
        placed(docs, "doc_id", slot="score")
    write_shards(docs.select("doc_id", "text"), "doc_id", str(tmp_path / "out"), ["x", "y"], 101, 2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 502
    plan = placed(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan


PAGES = [(1, "http://a.b/x?y=1", "<p>é</p>"), (2, "http://a.b/", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "https://c", None), (4, "https://d", ""),
         (5, "bad url", "line\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nabc"), (6, "http://[broken", "x" * 300_000), (None, "http://n", "<p>é</p>"),
         (None, "http://m", "only"), (7, "u", "twice"), (7, "u", "twice")]


def test_pages_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    most = defaultdict(lambda: None)
    for i, _, h in PAGES:
        most[h or ""] = max((x for x in (most[h or ""], i) if x is not None), default=None)
    want = Counter()
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = most[h or ""] is not None and most[h or ""] != i
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
              most[h or ""] if revisit else None)] += 1
    assert Counter(map(tuple, page_digests(pages).collect())) == want
    whole = captures(pages).collect()
    assert len(whole) == len(PAGES)
    for c in whole:
        assert c.request.concurrent_to == c.metadata.concurrent_to == c.response.record_id == c.capture_id
    blocks = {c.metadata.fields["page_id"]: bytes(c.response.block) for c in whole if c.response.type == "response"}
    assert blocks["5"] == PAGES[5][2].encode() and blocks["6"] == PAGES[6][2].encode()
    large = page_digests(pages.where("page_id in (1, 2, 4)")).count()
    assert large == 3 and page_digests(pages.where("false")).count() == 0


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    types = {c.metadata.fields["page_id"]: c.response.type for c in captures(pages, least_bytes=3).collect()}
    assert types == {"1": "response", "2": "response", "3": "revisit", "4": "response"}


def test_records_without_a_partner_stay(spark):
    pages = spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string")
    records = read_records(write_archives(pages, shared_folder(spark, "test")))
    assert records.count() == 3
    lone = assembled(records.where("type <> 'response'")).collect()
    assert len(lone) == 1 and lone[0].response is None and lone[0].request is not None and lone[0].metadata is not None
    assert opened("/tmp/x")[1] == "/tmp/x"

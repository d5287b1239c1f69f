"""Base spans against the contract's own patterns; disclosing terms on a planted corpus."""

import hashlib
import math
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm.oracles import PII
from ridgeline.llm.pii import KINDS, base_spans, disclosures, found, joined, sanitised, span_digests
from pyspark.sql import functions as F

PATTERN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
           "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, hit):
    digits = [int(c) for c in hit if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    doubled = [x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(digits))]
    return kind == "email" or 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def brute(text):
    out = [(m.start(), k, m.end()) for k in KINDS for m in re.finditer(PATTERN[k], text or "") if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{e}" for a, k, e in sorted(out, key=lambda x: (x[0], KINDS.index(x[1]))))


ODD = ["", None, "a@b", "a@b.c%d@e.f", "x a@b@c.d y", "1.2.3.4.5.6.7.8", "999.2.3.4.5.6", "256.1.1.1 0255.000.1.1", "1.2.3.4@x.y",
       "4111 1111 1111 1111", "4111-1111-1111-1111 ", "4111 1111  1111 1111", "41111111111111111111111", "1 4111111111111111",
       "+1 (386) 555-3733.", "+1((((((", "++12 345 678 90", "+1 234 567 89012 345 6789", "é é@ü.de a.b@c-d.e-f.g", "x@y.z.", "..@-.-",
       "4111111111111111 4111111111111111", "7" * 5000, "a" * 5000 + "@b.c", "1." * 3000, "+1" + "(" * 5000 + "2"]


def test_base_spans_are_those_of_the_plain_patterns(documents):
    docs = documents(list(enumerate(ODD)))
    got = {r.doc_id: r for r in span_digests(docs).collect()}
    for k, text in enumerate(ODD):
        want = brute(text)
        assert got[k].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert got[k].spans == want
        assert [got[k][f"n_{x}"] for x in KINDS] == [want.count(x + ":") for x in KINDS]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("a1 4.@+-()%é9\n", max_size=40), min_size=50, max_size=50))
def test_base_spans_on_random_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows.select("text", base_spans("text").alias("base")).select(
            "text", F.expr(joined("base")).alias("got")).collect():
        assert r.got == brute(r.text)


@pytest.fixture(scope="module")
def corpus(documents, words):
    """Three letters about one address with different texts, `orchid` only there; the rest of the corpus is unrelated."""
    rows = [(k, f"{' '.join(words(20, k))} filler\norchid common met lily{'x' * k} ada@example.org today\nend") for k in range(3)]
    rows += [(10 + k, " ".join(words(30, 50 + k)) + " common today met end") for k in range(40)]
    rows += [(60 + k, "same text copied zebra bob@example.org") for k in range(5)] + [(99, None), (100, ""), (None, "x ada@example.org")]
    return documents(rows)


def test_terms_that_disclose_an_entity(corpus):
    marked = found(corpus).where("size(base) > 0")
    got = {(r.entity, r.term): r.disclosure for r in disclosures(marked, corpus.select("text"), 0.0, 3).collect()}
    n, with_e = corpus.count(), 4  # `ada` stands in four documents
    want = math.log2(3 * n / (3 * with_e)) / math.log2(n / with_e)
    assert got[("email:ada@example.org", "orchid")] == pytest.approx(want)
    assert got.get(("email:ada@example.org", "common"), 0) < 0.5
    assert not any(term == "zebra" for _, term in got)  # copies are one context


def test_spans_are_added_and_base_spans_stay(corpus):
    rows = {r.doc_id: r for r in span_digests(corpus).collect()}
    assert len(rows) == corpus.count()
    kinds = [x.split(":")[0] for x in rows[0].spans.split(",")]
    assert kinds.count("email") == 1 and {"term", "stem"} & set(kinds)
    assert rows[99].spans == rows[100].spans == "" and rows[60].spans.count(":") == 2
    assert rows[None].n_email == 1


def test_sanitised_texts(corpus):
    out = sanitised(corpus)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "ada@example.org" not in texts[0] and "<email>" in texts[0] and "orchid" not in texts[0] and "common" in texts[0]
    assert texts[99] is None and texts[100] == ""
    assert texts[10] == corpus.where("doc_id = 10").first().text


def test_spans_match_sql(corpus):
    con = duckdb.connect()
    con.register("documents", corpus.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    got = corpus.transform(span_digests).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(PII).fetchall()))


def test_empty_table(documents):
    assert span_digests(documents([])).count() == 0 and sanitised(documents([])).count() == 0

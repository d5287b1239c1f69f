"""Ranked lexical search against its definition."""

import math
import random
import re
from collections import Counter

import pytest

from ridgeline.llm import lexical
from ridgeline.llm.queries import QUERIES

COLUMNS = ["item_id", "rank", "doc_id", "score"]
ITEMS = "item_id long, text string, score string, place string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=50):
    """Multiset of (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    holders = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) for t in set(terms(text)) if holders[t]}
        scored = []
        for i, c in counts:
            score = 0
            for t in weights.keys() & c.keys():
                m = 100 - 50 + 50 * c.total() * n_docs // length
                score += weights[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out.update((item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1))
    return out


def found(frame):
    assert frame.columns == COLUMNS
    return Counter(map(tuple, frame.collect()))


@pytest.fixture(scope="module")
def corpus(words):
    r = random.Random(4)
    vocabulary = words(4000)
    docs = [(3 * k, " ".join(r.choices(vocabulary[: r.choice((30, 400, 4000))], k=r.randint(1, 60)))) for k in range(2600)]
    items = [(k, " ".join(r.sample(vocabulary, 12) + r.sample(vocabulary[:30], 3))) for k in range(12)]
    docs += [(9000 + k, f"some ÄÖ words {items[3][1].upper()}, again {items[3][1]}") for k in range(70)]  # ties beyond the last rank
    docs += [(10_000, "rareword " * 400), (10_001, "rareword"), (10_002, "common " * 50_000 + "rareword"), (None, items[0][1]), (5, items[0][1]), (5, items[0][1]),
             (6, None), (7, ""), (8, " .,;")]
    return docs, items + [(20, "rareword RAREWORD"), (20, "common"), (None, "äö ÄÖ"), (21, None), (22, "nowhere"), (23, "")]


def test_ranks(spark, documents, corpus):
    docs, items = corpus
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    assert found(lexical.ranked(documents(docs), asked)) == expected(docs, items)


def test_colliding_coordinates_and_small_blocks(spark, documents, corpus, monkeypatch):
    """Loose bounds, one item a block, small steps and a shuffled rescoring give the same ranks."""
    for name, value in (("BLOCK_TERMS", 1), ("STEPS", (5, 20, None)), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = [d for k, d in enumerate(corpus[0]) if k % 5 == 0 or k > 2600], corpus[1][2:5] + corpus[1][12:14]
    asked = spark.createDataFrame([(i, t, "x", "y") for i, t in items], ITEMS)
    assert found(lexical.ranked(documents(docs), asked, 7, coordinates=64)) == expected(docs, items, 7)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert found(QUERIES["op12_lexical_search"](spark, sf)) == expected(docs, items)


def test_nothing(spark, documents):
    items = spark.createDataFrame([(1, "a b", "x", "y")], ITEMS)
    assert lexical.ranked(documents([]), items).count() == 0
    assert lexical.ranked(documents([(1, "a b")]), items.limit(0)).count() == 0

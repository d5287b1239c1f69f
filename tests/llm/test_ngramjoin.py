"""N-gram Jaccard join against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ridgeline.llm import ngramjoin
from ridgeline.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k: k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def expected(rows):
    """Components of all pairs with a similarity of 85 % or more; ids tie their texts."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for k, (i, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    near = {(p, k) for k, (_, s) in enumerate(sets) for x in s for p in holders[x] if p < k}
    for p, k in near:
        (i, s), (j, t) = sets[p], sets[k]
        if i is not None and j is not None and 100 * len(s & t) >= 85 * len(s | t):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


def found(frame):
    assert frame.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(map(tuple, frame.collect()))


def edited(random_, words, edits, vocabulary):
    out = list(words)
    for _ in range(edits):
        k = random_.randrange(len(out))
        out[k: k + random_.choice((0, 1))] = [random_.choice(vocabulary)]
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus(words):
    """Families of edited copies around the limit, a hot line, short texts over few words, odd rows."""
    r = random.Random(7)
    vocabulary, hot, few = words(3000), words(40, 2), words(4, 3)
    texts = []
    for size in (7, 12, 30, 60, 150, 400):
        for _ in range(4):
            base = r.sample(vocabulary, size)
            texts += [edited(r, base, k, vocabulary) for k in (0, 0, 1, 1, 2, 2, 3, max(1, size // 50), max(1, size // 30))]
    star = r.sample(vocabulary, 50)
    texts += [edited(r, star, 2, vocabulary) for _ in range(40)]
    texts += [" ".join(hot + r.sample(vocabulary, 60)) for _ in range(60)] + [" ".join(hot + r.sample(vocabulary, k)) for k in range(12)]
    texts += [" ".join(r.choice(few) for _ in range(r.randint(1, 9))) for _ in range(150)]
    texts += ["", None, " \t\n", "One two THREE", "one two three", "ÄB äb É é", "äB äb É é", "a\x0bb\x0cc d", "a b c d", "x" * 5000, "line of words\n" * 3000]
    r.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[0]), (rows[5][0], rows[40][1]), rows[7], rows[7], (2, None)]


def test_all_links(documents, corpus):
    assert found(ngramjoin.similar_documents(documents(corpus))) == expected(corpus)


def test_small_blocks(documents, corpus, monkeypatch):
    """Buckets of more than two members are compared in blocks of four."""
    monkeypatch.setattr(ngramjoin, "BLOCK", 4)
    rows = corpus[: len(corpus) // 2]
    assert found(ngramjoin.similar_documents(documents(rows), small=2)) == expected(rows)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = expected(rows)
    assert found(QUERIES["op11_ngram_join"](spark, sf)) == want and any(i != c for i, _, c in want)


def test_batches_of_many_rows():
    """Shingles of every row of a long batch, whole and sliced."""
    texts = pa.array([None if k % 97 == 0 else f"Word{k} TWO Ä{k % 7} four\x0bfive {k}" for k in range(3000)])
    for column in (texts, texts.slice(1500), texts.slice(700, 1800)):
        sizes = [n for _, ends, hashes in ngramjoin._shingles(column, 4) for n in np.diff(ngramjoin._sets(ends, hashes)[0])]
        assert sizes == [len(shingles(t)) for t in column.to_pylist()]
        distinct = {h for _, _, hashes in ngramjoin._shingles(column, 4) for h in hashes.tolist()}
        assert len(distinct) == len({x for t in column.to_pylist() for x in shingles(t)})


def test_no_documents(documents):
    assert ngramjoin.similar_documents(documents([])).count() == 0

"""Near-duplicates against brute force over all pairs."""

import random

import numpy as np
import pytest

from ridgeline.llm import neardup
from ridgeline.llm.components import components
from ridgeline.llm.neardup import near_duplicates, probminhash
from ridgeline.llm.words import jaccard, shingle_hashes, shingle_runs, texts_of_words

import pyarrow as pa


def shingle_sets(texts):
    return [np.unique(shingle_hashes(w)) for *_, w in texts_of_words(pa.array(texts, pa.string()))]


def brute(rows):
    """Class of each id: union of equal word sequences and of pairs with similarity 0.8."""
    ids = sorted({i for i, t in rows if i is not None})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = list(zip([i for i, _ in rows], shingle_sets([t for _, t in rows])))
    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and len(x) and jaccard(x, y) >= 0.8:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: top(i) for i in ids}


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(5)
    out = []
    for g in range(6):  # groups of edited copies at many distances
        base = words(rng.choice([30, 80, 200]), g)
        for k in range(14):
            text = list(base)
            for _ in range(rng.randint(0, len(base) // 15)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(10 ** 6)}"
            out.append((g * 100 + k, " ".join(text)))
    out += [(1000 + k, " ".join(words(40, 90))) for k in range(30)]  # exact copies
    out += [(1100 + k, "Hello, World!" if k % 2 else "hello world") for k in range(4)]
    out += [(1200, None), (1201, ""), (1202, " ,. "), (1203, None), (None, "hello world"), (None, None)]
    out += [(3, out[3][1])] + [(1300, " ".join(words(30000, 70))), (1301, " ".join(words(29990, 70)))]
    return out


def test_classes_are_those_of_brute_force(documents, rows):
    want = brute(rows)
    got = near_duplicates(documents(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.class_id == (None if r.doc_id is None else want[r.doc_id])


def test_members_that_fail_their_first_member_still_meet(documents, rows, monkeypatch):
    """With one register in a band, unrelated documents share buckets; the block comparison must find the rest."""
    want = brute(rows)
    got = near_duplicates(documents(rows), bands=60, rows=2)
    assert all(r.class_id == want[r.doc_id] for r in got.where("doc_id is not null").collect())
    monkeypatch.setattr(neardup, "BLOCK", 4)
    assert all(r.class_id == want[r.doc_id] for r in near_duplicates(documents(rows), bands=60, rows=2).where("doc_id is not null").collect())


def test_an_id_with_two_texts_joins_their_classes(documents, words):
    one, two = " ".join(words(40, 1)), " ".join(words(40, 2))
    got = {r.doc_id: r.class_id for r in near_duplicates(documents([(1, one), (2, two), (3, one), (3, two)])).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_empty_table(documents):
    assert near_duplicates(documents([])).count() == 0


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2 ** 50, 360).astype(np.uint64)
    wx, wy = np.append(rng.integers(1, 5, 300), np.zeros(60)), np.append(np.zeros(60), rng.integers(1, 5, 300))
    both = np.flatnonzero((wx > 0) & (wy > 0))
    exact = sum(1 / np.maximum(wx / wx[k], wy / wy[k]).sum() for k in both)
    owner = np.repeat([0, 1], 300)
    kept = probminhash(owner, np.concatenate([x[wx > 0], x[wy > 0]]), np.concatenate([wx[wx > 0], wy[wy > 0]]), 2, 20000)
    assert (kept[0] == kept[1]).mean() == pytest.approx(exact, abs=0.015)


def test_runs_give_the_shingles_of_each_text():
    texts = pa.array(["a b", "", "a b c d e", "a b c d e f", "x", None, "Q w E r t y u", "é ü-ö"] * 3)
    want = [shingle_hashes(w).tolist() for *_, w in texts_of_words(texts)]
    got = []
    for _, _, _, ends, shingles in shingle_runs(texts):
        got += [shingles[ends[k]: ends[k + 1]].tolist() for k in range(len(ends) - 1)]
    assert got == want


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90}


def test_lines_that_recur_in_one_of_two_texts(documents, words):
    """Similarity is that of the shingle sets, so how often a line stands in a text must not decide about the candidates."""
    rows = []
    for k in range(12):
        base = words(104, 20 + k)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base + words(10, 60 + k) * 200))]
    want = brute(rows)
    assert all(want[10 * k + 1] == 10 * k for k in range(12))
    assert {r.doc_id: r.class_id for r in near_duplicates(documents(rows)).collect()} == want

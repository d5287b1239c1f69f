"""Rank-order profiles: distances against their definition, accuracy on held-out rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

from ridgeline.llm.language import PROFILE, UNKNOWN, Ranker, identified, ngrams, profiles, ranked, with_language


def plain_ranks(text):
    """Top n-grams of a text by a plain reading of the rule."""
    letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    padded = " " + " ".join(letters.split()) + " "
    if not padded.strip():
        return []
    grams = [padded[k: k + n] for n in (1, 2, 3) for k in range(len(padded) - n + 1) if n > 1 or padded[k] != " "]
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return sorted((code(g) for g in Counter(grams)), key=lambda c: (-Counter(map(code, grams))[c], c))[:PROFILE]


@pytest.mark.parametrize("text", ["Hello, hello WORLD", "é ß Über", "a", "  x  y", "日本 語", "12 %", ""])
def test_ranks(text):
    assert ranked(text).tolist() == plain_ranks(text)


def test_distance_is_out_of_place():
    found = {"aa": ranked("the cat sat on the mat"), "bb": ranked("der hund lag auf dem bett")}
    text = "the hat"
    own, far = plain_ranks(text), {}
    for lang, profile in found.items():
        place = {g: k for k, g in enumerate(profile.tolist())}
        far[lang] = sum(abs(place[g] - k) if g in place else PROFILE for k, g in enumerate(own))
    lang, score = Ranker(found).predict(text)
    assert lang == "aa" == min(far, key=far.get) and score == pytest.approx(1 - far["aa"] / (PROFILE * len(own)))
    assert Ranker({}).predict(text) == (UNKNOWN, 0.0) and Ranker(found).predict("12 !") == (UNKNOWN, 0.0)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98


def test_profiles_ignore_rows_without_text_or_language(spark):
    rows = spark.createDataFrame([("abc abc", "x"), (None, "x"), ("zzz", None)], "text string, lang string")
    found = profiles(rows)
    assert list(found) == ["x"] and found["x"].tolist() == ranked("abc abc").tolist()


def test_odd_rows(documents):
    docs = documents([(1, "hello there world"), (2, None), (3, ""), (4, "12 34"), (None, "hello"), (1, "hello there world"), (5, "словарь"),
                      (6, "hello " * 50_000), (7, "hello world there")])
    rows = identified(docs).collect()
    assert len(rows) == 9 and {r.lang_pred for r in rows} == {"en", UNKNOWN}
    assert [r.lang_pred for r in sorted(rows, key=lambda r: r.doc_id or 0) if r.doc_id in (2, 3, 4)] == [UNKNOWN] * 3
    kept = with_language(docs, 0.01)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 6, 7]
    assert identified(documents([])).count() == 0
    assert len(ngrams("ab c")) == 3

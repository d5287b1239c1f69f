"""Smith-Waterman against the plain recurrence; planted copies, edited and not."""

import random

import numpy as np
import pytest

from ridgeline.llm.decontaminate import contaminated, smith_waterman


def plain(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(passage, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_scores():
    rng = random.Random(3)
    items = [np.array([rng.randrange(2, 9) for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    passages = [np.array([rng.randrange(2, 9) for _ in range(rng.randint(1, 30))]) for _ in range(60)]
    score, end = smith_waterman(items, passages)
    assert score.tolist() == [plain(i, p) for i, p in zip(items, passages)]
    for k in range(60):
        assert plain(items[k], passages[k][: end[k]]) == score[k]


@pytest.fixture(scope="module")
def items(spark, words):
    return spark.createDataFrame([(k, " ".join(words(25, k)), "x") for k in range(6)] + [(90, "two words", "x"), (91, None, "x"), (None, "a b c d", "x"), (92, "", "x")],
                                 "item_id long, text string, score string")


def test_planted_copies(documents, items, words):
    edited = words(25, 1)
    edited[4], edited[11] = "changed", "changed too"
    del edited[18]
    rows = [(1, " ".join(words(300, 50) + words(25, 0) + words(40, 51))), (2, " ".join(words(80, 52) + edited + words(9, 53))),
            (3, " ".join(words(200, 54) + words(6, 2))), (4, " ".join(words(500, 55))), (5, None), (6, ""), (7, "two words"),
            (None, " ".join(words(25, 3)))] + [(100 + k, " ".join(words(20, 60 + k) + words(25, 4))) for k in range(50)]
    rows += [(8, " ".join(words(25, 5)).upper())] * 2
    got = {(r.doc_id, r.item_id): r for r in contaminated(documents(rows), items).collect()}
    assert set(got) == {(1, 0), (2, 1), (8, 5)} | {(100 + k, 4) for k in range(50)}
    assert (got[1, 0].score, got[1, 0].first_word, got[1, 0].last_word) == (1.0, 300, 324)
    assert 0.7 < got[2, 1].score < 1 and got[2, 1].first_word == 80
    blocks = contaminated(documents(rows), items, block_items=2)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(got)


def test_a_common_seed_alone_is_no_leak(documents, items, words):
    stock = " ".join(words(3, 0))
    rows = [(k, " ".join(words(15, 100 + k)) + " " + stock) for k in range(30)]
    assert contaminated(documents(rows), items, score=0.05).count() == 0  # the seed stands in all documents
    assert contaminated(documents(rows[:1]), items, score=0.05).count() == 1


def test_empty_tables(documents, items, spark):
    assert contaminated(documents([]), items).count() == 0
    assert contaminated(documents([(1, "a b c d")]), items.where("false")).count() == 0


def test_many_documents_with_few_seeds_of_an_item(documents, spark, words):
    """Copies of one document, heavily edited copies and copies of short items don't make their own seeds common."""
    long, short, stock = words(16, 0), words(3, 1), words(6, 2)
    items = spark.createDataFrame([(0, " ".join(long)), (1, " ".join(short)), (2, " ".join(stock))], "item_id long, text string")
    edited = [w if k in (0, 1, 3, 4, 5, 7, 8, 10, 11, 13, 14) else f"edit{k}" for k, w in enumerate(long)]
    rows = [(k, " ".join(words(30, 100 + k) + edited + words(30, 200 + k))) for k in range(20)]
    rows += [(100 + k, " ".join(words(30, 300 + k) + short + words(30, 400 + k))) for k in range(20)]
    rows += [(200 + k, " ".join(words(30, 500) + stock[:3] + words(30, 501))) for k in range(20)]  # copies of one document
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(documents(rows), items).collect()}
    assert set(got) == {(k, 0) for k in range(20)} | {(100 + k, 1) for k in range(20)} | {(200 + k, 2) for k in range(20)}
    assert all(0.5 <= got[k, 0] < 0.6 and got[100 + k, 1] == 1 and got[200 + k, 2] == 0.5 for k in range(20))


def test_an_item_id_given_twice_is_compared_with_both_texts(documents, spark, words):
    texts = [" ".join(words(20, 1)), " ".join(words(30, 2))]
    items = spark.createDataFrame([(7, texts[0]), (7, texts[1]), (8, texts[1])], "item_id long, text string")
    rows = [(k, " ".join(words(40, 10 + k)) + f" {t} " + " ".join(words(40, 20 + k))) for k, t in enumerate(texts)]
    got = {(r.doc_id, r.item_id): (r.score, r.first_word, r.last_word) for r in contaminated(documents(rows), items).collect()}
    assert got == {(0, 7): (1.0, 40, 59), (1, 7): (1.0, 40, 69), (1, 8): (1.0, 40, 69)}

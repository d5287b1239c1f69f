"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages with test items.

Test items are taken in blocks of bounded size; each block goes to the tasks as a table of n-grams and meets all documents.  A
document emits, for each item with which it shares seeds, the passages around them, except those with too few of the item's words
to reach the score.  All of them are aligned, equal ones of a batch once.  The score is the best local alignment of words (+2 equal,
-1 different, -1 gap) over the score of a whole copy of the item.  An alignment that is no more than one seed of a longer item counts
only if a seed of its passage is rare, that is, stands alone in few passages of different wording, or if it has MANY_SEEDS of them.
"""

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import shingle_hashes, texts_of_words
from ridgeline.session import staged

SEED_WORDS = 3
MANY_SEEDS = 3
RARE_SHARE = 0.001
SCORE = 0.5
BLOCK_ITEMS = 20_000
SAME, DIFFERENT, GAP = 2, -1, -1


def _item_words(rows, least):
    """(item_id, words) of items with at least `least` words."""
    column = pa.array([r["text"] for r in rows], pa.string())
    return [(rows[row]["item_id"], words.copy()) for row, _, _, _, words in texts_of_words(column) if len(words) >= least]


class Seeds:
    """Sorted seeds of a block of items with their postings (item, position)."""

    def __init__(self, items: list[tuple[int, np.ndarray]], size: int):
        self.items = items
        seeds = [shingle_hashes(w, size) for _, w in items]
        flat = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.seed, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.item = np.concatenate([np.full(len(s), k) for k, s in enumerate(seeds)] + [np.zeros(0, int)]).astype(np.int64)[order]
        self.place = np.concatenate([np.arange(len(s)) for s in seeds] + [np.zeros(0, int)]).astype(np.int64)[order]

    def hits(self, grams: np.ndarray):
        """(document position, item, item position, seed) of all occurrences, by item and position."""
        if not len(self.seed) or not len(grams):
            return (np.zeros(0, np.int64),) * 4
        at = np.minimum(np.searchsorted(self.seed, grams), len(self.seed) - 1)
        where = np.flatnonzero(self.seed[at] == grams)
        at = at[where]
        n = self.first[at + 1] - self.first[at]
        flat = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.first[at], n)
        doc_at, item = np.repeat(where, n), self.item[flat]
        order = np.lexsort((doc_at, item))
        return doc_at[order], item[order], self.place[flat][order], np.repeat(at, n)[order]


PASSAGE = "doc_id long, item_id long, item_no int, first_word long, words array<long>, seeds array<long>"


def _passages(batches, block: Seeds, size, least):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        out = {"doc_id": [], "item_id": [], "item_no": [], "first_word": [], "words": [], "seeds": []}
        for row, _, _, _, words in texts_of_words(batch.column("text")):
            if ids[row] is None or len(words) < size:
                continue
            at, item, place, seed = block.hits(shingle_hashes(words, size))
            if not len(at):
                continue
            length = np.array([len(block.items[k][1]) for k in item])
            new = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (at[1:] - at[:-1] > length[1:])))
            for a, b in zip(new, np.append(new[1:], len(at))):
                m = int(length[a])
                slack = max(3, m // 4)
                lo = max(0, int((at[a:b] - place[a:b]).min()) - slack)
                hi = min(len(words), int((at[a:b] - place[a:b]).max()) + m + slack)
                item_id, aligned = block.items[int(item[a])]
                if np.isin(aligned, words[lo:hi]).sum() < least * len(aligned):  # even with all of these words in order
                    continue
                out["doc_id"].append(ids[row])
                out["item_id"].append(item_id)
                out["item_no"].append(int(item[a]))
                out["first_word"].append(lo)
                out["words"].append(words[lo:hi].view(np.int64))
                out["seeds"].append(np.unique(block.seed[seed[a:b]]).view(np.int64))
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_no", pa.int32()),
                                                         ("first_word", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))]))


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and the passage position after its last word (the first such position).

    All pairs advance together over the item's words; a gap along the passage is a running maximum.
    """
    n, m, w = len(items), max(map(len, items)), max(map(len, passages))
    item, passage = np.zeros((n, m), np.int64), np.ones((n, w), np.int64)
    for k in range(n):
        item[k, : len(items[k])] = items[k]
        passage[k, : len(passages[k])] = passages[k]
    used = np.arange(w) < np.array([len(p) for p in passages])[:, None]
    length = np.array([len(i) for i in items])
    slope = np.arange(w + 1) * -GAP
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    row = np.zeros((n, w + 1), np.int64)
    for j in range(m):
        same = (passage == item[:, j: j + 1]) & used & (j < length)[:, None]
        new = np.maximum(row + GAP, 0)
        new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + np.where(same, SAME, DIFFERENT))
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        top = row.argmax(axis=1)
        score = row[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
    return best, end


ALIGNED = "doc_id long, item_id long, score double, first_word long, last_word long"
LONE = ", lone boolean, content binary, seeds array<long>"  # no more than one seed of a longer item; hash of the passage


def _align(batches, block: Seeds, size, least):
    for batch in batches:
        rows, same = batch.to_pylist(), {}
        for r in rows:
            same.setdefault((r["item_no"], np.array(r["words"], np.int64).tobytes()), []).append(r)
        cases = sorted(same.items(), key=lambda c: (len(c[0][1]), c[0]))
        while cases:
            n = min(len(cases), max(1, 200_000 // max(1, len(cases[-1][0][1]) // 8)))
            part, cases = cases[-n:], cases[:-n]
            items = [block.items[no][1].view(np.int64) for (no, _), _ in part]
            words = [np.frombuffer(w, np.int64) for (_, w), _ in part]
            raw, end = smith_waterman(items, words)
            keep = [k for k in range(n) if raw[k] >= least * SAME * len(items[k])]
            out = {f.split()[0]: [] for f in (ALIGNED + LONE).split(", ")}
            if keep:
                _, back = smith_waterman([items[k][::-1] for k in keep], [words[k][: end[k]][::-1] for k in keep])
                for k, b in zip(keep, back):
                    whole, lone = SAME * len(items[k]), False
                    if raw[k] <= SAME * size and raw[k] < whole:
                        lone = len(part[k][1][0]["seeds"]) < MANY_SEEDS
                    content = hashlib.blake2b(part[k][0][1], digest_size=16).digest() if lone else None
                    for r in part[k][1]:
                        start = r["first_word"]
                        for name, value in zip(out, (r["doc_id"], r["item_id"], raw[k] / whole, start + int(end[k] - b),
                                                     start + int(end[k]) - 1, lone, content, r["seeds"] if lone else None)):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([
                ("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()),
                ("last_word", pa.int64()), ("lone", pa.bool_()), ("content", pa.binary()), ("seeds", pa.list_(pa.int64()))]))


def _blocks(benchmark: DataFrame, size: int):
    """Rows of the benchmark in blocks of at most `size`; one block is on the driver at a time."""
    block = []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
            "item_id is not null and text is not null").toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, seed_words: int = SEED_WORDS,
                 rare_share: float = RARE_SHARE, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of documents that hold a copy of a test item, edited or not.

    One row per document and item, with the best passage (word numbers of the document, both inclusive).  Rows without id or text
    have no part; an item with fewer than seed_words words can't be told from ordinary text and is left out.  Repeated documents
    count once; items that share an id are compared each, and the best of them counts.  Other columns are not read; an
    empty table on either side gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    few = max(1.0, rare_share * rows.count())
    found = docs.sparkSession.createDataFrame([], ALIGNED)
    for block in _blocks(benchmark, block_items):
        seeds = Seeds(_item_words(block, seed_words), seed_words)
        passages = rows.mapInArrow(partial(_passages, block=seeds, size=seed_words, least=score), PASSAGE)
        # written, so that the driver lets go of the block
        aligned = staged(passages.mapInArrow(partial(_align, block=seeds, size=seed_words, least=score), ALIGNED + LONE))
        columns = [f.split()[0] for f in ALIGNED.split(", ")]
        lone = aligned.where("lone").withColumn("seed", F.explode("seeds"))
        owners = lone.groupBy("item_id", "seed", "content").agg(F.min("doc_id").alias("owner"))
        rare = (owners.groupBy("item_id", "seed", "owner").agg(F.lit(1).alias("one")).groupBy("item_id", "seed")
                .agg(F.count("*").alias("n")).where(F.col("n") <= few).select("item_id", "seed"))
        found = found.unionByName(aligned.where("not lone").select(columns)).unionByName(
            staged(lone.join(rare, ["item_id", "seed"], "left_semi").select(columns)))
    best = F.max(F.struct("score", F.negative("first_word").alias("before"), F.negative("last_word").alias("until"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.score", F.negative("best.before").alias("first_word"), F.negative("best.until").alias("last_word"))

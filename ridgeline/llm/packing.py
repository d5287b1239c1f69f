"""Packing of token sequences by exact-complement hashing over the histogram of piece lengths.

A sequence has room for CAPACITY ids, so pieces have at most that many different lengths and a packing is a list of runs: so many
sequences, each filled with the same lengths.  The plan is made from the histogram (at most CAPACITY rows, whatever the corpus):
from the longest length down, its gap is looked up among single lengths, pair sums and triple sums of lengths that are still
available, and the combination is consumed as often as its scarcest length allows.  What has no exact complement is placed by
best fit, longest first, also in runs.  Every piece then finds its place from its rank within its length.  Ranks are counted in
salted slices of a length, so a length with a third of all pieces is spread over tasks.
"""

import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.llm.tokens import encoder
from ridgeline.session import staged

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(batches, vocabulary, capacity, added):
    tokens = encoder(vocabulary, added)
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
        for first, ids, ends in tokens.encode(batch.column("text")):
            for k in range(len(ends) - 1):
                own = ids[ends[k]: ends[k + 1]].astype("<u4")
                starts = [0, *range((len(own) - 1) % capacity + 1, len(own), capacity)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(own)])):
                    for name, value in zip(out, (docs[first + k], piece, a, b - a, zlib.crc32(own[a:b].tobytes()))):
                        out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                                                         ("length", pa.int64()), ("ids_crc32", pa.int64())]))


def cut_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document longer than capacity is cut into full pieces, the first may be shorter."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(partial(_cut, vocabulary=vocabulary, capacity=capacity, added=added), PIECES))


def _complement(left: np.ndarray, gap: int, longest: int) -> tuple[int, ...] | None:
    """Up to three available lengths that sum to gap, longest first; left holds availability after the length to complete."""
    if left[gap] > 0:
        return (gap,)
    have = left > 0
    first = np.arange(gap - 1, (gap - 1) // 2, -1)
    fits = first[have[first] & have[gap - first]]
    for a in fits[:2]:
        if 2 * a != gap or left[a] > 1:
            return int(a), int(gap - a)
    some = np.flatnonzero(have[:gap])
    sums = np.zeros(gap + 1, bool)
    for b in some[some <= gap // 2]:
        reach = some[some >= b] + b
        sums[reach[reach <= gap]] = True
    for a in some[::-1]:
        if 3 * a < gap:
            break
        if sums[gap - a]:
            second = some[(some <= a) & (2 * some >= gap - a) & (some < gap - a)][::-1]
            for b in second[have[gap - a - second]]:
                want = Counter((int(a), int(b), int(gap - a - b)))
                if all(left[x] >= n for x, n in want.items()):
                    return tuple(sorted(want.elements(), reverse=True))
    return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Counter]]:
    """Runs (number of sequences, lengths in each of them) that use every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    runs, rest = [], np.zeros_like(left)
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            found = () if length == capacity else _complement(left, capacity - length, length)
            left[length] += 1
            if found is None:
                rest[length], left[length] = left[length], 0
                break
            lengths = Counter((length, *found))
            n = int(min(left[x] // k for x, k in lengths.items()))
            for x, k in lengths.items():
                left[x] -= n * k
            runs.append((n, lengths))
    return runs + _best_fit(rest, capacity)


def _best_fit(rest: np.ndarray, capacity: int) -> list[tuple[int, Counter]]:
    """Best fit, longest first: many equal sequences take many equal pieces at once."""
    open_: dict[int, list[tuple[int, Counter]]] = {}
    for length in range(capacity, 0, -1):
        n = int(rest[length])
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                each = capacity // length
                full, more = divmod(n, each)
                if full:
                    open_.setdefault(capacity - each * length, []).append((full, Counter({length: each})))
                if more:
                    open_.setdefault(capacity - more * length, []).append((1, Counter({length: more})))
                break
            count, lengths = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
            each = min(gap // length, n)
            use = min(count, n // each)
            if use < count:
                open_.setdefault(gap, []).append((count - use, lengths))
            open_.setdefault(gap - each * length, []).append((use, lengths + Counter({length: each})))
            n -= use * each
    return [run for group in open_.values() for run in group]


def _slots(runs: list[tuple[int, Counter]]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset), sorted by length and rank."""
    used, sequence, rows = Counter(), 0, []
    for n, lengths in runs:
        offset = 0
        for length, copies in sorted(lengths.items(), reverse=True):
            rows.append((length, used[length], copies, sequence, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches, slots):
    keys = (slots[:, 0] << 48) + slots[:, 1]
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        _, start, copies, sequence, offset = slots[np.searchsorted(keys, (length << 48) + rank, "right") - 1].T
        row, copy = np.divmod(rank - start, copies)
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            + [pa.array(sequence + row), pa.array(offset + copy * length)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, added: bool = False) -> DataFrame:
    """One row per piece of docs(doc_id, text, ...) with its sequence_id and its offset there; offsets of a sequence have no gaps.

    A null text is an empty document (one end id), rows with a null or repeated id are packed like others, other columns are not
    read, an empty table gives an empty result.  added: find the added tokens of the vocabulary in texts.
    """
    pieces = staged(cut_documents(docs, vocabulary, capacity, added))
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = pieces.withColumn("salt", F.pmod(F.hash("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = staged(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("within", F.row_number().over(within) - 1).join(first.hint("merge"), ["length", "salt"])
              .withColumn("rank", F.col("first") + F.col("within")).drop("first", "within", "salt"))
    return ranked.mapInArrow(partial(_place, slots=_slots(plan(histogram, capacity))), PIECES + ", sequence_id long, offset long")

"""Ranked lexical search with hashed max-sketches.

Every document gets a sketch once: its terms are hashed to COORDINATES coordinates, and a coordinate keeps the largest number of
occurrences among its terms (one byte, the last value meaning "any number").  A document's impact grows with the occurrences, so these
maxima are also the maxima of the impacts.  The index holds the sketches (only coordinates in use), the documents' lengths and the
document frequency of every term, summed from partial counts per task.

Items are searched in blocks of about BLOCK_TERMS term entries.  Looking up the block's terms in the sketches, many documents and items at
once, gives an upper bound of each score.  Each item's K documents with the highest bounds are rescored exactly from their texts; the K-th
best score is the threshold.  Documents whose bound reaches it are rescored in descending order of the bounds, in steps, each of which
raises the threshold, until no bound reaches it.
"""

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.llm.words import slices, span_hashes, text_runs, word_spans
from ridgeline.session import staged

K = 50
COORDINATES = 1 << 16
MOST = 255  # this many occurrences or more
STEPS = (450, None)  # documents per item that are rescored after the first K, by bound; None: all that reach the threshold
BLOCK_TERMS = 100_000
BOUND_ROWS = 1024
BROADCAST_ROWS = 200_000
HELD_TERMS = 200_000
INDEX = "doc_id long, n long, coordinates binary, maxima binary, terms array<long>, holders array<long>"


def _terms(column):
    """(first row, rows, row of each distinct term, term, occurrences) for runs of rows; a term is a 64-bit hash."""
    for first, data, offsets in text_runs(column, "ascii"):
        starts, ends, bounds = word_spans(data, offsets)
        term = span_hashes(data, starts, ends)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
        order = np.lexsort((term, row))
        row, term = row[order], term[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
        at = np.flatnonzero(new)
        yield first, np.diff(bounds), row[at], term[at].view(np.int64), np.diff(np.append(at, len(row)))


def _coordinate(term: np.ndarray, coordinates: int) -> np.ndarray:
    return term.view(np.uint64) % np.uint64(coordinates)


def _index(batches, width):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("coordinates", pa.binary()), ("maxima", pa.binary()),
                        ("terms", pa.list_(pa.int64())), ("holders", pa.list_(pa.int64()))])

    def counted(terms, holders):
        return pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(c).type) for c in range(4)), pa.array([terms], pa.list_(pa.int64())),
                                           pa.array([holders], pa.list_(pa.int64()))], schema=schema)

    held, holders = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        ids = batch.column("doc_id")
        for first, n, row, term, times in _terms(batch.column("text")):
            own, count = np.unique(term, return_counts=True)
            held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
            holders = np.bincount(at, np.concatenate([holders, count]), len(held)).astype(np.int64)
            place = row.astype(np.uint64) * np.uint64(width) + _coordinate(term, width)
            order = np.argsort(place, kind="stable")
            place, tops = place[order], np.minimum(times[order], MOST).astype(np.uint8)
            at = np.flatnonzero(np.diff(place, prepend=place[:1] - np.uint64(1)) != 0) if len(place) else np.zeros(0, np.int64)
            tops = np.maximum.reduceat(tops, at) if len(at) else tops
            cut = np.searchsorted(place[at], np.arange(len(n) + 1, dtype=np.uint64) * np.uint64(width))
            coordinates = (place[at] % np.uint64(width)).astype("<u2")
            none = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(n)), pa.array(n, pa.int64()),
                 pa.array([coordinates[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                 pa.array([tops[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), none, none], schema=schema)
            if len(held) > HELD_TERMS:
                yield counted(held, holders)
                held, holders = held[:0], holders[:0]
    if len(held):
        yield counted(held, holders)


def _item_terms(batches):
    for batch in batches:
        places = np.asarray(batch.column("place"))
        for first, _, row, term, _ in _terms(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(places[first + row]), pa.array(term)], ["place", "term"])


class Corpus:
    """Number of documents with a term and of all their terms."""

    def __init__(self, documents: int, terms: int):
        self.documents, self.terms = documents, terms

    def weight(self, holders: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * holders + 1)))

    def impact(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(1000000000 * tf) div (1000 * tf + 20 * m); n is the document's number of terms."""
        lengths, at = np.unique(n, return_inverse=True)
        m = np.array([50 + 50 * int(x) * self.documents // self.terms for x in lengths], np.int64)[at]
        times = times.astype(np.int64)
        return 1_000_000_000 * times // (1000 * times + 20 * m)


class Block:
    """Term entries of some items: distinct terms and coordinates with the ranges of their entries."""

    def __init__(self, entries: list[tuple[int, int, int]], corpus: Corpus, coordinates: int):
        places, term, weight = (np.array([e[k] for e in entries], np.int64) for k in range(3))
        self.places, item = np.unique(places, return_inverse=True)
        by = np.argsort(term, kind="stable")
        self.terms, start = np.unique(term[by], return_index=True)
        self.of_term = (np.append(start, len(by)), item[by], weight[by])
        coordinate = _coordinate(term, coordinates).astype(np.int64)
        by = np.argsort(coordinate, kind="stable")
        self.of_coordinate = (np.searchsorted(coordinate[by], np.arange(coordinates + 1)), item[by], weight[by])
        self.corpus = corpus

    def _sums(self, rows: int, row, at, impact, entries) -> np.ndarray:
        """Row by item sums of weight times impact; at is the place of each value in the entries' ranges.  Exact below 2^53."""
        bounds, item, weight = entries
        count = bounds[at + 1] - bounds[at]
        entry = np.arange(int(count.sum())) + np.repeat(bounds[at] - (np.cumsum(count) - count), count)
        cell = np.repeat(row * len(self.places), count) + item[entry]
        return np.bincount(cell, weight[entry] * np.repeat(impact, count).astype(float), rows * len(self.places)).reshape(rows, -1)

    def bounds(self, n, coordinates, maxima, sizes) -> np.ndarray:
        row = np.repeat(np.arange(len(n)), sizes)
        used = self.of_coordinate[0][coordinates + 1] > self.of_coordinate[0][coordinates]
        row, coordinates, maxima = row[used], coordinates[used], maxima[used]
        impact = np.where(maxima == MOST, 1_000_000, self.corpus.impact(maxima, n[row]))
        return self._sums(len(n), row, coordinates, impact, self.of_coordinate)

    def scores(self, n, row, term, times) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, term), max(len(self.terms) - 1, 0))
        known = self.terms[at] == term
        return self._sums(len(n), row[known], at[known], self.corpus.impact(times[known], n[row[known]]), self.of_term)


def _bounds(batches, block):
    """(doc ids, document by item bounds) for a few sketches at a time."""
    for batch in slices(batches, BOUND_ROWS):
        coordinates, maxima = (batch.column(c).to_pylist() for c in ("coordinates", "maxima"))
        yield np.asarray(batch.column("doc_id")), block.bounds(
            np.asarray(batch.column("n")), np.frombuffer(b"".join(coordinates), "<u2").astype(np.int64),
            np.frombuffer(b"".join(maxima), np.uint8).astype(np.int64), np.fromiter(map(len, maxima), np.int64, len(maxima)))


def _bound_rows(item, doc, bound):
    return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(doc), pa.array(bound.astype(np.int64))], ["item", "doc_id", "bound"])


def _highest(batches, block, k):
    """The task's k highest bounds of every item."""
    item, doc, bound = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    least = np.zeros(len(block.places))
    for ids, own in _bounds(batches, block):
        row, col = np.nonzero(own > least)
        item, doc, bound = np.concatenate([item, col]), np.concatenate([doc, ids[row]]), np.concatenate([bound, own[row, col]])
        order = np.lexsort((doc, -bound, item))
        item, doc, bound = item[order], doc[order], bound[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        kept = rank < k
        last = rank == k - 1
        least[item[last]] = bound[last]
        item, doc, bound = item[kept], doc[kept], bound[kept]
    yield _bound_rows(item, doc, bound)


def _reaching(batches, block, threshold):
    """All bounds that reach the thresholds of their items."""
    for ids, own in _bounds(batches, block):
        row, col = np.nonzero(own >= threshold)
        yield _bound_rows(col, ids[row], own[row, col])


def _exact(batches, block):
    for batch in batches:
        ids, items = batch.column("doc_id").to_pylist(), batch.column("items").to_pylist()
        for first, n, row, term, times in _terms(batch.column("text")):
            scores = block.scores(n, row, term, times)
            out = [(item, ids[first + k], int(scores[k, item])) for k in range(len(n)) for item in items[first + k] if scores[k, item] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[c] for x in out], pa.int64()) for c in (1, 2))],
                                             ["item", "doc_id", "score"])


def _rescored(docs: DataFrame, chosen: DataFrame, block: Block) -> DataFrame:
    """(item, doc_id, score) of every row of docs whose id is chosen for an item; a few chosen rows are sent to the documents."""
    per_doc = chosen.select("item", "doc_id").distinct().groupBy("doc_id").agg(F.collect_list("item").alias("items"))
    per_doc = F.broadcast(per_doc) if chosen.count() <= BROADCAST_ROWS else per_doc
    return staged(docs.join(per_doc, "doc_id").mapInArrow(partial(_exact, block=block), "item int, doc_id long, score long"))


def _first(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def _thresholds(scored: DataFrame, k: int, items: int) -> np.ndarray:
    """The k-th best score of each item of a block, 1 if there are fewer."""
    out = np.ones(items)
    for r in _first(scored, k, F.desc("score")).where(F.col("rank") == k).collect():
        out[r["item"]] = max(1, r["score"])
    return out


def index(docs: DataFrame, coordinates: int = COORDINATES) -> DataFrame:
    """Sketches of docs(doc_id, text), and in rows without n the number of holders of terms, per task."""
    return docs.mapInArrow(partial(_index, width=coordinates), INDEX)


def search(docs: DataFrame, sketches: DataFrame, block: Block, k: int = K) -> DataFrame:
    """(item, doc_id, score, rank): the k best rows of docs for each item of a block."""
    order = (F.desc("bound"), "doc_id")
    top = sketches.mapInArrow(partial(_highest, block=block, k=k), "item int, doc_id long, bound long")
    chosen = staged(_first(top, k, *order).select("item", "doc_id"))
    scored = _rescored(docs, chosen, block)
    threshold = _thresholds(scored, k, len(block.places))
    open_ = staged(sketches.mapInArrow(partial(_reaching, block=block, threshold=threshold), "item int, doc_id long, bound long")
                   .join(chosen, ["item", "doc_id"], "left_anti").distinct())
    for step in STEPS:
        chosen = open_ if step is None else staged(_first(open_, step, *order).select("item", "doc_id"))
        scored = staged(scored.unionByName(_rescored(docs, chosen, block)))
        if step is not None:
            threshold = _thresholds(scored, k, len(block.places))
            least = docs.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(threshold)], "item int, least long")
            open_ = staged(open_.join(F.broadcast(least), "item").where("bound >= least").drop("least")
                           .join(chosen, ["item", "doc_id"], "left_anti"))
            if open_.isEmpty():
                break
    return _first(scored, k, F.desc("score"), "doc_id")


def _blocks(weighted: DataFrame, corpus: Corpus, coordinates: int):
    """Blocks of whole items, read one after the other."""
    entries = []
    for r in weighted.orderBy("place").toLocalIterator():
        if len(entries) >= BLOCK_TERMS and r["place"] != entries[-1][0]:
            yield Block(entries, corpus, coordinates)
            entries = []
        entries.append((r["place"], r["term"], corpus.weight(r["holders"])))
    if entries:
        yield Block(entries, corpus, coordinates)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, coordinates: int = COORDINATES) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items(item_id, text) its k best rows of docs(doc_id, text, ...).

    Best first, equal scores by ascending doc_id; only scores above 0.  Texts that are null or without terms take no part.  Rows of docs
    without an id count in the statistics and are not returned; repeated rows are documents of their own, as are repeated items.  Other
    columns are not read; without documents or items the result is empty.  coordinates: at most COORDINATES; fewer make looser bounds.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = staged(index(docs, coordinates))
    stats = made.where("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    corpus = Corpus(stats["documents"], stats["terms"] or 0)
    holders = (made.where("terms is not null").select(F.explode(F.arrays_zip("terms", "holders")).alias("_t"))
               .groupBy(F.col("_t.terms").alias("term")).agg(F.sum("_t.holders").alias("holders")))
    asked = staged(items.select("item_id", "text").withColumn("place", F.monotonically_increasing_id()))
    weighted = staged(asked.select("place", "text").mapInArrow(_item_terms, "place long, term long").join(holders, "term"))
    sketches = made.where("n > 0 and doc_id is not null").select("doc_id", "n", "coordinates", "maxima")
    out = asked.select(F.col("place"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    for block in _blocks(weighted, corpus, coordinates):
        of_item = docs.sparkSession.createDataFrame(list(enumerate(block.places.tolist())), "item int, place long")
        out = out.unionByName(staged(search(docs, sketches, block, k).join(F.broadcast(of_item), "item").select("place", "rank", "doc_id", "score")))
    return out.join(asked.select("place", "item_id"), "place").select("item_id", "rank", "doc_id", "score")

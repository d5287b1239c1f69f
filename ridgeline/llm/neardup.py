"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A document is the set of its five-word shingles (lower case; see words.py), all of weight 1 however often they occur.  Every shingle
sends a Poisson stream of arrivals, at a rate equal to its weight, to random registers; a register keeps the shingle that arrived
first.  A shingle drops out as soon as its next arrival is later than the latest register, which ends the walk early.  Two
registers agree with the probability Jaccard similarity of the weighted sets, which for equal weights is the Jaccard similarity.
Bands of registers give candidates, and a pair is linked if the exact Jaccard similarity of its shingle sets is 0.8 or more.

Exact copies (equal words in equal order) are reduced to their smallest doc_id before banding.  In each bucket all members are
first compared with one of them, which connects groups of copies without forming their pairs.  In a bucket that still holds several
components, the members outside of its first member's component then meet all members of other components: in blocks of about
BLOCK members whose whole signatures are compared in arrays, so that only pairs whose estimate comes near the threshold are emitted.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.components import components
from ridgeline.llm.words import jaccard, mix, shingle_hashes, shingle_runs, slices, texts_of_words
from ridgeline.session import staged

SIMILARITY = 0.8
BANDS, ROWS = 41, 8
BLOCK = 64
VERIFY_ROWS = 256
SLACK = 0.09  # four standard deviations of the estimate from BANDS * ROWS registers
_STREAM = np.uint64(0xA0761D6478BD642F)


def probminhash(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, documents: int, size: int) -> np.ndarray:
    """Registers (documents x size) of many weighted sets at once: the shingle of each register's first arrival.

    Element k belongs to document owner[k]; shingles of a document are distinct 64-bit values, weights are positive.
    """
    best = np.full(documents * size, np.inf)
    kept = np.zeros(documents * size, np.uint64)
    clock, step = np.zeros(len(shingles)), 0
    while len(shingles):
        ahead = min(64, max(1, 8192 // len(shingles)))  # a few elements send several arrivals in one go
        random = mix(shingles[:, None] + np.arange(step + 1, step + ahead + 1).astype(np.uint64) * _STREAM)
        gaps = -np.log(((random >> np.uint64(20)).astype(np.float64) + 0.5) * 2.0 ** -44) / weights[:, None]
        times = clock[:, None] + np.cumsum(gaps, axis=1)
        register = owner[:, None] * size + (random & np.uint64(0xFFFFF)).astype(np.int64) % size
        np.minimum.at(best, register.ravel(), times.ravel())
        first = times == best[register]
        kept[register[first]] = np.broadcast_to(shingles[:, None], times.shape)[first]
        going = times[:, -1] < best.reshape(documents, size).max(axis=1)[owner]  # a later arrival can't win a register
        owner, shingles, weights, clock = owner[going], shingles[going], weights[going], times[going, -1]
        step += ahead
    return kept.reshape(documents, size)


def _sequence_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the word sequence of each row."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    placed = mix(words) * (mix(place.astype(np.uint64)) | np.uint64(1))
    keys = []
    for term in (placed, mix(placed)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
        keys.append((sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return tuple(keys)


def _sign(batches, bands, rows):
    for batch in batches:
        ids = batch.column("doc_id")
        for first, bounds, words, ends, shingles in shingle_runs(batch.column("text")):
            n = len(bounds) - 1
            # the document above the upper 52 bits of the shingle: one sort finds the distinct shingles of all documents
            owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(ends))
            own = np.unique(owner % np.uint64(4096) << np.uint64(52) | shingles >> np.uint64(12))
            kept = probminhash((own >> np.uint64(52)).astype(np.int64), own & np.uint64((1 << 52) - 1), np.ones(len(own)), n,
                               bands * rows).reshape(n, bands, rows)
            key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
            for k in range(rows):
                key = mix(key * np.uint64(31) + kept[:, :, k])
            one, two = _sequence_keys(words, bounds)
            table = pa.RecordBatch.from_arrays(
                [ids.slice(first, n), pa.array(one), pa.array(two),
                 pa.FixedSizeListArray.from_arrays(pa.array(key.view(np.int64).ravel()), bands).cast(pa.list_(pa.int64())),
                 pa.array([row.tobytes() for row in (mix(kept) & np.uint64(255)).astype(np.uint8)], pa.binary())],
                ["doc_id", "key1", "key2", "bands", "sketch"])
            yield table.filter(pa.array(np.diff(bounds) > 0)).filter(pc.is_valid(pc.field("doc_id")))


def _similar(batches):
    for batch in slices(batches, VERIFY_ROWS):
        left, right = ([np.unique(shingle_hashes(words)) for *_, words in texts_of_words(batch.column(c))]
                       for c in ("text_a", "text_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"),
                                          pa.array([jaccard(x, y) for x, y in zip(left, right)], pa.float64())],
                                         ["a", "b", "similarity"])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key1, key2, bands, sketch) of every document with an id and a word; sketch has a byte per register."""
    return (docs.select(F.col("doc_id").cast("long"), "text")
            .mapInArrow(partial(_sign, bands=bands, rows=rows),
                        "doc_id long, key1 long, key2 long, bands array<long>, sketch binary"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) with the exact similarity of each pair."""
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return staged(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
                  .mapInArrow(_similar, "a long, b long, similarity double"))


def _without_singles(members: DataFrame) -> DataFrame:
    many = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return members.join(many, "bucket")


def _near_in_blocks(batches, least):
    for batch in slices(batches, 1):
        out = {"a": [], "b": []}
        for row in batch.to_pylist():
            ids, parts, bands = ([np.array([m[k] for m in row[side]]) for side in ("left", "right")] for k in ("doc_id", "part", "bands"))
            left, right = (np.frombuffer(b"".join(m["sketch"] for m in row[side]), np.uint8).reshape(len(row[side]), -1)
                           for side in ("left", "right"))
            for k in range(len(left)):
                same = (right == left[k]).mean(axis=1)
                common = bands[1] == bands[0][k]
                here = bands[1][np.arange(len(right)), common.argmax(axis=1)] == row["bucket"]  # each pair in its first bucket only
                near = (same >= least) & here & (parts[1] != parts[0][k]) & (ids[1] != ids[0][k])
                out["a"] += np.minimum(ids[1][near], ids[0][k]).tolist()
                out["b"] += np.maximum(ids[1][near], ids[0][k]).tolist()
        yield pa.RecordBatch.from_pydict(out, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _across(members: DataFrame, label: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """(a, b) in a common bucket but in different components, with an estimated similarity of at least `least`."""
    own = label.select(F.col("node").alias("doc_id"), "component")
    parts = (members.join(own, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component"))
    mixed = (parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "doc_id").alias("main"))
             .where("low != high").select("bucket", "main"))
    open_ = staged(parts.join(mixed, "bucket").withColumn("inner", F.col("part") == F.col("main")).drop("main"))
    sizes = open_.groupBy("bucket", "inner").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = staged(open_.join(sizes, ["bucket", "inner"]).join(sketches, "doc_id")
                    .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
                    .groupBy("bucket", "inner", "block").agg(F.collect_list(F.struct("doc_id", "part", "bands", "sketch")).alias("held")))
    left = blocks.where(~F.col("inner")).select("bucket", F.col("block").alias("one"), F.col("held").alias("left"))
    right = blocks.select("bucket", "inner", F.col("block").alias("two"), F.col("held").alias("right"))
    meet = left.join(right, "bucket").where("inner or one <= two").select("bucket", "left", "right")
    return staged(meet.mapInArrow(partial(_near_in_blocks, least=least), "a long, b long").distinct())


def links(members: DataFrame, sketches: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): links that connect what all similar pairs within buckets (bucket, doc_id) would connect."""
    heads = members.groupBy("bucket").agg(F.min("doc_id").alias("head"))
    stars = members.join(heads, "bucket").where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    star_links = _verified(stars, texts).where(F.col("similarity") >= similarity)
    others = _across(members, components(star_links), sketches, similarity - SLACK)
    return star_links.unionByName(_verified(others, texts).where(F.col("similarity") >= similarity))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) for every row of docs(doc_id, text, ...): class_id is the smallest doc_id of its group.

    A row without a text, without words or without an id is a class of its own (class_id = doc_id).  A repeated row (equal id and
    text) appears as often as it is given.  Rows that share an id and differ in text are joined into one class, as ids name
    documents.  Other columns of docs are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = staged(signatures(docs, bands, rows))
    leaders = staged(signed.groupBy("key1", "key2").agg(F.min("doc_id").alias("leader")))
    ids = leaders.select(F.col("leader").alias("doc_id"))
    buckets = (signed.join(ids, "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("bucket")).distinct())
    members = staged(_without_singles(buckets))
    texts = staged(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").where(F.col("text").isNotNull())
                   .groupBy("doc_id").agg(F.min("text").alias("text")))
    sketches = signed.join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct("sketch", "bands")).alias("own")).select("doc_id", "own.sketch", "own.bands")
    label = components(links(members, sketches, texts, similarity))
    # ids that carry several texts tie the leaders of these texts together
    per_id = signed.join(leaders, ["key1", "key2"]).select("doc_id", "leader").distinct()
    several = per_id.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("leader").alias("low")).where("n > 1")
    if several.limit(1).count():
        tie = per_id.join(several, "doc_id").select(F.col("leader").alias("a"), F.col("low").alias("b"))
        label = components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(tie))
    of_leader = per_id.groupBy("doc_id").agg(F.min("leader").alias("leader")).join(
        label, F.col("leader") == F.col("node"), "left").select("doc_id", F.coalesce("component", "leader").alias("class_id"))
    return docs.select("doc_id").join(of_leader, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))

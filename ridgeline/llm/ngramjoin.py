"""Jaccard join of documents on word n-grams by multiple global orders.

A document is the set of its distinct shingles.  Two sets of a similarity of PERCENT or more share one of their first
n - ceil(n * PERCENT / 100) + 1 shingles under any order that is the same for all documents.  Three orders are used: rarest first, by
counts of shingle hashes in a table of SLOTS slots that is summed over the whole corpus (its size does not depend on the data), and two
hash orders.  The first order's prefixes are the buckets in which pairs are looked for; a pair goes on only if its prefixes meet under
the two other orders as well and its sizes allow the similarity.  What is left is verified on whole texts.  The filters are necessary
conditions, so no link is lost.

Equal sets are reduced to their smallest doc_id first.  In each bucket all members meet its first member, which connects groups of near
copies without forming their pairs.  Of buckets that still hold several components, those of up to SMALL members give the pairs of
different components to the filters; in larger ones the members outside of the first member's component meet all members in blocks of about
BLOCK, as products of whole sets, and only links leave a block.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.components import components
from ridgeline.llm.words import mix, shingle_runs, slices
from ridgeline.session import staged

SHINGLE, PERCENT = 4, 85
SLOTS, PARTS = 1 << 20, 16
BLOCK, SMALL = 128, 256
VERIFY_ROWS = 256
SENT = 1 << 20  # rows of two numbers, 16 MB
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
_ORDERS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x1F83D9ABFB41BD6B))
_KEYS = (np.uint64(0x5BE0CD19137E2179), np.uint64(0xCBBB9D5DC1059ED8))
INDEX = "row_no long, doc_id long, n_shingles long, key1 long, key2 long, prefix array<long>, one array<int>, two array<int>"


def _shingles(column, size):
    """(first row, offsets, shingle hashes with repeats) for runs of rows."""
    for first, _, _, ends, hashes in shingle_runs(column, size, "ascii", _NOT_BLANK):
        yield first, ends, hashes


def _sets(ends, hashes) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and distinct ascending shingles of the rows of a run."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return np.searchsorted(row[first], np.arange(len(ends))), hashes[first]


def _slot(hashes):
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


def _count(batches, size):
    """The task's count of shingles per slot, in parts."""
    counts = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, _, hashes in _shingles(batch.column("text"), size):
            counts += np.bincount(_slot(hashes), minlength=SLOTS)
    if counts.any():
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()),
                                          "counts": [x.astype("<i8").tobytes() for x in np.split(counts, PARTS)]})


def _add(batches):
    """Sums of parts, a batch at a time."""
    held = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
            held[part] = held.get(part, 0) + np.frombuffer(counts, "<i8")
    if held:
        yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "counts": [x.tobytes() for x in held.values()]})


def sent(ids: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, sent to the tasks if it has at most SENT rows; larger ones are joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT else ids


def slot_levels(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """How frequent the shingles of each slot are, as a level of 0 to 255 (seven steps per doubling)."""
    parts = docs.select("text").mapInArrow(partial(_count, size=size), "part int, counts binary")
    summed = parts.repartition(PARTS, "part").mapInArrow(_add, "part int, counts binary").collect()  # PARTS rows of equal length
    counts = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for r in summed:
        counts[r["part"]] += np.frombuffer(r["counts"], "<i8")
    return np.minimum(7 * np.log2(counts.ravel() + 1.0), 255).astype(np.uint8)


def _ragged(values, bounds, take) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the first take[k] values of each row."""
    ends = np.concatenate([[0], np.cumsum(take)])
    return ends, values[np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], take)]


def _list(values, offsets, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _index(batches, levels, size, percent):
    row_no = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids = batch.column("doc_id")
        for first, ends, hashes in _shingles(batch.column("text"), size):
            bounds, own = _sets(ends, hashes)
            n = np.diff(bounds)
            take = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
            row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
            keys = []
            for salt in _KEYS:
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(own ^ salt))])
                keys.append(mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ n.astype(np.uint64)).view(np.int64))
            # stable sorts of shingles in ascending order: each order is total and the same for every document
            rare = np.argsort(row << np.uint64(54) | levels[_slot(own)].astype(np.uint64) << np.uint64(46) | own >> np.uint64(18), kind="stable")
            to, prefix = _ragged(own[rare], bounds, take)
            lists = [_list(prefix.view(np.int64), to, pa.int64())]
            for salt in _ORDERS:
                place = mix(own ^ salt)
                order = np.argsort(row << np.uint64(54) | place >> np.uint64(10), kind="stable")
                _, prefix = _ragged(place[order], bounds, take)
                lists.append(_list((prefix & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), to, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(row_no + np.arange(len(n))), ids.slice(first, len(n)), pa.array(n), *map(pa.array, keys), *lists],
                                             ["row_no", "doc_id", "n_shingles", "key1", "key2", "prefix", "one", "two"])
            row_no += len(n)


def _linked(batches, size, percent):
    """Pairs of texts with the similarity, by their whole sets."""
    for batch in slices(batches, VERIFY_ROWS):
        sides = []
        for column in ("text_a", "text_b"):
            sets = []
            for _, ends, hashes in _shingles(batch.column(column), size):
                bounds, own = _sets(ends, hashes)
                sets += [own[bounds[k]: bounds[k + 1]] for k in range(len(bounds) - 1)]
            sides.append(sets)
        both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sides)], np.int64)
        union = np.array([len(x) + len(y) for x, y in zip(*sides)], np.int64) - both
        yield batch.select(["a", "b"]).filter(pa.array((100 * both >= percent * union) & (both > 0)))


def _side(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, part, owner of each shingle, shingles) of the members in a list column of one row."""
    members = column.flatten()
    node, part = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part"))
    own = members.field("own")
    return node, part, np.repeat(np.arange(len(node)), pc.list_value_length(own).to_numpy(zero_copy_only=False)), own.flatten().to_numpy(zero_copy_only=False)


def _meet(batches, percent):
    """Links of a block with another by whole sets: for each member one link with each other component."""
    for batch in slices(batches, 1):
        (a, part_a, owner_a, one), (b, part_b, owner_b, two) = (_side(batch.column(c)) for c in ("left", "right"))
        common = np.intersect1d(one, two)
        held = []
        for n, owner, own in ((len(a), owner_a, one), (len(b), owner_b, two)):
            at = np.minimum(np.searchsorted(common, own), max(len(common) - 1, 0))
            known = common[at] == own if len(common) else np.zeros(len(own), bool)
            table = np.zeros((n, len(common)), np.float32)
            table[owner[known], at[known]] = 1
            held.append(table)
        both = (held[0] @ held[1].T).astype(np.int64)
        union = np.bincount(owner_a, minlength=len(a))[:, None] + np.bincount(owner_b, minlength=len(b)) - both
        i, j = np.nonzero((100 * both >= percent * union) & (both > 0) & (part_a[:, None] != part_b) & (a[:, None] != b))
        _, first = np.unique(np.stack([i, part_b[j]], axis=1), axis=0, return_index=True) if len(i) else (None, np.zeros(0, np.int64))
        i, j = a[i[first]], b[j[first]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j), pa.int64()), pa.array(np.maximum(i, j), pa.int64())], ["a", "b"])


def _small(batches, percent):
    """Pairs of different components of a small bucket, sizes allowing."""
    for batch in slices(batches, 1024):
        members = batch.column("held").flatten()
        node, part, n = (members.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "n_shingles"))
        ends = np.cumsum(pc.list_value_length(batch.column("held")).to_numpy(zero_copy_only=False))
        out = [np.zeros((2, 0), np.int64)]
        for low, high in zip(np.append(0, ends), ends):
            i, j = np.triu_indices(high - low, 1)
            i, j = i + low, j + low
            good = (part[i] != part[j]) & (node[i] != node[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            i, j = node[i[good]], node[j[good]]
            out.append(np.stack([np.minimum(i, j), np.maximum(i, j)]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _whole(batches, size):
    """(node, own): the sets of documents."""
    for batch in batches:
        ids = batch.column("doc_id")
        for first, ends, hashes in _shingles(batch.column("text"), size):
            bounds, own = _sets(ends, hashes)
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(bounds) - 1), _list(own.view(np.int64), bounds, pa.int64())], ["node", "own"])


def _in_pairs(rows: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows of the documents that a written table of pairs names."""
    ids = staged(pairs.select(F.col("a").alias(key)).union(pairs.select("b")).distinct())
    return rows.join(sent(ids), key, "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    pairs = staged(pairs)
    texts = _in_pairs(texts, "doc_id", pairs)
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return staged(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
                  .mapInArrow(partial(_linked, size=size, percent=percent), "a long, b long"))


def _filtered(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose prefixes meet under the two hash orders."""
    pairs = staged(pairs)
    nodes = _in_pairs(nodes, "node", pairs)
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n_shingles", "one", "two")]), side)
    sizes = 100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")
    return pairs.where(sizes & F.arrays_overlap("one_a", "one_b") & F.arrays_overlap("two_a", "two_b")).select("a", "b").distinct()


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: (bucket, node, n_shingles, part, inner, crowd)."""
    parts = (members.join(label.select("node", "component"), "node", "left").withColumn("part", F.coalesce("component", "node"))
             .drop("component"))
    mixed = staged(parts.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min_by("part", "node").alias("main"),
                                               F.count("*").alias("crowd")).where("low != high").select("bucket", "main", "crowd"))
    return staged(parts.join(mixed, "bucket").select("bucket", "node", "n_shingles", "part", (F.col("part") == F.col("main")).alias("inner"), "crowd"))


def _across_blocks(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of crowded buckets: those outside of the first member's component meet all members, block by block."""
    sizes = staged(open_.groupBy("bucket", "inner").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    ids = open_.select(F.col("node").alias("doc_id")).distinct()
    sets = staged(texts.join(ids, "doc_id", "left_semi").mapInArrow(partial(_whole, size=size), "node long, own array<long>"))
    blocks = staged(open_.join(sizes, ["bucket", "inner"]).join(sets, "node")
                    .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
                    .groupBy("bucket", "inner", "block").agg(F.collect_list(F.struct("node", "part", "own")).alias("held")))
    left = blocks.where(~F.col("inner")).select("bucket", F.col("block").alias("one"), F.col("held").alias("left"))
    right = blocks.select("bucket", "inner", F.col("block").alias("two"), F.col("held").alias("right"))
    meet = left.join(right, "bucket").where("inner or one <= two").select("left", "right")
    return staged(meet.mapInArrow(partial(_meet, percent=percent), "a long, b long").distinct())


def links(nodes: DataFrame, texts_of, size: int = SHINGLE, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(a, b): links that connect what all links between nodes would connect; texts_of(ids) gives the texts of the nodes in play."""
    entries = nodes.select("node", F.explode("prefix").alias("bucket"), "n_shingles")  # an id with several texts may be here twice
    heads = staged(entries.select("bucket", "node").groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("a"))
                   .where("n > 1").select("bucket", "a"))
    members = staged(entries.join(sent(heads), "bucket"))
    texts = texts_of(members.select(F.col("node").alias("doc_id")).distinct())
    stars = members.where("node != a").select("a", F.col("node").alias("b")).distinct()
    star_links = _verified(_filtered(stars, nodes, percent), texts, size, percent)
    open_ = _open(members.select("bucket", "node", "n_shingles"), components(star_links))
    held = F.collect_list(F.struct("node", "part", "n_shingles")).alias("held")
    others = (open_.where(F.col("crowd") <= small).groupBy("bucket").agg(held)
              .mapInArrow(partial(_small, percent=percent), "a long, b long").distinct())
    across = _verified(_filtered(others, nodes, percent), texts, size, percent)
    return star_links.unionByName(across).unionByName(_across_blocks(open_.where(F.col("crowd") > small), texts, size, percent))


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text, ...).

    Words are runs without ASCII white space, A to Z in lower case.  n_shingles is the number of distinct shingles of `size` words; a
    text with fewer words has one of all of them, a text that is null or has no words none, and it is linked with nothing.
    component_id is the smallest doc_id that links reach.  Rows that share an id are one document, linked by any of their texts;
    repeated rows are given each time; a row without an id has no component.  Other columns are not read, an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    levels = slot_levels(docs, size)
    index = staged(docs.mapInArrow(partial(_index, levels=levels, size=size, percent=percent), INDEX))
    rows = index.where("doc_id is not null and n_shingles > 0")
    leaders = staged(rows.groupBy("key1", "key2").agg(F.min(F.struct("doc_id", "row_no")).alias("first")).select(
        "key1", "key2", F.col("first.doc_id").alias("node"), "first.row_no"))
    nodes = staged(rows.join(sent(leaders.select("row_no")), "row_no", "left_semi")
                   .select(F.col("doc_id").alias("node"), "n_shingles", "prefix", "one", "two"))
    repeated = not rows.groupBy("doc_id").count().where("count > 1").isEmpty()

    def texts_of(ids):
        own = docs.join(sent(staged(ids)), "doc_id", "left_semi").where("text is not null")
        return staged(own.distinct() if repeated else own)

    per_id = staged(rows.select("doc_id", "key1", "key2").join(leaders.select("key1", "key2", "node"), ["key1", "key2"])
                    .select("doc_id", "node").distinct())
    several = per_id.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1").select("doc_id", "a")
    ties = per_id.join(several, "doc_id").select("a", F.col("node").alias("b"))  # an id with several texts is one document
    label = components(links(nodes, texts_of, size, percent, small).unionByName(ties))
    found = staged(per_id.join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id")))
    return (index.select("doc_id", "n_shingles").join(found, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))

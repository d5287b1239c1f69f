"""Alignment of two tokenizers on the same bytes, by divide and conquer at shared cuts.

A text with a blank before it is encoded by a byte-level vocabulary (A) and by a SentencePiece model (B).  A place where tokens of both
end is a cut.  An interval of A's tokens between two cuts is divided at a common end near its middle: the ends around the middle are
looked up in B's ends by bisection, nearest first, and both halves go on in the same way; an interval without a common end inside is a
group.  All intervals of a run of texts are divided together, level by level, so a level is a few array operations.

Two tokens are linked where their byte ranges overlap.  Links are counted over the corpus per id pair: partial counts per task,
summed by pair.  The HOT most frequent pairs (a fixed number) go to the tasks as arrays and serve most links of a document in place;
its other pairs join the table of counts, where a key has at most a HOT-th of all links.
"""

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from ridgeline.llm.tokens import RUN, ChunkEncoder, byte_symbols, encoder
from ridgeline.llm.words import SLICE_ROWS, arrow_texts, runs
from ridgeline.session import staged

HOT = 1 << 16
HELD_PAIRS = 1 << 20
SHA_TOKENS = 1 << 18
_SPACE = "▁"
DIGESTS = "row_no long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>"
GROUPS = "doc_id long, groups array<struct<start:int,end:int,a:array<int>,b:array<int>>>"
_known = {}


class PieceEncoder(ChunkEncoder):
    """SentencePiece ids of texts that begin with the blank which the model would add.

    A chunk starts at a blank after another character.  No piece has a blank behind other characters, so the model merges nothing
    across such a place, and the ids of a text are those of its chunks.
    """

    def __init__(self, path: str):
        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in self.pieces):
            raise ValueError("the model has pieces with a blank inside")
        self.blank = self.model.piece_to_id(_SPACE)

    def cuts(self, data, offsets):
        cut, blank = np.zeros(len(data) + 1, bool), data == 32
        cut[1:-1] = blank[1:] & ~blank[:-1]
        cut[offsets] = True
        return cut[:-1]

    def ids_of(self, chunks):
        texts = [c[1:].encode("latin-1").decode() for c in chunks]  # the model adds the blank again, but not to nothing
        return [ids if t else [self.blank] for ids, t in zip(self.model.encode(texts, num_threads=1), texts)]


class TokenBytes:
    """The bytes of every id, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        before = np.cumsum(size) - size
        return self.flat[np.arange(int(size.sum())) + np.repeat(self.start[ids] - before, size)]


def piece_bytes(model: SentencePieceProcessor) -> list[bytes]:
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]


def symbol_bytes(tokenizer) -> list[bytes]:
    """Bytes of byte-level ids; an added token has its own text."""
    back = {s: b for b, s in byte_symbols().items()}
    added = {k: t.content.encode() for k, t in tokenizer.get_added_tokens_decoder().items()}
    return [added[k] if k in added else bytes(back[c] for c in tokenizer.id_to_token(k) or "") for k in range(tokenizer.get_vocab_size())]


class Aligner:
    """Both tokenizers of a process with the bytes of their tokens."""

    def __init__(self, vocabulary: str, model: str):
        self.a, self.b = encoder(vocabulary), PieceEncoder(model)
        self.a_bytes, self.b_bytes = TokenBytes(symbol_bytes(self.a.tokenizer)), TokenBytes(piece_bytes(self.b.model))
        self.names = ([f"{k}{end}" for k in range(len(self.a_bytes.size)) for end in ",|"]
                      + [f"{k}{end}" for k in range(len(self.b_bytes.size)) for end in ",;"])

    def align(self, data: np.ndarray, offsets: np.ndarray) -> "Aligned":
        a, a_rows = self.a.encode_run(data, offsets)
        b, b_rows = self.b.encode_run(data, offsets)
        odd = _differs(self.a_bytes, a, a_rows, data, offsets) | _differs(self.b_bytes, b, b_rows, data, offsets)
        (a, a_rows), (b, b_rows) = _without(odd, a, a_rows), _without(odd, b, b_rows)
        return Aligned(self, a, a_rows, b, b_rows)


def aligner(vocabulary: str, model: str) -> Aligner:
    """The aligner of this process."""
    if (vocabulary, model) not in _known:
        _known[vocabulary, model] = Aligner(vocabulary, model)
    return _known[vocabulary, model]


def _differs(table: TokenBytes, ids, rows, data, offsets) -> np.ndarray:
    """Rows whose tokens do not join to their bytes."""
    joined = table.joined(ids)
    places = np.concatenate([[0], np.cumsum(table.size[ids])])[rows]
    length = np.diff(offsets)
    odd = np.diff(places) != length
    at = np.repeat(np.where(odd, 0, places[:-1] - offsets[:-1]), length) + np.arange(len(data))
    wrong = np.flatnonzero(joined[np.minimum(at, len(joined) - 1)] != data) if len(joined) else np.zeros(0, np.int64)
    odd[np.searchsorted(offsets, wrong, "right") - 1] = True
    return odd


def _without(odd, ids, rows):
    """Tokens and offsets without those of odd rows."""
    n = np.diff(rows)
    return ids[np.repeat(~odd, n)], np.concatenate([[0], np.cumsum(np.where(odd, 0, n))])


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which of A's tokens end where one of B's ends; ends ascend over all rows, rows has the offsets of the rows' A tokens.

    Divide and conquer: see the module.  The last token of a row always ends a group.
    """
    cut = np.zeros(len(a_ends), bool)
    many = np.diff(rows) > 0
    low, high = rows[:-1][many], rows[1:][many] - 1  # intervals of tokens low..high, of which high ends at a cut
    cut[high] = True
    while len(low):
        found, middle = np.full(len(low), -1), (low + high - 1) // 2
        open_, reach = np.flatnonzero(low < high), 0
        while len(open_):
            for sign in (1, -1)[: 2 if reach else 1]:
                place = middle[open_] + sign * reach
                inside = (place >= low[open_]) & (place < high[open_]) & (found[open_] < 0)
                at, place = open_[inside], place[inside]
                hit = b_ends[np.searchsorted(b_ends, a_ends[place])] == a_ends[place]
                found[at[hit]] = place[hit]
            reach += 1
            open_ = open_[(found[open_] < 0) & ((middle[open_] + reach < high[open_]) | (middle[open_] - reach >= low[open_]))]
        split = found >= 0
        cut[found[split]] = True
        low, high = np.concatenate([low[split], found[split] + 1]), np.concatenate([found[split], high[split]])
        more = low < high
        low, high = low[more], high[more]
    return cut


class Aligned:
    """Tokens of a run of rows, their groups and links."""

    def __init__(self, owner: Aligner, a, a_rows, b, b_rows):
        self.owner, self.a, self.a_rows, self.b, self.b_rows = owner, a, a_rows, b, b_rows
        self.a_ends, self.b_ends = np.cumsum(owner.a_bytes.size[a]), np.cumsum(owner.b_bytes.size[b])
        self.a_last = shared_cuts(self.a_ends, self.b_ends, a_rows)
        self.b_last = np.zeros(len(b), bool)
        self.b_last[np.searchsorted(self.b_ends, self.a_ends[self.a_last])] = True

    def group_rows(self) -> np.ndarray:
        """Offsets of the rows' groups."""
        return np.concatenate([[0], np.cumsum(self.a_last)])[self.a_rows]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, pair number) of every link: one for each stretch between neighbouring ends, which one token of each side covers."""
        ends = np.union1d(self.a_ends, self.b_ends)
        at = np.searchsorted(self.a_ends, ends)
        pair = self.a[at].astype(np.int64) * len(self.owner.b_bytes.size) + self.b[np.searchsorted(self.b_ends, ends)]
        return np.searchsorted(self.a_rows, at, "right") - 1, pair

    def digests(self) -> list[str]:
        """SHA-256 of the groups of each row written as `a1,a2|b1;a3|b2,b3`; empty without tokens."""
        names, both = self.owner.names, self.a_rows + self.b_rows
        a_to, b_to = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + np.repeat(np.append(0, b_to)[:-1], np.diff(a_to, prepend=0))] = self.a.astype(np.int64) * 2 + self.a_last
        order[np.arange(len(self.b)) + np.repeat(a_to, np.diff(b_to, prepend=0))] = (
            (self.b.astype(np.int64) + len(self.owner.a_bytes.size)) * 2 + self.b_last)
        out = []
        for low, high in zip(both[:-1].tolist(), both[1:].tolist()):
            sha = hashlib.sha256()
            for at in range(low, high, SHA_TOKENS):
                said = "".join(map(names.__getitem__, order[at: min(at + SHA_TOKENS, high)].tolist()))
                sha.update((said if at + SHA_TOKENS < high else said[:-1]).encode())
            out.append(sha.hexdigest() if high > low else "")
        return out

    def groups(self) -> pa.Array:
        """Per row its groups: byte range in the text with the blank before it, A's and B's ids."""
        a_to, b_to = np.flatnonzero(self.a_last) + 1, np.flatnonzero(self.b_last) + 1
        ends = self.a_ends[self.a_last]
        base = np.append(0, self.a_ends)[self.a_rows]
        rows = self.group_rows()
        start = np.append(0, ends)[:-1] - np.repeat(base[:-1], np.diff(rows))
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(ids.astype(np.int32)))
                 for to, ids in ((a_to, self.a), (b_to, self.b))]
        fields = [pa.array(start, pa.int32()), pa.array(ends - np.repeat(base[:-1], np.diff(rows)), pa.int32()), *lists]
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "end", "a", "b"]))


def _runs(batches, vocabulary, model):
    """(ids, alignment) for runs of rows."""
    both = aligner(vocabulary, model)
    for batch in batches:
        ids = batch.column("doc_id")
        for base in range(0, len(batch), SLICE_ROWS):
            texts = arrow_texts(batch.column("text").slice(base, SLICE_ROWS))
            spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(
                pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
            for first, data, offsets in runs(spaced, RUN):
                yield ids.slice(base + first, len(offsets) - 1), both.align(data, offsets)


def _list(values, offsets, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _digest(batches, vocabulary, model):
    """A row per document with its distinct pairs; rows without row_no have the counts of pairs of the task."""
    schema = pa.schema([("row_no", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                        ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])

    def counted(pairs, counts):
        none = [pa.nulls(1, f.type) for f in schema][:-2]
        return pa.RecordBatch.from_arrays([*none, _list(pairs, [0, len(pairs)], pa.int32()), _list(counts, [0, len(pairs)], pa.int64())],
                                          schema=schema)

    row_no = TaskContext.get().partitionId() << 36
    held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for ids, run in _runs(batches, vocabulary, model):
        n = len(ids)
        row, pair = run.links()
        own, times = np.unique(row << 32 | pair, return_counts=True)
        bounds = np.searchsorted(own, np.arange(n + 1) << 32)
        own &= 0xFFFFFFFF
        held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, times]), len(held)).astype(np.int64)  # far below 2^53 within a task
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_no + np.arange(n)), ids.cast(pa.int64()), pa.array(np.diff(run.a_rows)), pa.array(np.diff(run.b_rows)),
             pa.array(np.diff(run.group_rows())), pa.array(np.bincount(row, minlength=n)), pa.array(run.digests(), pa.string()),
             _list(own.astype(np.int32), bounds, pa.int32()), _list(times, bounds, pa.int64())], schema=schema)
        row_no += n
        if len(held) > HELD_PAIRS:
            yield counted(held.astype(np.int32), counts)
            held, counts = held[:0], counts[:0]
    if len(held):
        yield counted(held.astype(np.int32), counts)


def _groups(batches, vocabulary, model):
    for ids, run in _runs(batches, vocabulary, model):
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), run.groups()], ["doc_id", "groups"])


def _serve(batches, hot, n, best):
    """Sums over the hot pairs of each row; the other pairs are handed on."""
    for batch in batches:
        pairs, times = batch.column("pairs"), batch.column("times")
        offsets = np.asarray(pairs.offsets) - pairs.offsets[0].as_py()
        pair, time = np.asarray(pairs.flatten()), np.asarray(times.flatten())
        at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
        known = hot[at] == pair if len(hot) else np.zeros(len(pair), bool)

        def total(values):
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets]))

        sums = [total(np.where(known, time * x[at], 0) if len(hot) else time * 0) for x in (n, best)]
        rest = np.concatenate([[0], np.cumsum(~known)])[offsets]
        yield pa.RecordBatch.from_arrays([batch.column("row_no"), *sums, _list(pair[~known], rest, pa.int32()), _list(time[~known], rest, pa.int64())],
                                         ["row_no", "count_sum", "n_best", "pairs", "times"])


def token_groups(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """(doc_id, groups) of every row of docs(doc_id, text, ...): the groups in order, each with its byte range and both sides' ids.

    A text that is null or empty, or that one side's tokens do not join to, has no groups.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_groups, vocabulary=vocabulary, model=model), GROUPS)


def pair_counts(rows: DataFrame, pieces: int) -> DataFrame:
    """(pair, n, best): links of each id pair over the corpus, and whether no other pair of its B id has more."""
    counts = staged(rows.where("row_no is null").select(F.explode(F.arrays_zip("pairs", "times")).alias("_p"))
                    .groupBy(F.col("_p.pairs").alias("pair")).agg(F.sum("_p.times").alias("n")))
    top = counts.groupBy((F.col("pair") % pieces).alias("piece")).agg(F.max("n").alias("most"))  # a row per piece of the model
    paired = counts.join(top, counts.pair % pieces == top.piece)
    return staged(paired.select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def alignment_digests(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts the links whose pair has the most links among the pairs of its B id, ties included; count_sum adds up the pair's
    corpus-wide links over all links of the row.  A text that is null or empty, or that one side's tokens do not join to, has zeros
    and an empty digest.  Repeated rows are given each time, null ids stay, other columns are not read, an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = staged(rows.mapInArrow(partial(_digest, vocabulary=vocabulary, model=model), DIGESTS))
    pieces = SentencePieceProcessor(model_file=model).get_piece_size()
    counts = pair_counts(made, pieces)
    top = sorted(counts.orderBy(F.desc("n"), "pair").limit(HOT).collect())
    hot, n, best = (np.array([r[k] for r in top], np.int64) for k in range(3))
    own = made.where("row_no is not null")
    served = staged(own.select("row_no", "pairs", "times").mapInArrow(
        partial(_serve, hot=hot, n=n, best=best), "row_no long, count_sum long, n_best long, pairs array<int>, times array<long>"))
    rest = (served.select("row_no", F.explode(F.arrays_zip("pairs", "times")).alias("_p"))
            .select("row_no", F.col("_p.pairs").alias("pair"), F.col("_p.times").alias("times")).join(counts, "pair")
            .select("row_no", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best")))
    sums = (served.select("row_no", "count_sum", "n_best").unionByName(rest).groupBy("row_no")
            .agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best")))
    return own.join(sums, "row_no").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

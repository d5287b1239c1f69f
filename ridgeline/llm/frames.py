"""Token-id files: independent zstandard frames, a document index and a trailing seek table.

A file holds the ids of consecutive documents in ascending doc_id order as little-endian unsigned 32-bit integers, cut at FRAME_IDS
ids into frames that decompress on their own.  After them come two skippable frames: the document index (ids and lengths,
compressed) and the seek table of the zstandard seekable format, whose entries carry compressed size, decompressed size and the
low 32 bits of the XXH64 of the frame's content.  A plain zstandard decoder reads the file as one stream of ids.

Each task writes one file under a name of its own attempt; only names in the returned manifest count, so lost or repeated
attempts leave no trace in the result.
"""

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.llm.folders import opened, shared_folder
from ridgeline.llm.tokens import encoder
from ridgeline.session import staged

FRAME_IDS = 1 << 16
# fixed values of the zstandard seekable format
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_END = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80

MANIFEST = "file_no int, path string, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FrameWriter:
    """Writes one file; ids of documents are appended in order."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self.out, self.frame_ids, self.compress = out, frame_ids, zstandard.ZstdCompressor(level=3).compress
        self.waiting, self.count, self.table, self.docs, self.lengths = [], 0, [], [], []

    def append(self, doc_id, ids: np.ndarray):
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.count += len(ids)
        if self.count >= self.frame_ids:
            self._flush(False)

    def _flush(self, last):
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) - len(ids) % self.frame_ids
        for k in range(0, stop, self.frame_ids):
            raw = ids[k: min(k + self.frame_ids, stop)].astype("<u4").tobytes()
            packed = self.compress(raw)
            self.out.write(packed)
            self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.count = [ids[stop:]], len(ids) - stop

    def close(self):
        self._flush(True)
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        known = np.array([d is not None for d in self.docs], "u1")
        index = self.compress(struct.pack("<Q", len(ids)) + ids.tobytes() + np.array(self.lengths, "<i8").tobytes() + known.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries
                       + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_END))


class FrameReader:
    """Reads documents of one file; decompresses only the frames that hold them and checks each frame."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 9)
        n, flag, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_END or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table at the end of the file")
        source.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.ids_at = np.concatenate([[0], np.cumsum(self.table[:, 1] // 4)])
        source.seek(int(self.at[-1]))
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        raw = zstandard.ZstdDecompressor().decompress(source.read(size))
        n = struct.unpack_from("<Q", raw)[0]
        ids, known = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "u1", n, 8 + 16 * n)
        self.docs = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self._frame = (-1, None)

    def frame(self, k: int) -> np.ndarray:
        if self._frame[0] != k:
            self.source.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, np.frombuffer(raw, "<u4"))
        return self._frame[1]

    def document(self, j: int) -> np.ndarray:
        """Ids of the j-th document of the file."""
        start, stop = int(self.starts[j]), int(self.starts[j] + self.lengths[j])
        parts, k = [], int(np.searchsorted(self.ids_at, start, "right")) - 1
        while start < stop:
            upto = min(stop, int(self.ids_at[k + 1]))
            parts.append(self.frame(k)[start - self.ids_at[k]: upto - self.ids_at[k]])
            start, k = upto, k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _write(batches, folder, vocabulary, added):
    tokens, file_no = encoder(vocabulary, added), TaskContext.get().partitionId()
    path = f"{folder}/part-{file_no:06d}-{uuid.uuid4().hex}.zst"
    store, where = opened(path)
    writer = out = None
    total = 0
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for first, ids, ends in tokens.encode(batch.column("text")):
            if writer is None:
                store.create_dir(where.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(where, compression=None)
                writer = FrameWriter(out)
            for k in range(len(ends) - 1):
                writer.append(docs[first + k], ids[ends[k]: ends[k + 1]])
            total += len(ids)
    if writer is not None:
        writer.close()
        out.close()
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([file_no], pa.int32()), "path": [path],
                                          "n_docs": [len(writer.docs)], "n_tokens": [total]})


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, files: int | None = None, added: bool = False) -> DataFrame:
    """Write docs(doc_id, text, ...) below folder; returns the manifest (file_no, path, n_docs, n_tokens, start).

    Files follow each other in ascending doc_id; start is the number of ids in the files before.  A null text is an empty document
    (one end id), a null id comes first, rows with equal ids are ordered by text, repeated rows are written each time, other
    columns are not read, an empty table gives an empty manifest.  The default number of files is that of shuffle partitions.
    added: find the added tokens of the vocabulary in texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.repartitionByRange(*([files] if files else []), "doc_id")
    manifest = staged(dealt.sortWithinPartitions("doc_id", "text")
                      .mapInArrow(partial(_write, folder=folder, vocabulary=vocabulary, added=added), MANIFEST))
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _one_file_a_task(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()))


def _digest(batches):
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            store, where = opened(path)
            with store.open_input_file(where) as source:
                reader = FrameReader(source)
                crc = [zlib.crc32(reader.document(j).astype("<u4").tobytes()) for j in range(len(reader.docs))]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(reader.docs, pa.int64()), "start": start + reader.starts,
                                              "n_tokens": reader.lengths, "ids_crc32": pa.array(crc, pa.int64())})


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of a manifest."""
    return _one_file_a_task(manifest.select("path", "start")).mapInArrow(_digest, DIGEST)


def _pick(batches):
    for batch in batches:
        for path, wanted in zip(batch.column("path").to_pylist(), batch.column("wanted").to_pylist()):
            store, where = opened(path)
            with store.open_input_file(where) as source:
                reader, wanted = FrameReader(source), set(wanted)
                found = [j for j, d in enumerate(reader.docs) if d in wanted]
                out = {"doc_id": [reader.docs[j] for j in found], "ids": [reader.document(j) for j in found]}
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; only the frames that hold them are decompressed."""
    wanted = manifest.select("path", F.array(*[F.lit(int(d)).cast("long") for d in doc_ids]).alias("wanted"))
    return _one_file_a_task(wanted).mapInArrow(_pick, "doc_id long, ids array<long>")


def encoded(docs: DataFrame, vocabulary: str, added: bool = False) -> DataFrame:
    """Write all documents to a new shared folder and read the digests back."""
    return read_digests(write_tokens(docs, shared_folder(docs.sparkSession, "tokens"), vocabulary, added=added))

"""Token ids of whole Arrow columns through the tokenizers library.

A text is cut before every blank that a visible character follows, and between a letter and a punctuation mark other than the
apostrophe.  The vocabulary's word pattern never joins across such places, so the ids of a text are the ids of its chunks in order.  With `added`, the vocabulary's added
tokens are found in texts, as the library does by itself, and each is a chunk of its own; without, they are ordinary characters.  Each distinct chunk is encoded once per process and kept in a table of bounded size.
"""

import re
from itertools import chain

import numpy as np
from tokenizers import Tokenizer

from ridgeline.llm.words import span_hashes, text_runs

END_ID = 0
RUN = 2 << 20
TABLE_BYTES = 48 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), 0xC3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LATIN = np.zeros(256, bool)  # second bytes of letters after 0xC3
_LATIN[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True
_encoders = {}


# one word of the vocabulary's pattern (a blank or none, then Latin letters), in the bytes of UTF-8
_ONE_WORD = re.compile(" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def byte_symbols() -> dict[int, str]:
    """The symbol that byte-level BPE shows for each byte: printable bytes as they are, others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_SYMBOLS = byte_symbols()


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start, one flag per byte."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[:-2] = _BLANK[data[:-1]] & _VISIBLE[data[1:]]
        cut[offsets[1:] - 1] = False  # what follows the last byte of a row is another row
        letter = _LETTER[data[:-1]]
        letter[1:] |= (data[:-2] == 0xC3) & _LATIN[data[1:-1]]
        cut[1:-1] |= letter & _MARK[data[1:]]
    cut[offsets] = True
    return cut[:-1]


def _isolate(cut: np.ndarray, data: np.ndarray, offsets: np.ndarray, pattern: re.Pattern):
    """Make each match of the pattern within a row a chunk; a blank before it stays with the blanks before."""
    raw, at = data.tobytes(), 0
    while found := pattern.search(raw, at):
        start, end = found.span()
        k = int(np.searchsorted(offsets, start, "right"))
        if end > offsets[k]:  # goes on in the next row
            at = start + 1
            continue
        if start > offsets[k - 1] and start - 1 not in (offsets[k - 1], at):
            cut[start - 1] &= not _BLANK[data[start - 1]]
        cut[start: end] = False
        cut[start] = True
        cut[end: end + 1] = True
        at = end


class ChunkEncoder:
    """Ids of texts as the ids of their chunks in order; a subclass says where chunks start and encodes new ones.

    Each distinct chunk is encoded once and kept with its bytes, in tables that are emptied beyond TABLE_BYTES.  A chunk is looked up
    by hash and then compared byte by byte; one that shares its hash with another chunk is encoded by itself.
    """

    def __init__(self):
        self._clear()

    def _clear(self):
        self.known = np.zeros(0, np.uint64)  # hashes in order, each with its place in the arrays below
        self.slot, self.start, self.length, self.raw_start, self.raw_length = (np.zeros(0, np.int32) for _ in range(5))
        self.pool, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _held(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks start, one flag per byte; every row starts one."""
        raise NotImplementedError

    def ids_of(self, chunks: list[str]) -> list:
        """Ids of chunks, whose bytes are given as Latin-1."""
        raise NotImplementedError

    def _add(self, chunks: list[str]) -> np.ndarray:
        """Append chunks to the arrays; returns their places."""
        ids = self.ids_of(chunks)
        raw = np.frombuffer("".join(chunks).encode("latin-1"), np.uint8)
        slots = len(self.start) + np.arange(len(chunks))
        for start, length, pool, own, values in (("start", "length", "pool", ids, np.fromiter(chain.from_iterable(ids), np.uint32)),
                                                 ("raw_start", "raw_length", "raw", chunks, raw)):
            size = np.fromiter(map(len, own), np.int32, len(own))
            at = len(getattr(self, pool)) + np.cumsum(size) - size
            setattr(self, start, np.concatenate([getattr(self, start), at.astype(np.int32)]))
            setattr(self, length, np.concatenate([getattr(self, length), size]))
            setattr(self, pool, np.concatenate([getattr(self, pool), values]))
        return slots

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each chunk in the arrays."""
        unique, sample, chunk = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        text = data.tobytes().decode("latin-1")
        if new.any():
            slots = self._add([text[starts[k]: ends[k]] for k in sample[new]])
            at = np.searchsorted(self.known, unique[new])
            self.known, self.slot = np.insert(self.known, at, unique[new]), np.insert(self.slot, at, slots)
        place = self.slot[np.searchsorted(self.known, unique)][chunk]
        length = ends - starts
        odd = self.raw_length[place] != length
        like = np.repeat(self.raw_start[place] - starts, length) + np.arange(len(data))
        differs = self.raw[np.minimum(like, len(self.raw) - 1)] != data
        odd[np.searchsorted(starts, np.flatnonzero(differs), "right") - 1] = True
        if odd.any():
            place[odd] = self._add([text[starts[k]: ends[k]] for k in np.flatnonzero(odd)])
        return place

    def encode_run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a run and the offsets of the rows and the end."""
        if self._held() > TABLE_BYTES:
            self._clear()
        starts = np.flatnonzero(self.cuts(data, offsets))
        place = self._places(data, starts, np.append(starts[1:], len(data))) if len(starts) else starts
        length = self.length[place]
        before = np.cumsum(length, dtype=np.int64) - length
        ids = self.pool[np.arange(int(length.sum())) + np.repeat(self.start[place] - before, length)]
        return ids, np.append(before, len(ids))[np.searchsorted(starts, offsets)]

    def encode(self, column):
        """(first row, ids with END_ID after each row, offsets of the rows and the end) for runs of rows; null counts as empty."""
        for first, data, offsets in text_runs(column, limit=RUN):
            ids, row_ends = self.encode_run(data, offsets)
            yield first, np.insert(ids, row_ends[1:], END_ID), row_ends + np.arange(len(offsets))


class Encoder(ChunkEncoder):
    """Byte-level BPE of the tokenizers library; added: its added tokens are found in texts."""

    def __init__(self, path: str, added: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = sorted((t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, tokens))) if added and tokens else None

    def cuts(self, data, offsets):
        cut = _cuts(data, offsets)
        if self.added:
            _isolate(cut, data, offsets, self.added)
        return cut

    def ids_of(self, chunks):
        ids, other, one = [], [], self.tokenizer.model.tokenize
        for k, chunk in enumerate(chunks):
            if _ONE_WORD(chunk):  # the word pattern has nothing to cut here: straight to the library's BPE model
                ids.append([t.id for t in one(chunk.translate(_SYMBOLS))])
            else:
                ids.append(None)
                other.append(k)
        rest = [chunks[k].encode("latin-1").decode("utf-8", "replace") for k in other]
        for k, e in zip(other, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            ids[k] = e.ids
        return ids


def encoder(path: str, added: bool = False) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if (path, added) not in _encoders:
        _encoders[path, added] = Encoder(path, added)
    return _encoders[path, added]

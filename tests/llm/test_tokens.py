"""Token files round trip, packing against its definition."""

import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ridgeline.llm.folders import opened, shared_folder
from ridgeline.llm.frames import FrameReader, read_digests, read_documents, write_tokens
from ridgeline.llm.packing import packed, plan
from ridgeline.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "  a\n\n b", "x \n\ny  ", "a  b 　c", "\t\tfoo's  bar, (baz).", "<|endoftext|> a", "é è\r\n ñ×÷", "日本 語   x", "a  \n",
       "don't we'll\x0b x?!", "  \x85 a 1 ½ ²a", "word," * 3000, "résumé—naïve… x", "a'b 'c d' é'f"]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def encoded(texts):
    return [ids[ends[k]: ends[k + 1]].tolist() for _, ids, ends in Encoder(PATH).encode(pa.array(texts, pa.string()))
            for k in range(len(ends) - 1)]


def test_ids_are_those_of_the_library(tokenizer, spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert encoded(texts) == [ids_of(tokenizer, t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t.,'é×a")), max_size=30), max_size=20))
def test_ids_of_random_texts(texts):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    assert encoded(texts) == [ids_of(tokenizer, t) for t in texts]


@pytest.fixture(scope="module")
def rows():
    return [(7 * k % 41, t) for k, t in enumerate(ODD)] + [(None, "no id"), (5, "five"), (5, "five"), (900, "long text " * 40_000)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_round_trip(spark, documents, rows, tokenizer):
    manifest = write_tokens(documents(rows), shared_folder(spark, "test"), PATH, files=3)
    want, start = [], 0
    for i, t in in_order(rows):
        ids = ids_of(tokenizer, t)
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [tuple(r) for r in read_digests(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = {(r.doc_id, tuple(r.ids)) for r in read_documents(manifest, [5, 900]).collect()}
    assert some == {(i, tuple(ids_of(tokenizer, t))) for i, t in rows if i in (5, 900)}
    files = manifest.orderBy("file_no").collect()
    stream = b""
    for f in files:
        store, where = opened(f.path)
        raw = store.open_input_file(where).read()
        assert struct.unpack("<I", raw[-4:])[0] == 0x8F92EAB1
        with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as reader:
            stream += reader.read()
    assert np.frombuffer(stream, "<u4").tolist() == [x for i, t in in_order(rows) for x in ids_of(tokenizer, t)]


def test_a_damaged_frame_is_found(spark, documents, tmp_path):
    manifest = write_tokens(documents([(1, "some words " * 50)]), str(tmp_path), PATH, files=1)
    raw = bytearray(open(manifest.first().path, "rb").read())
    reader = FrameReader(pa.BufferReader(bytes(raw)))
    good = zstandard.ZstdDecompressor().decompress(bytes(raw[: reader.at[1]]))
    other = zstandard.ZstdCompressor(level=3).compress(good[:-4] + b"\1\0\0\0")
    if len(other) == reader.at[1]:
        raw[: reader.at[1]] = other
    else:
        entry = len(raw) - 9 - 12
        raw[entry + 8] ^= 1
    with pytest.raises(ValueError):
        FrameReader(pa.BufferReader(bytes(raw))).document(0)


def test_no_documents(spark, documents):
    assert read_digests(write_tokens(documents([]), shared_folder(spark, "test"), PATH)).count() == 0
    assert packed(documents([]), PATH).count() == 0


def test_packing(documents, rows, tokenizer):
    got = packed(documents(rows), PATH, 64).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        starts = [0, *range((len(ids) - 1) % 64 + 1, len(ids), 64)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 64
    assert len(places) <= -(-sum(n * k[3] for k, n in want.items()) // 64) + 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=20))
def test_plans_use_every_piece_once_and_fit(histogram):
    runs, used = plan(histogram, 32), Counter()
    for n, lengths in runs:
        assert n > 0 and sum(lengths.elements()) <= 32
        for length, k in lengths.items():
            used[length] += n * k
    assert used == histogram
    total, big = sum(k * n for k, n in histogram.items()), sum(n for k, n in histogram.items() if k > 16)
    assert sum(n for n, _ in runs) <= 1.25 * max(-(-total // 32), big) + 2


def test_exact_complements_are_found():
    assert len(plan({20: 3, 12: 3}, 32)) == 1 and sum(n for n, _ in plan({20: 3, 7: 3, 5: 3}, 32)) == 3
    assert sum(n for n, _ in plan({17: 2, 8: 2, 4: 2, 3: 2}, 32)) == 2


SPECIAL = ["a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y", " <|endoftext|> \n", "a <|endof", "text|> b",
           "tab\t \n<|endoftext|>'s", "é<|endoftext|>é", "  \n", "<|endoftext|>", "a<|endoftext|", ">", "<|ENDOFTEXT|>", "\n\n\n<|endoftext|>\n\n x",
           "a. <|endoftext|> <|endoftext|>  <|endoftext|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", "é", "'s", ".", "word"]), max_size=9).map("".join), max_size=9))
def test_added_tokens_are_those_of_the_library(texts):
    untouched = Tokenizer.from_file(PATH)
    texts = texts + SPECIAL
    got = [ids[ends[k]: ends[k + 1]].tolist() for _, ids, ends in Encoder(PATH, added=True).encode(pa.array(texts, pa.string()))
           for k in range(len(ends) - 1)]
    assert got == [ids_of(untouched, t) for t in texts]


ENDS = ["", " ", "  ", "\n", "\n\n", "\t\n", " \n \n", "a", "a\n\n", "b", "'s", ".", "é", "1  ", "\u3000", "日", "<|endoftext|>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ENDS), max_size=4).map("".join), min_size=2, max_size=12), st.randoms())
def test_ids_do_not_depend_on_the_rows_beside(texts, random):
    untouched = Tokenizer.from_file(PATH)
    encoder = Encoder(PATH, added=True)
    for _ in range(3):
        random.shuffle(texts)
        got = [ids[ends[k]: ends[k + 1]].tolist() for _, ids, ends in encoder.encode(pa.array(texts, pa.string())) for k in range(len(ends) - 1)]
        assert got == [ids_of(untouched, t) for t in texts]


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    """Thue-Morse words, which defeat polynomial hashes, and then a hash that is the same for every chunk."""
    untouched, swap = Tokenizer.from_file(PATH), str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 2048:
        word += word.translate(swap)
    texts = [word, word.translate(swap), "some words here", " some words", "here here"]
    for same in (False, True):
        if same:
            monkeypatch.setattr("ridgeline.llm.tokens.span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
        got = [ids[ends[k]: ends[k + 1]].tolist() for _, ids, ends in Encoder(PATH).encode(pa.array(texts, pa.string())) for k in range(len(ends) - 1)]
        assert got == [ids_of(untouched, t) for t in texts]


def test_tables_are_emptied(monkeypatch):
    untouched, texts = Tokenizer.from_file(PATH), [f"word{k} and  other{k}\n\n" for k in range(3000)]
    monkeypatch.setattr("ridgeline.llm.tokens.TABLE_BYTES", 20_000)
    monkeypatch.setattr("ridgeline.llm.tokens.RUN", 5_000)
    encoder = Encoder(PATH)
    got = [ids[ends[k]: ends[k + 1]].tolist() for _, ids, ends in encoder.encode(pa.array(texts)) for k in range(len(ends) - 1)]
    assert got == [ids_of(untouched, t) for t in texts] and len(encoder.known) < 1500


def test_queries_find_added_tokens(spark, tmp_path):
    from ridgeline.llm.queries import QUERIES

    untouched, texts = Tokenizer.from_file(PATH), dict(enumerate(SPECIAL))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], schema).write.parquet(f"{tmp_path}/documents.parquet")
    want = {k: (len(ids_of(untouched, t)), zlib.crc32(np.array(ids_of(untouched, t), "<u4").tobytes())) for k, t in texts.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in QUERIES["op9_token_frames"](spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: (r.length, r.ids_crc32) for r in QUERIES["op10_best_fit_packing"](spark, str(tmp_path)).collect()} == want

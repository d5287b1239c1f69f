"""Alignment of two tokenizers against a plain merge of their ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ridgeline.llm import align
from ridgeline.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["", None, " ", "  ", " " * 70, "a▁b", "▁", "日本 語", "<|endoftext|> x", "<s> </s> <unk> <0x0A>", "x\n\n  y\t", "🙂🙂", "ﬁ\x00　q ", "internationalization",
       "word " * 5000, "a" * 3000, "same text", "same text"]


@pytest.fixture(scope="module")
def plain():
    """Groups, links and token counts of a text by the libraries and one merge."""
    tokenizer, pieces = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    a_bytes, b_bytes = align.symbol_bytes(tokenizer), align.piece_bytes(pieces)

    def make(text):
        if not text:
            return [], []
        a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        whole = (" " + text).encode()
        if b"".join(a_bytes[k] for k in a) != whole or b"".join(b_bytes[k] for k in b) != whole:
            return [], []
        owner = [np.repeat(np.arange(len(ids)), [len(table[k]) for k in ids]) for ids, table in ((a, a_bytes), (b, b_bytes))]
        links = sorted(set(zip(owner[0].tolist(), owner[1].tolist())))  # tokens over the same byte
        ends = [np.cumsum([len(table[k]) for k in ids]).tolist() for ids, table in ((a, a_bytes), (b, b_bytes))]
        groups, i, j = [], 0, 0
        for cut in sorted({*ends[0]} & {*ends[1]}):
            m, n = ends[0].index(cut) + 1 if len(a) < 100 else int(np.searchsorted(ends[0], cut)) + 1, int(np.searchsorted(ends[1], cut)) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        return groups, [(a[x], b[y]) for x, y in links]
    return make


def written(groups):
    said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    return hashlib.sha256(said.encode()).hexdigest() if groups else ""


def expected(rows, plain):
    made = [(i, *plain(t)) for i, t in rows]
    counts = Counter(link for *_, links in made for link in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), written(groups)) for i, groups, links in made)


@pytest.mark.parametrize("hot", [0, 40, align.HOT])
def test_digests(documents, plain, monkeypatch, hot):
    """However many pairs are served in place, the sums are those of all links."""
    monkeypatch.setattr(align, "HOT", hot)
    rows = [*enumerate(ODD), (None, "no id"), (3, "same id, other text"), (3, "same id, other text")]
    got = align.alignment_digests(documents(rows), A, B)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == expected(rows, plain)


def test_query(spark, sf, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op13_token_alignment"](spark, sf).select(COLUMNS).collect())) == expected(rows, plain)


def test_groups(documents, plain):
    for r in align.token_groups(documents(list(enumerate(ODD))), A, B).collect():
        groups, _ = plain(ODD[r.doc_id])
        assert [(g.a, g.b) for g in r.groups] == groups
        assert [g.end for g in r.groups[:-1]] == [g.start for g in r.groups[1:]]
        if groups:
            assert (r.groups[0].start, r.groups[-1].end) == (0, len(ODD[r.doc_id].encode()) + 1)


def test_no_documents(documents):
    assert align.alignment_digests(documents([]), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "a", "foo", "é", "'s", "12", "日", "ization", "\r", "ﬁ", "<s>", "\x00"]), max_size=7).map("".join), max_size=9))
def test_rows_of_a_run(plain, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [g for out in align._groups([batch], A, B) for g in out.column("groups").to_pylist()]
    assert [[(g["a"], g["b"]) for g in own] for own in got] == [plain(t)[0] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.randoms()), max_size=4))
def test_cuts_are_all_common_ends(rows):
    """Rows of equal length on both sides, cut up at random."""
    a_ends, b_ends, bounds, at = [], [], [0], 0
    for sizes, random in rows:
        total = sum(sizes)
        a_ends += (at + np.cumsum(sizes)).tolist()
        b_ends += sorted({at + total, *(at + random.randint(1, total) for _ in range(random.randint(0, 20)))})
        at += total
        bounds.append(len(a_ends))
    cut = align.shared_cuts(np.array(a_ends, np.int64), np.array(b_ends, np.int64), np.array(bounds))
    assert [e for e, c in zip(a_ends, cut) if c] == sorted({*a_ends} & {*b_ends})

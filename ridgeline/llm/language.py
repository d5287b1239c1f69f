"""Language identification with rank-order profiles of character n-grams.

A text is read as lower-case letters, with one blank for anything between words.  Its 1- to 3-grams are ordered by frequency; the
first PROFILE of them are compared with each language's first PROFILE by out-of-place distance: the sum of rank differences, with
PROFILE for an n-gram that the language's profile lacks.  Profiles are counted over all labelled rows given for learning: partial
counts per task, summed by language and n-gram; only PROFILE rows per language leave the cluster.
"""

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.llm.words import text_runs, text_slices

PROFILE = 300
SIZES = (1, 2, 3)
UNKNOWN = "und"
_BITS = np.uint64(21)
_BLANK = np.uint64(32)
MAX_CODE = 0x110000
COUNT_BYTES, HELD_GRAMS = 1 << 20, 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of each code point that is a letter, else a blank."""
    table = np.full(MAX_CODE, 32, np.uint32)
    for c in range(MAX_CODE):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def ngrams(text: str) -> list[np.ndarray]:
    """Codes of the 1- to 3-grams of a text, one array per size; without letters, no arrays."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    blank = codes == _BLANK
    codes = codes[np.append(True, ~(blank[1:] & blank[:-1]))]
    if len(codes) < 2:
        return []
    pairs = codes[:-1] << _BITS | codes[1:]
    triples = pairs[:-1] << _BITS | codes[2:]
    return [codes[codes != _BLANK], pairs, triples]


def ranked(text: str, profile: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams of a text, in order; ties by code."""
    grams = ngrams(text)
    if not grams:
        return np.zeros(0, np.uint64)
    code, n = np.unique(np.concatenate(grams), return_counts=True)
    return code[np.argsort(-n, kind="stable")[:profile]]


def _merged(codes, counts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with the sums of their counts."""
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)


def _counted(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x for x, (code, _) in held.items() for _ in range(len(code))], pa.string()),
         pa.array(np.concatenate([code for code, _ in held.values()]).view(np.int64)),
         pa.array(np.concatenate([n for _, n in held.values()]))], ["lang", "gram", "n"])


def _count(batches):
    """Counts of a task's n-grams by language, handed on when they are many; texts are read a few at a time."""
    held = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for first, data, offsets in text_runs(batch.column("text"), limit=COUNT_BYTES):
            parts = {}
            for k, lang in enumerate(langs[first: first + len(offsets) - 1]):
                parts.setdefault(lang, []).append(data[offsets[k]: offsets[k + 1]].tobytes().decode("utf-8", "replace"))
            for lang, own in parts.items():
                grams = ngrams("\n".join(own))
                if grams:
                    code, n = np.unique(np.concatenate(grams), return_counts=True)
                    before = held.get(lang)
                    held[lang] = _merged((before[0], code), (before[1], n)) if before else (code, n)
            if sum(len(code) for code, _ in held.values()) > HELD_GRAMS:
                yield _counted(held)
                held = {}
    if held:
        yield _counted(held)


def profiles(labelled: DataFrame, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """N-grams of each language of labelled(text, lang) in rank order; rows without text or language are not used."""
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    counted = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counted.withColumn("rank", rank).where(F.col("rank") <= profile).orderBy("lang", "rank")
    out = {}
    for row in top.collect():  # at most `profile` rows per language
        out.setdefault(row["lang"], []).append(row["gram"])
    return {lang: np.array(grams, np.int64).view(np.uint64) for lang, grams in out.items()}


class Ranker:
    """Distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], profile: int = PROFILE):
        self.languages, self.profile = sorted(profiles), profile
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(1, np.uint64)]))
        self.rank = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for k, lang in enumerate(self.languages):
            self.rank[np.searchsorted(self.grams, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranked(text, self.profile)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = self.rank[np.where(self.grams[at] == own, at, len(self.grams))]
        far = np.where(rank < 0, self.profile, np.abs(rank - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(far))
        return self.languages[best], 1.0 - float(far[best]) / (self.profile * len(own))


def _predict(batches, found, profile):
    ranker = Ranker(found, profile)
    for batch in batches:
        out = [ranker.predict(t) for _, texts in text_slices(batch.column("text")) for t in texts.to_pylist()]
        keep = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "text"]
        yield pa.RecordBatch.from_arrays(
            keep + [pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())],
            [c for c in batch.schema.names if c != "text"] + ["lang_pred", "score"])


def held_out():
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, found: dict[str, np.ndarray], profile: int = PROFILE) -> DataFrame:
    """docs(text, ...) with lang_pred and score instead of text.

    score is 1 minus the distance over the largest possible distance.  A text that is null or has no letters gets `und` and 0, as
    does any text when no profile was learned; ties between languages go to the first by name.
    """
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(partial(_predict, found=found, profile=profile), f"{rest}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs(doc_id, text, lang, ...), learned from the rows not held out.

    Repeated rows and null ids are predicted like others; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = profiles(rows.where(~held_out()))
    return predict(rows.select("doc_id", held_out().alias("held_out"), "text"), found)


def with_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a recognised language with a score of at least `least`; all columns stay as they are.

    Only the text goes to Python; the other columns wait in the JVM.
    """
    found = profiles(docs.where(~held_out()).select("text", "lang"))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        ranker = Ranker(found)
        said = (ranker.predict(t) for _, part in text_slices(texts) for t in part.to_pylist())
        return pa.array([-1.0 if lang == UNKNOWN else x for lang, x in said], pa.float64())

    return docs.where(score("text") >= max(least, 0.0))

import pytest

from ridgeline.session import importable_in_tasks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def tasks(spark):
    importable_in_tasks(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of documents from (doc_id, text) pairs, with columns that clash with names inside operators."""
    def make(rows, lang="en"):
        docs = spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in rows], DOCS)
        for name in ("key", "a", "b", "bucket", "row", "base", "rank", "component", "score", "words"):
            docs = docs.withColumn(name, docs.source)
        return docs
    return make


@pytest.fixture(scope="session")
def words():
    """Different pseudo-words, the same for every run."""
    def make(n, seed=0):
        return [f"w{(seed * 7919 + k) * 2654435761 % 1000003:x}" for k in range(n)]
    return make

"""Stages of the corpus pipeline: what they keep, and the whole run."""

import corpus_pipeline
from ridgeline.llm.neardup import near_duplicates
from ridgeline.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts, kept = {r.doc_id: r.text for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = staged(stage(spark, docs, sf))
        assert docs.columns == COLUMNS and docs.schema == before.schema
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    assert len(kept["language_id"]) == len(texts)  # all have letters
    classes = {r.doc_id: r.class_id for r in near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert set(kept["near_dedup"]) == set(classes.values())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i in kept["near_dedup"] if any(t in texts[i] for t in items)}
    assert leaked and set(kept["decontamination"]) == set(kept["near_dedup"]) - leaked
    assert set(kept["pii"]) == set(kept["decontamination"])
    assert any(r.text != texts[i] for i, r in kept["pii"].items()) and all(r.n_chars == len(r.text) for r in kept["pii"].values())
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(kept["pii"]) and corpus_pipeline.ORACLE_SQL is None


def test_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (2, None, None, None, None),
            (3, "", "en", None, 0), (None, "seven eight nine ten eleven", "en", "s", 27), (4, "12 34", "en", "s", 5)]
    docs = spark.createDataFrame(rows, schema)
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf))
        counts.append(docs.count())
    assert counts == [3, 2, 2, 2, 2]
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


UNSEEN = [
    "Suomen kieli on uralilaisten kielten itämerensuomalaiseen ryhmään kuuluva kieli jota puhuvat pääosin suomalaiset",
    "Język polski jest językiem naturalnym należącym do grupy zachodniosłowiańskiej używany jest głównie w Polsce",
    "Türkçe konuşulan Türk dilleri dil ailesine ait sondan eklemeli bir dildir ve bu ailenin en çok konuşulan dilidir",
    "Bahasa Indonesia adalah bahasa Melayu yang dijadikan sebagai bahasa resmi dan bahasa persatuan bangsa",
    "Kiswahili ni lugha ya Kibantu yenye misamiati mingi ya Kiarabu inayozungumzwa katika eneo kubwa la Afrika",
    "Tiếng Việt là ngôn ngữ của người Việt và là ngôn ngữ chính thức tại Việt Nam", "Русский язык один из восточнославянских языков",
    "汉语是世界上使用人数最多的语言之一"]


def test_languages_that_no_row_teaches_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    other = spark.createDataFrame([(10**6 + k, t, None, "s", len(t)) for k, t in enumerate(UNSEEN)], schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(other), sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}

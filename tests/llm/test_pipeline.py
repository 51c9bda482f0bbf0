"""The pipeline's stages, each on its own input, and the whole run."""

import corpus_pipeline
from pulselake.llm import language_id
from pulselake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard_join", "decontamination", "pii", "mixing"]
    stage = dict(corpus_pipeline.STAGES)
    before = docs.count()
    after = stage["language_id"](spark, docs, SF)
    assert after.columns == docs.columns and after.count() == before
    one = stage["ngram_jaccard_join"](spark, docs, SF)
    assert one.columns == docs.columns and 0 < one.count() < before and one.select("text").distinct().count() == one.count()
    clean = stage["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() <= before
    hidden = stage["pii"](spark, docs, SF)
    assert hidden.columns == docs.columns and hidden.count() == before
    assert hidden.where(r"text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+\\.[a-z]'").count() == 0
    assert stage["mixing"](spark, docs, SF).count() == before


def test_run_and_registry(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "text", "lang", "source", "n_chars", "copies", "taken", "target"} <= set(out.columns)
    assert len(QUERIES) == 10 and set(ORACLES) <= set(QUERIES)


def _docs(spark, rows):
    return spark.createDataFrame([(k, t, lang, src, len(t or "")) for k, t, lang, src in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_language_stage_drops_what_it_cannot_recognise(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = _docs(spark, [(900001, None, None, "s"), (900002, "", "en", "s"), (900003, "12 34 !! 56", "en", "s"), (None, None, None, None), (900004, "Ж" * 40, None, "s"), (900005, "日本語の文字", None, "s")])
    docs = known.union(odd)
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    model = language_id.fit(docs)
    scored = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(odd, model).collect()}
    low = {k for k, (lang, score) in scored.items() if lang == "und" or score < language_id.MIN_SCORE}
    assert {900001, 900002, 900003, None} <= low
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - low
    assert kept.columns == docs.columns


def test_one_of_each_is_the_same_row_every_time(spark):
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(5, "b text", "en", "s1"), (5, "a text", "en", "s2"), (5, "a text", "de", "s0"), (5, None, "en", "s"), (None, "x", "en", "s"), (None, "x", "en", "s"), (7, long_, "en", "s"), (6, long_ + " end", "en", "s"), (8, "other", "en", "s")]
    docs = _docs(spark, rows)
    for given in (docs, docs.orderBy("source").repartition(7)):
        kept = corpus_pipeline.one_of_each(spark, given, SF)
        assert kept.columns == docs.columns
        got = sorted((str(r.doc_id), r.text, r.lang) for r in kept.collect())
        assert got == sorted([("5", "a text", "de"), ("None", "x", "en"), ("None", "x", "en"), ("6", long_ + " end", "en"), ("8", "other", "en")])


def test_contaminated_and_private_documents(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    docs = _docs(spark, [(1, item, "en", "s"), (1, "clean words only", "en", "s"), (None, item, "en", "s"), (None, "write to a@b.org", "en", "s"), (2, None, "en", "s")])
    stage = dict(corpus_pipeline.STAGES)
    clean = stage["decontamination"](spark, docs, SF).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in clean) == [("1", "clean words only"), ("2", "None"), ("None", "write to a@b.org")]
    hidden = {r.text for r in stage["pii"](spark, docs, SF).collect()}
    assert "write to [EMAIL]" in hidden and "clean words only" in hidden and None in hidden
    mixed = stage["mixing"](spark, docs, SF)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() == 5
    assert stage["mixing"](spark, docs.where("false"), SF).count() == 0

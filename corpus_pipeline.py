"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, mixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm import decontaminate, language_id, mixing, ngram_join, pii
from pulselake.session import Scratch, read_table, small_side


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_recognised(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group.

    Rows of one id are one document, of which the row with the smallest text stays (of several such
    rows the first by all columns); a row without id stays.
    """
    work = Scratch(spark, "one_of_each")
    marked = work.write(ngram_join.near_duplicate_components(docs, work), "components")
    extra = marked.where("doc_id <> component_id").select(F.col("doc_id").alias("extra_doc_id")).distinct()
    kept = docs.join(small_side(extra, extra.count()), F.col("doc_id") == F.col("extra_doc_id"), "left_anti")
    again = marked.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again_doc_id"))
    again = work.write(again, "repeated")
    if again.isEmpty():
        return kept
    again = small_side(again, again.count())
    same = F.col("doc_id") == F.col("again_doc_id")
    first = kept.join(again, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("no_text"), "text", *(c for c in docs.columns if c != "text"))).alias("first"))
    return kept.join(again, same, "left_anti").union(first.select(*(F.col(f"first.{c}").alias(c) for c in docs.columns)))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number of copies of each that the mixture takes."""
    return mixing.mix_documents(docs)


STAGES = [
    ("language_id", recognised),
    ("ngram_jaccard_join", one_of_each),
    ("decontamination", clean_of_benchmarks),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: SQL cannot express the trained first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; a stage's own tables go then."""
    work = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = [*Scratch.made]
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = work.write(docs, name)
            for own in [x for x in Scratch.made if x not in before]:
                own.clear()
    return docs

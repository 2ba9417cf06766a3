"""A corpus from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of documents; the last returns the pieces of packed sequences.

* quality rules: documents that fail the base rules or are depleted go; the others lose the
  lines that are boilerplate of their source.
* line dedup: repeated lines stay in their first document only; documents of which nothing
  but white space stays go.
* near dedup: five-word shingles, similarity 0.8; the smallest doc_id of each group stays.
* secret scan: spans are replaced by a mark.
* packing: sequences of at most 2048 tokens.

Defined cases, for every stage: a null text is an empty one and comes out as such; nulls in other
columns stay (a null source is a source of its own, a null lang changes nothing); rows with a null
doc_id pass line dedup and near dedup unchanged; rows that repeat a doc_id are one document in
quality rules and line dedup, and go or stay together in near dedup; equal rows come out equal;
ties are decided by the smallest doc_id; an empty table gives an empty table. Very long texts, and
texts of very many lines or spans, are worked on whole, in time in proportion to their length.
Columns beside those of documents are dropped, whatever their names; n_chars is counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.llm.common import ascii_strip, read, stored
from tarnwatch.llm.line_dedup import dedup_lines
from tarnwatch.llm.near_dup import near_duplicates
from tarnwatch.llm.packing import default_tokenizer, pack_documents
from tarnwatch.llm.quality import base_rules, line_frequency
from tarnwatch.llm.secrets import find_secrets, redacted

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(df: DataFrame, text) -> DataFrame:
    return df.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = line_frequency(base_rules(docs.select(*COLUMNS)))
    return _with_text(judged.filter(~F.col("base_failed") & ~F.col("depleted")), F.col("clean_text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs.select(*COLUMNS))
    return _with_text(out.filter((F.col("n_dropped") == 0) | (ascii_strip(F.col("kept_text")) != "")), F.col("kept_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_secrets(docs.select(*COLUMNS))
    return _with_text(found, redacted(F.coalesce("text", F.lit("")), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, default_tokenizer())


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("secret scan", secret_scan), ("packing", packing)]

#: SQL can't tokenise; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

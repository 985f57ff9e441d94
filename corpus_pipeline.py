"""A corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and reads it back for the next.  All but the last return the columns of
``documents``.

* ``language``: documents whose language cannot be told go (no letters, or no language that covers
  two fifths of the letters); learns from the documents that carry a language.
* ``near_duplicates``: of documents linked by five-word shingles with a similarity of 0.8 or more the
  one with the smallest ``doc_id`` stays.
* ``benchmark``: documents with a passage of ten words of a benchmark item go.
* ``personal_data``: personal data becomes ``<KIND>``; ``n_chars`` is the new length.
* ``mixture``: each document is emitted as often as its source's rate says.

Null columns, empty texts and tables, repeated rows and extra columns are treated as the operators'
modules say; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perennial.functions.storage import materialize
from perennial.llm import decontam, langid, mixing, ngram_join, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, least=0.4)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, n=5, similarity=(80, 100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.remove_contaminated(docs, items)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    length = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    return clean.select(
        *[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_copies(mixing.mixture_plan(docs), docs.columns)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: Trigram models, spans and redaction have no SQL form; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

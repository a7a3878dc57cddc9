"""A training corpus from ``documents``: five stages, each over all that its
predecessor kept and each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import language, lines, pieces, simhash, tiling
from surveyloom.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null and empty texts, and those
    without a letter. Rows stay whole, repeated ones repeated."""
    return language.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or near-equal lines one stays; n_chars, where there is one, follows the text.

    All rows stay: a null text is null still (and has the n_chars it had), an empty
    one empty, and one whose lines all go keeps its blank lines. Rows of equal
    doc_id and text are cut alike. Other columns, whatever their names, are kept.
    """
    # Working names, so that none can meet a column that the operator adds.
    named = {c: c if c in ("doc_id", "text") else f"column {k}" for k, c in enumerate(docs.columns)}
    kept = lines.dedup_lines(docs.toDF(*named.values()))
    own = lambda c: F.coalesce(F.length("text").cast(docs.schema[c].dataType), F.col(f"`{named[c]}`")) if c == "n_chars" else F.col(f"`{named[c]}`")
    return kept.select(*[own(c).alias(c) for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, that of the least doc_id
    (null before all), then text hash; of repeated rows one. Null and blank texts
    are near duplicates of one another."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go. Null and blank texts hold none, null
    items are in none, and repeated rows share their fate."""
    return tiling.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and its text decoded from them; a null or empty
    text has no ids. A row for every row."""
    return pieces.encode_decode(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: No stage can be told in SQL; tests hold each stage's rows against its own input, and
#: the two deduplications against all-pairs code on small tables with odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

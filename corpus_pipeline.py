"""The corpus pipeline: from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``; a text that a stage changes gets
a new ``n_chars``. Other columns of ``docs``, whatever their names, are ignored.

In every stage an empty table gives an empty result, null ``lang``, ``source``
and ``n_chars`` stay null, and equal rows get equal results; nothing is cut from
long texts. What a stage does with null texts, null ids and ties is stated there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import id_key, staged
from siltstone.llm.jaccard import near_copies
from siltstone.llm.lines import dedup_lines
from siltstone.llm.packing import pack_documents
from siltstone.llm.pii import find_private, sanitise
from siltstone.llm.quality import quality
from siltstone.llm.queries import trusted_ids

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(changed: DataFrame, text: Column) -> DataFrame:
    """The columns of ``documents`` from an operator's result that carried them, with a new text."""
    same = [F.col(f"carried.{c}").alias(c) for c in ("lang", "source")]
    return changed.select("doc_id", text.alias("text"), *same, F.char_length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the likelihood ratio, unchanged.

    A null, empty or short text fails the base rules. A score equal to the threshold is kept. Null ids are kept or dropped by their text.
    """
    return quality(docs, trusted_ids(spark, sf_dir), carry=COLUMNS).where("kept").select("carried.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row without the lines that an earlier document holds.

    A null text becomes the empty one. A null id counts as the smallest, so its lines stay; rows of one id are one document and keep their lines.
    """
    return _documents(dedup_lines(docs, carry=["lang", "source"]), F.col("kept_text"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more): the smallest id.

    Rows of one id are one document, kept or dropped together; a null id counts as the smallest. Texts without words, null ones too,
    are copies of each other.
    """
    groups = near_copies(docs)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key().alias("key")).distinct()
    return docs.select(*COLUMNS).join(first.hint("shuffle_hash"), id_key() == F.col("key"), "left_semi")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its personal data, and the terms that disclose it, generalised.

    A null text becomes the empty one. Of spans that overlap, the first gives the name.
    """
    return _documents(find_private(docs, carry=["lang", "source"]), sanitise(F.col("text"), F.col("spans")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, placed in windows.

    A null or empty text is one piece, the closing id; rows that repeat are placed each; null ids stay null.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("private_data", private_data),
    ("packing", packing),
]

#: The likelihood ratios, fingerprints and packing are no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

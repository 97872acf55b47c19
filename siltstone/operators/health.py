"""Health of a set of embeddings: counters, repeated vectors, suspicious inputs.

Input rows are ``ix, embedding`` (null: missing). Fingerprints are of the
32-bit little-endian bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vectors as V

SAMPLES = 5
ZERO_NORM = 2.220446049250313e-16
VARIANCE_EPSILON = 1e-12


def vector_text(embedding: Column) -> Column:
    """A canonical text of the values, from which the fingerprint is taken."""
    return F.array_join(F.transform(embedding, lambda x: x.cast("double").cast("string")), ",")


def observed(inputs: DataFrame) -> DataFrame:
    """``ix, embedding, fingerprint, missing, non_finite, l2, zero``."""
    odd = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
    rows = inputs.select("ix", "embedding", F.col("embedding").isNull().alias("missing"), F.coalesce(odd, F.lit(False)).alias("non_finite"))
    rows = rows.withColumn("fingerprint", F.when(~F.col("missing"), F.sha2(vector_text(F.col("embedding")), 256)))
    rows = rows.withColumn("l2", F.when(~F.col("missing") & ~F.col("non_finite"), V.norm(F.col("embedding"))))
    return rows.withColumn("zero", F.coalesce(F.col("l2") <= ZERO_NORM, F.lit(False)))


def fingerprint_counts(rows: DataFrame) -> DataFrame:
    return rows.where("l2 IS NOT NULL").groupBy("fingerprint").agg(F.count("*").alias("occurrences"))


def varying_dimensions(rows: DataFrame) -> DataFrame:
    """One row: ``varying_dimensions`` (variance above the tolerance) and ``max_variance``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    finite = rows.where("l2 IS NOT NULL").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    summary = finite.agg(Summarizer.metrics("variance", "count").summary(F.col("v")).alias("s"))
    n = F.col("s.count")
    population = F.transform(vector_to_array("s.variance"), lambda v: v * (n - 1) / n)
    return summary.select(F.size(F.filter(population, lambda v: v > VARIANCE_EPSILON)).cast("long").alias("varying_dimensions"), F.array_max(population).alias("max_variance"))


def health(inputs: DataFrame) -> DataFrame:
    """One row of counters over all inputs."""
    rows = observed(inputs)
    totals = rows.agg(
        F.count("*").alias("input_count"), F.count_if(~F.col("missing")).alias("available_count"), F.count_if("missing").alias("missing_count"),
        F.count_if("non_finite").alias("non_finite_count"), F.count_if("zero").alias("zero_count"),
        F.min("l2").alias("min_l2"), F.avg("l2").alias("mean_l2"), F.max("l2").alias("max_l2"),
    )
    groups = fingerprint_counts(rows).agg(
        F.count("*").alias("unique_count"), F.coalesce(F.sum(F.col("occurrences") - 1), F.lit(0)).alias("repeated_count"),
        F.count_if(F.col("occurrences") > 1).alias("repeated_groups"), F.max(F.when(F.col("occurrences") > 1, F.col("occurrences"))).alias("max_occurrence"),
    )
    return totals.crossJoin(F.broadcast(groups)).crossJoin(F.broadcast(varying_dimensions(rows)))  # one row each


def repeated_groups(inputs: DataFrame, groups: int | None = SAMPLES, samples: int = SAMPLES) -> DataFrame:
    """The most repeated fingerprints with their first inputs; the report shows ``groups`` of them, ``None`` gives all."""
    rows = observed(inputs)
    top = fingerprint_counts(rows).where("occurrences > 1")
    if groups is not None:
        top = top.orderBy(F.desc("occurrences"), "fingerprint").limit(groups)
    order = Window.partitionBy("fingerprint").orderBy("ix")
    first = rows.join(top, "fingerprint").withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)
    return first.groupBy("fingerprint", "occurrences").agg(F.array_join(F.array_sort(F.collect_list("ix")), ",").alias("sample_inputs"))


def suspicious(inputs: DataFrame, limit: int = SAMPLES) -> DataFrame:
    """The first inputs (by ``ix``) with a reason to look at them, reasons in a fixed order."""
    rows = observed(inputs)
    repeated = fingerprint_counts(rows).where("occurrences > 1").select("fingerprint", F.lit(True).alias("again"))
    marked = rows.join(repeated, "fingerprint", "left").crossJoin(F.broadcast(varying_dimensions(rows)))
    reasons = F.array_compact(F.array(
        F.when(F.col("missing"), "missing-embedding"), F.when(F.col("non_finite"), "non-finite-embedding"),
        F.when(F.col("zero"), "zero-vector"), F.when(F.col("again"), "repeated-embedding"),
    ))
    flat = F.when((F.size(reasons) == 0) & (F.col("varying_dimensions") <= 1) & F.col("l2").isNotNull(), F.array(F.lit("collapsed-variance-population"))).otherwise(reasons)
    return marked.select("ix", F.array_join(flat, ",").alias("reasons")).where("reasons <> ''").orderBy("ix").limit(limit)

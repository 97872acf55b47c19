"""Clustering telemetry as tables: what a run is blocked on, live records, pass summaries.

``statuses`` has a row per reported status: ``run_id, seq, pass_no`` (passes completed before it), ``family`` (``v2``
or ``v3``), ``phase, layer_index, state, item_count, completed_units, total_units, pending_count, pending``
(``array<struct<path, expected, observed>>``), ``partition_path, partition_size, recursion_depth, stall_reason,
stall_ms, elapsed_ms``; what a phase does not know is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Pending partitions that a record shows.
PREVIEW = 2
#: What each layered phase does, before and between the counts (fixed texts of the records).
_LAYERED = {
    "partition-load": ("loading layer ", " block(s)", ""),
    "partition-train-ingest": ("training ingest for layer ", "", " item(s)"),
    "partition-classify": ("classifying layer ", "", " item(s)"),
    "bottom-up-assembly": ("assembling layer ", " group(s)", ""),
}
#: Phases of which live records are kept.
LIVE_PHASES = ("hierarchy-planning", "terminal-materialization-load", *_LAYERED)


def _text(*parts) -> Column:
    """Parts end to end; null if a part is."""
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


def blocked_on() -> Column:
    """What a status waits for, by its phase; ``unknown`` if it does not tell."""
    phase, layer, done, total = F.col("phase"), F.col("layer_index"), F.col("completed_units"), F.col("total_units")
    partition = lambda p: F.concat(_text(p["path"], " expects ", p["expected"], " item(s)"), F.coalesce(_text(", observed ", p["observed"]), F.lit("")))
    n_listed = F.when(F.col("pending").isNotNull(), F.size("pending"))
    pass_parts = [
        _text(F.coalesce("pending_count", n_listed), " pending partition(s)"),
        F.when(n_listed > 0, _text("pending detail ", F.array_join(F.transform(F.slice("pending", 1, PREVIEW), partition), " | "))),
        F.when(n_listed > PREVIEW, _text("+", n_listed - PREVIEW, " more pending partition(s)")),
        _text("suspected stall ", F.col("stall_reason"), " for ", F.col("stall_ms"), " ms"),
    ]
    planning_parts = [_text("active partition ", F.col("partition_path")), _text("partition size ", F.col("partition_size")), _text("recursion depth ", F.col("recursion_depth"))]
    out = F.when(phase == "planning-pass", F.concat_ws("; ", *pass_parts)).when(phase == "hierarchy-planning", F.concat_ws("; ", *planning_parts))
    for name, (verb, always, counted) in _LAYERED.items():
        known = _text(verb, layer, always, counted, " ", done, " of ", total)
        out = out.when(phase == name, F.coalesce(known, _text(verb, layer, always, "; completed ", done)))
    load = _text("loading terminal materialization input(s) for layer ", layer, "; completed ", done)
    out = out.when(phase == "terminal-materialization-load", F.coalesce(_text(load, " of ", total), load))
    out = out.when(phase == "final-materialization-replay", _text("replaying final materialization item(s) ", done, " of ", total))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(UNKNOWN))


def concrete_blocked_on(statuses: DataFrame) -> DataFrame:
    """``run_id, pass_no, blocked_on``: the last text other than ``unknown`` of each pass, else ``unknown``."""
    told = statuses.select("run_id", "pass_no", "seq", blocked_on().alias("text"))
    last = F.max_by(F.when(F.col("text") != UNKNOWN, F.col("text")), F.when(F.col("text") != UNKNOWN, F.col("seq")))
    return told.groupBy("run_id", "pass_no").agg(F.coalesce(last, F.lit(UNKNOWN)).alias("blocked_on"))


def pass_summaries(passes: DataFrame, statuses: DataFrame) -> DataFrame:
    """``run_id, pass_no, verdict, evidence, blocked_on, message`` of completed passes.

    ``passes`` is ``run_id, pass_no, items, planned, terminal, depth, complete`` (whether planning ended with it). Where it also has
    ``requested_clusters, realized_clusters, quality, balance, completion_reason``, the message tells them and there is a ``record`` (JSON).
    """
    full = "quality" in passes.columns
    order = Window.partitionBy("run_id").orderBy("pass_no")
    rows = passes.withColumn("gap", F.greatest(F.col("planned") - F.col("terminal"), F.lit(0)))
    rows = rows.withColumns({f"{c}0": F.lag(c).over(order) for c in ("terminal", "gap", "pass_no")})
    moves = [_text("terminal partitions ", F.col("terminal0"), " -> ", F.col("terminal")), _text("non-terminal gap ", F.col("gap0"), " -> ", F.col("gap"))]
    better = F.concat_ws("; ", F.when(F.col("terminal") > F.col("terminal0"), moves[0]), F.when(F.col("gap") < F.col("gap0"), moves[1]))
    worse = F.concat_ws("; ", F.when(F.col("terminal") < F.col("terminal0"), moves[0]), F.when(F.col("gap") > F.col("gap0"), moves[1]))
    still = _text("terminal partitions stayed at ", F.col("terminal"), " and non-terminal gap stayed at ", F.col("gap"), " across passes ", F.col("pass_no0"), " -> ", F.col("pass_no"))
    first = F.col("pass_no0").isNull()
    verdict = F.when(F.col("complete"), "converging").when(first | ((better != "") & (worse != "")), "inconclusive").when(better != "", "converging").otherwise("not-converging")
    evidence = (
        F.when(F.col("complete"), _text("planning completion confirmed on pass ", F.col("pass_no")))
        .when(first, "first completed pass; need another completed pass before trend can be compared")
        .when((better == "") & (worse == ""), still)
        .otherwise(F.concat_ws("; ", F.nullif(better, F.lit("")), F.nullif(worse, F.lit(""))))
    )
    told = rows.withColumn("verdict", verdict).withColumn("evidence", evidence).join(concrete_blocked_on(statuses), ["run_id", "pass_no"], "left")
    clusters = F.coalesce(_text("; realized/requested clusters ", F.col("realized_clusters"), "/", F.col("requested_clusters")), F.lit("")) if full else F.lit("")
    metrics = F.format_string("; quality %.6f; balance %.6f", "quality", "balance") if full else F.lit("")
    message = F.concat(
        _text("Completed planning pass ", F.col("pass_no"), " over ", F.col("items"), " item(s); terminal partitions ", F.col("terminal"), "/", F.col("planned"), "; hierarchy depth ", F.col("depth")), clusters, metrics,
        _text("; diagnosis ", F.col("verdict"), " (", F.col("evidence"), ")"), F.coalesce(_text("; last blocked on ", F.col("blocked_on")), F.lit("")),
    )
    record = F.struct(
        F.lit("pass-summary").alias("telemetry_kind"), F.col("pass_no").alias("completed_pass_count"), F.col("items").alias("observed_item_count"),
        F.col("requested_clusters").alias("requested_planning_cluster_count"), F.col("realized_clusters").alias("realized_planning_cluster_count"),
        F.col("quality").alias("planning_quality_metric"), F.col("balance").alias("planning_balance_metric"), F.col("planned").alias("planned_partition_count"),
        F.col("terminal").alias("terminal_partition_count"), F.col("depth").alias("hierarchy_depth"), F.col("verdict").alias("convergence_verdict"), F.col("evidence").alias("convergence_evidence_summary"),
        F.col("blocked_on").alias("last_known_blocked_on_summary"), F.when(F.col("complete"), "complete").otherwise("replay-required").alias("planning_completion_state"), F.col("completion_reason").alias("planning_completion_reason"),
    ) if full else None
    return told.select("run_id", "pass_no", "verdict", "evidence", "blocked_on", message.alias("message"), *([F.to_json(record).alias("record")] if full else []))


def status_records(statuses: DataFrame) -> DataFrame:
    """``run_id, seq, kind, record``: JSON of the statuses that are recorded.

    ``intra-pass`` for unfinished planning passes of the v2 family, with the first ``PREVIEW`` pending partitions;
    ``live-status`` for the v3 family in a phase of ``LIVE_PHASES``; every other status gives none.
    """
    shared = [F.col("phase"), F.col("state"), F.col("item_count"), F.col("completed_units"), F.col("total_units"), F.col("elapsed_ms"), blocked_on().alias("blocked_on")]
    n_listed = F.when(F.col("pending").isNotNull(), F.size("pending"))
    intra = F.struct(
        F.lit("intra-pass").alias("telemetry_kind"), *shared, (F.col("pass_no") + 1).alias("pass_number"), F.coalesce("pending_count", n_listed).alias("pending_partition_count"),
        F.least(n_listed, F.lit(PREVIEW)).alias("pending_partition_preview_count"), F.slice("pending", 1, PREVIEW).alias("pending_partitions"), "stall_reason", "stall_ms",
    )
    live = F.struct(F.lit("live-status").alias("telemetry_kind"), *shared, "layer_index", "partition_path", "partition_size", "recursion_depth", (F.col("total_units") - F.col("completed_units")).alias("remaining_units"))
    wanted_intra = (F.col("family") == "v2") & (F.col("phase") == "planning-pass") & (F.col("state") != "completed")
    wanted_live = (F.col("family") == "v3") & F.col("phase").isin(*LIVE_PHASES)
    kind = F.when(wanted_intra, "intra-pass").when(wanted_live, "live-status")
    rows = statuses.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.select("run_id", "seq", "kind", F.when(F.col("kind") == "intra-pass", F.to_json(intra)).otherwise(F.to_json(live)).alias("record"))


def write_records(records: DataFrame, path: str, first: bool) -> None:
    """JSON lines, one file per task below ``path``; the first write of a run replaces what is there, others append."""
    records.select(F.col("record").alias("value")).write.mode("overwrite" if first else "append").text(path)


def failing_subset(failures: DataFrame, attempts: DataFrame) -> DataFrame:
    """``run_id, phase, provenance, item_count, input_count`` of failed statuses (``run_id, phase, item_count``).

    The subset is exact if it has as many items as the attempt (``run_id, input_count``), else the attempt is the narrowest that can be shown.
    """
    exact = F.col("item_count") == F.col("input_count")
    return failures.join(attempts, "run_id").select("run_id", "phase", F.when(exact, "exact").otherwise("narrowest-provable").alias("provenance"), "item_count", "input_count")

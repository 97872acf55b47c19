"""Workflow journals as rows: the invariants of a journal, its transitions, and its file.

A table of journals has the columns of ``JOURNAL``. Every rule is a column expression, so one pass over the table
finds all broken rules of all journals; ``first_violations`` gives the one a reader meets first. Transitions are
column updates that keep the rules' order of precedence: what is given must not be empty.
"""

from __future__ import annotations

import json
import os
import tempfile
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import trim_all

from .shared import kept
from .workflow import STAGES, rank_of

SCHEMA_VERSION = 1
#: The kinds of work, as the journal's columns name them (fixed values of the format).
KINDS = ("mailbox_admission", "chunking", "embedding", "indexing", "publication")
TERMINAL = ("terminal-success", "terminal-failure")
#: For each kind of work: the first stage at which none of it may be pending any more.
DONE_BEFORE = {"mailbox_admission": "chunk-derivation", "chunking": "embedding", "embedding": "published-root-generation"}

def stage_dimension(spark: SparkSession) -> DataFrame:
    """``stage, rank, work_kind, may_be_pending`` for every stage and kind of work (a few dozen rows)."""
    rows = []
    for stage in (*STAGES, TERMINAL[1]):
        rank = len(STAGES) - 1 if stage in TERMINAL else STAGES.index(stage)
        for kind in KINDS:
            late = kind in DONE_BEFORE and rank >= STAGES.index(DONE_BEFORE[kind]) and stage != TERMINAL[1]
            rows.append((stage, rank, kind, not late))
    return spark.createDataFrame(rows, "stage string, rank int, work_kind string, may_be_pending boolean")


_INVENTORY = "struct<pending:array<string>,completed:array<string>>"
JOURNAL = (
    "schema_version int, authority string, current_stage string, "
    "generation struct<generation_id:string,journal_id:string,started_at:string,completed_at:string>, "
    "source_snapshot struct<source_snapshot_id:string,source_uri:string,acquisition_started_at:string,acquisition_completed_at:string,corpus_manifest_identity:string,additional_provenance:map<string,string>>, "
    "effective_indexing_configuration struct<effective_indexing_configuration_id:string,chunking_policy_id:string,embedding_provider_or_model_id:string,delegated_published_root_generation_id:string,additional_root_affecting_inputs:map<string,string>>, "
    f"work struct<{','.join(f'{k}:{_INVENTORY}' for k in KINDS)}>, "
    "audit struct<work_set_id:string,work_set_frozen:boolean,published_root_id:string,published_root_recorded_at:string,root_history_entry_id:string,root_history_recorded_at:string,root_change_explanation:string>, "
    "checkpoints array<struct<stage:string,work_kind:string,item_id:string,recorded_at:string>>, "
    "subordinate_journals array<struct<authority:string,implementation:string,location:string,last_observed_generation_id:string,metadata:map<string,string>>>, "
    "terminal_outcome struct<kind:string,recorded_at:string,detail:string>"
)

_REQUIRED = (
    "generation.generation_id", "generation.journal_id", "generation.started_at", "source_snapshot.source_snapshot_id", "source_snapshot.source_uri",
    *(f"effective_indexing_configuration.{c}" for c in ("effective_indexing_configuration_id", "chunking_policy_id", "embedding_provider_or_model_id", "delegated_published_root_generation_id")),
)
_OPTIONAL = ("generation.completed_at", "source_snapshot.acquisition_started_at", "source_snapshot.acquisition_completed_at", "source_snapshot.corpus_manifest_identity")
_AUDIT = ("work_set_id", "published_root_id", "published_root_recorded_at", "root_history_entry_id", "root_history_recorded_at", "root_change_explanation")
_PAIRS = (("audit.published_root_id", "audit.published_root_recorded_at"), ("audit.root_history_entry_id", "audit.root_history_recorded_at"))


def _blank(value: Column) -> Column:
    return trim_all(value) == ""


def _empty(field: str, required: bool = False):
    """For an array's members: whether the field is blank (or missing, if it is required)."""
    return lambda x: F.coalesce(_blank(x[field]), F.lit(required))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array())


def _of_kind(kind: Column, field: str) -> Column:
    """The inventory list of a work kind that is a value (kinds in values have dashes)."""
    chosen = F.array().cast("array<string>")
    for k in KINDS:
        chosen = F.when(kind == k.replace("_", "-"), _list(f"work.{k}.{field}")).otherwise(chosen)
    return chosen


def rules() -> dict[str, Column]:
    """Each invariant's name and whether a row breaks it, in the order in which a reader checks them."""
    stage, terminal = F.col("current_stage"), F.col("current_stage").isin(*TERMINAL)
    outcome, completed_at = F.col("terminal_outcome"), F.col("generation.completed_at")
    checkpoints, subordinates = _list("checkpoints"), _list("subordinate_journals")
    out: dict[str, Column] = {
        "unsupported schema_version": F.col("schema_version") != SCHEMA_VERSION,
        "invalid workflow authority": F.col("authority") != "workflow",
    }
    for field in _REQUIRED:
        out[f"empty {field}"] = F.coalesce(_blank(F.col(field)), F.lit(True))
    for field in _OPTIONAL:
        out[f"empty {field}"] = _blank(F.col(field))
    for kind in KINDS:
        for state in ("pending", "completed"):
            out[f"empty work.{kind}.{state}"] = F.exists(_list(f"work.{kind}.{state}"), _blank)
        out[f"work.{kind} both pending and completed"] = F.arrays_overlap(_list(f"work.{kind}.pending"), _list(f"work.{kind}.completed"))
    for field in ("implementation", "location", "last_observed_generation_id"):
        out[f"empty subordinate_journal.{field}"] = F.exists(subordinates, _empty(field))
    out["invalid subordinate authority"] = F.exists(subordinates, lambda s: s["authority"] != "subordinate")
    places = F.transform(subordinates, lambda s: F.struct(s["implementation"], s["location"]))
    out["duplicate subordinate journal"] = F.size(F.array_distinct(places)) < F.size(places)
    out["missing audit.work_set_id"] = F.col("audit.work_set_frozen") & F.col("audit.work_set_id").isNull()
    for field in _AUDIT:
        out[f"empty audit.{field}"] = _blank(F.col(f"audit.{field}"))
    for left, right in _PAIRS:
        out[f"unpaired {right}"] = F.col(left).isNotNull() & F.col(right).isNull()
        out[f"unpaired {left}"] = F.col(left).isNull() & F.col(right).isNotNull()
    out["terminal checkpoint stage"] = F.exists(checkpoints, lambda c: c["stage"].isin(*TERMINAL))
    for field in ("item_id", "recorded_at"):
        out[f"empty checkpoint.{field}"] = F.exists(checkpoints, _empty(field, required=True))
    items = F.transform(checkpoints, lambda c: F.struct(c["work_kind"], c["item_id"]))
    out["duplicate checkpoint"] = F.size(F.array_distinct(items)) < F.size(items)
    out["checkpoint not completed"] = F.exists(checkpoints, lambda c: ~F.array_contains(_of_kind(c["work_kind"], "completed"), c["item_id"]))
    out["checkpoint still pending"] = F.exists(checkpoints, lambda c: F.array_contains(_of_kind(c["work_kind"], "pending"), c["item_id"]))
    out["stage precedes checkpoint"] = F.exists(checkpoints, lambda c: rank_of(stage) < rank_of(c["stage"]))
    out["missing terminal_outcome"] = terminal & outcome.isNull()
    out["outcome before the end"] = ~terminal & outcome.isNotNull()
    out["completed before the end"] = ~terminal & completed_at.isNotNull()
    out["missing generation.completed_at"] = (terminal | outcome.isNotNull()) & completed_at.isNull()
    out["empty terminal_outcome.recorded_at"] = outcome.isNotNull() & F.coalesce(_blank(F.col("terminal_outcome.recorded_at")), F.lit(True))
    out["empty terminal_outcome.detail"] = _blank(F.col("terminal_outcome.detail"))
    out["completed_at differs from the outcome"] = outcome.isNotNull() & (completed_at != F.col("terminal_outcome.recorded_at"))
    out["success with another outcome"] = (stage == "terminal-success") & (F.col("terminal_outcome.kind") != "success")
    out["failure with another outcome"] = (stage == "terminal-failure") & (F.col("terminal_outcome.kind") != "non-recoverable-failure")
    at_or_after = lambda name: (rank_of(stage) >= rank_of(F.lit(name))) & (stage != "terminal-failure")
    for kind in ("mailbox_admission", "chunking"):
        out[f"pending {kind} at a later stage"] = at_or_after(DONE_BEFORE[kind]) & (F.size(_list(f"work.{kind}.pending")) > 0)
    out["work set not frozen"] = at_or_after("published-root-generation") & ~F.coalesce(F.col("audit.work_set_frozen"), F.lit(False))
    out["pending embedding at a later stage"] = at_or_after(DONE_BEFORE["embedding"]) & (F.size(_list("work.embedding.pending")) > 0)
    out["missing audit.published_root_id"] = at_or_after("root-history-publication") & F.col("audit.published_root_id").isNull()
    out["missing audit.root_history_entry_id"] = (stage == "terminal-success") & F.col("audit.root_history_entry_id").isNull()
    return out


def broken_rules(journals: DataFrame) -> DataFrame:
    """``generation_id, rule_ix, rule``: every broken rule of every journal, from one pass over the table."""
    marks = [F.when(broken, F.struct(F.lit(i).alias("rule_ix"), F.lit(name).alias("rule"))) for i, (name, broken) in enumerate(rules().items())]
    found = F.filter(F.array(*marks), lambda x: x.isNotNull())
    return journals.select(F.col("generation.generation_id").alias("generation_id"), F.explode(found).alias("broken")).select("generation_id", "broken.*")


def first_violations(journals: DataFrame) -> DataFrame:
    """``generation_id, rule``: the first broken rule of each journal that breaks any."""
    marks = [F.when(broken, F.lit(name)) for name, broken in rules().items()]
    return journals.select(F.col("generation.generation_id").alias("generation_id"), F.coalesce(*marks).alias("rule")).where(F.col("rule").isNotNull())


# --- transitions -----------------------------------------------------------------------------------------


def _given(**values: str) -> None:
    for field, value in values.items():
        if not value or not value.strip():
            raise ValueError(f"empty {field}")


def _written(transition):
    """The table after a transition is written, so that plans do not grow with the number of transitions."""

    @wraps(transition)
    def run(journals: DataFrame, *args, **kwargs) -> DataFrame:
        return kept(transition(journals, *args, **kwargs), "journals")

    return run


def _with(journals: DataFrame, name: str, **fields) -> DataFrame:
    changed = F.col(name)
    for field, value in fields.items():
        changed = changed.withField(field, value if isinstance(value, Column) else F.lit(value))
    return journals.withColumn(name, changed)


@_written
def queue_item(journals: DataFrame, kind: str, item_id: str) -> DataFrame:
    """The item becomes pending unless it is completed."""
    _given(item_id=item_id)
    pending, completed = _list(f"work.{kind}.pending"), _list(f"work.{kind}.completed")
    queued = F.when(F.array_contains(completed, item_id), pending).otherwise(F.array_union(pending, F.array(F.lit(item_id))))
    return _with(journals, "work", **{f"{kind}.pending": queued})


@_written
def record_checkpoint(journals: DataFrame, stage: str, kind: str, item_id: str, recorded_at: str) -> DataFrame:
    """The item is completed and noted once; the stage only moves forward. Terminal stages are refused."""
    if stage in TERMINAL:
        raise ValueError("checkpoints must not record terminal stages")
    _given(item_id=item_id, recorded_at=recorded_at)
    fresh = ~F.array_contains(_list(f"work.{kind}.completed"), item_id)
    note = F.struct(F.lit(stage).alias("stage"), F.lit(kind.replace("_", "-")).alias("work_kind"), F.lit(item_id).alias("item_id"), F.lit(recorded_at).alias("recorded_at"))
    noted = journals.withColumns({
        "checkpoints": F.when(fresh, F.concat(_list("checkpoints"), F.array(note))).otherwise(_list("checkpoints")),
        "current_stage": F.when(fresh & (rank_of(F.lit(stage)) > rank_of(F.col("current_stage"))), F.lit(stage)).otherwise(F.col("current_stage")),
    })
    lists = {f"{kind}.pending": F.array_remove(_list(f"work.{kind}.pending"), item_id), f"{kind}.completed": F.array_union(_list(f"work.{kind}.completed"), F.array(F.lit(item_id)))}
    return _with(noted, "work", **lists)


@_written
def freeze_work_set(journals: DataFrame, work_set_id: str) -> DataFrame:
    _given(work_set_id=work_set_id)
    return _with(journals, "audit", work_set_id=work_set_id, work_set_frozen=True)


@_written
def record_published_root(journals: DataFrame, root_id: str, recorded_at: str) -> DataFrame:
    _given(root_id=root_id, recorded_at=recorded_at)
    return _with(journals, "audit", published_root_id=root_id, published_root_recorded_at=recorded_at)


@_written
def record_root_history(journals: DataFrame, entry_id: str, recorded_at: str) -> DataFrame:
    _given(entry_id=entry_id, recorded_at=recorded_at)
    return _with(journals, "audit", root_history_entry_id=entry_id, root_history_recorded_at=recorded_at)


@_written
def explain_root_change(journals: DataFrame, explanation: str) -> DataFrame:
    _given(explanation=explanation)
    return _with(journals, "audit", root_change_explanation=explanation)


@_written
def put_subordinate(journals: DataFrame, implementation: str, location: str, last_observed: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Adds a subordinate journal, or replaces the state of the one at the same place."""
    _given(implementation=implementation, location=location)
    if last_observed is not None:
        _given(last_observed=last_observed)
    pairs = [F.lit(x) for pair in sorted((metadata or {}).items()) for x in pair]
    state = F.struct(
        F.lit("subordinate").alias("authority"), F.lit(implementation).alias("implementation"), F.lit(location).alias("location"),
        F.lit(last_observed).cast("string").alias("last_observed_generation_id"), (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("metadata"),
    )
    here = lambda s: (s["implementation"] == implementation) & (s["location"] == location)
    have = _list("subordinate_journals")
    replaced = F.transform(have, lambda s: F.when(here(s), state).otherwise(s))
    return journals.withColumn("subordinate_journals", F.when(F.exists(have, here), replaced).otherwise(F.concat(have, F.array(state))))


@_written
def finish(journals: DataFrame, recorded_at: str, failure: str | None = None) -> DataFrame:
    """Terminal success, or with ``failure`` (its detail) terminal failure."""
    _given(recorded_at=recorded_at)
    if failure is not None:
        _given(detail=failure)
    kind = "success" if failure is None else "non-recoverable-failure"
    outcome = F.struct(F.lit(kind).alias("kind"), F.lit(recorded_at).alias("recorded_at"), F.lit(failure).cast("string").alias("detail"))
    ended = journals.withColumns({"current_stage": F.lit(TERMINAL[failure is not None]), "terminal_outcome": outcome})
    return _with(ended, "generation", completed_at=recorded_at)


# --- one journal as a file -------------------------------------------------------------------------------


def _checked(journals: DataFrame) -> DataFrame:
    wrong = first_violations(journals).first()
    if wrong:
        raise ValueError(f"workflow journal {wrong['generation_id']!r}: {wrong['rule']}")
    return journals


def new_journal(spark: SparkSession, generation: dict, source_snapshot: dict, configuration: dict, stage: str = "source-acquisition") -> DataFrame:
    """One valid journal without work."""
    state = {
        "schema_version": SCHEMA_VERSION, "authority": "workflow", "current_stage": stage, "generation": generation, "source_snapshot": source_snapshot,
        "effective_indexing_configuration": configuration, "work": {k: {"pending": [], "completed": []} for k in KINDS}, "audit": {"work_set_frozen": False}, "checkpoints": [], "subordinate_journals": [],
    }
    return _checked(journal_of(spark, state))


def journal_of(spark: SparkSession, *states: dict) -> DataFrame:
    """Journals from documents (absent fields are null)."""
    return spark.createDataFrame(list(states), JOURNAL)


def save_journal(journal: DataFrame, path: str) -> None:
    """Validate, write aside, flush, put in place, flush the folder (driver side: one document)."""
    (row,) = _checked(journal).select(F.to_json(F.struct(*journal.columns)).alias("doc")).collect()
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, aside = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(row["doc"])
        f.flush()
        os.fsync(f.fileno())
    os.replace(aside, path)
    place = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(place)
    finally:
        os.close(place)


def load_journal(spark: SparkSession, path: str) -> DataFrame | None:
    """The valid journal of a file; none if there is no file."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return _checked(journal_of(spark, json.load(f)))

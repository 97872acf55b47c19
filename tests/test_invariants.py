"""Every rejected state of a workflow journal, and its transitions."""

import copy

import pytest

from siltstone.operators import invariants as I

AT = "2026-01-01T00:00:00Z"
BASE = {
    "schema_version": 1, "authority": "workflow", "current_stage": "source-acquisition",
    "generation": {"generation_id": "g", "journal_id": "j", "started_at": AT}, "source_snapshot": {"source_snapshot_id": "s", "source_uri": "u"},
    "effective_indexing_configuration": {"effective_indexing_configuration_id": "e", "chunking_policy_id": "c", "embedding_provider_or_model_id": "m", "delegated_published_root_generation_id": "d"},
    "work": {k: {"pending": [], "completed": []} for k in I.KINDS}, "audit": {"work_set_frozen": False}, "checkpoints": [], "subordinate_journals": [],
}
CHECKPOINT = {"stage": "mailbox-admission", "work_kind": "chunking", "item_id": "x", "recorded_at": AT}
BELOW = {"authority": "subordinate", "implementation": "i", "location": "l"}
DONE = {"terminal_outcome": {"kind": "success", "recorded_at": AT}, "generation.completed_at": AT, "current_stage": "terminal-success"}
PUBLISHED = {"audit.work_set_id": "w", "audit.work_set_frozen": True, "audit.published_root_id": "r", "audit.published_root_recorded_at": AT, "audit.root_history_entry_id": "h", "audit.root_history_recorded_at": AT}


def state(**changes):
    out = copy.deepcopy(BASE)
    for path, value in changes.items():
        *above, last = path.split(".")
        at = out
        for key in above:
            at = at[key]
        at[last] = value
    return out


REJECTED = [
    ("unsupported schema_version", {"schema_version": 2}), ("invalid workflow authority", {"authority": "subordinate"}),
    *((f"empty {f}", {f: "  "}) for f in (*I._REQUIRED, *I._OPTIONAL)),
    *((f"empty work.{k}.{s}", {f"work.{k}.{s}": [" "]}) for k in I.KINDS for s in ("pending", "completed")),
    *((f"work.{k} both pending and completed", {f"work.{k}.pending": ["a"], f"work.{k}.completed": ["a"]}) for k in I.KINDS),
    *((f"empty subordinate_journal.{f}", {"subordinate_journals": [BELOW | {f: ""}]}) for f in ("implementation", "location", "last_observed_generation_id")),
    ("invalid subordinate authority", {"subordinate_journals": [BELOW | {"authority": "workflow"}]}), ("duplicate subordinate journal", {"subordinate_journals": [BELOW, BELOW]}),
    ("missing audit.work_set_id", {"audit.work_set_frozen": True}), *((f"empty audit.{f}", {f"audit.{f}": " "}) for f in ("work_set_id", "root_change_explanation")),
    *((f"empty {f}", {f: " ", other: AT}) for pair in I._PAIRS for f, other in (pair, pair[::-1])), *((f"unpaired {b}", {a: "x"}) for pair in I._PAIRS for a, b in (pair, pair[::-1])),
    ("terminal checkpoint stage", {"checkpoints": [CHECKPOINT | {"stage": "terminal-success"}]}), *((f"empty checkpoint.{f}", {"checkpoints": [CHECKPOINT | {f: ""}]}) for f in ("item_id", "recorded_at")),
    ("duplicate checkpoint", {"checkpoints": [CHECKPOINT, CHECKPOINT], "work.chunking.completed": ["x"]}), ("checkpoint not completed", {"checkpoints": [CHECKPOINT]}),
    ("work.chunking both pending and completed", {"checkpoints": [CHECKPOINT], "work.chunking.completed": ["x"], "work.chunking.pending": ["x"]}),
    ("stage precedes checkpoint", {"checkpoints": [CHECKPOINT], "work.chunking.completed": ["x"]}),
    ("missing terminal_outcome", {"current_stage": "terminal-failure"}), ("outcome before the end", {"terminal_outcome": DONE["terminal_outcome"]}), ("completed before the end", {"generation.completed_at": AT}),
    ("missing generation.completed_at", PUBLISHED | DONE | {"generation.completed_at": None}), ("empty terminal_outcome.recorded_at", PUBLISHED | DONE | {"terminal_outcome": {"kind": "success", "recorded_at": " "}}),
    ("empty terminal_outcome.detail", PUBLISHED | DONE | {"terminal_outcome": {"kind": "success", "recorded_at": AT, "detail": " "}}), ("completed_at differs from the outcome", PUBLISHED | DONE | {"generation.completed_at": "later"}),
    ("success with another outcome", PUBLISHED | DONE | {"terminal_outcome": {"kind": "non-recoverable-failure", "recorded_at": AT}}), ("failure with another outcome", DONE | {"current_stage": "terminal-failure"}),
    ("pending mailbox_admission at a later stage", {"current_stage": "chunk-derivation", "work.mailbox_admission.pending": ["a"]}), ("pending chunking at a later stage", {"current_stage": "embedding", "work.chunking.pending": ["a"]}),
    ("work set not frozen", {"current_stage": "published-root-generation"}), ("pending embedding at a later stage", PUBLISHED | {"current_stage": "published-root-generation", "work.embedding.pending": ["a"]}),
    ("missing audit.published_root_id", {"current_stage": "root-history-publication", "audit.work_set_id": "w", "audit.work_set_frozen": True}),
    ("missing audit.root_history_entry_id", PUBLISHED | DONE | {"audit.root_history_entry_id": None, "audit.root_history_recorded_at": None}),
]
ACCEPTED = [
    {}, {"current_stage": "mailbox-admission", "work.mailbox_admission.pending": ["a"]}, PUBLISHED | DONE, {"current_stage": "embedding", "work.embedding.pending": ["a"], "work.indexing.pending": ["b"]},
    {"current_stage": "terminal-failure", "generation.completed_at": AT, "terminal_outcome": {"kind": "non-recoverable-failure", "recorded_at": AT, "detail": "no"}, "work.chunking.pending": ["left"]},
    {"current_stage": "mailbox-admission", "checkpoints": [CHECKPOINT], "work.chunking.completed": ["x"]}, PUBLISHED | DONE | {"work.publication.pending": ["p"]},
]


def test_each_rejected_state_and_no_accepted_one(spark):
    cases = [(name, state(**changes)) for name, changes in REJECTED] + [(None, state(**changes)) for changes in ACCEPTED]
    docs = [s | {"generation": s["generation"] | {"generation_id": s["generation"]["generation_id"] if not s["generation"]["generation_id"].strip() else f"g{i}"}} for i, (_, s) in enumerate(cases)]
    journals = I.journal_of(spark, *docs)
    first = {r.generation_id: r.rule for r in I.first_violations(journals).collect()}
    for (name, _), doc in zip(cases, docs):
        assert first.get(doc["generation"]["generation_id"]) == name
    every = {(r.generation_id, r.rule) for r in I.broken_rules(journals).collect()}
    assert set(first.items()) <= every and {n for n, _ in REJECTED} <= {rule for _, rule in every} and len(I.rules()) == len({n for n, _ in REJECTED} | {"checkpoint still pending"})


def test_transitions_and_file(spark, tmp_path):
    j = I.new_journal(spark, BASE["generation"], BASE["source_snapshot"], BASE["effective_indexing_configuration"])
    j = I.queue_item(I.queue_item(j, "chunking", "a"), "chunking", "b")
    j = I.record_checkpoint(I.record_checkpoint(j, "chunk-derivation", "chunking", "a", AT), "embedding", "chunking", "a", AT)  # the second is a no-op
    j = I.queue_item(j, "chunking", "a")
    j = I.put_subordinate(I.put_subordinate(j, "i", "l"), "i", "l", "g0", {"k": "v"})
    row = j.first()
    assert (row.work.chunking.pending, row.work.chunking.completed, row.current_stage, len(row.checkpoints)) == (["b"], ["a"], "chunk-derivation", 1)
    assert [(s.last_observed_generation_id, s.metadata) for s in row.subordinate_journals] == [("g0", {"k": "v"})]
    with pytest.raises(ValueError, match="terminal"):
        I.record_checkpoint(j, "terminal-success", "chunking", "b", AT)
    with pytest.raises(ValueError, match="empty"):
        I.queue_item(j, "chunking", " ")
    j = I.record_checkpoint(j, "embedding", "chunking", "b", AT)
    j = I.explain_root_change(I.record_root_history(I.record_published_root(I.freeze_work_set(j, "w"), "r", AT), "h", AT), "new mail")
    path = str(tmp_path / "deep" / "journal.json")
    assert I.load_journal(spark, path) is None
    I.save_journal(I.finish(j, AT), path)
    back = I.load_journal(spark, path).first()
    assert (back.current_stage, back.terminal_outcome.kind, back.generation.completed_at, back.audit.work_set_frozen) == ("terminal-success", "success", AT, True)
    with pytest.raises(ValueError, match="pending"):
        I.save_journal(I.queue_item(I.finish(j, AT), "embedding", "late"), path)
    assert I.finish(j, AT, "disk lost").first().terminal_outcome.detail == "disk lost"

"""Reply trees and formatted conversations against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from siltstone.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth string"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def test_round_trip_of_awkward_turns(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n### user\nx", "\\l \\h \\n \\\\", "", None, "a\n\nb", "#<\\" * 50, "long " * 5000, "é😀"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(hard)] + [(2, 5, None, "x"), (2, 1, "we\nird: #role", "y"), (None, 0, "user", "z"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    out = chat.format_paths(chat.best_paths(chat.chain(_turns(spark, rows)))).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_mask"))).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in out}
    want = {}
    for c in (1, 2, None, 3):
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        want[c] = (turns, "".join(t for r, t in turns if r == "assistant"))
    assert got == want


def test_paths_are_ranked_by_score(spark):
    rng = random.Random(2)
    rows, parent, score = [], {}, {}
    for conv in range(4):
        for node in range(40):
            p = rng.randrange(node) if node and rng.random() < 0.95 else (None if node == 0 else 999)
            parent[conv, node], score[conv, node] = p, rng.random()
            rows.append((conv, node, p, "user", f"t{node}", score[conv, node]))
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")

    def path(conv, node):
        out = [node]
        while parent[conv, node] in range(40):
            node = parent[conv, node]
            out.append(node)
        return out[::-1]

    for k in (1, 3, None):
        got = {}
        for r in chat.best_paths(df, k).collect():
            got.setdefault((r.conv_id, r.branch), []).append((r.depth, r.text))
        want = {}
        for conv in range(4):
            leaves = [n for n in range(40) if n not in {parent[conv, m] for m in range(40)}]
            ranked = sorted(leaves, key=lambda n: (-round(sum(score[conv, m] for m in path(conv, n)), 12), n))
            for b, n in enumerate(ranked[:k], 1):
                want[conv, b] = [(d, f"t{m}") for d, m in enumerate(path(conv, n), 1)]
        assert {x: sorted(v) for x, v in got.items()} == want


def test_cycles_and_empty_tables(spark):
    loop = spark.createDataFrame([(1, 1, 2, "u", "a", 1.0), (1, 2, 1, "u", "b", 1.0), (1, 3, None, "u", "c", 1.0)], "conv_id long, node long, parent long, role string, text string, score double")
    assert [r.text for r in chat.best_paths(loop, None).collect()] == ["c"]
    assert chat.format_paths(chat.best_paths(chat.chain(_turns(spark, [])))).count() == 0


def test_query_has_the_hard_conversation(spark):
    row = queries.op5_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = queries.HARD_TURN
    assert text == "\\### Assistant: </turn> ok"
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())

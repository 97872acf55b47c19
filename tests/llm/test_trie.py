"""The prefix trie against plain Python, with every prefix spelled out."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import queries, trie
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, depth string, len string, k1 string, conv string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _turns(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA).repartition(5)


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    plain = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in plain}
    return {c: plain.get(c - int(math.fmod(c, 100)), [])[: h[c]] + v[h[c] :] for c, v in plain.items()}


def brute(convs):
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        saved[p] = (len(members[p]) - 1) * len(p[-1][1]) * bool(p) + sum(saved[q] for q in children[p]) if p else sum(saved[q] for q in children[p])
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def random_rows(seed, n_convs=60):
    rng = random.Random(seed)
    says = [("user", "a"), ("user", "bb"), ("assistant", "é😀"), (None, None), ("", ""), ("user", "")]
    rows = []
    for c in [*range(-3, n_convs), -100, -101, 100, 150, 199, 10**12]:
        for t in range(rng.randint(1, 8)):
            rows.append((c, rng.choice([t, t, None, 2]), *rng.choice(says)))
    long = [(500, t, "user", f"x{t % 7}") for t in range(400)]
    rows += long + [(550, *r[1:]) for r in long] + [(577, *r[1:]) for r in long[:300]] + [(None, 0, "user", "lost"), (None, None, None, None)] + rows[:10]
    return rows


def _nodes(spark, rows, **options):
    return sorted((tuple(r[c] for c in NAMES) for r in trie.prefix_trie(*trie.share_heads(trie.ordered_turns(_turns(spark, rows))), **options).collect()), key=str)


def test_nodes(spark):
    rows = random_rows(1)
    assert _nodes(spark, rows) == brute(rebuilt(rows))


def test_a_full_sketch_proves_nothing_and_changes_nothing(spark):
    rows = random_rows(2, 20)
    assert _nodes(spark, rows, max_counters=2) == brute(rebuilt(rows))


def test_copies_of_one_conversation_and_conversations_without_turns(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)]
    out = brute(rebuilt(rows))
    assert any(r[1] == 0 and r[3] == 300 for r in out)
    assert _nodes(spark, rows) == out
    lone = [(7, 0, "user", "x"), (8, 0, "user", "x")]  # no conversation 0 to take a head from
    assert _nodes(spark, lone) == brute(rebuilt(lone))
    assert _nodes(spark, []) == []


def test_an_estimate_is_never_below_the_count(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**62), 2**62, (500, 2))
    n = rng.integers(1, 4, 500)
    rows = [(i, 1, int(a), int(b)) for i, (a, b) in enumerate(np.repeat(keys, n, axis=0))]
    prefixes = spark.createDataFrame(rows, "conv long, depth long, k1 long, k2 long").repartition(4)
    for bound, least in ((trie.MAX_COUNTERS, 0.9), (64, 0.0)):
        out = trie.screened(prefixes, bound).groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("maybe").alias("maybe")).collect()
        assert all(r.maybe for r in out if r.n > 1)
        assert np.mean([not r.maybe for r in out if r.n == 1]) >= least


def test_running_values_cross_partitions(spark):
    df = spark.createDataFrame([(i % 3 if i < 30 else 9, i, i * i) for i in range(500)], "g long, i long, x long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.g, r.i): r.run_x for r in trie.running(df, "g", ["i"], {"x": "sum"}, "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want, total = {}, defaultdict(int)
    for i in range(500):
        g = i % 3 if i < 30 else 9
        total[g] += i * i
        want[g, i] = total[g]
    assert got == want


def test_matches_sql(spark):
    compare(spark, queries.QUERIES["op11_prefix_trie"], queries.ORACLE["op11_prefix_trie"], "/root/testdata/sf0.001")

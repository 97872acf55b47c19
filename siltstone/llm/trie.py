"""Prefix trie of conversations: count-min screening, then exact grouping of what may be shared.

1. Turns are put in order and numbered; each becomes 128 bits and a length
   (:func:`ordered_turns`). Texts cross the network only where turns tie.
2. A prefix's digest is the running xor of its turns' hashes, each mixed with
   its depth. Running values come from range partitions and one row per
   partition, so a conversation of any length is spread over tasks.
3. A count-min sketch of two-bit counters takes every prefix digest. An
   estimate of one proves that a prefix has one conversation: the estimate is
   never below the count. Such nodes, the tails, are emitted where they stand.
   The sketch grows with the input up to ``MAX_COUNTERS`` (32 MB, the only
   thing broadcast); beyond that fewer prefixes are proven and more take the
   exact way, with the same result.
4. Possibly shared prefixes are grouped by digest, with map-side aggregation.
   What a node sums over its subtree is a sum over its members: a node is
   owned by its smallest member, a member owns all its nodes from some depth
   on, and so it brings each of its prefixes the nodes that it owns below. No
   step runs once per level, and no group of conversations is collected.

Edge cases: null roles and texts are empty; a null turn comes first; rows that
share a turn are ordered by role, then text, and repeated rows are repeated
turns; rows without a ``conv_id`` belong to no conversation and are left out;
other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, staged

#: Rows of the count-min sketch, and two-bit counters over all of them at most.
ROWS, MAX_COUNTERS = 2, 1 << 27
_SLICE = 1 << 20
_CHUNK = 1 << 16
_ID = ["k1", "k2"]


# --- running values in groups of any size -----------------------------------------------------------------


def _runs(group: np.ndarray) -> np.ndarray:
    """Index of the first row of the run that each row belongs to."""
    first = np.r_[True, group[1:] != group[:-1]]
    return np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))


def running(df: DataFrame, group: str, order: list[str], value: dict[str, str], name: str) -> DataFrame:
    """``df``, written, with ``run_<column>``: the running ``xor`` or ``sum`` of each column of ``value`` in ``order`` inside ``group``.

    Rows are range-partitioned by group and order. Only the first group of a partition can go on from the one before, so one row per
    partition carries what came earlier.
    """
    ops = {"xor": np.bitwise_xor, "sum": np.add}
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + ["part int"] + [f"run_{c} long" for c in value]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, carry = None, dict.fromkeys(value, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group).to_numpy(zero_copy_only=False)
            start = _runs(keys)
            goes_on = (keys == last) & (start == 0)
            added = []
            for c, op in value.items():
                x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                total = ops[op].accumulate(x)
                before = np.where(start > 0, total[start - 1], 0)
                run = total ^ before if op == "xor" else total - before
                run = np.where(goes_on, run ^ carry[c] if op == "xor" else run + carry[c], run)
                added.append(pa.array(run))
                carry[c] = int(run[-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *added], names=[*batch.schema.names, "part", *(f"run_{c}" for c in value)])

    placed = staged(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).mapInArrow(local, ", ".join(schema)), name)
    at = F.struct(group, *order)
    ends = placed.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("last"), *(F.max_by(f"run_{c}", at).alias(c) for c in value))
    starts, held, before = [], None, dict.fromkeys(value, 0)
    for row in sorted(ends.collect(), key=lambda r: r["part"]):  # a row per partition
        own = {c: row[c] for c in value}
        if held is not None and row["first"] == held:
            starts.append((row["part"], held, *before.values()))
            if row["last"] == held:
                own = {c: own[c] ^ before[c] if op == "xor" else own[c] + before[c] for c, op in value.items()}
        held, before = row["last"], own
    offsets = df.sparkSession.createDataFrame(starts, f"part int, `{group}` long, " + ", ".join(f"from_{c} long" for c in value))
    joined = placed.join(F.broadcast(offsets), ["part", group], "left")

    def whole(c: str, op: str) -> Column:
        run, earlier = F.col(f"run_{c}"), F.coalesce(F.col(f"from_{c}"), F.lit(0).cast("long"))
        return (run.bitwiseXOR(earlier) if op == "xor" else run + earlier).alias(f"run_{c}")

    return joined.select(*df.columns, *(whole(c, op) for c, op in value.items()))


# --- turns in order ---------------------------------------------------------------------------------------


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv, ix, t1, t2, n_chars``, written: turn ``ix`` (from 0) of each conversation as a hash of role and text, and its code points."""
    clean = turns.select(
        turns["conv_id"].cast("long").alias("conv"), turns["turn"].cast("long").alias("turn"),
        F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    ties = clean.groupBy("conv", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.lit(True).alias("tied"))
    known = clean.join(ties, (F.col("conv") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t")), "left")
    hashed = known.select(
        "conv", "turn", F.when(F.col("tied"), F.struct("role", "text")).alias("tie"), F.monotonically_increasing_id().alias("row"),
        F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.char_length("text").cast("long").alias("n_chars"), F.lit(1).cast("long").alias("one"),
    )
    return running(hashed, "conv", ["turn", "tie", "row"], {"one": "sum"}, "trie-turns").select("conv", (F.col("run_one") - 1).alias("ix"), "t1", "t2", "n_chars")


def share_heads(ordered: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first h turns come from conversation ``c - c % every``, h being crc32(decimal c) % ``most``.

    Returns ``conv, len`` of all conversations, turnless ones too, and ``conv, depth, len, t1, t2, n_chars`` of their turns.
    """
    heads = ordered.where(F.col("ix") < most - 1).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("ix", "t1", "t2", "n_chars"))).alias("head"))
    own = ordered.groupBy("conv").agg(F.count("*").alias("n_own"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    based = own.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<ix:long,t1:long,t2:long,n_chars:long>>")), F.lit(1), F.col("h"))
    convs = staged(based.withColumn("head", head).select("conv", "h", "head", (F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("len")), "trie-convs")
    borrowed = convs.select("conv", "len", F.explode("head").alias("x")).select("conv", (F.col("x.ix") + 1).alias("depth"), "len", "x.t1", "x.t2", "x.n_chars")
    rest = ordered.join(convs.select("conv", "h", F.size("head").alias("m"), "len"), "conv").where("ix >= h")
    rest = rest.select("conv", (F.col("ix") - F.col("h") + F.col("m") + 1).cast("long").alias("depth"), "len", "t1", "t2", "n_chars")
    return convs.select("conv", "len"), borrowed.unionByName(rest)


# --- the sketch -------------------------------------------------------------------------------------------


def _slots(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """Counter of each prefix in each row of the sketch."""
    k1, k2 = (batch.column(c).to_numpy().view(np.uint64) for c in _ID)
    return [(mix(k1 + np.uint64(j) * k2) & np.uint64(width - 1)).astype(np.int64) + j * width for j in range(ROWS)]


def _sketch(prefixes: DataFrame, width: int) -> np.ndarray:
    """Two-bit counters (0, 1, more), four to a byte: tasks send the counters that they touched, slices are merged one at a time."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, n = np.unique(np.concatenate(_slots(batch, width)), return_counts=True)
            cuts = np.flatnonzero(np.r_[True, slots[1:] // _SLICE != slots[:-1] // _SLICE, True]) if len(slots) else np.zeros(1, np.int64)
            parts = [(int(slots[a] // _SLICE), (slots[a:b] % _SLICE).astype(np.int32).tobytes(), np.minimum(n[a:b], 2).astype(np.uint8).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = list(zip(*parts)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["slice", "slots", "n"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counters = None, None

        def done() -> pa.RecordBatch:
            four = counters.reshape(-1, 4)
            packed = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([packed.tobytes()], pa.binary())], names=["slice", "packed"])

        for batch in batches:
            for number, slots, n in zip(*(batch.column(c) for c in ("slice", "slots", "n"))):
                if number.as_py() != held:
                    if held is not None:
                        yield done()
                    held, counters = number.as_py(), np.zeros(_SLICE, np.uint8)
                at = np.frombuffer(slots.as_buffer(), np.int32)
                counters[at] = np.minimum(counters[at] + np.frombuffer(n.as_buffer(), np.uint8), 2)
        if held is not None:
            yield done()

    partial = prefixes.select(*_ID).mapInArrow(touched, "slice int, slots binary, n binary")
    slices = partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(merged, "slice int, packed binary")
    out = np.zeros(max(ROWS * width, _SLICE) // 4, np.uint8)
    for row in slices.toLocalIterator():  # at most MAX_COUNTERS / 4 bytes over all rows
        out[row["slice"] * _SLICE // 4 : (row["slice"] + 1) * _SLICE // 4] = np.frombuffer(row["packed"], np.uint8)
    return out


def screened(prefixes: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """``prefixes`` with ``maybe`` (false: proven to have one conversation) and ``after`` (the prefix before it is proven too, and stood before it)."""
    n = prefixes.count()
    width = min(1 << max(10, (8 * n).bit_length()), max_counters // ROWS)
    shared = prefixes.sparkSession.sparkContext.broadcast(_sketch(prefixes, width))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = shared.value
        conv_before, depth_before, proven_before = None, -1, False
        for batch in batches:
            if not batch.num_rows:
                continue
            estimate = np.minimum.reduce([packed[s >> 2] >> ((s & 3) << 1).astype(np.uint8) & 3 for s in _slots(batch, width)])
            maybe = estimate > 1
            conv, depth = (batch.column(c).to_numpy() for c in ("conv", "depth"))
            after = np.r_[False, (conv[1:] == conv[:-1]) & (depth[1:] == depth[:-1] + 1) & ~maybe[:-1]]
            after[0] = conv[0] == conv_before and depth[0] == depth_before + 1 and proven_before
            conv_before, depth_before, proven_before = conv[-1], depth[-1], not maybe[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe), pa.array(after)], names=[*batch.schema.names, "maybe", "after"])

    return staged(prefixes.mapInArrow(screen, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema) + ", maybe boolean, after boolean"), "trie-screened")


# --- nodes ------------------------------------------------------------------------------------------------


def _digest_lists(members: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of ``k1, k2, conv``: ids ascending, comma-joined. Pieces of a list are joined by tasks, then streamed through one hash."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held, size = [], None, 0
            for k1, k2, conv in zip(*(batch.column(c).to_pylist() for c in (*_ID, "conv"))):
                if (k1, k2) != held or size > _CHUNK:
                    rows.append((k1, k2, conv, []))
                    held, size = (k1, k2), 0
                rows[-1][3].append(str(conv))
                size += len(rows[-1][3][-1]) + 1
            yield pa.RecordBatch.from_pylist([{"k1": a, "k2": b, "first": c, "ids": ",".join(x)} for a, b, c, x in rows], schema=pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, hashlib.sha256()
        kind = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*_ID, "ids"))):
                if (k1, k2) == held:
                    state.update(b"," + ids.encode())
                    continue
                if held:
                    out.append(dict(zip(kind.names, (*held, state.hexdigest()))))
                held, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=kind)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, (*held, state.hexdigest())))], schema=kind)

    joined = members.repartitionByRange(*_ID, "conv").sortWithinPartitions(*_ID, "conv").mapInArrow(pieces, "k1 long, k2 long, first long, ids string")
    return joined.repartition(*_ID).sortWithinPartitions(*_ID, "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def _prefixes(turns: DataFrame) -> DataFrame:
    """``conv, depth, len, n_chars`` with the digests of the prefix (``k1, k2``) and of the prefix before it (``p1, p2``), written in order."""
    tagged = turns.select("conv", "depth", "len", "n_chars", F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64(F.lit(3), "depth", "t2", "t1").alias("x2"))
    ran = running(tagged, "conv", ["depth"], {"x1": "xor", "x2": "xor"}, "trie-prefixes")
    before = [F.col(f"run_x{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)]
    return ran.select("conv", "depth", "len", "n_chars", F.col("run_x1").alias("k1"), F.col("run_x2").alias("k2"), *before)


def prefix_trie(convs: DataFrame, turns: DataFrame, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """The trie's nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``convs``: ``conv, len``, one row each; ``turns``: ``conv, depth, len, t1, t2, n_chars``, depths 1 to ``len``.
    """
    zero, nothing = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    rows = screened(_prefixes(turns), max_counters)
    maybe, proven = rows.where("maybe"), rows.where("NOT maybe")
    last = F.col("depth") == F.col("len")
    groups = staged(
        maybe.groupBy(*_ID).agg(
            F.min("conv").alias("owner"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.sum(last.cast("long")).alias("n_ends"),
            F.min("n_chars").alias("n_chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        ).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")), "trie-groups",
    )
    # What a conversation owns: its nodes from depth ``since`` on, and perhaps the leaf where it ends.
    shared = groups.groupBy(F.col("owner").alias("conv")).agg(F.min("depth").alias("since"), F.sum("saved").alias("total"), F.max(F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    alone = proven.groupBy("conv").agg(F.min("depth").alias("since"), F.lit(0).cast("long").alias("total"), F.max(last).alias("leaf"))
    owners = staged(shared.unionByName(alone).groupBy("conv").agg(F.min("since").alias("since"), F.sum("total").alias("total"), F.max("leaf").cast("long").alias("leaf")), "trie-owners")

    top = convs.agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"))
    first = top.first()["owner"]
    brought = maybe.join(owners, "conv", "left").select(
        *_ID, ((F.col("depth") + 1 >= F.col("since")) & ~last).cast("long").alias("child"), "leaf", F.when(F.col("depth") < F.col("since"), F.col("total")).alias("below"),
    )
    sums = brought.groupBy(*_ID).agg(*(F.coalesce(F.sum(c), zero).alias(c) for c in ("child", "leaf", "below")))
    # A node's owner adds what it owns from here on: its total without what stands above.
    path = running(groups.select("owner", "depth", *_ID, "saved"), "owner", ["depth"], {"saved": "sum"}, "trie-paths")
    above = path.select(*_ID, (F.col("run_saved") - F.col("saved")).alias("above"))
    ends = _digest_lists(maybe.where(last).select(*_ID, "conv").unionByName(convs.where("len = 0").select(zero.alias("k1"), zero.alias("k2"), "conv")))
    ends = staged(ends, "trie-ends")

    parents = groups.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_owner"))
    parent = F.when(F.col("depth") == 1, F.lit(first).cast("long"))
    named = groups.join(sums, _ID).join(above, _ID).join(ends, _ID, "left").join(parents, ["p1", "p2"], "left")
    named = named.join(owners.select(F.col("conv").alias("owner"), "total"), "owner")
    inner = named.select(
        F.col("owner").alias("conv_id"), "depth", parent.otherwise(F.coalesce("parent_owner", "owner")).alias("parent_conv_id"), "n_convs",
        F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"), (F.col("below") + F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )

    def tail(part: DataFrame, parent_conv: Column) -> DataFrame:
        said = F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nothing)
        return part.select(
            F.col("conv").alias("conv_id"), "depth", parent_conv.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (~last).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), said.alias("ends_sha256"),
        )

    tails = tail(proven.where("after"), F.col("conv")).unionByName(tail(proven.where("NOT after").join(parents, ["p1", "p2"], "left"), parent.otherwise(F.coalesce("parent_owner", "conv"))))
    below = owners.agg(F.coalesce(F.sum((F.col("since") == 1).cast("long")), zero).alias("child"), F.coalesce(F.sum("leaf"), zero).alias("leaf"), F.coalesce(F.sum("total"), zero).alias("total"))
    empty = ends.where("k1 = 0 AND k2 = 0").select("ends_sha256")
    root = top.where("n_convs > 0").crossJoin(F.broadcast(below)).join(F.broadcast(empty), F.lit(True), "left").select(
        F.col("owner").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col("child").alias("n_children"),
        F.greatest("leaf", F.lit(1).cast("long")).alias("n_leaves"), F.col("total").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return inner.unionByName(tails).unionByName(root)

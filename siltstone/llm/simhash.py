"""SimHash near-duplicate detection by a binary trie self-join.

Fingerprints: 64 bits over lower-cased 3-word shingles (XXH64, seed 42). The
join works on distinct fingerprints only. Any two within ``MAX_BITS`` = 3 bits
agree on two of five bit blocks, so each fingerprint goes to the ten groups
named by a pair of blocks and their bits (about 25 bits of key: at a billion
fingerprints a group holds some thirty). In each partition all groups' sorted
fingerprints form binary tries, which are joined with themselves: node pairs
descend together, add up differing bits, and die beyond the error budget. A
group of more than ``LARGE_GROUP`` fingerprints is dealt into slices, and every
pair of slices is a group of its own, so that no task holds it whole.

A group of near copies would have a number of pairs that is quadratic in its
size; a partition therefore keeps a forest over its members (union-find over
the found pairs) and returns at most one link per member. Frontiers longer
than ``FRONTIER`` are split and finished depth first, which bounds memory.
Connected components over these links use alternating large and small stars.

Edge cases: null or empty text has fingerprint zero and links like any other;
fewer than three words make one shingle; equal texts and repeated rows share a
fingerprint; a null ``doc_id`` counts as the smallest id and is returned as
null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, blocks, id_key, staged, texts_of

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Five blocks of 13, 13, 13, 13 and 12 bits; three differing bits leave two of them untouched.
_CUTS = (0, 13, 26, 39, 52, 64)
FRONTIER = 1 << 18
#: A larger group is joined in slices of half this size, each pair of slices by itself.
LARGE_GROUP = 200_000
#: Rows of whole groups that a task joins at a time.
ROWS_AT_ONCE = 500_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text; :func:`_sign` does the same for many."""
    return int(_vote(_shingles(text, size), 1)[0]) if text.split() else 0


def _shingles(text: bytes, size: int) -> list[int]:
    words = text.lower().split()  # of bytes: touches A-Z only, splits at the six ASCII blanks only
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(size)))]


def _vote(hashes: list[int], _docs: int = 1) -> np.ndarray:
    """Bits that are set in over half of the hashes."""
    array = np.array(hashes, dtype=np.uint64)
    count = np.zeros(64, dtype=np.int64)
    for part in np.array_split(array, len(array) // 65536 + 1):
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(array), bitorder="little").view(np.uint64)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.zeros(batch.num_rows, dtype=np.uint64)
            for block in blocks(batch.column(1)):
                for i in range(block.n):
                    if hashes := _shingles(block.text(i), size):
                        prints[block.rows.start + i] = _vote(hashes)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    return texts_of(docs).mapInArrow(_sign(size), "doc_id long, fp long")


class _Forest:
    """Union-find over row numbers; ``join`` takes whole arrays of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while (r != self.root[r]).any():
            r = self.root[r]
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.find(a), self.find(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))


def trie_links(group: np.ndarray, prints: np.ndarray, budget: int = MAX_BITS, frontier: int = FRONTIER) -> np.ndarray:
    """For rows sorted by (group, print): each row's root in the forest of links inside its group.

    A trie node is a row range that shares its top bits; ``ones[d]`` counts set bits so that splitting a
    node is arithmetic on prefix counts. A node pair is (depth, lo, hi, lo', hi', differing bits so far).
    """
    n = len(prints)
    forest = _Forest(n)
    if n < 2:
        return forest.root
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(edges, n))
    lo, hi = edges[sizes > 1], (edges + sizes)[sizes > 1]
    stack = [(0, lo[i : i + frontier], hi[i : i + frontier], lo[i : i + frontier], hi[i : i + frontier], np.zeros(len(lo[i : i + frontier]), dtype=np.int8)) for i in range(0, len(lo), frontier)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, bits = stack.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)  # two leaves: the rest of the bits at once
        left, right = a0[single], b0[single]
        near = np.bitwise_count(prints[left] ^ prints[right]) <= budget
        forest.join(left[near], right[near])
        a0, a1, b0, b1, bits = (x[~single] for x in (a0, a1, b0, b1, bits))
        if not len(a0):
            continue
        if depth == 64:  # distinct prints end as single leaves; equal ones that remain are linked
            forest.join(np.concatenate([np.arange(x, y) for x, y in zip(a0, a1)]), np.repeat(a0, a1 - a0))
            forest.join(a0, b0)
            continue
        if depth not in ones:
            bit = (prints >> np.uint64(63 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit, dtype=np.int32)))
        run = ones[depth]
        am, bm = a1 - (run[a1] - run[a0]), b1 - (run[b1] - run[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, bits, np.ones(len(a0), dtype=bool)),
            (am, a1, bm, b1, bits, np.ones(len(a0), dtype=bool)),
            (a0, am, bm, b1, bits + 1, np.ones(len(a0), dtype=bool)),
            (am, a1, b0, bm, bits + 1, ~same),  # a node with itself: its two halves meet once
        ]
        nexts = []
        for x0, x1, y0, y1, cost, ok in parts:
            ok = ok & (x1 > x0) & (y1 > y0) & (cost <= budget) & ~((x0 == y0) & (x1 - x0 == 1))
            nexts.append([v[ok] for v in (x0, x1, y0, y1, cost)])
        a0, a1, b0, b1, bits = (np.concatenate(v) for v in zip(*nexts))
        # Pairs of which both sides are one tree of the forest already have nothing to add.
        if len(a0) > 4096:
            roots = forest.find(np.arange(n))
            change = np.concatenate(([0], np.cumsum(roots[1:] != roots[:-1])))
            done = (change[a1 - 1] == change[a0]) & (change[b1 - 1] == change[b0]) & (roots[a0] == roots[b0])
            a0, a1, b0, b1, bits = (v[~done] for v in (a0, a1, b0, b1, bits))
        for i in range(0, len(a0), frontier):
            stack.append((depth + 1, *(v[i : i + frontier] for v in (a0, a1, b0, b1, bits))))
    return forest.find(np.arange(n))


def _links(table: pa.Table) -> pa.RecordBatch:
    key, fp, node = (table.column(k).to_numpy() for k in range(3))
    prints = fp.view(np.uint64)
    order = np.lexsort((prints, key))
    key, prints, node = key[order], prints[order], node[order]
    root = trie_links(key, prints)
    links = np.unique(np.sort(np.stack((node, node[root])), axis=0), axis=1)
    links = links[:, links[0] != links[1]]
    return pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1])], ["a", "b"])


def _join_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, node) sorted by key: the links of a partition's groups, at most one per row.

    Whole groups are joined ``ROWS_AT_ONCE`` rows at a time, so memory follows the largest group, not the partition.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            if cut:
                yield _links(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
    if rows:
        yield _links(pa.Table.from_batches(held))


def _group_keys() -> list:
    """For each pair of blocks: its number and the bits of both, as one long."""
    keys = []
    for n, (i, j) in enumerate(combinations(range(5), 2)):
        part = [F.shiftrightunsigned("fp", _CUTS[k]).bitwiseAND(F.lit((1 << (_CUTS[k + 1] - _CUTS[k])) - 1).cast("long")) for k in (i, j)]
        keys.append(F.lit(n << 26).cast("long") + F.shiftleft(part[0], 13) + part[1])
    return keys


def near_links(prints: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """``a, b``: links between nodes of ``prints`` (``fp, node``, distinct) that join all within 3 bits."""
    keyed = prints.select(F.explode(F.array(*_group_keys())).alias("key"), "fp", "node")
    hot = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > large), "large-groups")
    slices = F.ceil(2 * F.col("n") / large).cast("int")
    own = F.pmod(F.xxhash64("fp"), slices).cast("int")
    # Should two of these keys be equal, their rows are compared in vain, and links stay true.
    pairs = F.transform(F.sequence(F.lit(0), slices - 1), lambda j: F.xxhash64("key", F.least(own, j), F.greatest(own, j)))
    dealt = keyed.join(hot, "key", "left").select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "fp", "node")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_join_partition, "a long, b long").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``: the smallest node that it reaches.

    Large and small stars alternate until nothing changes; each round's links are a written table.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select("u", "v", "m")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    member = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id`` (the smallest ``doc_id`` reachable)."""
    signed = staged(fingerprints(docs, size), "fingerprints")
    prints = staged(signed.groupBy("fp").agg(F.min(id_key()).alias("node")), "distinct-prints")
    found = components(near_links(prints))
    labels = prints.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    label = F.when(F.col("component") == NULL_ID, F.lit(None)).otherwise(F.col("component"))
    return signed.join(labels, "fp").select("doc_id", "fp", label.alias("component_id"))

"""The archive as a user sees it: ingest, build, search, judge and copy, over tables below one folder.

``items``, ``keys``, ``embeddings``, ``blocks``, ``edges``, ``entries``, ``journal_records`` and ``journal_blocks`` are Parquet
tables that only grow; an embedding provider is any function from a list of texts to a list of vectors. Items, blocks, edges
and entries are in buckets of their hash, and ``keys`` names the items of an entry or an email, so looking something up reads a
few row groups whatever the archive's size.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import vectors as V
from siltstone.operators import graph, health, journal, planning, replay, reports, search, spread, store, trees
from siltstone.operators import telemetry as telemetry_tables
from siltstone.operators.shared import kept
from siltstone.sources import mail
from siltstone.sources.requests import SELF_SIZED_PROFILES, Request

Provider = Callable[[list[str]], list[list[float]]]


def hashed_words(dims: int) -> Provider:
    """A deterministic local provider: words hashed to signed dimensions, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dims)
            for word in text.lower().split() or [""]:
                digest = hashlib.sha256(word.encode()).digest()
                v[int.from_bytes(digest[:8], "little") % dims] += 1 if digest[8] % 2 else -1
            out.append((v / (math.sqrt(float(v @ v)) or 1.0)).tolist())
        return out

    return embed


#: Tables that are in buckets, by the hash that their rows are looked up with.
TABLES = ("items", "keys", "embeddings", "blocks", "edges", "entries", "journal_records", "journal_blocks")
BUCKETED = {"items": "block_id", "keys": "key_hash", "blocks": "block_id", "edges": "parent_id", "entries": "block_id"}


#: Of tables that may be empty: a tree of one leaf has no edges.
SCHEMAS = {
    "keys": "key_hash string, block_id string, path string, bucket string", "blocks": "block_id string, level int, bucket string",
    "edges": "parent_id string, child_ix int, child_id string, bucket string", "entries": "block_id string, entry_ix long, embedding array<double>, bucket string",
}
#: Tags of what this session is at work on, by archive; true once cancelled.
_RUNNING: dict[str, dict[str, bool]] = {}


class Cancelled(Exception):
    """An operation that :meth:`Archive.cancel` ended."""


def key_hash(kind: str, value: Column) -> Column:
    """How ``keys`` names an ``entry`` or an ``email``."""
    return F.sha2(F.concat_ws(":", F.lit(kind), value.cast("string")), 256)


class Archive:
    def __init__(self, spark: SparkSession, folder: str, refs: str):
        self.spark, self.folder, self.refs = spark, folder.rstrip("/"), refs

    @classmethod
    def from_config(cls, spark: SparkSession, path: str) -> Archive:
        """From a JSON file with ``archive`` and ``refs``; other fields are refused."""
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        if set(config) != {"archive", "refs"}:
            raise ValueError(f"{path} must have archive and refs, and nothing else")
        return cls(spark, config["archive"], config["refs"])

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(SCHEMAS[name]) if name in SCHEMAS else reader).parquet(self._path(name))

    def ingest(self, request: Request, provider: Provider, inline: DataFrame | None = None) -> int:
        """New items, those of ``inline (body, metadata)`` too, their records in the journal and their missing embeddings are appended; returns the number of new items."""
        request.check()
        with self._work("ingest"):
            return self._ingest(request, provider, inline)

    def _ingest(self, request: Request, provider: Provider, inline: DataFrame | None) -> int:
        items = mail.all_items(self.spark, request.documents, request.mailboxes)
        return self._admit(items if inline is None else items.unionByName(mail.inline_items(inline)), request, provider, request.metadata or None)

    def _admit(self, items: DataFrame, request: Request, provider: Provider, metadata: dict | None) -> int:
        """Items, their keys and embeddings are appended, then the journal; its head moves last, with the reference's ``metadata``.

        Each step adds what its table lacks, so a run that ended anywhere is made whole by the next one, and the head never names
        an item that cannot be replayed.
        """
        store.append_new(items.withColumn("block_id", F.sha2(F.concat_ws("|", "input_hash", F.to_json("metadata")), 256)), self._path("items"), bucketed=True)
        self._add_keys()
        held = store.table_or_none(self.spark, self._path("embeddings"))
        known = held if held is not None else self.spark.createDataFrame([], "input_hash string, embedding array<float>")
        wanted = self.table("items").join(known.select("input_hash"), "input_hash", "left_anti")
        journal.embed_missing(wanted, known.limit(0), provider, request.dims).write.mode("append").parquet(self._path("embeddings"))
        # What the journal lacks is appended, also if an earlier run ended before it.
        seen = self._journal(request.ref_name).select(F.col("item_block_id").alias("block_id"))
        fresh = kept(self.table("items").join(seen, "block_id", "left_anti"), "fresh")
        self._go_on()
        replay.append(replay.records_from_items(fresh), self._path, self.refs, request.ref_name, ["item_block_id"], metadata=metadata)
        return fresh.count()

    def ingest_stream(self, stream: DataFrame, request: Request, provider: Provider, checkpoint: str, name: str = "stream") -> None:
        """Admit a stream of items (the columns of :func:`siltstone.sources.mail.all_items`), a micro-batch at a time, to its end.

        The reference takes a batch's number in the step that moves its head. A batch that is run again after a failure finds either
        its number there, and does nothing, or what it had written, and adds the rest; so each item is in the journal once.
        """
        key = f"stream:{name}"

        def step(batch: DataFrame, epoch: int) -> None:
            held = store.load_ref(self.refs, request.ref_name)["metadata"]
            if int(held.get(key, -1)) >= epoch:
                return
            self._admit(batch, request, provider, held | {key: str(epoch)})

        with self._work("ingest"):
            stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _add_keys(self) -> None:
        """``key_hash, block_id, path`` of every item that has none yet, also of an ingest that ended before its keys were written."""
        items = self.table("items")
        keys = F.array_compact(F.array(key_hash("entry", F.xxhash64("input_hash")), F.when(F.col("kind") == "email-chunk", key_hash("email", F.col("email_ref")))))
        held = store.table_or_none(self.spark, self._path("keys"))
        lacking = items if held is None else items.join(held.select("block_id"), "block_id", "left_anti")
        store.append_bucketed(kept(lacking.select(F.explode(keys).alias("key_hash"), "block_id", "path"), "fresh-keys"), self._path("keys"), "key_hash")

    def _items_of(self, kind: str, values: DataFrame) -> DataFrame:
        """``value, block_id, path``: the items of each entry or email in ``values`` (one column)."""
        wanted = kept(values.toDF("value").distinct().withColumn("key_hash", key_hash(kind, F.col("value"))), "wanted")
        return store.only(self.table("keys"), "key_hash", wanted.select("key_hash")).join(wanted, "key_hash").select("value", "block_id", "path")

    def _journal(self, ref_name: str) -> DataFrame:
        return replay.read(self.spark, self._path, store.load_ref(self.refs, ref_name)["replay_journal_head_block_id"])

    def replayed(self, ref_name: str) -> DataFrame:
        """``block_id, input_hash, embedding`` of the items that the journal names, from what is stored: nothing is embedded.

        An item that is missing, differs from its record or has no embedding fails the job.
        """
        entries = journal.replay_order(replay.items_from_records(self._journal(ref_name)))
        leaves = self.table("items").select("block_id", replay.item_key(F.col("text")).alias("content_key"), "metadata", "input_hash")
        checked = replay.checked_entries(entries, leaves).select("block_id", "input_hash")
        joined = checked.join(self.table("embeddings"), "input_hash", "left")
        missing = F.raise_error(F.concat(F.lit("no stored embedding: "), F.col("input_hash"))).cast("array<float>")
        return joined.withColumn("embedding", F.when(F.col("embedding").isNull(), missing).otherwise(F.col("embedding")))

    @contextmanager
    def _work(self, name: str) -> Iterator[None]:
        """Jobs of one operation carry a tag, so that :meth:`cancel` ends them; what was cancelled raises :class:`Cancelled`, whatever failed."""
        tag = f"siltstone-{name}-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        _RUNNING.setdefault(self.folder, {})[tag] = False
        try:
            yield
            stopped = _RUNNING[self.folder][tag]
        except Exception as error:
            if _RUNNING[self.folder][tag]:
                raise Cancelled(f"{name} of {self.folder} was cancelled") from error
            raise
        finally:
            self.spark.removeTag(tag)
            _RUNNING[self.folder].pop(tag, None)
        if stopped:
            raise Cancelled(f"{name} of {self.folder} was cancelled")

    def cancel(self) -> int:
        """End this session's running ingests, builds and copies of the archive; returns their number. Head and root stay as they are."""
        tags = list(_RUNNING.get(self.folder, {}))
        for tag in tags:
            _RUNNING[self.folder][tag] = True
            self.spark.interruptTag(tag)
        return len(tags)

    def _go_on(self) -> None:
        if any(_RUNNING.get(self.folder, {}).values()):
            raise Cancelled(f"work on {self.folder} was cancelled")

    def build(self, request: Request) -> str:
        """Cluster the journal's items into a tree; appends its new blocks, publishes and returns its root.

        Planning keeps its passes below ``planning`` and goes on after the last one if a run was killed. A failure leaves
        its diagnostics there and in the exception's notes; a cancelled build raises :class:`Cancelled` instead.
        """
        request.check()
        with self._work("build"):
            vectors = self.replayed(request.ref_name).dropDuplicates(["input_hash"]).select(F.xxhash64("input_hash").alias("entry_ix"), "embedding")
            vectors = kept(vectors, "vectors")
            try:
                tree = self._planned(request, vectors)
                root = tree.blocks.orderBy(F.desc("level"), "block_id").first()["block_id"]
                self._add(tree)
            except Exception as error:
                if any(_RUNNING[self.folder].values()):
                    raise
                raise self._diagnosed(request, vectors, error) from error.__cause__
            made = tree.blocks.count()
            self._go_on()
            last = self._journal(request.ref_name).where("record_kind = 'indexing-outcome'").orderBy("steps", F.desc("seq")).first()
            if last is None or last["item_block_id"] != root:
                replay.append(replay.outcome(self.spark, root, vectors.count(), made), self._path, self.refs, request.ref_name, ["item_block_id"])
            store.update_ref(self.refs, request.ref_name, root=root)
        return root

    def _planned(self, request: Request, vectors: DataFrame) -> trees.Tree:
        """The tree of ``vectors``, planned in passes of a run that its inputs and settings name."""
        size = trees.fan_out(request.dims, request.block_bytes)
        seen = vectors.agg(F.count("*").alias("n"), F.sum(F.xxhash64("entry_ix", "embedding").cast("decimal(38,0)")).alias("s")).first()
        settings = (seen["n"], str(seen["s"]), request.dims, request.method, request.clusters, request.seed, size)
        run_id = hashlib.sha256(json.dumps(settings).encode()).hexdigest()[:16]
        family = "v3" if request.profile_version in SELF_SIZED_PROFILES else "v2"
        telemetry = planning.Telemetry(self.spark, f"{self.folder}/planning", run_id, family)
        planned = planning.plan(vectors, f"{self.folder}/planning/{run_id}", size, telemetry, request.method, request.clusters, request.seed)
        self._go_on()
        n = seen["n"]
        return trees.assemble(planned.clustered, size, lambda level, groups: telemetry.tell("bottom-up-assembly", layer_index=level, item_count=n, completed_units=groups, total_units=groups, state="completed"))

    def _diagnosed(self, request: Request, vectors: DataFrame, error: Exception) -> Exception:
        """The failure with a bundle about its inputs; whatever goes wrong with the bundle is only noted on it."""
        try:
            inputs = vectors.select(F.col("entry_ix").alias("ix"), "embedding")
            spec = {"dims": request.dims, "encoding": request.encoding}
            bundle = reports.failure_diagnostics(inputs.select("ix"), health.health(inputs).first().asDict(), request.clustering(), spec)
        except Exception as problem:  # the failure itself must reach the caller
            error.add_note(f"no diagnostics: {problem}")
            return error
        return reports.write_failure(os.path.join(self.refs, "failures", f"{request.ref_name.replace('/', '-')}.json"), bundle, error)

    def pass_reports(self) -> DataFrame:
        """Every completed pass of every run's planning: verdict, evidence, message and record."""
        statuses = self.spark.read.schema(planning.STATUSES).parquet(f"{self.folder}/planning/statuses")
        passes = self.spark.read.schema(planning.PASSES).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*self._pass_folders())
        return telemetry_tables.pass_summaries(passes, statuses)

    def _pass_folders(self) -> list[str]:
        runs = self.spark.read.parquet(f"{self.folder}/planning/statuses").select("run_id").distinct().collect()  # a row per run
        found = []
        for run in runs:
            number = 1
            while store.finished(self.spark, path := f"{self.folder}/planning/{run['run_id']}/pass-{number}"):
                found.append(path)
                number += 1
        return found

    def status_records(self) -> DataFrame:
        """The recorded statuses of every run's planning as JSON."""
        return telemetry_tables.status_records(self.spark.read.schema(planning.STATUSES).parquet(f"{self.folder}/planning/statuses"))

    def _add(self, tree: trees.Tree) -> int:
        """Append what the tables lack; blocks come last, so a block that is there is complete. Returns the number of new blocks."""
        fresh = tree.blocks.dropDuplicates(["block_id"])
        held = store.table_or_none(self.spark, self._path("blocks"))
        if held is not None:
            fresh = fresh.join(held.select("block_id"), "block_id", "left_anti")
        fresh = kept(fresh, "fresh-blocks")
        for name, key, rows in (("edges", "parent_id", tree.edges), ("entries", "block_id", tree.entries)):
            mine = rows.join(fresh.select(F.col("block_id").alias(key)), key, "left_semi")
            there = store.table_or_none(self.spark, self._path(name))
            if there is not None:
                mine = mine.join(there.select(key).distinct(), key, "left_anti")
            store.append_bucketed(kept(mine.drop("bucket"), f"fresh-{name}"), self._path(name), key)
        store.append_bucketed(fresh.drop("bucket"), self._path("blocks"), "block_id")
        return fresh.count()

    def tree(self, *roots: str) -> trees.Tree:
        """All trees of the archive, or what the given roots reach."""
        tree = trees.Tree(self.table("blocks"), self.table("edges"), self.table("entries"))
        if not roots:
            return tree
        reached = kept(graph.closure(tree.edges, self.spark.createDataFrame([(r,) for r in roots], "block_id string")), "reached")
        parents = reached.select(F.col("block_id").alias("parent_id"))
        return trees.Tree(tree.blocks.join(reached, "block_id", "left_semi"), tree.edges.join(parents, "parent_id", "left_semi"), tree.entries.join(reached, "block_id", "left_semi"))

    def search_chunks(self, query: str, provider: Provider, root: str, k: int = 5, width: int = 3) -> dict:
        """Hits of one query text, best first, with the source of each."""
        began = time.perf_counter()
        if root == store.PLACEHOLDER_ROOT:
            raise ValueError("the archive has no tree yet")
        tree, clock = self.tree(), [began]
        if not store.only(tree.blocks, "block_id", [root]).take(1):
            raise ValueError(f"no block {root}")
        clock.append(time.perf_counter())
        vector = provider([query])[0]
        clock.append(time.perf_counter())
        target = self.spark.createDataFrame([(-1, [float(x) for x in vector])], "query_id long, target array<double>")
        clock.append(time.perf_counter())
        hits, _ = search.beam_search(tree, target, root, width, k)
        hits = kept(hits.select("neighbor_id", "position", F.col("block_id").alias("leaf_id")), "hits")
        # An entry may stand for many items of one text: the first k by position and path are looked up, no more.
        named = self._items_of("entry", hits.select("neighbor_id")).withColumnRenamed("value", "neighbor_id")
        first = kept(hits.join(named, "neighbor_id").orderBy("position", "path", "block_id").limit(k), "first-hits")
        items = store.only(self.table("items"), "block_id", first.select("block_id")).select("block_id", "text", "metadata")
        entries = first.drop("path").join(items, "block_id").select("position", F.col("leaf_id").alias("block_id"), F.lit("text/plain").alias("media_type"), F.col("text").alias("body"), "metadata")
        rows = reports.search_hits(entries).orderBy("position", "source_path").collect()
        if not rows:
            raise ValueError("no leaf can be reached")
        clock.append(time.perf_counter())
        found = [{"leaf" if c == "leaf_block_id" else c: dict(sorted(v.items())) if c == "metadata" else v for c, v in r.asDict().items()} for r in rows]
        parts = ("root_load_ms", "embedding_ms", "target_preparation_ms", "traversal_ms")
        timing = {name: int(1000 * (after - before)) for name, before, after in zip(parts, clock, clock[1:])} | {"total_ms": int(1000 * (clock[-1] - began))}
        return {"query": query, "root_id": root, "top_k": k, "traversal_width": width, "hits": found, "timing": timing, "elapsed_ms": timing["total_ms"]}

    def get_email(self, email_ref: str) -> DataFrame:
        """The chunks of one normalised email in order."""
        named = self._items_of("email", self.spark.createDataFrame([(email_ref,)], "email_ref string"))
        items = store.only(self.table("items"), "block_id", named.select("block_id"))
        return items.join(named.select("block_id"), "block_id", "left_semi").orderBy("chunk_index")

    def get_leaf_email(self, block_id: str) -> dict:
        """The one email chunk of an ingested leaf; ``ValueError`` if there is no such entry, more than one, or another kind."""
        rows = store.only(self.table("items"), "block_id", [block_id]).limit(2).collect()
        if len(rows) != 1:
            raise ValueError(f"{block_id} holds {'no' if not rows else 'more than one'} entry")
        if rows[0]["metadata"].get("source_kind") != "email":
            raise ValueError(f"{block_id} is no email")
        return {"text": rows[0]["text"], "metadata": dict(sorted(rows[0]["metadata"].items()))}

    def get_document(self, *_: str) -> dict:
        return {"status": "unsupported"}

    def get_thread(self, *_: str) -> dict:
        return {"status": "unsupported"}

    def quality(self, root: str, sample: int = search.SAMPLE, seed: int = 0, width: int = 3) -> dict[str, DataFrame]:
        """Findings, layers, splits and recall of the tree, each as a DataFrame."""
        tree = self.tree(root)
        stats = spread.spread(tree.entries)
        axes = spread.principal_axes(tree.entries)
        deltas = spread.centered(tree.entries, spread.centroids(tree.entries)).join(axes, "block_id")
        bins = spread.quantile_bins(deltas.select("block_id", V.dot(F.col("delta"), F.col("axis")).alias("projection")))
        dims = tree.entries.groupBy("block_id").agg(F.max(F.size("embedding")).alias("dims"))
        blocks = tree.blocks.join(dims, "block_id")
        usable, _ = store.corpus(tree.entries.join(tree.blocks.where("level = 0"), "block_id"))
        corpus = usable.select(F.col("entry_ix").alias("id"), "embedding")
        chosen = search.seeded_sample(corpus, "id", seed, sample)
        hits, touched = search.beam_search(tree, chosen.select(F.col("id").alias("query_id"), F.col("embedding").alias("target")), root, width, search.TOP)
        sizes = tree.entries.groupBy("block_id").agg(F.sum(4 * F.size("embedding") + trees.ENTRY_OVERHEAD).alias("n_bytes"))
        found = kept(graph.findings(tree.edges, blocks, self.spark.createDataFrame([(root,)], "block_id string")), "findings")
        recalls = kept(search.recall(search.exact_top(corpus, chosen), hits), "recalls")
        return {
            "findings": found,
            "layers": spread.layer_metrics(tree.blocks, tree.edges, stats, bins, axes),
            "splits": spread.split_metrics(tree.blocks, tree.edges, stats),
            "recall": recalls,
            "recall_report": reports.gated_recall(recalls, found),
            "access": search.access_summary(touched, sizes),
        }

    def copy(self, roots: list[str], destination: str, read_before_write: bool = True) -> DataFrame:
        """Copy the blocks under ``roots`` with their edges, entries, items and embeddings into another archive; returns the report row.

        Ids are content hashes, so what the destination holds is never written twice, in either mode.
        """
        with self._work("copy"):
            return self._copy(roots, destination, read_before_write)

    def _copy(self, roots: list[str], destination: str, read_before_write: bool) -> DataFrame:
        tree = self.tree()
        start = self.spark.createDataFrame([(r,) for r in roots], "block_id string")
        held = store.table_or_none(self.spark, Archive(self.spark, destination, self.refs)._path("blocks"))
        there = held.select("block_id") if held is not None else tree.blocks.select("block_id").limit(0)
        plan = kept(graph.copy_plan(graph.closure(tree.edges, start), tree.blocks, there, read_before_write), "copy-plan")
        other = Archive(self.spark, destination, self.refs)
        mine = self.tree(*roots)
        leaves = mine.entries.join(mine.blocks.where("level = 0"), "block_id", "left_semi").select("entry_ix").distinct()
        items = self.table("items").join(leaves, F.xxhash64("input_hash") == F.col("entry_ix"), "left_semi")
        store.append_new(items, other._path("items"), bucketed=True)
        other._add_keys()
        store.append_new(self.table("embeddings").join(items.select("input_hash").distinct(), "input_hash", "left_semi"), other._path("embeddings"), "input_hash")
        other._add(mine)
        return graph.copy_report(plan)

    def copy_failures(self, roots: list[str]) -> DataFrame:
        """``block_id, roots, operation, message``: blocks under ``roots`` that a copy cannot read, with all roots that reach them."""
        tree = self.tree()
        start = self.spark.createDataFrame([(r,) for r in roots], "block_id string")
        lost = kept(graph.closure(tree.edges, start).join(tree.blocks.select("block_id"), "block_id", "left_anti"), "copy-failed")
        named = graph.failure_roots(lost, tree.edges, start)
        return named.select("block_id", "roots", F.lit("read").alias("operation"), F.concat(F.lit("block is not in the source: "), F.col("block_id")).alias("message"))

    def compact(self) -> dict[str, int]:
        """Rewrite every table in files of about 128 MB as a new generation; returns the rows of each.

        The generations are written beside the tables in use and then named, all of them, by one replacement of ``tables.json``; a run
        that ends before leaves the archive as it was. Old generations stay until :meth:`vacuum`, so readers go on. For an archive
        that nobody writes to meanwhile.
        """
        counts, made = {}, self._generations()
        for name in TABLES:
            rows = store.table_or_none(self.spark, self._path(name))
            if rows is not None:
                target = f"{name}-{uuid.uuid4().hex}"
                if name in BUCKETED:
                    store.append_bucketed(rows.drop("bucket"), f"{self.folder}/{target}", BUCKETED[name])
                else:
                    rows.write.parquet(f"{self.folder}/{target}")
                made[name] = target
                counts[name] = self.spark.read.parquet(f"{self.folder}/{target}").count()
        store.replace_document(os.path.join(self.refs, "tables.json"), {**self._all_generations(), self.folder: made})
        return counts

    def vacuum(self) -> list[str]:
        """Delete the generations that ``tables.json`` no longer names; returns their names."""
        used = {*self._generations().values()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        old = [n for n in names if n not in used and any(n.startswith(f"{t}-") or (n == t and t in self._generations()) for t in TABLES)]
        for name in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}"), True)
        return sorted(old)

    def _all_generations(self) -> dict[str, dict[str, str]]:
        return store.read_document(os.path.join(self.refs, "tables.json"))

    def _generations(self) -> dict[str, str]:
        return dict(self._all_generations().get(self.folder, {}))

    def _path(self, name: str) -> str:
        """Where a table is: the generation that ``tables.json`` names, else the folder of its name."""
        return f"{self.folder}/{self._generations().get(name, name)}"

"""Queries over what an archive keeps: workflow journals, replay integrity, edges of all kinds, gates, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import formats
from siltstone.operators import graph, invariants, replay, reports, search, telemetry, trees
from siltstone.plans import vector_queries as vectors

from .registry import Registry

R = Registry()

# --- workflow invariants: one journal per order, with planted faults ---------------------------------------


def _journals(t) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    every = lambda n: key % n == 0
    text = lambda value, n: F.when(~every(n), F.lit(value))  # noqa: E731  missing at every n-th order
    none = F.lit(None).cast("string")
    stage = F.when(status == "F", "terminal-success").when(status == "P", "published-root-generation").otherwise("embedding")
    ends = F.when(status == "F", F.lit("then"))
    item = key.cast("string")
    empty = F.array().cast("array<string>")
    idle = F.struct(empty.alias("pending"), empty.alias("completed"))
    chunking = F.struct(F.when(every(7), F.array(item)).otherwise(empty).alias("pending"), F.when(every(5), F.array(item)).otherwise(empty).alias("completed"))
    embedding = F.struct(F.when(every(43), F.array(item)).otherwise(empty).alias("pending"), empty.alias("completed"))
    note = F.struct(F.when(every(41), "root-history-publication").otherwise("mailbox-admission").alias("stage"), F.lit("chunking").alias("work_kind"), item.alias("item_id"), F.lit("now").alias("recorded_at"))
    return t("orders").select(
        F.when(every(89), 2).otherwise(1).alias("schema_version"), F.lit("workflow").alias("authority"), stage.alias("current_stage"),
        F.struct(item.alias("generation_id"), F.when(every(97), " ").otherwise("j").alias("journal_id"), F.lit("now").alias("started_at"), F.when(~every(53), ends).alias("completed_at")).alias("generation"),
        F.struct(F.lit("s").alias("source_snapshot_id"), F.lit("u").alias("source_uri"), none.alias("acquisition_started_at"), none.alias("acquisition_completed_at"), none.alias("corpus_manifest_identity")).alias("source_snapshot"),
        F.struct(*(F.lit("x").alias(c.rsplit(".", 1)[1]) for c in invariants._REQUIRED[5:])).alias("effective_indexing_configuration"),
        F.struct(*((chunking if k == "chunking" else embedding if k == "embedding" else idle).alias(k) for k in invariants.KINDS)).alias("work"),
        F.struct(text("w", 13).alias("work_set_id"), (~every(11)).alias("work_set_frozen"), text("r", 17).alias("published_root_id"), text("now", 19).alias("published_root_recorded_at"), text("h", 23).alias("root_history_entry_id"), text("now", 29).alias("root_history_recorded_at"), none.alias("root_change_explanation")).alias("audit"),
        F.when(every(3), F.array(note)).alias("checkpoints"), F.lit(None).cast("array<struct<authority:string,implementation:string,location:string,last_observed_generation_id:string>>").alias("subordinate_journals"),
        F.when(status == "F", F.struct(F.when(every(31), "non-recoverable-failure").otherwise("success").alias("kind"), F.when(every(37), "later").otherwise("then").alias("recorded_at"), none.alias("detail"))).alias("terminal_outcome"),
    )


_RULES = [
    ("unsupported schema_version", "k % 89 = 0"), ("empty generation.journal_id", "k % 97 = 0"), ("work.chunking both pending and completed", "k % 7 = 0 AND k % 5 = 0"), ("missing audit.work_set_id", "k % 11 <> 0 AND k % 13 = 0"),
    ("unpaired audit.published_root_recorded_at", "k % 17 <> 0 AND k % 19 = 0"), ("unpaired audit.published_root_id", "k % 17 = 0 AND k % 19 <> 0"),
    ("unpaired audit.root_history_recorded_at", "k % 23 <> 0 AND k % 29 = 0"), ("unpaired audit.root_history_entry_id", "k % 23 = 0 AND k % 29 <> 0"),
    ("checkpoint not completed", "k % 3 = 0 AND k % 5 <> 0"), ("checkpoint still pending", "k % 3 = 0 AND k % 7 = 0"), ("stage precedes checkpoint", "k % 3 = 0 AND k % 41 = 0 AND s <> 'F'"),
    ("missing generation.completed_at", "s = 'F' AND k % 53 = 0"), ("completed_at differs from the outcome", "s = 'F' AND k % 37 = 0 AND k % 53 <> 0"), ("success with another outcome", "s = 'F' AND k % 31 = 0"),
    ("pending chunking at a later stage", "k % 7 = 0"), ("work set not frozen", "s IN ('P', 'F') AND k % 11 = 0"), ("pending embedding at a later stage", "s IN ('P', 'F') AND k % 43 = 0"),
    ("missing audit.published_root_id", "s = 'F' AND k % 17 = 0"), ("missing audit.root_history_entry_id", "s = 'F' AND k % 23 = 0"),
]
_ORDERS = "(SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)"


@R.query(" UNION ALL ".join(f"SELECT '{name}' AS rule, k::VARCHAR AS generation_id FROM {_ORDERS} WHERE {broken}" for name, broken in _RULES))
def workflow_invariants(spark: SparkSession, t) -> DataFrame:
    return invariants.broken_rules(_journals(t)).select("rule", "generation_id")


_FIRST = "CASE " + " ".join(f"WHEN {broken} THEN '{name}'" for name, broken in _RULES) + " END"


@R.query(f"SELECT generation_id, rule FROM (SELECT k::VARCHAR AS generation_id, {_FIRST} AS rule FROM {_ORDERS}) WHERE rule IS NOT NULL")
def workflow_first_violation(spark: SparkSession, t) -> DataFrame:
    return invariants.first_violations(_journals(t))


# --- replay ----------------------------------------------------------------------------------------------

_END = "'\\x00\\x00'::BLOB"
_DIGEST = "sha256(" + " || ".join(f"encode({x}) || {_END}" for x in ("'document:' || source || '/' || doc_id", "'lang'", "lang", "'source'", "source")) + ")"


def _leaves(t) -> DataFrame:
    key = F.concat(F.lit("document:"), F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    metadata = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    return t("documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("block_id"), "doc_id", key.alias("content_key"), metadata.alias("metadata"))


@R.query(f"SELECT doc_id, {_DIGEST} AS digest FROM documents")
def replay_digests(spark: SparkSession, t) -> DataFrame:
    return _leaves(t).select("doc_id", replay.sort_digest(F.col("content_key"), F.col("metadata")).alias("digest"))


@R.query("SELECT sha256(doc_id::VARCHAR) AS block_id, CASE WHEN doc_id % 50 = 1 THEN 'missing-block' ELSE 'digest-differs' END AS problem FROM documents WHERE doc_id % 50 = 1 OR doc_id % 70 = 3")
def replay_integrity(spark: SparkSession, t) -> DataFrame:
    """Journal entries against stored leaves: every fiftieth leaf was lost, every seventieth has other metadata."""
    leaves = _leaves(t)
    entries = leaves.select("block_id", replay.sort_digest(F.col("content_key"), F.col("metadata")).alias("digest"))
    other = F.when(F.col("doc_id") % 70 == 3, F.create_map(F.lit("source"), F.lit("elsewhere"))).otherwise(F.col("metadata"))
    return replay.broken_entries(entries, leaves.where("doc_id % 50 <> 1").withColumn("metadata", other))


@R.query("""SELECT doc_id, sha256(unhex(sha256(source)) || encode(lang) || encode('text/plain') || encode(text)
  || encode('lang') || '\\x00'::BLOB || encode(lang) || '\\xFF'::BLOB || encode('source') || '\\x00'::BLOB || encode(source) || '\\xFF'::BLOB) AS neighbor_id FROM documents""")
def neighbor_ids(spark: SparkSession, t) -> DataFrame:
    metadata = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"))
    made = reports.neighbor_id(F.sha2("source", 256), F.col("lang").cast("binary"), F.lit("text/plain"), F.col("text").cast("binary"), metadata)
    return t("documents").select("doc_id", made.alias("neighbor_id"))


# --- edges of every kind ---------------------------------------------------------------------------------

_H = "sha256({0})"


@R.query("""
WITH o AS (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM orders),
e AS (
  SELECT DISTINCT sha256('r' || n_regionkey) AS parent_id, sha256('n' || n_nationkey) AS child_id, 'branch' AS kind FROM nation
  UNION SELECT sha256('d' || doc_id), sha256(source), 'artifact' FROM documents WHERE doc_id % 30 <> 0
  UNION SELECT sha256('d' || doc_id), sha256('m' || lang), 'artifact' FROM documents
  UNION SELECT sha256('o' || o_orderkey), sha256('o' || previous), 'journal-previous' FROM o WHERE previous IS NOT NULL
  UNION SELECT sha256('o' || l_orderkey), sha256('p' || l_partkey), 'journal-item' FROM lineitem
  UNION SELECT sha256('o' || l_orderkey), sha256('s' || l_suppkey), 'journal-artifact' FROM lineitem WHERE l_linenumber = 1
  UNION SELECT sha256('s' || s_suppkey), sha256('n' || s_nationkey), 'mailbox' FROM supplier WHERE s_suppkey % 9 <> 0)
SELECT * FROM e UNION ALL SELECT DISTINCT sha256('d' || doc_id), 'no block hash: ' || source, 'failure' FROM documents WHERE doc_id % 30 = 0
UNION ALL SELECT sha256('s' || s_suppkey), 'email without mailbox_artifact_ref', 'failure' FROM supplier WHERE s_suppkey % 9 = 0""")
def child_edges(spark: SparkSession, t) -> DataFrame:
    """The graph that a copy follows: branches, artifact references, journal links, emails' mailboxes; and what cannot be read."""
    name = lambda letter, column: F.sha2(F.concat(F.lit(letter), F.col(column).cast("string")), 256)
    branches = t("nation").select(name("r", "n_regionkey").alias("parent_id"), name("n", "n_nationkey").alias("child_id"))
    email = F.when(F.col("doc_id") % 30 == 0, F.col("source")).otherwise(F.sha2("source", 256))
    leaves = t("documents").select(name("d", "doc_id").alias("block_id"), F.create_map(F.lit("email_artifact_ref"), email, F.lit("mailbox_artifact_ref"), name("m", "lang")).alias("metadata"))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    chained = t("orders").withColumn("previous", F.lag("o_orderkey").over(order))
    blocks = chained.select(name("o", "o_orderkey").alias("block_id"), F.when(F.col("previous").isNotNull(), name("o", "previous")).alias("previous_block_id"))
    ref = F.struct(F.when(F.col("l_linenumber") == 1, name("s", "l_suppkey")).alias("email_ref"))
    records = t("lineitem").select(name("o", "l_orderkey").alias("block_id"), name("p", "l_partkey").alias("item_block_id"), ref.alias("content_ref"))
    emails = t("supplier").select(name("s", "s_suppkey").alias("block_id"), F.when(F.col("s_suppkey") % 9 != 0, name("n", "s_nationkey")).alias("mailbox_artifact_ref"))
    edges, failures = graph.child_edges(branches, leaves, records, blocks, emails)
    return edges.unionByName(failures.select(F.col("block_id").alias("parent_id"), F.col("message").alias("child_id"), F.lit("failure").alias("kind")))


_SPEC = "(CASE WHEN {0} % 3 = 0 THEN 64 ELSE 64 + {0} % 2 END)"


@R.query(f"SELECT 'n' || c_nationkey AS parent_id, 'c' || c_custkey AS child_id FROM customer WHERE {_SPEC.format('c_nationkey')} <> {_SPEC.format('c_custkey')}")
def spec_mismatches(spark: SparkSession, t) -> DataFrame:
    """Blocks whose descriptor names a logical spec are compared by it, the others by how they are stored."""
    blocks = None
    for letter, table, key in (("n", "nation", "n_nationkey"), ("c", "customer", "c_custkey")):
        stored = (F.lit(64) + F.col(key) % 2).cast("long")
        described = F.when(F.col(key) % 3 == 0, F.lit(64).cast("long"))
        spec = reports.logical_spec(stored, F.lit("f32le"), described, F.when(described.isNotNull(), F.lit("f32le")))
        rows = t(table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("block_id"), spec.alias("spec"))
        blocks = rows if blocks is None else blocks.unionByName(rows)
    edges = t("customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child_id"))
    return reports.spec_mismatches(edges, blocks)


# --- search with every query row, and the recall gate ------------------------------------------------------

_QUERIES = "(SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)"


def _every_hundredth(t) -> DataFrame:
    return vectors._entries(t).where("id % 100 = 0")


@R.query(f"SELECT query_id, neighbor_id, round(score, 6) AS score, position FROM ({vectors._EXACT.replace(vectors._SAMPLE, _QUERIES)}) WHERE position < 10")
def corpus_search_top10(spark: SparkSession, t) -> DataFrame:
    """Every row whose id is divisible by 100, against all rows."""
    out = search.exact_top(vectors._entries(t), _every_hundredth(t))
    return out.select("query_id", "neighbor_id", F.round("score", 6).alias("score"), F.col("position").cast("long").alias("position"))


@R.query(f"WITH {vectors._TREE}, {vectors._BEAM.replace(vectors._SAMPLE, _QUERIES)} SELECT q AS query_id, neighbor AS neighbor_id, position FROM hits WHERE position < 5")
def corpus_beam_top5(spark: SparkSession, t) -> DataFrame:
    """The same queries through the label tree."""
    tree = trees.label_tree(t("embeddings"))
    hits, _ = search.beam_search(tree, _every_hundredth(t).select(F.col("id").alias("query_id"), F.col("embedding").alias("target")), "R", vectors.WIDTH, 5)
    return hits.select("query_id", "neighbor_id", F.col("position").cast("long").alias("position"))


_MATCHED = "least(l_quantity::BIGINT % (k + 1), k)"


@R.query(f"""WITH r AS (SELECT k, {_MATCHED} AS matched, {_MATCHED} / k AS share FROM lineitem, (SELECT unnest([1, 5, 10])::BIGINT AS k)),
s AS (SELECT k, round(avg(share), 6) AS mean, round(stddev_pop(share), 6) AS stdev, count(DISTINCT matched) AS bins FROM r GROUP BY k)
SELECT 'open' AS gate, * FROM s UNION ALL SELECT 'shut', k, 0, 0, 0 FROM s""")
def recall_gate(spark: SparkSession, t) -> DataFrame:
    """Recall per k, and the zeroed report of a tree whose specs do not match."""
    levels = F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 5, 10)))).alias("k")
    rows = t("lineitem").select("l_quantity", levels)
    recalls = rows.select(F.least(F.col("l_quantity").cast("long") % (F.col("k") + 1), F.col("k")).alias("matched"), F.col("k").alias("possible"), "k")
    findings = t("region").select(F.when(F.col("r_regionkey") == 0, "embedding-spec-mismatch").otherwise("cycle").alias("kind"))
    out = None
    for gate, found in (("open", findings.where("kind = 'cycle'")), ("shut", findings)):
        part = reports.gated_recall(recalls, found).select(F.lit(gate).alias("gate"), F.col("k").cast("long").alias("k"), F.round("mean", 6).alias("mean"), F.round("stdev", 6).alias("stdev"), F.size("histogram").cast("long").alias("bins"))
        out = part if out is None else out.unionByName(part)
    return out


# --- telemetry: events as statuses, orders as passes -------------------------------------------------------


def _statuses(t) -> DataFrame:
    key, kind = F.col("event_id"), F.col("event_type")
    number = lambda n: (key % n).cast("int")
    some = lambda value, n: F.when(key % n != 0, value)
    phase = F.when(kind == "view", "planning-pass").when(kind == "click", "hierarchy-planning").when(kind == "purchase", "partition-load").when(kind == "signup", "terminal-materialization-load").otherwise("final-materialization-replay")
    part = lambda i: F.struct(F.concat(F.lit("p"), key.cast("string"), F.lit(f"/{i}")).alias("path"), number(7).alias("expected"), some(number(5), 2).alias("observed"))
    pending = F.when(key % 4 == 0, F.array(part(0))).when(key % 4 == 1, F.array(*(part(i) for i in range(3))))
    return t("events").select(
        F.lit("r").alias("run_id"), key.alias("seq"), (F.year("ts") - 2020).alias("pass_no"), F.when(key % 2 == 0, "v2").otherwise("v3").alias("family"), phase.alias("phase"), number(3).alias("layer_index"),
        F.when(key % 6 == 0, "completed").otherwise("in-progress").alias("state"), number(90).alias("item_count"), number(11).alias("completed_units"), some(number(13), 3).alias("total_units"), F.when(key % 8 == 2, number(9)).alias("pending_count"), pending.alias("pending"),
        some(F.concat(F.lit("q"), key.cast("string")), 5).alias("partition_path"), some(number(17), 4).alias("partition_size"), some(number(19), 6).alias("recursion_depth"), F.when(key % 10 == 0, "unchanged-routing-bucket-fill").alias("stall_reason"), F.when(key % 10 == 0, number(1000)).alias("stall_ms"), key.alias("elapsed_ms"),
    )


_PART = "('p' || e || '/{0} expects ' || (e % 7) || ' item(s)' || CASE WHEN e % 2 <> 0 THEN ', observed ' || (e % 5) ELSE '' END)"
_TOTAL = "CASE WHEN e % 3 <> 0 THEN e % 13 END"
_BLOCKED = f"""SELECT e AS seq, y AS event_type, coalesce(nullif(CASE y
  WHEN 'view' THEN concat_ws('; ', coalesce(CASE WHEN e % 8 = 2 THEN e % 9 END, CASE WHEN e % 4 = 0 THEN 1 WHEN e % 4 = 1 THEN 3 END) || ' pending partition(s)',
    CASE WHEN e % 4 = 0 THEN 'pending detail ' || {_PART.format(0)} WHEN e % 4 = 1 THEN 'pending detail ' || {_PART.format(0)} || ' | ' || {_PART.format(1)} END,
    CASE WHEN e % 4 = 1 THEN '+1 more pending partition(s)' END, CASE WHEN e % 10 = 0 THEN 'suspected stall unchanged-routing-bucket-fill for ' || (e % 1000) || ' ms' END)
  WHEN 'click' THEN concat_ws('; ', CASE WHEN e % 5 <> 0 THEN 'active partition q' || e END, CASE WHEN e % 4 <> 0 THEN 'partition size ' || (e % 17) END, CASE WHEN e % 6 <> 0 THEN 'recursion depth ' || (e % 19) END)
  WHEN 'purchase' THEN coalesce('loading layer ' || (e % 3) || ' block(s) ' || (e % 11) || ' of ' || ({_TOTAL}), 'loading layer ' || (e % 3) || ' block(s); completed ' || (e % 11))
  WHEN 'signup' THEN 'loading terminal materialization input(s) for layer ' || (e % 3) || '; completed ' || (e % 11) || coalesce(' of ' || ({_TOTAL}), '')
  ELSE 'replaying final materialization item(s) ' || (e % 11) || ' of ' || ({_TOTAL}) END, ''), 'unknown') AS blocked_on FROM (SELECT event_id AS e, event_type AS y FROM events)"""


@R.query(f"SELECT seq, blocked_on FROM ({_BLOCKED})")
def blocked_on(spark: SparkSession, t) -> DataFrame:
    return _statuses(t).select("seq", telemetry.blocked_on().alias("blocked_on"))


@R.query("""SELECT e AS seq, CASE WHEN y = 'view' THEN 'intra-pass' ELSE 'live-status' END AS kind FROM (SELECT event_id AS e, event_type AS y FROM events)
WHERE (y = 'view' AND e % 2 = 0 AND e % 6 <> 0) OR (y IN ('click', 'purchase', 'signup') AND e % 2 = 1)""")
def status_records(spark: SparkSession, t) -> DataFrame:
    """Which statuses are recorded, and as what (the records themselves are held against plain Python in the tests)."""
    return telemetry.status_records(_statuses(t)).select("seq", "kind")


@R.query("""WITH p AS (SELECT o_orderpriority AS run_id, year(o_orderdate)::BIGINT AS n, count(*) AS planned, count(*) FILTER (o_orderstatus = 'F') AS terminal FROM orders GROUP BY 1, 2),
g AS (SELECT *, greatest(planned - terminal, 0) AS gap, n = 1998 AS complete FROM p), l AS (SELECT *, lag(terminal) OVER w AS t0, lag(gap) OVER w AS g0, lag(n) OVER w AS n0 FROM g WINDOW w AS (PARTITION BY run_id ORDER BY n)),
m AS (SELECT *, 'terminal partitions ' || t0 || ' -> ' || terminal AS tm, 'non-terminal gap ' || g0 || ' -> ' || gap AS gm FROM l),
v AS (SELECT *, concat_ws('; ', CASE WHEN terminal > t0 THEN tm END, CASE WHEN gap < g0 THEN gm END) AS better, concat_ws('; ', CASE WHEN terminal < t0 THEN tm END, CASE WHEN gap > g0 THEN gm END) AS worse FROM m)
SELECT run_id, n AS pass_no, CASE WHEN complete THEN 'converging' WHEN n0 IS NULL OR (better <> '' AND worse <> '') THEN 'inconclusive' WHEN better <> '' THEN 'converging' ELSE 'not-converging' END AS verdict,
  CASE WHEN complete THEN 'planning completion confirmed on pass ' || n WHEN n0 IS NULL THEN 'first completed pass; need another completed pass before trend can be compared'
    WHEN better = '' AND worse = '' THEN 'terminal partitions stayed at ' || terminal || ' and non-terminal gap stayed at ' || gap || ' across passes ' || n0 || ' -> ' || n
    ELSE concat_ws('; ', nullif(better, ''), nullif(worse, '')) END AS evidence FROM v""")
def pass_summaries(spark: SparkSession, t) -> DataFrame:
    rows = t("orders").select(F.col("o_orderpriority").alias("run_id"), F.year("o_orderdate").cast("long").alias("pass_no"), "o_orderstatus")
    passes = rows.groupBy("run_id", "pass_no").agg(F.count("*").alias("planned"), F.count_if(F.col("o_orderstatus") == "F").alias("terminal"), F.count("*").alias("items"), F.lit(1).alias("depth"))
    return telemetry.pass_summaries(passes.withColumn("complete", F.col("pass_no") == 1998), _statuses(t)).select("run_id", "pass_no", "verdict", "evidence")


@R.query("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey AS item, CASE WHEN o_orderkey % 9 = n THEN 'exact' ELSE 'narrowest-provable' END AS provenance, o_orderkey % 9 AS item_count, n AS input_count FROM orders JOIN a USING (o_custkey)")
def failing_subsets(spark: SparkSession, t) -> DataFrame:
    rows = t("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("phase"), (F.col("o_orderkey") % 9).alias("item_count"))
    attempts = rows.groupBy("run_id").agg(F.count("*").alias("input_count"))
    return telemetry.failing_subset(rows, attempts).select(F.col("phase").alias("item"), "provenance", "item_count", "input_count")


# --- formats ---------------------------------------------------------------------------------------------

_HEAD = "CASE WHEN {0} <= 23 THEN 1 WHEN {0} <= 255 THEN 2 WHEN {0} <= 65535 THEN 3 WHEN {0} <= 4294967295 THEN 5 ELSE 9 END"


@R.query(f"""SELECT doc_id, {_HEAD.format('b')} + b AS text_size, {_HEAD.format('n')} + n * (4 + ({_HEAD.format('256')}) + 256 + 33) AS branch_size,
  1 + 15 + 1 + 18 + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 66 END + 8 + {_HEAD.format('n')} + b AS journal_size
FROM (SELECT doc_id, octet_length(encode(text)) AS b, n_chars AS n FROM documents)""")
def cbor_sizes(spark: SparkSession, t) -> DataFrame:
    previous = F.when(F.col("doc_id") % 2 == 1, F.sha2("source", 256))
    size = F.octet_length("text")
    return t("documents").select(
        "doc_id", formats.cbor_text_size(F.col("text")).cast("long").alias("text_size"), formats.branch_size(F.lit(64), F.col("n_chars"), F.lit(4)).cast("long").alias("branch_size"),
        formats.journal_body_size(F.col("n_chars"), size, previous).cast("long").alias("journal_size"),
    )


@R.query("""SELECT page_id, 'PartitionKey eq ' || chr(39) || 'refs' || chr(39) || ' and RowKey eq ' || chr(39) || lower(hex(encode(url))) || chr(39) AS lookup, split_part(url, '?', 1) || '/main.json' || CASE WHEN page_id % 2 = 0 THEN '?sig=a%2F' || page_id ELSE '' END AS address,
  split_part(url, '?', 1) || '/main.json' AS shown FROM (SELECT page_id, rtrim(split_part(url, '?', 1), '/') AS url FROM pages)""")
def ref_addresses(spark: SparkSession, t) -> DataFrame:
    base = F.rtrim(F.substring_index("url", "?", 1), F.lit("/"))
    container = F.when(F.col("page_id") % 2 == 0, F.concat(base, F.lit("/?sig=a%2F"), F.col("page_id").cast("string"))).otherwise(base)
    name = F.lit("main.json")
    return t("pages").select("page_id", formats.lookup_filter(F.lit("refs"), formats.ref_row_key(base)).alias("lookup"), formats.signed_url(container, name).alias("address"), formats.shown_url(container, name).alias("shown"))


@R.query(f"WITH {vectors._TREE}, {vectors._BEAM} SELECT q AS query_id, count(*) AS blocks, sum(n_bytes)::BIGINT AS bytes, count(DISTINCT level) AS levels FROM (SELECT DISTINCT q, b, level FROM touched) x JOIN {vectors._SIZE} z USING (b) GROUP BY q")
def query_totals(spark: SparkSession, t) -> DataFrame:
    tree, _, touched = vectors._beam(t)
    levels = search.level_access(touched, vectors._sizes(tree))
    return search.query_totals(levels).join(levels.groupBy("query_id").agg(F.count("*").alias("levels")), "query_id").select("query_id", "blocks", F.col("bytes").cast("long").alias("bytes"), "levels")


@R.query("SELECT count(*) AS queries, sum(v)::BIGINT AS total_micros, (sum(v) // count(*))::BIGINT AS mean_micros, max(v) AS max_micros FROM (SELECT floor(value * 1000)::BIGINT AS v FROM events)")
def elapsed_summary(spark: SparkSession, t) -> DataFrame:
    return search.elapsed_summary(t("events").select(F.col("event_id").alias("query_id"), F.floor(F.col("value") * 1000).alias("micros")))

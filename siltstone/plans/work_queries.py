"""Queries over journals, workflows, batches, telemetry and streams; and platform coverage (T rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.operators import journal, workflow
from siltstone.streaming import events as streams
from siltstone.streaming import stages

from .registry import Registry

R = Registry()

# --- journals and replay ---------------------------------------------------------------------------------

_REPLAY = "(SELECT sha256(text) AS block_id, sha256(lang || ':' || CASE WHEN doc_id % 37 = 0 THEN source ELSE '' END) AS digest FROM documents)"


def _replay(t) -> DataFrame:
    odd = F.when(F.col("doc_id") % 37 == 0, F.col("source")).otherwise("")
    return t("documents").select(F.sha2("text", 256).alias("block_id"), F.sha2(F.concat_ws(":", "lang", odd), 256).alias("digest"))


@R.query(f"SELECT DISTINCT block_id, digest FROM {_REPLAY}")
def replay_order(spark: SparkSession, t) -> DataFrame:
    return journal.replay_order(_replay(t))


@R.query(f"SELECT block_id, count(*) AS occurrences, min(digest) AS least, max(digest) AS greatest FROM {_REPLAY} GROUP BY block_id HAVING min(digest) <> max(digest)")
def replay_conflicts(spark: SparkSession, t) -> DataFrame:
    return journal.replay_conflicts(_replay(t))


_CHAIN = "(SELECT o_orderkey AS block_id, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous_block_id FROM orders)"


def _order_chain(t) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select(F.col("o_orderkey").alias("block_id"), "o_custkey", F.lag("o_orderkey").over(order).alias("previous_block_id"))


@R.query("SELECT o_orderkey AS block_id, last_value(o_orderkey) OVER w AS head_id, count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS steps FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def journal_chain(spark: SparkSession, t) -> DataFrame:
    """Each customer's orders as a chain of blocks, walked newest first from its head."""
    blocks = _order_chain(t)
    heads = blocks.select("block_id").join(blocks.select(F.col("previous_block_id").alias("block_id")), "block_id", "left_anti")
    return journal.chain(blocks, heads)


@R.query("""WITH RECURSIVE r AS (SELECT o_custkey AS journal, o_orderkey AS seq, length(o_orderpriority) + length(o_orderstatus) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
w AS (SELECT journal, seq, n, i, 0::BIGINT AS b, 8 + n AS used FROM r WHERE i = 1
  UNION ALL SELECT r.journal, r.seq, r.n, r.i, CASE WHEN used + r.n > 60 THEN b + 1 ELSE b END, CASE WHEN used + r.n > 60 THEN 8 + r.n ELSE used + r.n END FROM w JOIN r ON r.journal = w.journal AND r.i = w.i + 1)
SELECT journal, seq, n AS n_bytes, b AS block_seq FROM w""")
def journal_blocks(spark: SparkSession, t) -> DataFrame:
    """Greedy size-bounded blocks per journal (a customer's orders)."""
    rows = t("orders").select(F.col("o_custkey").alias("journal"), F.col("o_orderkey").alias("seq"), (F.char_length("o_orderpriority") + F.char_length("o_orderstatus")).cast("long").alias("n_bytes"))
    return journal.journal_blocks(rows, limit=60, overhead=8)


@R.query(f"SELECT block_id, previous_block_id FROM {_CHAIN} WHERE previous_block_id % 10 = 3")
def journal_gaps(spark: SparkSession, t) -> DataFrame:
    """Blocks whose predecessor was lost: every order whose key ends in 3 is taken away, but not what names it."""
    blocks = _order_chain(t)
    held = blocks.select("block_id", "previous_block_id")
    present = held.where("block_id % 10 <> 3").select(F.col("block_id").alias("previous_block_id"))
    return held.where("previous_block_id IS NOT NULL").join(present, "previous_block_id", "left_anti").select("block_id", "previous_block_id")


@R.query("SELECT floor((row_number() OVER (ORDER BY h) - 1) / 50)::BIGINT AS fragment, h AS block_id, CASE WHEN floor((row_number() OVER (ORDER BY h) - 1) / 50) = 0 THEN 777 ELSE 0 END AS input_block_count FROM (SELECT DISTINCT sha256(text) AS h FROM documents)")
def outcome_fragments(spark: SparkSession, t) -> DataFrame:
    ids = t("documents").select(F.sha2("text", 256).alias("block_id"))
    return journal.outcome_fragments(ids, 50, 777)


@R.query("SELECT doc_id, sha256(encode('text/plain') || '\\x00'::BLOB || encode(text)) AS input_hash FROM documents ANTI JOIN labels USING (doc_id)")
def missing_embeddings(spark: SparkSession, t) -> DataFrame:
    missing = t("documents").select("doc_id", "text").join(t("labels").select("doc_id"), "doc_id", "left_anti")
    return missing.select("doc_id", H.content_hash(F.lit("text/plain"), F.col("text")).alias("input_hash"))


@R.query("""SELECT lpad(doc_id::VARCHAR, 20, '0') AS key, CASE WHEN doc_id % 5 = 0 THEN 'inline:text/plain:[' || array_to_string(list_transform(string_split(source, ''), lambda c: ascii(c)), ', ') || ']'
  WHEN doc_id % 2 = 0 THEN 'document:' || source || '/' || doc_id ELSE 'email:' || source || ':' || lpad(doc_id::VARCHAR, 20, '0') END AS content_key FROM documents""")
def replay_sort_keys(spark: SparkSession, t) -> DataFrame:
    kind = F.when(F.col("doc_id") % 5 == 0, "inline").when(F.col("doc_id") % 2 == 0, "document").otherwise("email-chunk")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    key = journal.content_key(kind, path, F.col("source"), F.col("doc_id"), F.lit("text/plain"), F.col("source"))
    return t("documents").select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("key"), key.alias("content_key"))


@R.query("SELECT l_orderkey, l_linenumber, floor((row_number() OVER w - 1) / 3)::BIGINT AS batch_ix, floor((row_number() OVER w - 1) / 3)::BIGINT * 3 AS done_before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def batch_progress(spark: SparkSession, t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = journal.batches(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3)
    return out.select("l_orderkey", "l_linenumber", "batch_ix", "done_before")


# --- workflows and telemetry -----------------------------------------------------------------------------

_EVENT_STAGES = ("view", "click", "signup", "purchase", "error")


@R.query("SELECT work_id, CASE WHEN max(p) + max(c) = 2 THEN 'conflict' WHEN max(c) = 1 THEN 'completed' ELSE 'pending' END AS state FROM (SELECT user_id AS work_id, 1 AS p, 0 AS c FROM events WHERE event_type <> 'purchase' UNION ALL SELECT user_id, 0, 1 FROM events WHERE event_type = 'purchase') GROUP BY work_id")
def work_inventory(spark: SparkSession, t) -> DataFrame:
    rows = t("events").select(F.col("user_id").alias("work_id"), "event_type")
    return workflow.inventory(rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'"))


@R.query("SELECT DISTINCT work_id FROM (SELECT user_id AS work_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 400))")
def queued_work(spark: SparkSession, t) -> DataFrame:
    rows = t("events").select(F.col("user_id").alias("work_id"), "event_type", "value")
    done = rows.where("event_type = 'purchase' AND value > 400").select("work_id").distinct()
    return workflow.queue_work(rows.where("event_type = 'click'").distinct(), done, rows.where("event_type = 'view'"))


_RANK = "list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) - 1"


@R.query(f"SELECT user_id, max({_RANK})::BIGINT AS rank, count(*) AS checkpoints FROM events GROUP BY user_id")
def checkpoint_stage(spark: SparkSession, t) -> DataFrame:
    rows = t("events").select("user_id", workflow.rank_of(F.col("event_type"), _EVENT_STAGES).alias("rank"))
    return workflow.current_stage(rows, "user_id")


@R.query(f"SELECT event_id, rank > best AS advanced, rank < best AS regressed FROM (SELECT event_id, {_RANK} AS rank, coalesce(max({_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best FROM events)")
def checkpoint_moves(spark: SparkSession, t) -> DataFrame:
    rows = t("events").select("event_id", "user_id", "ts", workflow.rank_of(F.col("event_type"), _EVENT_STAGES).alias("rank"))
    return workflow.advance(rows, "user_id", ["ts", "event_id"]).select("event_id", "advanced", "regressed")


@R.query("""SELECT 'unknown-stage' AS rule, event_id AS key FROM events WHERE event_type NOT IN ('view', 'click', 'purchase') UNION ALL SELECT 'value-out-of-range', event_id FROM events WHERE value < 0 OR value > 300
UNION ALL SELECT 'missing-properties', event_id FROM events WHERE props IS NULL OR props NOT LIKE '{%}' UNION ALL SELECT 'unpaired-error', event_id FROM events WHERE event_type = 'error' AND value > 100""")
def journal_violations(spark: SparkSession, t) -> DataFrame:
    rules = {
        "unknown-stage": ~F.col("event_type").isin("view", "click", "purchase"),
        "value-out-of-range": (F.col("value") < 0) | (F.col("value") > 300),
        "missing-properties": F.col("props").isNull() | ~F.col("props").rlike(r"(?s)^\{.*\}$"),
        "unpaired-error": (F.col("event_type") == "error") & (F.col("value") > 100),
    }
    return workflow.violations(t("events"), rules, "event_id")


@R.query("""WITH p AS (SELECT date_diff('month', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS pass_no, count(*) AS planned, count(*) FILTER (o_orderstatus = 'F') AS terminal FROM orders GROUP BY 1),
g AS (SELECT *, greatest(planned - terminal, 0) AS gap FROM p), l AS (SELECT *, lag(terminal) OVER (ORDER BY pass_no) AS t0, lag(gap) OVER (ORDER BY pass_no) AS g0 FROM g)
SELECT pass_no, planned, terminal, gap, CASE WHEN t0 IS NULL THEN 'inconclusive' WHEN (terminal > t0 OR gap < g0) AND (terminal < t0 OR gap > g0) THEN 'inconclusive' WHEN terminal > t0 OR gap < g0 THEN 'converging' ELSE 'not-converging' END AS verdict FROM l""")
def pass_diagnosis(spark: SparkSession, t) -> DataFrame:
    date = F.col("o_orderdate")
    month = ((F.year(date) - 1970) * 12 + F.month(date) - 1).cast("long")
    passes = t("orders").groupBy(month.alias("pass_no")).agg(F.count("*").alias("planned"), F.count_if(F.col("o_orderstatus") == "F").alias("terminal"))
    return workflow.pass_diagnosis(passes)


@R.query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def status_changes(spark: SparkSession, t) -> DataFrame:
    return workflow.changed_only(t("events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@R.query("WITH r AS (SELECT l_returnflag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY l_returnflag), b AS (SELECT * FROM r WHERE l_returnflag = 'A') SELECT r.l_returnflag, r.n, r.quantity, r.n - b.n AS delta_n, r.quantity - b.quantity AS delta_quantity FROM r, b")
def baseline_delta(spark: SparkSession, t) -> DataFrame:
    rows = t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))
    base = rows.where("l_returnflag = 'A'").select(F.col("n").alias("n0"), F.col("quantity").alias("q0"))
    out = rows.crossJoin(F.broadcast(base))  # one row
    return out.select("l_returnflag", "n", "quantity", (F.col("n") - F.col("n0")).alias("delta_n"), (F.col("quantity") - F.col("q0")).alias("delta_quantity"))


# --- streams ---------------------------------------------------------------------------------------------


def _events(spark: SparkSession, t) -> DataFrame:
    """The events table as a stream of its files; the table is one file or a folder of files."""
    table = t("events")
    folder, _, name = table.inputFiles()[0].rpartition("/")
    one_file = not folder.endswith(".parquet")
    return streams.event_time(streams.file_stream(spark, folder, table.schema, glob=name if one_file else None), "ts")


@R.query("SELECT user_id, event_type, count(*) AS first_events FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY user_id, event_type")
def stream_dedup(spark: SparkSession, t) -> DataFrame:
    """Each event twice in the stream, once in the result."""
    stream = _events(spark, t)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = streams.available_now(streams.dedup_events(twice, ["event_id"]).select("event_id", "user_id", "event_type"))
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("first_events"))


@R.query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, t) -> DataFrame:
    out = streams.available_now(streams.tumbling(_events(spark, t), "ts", "1 hour", ["event_type"], "value"), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def stream_session(spark: SparkSession, t) -> DataFrame:
    out = streams.available_now(streams.sessions(_events(spark, t), "ts", "30 minutes", ["user_id"]), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# --- T rows: what the platform offers beyond the reference -------------------------------------------------


@R.query("SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def t_pricing_summary(spark: SparkSession, t) -> DataFrame:
    rows = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@R.query("SELECT n_name, o_orderstatus, grouping(n_name) + 2 * grouping(o_orderstatus) AS level, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, o_orderstatus)")
def t_order_cube(spark: SparkSession, t) -> DataFrame:
    joined = t("orders").select("o_custkey", "o_orderstatus").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    level = (F.grouping("n_name") + 2 * F.grouping("o_orderstatus")).cast("long")
    return joined.cube("n_name", "o_orderstatus").agg(level.alias("level"), F.count("*").alias("orders"))


@R.query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def t_idle_suppliers(spark: SparkSession, t) -> DataFrame:
    busy = t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return t("supplier").select("s_suppkey", "s_name").join(busy, "s_suppkey", "left_anti")


@R.query(f"""SELECT event_id, user_id, greatest({_RANK}, best)::BIGINT AS rank, n AS checkpoints, {_RANK} > best AS advanced, {_RANK} < best AS regressed FROM (SELECT *,
  coalesce(max({_RANK}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS best, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)""")
def stream_stage_moves(spark: SparkSession, t) -> DataFrame:
    """Stages of users as streaming state; all files are one batch, as they are not in order of time."""
    table = t("events")
    folder, _, name = table.inputFiles()[0].rpartition("/")
    stream = streams.file_stream(spark, folder, table.schema, files_per_batch=1_000_000, glob=None if folder.endswith(".parquet") else name)
    moves = stages.stage_moves(stream.select("event_id", "user_id", "ts", F.col("event_type").alias("stage")), "user_id", ["ts", "event_id"], {s: i for i, s in enumerate(_EVENT_STAGES)}, ["event_id"])
    return streams.available_now(moves).select("event_id", "user_id", "rank", "checkpoints", "advanced", "regressed")

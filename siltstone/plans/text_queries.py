"""Queries over texts and pages: normalisation, chunking, hashing, items, mail. SQL beside each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as X
from siltstone.operators import reports
from siltstone.sources import mail

from .registry import Registry

R = Registry()
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


@R.query(f"SELECT doc_id, {_collapsed('text')} AS normalized FROM documents")
def normalize_whitespace(spark: SparkSession, t) -> DataFrame:
    return t("documents").select("doc_id", X.collapse(F.col("text")).alias("normalized"))


@R.query(r"SELECT doc_id, length(x) AS chars, sha256(x) AS text_sha256 FROM (SELECT doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM documents)")
def line_endings(spark: SparkSession, t) -> DataFrame:
    out = X.line_feeds(F.col("text"))
    return t("documents").select("doc_id", F.char_length(out).cast("long").alias("chars"), F.sha2(out, 256).alias("text_sha256"))


@R.query("""
SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', ''), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') AS body FROM pages""")
def strip_html(spark: SparkSession, t) -> DataFrame:
    return t("pages").select("page_id", X.strip_html(F.col("html")).alias("body"))


_UNITS = (
    "SELECT doc_id, u, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit_ix FROM (SELECT doc_id, i, "
    + _collapsed("p[i]")
    + r" AS u FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])', '\1' || chr(1), 'g'), '\n[ \t\x0B\f\r\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*\n', chr(1), 'g'), chr(1)) AS p FROM documents))) WHERE u <> ''"
)


@R.query(f"SELECT doc_id, unit_ix, u AS unit FROM ({_UNITS})")
def sentence_units(spark: SparkSession, t) -> DataFrame:
    out = t("documents").select("doc_id", F.posexplode(X.sentence_units(F.col("text"))).alias("unit_ix", "unit"))
    return out.select("doc_id", F.col("unit_ix").cast("long").alias("unit_ix"), "unit")


@R.query(f"""WITH RECURSIVE u AS MATERIALIZED ({_UNITS}),
w AS (SELECT doc_id, unit_ix, 0 AS c, u AS open FROM u WHERE unit_ix = 0
  UNION ALL SELECT u.doc_id, u.unit_ix, CASE WHEN length(open) + 1 + length(u.u) <= {X.CHUNK_CHARS} THEN c ELSE c + 1 END,
    CASE WHEN length(open) + 1 + length(u.u) <= {X.CHUNK_CHARS} THEN open || ' ' || u.u ELSE u.u END FROM w JOIN u ON u.doc_id = w.doc_id AND u.unit_ix = w.unit_ix + 1)
SELECT doc_id, c AS chunk_index, arg_max(open, unit_ix) AS chunk FROM w GROUP BY doc_id, c
UNION ALL SELECT doc_id, 0, {_collapsed('text')} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u)""")
def chunk_documents(spark: SparkSession, t) -> DataFrame:
    """Greedy packing carries state from unit to unit."""
    return t("documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_index", "chunk"))


@R.query(f"SELECT doc_id, count(*) AS units, sum(length(u))::BIGINT AS unit_chars, max(length(u))::BIGINT AS longest FROM ({_UNITS}) GROUP BY doc_id")
def chunk_stats(spark: SparkSession, t) -> DataFrame:
    units = t("documents").select("doc_id", F.explode(X.sentence_units(F.col("text"))).alias("u"))
    return units.groupBy("doc_id").agg(F.count("*").alias("units"), F.sum(F.char_length("u")).alias("unit_chars"), F.max(F.char_length("u")).cast("long").alias("longest"))


@R.query()
def email_core(spark: SparkSession, t) -> DataFrame:
    """Line-by-line state; held against plain Python in the tests."""
    rows = t("conversations")
    core = X.email_core(F.col("text"))
    return rows.select("conv_id", "turn", X.body_or_subject(core, F.lit(None).cast("string")).alias("body"))


@R.query("SELECT h AS input_hash, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(encode('text/plain') || '\\x00'::BLOB || encode(text)) AS h FROM documents) GROUP BY h")
def content_hash_dedup(spark: SparkSession, t) -> DataFrame:
    hashed = t("documents").select("doc_id", H.content_hash(F.lit("text/plain"), F.col("text")).alias("input_hash"))
    return hashed.groupBy("input_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@R.query("""
SELECT doc_id, kind, CASE kind WHEN 'document' THEN sha256('document:' || source || '/' || doc_id) WHEN 'email-chunk' THEN sha256('email-chunk:' || sha256(source) || ':' || doc_id)
  ELSE sha256(encode('text/plain') || '\\x00'::BLOB || encode(text)) END AS fingerprint,
  CASE kind WHEN 'document' THEN 'document:' || source || '/' || doc_id WHEN 'email-chunk' THEN 'email-chunk:' || sha256(source) || ':' || doc_id ELSE 'inline:text/plain:' || sha256(text) END AS logical_id
FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'email-chunk' ELSE 'inline' END AS kind FROM documents)""")
def fingerprints(spark: SparkSession, t) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "document").when(F.col("doc_id") % 3 == 1, "email-chunk").otherwise("inline")
    rows = t("documents").withColumn("kind", kind)
    parts = (F.col("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.lit("text/plain"), F.col("text"), F.sha2("source", 256), F.col("doc_id"))
    return rows.select("doc_id", "kind", H.fingerprint(*parts).alias("fingerprint"), H.logical_id(*parts).alias("logical_id"))


@R.query("""
SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS ref, length(text) AS chars, replace(source, '\\', '/') AS source_path FROM documents
UNION ALL SELECT 'email-chunk', conv_id || ':' || turn, length(text), 'conversations/' || conv_id FROM conversations""")
def union_items(spark: SparkSession, t) -> DataFrame:
    docs = t("documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("ref"), F.char_length("text").cast("long").alias("chars"), X.slash_path(F.col("source")).alias("source_path"))
    mails = t("conversations").select(F.lit("email-chunk"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.char_length("text").cast("long"), F.concat(F.lit("conversations/"), F.col("conv_id").cast("string")))
    return docs.union(mails)


@R.query("""
SELECT source, count(*) AS entries, sum(n_chars)::BIGINT AS total_chars,
  sha256('table:documents/' || source || '|' || count(*) || '|' || sum(('0x' || substr(h, 1, 15))::HUGEINT) || '|' || sum(('0x' || substr(h, 16, 15))::HUGEINT) || '|' || sum(('0x' || substr(h, 31, 15))::HUGEINT) || '|' || sum(('0x' || substr(h, 46, 15))::HUGEINT)) AS source_snapshot_id
FROM (SELECT source, n_chars, sha256(doc_id || ':' || sha256(text) || ':' || n_chars) AS h FROM documents) GROUP BY source""")
def snapshot_manifest(spark: SparkSession, t) -> DataFrame:
    digest = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256), F.col("n_chars").cast("string")), 256)
    sums = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    rows = t("documents").select("source", "n_chars", digest.alias("h")).groupBy("source").agg(F.count("*").alias("entries"), F.sum("n_chars").alias("total_chars"), *sums)
    body = F.concat_ws("|", F.concat(F.lit("table:documents/"), F.col("source")), F.col("entries").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(4)))
    return rows.select("source", "entries", "total_chars", F.sha2(body, 256).alias("source_snapshot_id"))


@R.query("""
SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, lower(hex(encode(url))) AS row_key,
  regexp_replace(split_part(url, '?', 1), '/v1/embeddings/?$', '') AS base_url, replace(url, '''', '''''') AS odata FROM pages""")
def url_refs(spark: SparkSession, t) -> DataFrame:
    url = F.col("url")
    return t("pages").select(
        "page_id", "url", F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.lower(F.hex(url)).alias("row_key"),
        F.regexp_replace(F.substring_index(url, "?", 1), "/v1/embeddings/?$", "").alias("base_url"), F.replace(url, F.lit("'"), F.lit("''")).alias("odata"),
    )


@R.query("""
WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size || '.x.' || p_partkey ELSE p_size % 7 || '.' || p_size || '.' || p_partkey END AS version FROM part)
SELECT p_partkey, version, CASE WHEN regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN split_part(version, '.', 1)::BIGINT ELSE -1 END AS major,
  CASE WHEN regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN split_part(version, '.', 2)::BIGINT ELSE -1 END AS minor,
  CASE WHEN regexp_full_match(version, '[0-9]+\\.[0-9]+\\.[0-9]+') THEN split_part(version, '.', 3)::BIGINT ELSE -1 END AS patch FROM v""")
def version_parse(spark: SparkSession, t) -> DataFrame:
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    good = F.concat_ws(".", (F.col("p_size") % 7).cast("string"), size, key)
    rows = t("part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(".", size, F.lit("x"), key)).otherwise(good).alias("version"))
    return rows.withColumn("v", H.version_parts(F.col("version"))).select("p_partkey", "version", *(F.coalesce(f"v.{n}", F.lit(-1)).alias(n) for n in ("major", "minor", "patch")))


@R.query("""
SELECT p_partkey, lower(h) AS block_id FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(sha256(p_name)) WHEN p_partkey % 4 = 1 THEN substr(sha256(p_name), 2) ELSE sha256(p_name) END AS h FROM part)
WHERE regexp_full_match(h, '[0-9a-fA-F]{64}')""")
def hex_codec(spark: SparkSession, t) -> DataFrame:
    digest, key = F.sha2("p_name", 256), F.col("p_partkey") % 4
    text = F.when(key == 0, F.upper(digest)).when(key == 1, F.substring(digest, 2, 63)).otherwise(digest)
    rows = t("part").select("p_partkey", H.valid_hash(text).alias("id")).where("id IS NOT NULL")
    return rows.select("p_partkey", F.lower(F.hex(F.unhex("id"))).alias("block_id"))


@R.query("""
SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, 'document' AS media_kind, source AS source_kind_name, coalesce(nullif(lang, ''), source) AS lang_or_source,
  text FROM documents""")
def search_projection(spark: SparkSession, t) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy("doc_id")
    return t("documents").select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("position"), F.lit("document").alias("media_kind"), F.col("source").alias("source_kind_name"),
        F.coalesce(F.nullif("lang", F.lit("")), "source").alias("lang_or_source"), "text",
    )


@R.query("""
SELECT doc_id AS position, sha256('leaf' || doc_id % 7) AS leaf_block_id, 'text/plain' AS media_type, coalesce(text, '') AS text, source_kind, source_path, source_name, CAST(n AS BIGINT) AS n_metadata
FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'email' ELSE 'document' END AS source_kind, source || '/' || doc_id AS source_path,
  CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'mail ' || doc_id WHEN doc_id % 5 = 0 THEN lang END AS source_name,
  2 + (CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS n FROM documents)""")
def search_hits(spark: SparkSession, t) -> DataFrame:
    """Leaf entries with binary bodies and metadata maps as hits: text, and the source's kind, path and name, which a subject is not."""
    mail, key = F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")
    pairs = {
        "source_kind": F.when(mail, "email").otherwise("document"), "source_path": F.concat_ws("/", "source", key), "email_subject": F.when(mail, F.concat(F.lit("about "), key)),
        "email_name": F.when(mail & (F.col("doc_id") % 3 == 0), F.concat(F.lit("mail "), key)), "name": F.when(F.col("doc_id") % 5 == 0, F.col("lang")),
    }
    metadata = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    leaf = F.sha2(F.concat(F.lit("leaf"), (F.col("doc_id") % 7).cast("string")), 256)
    entries = t("documents").select(F.col("doc_id").alias("position"), leaf.alias("block_id"), F.lit("text/plain").alias("media_type"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), metadata.alias("metadata"))
    return reports.search_hits(entries).select("*", F.size("metadata").cast("long").alias("n_metadata")).drop("metadata")


@R.query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 's' || doc_id WHEN doc_id % 5 = 1 THEN 'd' || doc_id WHEN doc_id % 5 = 2 THEN 'e' || doc_id WHEN doc_id % 5 = 3 THEN source END AS source_name FROM documents""")
def source_name(spark: SparkSession, t) -> DataFrame:
    """The first of five metadata keys that is present."""
    key, r = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    pairs = [("name", F.when(r == 3, F.col("source"))), ("email_name", F.when(r <= 2, F.concat(F.lit("e"), key))), ("document_name", F.when(r <= 1, F.concat(F.lit("d"), key))), ("source_name", F.when(r == 0, F.concat(F.lit("s"), key)))]
    m = F.map_filter(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    names = ("source_name", "document_name", "email_name", "thread_name", "name")
    return t("documents").select("doc_id", m.alias("m")).select("doc_id", F.coalesce(*(F.try_element_at("m", F.lit(n)) for n in names)).alias("source_name"))


@R.query("""
SELECT conv_id, turn, trim('Turn ' || coalesce(turn::VARCHAR, '')) AS email_subject, nullif(role, '') AS email_from, length(coalesce(text, '')) > 0 AS has_text, sha256(coalesce(text, '')) AS raw_body_sha256 FROM conversations""")
def mail_messages(spark: SparkSession, t) -> DataFrame:
    """Every turn as a MIME message and back: headers and body survive the parser; what is null is empty."""
    turns = t("conversations").select("conv_id", "turn", F.coalesce(F.col("turn").cast("string"), F.lit("")).alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.concat(F.lit("Subject: Turn "), F.col("n"), F.lit("\nFrom: "), F.col("role"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64("text"))
    rows = turns.select("conv_id", "turn", mail.parse_message(F.encode(raw, "UTF-8")).alias("m"))
    return rows.select("conv_id", "turn", F.col("m.subject").alias("email_subject"), F.col("m.sender").alias("email_from"), (F.char_length("m.body") > 0).alias("has_text"), F.sha2("m.body", 256).alias("raw_body_sha256"))

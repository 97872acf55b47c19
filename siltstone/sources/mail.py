"""Mailboxes and text documents to index items.

MIME parsing is the one step that leaves the JVM: the standard library's email
parser in a pandas UDF. Splitting, cleaning, chunking and naming are native.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.hashing import content_hash
from siltstone.operators import store

from .mailbox import mailbox_messages, read_mailboxes

_PARSED = "headers array<struct<name:string,value:string>>, to string, cc string, list_id string, subject string, sender string, date string, message_id string, body string, html boolean"


def files(spark: SparkSession, path: str, *suffixes: str) -> DataFrame:
    """``path, length, content`` of files with one of the suffixes, in any case, below ``path``; Spark lists no empty files."""
    either = "{" + ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", either).load(path)  # no other file is opened
    return found.select("path", "length", "content")


def split_mailbox(mailboxes: DataFrame) -> DataFrame:
    """``path, mailbox_ref, message_index, raw`` of mailboxes that are held whole (``content``); files are read by :mod:`siltstone.sources.mailbox`."""
    latin = F.decode("content", "ISO-8859-1")  # one character per byte: no byte is lost
    parts = F.filter(F.split(latin, r"(?md)^From [^\n]*\n?", -1), lambda m: m != "")
    ref = F.sha2("content", 256)
    return mailboxes.select("path", ref.alias("mailbox_ref"), F.posexplode(parts).alias("message_index", "part")).select("path", "mailbox_ref", "message_index", F.encode("part", "ISO-8859-1").alias("raw"))


def _body(message) -> tuple[str, bool]:
    """First text/plain part depth first, else the first text/html part (to be stripped); a single part as it is."""
    if not message.is_multipart():
        return _text(message), False
    leaves = [p for p in message.walk() if not p.is_multipart()]
    for kind in ("text/plain", "text/html"):
        for part in leaves:
            if part.get_content_type() == kind:
                return _text(part), kind == "text/html"
    return "", False


def _text(part) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", "replace")


def parse_message(raw: Column | str) -> Column:
    """Header fields and preferred body of a MIME message (binary)."""
    return F.pandas_udf(_parse, _PARSED)(raw)


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    from email import message_from_bytes
    from email.header import decode_header, make_header

    def header(value) -> str:
        try:
            return str(make_header(decode_header(str(value))))
        except (LookupError, UnicodeDecodeError, ValueError):
            return str(value)

    for raws in batches:
        rows = []
        for raw in raws:
            message = message_from_bytes(raw)
            pairs = [(name, " ".join(header(value).split())) for name, value in message.items()]
            first: dict[str, str] = {}
            for name, value in pairs:
                first.setdefault(name.lower(), value)
            body, html = _body(message)
            rows.append(([{"name": n, "value": v} for n, v in pairs], *(first.get(k) for k in ("to", "cc", "list-id")), *(first.get(k) or None for k in ("subject", "from", "date", "message-id")), body, html))
        yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in ("headers", "to", "cc", "list_id", "subject", "sender", "date", "message_id", "body", "html")])


def normalise(messages: DataFrame) -> DataFrame:
    """Messages with their header fields, recipient context and normalised ``body``."""
    rows = messages.withColumn("m", parse_message("raw"))
    body = F.when(F.col("m.html"), X.strip_html(F.col("m.body"))).otherwise(F.col("m.body"))
    rows = rows.select("path", "mailbox_ref", "message_index", "m.headers", "m.subject", "m.sender", "m.date", "m.message_id", X.recipient_context(F.col("m.to"), F.col("m.cc"), F.col("m.list_id")).alias("recipient_context"), X.email_core(body).alias("core"))
    whole = rows.withColumn("body", X.body_or_subject(F.col("core"), F.col("subject"))).drop("core")
    canonical = F.to_json(F.struct(F.lit(1).alias("schema_version"), "headers", "subject", "sender", "recipient_context", "date", "message_id", "body"))
    return whole.withColumn("email_ref", F.sha2(canonical, 256))


def chunk_items(emails: DataFrame) -> DataFrame:
    """One index item per chunk, with its metadata map; absent email fields are left out of the map."""
    each = emails.select("*", F.posexplode(X.chunks(F.col("body"))).alias("chunk_index", "text"))
    locator = F.concat_ws(":", "email_ref", F.col("chunk_index").cast("string"))
    pairs = {
        "source_kind": F.lit("email"), "source_path": X.slash_path(F.col("path")), "mailbox_artifact_ref": F.col("mailbox_ref"), "email_artifact_ref": F.col("email_ref"),
        "mailbox_message_index": F.col("message_index").cast("string"), "chunk_index": F.col("chunk_index").cast("string"), "chunk_locator": locator,
        "email_subject": F.col("subject"), "email_name": F.col("subject"), "email_from": F.col("sender"),
        "email_recipient_context": F.col("recipient_context"), "email_date": F.col("date"), "email_message_id": F.col("message_id"),
    }
    metadata = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())
    return each.select(F.lit("email-chunk").alias("kind"), "path", "email_ref", "chunk_index", "text", metadata.alias("metadata"), content_hash(F.lit("text/plain"), F.col("text")).alias("input_hash"))


#: How normalised emails are stored (fixed values of the format).
EMAIL_TYPE, EMAIL_MEDIA_TYPE, EMAIL_VERSION = "normalised-email", "application/json", 1


def email_artifacts(emails: DataFrame) -> DataFrame:
    """Normalised emails as typed artifacts: ``block_id`` is the email's reference, ``body`` its text."""
    return emails.select(
        F.col("email_ref").alias("block_id"), F.lit(EMAIL_TYPE).alias("type_name"), F.lit(EMAIL_MEDIA_TYPE).alias("media_type"), F.lit(EMAIL_VERSION).alias("schema_version"),
        F.col("body").cast("binary").alias("body"), F.col("mailbox_ref").alias("mailbox_artifact_ref"),
    )


def resolve_chunks(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """``items`` (``email_ref, chunk_index``) with the ``text`` that their email's artifact gives when it is chunked again.

    Each artifact is chunked once. A missing artifact, another media type or version, or a chunk that is not there fails the job.
    """
    bodies = store.readable_artifacts(artifacts, EMAIL_TYPE, EMAIL_MEDIA_TYPE, EMAIL_VERSION)
    cut = bodies.select("block_id", X.chunks(F.decode("body", "UTF-8")).alias("chunks")).withColumnRenamed("block_id", "email_ref")
    joined = items.drop("text").join(cut, "email_ref", "left")
    missing = F.raise_error(F.concat(F.lit("missing artifact: "), F.col("email_ref"))).cast("string")
    outside = F.raise_error(F.concat(F.lit("no chunk "), F.col("chunk_index").cast("string"), F.lit(" in "), F.col("email_ref"))).cast("string")
    text = F.when(F.col("chunks").isNull(), missing).otherwise(F.coalesce(F.get("chunks", F.col("chunk_index")), outside))
    return joined.withColumn("text", text).drop("chunks")


def mailbox_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of all mailboxes (``.mail``, ``.mbox``) below ``path``; empty mailboxes give none."""
    return chunk_items(normalise(mailbox_messages(spark, path)))


def mailbox_counts(spark: SparkSession, path: str) -> DataFrame:
    """``path, month, messages``; the month is the file's name without its suffix."""
    return read_mailboxes(spark, path, "digests").select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("month"), "messages")


def document_items(spark: SparkSession, path: str) -> DataFrame:
    """One item per ``.txt`` file below ``path``; bytes that are no UTF-8 become U+FFFD."""

    @F.pandas_udf("string")
    def lossy(raws: pd.Series) -> pd.Series:
        return raws.map(lambda b: b.decode("utf-8", "replace"))

    rows = files(spark, path, "txt").select("path", lossy("content").alias("text"))
    metadata = F.create_map(F.lit("source_kind"), F.lit("document"), F.lit("source_path"), X.slash_path(F.col("path")))
    return rows.select(F.lit("document").alias("kind"), "path", F.lit(None).cast("string").alias("email_ref"), F.lit(None).cast("int").alias("chunk_index"), "text", metadata.alias("metadata"), content_hash(F.lit("text/plain"), F.col("text")).alias("input_hash"))


def inline_items(rows: DataFrame) -> DataFrame:
    """One item per row of ``body`` (text) and ``metadata``: content that is given with a request, not in a file. A null body is empty."""
    text = F.coalesce(rows["body"].cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    return rows.select(F.lit("inline").alias("kind"), none.alias("path"), none.alias("email_ref"), F.lit(None).cast("int").alias("chunk_index"), text.alias("text"), rows["metadata"], content_hash(F.lit("text/plain"), text).alias("input_hash"))


def all_items(spark: SparkSession, documents: str | None, mailboxes: str | None) -> DataFrame:
    """Documents, then mailbox chunks."""
    parts = [f(spark, p) for f, p in ((document_items, documents), (mailbox_items, mailboxes)) if p]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``relative_path, block_id, byte_length`` of every file below ``path``, symlinks and special files aside."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/") + "/"
    relative = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    return found.select(F.substr(relative, F.lit(len(root) + 1)).alias("relative_path"), F.sha2("content", 256).alias("block_id"), F.col("length").alias("byte_length"))


def snapshot_id(entries: DataFrame, source_uri: str) -> DataFrame:
    """One row: ``source_snapshot_id, entries``. The id hashes the source, the number of entries and four sums over
    the entries' SHA-256 digests, so it does not depend on order and no task sees more than its own entries."""
    digest = F.sha2(F.concat_ws(":", "relative_path", "block_id", F.col("byte_length").cast("string")), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    sums = entries.select(digest.alias("h")).agg(F.count("*").alias("entries"), *parts)
    body = F.concat_ws("|", F.lit(source_uri), F.col("entries").cast("string"), *(F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)))
    return sums.select(F.sha2(body, 256).alias("source_snapshot_id"), "entries")

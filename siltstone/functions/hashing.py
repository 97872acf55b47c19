"""Content hashes, fingerprints and the identifiers built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(media_type: Column, body: Column) -> Column:
    """SHA-256 of media type, a zero byte and the body."""
    return F.sha2(F.concat(media_type.cast("binary"), F.unhex(F.lit("00")), body.cast("binary")), 256)


def fingerprint(kind: Column, path: Column, media_type: Column, body: Column, artifact_ref: Column, chunk_index: Column) -> Column:
    """Identity of a content reference, by its kind."""
    return (
        F.when(kind == "document", F.sha2(F.concat(F.lit("document:"), path), 256))
        .when(kind == "email-chunk", F.sha2(F.concat_ws(":", F.lit("email-chunk"), artifact_ref, chunk_index.cast("string")), 256))
        .otherwise(content_hash(media_type, body))
    )


def logical_id(kind: Column, path: Column, media_type: Column, body: Column, artifact_ref: Column, chunk_index: Column) -> Column:
    return (
        F.when(kind == "document", F.concat(F.lit("document:"), path))
        .when(kind == "email-chunk", F.concat_ws(":", F.lit("email-chunk"), artifact_ref, chunk_index.cast("string")))
        .otherwise(F.concat_ws(":", F.lit("inline"), media_type, F.sha2(body.cast("binary"), 256)))
    )


def seed_bytes(seed: int) -> Column:
    """An unsigned 64-bit seed as eight little-endian bytes."""
    return F.unhex(F.lit(seed.to_bytes(8, "little").hex()))


def sample_key(seed: int, entry_id: Column) -> Column:
    return F.sha2(F.concat(seed_bytes(seed), entry_id.cast("string").cast("binary")), 256)


def choice(digest_hex: Column, n: Column) -> Column:
    """The digest's first eight bytes as a little-endian number, modulo ``n``."""
    big_endian = F.concat(*(F.substring(digest_hex, i, 2) for i in range(15, 0, -2)))
    return (F.conv(big_endian, 16, 10).cast("decimal(20,0)") % n.cast("decimal(20,0)")).cast("long")


def valid_hash(text: Column) -> Column:
    """Lower-case form of 64 hex digits, else null."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.lower(text))


def version_parts(text: Column) -> Column:
    """``major, minor, patch`` of a strict three-part version, else null."""
    parts = F.split(text, r"\.", -1)
    return F.when(text.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.struct(*(F.get(parts, i).try_cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch")))))

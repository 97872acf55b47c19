"""Sizes and names of the stored formats, without encoding anything: CBOR heads, reference keys and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A CBOR head takes one byte up to this argument, then 2, 3, 5 or 9 (fixed values of the format).
_HEADS = ((23, 1), (0xFF, 2), (0xFFFF, 3), (0xFFFFFFFF, 5))


def cbor_head_size(argument: Column) -> Column:
    """Bytes of the head that carries a length, a count or an unsigned number."""
    out = F.lit(9)
    for most, size in reversed(_HEADS):
        out = F.when(argument <= most, size).otherwise(out)
    return out


def cbor_text_size(text: Column) -> Column:
    size = F.octet_length(text)
    return cbor_head_size(size) + size


def cbor_bytes_size(size: Column) -> Column:
    return cbor_head_size(size) + size


def branch_size(dims: Column, entries: Column, encoding_bytes: Column) -> Column:
    """Bytes of a branch block's entries: per entry a map of two fields, the vector and a 32-byte child id."""
    entry = F.lit(1) + 1 + cbor_bytes_size(dims * encoding_bytes) + 1 + cbor_bytes_size(F.lit(32))
    return cbor_head_size(entries) + entries * entry


def journal_body_size(records: Column, record_bytes: Column, previous: Column) -> Column:
    """Bytes of a journal block's body: a map of version, predecessor (text or null) and the array of encoded records."""
    field = lambda name: F.lit(1 + len(name))  # noqa: E731  names are shorter than 24 bytes
    link = F.when(previous.isNull(), F.lit(1)).otherwise(cbor_text_size(previous))
    return F.lit(1) + field("schema_version") + 1 + field("previous_block_id") + link + field("entries") + cbor_head_size(records) + record_bytes


def ref_row_key(path: Column) -> Column:
    """A reference's path as a table key: lower-case hex of its bytes."""
    return F.lower(F.hex(path.cast("binary")))


def quoted(text: Column) -> Column:
    """Text inside single quotes of a table filter: quotes are doubled."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def lookup_filter(partition_key: Column, row_key: Column) -> Column:
    return F.concat(F.lit("PartitionKey eq "), quoted(partition_key), F.lit(" and RowKey eq "), quoted(row_key))


def signed_url(container: Column, name: Column) -> Column:
    """A name below a container's address; the signature (its query) stays last."""
    base, query = F.rtrim(F.substring_index(container, "?", 1), F.lit("/")), F.when(F.instr(container, "?") > 0, F.substr(container, F.instr(container, "?")))
    return F.concat(base, F.lit("/"), name, F.coalesce(query, F.lit("")))


def shown_url(container: Column, name: Column) -> Column:
    """The same address without its signature, for messages."""
    return F.concat(F.rtrim(F.substring_index(container, "?", 1), F.lit("/")), F.lit("/"), name)


def joined_metadata(kind: Column, path: Column, user: Column) -> Column:
    """Metadata of an item: where it comes from, under what the user says (whose value wins for an equal key), keys in order."""
    own = F.create_map(F.lit("source_kind"), kind, F.lit("source_path"), F.translate(path, "\\", "/"))
    given = F.coalesce(user, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(own, lambda k, v: ~F.map_contains_key(given, k))
    return F.map_from_entries(F.array_sort(F.concat(F.map_entries(rest), F.map_entries(given))))

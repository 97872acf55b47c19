"""Text normalisation, sentence units and chunking as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_CHARS = 1000
EMPTY_BODY = "(empty email body)"


def collapse(text: Column) -> Column:
    """Runs of Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trim_all(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def line_feeds(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_html(html: Column) -> Column:
    """Without tags (an unclosed one eats the rest) and stray ``>``; four entities, ``&amp;`` before ``&lt;``."""
    out = F.replace(F.regexp_replace(html, r"<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def sentence_units(text: Column) -> Column:
    """Units closed by ``.``, ``!``, ``?`` or a line of nothing but white space; white space collapsed; empty ones dropped."""
    parts = F.split(text, r"(?U)(?<=[.!?])|\n[^\S\n]*\n", -1)
    return F.filter(F.transform(parts, collapse), lambda u: u != "")


def pack_units(units: Column, limit: int = CHUNK_CHARS) -> Column:
    """Greedy chunks of at most ``limit`` code points, joined by one blank; a longer unit stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, unit: Column) -> Column:
        fits = F.char_length(acc["open"]) + 1 + F.char_length(unit) <= limit
        first = acc["open"] == ""
        return F.struct(
            F.when(first | fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"),
            F.when(first, unit).when(fits, F.concat_ws(" ", acc["open"], unit)).otherwise(unit).alias("open"),
        )

    return F.aggregate(units, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def chunks(body: Column, limit: int = CHUNK_CHARS) -> Column:
    """Chunks of a normalised body; without units, the trimmed body is the only chunk."""
    units = sentence_units(body)
    return F.when(F.size(units) == 0, F.array(trim_all(body))).otherwise(pack_units(units, limit))


def email_core(body: Column) -> Column:
    """Lines trimmed, quotes dropped, blank runs collapsed, cut at a reply intro or a signature."""
    lines = F.transform(F.split(line_feeds(body), "\n", -1), trim_all)

    def ends(line: Column) -> Column:
        low = F.lower(line)
        return (low.startswith("on ") & low.endswith(" wrote:")) | (line == "--") | line.startswith("-- ")

    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        over = acc["over"] | ends(line)
        again = (line == "") & (F.coalesce(F.try_element_at(acc["kept"], F.lit(-1)), F.lit("")) == "")
        skip = over | line.startswith(">") | again
        return F.struct(over.alias("over"), F.when(skip, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line))).alias("kept"))

    return trim_all(F.array_join(F.aggregate(lines, start, step, lambda acc: acc["kept"]), "\n"))


def body_or_subject(core: Column, subject: Column) -> Column:
    """The body an email is indexed by: its core, else its subject, else a fixed note."""
    return F.coalesce(F.nullif(core, F.lit("")), F.nullif(subject, F.lit("")), F.lit(EMPTY_BODY))


def recipient_context(to: Column, cc: Column, list_id: Column) -> Column:
    """The first header that is present; an empty ``To`` therefore hides ``Cc``."""
    return F.nullif(collapse(F.coalesce(to, cc, list_id)), F.lit(""))


def slash_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")

"""Personal data: base patterns, then information-theoretic sanitisation. DataFrame functions only.

Base spans (email, ip, card, phone) are the protected entities, each by its
value and by what the value belongs to (an address's domain, a network, a
card's issuer, a dialling area). The method then asks which ordinary terms
(words of letters and digits outside base spans, lower-cased) give such an
entity away. Over the N different texts of the whole corpus, with n(x) of them
holding x,

    disclosure(t, e) = PMI(t; e) / IC(e) = log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e)),

which is 1 when t occurs only with e. A pair seen in ``MIN_TEXTS`` different
texts (one text is no co-occurrence to estimate from) with a disclosure of
``THRESHOLD`` or more makes every occurrence of t, in the texts that hold e, a
span of kind ``term``. ``sanitise`` generalises each span to its kind.

Plan: the patterns run as a narrow projection; only documents with an entity
are written out. A pair can only reach the threshold if
``n(t) <= n(e) (N / n(e)) ** (1 - threshold)``, so words meet the corpus counts
before they meet entities, and frequent words pair with none. Entities of the
same set of texts are one class and counted once. A text of many words that has
many entities is not paired with all of them: pairs are looked for in the other
texts of each class first (:func:`_occurrences`).

Edge cases: null or empty text has no spans; copies and repeated rows get equal
results and count as one text in all four counts; null ids are kept; an empty
table gives an empty result. Positions are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, texts_of

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns; possessive and with look-behinds, so that a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth running.
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
WORD = r"[\p{L}\p{N}]++"
MIN_TEXTS = 2
THRESHOLD = 0.9
_SPAN = "array<struct<start:int,kind_no:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """``array<struct<start, end, value>>`` of the pattern's leftmost non-overlapping matches; with ``wanted``, of its values in any case."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda hit, gap: F.struct(F.char_length(gap).alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        first = acc["at"] + pair["gap"]
        last = first + F.char_length(pair["hit"])
        found = F.struct(first.alias("start"), last.alias("end"), pair["hit"].alias("value"))
        out = F.concat(acc["out"], F.array(found))
        if wanted is not None:
            out = F.when(F.array_contains(wanted, F.lower(pair["hit"])), out).otherwise(acc["out"])
        return F.struct(last.alias("at"), out.alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _holds(kind: str, value: Column) -> Column:
    """The contract's filter on a match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        digits = F.translate(value, " -", "")
        return F.char_length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _kind_spans(text: Column, number: int, kind: str) -> Column:
    found = F.filter(_matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"], F.lit(number).alias("kind_no"), m["end"], m["value"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    parts = []
    for number, kind in enumerate(KINDS[:4]):
        parts.append(F.when(text.rlike(_NEEDS[kind]), _kind_spans(text, number, kind)).otherwise(F.array().cast(_SPAN)))
    return F.array_sort(F.concat(*parts))


def _scanned(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Each row with its base spans and the 128 bits ``k1, k2`` that stand for its text."""
    text = F.coalesce("text", F.lit(""))
    rows = texts_of(docs, carry).select("doc_id", F.xxhash64(text, F.lit(7)).alias("k1"), F.xxhash64(F.lit(11), text).alias("k2"), text.alias("text"), *(["carried"] if carry else []))
    return rows.withColumn("base", F.when(F.col("text").rlike("[0-9@]"), base_spans(F.col("text"))).otherwise(F.array().cast(_SPAN)))


def _entities() -> Column:
    """What the base spans of a text protect: ``kind:value`` and ``kind/group`` of each, the kind by its number."""

    def of(s: Column) -> Column:
        value, digits = F.lower(s["value"]), F.regexp_replace(s["value"], "[^0-9]", "")
        group = F.when(s["kind_no"] == 0, F.substring_index(value, "@", -1)).when(s["kind_no"] == 1, F.substring_index(value, ".", 3))
        group = group.when(s["kind_no"] == 2, F.left(digits, F.lit(6))).otherwise(F.left(digits, F.lit(4)))
        return F.array(F.concat(s["kind_no"], F.lit(":"), value), F.concat(s["kind_no"], F.lit("/"), group))

    return F.array_distinct(F.flatten(F.transform("base", of)))


def _blanked() -> Column:
    """The text with blanks in the place of base spans; positions stay."""
    text, start = F.col("text"), F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        first = F.greatest(acc["at"], s["start"])
        out = F.concat(acc["out"], F.substring(text, acc["at"] + 1, first - acc["at"]), F.repeat(F.lit(" "), s["end"] - first))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    joined = F.aggregate("base", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size("base") == 0, text).otherwise(joined)


def _words() -> Column:
    """The different words of a text outside its base spans."""
    return F.array_distinct(F.transform(F.regexp_extract_all(_blanked(), F.lit(WORD), F.lit(0)), F.lower))


def _text_counts(docs: DataFrame, copies: DataFrame, least: int, most: float) -> DataFrame:
    """``term, n_t``: the different texts that hold each term, for terms of ``least`` to ``most`` texts.

    A text of c rows counts 1 / c for each of them; the sums are whole but for rounding.
    """
    shared = copies.where("copies > 1").hint("shuffle_hash")
    rows = _scanned(docs).select("k1", "k2", "text", "base").join(shared, ["k1", "k2"], "left")
    each = rows.select((1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(_words()).alias("term"))
    return each.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("n_t")).where(F.col("n_t").between(least, most))


def _occurrences(hit: DataFrame, classes: DataFrame, counts: DataFrame, bound: Column, min_texts: int) -> DataFrame:
    """``k1, k2, c1, c2, term, n_e, n_t``: where a term that may disclose a class stands in a text of that class.

    A text of many words and many classes would give a row for each pair of them. But a pair must be seen in ``min_texts`` of the
    class's texts, so one of them may be left out when pairs are looked for: of each class the text with the most classes is.
    What was found elsewhere is then looked up there.
    """
    texts = hit.join(classes.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    words = staged(texts.select("k1", "k2", F.explode(_words()).alias("term")).join(counts, "term"), "pii-words")
    if min_texts < 2:
        return words.join(classes, ["k1", "k2"]).where(F.col("n_t") <= bound)
    sized = classes.join(classes.groupBy("k1", "k2").agg(F.count("*").alias("n_c")), ["k1", "k2"])
    fullest = staged(sized.groupBy("c1", "c2").agg(F.max(F.struct("n_c", "k1", "k2")).alias("m")).select("c1", "c2", F.col("m.k1").alias("f1"), F.col("m.k2").alias("f2")), "pii-fullest")
    light = classes.join(fullest, ["c1", "c2"]).where("k1 <> f1 OR k2 <> f2").drop("f1", "f2")
    found = staged(words.join(light, ["k1", "k2"]).where(F.col("n_t") <= bound), "pii-found")
    again = found.groupBy("c1", "c2", "term").agg(F.first("n_e").alias("n_e")).join(fullest, ["c1", "c2"]).withColumnsRenamed({"f1": "k1", "f2": "k2"}).join(words, ["k1", "k2", "term"])
    return found.unionByName(again.select(*found.columns))


def _study(docs: DataFrame, hit: DataFrame, min_texts: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members`` (entity, c1, c2, n_e), ``seen`` (k1, k2, c1, c2, term: the occurrences) and ``chosen`` (c1, c2, term, n_te, n_t)."""
    holds = staged(hit.select("k1", "k2", F.explode(_entities()).alias("entity")).distinct(), "pii-holds")
    # Entities of the same texts share these 128 bits, and so every count: they are one class.
    signs = [F.bit_xor(F.xxhash64(F.lit(k), "k1", "k2")).alias(f"c{k}") for k in (1, 2)]
    members = staged(holds.groupBy("entity").agg(F.count("*").alias("n_e"), *signs).where(F.col("n_e") >= min_texts), "pii-members")
    classes = staged(holds.join(members, "entity").select("k1", "k2", "c1", "c2", "n_e").distinct(), "pii-classes")
    copies = staged(_scanned(docs).groupBy("k1", "k2").agg(F.count("*").alias("copies")), "pii-copies")
    total = float(copies.count())
    # The most texts a term may be in, with some slack for rounding; exact decisions follow.
    bound = F.col("n_e") * F.pow(F.lit(total) / F.col("n_e"), F.lit(1 - threshold)) * 1.000001
    most = members.agg(F.max(bound)).first()[0] or 0.0
    counts = staged(_text_counts(docs, copies, min_texts, most), "pii-counts")
    seen = staged(_occurrences(hit, classes, counts, bound, min_texts), "pii-seen")
    pairs = seen.groupBy("c1", "c2", "term").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pmi = F.log2(F.col("n_te") * F.lit(total) / (F.col("n_t") * F.col("n_e")))
    information = F.log2(F.lit(total) / F.col("n_e"))
    enough = (F.col("n_te") >= min_texts) & (F.col("n_e") < total) & (pmi >= threshold * information - 1e-12)
    return members, seen, staged(pairs.where(enough).select("c1", "c2", "term", "n_te", "n_t"), "pii-chosen")


def disclosive_pairs(docs: DataFrame, min_texts: int = MIN_TEXTS, threshold: float = THRESHOLD) -> DataFrame:
    """``entity, term, n_te, n_t, n_e``: the pairs whose term discloses the entity (of :func:`_entities`)."""
    members, _, chosen = _study(docs, staged(_scanned(docs).where(F.size("base") > 0), "pii-documents"), min_texts, threshold)
    return members.join(chosen, ["c1", "c2"]).select("entity", "term", "n_te", "n_t", "n_e")


def find_private(docs: DataFrame, min_texts: int = MIN_TEXTS, threshold: float = THRESHOLD, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text, base, spans`` (``base`` and the term spans; and ``carried``)."""
    more = ["carried"] if carry else []
    hit = staged(_scanned(docs, carry).where(F.size("base") > 0), "pii-documents")
    _, seen, chosen = _study(docs, hit, min_texts, threshold)
    terms = seen.join(chosen.select("c1", "c2", "term"), ["c1", "c2", "term"]).groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"))
    joined = hit.join(staged(terms, "pii-terms"), ["k1", "k2"], "left")
    places = F.transform(_matches(_blanked(), WORD, F.col("terms")), lambda m: F.struct(m["start"], F.lit(4).alias("kind_no"), m["end"], F.lower(m["value"]).alias("value")))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", places)))
    found = joined.select("doc_id", "text", "base", spans.alias("spans"), *more)
    nothing = _scanned(docs, carry).where(F.size("base") == 0).select("doc_id", "text", "base", F.col("base").alias("spans"), *more)
    return found.unionByName(nothing)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span generalised to ``[KIND]``; overlapping spans become one, named by the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["kind_no"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    joined = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(joined)

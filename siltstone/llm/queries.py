"""The registered queries of this subpackage: thin digests over the operators, whole tables in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import best_paths, chain, format_paths, masked_text, parse
from .html_text import extract
from .langid import identify
from .lines import dedup_lines
from .media import describe_media, read_media, store_media
from .packing import pack_documents
from .pieces import decode_pieces, encode_pieces
from .phrases import collocations
from .pii import KINDS, find_private, span_list
from .quality import quality
from .simhash import near_duplicates
from .suffix import remove_repeats
from .trie import ordered_turns, prefix_trie, share_heads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def _count_kind(number: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind_no"] == number)).cast("long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_private(table(spark, sf_dir, "documents"))
    counts = [_count_kind(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return out.select("doc_id", *counts, F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_pieces(encode_pieces(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe_media(read_media(spark, store_media(table(spark, sf_dir, "documents"))))


#: A conversation whose texts hold the template's own control strings.
HARD_TURN = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TURN).alias("text"))
    out = format_paths(best_paths(chain(turns.unionByName(hard)))).withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the digests: ``spans``, the removed runs (start:end in bytes), and ``text``, what is left, with U+FFFD where a cut splits a character."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), spans.alias("spans"), text.alias("text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*share_heads(ordered_turns(table(spark, sf_dir, "conversations"))))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_media": op4_media,
    "op5_chat": op5_chat,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_language": op10_language,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_phrases": op12_phrases,
    "op13_html_text": op13_html_text,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: crc32 of a decimal number's characters, bit by bit (reversed polynomial 0xEDB88320).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(CAST({0} AS VARCHAR), '')]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"""

_SPLIT_PIECES = "'[.,;:!?' || chr(10) || '-' || chr(13) || ']'"
_CUT = """SELECT x.lang, x.k, x.p, x.a, y.a AS l, z.a AS r, (1000::HUGEINT * x.a * n.n) // (y.a::HUGEINT * z.a) AS score, len(y.w) AS j
  FROM kept x JOIN f y ON y.lang = x.lang AND len(y.w) < x.k AND y.w = x.w[1:len(y.w)] JOIN f z ON z.lang = x.lang AND z.w = x.w[len(y.w) + 1:] JOIN n ON n.lang = x.lang"""

_ESCAPED_EXTRA = "length(t) - length(replace(replace(replace(t, chr(92), ''), '<', ''), '#', ''))"

ORACLE: dict[str, str] = {
    "op5_chat": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(r) + 1 + length(t) + {_ESCAPED_EXTRA} + 1 + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
j AS (SELECT k.*, coalesce(k.doc_id > m.first_doc, false) AS lost FROM k LEFT JOIN m USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id""",
    "op11_prefix_trie": f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
    [coalesce(role, ''), coalesce(text, '')] AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT c, list(x ORDER BY i) AS xs, {_CRC32.format("c")} % 6 AS h FROM o GROUP BY c),
b AS (SELECT s.c, list_concat(coalesce(t.xs[1:s.h], []), s.xs[s.h + 1:]) AS xs FROM s LEFT JOIN s t ON t.c = s.c - s.c % 100),
m AS (SELECT c, unnest(range(len(xs) + 1)) AS d, xs FROM b),
k AS (SELECT c, d, xs[1:d] AS p, len(xs) = d AS e FROM m),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (e), '') AS ends FROM k GROUP BY p, d),
u AS (SELECT a.p, count(*) FILTER (v.d = a.d + 1) AS n_children, sum(CASE WHEN v.d > 0 THEN (v.n_convs - 1) * length(v.p[v.d][2]) ELSE 0 END) AS saved,
    count(*) FILTER (NOT EXISTS (SELECT 1 FROM n w WHERE w.d = v.d + 1 AND w.p[1:v.d] = v.p)) AS n_leaves
  FROM n a JOIN n v ON v.d >= a.d AND v.p[1:a.d] = a.p GROUP BY a.p)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, u.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u USING (p) LEFT JOIN n q ON q.d = n.d - 1 AND q.p = n.p[1:n.d - 1]""",
    "op12_phrases": f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPLIT_PIECES})) AS piece FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ ' || chr(9) || ']+'), lambda x: x <> '') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM s, range(1, 6) r(k) WHERE len(w) >= k),
f AS (SELECT lang, w[i + 1:i + k] AS w, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, w, a, len(w) AS k, array_to_string(w, ' ') AS p FROM f WHERE len(w) > 1),
kept AS (SELECT * FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.a >= 100 * x.a AND contains(' ' || y.p || ' ', ' ' || x.p || ' '))),
cuts AS ({_CUT}),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
ranked AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM best)
SELECT lang, rank, p AS phrase, a, l, r, n.n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}

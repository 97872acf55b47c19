"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams.

The verdict of the method compares two multinomials over hashed n-grams: one
of trusted documents, one of the whole raw corpus, each distinct text counted
once in both, however many copies it has. N-grams are those of 4 bytes, and
those of 3 words by their form: each word's length, the classes of its first
and last byte, and which of the three words are equal. (Words themselves would
say nothing here: most pairs of a good text never occur again.) A document's
score is the mean over its n-grams of ``ln(p_trusted / p_raw)``; it is kept at
``threshold`` or above. The trusted multinomial is smoothed towards the raw
one, so an n-gram (or a whole language) that the trusted sample lacks costs a
bounded amount. Ratios are fixed-point integers: scores do not depend on how
documents fall into tasks.

Edge cases: a null or empty text has no words and fails the base rules; with
no trusted document all ratios are zero and the method keeps everything; texts
shorter than one n-gram score zero; repeated rows get equal verdicts; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import RollingHash, blocks, mix, texts_of, word_bounds

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Bound on the trusted rows that are read (a documented, bounded labelled sample).
MAX_TRUSTED = 20_000
NGRAM = 4
#: Bytes of texts that are measured at once.
BLOCK_BYTES = 500_000
#: Buckets of the byte n-grams, and as many of the word n-grams.
BUCKETS = 1 << 15
#: Weight of the raw multinomial in the trusted one, as a share of the trusted n-grams.
SMOOTHING = 0.05
#: In nats per n-gram, from the labelled rows of the given tables that pass the base rules: trusted ones score -0.12 and up at
#: every size, those of low quality have a median of -1.2 (98 in 100 are below the threshold). Clean rows of languages that
#: 341 trusted rows hardly show score down to -0.3.
THRESHOLD = -0.35
_SCALE = 1 << 20
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: 0 other, 1 a-z, 2 A-Z, 3 0-9, 4 beyond ASCII, 5 marks that end or divide sentences.
_CLASS = np.zeros(256, dtype=np.int64)
for _number, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".,;:!?"), 1):
    _CLASS[list(_members)] = _number
_WEIGHTS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)

FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte, and whether it ends inside its document."""
    code = np.zeros(len(data), dtype=np.uint32)
    for k in range(NGRAM):
        code[: len(data) - k] |= data[k:].astype(np.uint32) << np.uint32(8 * k)
    inside = np.ones(len(data), dtype=bool)
    for k in range(1, NGRAM):
        ends = offsets[1:] - k
        inside[ends[ends >= offsets[:-1]]] = False
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1), inside


def _word_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of three words of a document, and its document."""
    form = (np.minimum(ends - starts, 15) * 8 + _CLASS[data[starts]]) * 8 + _CLASS[data[ends - 1]]
    code = (form[:-2] << 20 | form[1:-1] << 10 | form[2:]) << 3
    code |= (hashes[:-2] == hashes[1:-1]) | (hashes[1:-1] == hashes[2:]).astype(np.int64) << 1 | (hashes[:-2] == hashes[2:]).astype(np.int64) << 2
    inside = doc[2:] == doc[:-2]
    return BUCKETS + (mix(code[inside]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), doc[2:][inside]


def _words(block) -> tuple[RollingHash, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's rolling hash, its words (starts, ends, hashes, documents), and which bytes are blank."""
    starts, ends, blank, _ = word_bounds(block)
    rolling = RollingHash(block.data)
    return rolling, starts, ends, rolling(starts, ends), np.searchsorted(block.offsets, starts, side="right") - 1, blank


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-gram counts of a partition: all documents, and the trusted ones."""
    raw, trusted = np.zeros(2 * BUCKETS, dtype=np.int64), np.zeros(2 * BUCKETS, dtype=np.int64)
    for batch in batches:
        flags = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
        for block in blocks(batch.column(0), BLOCK_BYTES):
            bucket, inside = _ngram_buckets(block.data, block.offsets)
            raw += np.bincount(bucket[inside], minlength=2 * BUCKETS)
            good = inside & np.repeat(flags[block.rows], np.diff(block.offsets))
            trusted += np.bincount(bucket[good], minlength=2 * BUCKETS)
            _, starts, ends, hashes, doc, _ = _words(block)
            bucket, doc = _word_buckets(block.data, starts, ends, hashes, doc)
            raw += np.bincount(bucket, minlength=2 * BUCKETS)
            trusted += np.bincount(bucket[flags[block.rows][doc]], minlength=2 * BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], ["bucket", "raw", "trusted"])


def log_ratios(docs: DataFrame, trusted: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """Fixed-point ``ln(p_trusted / p_raw)`` of each bucket, counted over the distinct texts of all documents.

    ``trusted`` holds the ``doc_id`` of trusted documents; at most ``max_trusted`` of them (by hash order)
    are used, which bounds what is broadcast; a text is trusted if a row of it is. ``2 * BUCKETS`` rows at most come to the driver.
    """
    chosen = trusted.select(trusted["doc_id"].cast("long").alias("doc_id")).dropna().distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("good", F.lit(True))
    flagged = texts_of(docs).join(F.broadcast(chosen), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    once = flagged.groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")).agg(F.first("text").alias("text"), F.max("good").alias("good")).select("text", "good")
    counted = once.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, good = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for row in counted.collect():  # at most 2 * BUCKETS rows
        raw[row["bucket"]], good[row["bucket"]] = row["raw"], row["trusted"]
    if not raw.sum() or not good.sum():
        return np.zeros(2 * BUCKETS, dtype=np.int64)
    p_raw = (raw + 1) / (raw + 1).sum()
    prior = SMOOTHING * good.sum()
    return np.rint(np.log((good + prior * p_raw) / (good.sum() + prior) / p_raw) * _SCALE).astype(np.int64)


def _repeated_words(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words per document that lie in an 8-word window which the document holds twice or more."""
    if len(hashes) < WINDOW:
        return np.zeros(n_docs, dtype=np.int64)
    n = len(hashes) - WINDOW + 1
    window = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        window += hashes[k : k + n] * _WEIGHTS[k]
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    key = mix(window[at]) ^ mix(doc[at].astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def _repeated_lines(block, rolling: RollingHash, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    cut = block.data == 10
    first = np.union1d(block.offsets[:-1], np.flatnonzero(cut) + 1)
    first = first[first < len(block.data)]
    last = np.append(first[1:], len(block.data))
    last = last - cut[last - 1] if len(first) else last[:0]  # without the line feed
    words = np.zeros(len(block.data) + 1, dtype=np.int64)
    words[starts + 1] = 1
    words = np.cumsum(words)
    full = words[last] > words[first]
    first, last = first[full], last[full]
    doc = np.searchsorted(block.offsets, first, side="right") - 1
    key = np.unique(np.stack((doc.astype(np.uint64), rolling(first, last))), axis=1)[0].astype(np.int64)
    return np.bincount(doc, minlength=block.n) - np.bincount(key, minlength=block.n)


def _measure(ratios: np.ndarray, text: bool = False):
    """The features of each row, its other columns, and with ``text`` the text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), BLOCK_BYTES):
                rolling, starts, ends, hashes, doc, blank = _words(block)
                n_words = np.bincount(doc, minlength=block.n)
                bucket, inside = _ngram_buckets(block.data, block.offsets)
                forms, forms_doc = _word_buckets(block.data, starts, ends, hashes, doc)
                grams = block.totals(inside) + np.bincount(forms_doc, minlength=block.n)
                total = block.totals(np.where(inside, ratios[bucket], 0))
                np.add.at(total, forms_doc, ratios[forms])
                score = total / np.maximum(grams, 1) / _SCALE
                values = [
                    n_words,
                    block.totals(~blank & ((block.data & 0xC0) != 0x80)),
                    block.totals(_SYMBOLS[block.data]),
                    _repeated_lines(block, rolling, starts),
                    _repeated_words(hashes, doc, block.n),
                ]
                ids, *carried = (batch.column(k).slice(block.rows.start, block.n) for k in range(batch.num_columns) if k != 1 or text)
                names = [*(c.split()[0] for c in FEATURES.split(", ")), *batch.schema.names[1 if text else 2 :]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v.astype(np.int64)) for v in values), pa.array(score), *carried], names=names)

    return run


def quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: the base features, ``base_failed``, ``score`` and ``kept`` (and ``carried``)."""
    ratios = log_ratios(docs, trusted, max_trusted)
    # A text that is carried comes back from the measuring task: sent beside itself, it would take a batch's memory twice.
    text = "text" in carry and docs.schema["text"].dataType == StringType()
    rows = texts_of(docs, [c for c in carry if not (text and c == "text")])
    schema = StructType.fromDDL(FEATURES)
    for field in rows.schema.fields[1 if text else 2 :]:
        schema = schema.add(field)
    out = rows.mapInArrow(_measure(ratios, text), schema)
    if text:
        out = out.withColumn("carried", F.struct(*(F.col(c) if c == "text" else F.col(f"carried.{c}") for c in carry))).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))

"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its
letters' vectors, rotated by two, one and no places (binding); a text is the
sum of its trigrams' vectors (bundling); a language's prototype is the sum over
its training texts. A document gets the language whose prototype has the
highest cosine with its own vector; that cosine (never below 0) is the score.

Training reads ``text`` and ``lang`` of the documents outside the held-out fold
and adds up one vector per language and task, so ``languages x DIMENSIONS``
numbers come to the driver however large the corpus is. Prediction reads
``text`` only.

Edge cases: null text or text without a letter gives ``und`` and score 0; so
does every text if nothing was learned; a null ``doc_id`` is neither learned
from nor held out; ties go to the language that sorts first; repeated rows get
equal predictions; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, texts_of

DIMENSIONS = 1024
SEED = 20240601
#: Letters of a text are folded onto this many symbols; symbol 0 is everything that is no letter.
SYMBOLS = 512
UNKNOWN = "und"
#: Code points whose trigrams are held at once, and distinct trigrams whose vectors are.
PART, SLICE = 500_000, 4096
#: Texts that are predicted at once, and counts (rows times trigrams of a slice) that are held at once.
ROWS, COUNTS = 500, 2_000_000
FOLDS = 3
HELD_OUT = 1


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """The symbol of each code point (lower-cased letters; 0 for the rest), and whether it is a letter."""
    symbol, letter = np.zeros(0x110000, dtype=np.int64), np.zeros(0x110000, dtype=bool)
    for point in range(0x30000):
        char = chr(point)
        if char.isalpha():
            letter[point] = True
            symbol[point] = 1 + ord(char.lower()[0]) % (SYMBOLS - 1)
    for point in range(0x30000, 0x110000):
        if chr(point).isalpha():
            letter[point], symbol[point] = True, 1 + point % (SYMBOLS - 1)
    return symbol, letter


@lru_cache(maxsize=1)
def _vectors() -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIMENSIONS))


def _bound(trigrams: np.ndarray) -> np.ndarray:
    """The vector of each trigram (as int8): rotated letters multiplied."""
    base = _vectors()
    a, b, c = trigrams // (SYMBOLS * SYMBOLS), trigrams // SYMBOLS % SYMBOLS, trigrams % SYMBOLS
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def _trigrams(texts: list[str], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers of all texts, the text of each, which texts hold a letter, and all marks (runs of non-letters count as one blank).

    ``before`` are the last marks of what precedes the first text.
    """
    symbol, letter = _letters()
    before = np.zeros(0, dtype=np.int64) if before is None else before
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), lengths)
    has = np.bincount(owner[letter[points]], minlength=len(texts)) > 0
    marks, owner = np.concatenate((before, symbol[points])), np.concatenate((np.zeros(len(before), dtype=np.int64), owner))
    keep = np.ones(len(marks), dtype=bool)
    keep[1:] = (marks[1:] != 0) | (marks[:-1] != 0) | (owner[1:] != owner[:-1])
    marks, owner = marks[keep], owner[keep]
    grams = (marks[:-2] * SYMBOLS + marks[1:-1]) * SYMBOLS + marks[2:]
    inside = owner[:-2] == owner[2:]
    return grams[inside], owner[:-2][inside], has, marks


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`_trigrams` of all texts, ``PART`` code points at a time; the parts of a long text hold each of its trigrams once."""
    first = 0
    while first < len(texts):
        last, size = first + 1, len(texts[first])
        while last < len(texts) and size + len(texts[last]) <= PART:
            size += len(texts[last])
            last += 1
        tail = None
        for lo in range(0, max(size, 1), PART if last == first + 1 else max(size, 1)):
            grams, owner, has, marks = _trigrams([texts[first][lo : lo + PART]] if last == first + 1 else texts[first:last], tail)
            every = np.zeros(len(texts), dtype=bool)
            every[first:last] = has
            yield grams, owner + first, every
            tail = marks[-2:]
        first = last


def _sums(texts: list[str], row_of: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the trigram vectors of each row (text ``i`` adds to row ``row_of[i]``), and which texts hold a letter."""
    total, has = np.zeros((n_rows, DIMENSIONS)), np.zeros(len(texts), dtype=bool)
    width = max(1, min(SLICE, COUNTS // max(1, n_rows)))
    for grams, owner, letters in _parts(texts):
        has |= letters
        seen, at = np.unique(grams, return_inverse=True)
        order = np.argsort(at, kind="stable")
        at, row = at[order], row_of[owner[order]]
        edges = np.searchsorted(at, np.arange(0, len(seen) + width, width))
        for k, lo in enumerate(range(0, len(seen), width)):  # a slice of the trigrams at a time
            part = _bound(seen[lo : lo + width]).astype(np.float32)
            mine = slice(edges[k], edges[k + 1])
            counts = np.bincount(row[mine] * len(part) + at[mine] - lo, minlength=n_rows * len(part))
            total += counts.reshape(n_rows, len(part)).astype(np.float32) @ part  # exact: whole numbers of a part stay below 2**24
    return total, has


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of a partition: the sum of its trigram vectors, one row per dimension."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for block in blocks(batch.column(0)):
            own = langs[block.rows]
            names = sorted(set(own))
            number = {name: i for i, name in enumerate(names)}
            sums, _ = _sums([block.text(i).decode() for i in range(block.n)], np.array([number[x] for x in own]), len(names))
            for name, row in zip(names, sums):
                total[name] = total.get(name, 0) + row.astype(np.int64)
    for name, row in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(row)], ["lang", "at", "value"])


def prototypes(docs: DataFrame, lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and one unit vector each."""
    labelled = docs.select(docs["text"].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).dropna()
    sums = labelled.mapInArrow(_bundle, "lang string, at long, value long").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    rows = sums.collect()  # languages x DIMENSIONS numbers
    names = sorted({r["lang"] for r in rows})
    table = np.zeros((len(names), DIMENSIONS))
    number = {name: i for i, name in enumerate(names)}
    for r in rows:
        table[number[r["lang"]], r["at"]] = r["value"]
    norms = np.linalg.norm(table, axis=1, keepdims=True)
    return names, table / np.where(norms == 0, 1, norms)


def _predict(names: list[str], table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lo in ((b, lo) for b in blocks(batch.column(2), 500_000) for lo in range(0, b.n, ROWS)):
                texts = [block.text(i).decode() for i in range(lo, min(lo + ROWS, block.n))]
                n = len(texts)
                vectors, has = _sums(texts, np.arange(n), n)
                norms = np.linalg.norm(vectors, axis=1)
                cosine = np.round(vectors @ table.T / np.where(norms == 0, 1, norms)[:, None], 9) if names else np.zeros((n, 1))
                best = cosine.argmax(axis=1)
                sure = has & bool(names)
                lang = [names[b] if ok else UNKNOWN for b, ok in zip(best, sure)]
                score = np.where(sure, np.clip(cosine[np.arange(n), best], 0, 1), 0.0)
                head = [batch.column(k).slice(block.rows.start + lo, n) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*head, pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def identify(docs: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learns from the rows of ``training`` (by default ``docs``) outside the fold."""
    source = docs if training is None else training
    names, table = prototypes(source.where(fold(source["doc_id"]) != HELD_OUT))
    rows = texts_of(docs).select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_predict(names, table), "doc_id long, held_out boolean, lang_pred string, score double")

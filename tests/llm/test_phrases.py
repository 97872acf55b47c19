"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from siltstone.llm import phrases, queries
from tests.llm import cases
from tests.oracle import compare

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least, most=5, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = [p for p, a in f.items() if len(p) > 1 and a >= least]
        inside = {p[i:j] for p in candidates for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f[p] >= 100 * f[p[i:j]]}
        scored = []
        for p in set(candidates) - inside:
            score, k = min((1000 * f[p] * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, b.decode(), -a, left, right, totals[lang], -s) for i, (s, a, b, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def _texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "city", "é", "É", "日本", "x-y", "a"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))) + rng.choice(["", ". new York city", "\nof the\x0bof\tthe", "!?", "\x0c\r of"]), rng.choice(["en", "fr", None, "und"])) for i in range(200)]
    return rows + [(r[0], *r[1:]) for r in rows[:20]] + [(None, None, "en"), (900, "", None), (901, " \t ", "en"), (902, ".,;", "en"), (903, "a a a a a a a a", "en"), (904, "of the " * 4000, "fr")]


def _run(spark, rows, **options):
    return sorted(tuple(r[c] for c in NAMES) for r in phrases.collocations(cases.table(spark, rows), **options).collect())


@pytest.mark.parametrize(("least", "shared"), [(20, phrases.MAX_SHARED), (20, 5)])
def test_phrases(spark, least, shared):
    """Both ways of the semi-join: groups that every worker holds, and groups joined to each row."""
    rows = _texts(1)
    assert _run(spark, rows, min_count=least, max_shared=shared) == brute([r[1:] for r in rows], least)


def test_awkward_rows_blocks_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "_BLOCK", 500)
    rows = cases.texts()
    want = brute([r[1:] for r in rows], 5, top=7)
    assert len(want) > 10
    assert _run(spark, rows, min_count=5, top=7) == want
    assert _run(spark, rows, min_count=5, max_words=2) == brute([r[1:] for r in rows], 5, 2)
    assert _run(spark, [], min_count=1) == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, left, right = 900_000_000_001, 987_654_321_987_654, 900_000_000_003, 900_000_000_007
    row = spark.createDataFrame([(a, n, [left], [right])], "a long, n long, firsts array<long>, rests array<long>").select(phrases._cuts().alias("cut")).first().cut
    assert (int(row.score), row.l, row.r) == (1000 * a * n // (left * right), left, right)


def test_matches_sql(spark):
    compare(spark, queries.QUERIES["op12_phrases"], queries.ORACLE["op12_phrases"], "/root/testdata/sf0.001")

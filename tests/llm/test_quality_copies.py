"""Copies of a text do not count against it."""

import random

from siltstone.llm import quality
from tests.llm import cases


def test_a_clean_unlabelled_text_with_many_copies_stays_kept(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=150)), "en") for i in range(200)]
    clean = " ".join(rng.choices(words, k=150))
    rows += [(1000 + i, clean, "en") for i in range(100)]
    trusted = spark.range(0, 200, 2).selectExpr("id AS doc_id")
    out = quality.quality(cases.table(spark, rows), trusted).collect()
    assert all(r.kept for r in out if r.doc_id >= 1000)
    single = quality.quality(cases.table(spark, rows[:201]), trusted).where("doc_id = 1000").first()
    assert {r.score for r in out if r.doc_id >= 1000} == {single.score}

"""The pipeline's near-duplicate stage against brute-force Jaccard over five-word shingles."""

import random

from siltstone.llm import jaccard
from tests.llm import cases
from tests.llm.test_pipeline import SF, corpus_pipeline


def _set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-12


def _rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    rows = []
    for g in range(30):
        words = rng.choices(vocabulary, k=300)
        rows.append((1000 * g, " ".join(words), "en"))
        for n in (1, 2, 4, 6, 7, 12, 40):
            copy = list(words)
            for at in rng.sample(range(300), n):
                copy[at] = rng.choice(vocabulary) + "x"
            rows.append((1000 * g + n, " ".join(copy), "en"))
    return rows + [(99_001, None, None), (99_002, " \n", None), (99_003, "one two three", None), (99_004, "One  TWO three", None), (None, rows[9][1], None)]


def test_near_copies_are_those_of_brute_force(spark):
    rows = _rows()
    sets = [_set(t) for _, t, _ in rows]
    label = list(range(len(rows)))
    ids = [jaccard.NULL_ID if i is None else i for i, _, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if label[a] != label[b] and _alike(sets[a], sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {c: min(ids[k] for k in range(len(rows)) if label[k] == c) for c in set(label)}
    want = sorted((ids[k], least[label[k]]) for k in range(len(rows)))
    null = lambda x: jaccard.NULL_ID if x is None else x
    got = sorted((null(r.doc_id), null(r.component_id)) for r in jaccard.near_copies(cases.table(spark, rows)).collect())
    assert got == want
    kept = {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, cases.table(spark, rows), SF).collect()}
    assert kept == {None if m == jaccard.NULL_ID else m for m in least.values()}


def test_members_of_a_band_that_miss_its_smallest_are_compared(spark):
    words = [f"w{i}" for i in range(200)]
    far = ["a", "b", "c", "d", "e", "f"]
    change = lambda places, by: " ".join(by + w if i in places else w for i, w in enumerate(words))
    rows = [(1, " ".join(words), "en")]
    rows += [(10 + i, change({20, 60, 100, 140, 180, 10 + i}, x), "en") for i, x in enumerate(far)]  # each about 0.74 from the first
    rows += [(30 + i, change({20, 60, 100, 140, 180, 10 + i, 30}, x), "en") for i, x in enumerate(far)]
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(cases.table(spark, rows)).collect()}
    assert got == {1: 1} | {k + i: 10 + i for i in range(6) for k in (10, 30)}


def test_links_come_from_the_simhash_join_first(spark, monkeypatch):
    """Copies within the Hamming budget are linked by the trie join; their pairs are not compared again by bands."""
    words = [f"w{i}" for i in range(3000)]
    rows = [(10 + i, " ".join(words[:1500] + [f"x{i}"] + words[1501:]), "en") for i in range(6)] + [(99, "quite another text of seven words", "en")]
    tried, joined = [], []
    real, links = jaccard._alike, jaccard.near_links
    monkeypatch.setattr(jaccard, "_alike", lambda docs, pairs: (tried.append(pairs.count()), real(docs, pairs))[1])
    monkeypatch.setattr(jaccard, "near_links", lambda prints: (joined.append(prints.count()), links(prints))[1])
    got = {r.doc_id: r.component_id for r in jaccard.near_copies(cases.table(spark, rows)).collect()}
    assert got == {10 + i: 10 for i in range(6)} | {99: 99}
    assert joined and joined[0] >= 2 and tried[0] >= 5 and tried[1:] == [0, 0]

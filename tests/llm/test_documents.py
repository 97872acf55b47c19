"""The operators on documents against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import gsaca, langid, lines, media, packing, pieces, pii, quality, queries, simhash, suffix
from siltstone.llm.common import RollingHash, mix
from tests.llm import cases

ROWS = cases.texts()
BLANK = re.compile("[^ \t\n\x0b\x0c\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- personal data ----------------------------------------------------------------------------------------

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute_spans(text):
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if _fits(k, m.group())]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))


ODD = [
    "a@b.c", "a@b.com_x@d.org", ". ..@x.y-z.q.", "x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.1.1.1 01.2.3", "4111 1111 1111 1111-", "4111-1111-1111-1111-2", "+1 (988) 555-2485+44 20 7946 0958 +1",
    "é" * 10 + "a@b.com\n日本 1.1.1.1", "9" * 30_000, "1 " * 20_000, "a" * 50_000 + "@", "+" * 500 + "1", "+1(((((2", "١٢٣.1.1.1", "a@b..c@d.e", "@@a@b.c@d.e", "1.1.1.1@a.b 4111111111111111@c.d",
]


def test_base_spans(spark):
    rows = [(i, t, None) for i, t in enumerate(ODD)] + [(i and i + 1000, t, x) for i, t, x in ROWS]
    out = pii.find_private(cases.table(spark, rows)).select("doc_id", "text", pii.span_list(F.col("base")).alias("b"), pii.span_list(F.col("spans")).alias("s")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.b == brute_spans(r.text)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))


def test_terms_that_disclose_an_entity_are_spans_and_copies_are_one_text(spark):
    filler = [(1000 + i, f"nothing {w} here the", None) for i, w in enumerate("abc def ghi jkl".split() * 20)]
    told = [(i, f"the {w} Zorblax secretly owns\nq@x.org the {w} Zorblax", None) for i, w in enumerate(("red", "blue", "green", "grey"))]
    copies = [(500 + i, "the Rarity word beside c@x.org", None) for i in range(5)]
    out = pii.find_private(cases.table(spark, filler + told + copies)).collect()
    for r in out:
        extra = [r.text[s.start : s.end] for s in r.spans if s.kind_no == 4]
        assert extra == (["Zorblax", "secretly", "owns", "Zorblax"] if "q@x.org" in r.text else [])
    clean = pii.find_private(cases.table(spark, told + filler)).select(pii.sanitise(F.col("text"), F.col("spans")).alias("t")).collect()
    assert any(r.t.endswith("[EMAIL] the red [TERM]") for r in clean)


def _blanked(text):
    """Base spans as blanks, and the entities."""
    chars, found = list(text or ""), set()
    for i, (k, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            if _fits(k, m.group()):
                value, digits = m.group().lower(), re.sub("[^0-9]", "", m.group())
                found |= {f"{i}:{value}", f"{i}/{(value.split('@')[-1], '.'.join(value.split('.')[:3]), digits[:6], digits[:4])[i]}"}
                chars[m.start() : m.end()] = " " * (m.end() - m.start())
    return "".join(chars), found


_WORD = re.compile(r"[^\W_]+")


def brute_pairs(texts, min_texts, threshold):
    """Every disclosing (entity, term) with its counts, over the distinct texts."""
    n_t, n_e, n_te = Counter(), Counter(), Counter()
    once = set(t or "" for t in texts)
    for t in once:
        rest, entities = _blanked(t)
        words = {w.lower() for w in _WORD.findall(rest)}
        n_t.update(words)
        n_e.update(entities)
        n_te.update((e, w) for e in entities for w in words)
    out = {}
    for (e, w), k in n_te.items():
        if k >= min_texts and n_e[e] < len(once) and np.log2(k * len(once) / (n_t[w] * n_e[e])) >= threshold * np.log2(len(once) / n_e[e]) - 1e-12:
            out[(e, w)] = (k, n_t[w], n_e[e])
    return out


def _told(seed):
    """Texts in which entities recur, with names near them, copies, repeated rows and spans that overlap."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}x" for i in range(60)]
    entities = ["q@x.org", "Q@X.ORG", "10.0.0.1", "+44 20 7946 0958", "4111 1111 1111 1111.1.1.1", "rare@y.z", "+1 555 555 0100", "p@x.org", "10.0.0.2", "10.0.0.3"]
    rows = []
    for i in range(80):
        body = list(rng.choice(words, rng.integers(1, 30)))
        if i % 3 == 0:
            e = int(rng.integers(0, len(entities)))
            body += [entities[e], f"Name{e}", f"other{int(rng.integers(0, 9))}"]
            body = list(rng.permutation(body))
        rows.append((i, " ".join(body).replace(" w7x ", "\n"), None))
    return rows + [(200 + i, rows[3 * (i % 5)][1], None) for i in range(20)] + rows[:6] + [(300, None, None), (None, "Name0 q@x.org", None)]


@pytest.mark.parametrize("min_texts,threshold", [(pii.MIN_TEXTS, pii.THRESHOLD), (3, 0.5), (2, 0.2)])
def test_disclosive_pairs_equal_plain_counts(spark, min_texts, threshold):
    rows = _told(min_texts) + ROWS
    want = brute_pairs([t for _, t, _ in rows], min_texts, threshold)
    got = {(r.entity, r.term): (r.n_te, r.n_t, r.n_e) for r in pii.disclosive_pairs(cases.table(spark, rows), min_texts, threshold).collect()}
    assert got == want and want
    for r in pii.find_private(cases.table(spark, rows), min_texts, threshold).collect():
        rest, entities = _blanked(r.text)
        marked = [(m.start(), m.end()) for m in _WORD.finditer(rest) if any((e, m.group().lower()) in want for e in entities)]
        assert [(s.start, s.end) for s in r.spans if s.kind_no == 4] == marked


# --- quality ----------------------------------------------------------------------------------------------


def brute_features(text):
    text = text or ""
    words = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_features(spark):
    rows = ROWS + [(200, "dup\nline\ndup\n \n \nline x\ndup", None), (201, "| a | <b> #$ " * 30, None), (202, " ".join(map(str, range(100))) + " " + " ".join(map(str, range(50, 80))), None)]
    docs = cases.table(spark, rows)
    texts = {(i, sha(t or "")): t for i, t, _ in rows}
    out = quality.quality(docs, spark.range(30).select(F.col("id").alias("doc_id")), carry=["text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == brute_features(texts[(r.doc_id, sha(r.carried.text or ""))])
        assert not (r.base_failed and r.kept)


def test_quality_score_is_the_mean_ratio(spark):
    """The scores against a plain computation from the same counts."""
    rows = [(i, t, x) for i, t, x in ROWS if i is not None][:40]
    docs = cases.table(spark, rows)
    ratios = quality.log_ratios(docs, spark.createDataFrame([(i,) for i in range(10)] + [(None,)], "doc_id long"))
    raw, good = Counter(), Counter()

    def grams(t):
        b = (t or "").encode()
        out = [((int.from_bytes(b[i : i + 4], "little") * 2654435761) & 0xFFFFFFFF) >> 17 for i in range(len(b) - 3)]
        words = [w.encode() for w in BLANK.findall(t or "")]
        for x, y, z in zip(words, words[1:], words[2:]):
            code = 0
            for w in (x, y, z):
                code = code * 1024 + (min(len(w), 15) * 8 + kind(w[0])) * 8 + kind(w[-1])
            code = code * 8 + (x == y) + 2 * (y == z) + 4 * (x == z)
            out.append(quality.BUCKETS + int(mix(np.array([code]))[0] >> np.uint64(49)))
        return out

    def kind(byte):
        return 4 if byte > 127 else next((i for i, p in enumerate(("[a-z]", "[A-Z]", "[0-9]"), 1) if re.match(p, chr(byte))), 5 * (chr(byte) in ".,;:!?"))

    for i, t, _ in rows:
        g = grams(t)
        raw.update(g)
        good.update(g if i < 10 else [])
    size = 2 * quality.BUCKETS
    n_raw, n_good = sum(raw.values()) + size, sum(good.values())
    for b in list(raw)[:200]:
        p = (raw[b] + 1) / n_raw
        want = np.log((good[b] + quality.SMOOTHING * n_good * p) / (n_good * (1 + quality.SMOOTHING)) / p)
        assert ratios[b] / 2**20 == pytest.approx(want, abs=1e-5)
    for r in quality.quality(docs, spark.createDataFrame([(i,) for i in range(10)], "doc_id long"), carry=["text"]).collect():
        g = grams(r.carried.text)
        assert r.score == pytest.approx(sum(ratios[b] for b in g) / max(len(g), 1) / 2**20, abs=1e-9)


def test_no_trusted_document_keeps_all_that_pass_the_base_rules(spark):
    out = quality.quality(cases.table(spark), spark.range(0).select(F.col("id").alias("doc_id"))).collect()
    assert all(r.kept != r.base_failed and r.score == 0 for r in out)


def test_rolling_hash_tells_ranges_apart():
    data = np.frombuffer(b"abcabcab" * 50, np.uint8)
    h = RollingHash(data)
    one = h(np.array([0, 3, 1, 0]), np.array([3, 6, 4, 4]))
    assert one[0] == one[1] and len(set(one.tolist())) == 3


# --- lines ------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    ids = defaultdict(set)
    for i, t, _ in ROWS:
        for line in (t or "").split("\n"):
            ids[key(line)].add(-(2**63) if i is None else i)
    first = {k: min(v) for k, v in ids.items() if len(v) > 1 and len(k) >= 10}
    want = Counter()
    for i, t, _ in ROWS:
        own = -(2**63) if i is None else i
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if first.get(key(x), own) == own]
        want[(i, len(all_lines), len(all_lines) - len(kept), "\n".join(kept))] += 1
    rows = lines.dedup_lines(cases.table(spark)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows) == want
    for r in rows:  # the bitmap tells the same
        assert sum(x.length for x in r.keep_runs) == r.n_lines - r.n_dropped


def test_keep_bitmaps_are_runs_of_dropped_lines(spark):
    rows = [(1, "\n".join(f"the common line {i}" for i in range(12)), None), (2, "\n".join(f"{'the common' if i in (0, 1, 2, 5, 10, 11) else 'my very own'} line {i}" for i in range(12)), None)]
    (r,) = lines.keep_bitmaps(cases.table(spark, rows)).collect()
    assert (r.doc_key, r.n_dropped, [tuple(x) for x in r.bitmap]) == (2, 6, [(0, 3), (5, 1), (10, 2)])


def test_first_occurrences_stream_in_sort_order(spark, capsys):
    """The range-partitioned order feeds the aggregation: no other sort and no hash table before it."""
    index = spark.range(100).selectExpr("id % 7 AS h1", "id % 7 AS h2", "id AS doc_key", "int(id) AS pos", "id AS text_key")
    assert {(r.h1, r.first_doc) for r in lines._first_occurrences(index).collect()} == {(i, i) for i in range(7)}
    lines._first_occurrences(index).explain()
    plan = capsys.readouterr().out
    partial = plan[plan.index("partial_min") :]
    assert "HashAggregate" not in plan and partial.index("Sort [h1") < partial.index("rangepartitioning") and partial.count("Sort [") == 1


def test_only_ascii_letters_are_folded(spark):
    rows = [(1, "Same Line ÉTÉ é", None), (2, "same line ÉTÉ é", None), (3, "same line été é", None), (4, " \x0bSAME LINE ÉTÉ é\r", None)]
    assert {r.doc_id: r.n_dropped for r in lines.dedup_lines(cases.table(spark, rows)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


# --- SimHash ----------------------------------------------------------------------------------------------


def brute_print(text):
    words = (text or "").translate(LOWER)
    words = BLANK.findall(words)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(prints))]


def test_simhash(spark):
    base = " ".join(f"word{i % 97}" for i in range(400))
    near = [(300 + i, base.replace(f"word{i} ", "other ", 1), None) for i in range(12)]
    rows = ROWS + near
    out = simhash.near_duplicates(cases.table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: -(2**63) if r[0] is None else r[0])
    prints = [brute_print(t) for _, t, _ in order]
    roots = brute_components(prints)
    want = Counter((i, p, order[r][0]) for (i, _, _), p, r in zip(order, prints, roots))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == want


@pytest.mark.parametrize("frontier", [3, 64, 1 << 18])
def test_trie_join_finds_all_links_however_it_is_split(frontier):
    rng = np.random.default_rng(frontier)
    p = rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, 250)]
    for _ in range(3):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, len(p)).astype(np.uint64))
    p = np.unique(p)
    assert simhash.trie_links(np.zeros(len(p)), p, frontier=frontier).tolist() == brute_components(p.tolist())


def test_a_partition_is_joined_by_whole_groups(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 40, 600))
    fp = rng.integers(0, 2**62, 3)[key % 3] ^ (1 << rng.integers(0, 60, 600)) ^ key
    table = pa.table({"key": key, "fp": fp, "node": np.arange(600)})

    def joined():
        forest = list(range(600))

        def find(x):
            while forest[x] != x:
                x = forest[x]
            return x

        for batch in simhash._join_partition(iter(table.to_batches(max_chunksize=13))):
            for a, b in zip(*(c.to_pylist() for c in batch.columns)):
                forest[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(600)]

    whole = joined()
    monkeypatch.setattr(simhash, "ROWS_AT_ONCE", 20)
    assert joined() == whole and len(set(whole)) < 600


def test_large_groups_are_joined_slice_by_slice(spark):
    rng = np.random.default_rng(9)
    prints = np.unique(np.uint64(0x123456789ABCDEF0) ^ (np.uint64(1) << rng.integers(0, 26, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))
    table = spark.createDataFrame([(int(p.astype(np.int64)), i) for i, p in enumerate(prints)], "fp long, node long")
    whole, split = ({r.node: r.component for r in simhash.components(simhash.near_links(table, large)).collect()} for large in (simhash.LARGE_GROUP, 40))
    roots = brute_components(prints.tolist())
    assert whole == split == {i: r for i, r in enumerate(roots) if roots.count(r) > 1}


def test_long_chains_of_links_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


# --- substrings -------------------------------------------------------------------------------------------


def brute_repeats(rows):
    places = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        places.update(b[i : i + 400] for i in range(len(b) - 399))
    out = Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if places[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)] += 1
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)  # 3: nearly all groups are split, most of them several times
    shared = " ".join(f"w{i * i % 311}" for i in range(200))
    rows = ROWS + [(400 + i, f"{i} start {i}" * (i % 5) + shared[i * 7 : i * 7 + 500 + 11 * i] + f"end {i}", None) for i in range(30)]
    rows += [(430, "ab" * 700, None), (431, "b" * 399, None), (432, "c" * 400, None), (432, "c" * 400, None)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(cases.table(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_rows_of_op8_show_which_bytes_went(spark, tmp_path):
    long_passage = " ".join(f"lengthy{i:03d}" for i in range(60))
    short_passage = " ".join(f"w{i:04d}" for i in range(60))  # over 50 words in 359 bytes: no 400-byte string repeats
    kept_whole = [(5, "clean " + " ".join(f"own{i * i}" for i in range(99)), None), (6, None, None), (7, "", None)]
    rows = [(1, f"one {long_passage} first", None), (2, f"another {long_passage} second", None), (3, f"three {short_passage} x", None), (4, f"four {short_passage} y", None), *kept_whole]
    rows += [(8, "p" + "z" * 399 + "é", None), (9, "q" + "z" * 399 + "è", None), (10, "aé" + "y" * 399, None), (11, "bĩ" + "y" * 399, None)]  # é and è begin with one byte, é and ĩ end with one
    cases.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_substrings(spark, str(tmp_path)).collect()}
    raw = {i: (t or "").encode() for i, t, _ in rows}
    kept = {i: k for i, _, _, _, k in brute_repeats(rows)}
    for i, r in got.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        left = bytes(b for k, b in enumerate(raw[i]) if not any(a <= k < z for a, z in spans))
        assert (len(spans), sum(z - a for a, z in spans), left, sha(left)) == (r.n_spans, r.n_removed, kept[i], r.kept_sha256)
        assert r.text == left.decode(errors="replace")
    assert len(got) == len(rows) and [got[i].text for i in (1, 2, 6, 7)] == ["onefirst", "anothersecond", "", ""]
    assert all(got[i].text == raw[i].decode() and not got[i].spans for i in (3, 4, 5))
    assert [got[i].text for i in (8, 9, 10, 11)] == ["p\ufffd", "q\ufffd", "a\ufffd", "b\ufffd"]


def test_many_rows_without_an_id_keep_their_texts_apart(spark):
    passage = " ".join(f"w{i}" for i in range(120))
    rows = [(None, f"{i} {passage if i % 2 else ''} own words {i * i}", None) for i in range(300)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in suffix.remove_repeats(cases.table(spark, rows)).collect())
    assert got == brute_repeats(rows)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(1500):
        text = rng.integers(0, rng.integers(1, 6), rng.integers(0, 30)).tolist()
        assert gsaca.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


# --- tokens, packing, pieces ------------------------------------------------------------------------------


def test_packing(spark):
    rows = ROWS + [(120, "many words here " * 3000, None)]
    library = packing._encoder(packing.default_vocabulary()).library
    out = packing.pack_documents(cases.table(spark, rows), group_tokens=20 * 2048).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        edges = packing._cuts(len(ids), packing.WINDOW, packing.CUT)
        for a, b in zip(edges, edges[1:]):
            want[(i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
    assert sum(r.length for r in out) / (2048 * len(windows)) > 0.9


def test_a_repeated_row_fills_no_group(spark):
    docs = cases.table(spark, [(7, "many equal rows of one id " * 40, None)] * 900 + [(i, "others " * 100, None) for i in range(200)])
    out = packing.pack_documents(docs, group_tokens=10 * 2048)
    groups = out.groupBy(F.shiftright("sequence_id", 24).alias("g")).count().collect()
    assert sum(r["count"] for r in groups) == 1100 and max(r["count"] for r in groups) < 300


def test_differencing_is_near_equal_and_never_over():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sizes = rng.integers(1, 2048, rng.integers(1, 15)).tolist()
        assert np.bincount(packing.pack(sizes, 2048), weights=sizes).max() <= 2048
    sizes = sorted(rng.integers(1, 512, 1000).tolist(), reverse=True)
    loads = np.bincount(packing.pack(sizes, 2048), weights=sizes)
    assert loads.max() - loads.min() < 60


def test_ids_equal_the_library():
    bpe = packing._encoder(packing.default_vocabulary())
    odd = ["", "  ", "it's I'LL don't", "a\x1cb", "日本語 テスト ½ ²x", "İstanbul ΣΑΣ café é x́", "<|endoftext|> hi", "x" * 3000 + " y", "12345 a1b2", "''''s 's", "naïve—dash “q”", "\x00\x01 a", "ẞß ŉ ǅ ﬁ", "ab c　d", "ä ̈b", "ñ" * 60]
    texts = odd + [t for _, t, _ in ROWS if t]
    ids, counts = bpe.encode(texts)
    want = bpe.library.encode_batch(texts, add_special_tokens=False)
    assert ids.tolist() == [i for e in want for i in e.ids] and counts.tolist() == [len(e.ids) for e in want]


def test_ids_equal_the_library_on_all_documents():
    import duckdb

    bpe = packing._encoder(packing.default_vocabulary())
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    ids, counts = bpe.encode(texts)
    want = bpe.library.encode_batch(texts, add_special_tokens=False)
    assert counts.tolist() == [len(e.ids) for e in want] and ids.tolist() == [i for e in want for i in e.ids]


def test_pieces_round_trip_and_are_the_best_path(spark):
    out = pieces.decode_pieces(pieces.encode_pieces(cases.table(spark))).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((i, t or "") for i, t, _ in ROWS)
    model = pieces._model(pieces.default_model())

    def brute(text):
        text = " " + text
        best = [(0.0, [])]
        for j in range(1, len(text) + 1):
            top = None
            for i in range(max(0, j - 40), j):
                if found := model.scores.get(text[i:j]):
                    step = (best[i][0] + found[0], best[i][1] + [found[1]])
                elif j - i == 1:
                    step = (best[i][0] + model.unknown, best[i][1] + [model.byte_ids[b] for b in text[i:j].encode()])
                else:
                    continue
                if top is None or step[0] > top[0]:
                    top = step
            best.append(top)
        return best[-1][1]

    for text in [t[:400] for _, t, _ in ROWS if t] + ["a  b\n\n  c ▁ ", "\n", " ", "﷽"]:
        ids, _ = model.encode([text])
        assert ids.tolist() == brute(text) and model.decode(ids) == text


# --- media ------------------------------------------------------------------------------------------------


def test_media_round_trip(spark):
    path = media.store_media(cases.table(spark))
    out = media.describe_media(media.read_media(spark, path, rangeBytes=3000)).collect()
    want = Counter()
    for i, t, _ in ROWS:
        b = (t or "").encode()
        payload = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        stored = media.to_png(b)
        assert media.from_png(stored) == (payload, len(b))
        want[(i, len(b), len(payload), sha(payload), zlib.crc32(payload[-64:]), len(stored), sha(stored), media.features(payload))] += 1
    assert Counter(tuple(r) for r in out) == want


def test_a_damaged_member_is_retried_alone_and_reported(spark, tmp_path):
    path = media.store_media(cases.table(spark, [(i, f"text {i} " * 50, None) for i in range(20)]).coalesce(1), f"file://{tmp_path}/a")
    archive = next((tmp_path / "a").glob("*.zip"))
    members = {r["name"]: r["offset"] for r in media.read_media(spark, path).collect()}
    raw = bytearray(archive.read_bytes())
    raw[members["7.png"] + 30 + len("7.png") + 60] ^= 255
    archive.write_bytes(raw)
    rows = media.read_media(spark, path, rangeBytes=700, retries=2).collect()
    assert {r["name"] for r in rows if r["error"]} == {"7.png"} and len(rows) == 20
    with pytest.raises(Exception, match="7.png"):
        media.describe_media(media.read_media(spark, path)).collect()


def test_appends_add_up_and_overwrite_replaces(spark, tmp_path):
    path = f"file://{tmp_path}/media"
    one = lambda *ids: cases.table(spark, [(i, f"text {i} " * 40, None) for i in ids]).coalesce(1)
    names = lambda: sorted(r["name"] for r in media.read_media(spark, path).collect())
    media.store_media(one(1), path)
    media.store_media(one(2, 3), path)
    media.store_media(cases.empty(spark), path)
    assert names() == ["1.png", "2.png", "3.png"]
    media.store_media(one(4, 5, 6), path, mode="overwrite", archiveBytes=100)
    assert names() == ["4.png", "5.png", "6.png"]
    assert len(list((tmp_path / "media").glob("*.zip"))) == 3  # closed at their size; those replaced are gone


# --- language ---------------------------------------------------------------------------------------------


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_of_awkward_rows(spark):
    out = langid.identify(cases.table(spark)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    for i in (100, 101, 102, 103, 106):
        assert (by[i].lang_pred, by[i].score) == ("und", 0)
    assert by[None].held_out is False
    lonely = langid.identify(cases.table(spark), cases.empty(spark)).collect()
    assert {(r.lang_pred, r.score) for r in lonely} == {("und", 0.0)}


def test_hypervectors_bundle_their_trigrams():
    grams, owner, has, _ = langid._trigrams(["ab c", "", "12"])
    vectors = langid._bound(grams[owner == 0])
    base = langid._vectors()
    s = lambda c: 1 + ord(c) % (langid.SYMBOLS - 1)
    assert (vectors[0] == np.roll(base, 2, axis=1)[s("a")] * np.roll(base, 1, axis=1)[s("b")] * base[0]).all()
    assert has.tolist() == [True, False, False]


def _plain_vector(text):
    """The sum of a text's trigram vectors, trigram by trigram."""
    marks = []
    for c in text or "":
        n = 1 + ord(c.lower()[0]) % (langid.SYMBOLS - 1) if c.isalpha() else 0
        if n or not marks or marks[-1]:
            marks.append(n)
    base, total = langid._vectors().astype(int), np.zeros(langid.DIMENSIONS, dtype=int)
    for a, b, c in zip(marks, marks[1:], marks[2:]):
        total += np.roll(base[a], 2) * np.roll(base[b], 1) * base[c]
    return total


@pytest.mark.parametrize("part", [3, 50, 10_000])
def test_texts_in_parts_have_each_trigram_once(monkeypatch, part):
    monkeypatch.setattr(langid, "PART", part)
    monkeypatch.setattr(langid, "SLICE", 16)
    texts = [(t or "")[:700] for _, t, _ in ROWS[:12] + ROWS[60:]] + ["a   b", " " * 200, "ab" + " " * 120 + "c d", "x"]
    sums, has = langid._sums(texts, np.arange(len(texts)), len(texts))
    assert has.tolist() == [any(c.isalpha() for c in t) for t in texts]
    assert all((s == _plain_vector(t)).all() for s, t in zip(sums, texts))


def test_predictions_equal_a_plain_computation(spark):
    """Prototypes, languages and scores of awkward rows, trigram by trigram."""
    rows = [(i, (t or "")[:600] if t is not None else None, x) for i, t, x in ROWS]
    sums = defaultdict(int)
    for i, t, x in rows:
        if i is not None and t is not None and x is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            sums[x] = sums[x] + _plain_vector(t)
    got = langid.identify(cases.table(spark, rows)).collect()
    want = Counter()
    for i, t, _ in rows:
        v = _plain_vector(t)
        cosines = {x: round(float(v @ p / (np.linalg.norm(v) * np.linalg.norm(p) or 1)), 9) for x, p in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        known = any(c.isalpha() for c in t or "")
        want[(i, best if known else "und", round(max(0, cosines[best]), 6) if known else 0.0)] += 1
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in got) == want


# --- all --------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = cases.empty(spark)
    ids = none.select("doc_id")
    frames = [
        pii.find_private(none), quality.quality(none, ids), lines.dedup_lines(none), simhash.near_duplicates(none), suffix.remove_repeats(none), packing.pack_documents(none),
        pieces.decode_pieces(pieces.encode_pieces(none)), media.describe_media(media.read_media(spark, media.store_media(none))), langid.identify(none),
    ]
    assert [f.count() for f in frames] == [0] * len(frames)

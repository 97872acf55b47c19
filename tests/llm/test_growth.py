"""What grows with the input, and by how much: pairs of terms and entities, vectors of short texts, what tasks hold."""

import resource
import tracemalloc

import numpy as np
import pyarrow as pa

from siltstone.llm import langid, packing, pii, quality
from tests.llm import cases


def _rows_made(spark, monkeypatch, n):
    """Rows of the tables that the study writes for one text of ``n`` addresses, each in one other text too, as are its words."""
    counts = {}
    real = pii.staged

    def counted(df, name, **options):
        out = real(df, name, **options)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(pii, "staged", counted)
    whole = " ".join(f"u{i}@d{i}.org word{i} other{i}" for i in range(n))
    rows = [(0, whole, None)] + [(1 + i, f"u{i}@d{i}.org word{i} other{i} alone", None) for i in range(n)] + [(10_000 + i, f"filler {i}", None) for i in range(50)]
    spans = {r.doc_id: sum(s.kind_no == 4 for s in r.spans) for r in pii.find_private(cases.table(spark, rows)).collect()}
    monkeypatch.setattr(pii, "staged", real)
    return counts, spans


def test_pairs_of_a_text_with_many_entities_grow_with_the_text(spark, monkeypatch):
    (small, _), (large, spans) = (_rows_made(spark, monkeypatch, n) for n in (60, 120))
    for name in ("pii-words", "pii-found", "pii-seen"):
        assert large[name] <= 2.2 * small[name], name
    assert spans[0] == 240 and all(spans[1 + i] == 2 for i in range(120))


def test_many_short_texts_take_bounded_memory():
    rng = np.random.default_rng(1)
    short = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzäöüß "), 40)) for _ in range(10_000)]
    table = rng.normal(size=(4, langid.DIMENSIONS))
    names = ["de", "en", "es", "fr"]
    for texts in (short, [""] * 10_000):
        batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([True] * 10_000), pa.array(texts)], ["doc_id", "held_out", "text"])
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        out = pa.Table.from_batches(list(langid._predict(names, table)(iter([batch]))))
        assert out.num_rows == 10_000 and out["doc_id"].to_pylist() == list(range(10_000))
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # KB
    alone = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([True]), pa.array([short[7]])], ["doc_id", "held_out", "text"])
    one = pa.Table.from_batches(list(langid._predict(names, table)(iter([alone]))))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([True] * 600), pa.array(short[:600])], ["doc_id", "held_out", "text"])
    many = pa.Table.from_batches(list(langid._predict(names, table)(iter([batch])))).slice(7, 1)
    assert one["lang_pred"].to_pylist() == many["lang_pred"].to_pylist() and abs(one["score"][0].as_py() - many["score"][0].as_py()) < 1e-9


def test_parts_met_in_an_earlier_block_are_not_encoded_again(monkeypatch):
    bpe = packing.WordBpe(packing.default_vocabulary())
    merged, real = [], bpe._merge
    monkeypatch.setattr(bpe, "_merge", lambda *given: merged.append(given) or real(*given))
    texts = [f"It's word{i} Word{i + 1}, {i}!" for i in range(3000)]
    first = bpe.encode(texts)
    assert merged
    merged.clear()
    again = bpe.encode(texts[::-1])
    assert not merged and first[1].tolist() == again[1][::-1].tolist() and sorted(first[0]) == sorted(again[0])



def test_measuring_long_batches_takes_bounded_memory():
    texts = pa.array([f"some words of text number {i} and more of them, " * 40 for i in range(4000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), texts], ["doc_id", "text"])
    held = pa.RecordBatch.from_arrays([texts, pa.array([True] * 4000)], ["text", "good"])
    for task, given in ((quality._count, held), (quality._measure(np.zeros(2 * quality.BUCKETS, np.int64)), batch)):
        tracemalloc.start()
        for _ in task(iter([given])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80_000_000, (task, peak)


def test_a_carried_text_is_sent_once(spark, monkeypatch):
    real = quality._measure

    def watched(*given):
        def run(batches):
            for batch in batches:
                assert batch.nbytes < 1.5 * batch.column(1).nbytes
                yield from real(*given)(iter([batch]))

        return run

    monkeypatch.setattr(quality, "_measure", watched)
    docs = cases.table(spark, [(i, f"a text of many words, number {i} " * 200, "en") for i in range(20)] + [(99, None, None)])
    out = quality.quality(docs, docs.select("doc_id"), carry=["text", "doc_id", "lang"])
    assert out.schema["carried"].dataType.names == ["text", "doc_id", "lang"]
    assert sorted(out.select("carried.*").collect(), key=lambda r: r.doc_id) == sorted(docs.select("text", "doc_id", "lang").collect(), key=lambda r: r.doc_id)

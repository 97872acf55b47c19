import re

from pyspark.sql import functions as F

from siltstone.functions import hashing as H
from siltstone.functions import text as X
from siltstone.operators.journal import journal_blocks

SF = "/root/testdata/sf0.001"


def _units(text):
    out, cur = [], ""
    for part in re.split(r"(?<=[.!?])|(?<=\n\n)", text):
        cur = " ".join(part.split())
        if cur:
            out.append(cur)
    return out


def _chunks(text, limit=1000):
    units, done, cur = _units(text), [], ""
    if not units:
        return [text.strip()]
    for u in units:
        if cur and len(cur) + 1 + len(u) > limit:
            done.append(cur)
            cur = u
        else:
            cur = f"{cur} {u}" if cur else u
    return done + [cur]


def _core(body):
    kept = []
    for line in body.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = line.strip()
        low = line.lower()
        if (low.startswith("on ") and low.endswith(" wrote:")) or line == "--" or line.startswith("-- "):
            break
        if line.startswith(">"):
            continue
        if line == "" and (not kept or kept[-1] == ""):
            continue
        kept.append(line)
    return "\n".join(kept).strip()


CASES = ["", " ", "a. b! c?", "3.14 and ... x", "one\n\ntwo\n\n\nthree", "x" * 2500, "a " * 900 + "." + "b " * 900, "tab\tand space", "no end"]


def test_units_and_chunks(spark):
    texts = CASES + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in df.select("i", X.sentence_units(F.col("text")).alias("u"), X.chunks(F.col("text")).alias("c")).collect():
        assert r.u == _units(texts[r.i])
        assert r.c == _chunks(texts[r.i])


def test_email_core(spark):
    bodies = CASES + ["hi\n\n\n> quoted\nbye\nOn Monday, X wrote:\nold", "on wrote:\nx", "a\r\nb\rc", "-- \nsig", "text\n--\nsig", "> only quotes\n>", "--x\ny", "\n\n lead\n"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, text string")
    for r in df.select("i", X.email_core(F.col("text")).alias("c")).collect():
        assert r.c == _core(bodies[r.i]), bodies[r.i]


def test_body_falls_back(spark):
    row = spark.range(1).select(X.body_or_subject(F.lit(""), F.lit("s")).alias("a"), X.body_or_subject(F.lit(""), F.lit("")).alias("b"), X.recipient_context(F.lit(" "), F.lit("cc"), F.lit(None).cast("string")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("s", "(empty email body)", None)


def test_strip_html(spark):
    cases = {"<p>a&amp;lt;b</p>": "a<b", "a > b": "a  b", "x <unclosed": "x ", "&nbsp;&gt;": " >"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.s for r in df.select("h", X.strip_html(F.col("h")).alias("s")).collect()} == cases


def test_choice_is_little_endian(spark):
    digest = "0102030405060708" + "0" * 48
    want = int.from_bytes(bytes(range(1, 9)), "little") % 97
    assert spark.range(1).select(H.choice(F.lit(digest), F.lit(97)).alias("c")).first().c == want


def test_journal_blocks_are_greedy(spark):
    rows = [(1, i, s) for i, s in enumerate([30, 20, 10, 45, 5, 60])]
    out = journal_blocks(spark.createDataFrame(rows, "journal long, seq long, n_bytes long"), limit=60).orderBy("seq").collect()
    assert [r.block_seq for r in out] == [0, 0, 0, 1, 1, 2]

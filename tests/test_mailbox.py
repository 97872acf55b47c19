"""The mailbox source: any cut of a file into byte ranges gives the messages of one read."""

import hashlib
import io
import random

import pytest

from siltstone.sources import mail, mailbox

HARD = [
    b"", b"x", b"From ", b"From a", b"From a\n", b"From a\nFrom b\n", b"From a\nFrom b", b"pre\nFrom a\nbody\n", b"From a\nbody", b"From a\nbody\nFrom b\n\nFrom c\nlast\n",
    b"From a\n From b\n>From c\nFromage\nFrom d\nx", b"\nFrom a\n\n\nFrom b\n", b"a\rFrom b\rc\n\x85From d\nFrom e\nf\r\n", b"From a\r\nbody\r\n\r\nFrom b\r\nbody\r\n", b"no mail\nat all\n",
]


def plain(data: bytes) -> list[bytes]:
    out, current = [], b""
    for line in data.split(b"\n"):
        whole = line + b"\n"
        if line.startswith(b"From "):
            out.append(current)
            current = b""
        else:
            current += whole
    out.append(current)
    out[-1] = out[-1][:-1] if not data.split(b"\n")[-1].startswith(b"From ") else out[-1]
    return [m for m in out if m]


def _read(data, lo, hi):
    f = io.BytesIO(data)
    f.seek(max(lo - 1, 0))
    return list(mailbox.messages_in(f.read, lo, hi))


def _random(seed):
    rng = random.Random(seed)
    return b"".join(rng.choice([b"From ", b"\n", b"\nFrom ", b"a", b"From", b"\r\n", b"x" * rng.randint(0, 30)]) for _ in range(rng.randint(1, 60)))


@pytest.mark.parametrize("buffer", [1, 3, 7, 1 << 20])
def test_every_cut_gives_the_rows_of_one_read(monkeypatch, buffer):
    monkeypatch.setattr(mailbox, "_READ", buffer)
    monkeypatch.setattr(mailbox, "_BATCH", buffer * 2)
    for data in [*HARD, *map(_random, range(60))]:
        whole = _read(data, 0, len(data))
        assert [m for _, m in whole] == plain(data)
        for cut in range(1, len(data)):
            assert _read(data, 0, cut) + _read(data, cut, len(data)) == whole
        bits = [x for lo in range(0, len(data), 3) for x in _read(data, lo, min(lo + 3, len(data)))]
        assert bits == whole


def test_files_of_many_ranges(spark, tmp_path):
    boxes = {f"{i}.mbox" if i % 2 else f"{i}.MAIL": d for i, d in enumerate([*HARD, *map(_random, range(20))]) if d}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in boxes.items():
        (tmp_path / "in" / "deep" / name).write_bytes(data)
    (tmp_path / "in" / "other.eml").write_bytes(b"From a\nnot a mailbox\n")
    path = f"file://{tmp_path}/in"
    want = {n: (hashlib.sha256(d).hexdigest(), list(enumerate(plain(d)))) for n, d in boxes.items()}
    for step in (5, 1 << 20):
        rows = mailbox.mailbox_messages(spark, path, step)
        got = {}
        for r in rows.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], (r.mailbox_ref, []))[1].append((r.message_index, bytes(r.raw)))
        assert {n: (h, sorted(m)) for n, (h, m) in got.items()} == {n: x for n, x in want.items() if x[1]}
    assert mailbox.read_mailboxes(spark, path, range_bytes=5).rdd.getNumPartitions() == sum(-(-len(d) // 5) for d in boxes.values())
    assert {r.path.rsplit("/", 1)[1]: r.messages for r in mail.mailbox_counts(spark, path).collect()} == {n: len(m) for n, (_, m) in want.items()}
    one = mailbox.mailbox_messages(spark, f"file://{tmp_path}/in/deep/{max(boxes, key=lambda n: len(boxes[n]))}", 7)
    assert one.count() == max((len(d), len(want[n][1])) for n, d in boxes.items())[1]


def test_held_content_and_files_agree(spark, tmp_path):
    for i, data in enumerate(d for d in HARD if d):
        (tmp_path / f"{i}.mbox").write_bytes(data)
    key = lambda rows: sorted((r.path, r.mailbox_ref, r.message_index, bytes(r.raw)) for r in rows.collect())
    path = f"file://{tmp_path}"
    assert key(mail.split_mailbox(mail.files(spark, path, "mbox"))) == key(mailbox.mailbox_messages(spark, path))

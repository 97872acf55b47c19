from siltstone.sources import mail

FULL = b"From x\nSubject: Hello\nFrom: a@b.c\nTo: list@d.e\nCc: other@d.e\nDate: Thu, 1 Jan 2026 00:00:00 +0000\nMessage-ID: <m1>\n\nFirst sentence. Second one.\n"


def _write(folder, **files):
    for name, data in files.items():
        (folder / name.replace("__", ".")).write_bytes(data)
    return f"file://{folder}"


def test_full_headers_make_one_chunk(spark, tmp_path):
    path = _write(tmp_path, a__mbox=FULL, b__MAIL=FULL, c__eml=FULL, d__mbox=b"")
    rows = mail.mailbox_items(spark, path).collect()
    assert len(rows) == 2 and {r.text for r in rows} == {"First sentence. Second one."}
    meta = rows[0].metadata
    assert meta["email_subject"] == meta["email_name"] == "Hello" and meta["email_recipient_context"] == "list@d.e"
    assert meta["chunk_locator"] == f"{rows[0].email_ref}:0" and meta["mailbox_message_index"] == "0"
    counts = {r.month: r.messages for r in mail.mailbox_counts(spark, path).collect()}
    assert counts == {"a": 1, "b": 1}


def test_splits_and_fallbacks(spark, tmp_path):
    box = b"Subject: first\n\nbody one\nFrom here on\nSubject: only\n\n> quoted\nFrom b\nX: y\n\n\nFrom c\nContent-Type: text/html\n\n<b>kept</b>\n"
    rows = mail.normalise(mail.split_mailbox(mail.files(spark, _write(tmp_path, a__mbox=box), "mbox"))).orderBy("message_index").collect()
    assert [r.body for r in rows] == ["body one", "only", "(empty email body)", "<b>kept</b>"]


def test_invalid_bytes_become_replacement(spark, tmp_path):
    single = b"Subject: s\n\nf\x80o\n"
    multi = b'Content-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/html\n\n<i>h</i>\n--B\nContent-Type: text/plain\n\nf\x80o\n--B--\n'
    rows = mail.normalise(mail.split_mailbox(mail.files(spark, _write(tmp_path, a__mbox=single, b__mbox=multi), "mbox"))).collect()
    assert [r.body for r in rows] == ["f�o"] * 2


def test_rerun_gives_the_same_refs_and_documents_come_along(spark, tmp_path):
    path = _write(tmp_path, a__mbox=FULL, n__TXT=b"note \xff")
    first, second = (sorted((r.kind, r.text, r.input_hash) for r in mail.all_items(spark, path, path).collect()) for _ in range(2))
    assert first == second and [k for k, *_ in first] == ["document", "email-chunk"]
    assert first[0][1] == "note �"


def test_snapshot_ids(spark, tmp_path):
    path = _write(tmp_path, a__mbox=FULL, b__txt=b"x")
    entries = mail.manifest(spark, path)
    assert sorted(r.relative_path for r in entries.collect()) == ["a.mbox", "b.txt"]
    one = mail.snapshot_id(entries, "u").first()
    assert one == mail.snapshot_id(entries.repartition(3), "u").first() and one.entries == 2
    assert one.source_snapshot_id != mail.snapshot_id(entries, "v").first().source_snapshot_id

"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, key string, carried string, node long, h long, lo int"


def texts(seed: int = 1) -> list[tuple[int | None, str | None, str | None]]:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 7))) for _ in range(80)]
    passage = " ".join(rng.choices(words, k=140))
    rows: list[tuple[int | None, str | None, str | None]] = []
    for i in range(60):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.append("A  shared line of some length")
        if i % 4 == 0:
            lines.append(passage + ("" if i % 8 else " tail"))
        if i % 5 == 0:
            lines.append(f"write to user{i % 10}@mail.example.com or +1 (555) 555-01{i:02d}, ip 10.0.{i}.7, card 4111 1111 1111 1111")
        rows.append((i, "\n".join(lines), ("en", "de")[i % 2]))
    rows += [
        (100, None, None), (101, "", "en"), (102, "   \t\n\x0b ", "en"), (103, "\n\n\n", None), (None, "text of a row without an id " * 20, "en"),
        (104, rows[0][1], "de"), (0, rows[0][1], "de"), (1, "same id, other text", None), (105, "x" * 20_000, "en"), (106, "1 " * 6_000, "en"), (107, "日本語 テスト 😀 " * 30, "ja"),
        (108, "Ünïcode ÉÈ " * 50 + "\r\n" + passage, "fr"), (109, "one", "en"), (110, "one two", "en"), (111, "one two", "en"), (112, "a b " * 200, "en"),
    ]
    return rows


def table(spark, rows=None):
    full = [(i, t, lang, "s", 7, "clash", "clash", "clash", -1, -2, -3) for i, t, lang in (texts() if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

"""Terms that disclose an entity, sought in whole texts."""

from siltstone.llm import pii
from tests.llm import cases


def test_terms_of_other_lines_and_of_a_shared_line_are_marked_everywhere(spark):
    filler = [(1000 + i, f"nothing w{w} here the", None) for i, w in enumerate("abc def ghi jkl".split() * 20)]
    above = [(i, f"the {w} Xu\n" + "here the " * 60 + f"\nnothing q@x.org\nthe xu", None) for i, w in enumerate(("red", "blue", "green", "grey"))]
    line = [(100 + i, f"some {w} text\nContact Zorblax at z@x.org\nnothing here, ZORBLAX, the", None) for i, w in enumerate(("one", "two", "three", "four", "five"))]
    copies = [(500 + i, "the Rarity word beside c@x.org", None) for i in range(5)]
    got = {r.doc_id: [r.text[s.start : s.end] for s in r.spans if s.kind_no == 4] for r in pii.find_private(cases.table(spark, filler + above + line + copies)).collect()}
    assert {i: got[i] for i in range(4)} == {i: ["Xu", "xu"] for i in range(4)}
    assert all(got[100 + i] == ["some", "text", "Contact", "Zorblax", "at", "ZORBLAX"] for i in range(5))
    assert all(not got[i] for i in got if i >= 500)

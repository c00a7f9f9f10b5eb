"""Span algebra against a model: every character carries its origin."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions import spans as S
from marginalia.functions.spans import Mod, Span


def test_replace_keeps_origins():
    text, spans = S.replace("Hello, my name is John Doe.", [Span(0, 27)], [(0, 5), (18, 22)], ["Hi", "Jane"])
    assert text == "Hi, my name is Jane Doe."
    assert spans == [Mod(2, (Span(0, 5),)), Span(5, 18), Mod(4, (Span(18, 22),)), Span(22, 27)]


def test_part_of_a_replacement_keeps_all_it_stands_for():
    once = S.replace("abcdef", [Span(0, 6)], [(1, 4)], ["XYZ"])
    text, spans = S.replace(*once, [(2, 5)], ["-"])
    assert (text, spans) == ("aX-f", [Span(0, 1), Mod(1, (Span(1, 4),)), Mod(1, (Span(1, 4), Span(4, 5))), Span(5, 6)])


def test_remove_insert_extract_move():
    start = "one two three", [Span(100, 113)]
    assert S.remove(*start, [(3, 7)]) == ("one three", [Span(100, 103), Span(107, 113)])
    assert S.insert(*start, [3, 13], [",", "!"]) == ("one, two three!", [Span(100, 103), Mod(1), Span(103, 113), Mod(1)])
    assert S.extract(*start, [(0, 3), (8, 13)]) == ("onethree", [Span(100, 103), Span(108, 113)])
    assert S.extract(*start, []) == ("", [])
    assert S.move(*start, (0, 4), 8) == ("two one three", [Span(104, 108), Span(100, 104), Span(108, 113)])
    assert S.move(*start, (8, 13), 0) == ("threeone two ", [Span(108, 113), Span(100, 108)])


@pytest.mark.parametrize("ranges, texts", [([(3, 2)], ["a"]), ([(0, 3), (2, 4)], ["a", "b"]), ([(0, 9)], ["a"]), ([(0, 1)], [])])
def test_bad_ranges(ranges, texts):
    with pytest.raises(ValueError):
        S.replace("abcd", [Span(0, 4)], ranges, texts)


def test_spans_must_fit():
    with pytest.raises(ValueError):
        S.replace("abcd", [Span(0, 3)], [], [])
    with pytest.raises(ValueError):
        S.move("abcd", [Span(0, 4)], (0, 2), 1)


def test_normalize_and_gaps():
    assert S.normalize([Mod(3, (Span(30, 35), Span(10, 15))), Span(15, 20), Span(25, 30)]) == [Span(10, 20), Span(25, 35)]
    assert S.normalize([Span(0, 5), Span(4, 8)]) == [Span(0, 5), Span(4, 8)]
    text = "heart  failure xxxx acute"
    assert S.close_gaps([Span(0, 5), Span(7, 14), Span(20, 25)], text, 3) == [Span(0, 14), Span(20, 25)]
    assert S.close_gaps([Span(0, 14), Span(20, 25)], text, 4) == [Span(0, 25)]
    assert S.overlaps(Span(0, 3), Span(2, 4)) and not S.overlaps(Span(0, 3), Span(3, 4))


@settings(max_examples=200, deadline=None)
@given(st.text(min_size=1, max_size=30), st.lists(st.tuples(st.integers(0, 30), st.integers(0, 5), st.text(max_size=4)), max_size=5))
def test_replace_against_characters(text, edits):
    ranges, new, at = [], [], 0
    for start, length, t in sorted(edits):
        a = min(max(start, at), len(text))
        b = min(a + length, len(text))
        ranges.append((a, b))
        new.append(t)
        at = b
    out, spans = S.replace(text, [Span(0, len(text))], ranges, new)
    assert sum(map(S.size, spans)) == len(out)
    at = 0
    for s in spans:
        if isinstance(s, Span):
            assert out[at : at + S.size(s)] == text[s.start : s.end]
        at += S.size(s)


def test_column_form(spark):
    from marginalia.schema import SPAN

    cases = [[Mod(3, (Span(30, 35), Span(10, 15))), Span(15, 20)], [], [Span(3, 4)], [Mod(2)]]
    df = spark.createDataFrame([(i, S.to_rows(c)) for i, c in enumerate(cases)], f"i int, s array<{SPAN}>")
    for r in df.select("i", S.normalize_column(df.s).alias("n")).collect():
        assert [Span(x["start"], x["end"]) for x in r["n"]] == S.normalize(cases[r["i"]])

from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import splitting
from lodeweave.llm.splitting import pieces_of, spans, split_oversized

word = st.text("abcdeé", min_size=1, max_size=9)
gap = st.sampled_from([" ", " ", " ", ". ", "\n", "\r\n", "\n\n", "? ", "", "   "])


def joined(pieces):
    return "".join(w + g for w, g in pieces)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(word, gap), max_size=300).map(joined), st.sampled_from([100, 200, 333]))
def test_pieces_cover_the_text_within_the_limit(text, limit):
    overlap = limit // 10
    got = spans(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, cut), (c, d, _) in zip(got, got[1:]):
        assert b - a <= limit and c <= b and b - c <= overlap and d > b
        if cut in ("paragraph", "line"):
            assert text[b - 1] in "\r\n"
        if cut == "word":
            assert text[b].isspace() and not text[b - 1].isspace()
        if b - c < overlap:
            assert c == b or text[c - 1].isspace()
        if cut == "none":
            assert not any(x.isspace() for x in text[a + 2 * overlap + 2 : b])


def test_cuts_where_the_topic_changes():
    a = "The cat sat near the warm oven with another cat. " * 30
    b = "Bonds yield interest as markets price new credit risk. " * 30
    text = a + "\n" + b
    (first, *_) = spans(text, 2000, 20)
    assert abs(first[1] - len(a)) < 120


def test_no_place_to_cut():
    assert [(e - s) for s, e, _ in spans("x" * 13_000)] == [6000, 6000, 1300]
    text = "é" * 4000
    assert all(text[e : e + 1] != "́" for _, e, _ in spans(text))
    assert spans(" " * 7000)[-1][1] == 7000 and spans("a\n" * 5000)[-1][1] == 10_000
    assert spans("") == [(0, 0, "end")]


def test_operator(spark):
    long = "word " * 3000
    rows = [("a", long, 1), ("b", "short", 2), ("c", None, 3), (None, long, 4), ("a", long, 5), ("d", "", 6)]
    df = spark.createDataFrame(rows, "id string, text string, piece_no int")
    got = split_oversized(df, "id", "text").collect()
    assert {r.id for r in got} == {"a", None}
    one = sorted((r.piece_no, r.start, r.end, r.text) for r in got if r.id is None)
    assert all(long[s:e] == t for _, s, e, t in one) and [r[0] for r in one] == list(range(len(one)))
    assert len([r for r in got if r.id == "a"]) == 2 * len(one)
    assert {r.id for r in split_oversized(df, "id", "text", whole=True).collect()} == {"a", "b", "d", None}
    assert split_oversized(spark.createDataFrame([], "id string, text string"), "id", "text").count() == 0


def test_limit_must_hold_overlaps():
    import pytest

    with pytest.raises(ValueError):
        pieces_of("text", 100, 30)


def test_memory_does_not_grow_with_the_text():
    import random
    import tracemalloc

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ".\n\n"]) for _ in range(700_000))
    splitting.spans(text[:50_000])
    tracemalloc.start()
    got = splitting.spans(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 3_000_000 and peak < 60_000_000
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - s <= 6000 for s, e, _ in got)
    assert all(0 <= a[1] - b[0] <= 150 for a, b in zip(got, got[1:])) and {c for *_, c in got[:-1]} <= {"paragraph", "sentence", "line"}


def test_windows_cut_where_the_whole_would():
    import random

    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(400)) + "\n\n"
    text = "".join(text[k : k + 300] + rng.choice([". ", "\n", "\n\n", " "]) for k in [rng.randrange(100) for _ in range(400)])
    whole, parts = splitting.spans(text, 900, 60, window=10**9), splitting.spans(text, 900, 60, window=8000)
    assert [e for _, e, c in parts] and all(text[e - 1 : e + 1].strip() != text[e - 1 : e + 1] for _, e, c in parts[:-1])
    same = {e for _, e, _ in whole} & {e for _, e, _ in parts}
    assert len(same) > 0.5 * len(whole)

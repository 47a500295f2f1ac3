import base64
import random
from unittest import mock

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeweave.llm import tokens


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return tokens.encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")


def ids_of(encoder, texts):
    flat, n = encoder.encode(texts)
    out, at = [], 0
    for k in n.tolist():
        out.append(flat[at : at + k].tolist())
        at += k
    return out


piece = st.sampled_from(["'s", "'ll", "'re", "'ve", "'", "''", " ", "  ", "\n", "\t", " ", " ", "a", "aaaa", "é", "ß", "1", "²", "٣", "中", "🙂", "<|endoftext|>", ".", "...", "\r\n", "\x1c", "\x85", " the", "'S", "​", "_", "Ⅷ", "é"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.lists(piece, max_size=12).map("".join), st.text(max_size=30)), min_size=1, max_size=4))
def test_same_ids_as_the_public_library(encoder, reference, texts):
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_texts_without_a_place_to_split(encoder, reference):
    texts = ["a" * 3000, " " * 2000 + "x", "ab" * 1500, "中" * 1000, "\n" * 500]
    assert ids_of(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_words_are_forgotten_without_harm(reference):
    enc = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    for k in range(3):
        text = " ".join(f"w{i}x{k}" for i in range(200))
        enc.clear()
        assert ids_of(enc, [text, "", text]) == [reference.encode_ordinary(text), [], reference.encode_ordinary(text)]


def test_encode_corpus(spark, reference):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (3, "", None), (3, "again <|endoftext|>", "z"), (None, "no id", "z"), (4, "long " * 50_000, "z")]
    got = tokens.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()
    want = sorted((i, reference.encode_ordinary(t or "")) for i, t, _ in rows if i is not None)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == want
    assert [r.ids for r in got if r.doc_id is None] == [reference.encode_ordinary("no id")]
    assert tokens.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_counts_are_lengths(spark):
    df = spark.createDataFrame([("a b c",), (None,), ("",)], "text string")
    assert [tuple(r) for r in df.select(tokens.token_count("text"), "text").collect()] == [(3, "a b c"), (0, None), (0, "")]


def test_rows_made_by_replay_are_those_of_single_steps():
    auto = tokens.Automaton(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(1)
    arcs = sorted(auto.ids.values())
    for state in [*rng.sample(arcs, 25), auto.ids[b"a"], auto.ids[b" "]]:
        row = auto.row(state)
        assert all(bool(row[a]) == auto._step(state, a, tokens.LAST) for a in [*rng.sample(arcs, 4000), state])


def test_dense_rows_change_nothing(reference):
    auto = tokens.Automaton(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgherstn") for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    for often in (10**9, 1):
        with mock.patch.object(tokens, "OFTEN", often), mock.patch.object(tokens, "DENSE", 300):
            for w in words[: 3000 if often > 1 else 600]:
                ids = auto.encode(w.encode())
                assert ids == reference.encode_ordinary(w) and auto.decode(ids) == w.encode()
    assert 0 < len(auto.rows) <= 300


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(piece, max_size=12).map("".join), st.text(max_size=60)))
def test_labels_on_the_path_give_the_text_back(encoder, text):
    flat, _ = encoder.encode([text])
    assert encoder.automaton.decode(flat.tolist()).decode() == text


def test_words_of_one_hash_are_told_apart(reference):
    enc = tokens.Encoder(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    with mock.patch.object(tokens.cp, "run_hashes", lambda points, starts, ends: (ends - starts).astype("uint64") % 3):
        for texts in (["the cat sat", "tin can"], ["a dog ran", "the tin"]):
            assert ids_of(enc, texts) == [reference.encode_ordinary(t) for t in texts]


def test_decoded(spark):
    df = spark.createDataFrame([(1, "Grüße 🙂 <|endoftext|>"), (2, None), (3, "")], "doc_id bigint, text string")
    got = tokens.encode_corpus(df).select("doc_id", tokens.decoded("ids").alias("t"))
    assert {r.doc_id: r.t for r in got.collect()} == {1: "Grüße 🙂 <|endoftext|>", 2: "", 3: ""}
    odd = spark.createDataFrame([([0, 10**6, None, -5],), (None,)], "ids array<int>").select(tokens.decoded("ids").alias("t"))
    assert [r.t for r in odd.collect()] == ["!", ""]

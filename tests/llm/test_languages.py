import random

import duckdb
import pytest

from lodeweave.llm import languages as lg

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples():
    return duckdb.sql(f"SELECT lang, text FROM '{DATA}/language_samples.parquet' ORDER BY sample_id").fetchall()


def test_held_out_samples(samples):
    right = 0
    for fold in range(4):
        flt = lg.Filter([s for i, s in enumerate(samples) if i % 4 != fold])
        held = [s for i, s in enumerate(samples) if i % 4 == fold]
        got = lg.segments(flt, [t for _, t in held])
        right += sum(g is not None and len(g) == 1 and g[0][0] == lang for (lang, _), g in zip(held, got, strict=True))
    assert right >= 0.97 * len(samples)


def test_case_marks_and_width_do_not_matter(samples):
    flt = lg.Filter(samples)
    import unicodedata

    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    for change in (str.upper, plain, lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace(" ", " ")):
        got = lg.segments(flt, [change(t) for _, t in samples])
        assert sum(g is not None and g[0][0] == lang for (lang, _), g in zip(samples, got, strict=True)) >= 0.99 * len(samples)


def test_segments_in_reading_order(samples):
    flt = lg.Filter(samples)
    by = dict(samples)
    text = by["en"] + "\n" + by["de"] + " " + by["en"]
    (got,) = lg.segments(flt, [text])
    assert [s[0] for s in got] == ["en", "de", "en"]
    assert got[0][2] == 0 and got[-1][3] == len(text) and all(a[3] == b[2] for a, b in zip(got, got[1:])) and all(0 <= s[1] <= 1 for s in got)
    quoted = by["en"].rstrip(".") + ' ("todas las declaraciones de los proveedores"). ' + by["en"]
    assert [s[0] for s in lg.segments(flt, [quoted])[0]] == ["en"]


def test_no_sentence(samples):
    flt = lg.Filter(samples)
    assert lg.segments(flt, ["", " \n", "——— 12/7 ———", "| 0 | 872.05 | 0x105 |", "0xA12 CTL-11 G/2020/8 d3adbeef00 " * 5, "12 34\n56"]) == [None] * 6


def test_filter_never_misses_what_it_holds(samples):
    flt = lg.Filter(samples)
    import numpy as np

    from lodeweave.llm import codepoints as cp

    for k, lang in enumerate(flt.langs):
        points, at = cp.buffer([t for x, t in samples if x == lang])
        for h, _ in lg.ngrams(*lg.folded(points, np.searchsorted(at, np.arange(len(points)), "right") - 1)):
            mask = np.bitwise_and.reduce([flt.tables[0][p] for p in flt._places(h)])
            assert ((mask >> k) & 1).all()


def test_operator(spark, samples):
    by = dict(samples)
    rows = [
        (1, by["en"], "EN"), (2, by["de"], "english"), (3, by["fr"], None), (4, None, "en"), (5, "", "en"), (6, "——— 1/2 ———", "??"), (7, by["el"], "gre"), (8, by["pt"] + "\n\n" + by["pl"], "pt-BR"),
        (9, by["es"], " es_MX "), (9, by["es"], " es_MX "), (None, by["it"], "und"), (10, by["nl"] * 200, "Dutch"), (11, by["en"], "en2"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 as seg_no", "'x' as label")
    sm = spark.createDataFrame(samples, "lang string, text string")
    got = sorted(((r.doc_id or 0), r.seg_no, r.lang, r.label_state, r.n_segments) for r in lg.label_languages(df, sm).collect())
    assert got == [(0, 1, "it", "missing", 1), (1, 1, "en", "ok", 1), (2, 1, "de", "wrong", 1), (3, 1, "fr", "missing", 1), (7, 1, "el", "ok", 1), (8, 1, "pt", "ok", 2), (8, 2, "pl", "ok", 2), (9, 1, "es", "ok", 1), (9, 1, "es", "ok", 1), (10, 1, "nl", "ok", 1), (11, 1, "en", "missing", 1)]
    assert lg.label_languages(df.limit(0), sm).count() == 0


def made_up(n, seed=5):
    """Texts of n languages that have words of their own."""
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 12)
        words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
        out[f"q{chr(97 + k // 26)}{chr(97 + k % 26)}"] = lambda rng, words=words: " ".join(rng.choice(words) for _ in range(12)) + "."
    return out


@pytest.mark.parametrize("n", [17, 40, 90])
def test_many_languages(spark, n):
    langs, rng = made_up(n), random.Random(6)
    sm = spark.createDataFrame([(k, make(rng)) for k, make in langs.items() for _ in range(30)], "lang string, text string")
    names = list(langs)
    rows = [(i, make(rng) + " " + make(rng), k.upper() + "-XX") for i, (k, make) in enumerate(langs.items())] + [(n, langs[names[0]](rng) * 3 + "\n" + langs[names[-1]](rng) * 3, None)]
    got = sorted((r.doc_id, r.seg_no, r.lang, r.label_state) for r in lg.label_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sm).collect())
    assert got == [(i, 1, k, "ok") for i, k in enumerate(langs)] + [(n, 1, names[0], "missing"), (n, 2, names[-1], "missing")]


def test_sorted_samples_beyond_the_bound_keep_every_language(spark):
    langs, rng = made_up(9), random.Random(7)
    sizes = [2000, 1500, 900, 300, 200, 50, 30, 15, 5]
    rows = [(k, make(rng)) for (k, make), n in zip(langs.items(), sizes) for _ in range(n)]
    sm = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    flt = lg.train(sm, max_samples=450)
    assert flt.langs == list(langs)
    found = [lg.segments(flt, [make(rng)])[0] for make in langs.values() for _ in range(20)]
    right = sum(f is not None and f[0][0] == k for f, k in zip(found, [k for k in langs for _ in range(20)]))
    assert right >= 0.97 * len(found)


def test_own_code_and_given_spellings(spark):
    df = spark.createDataFrame([("Cy",), ("CYM",), ("welsh",), ("zh-Hans",), ("zh",), ("",), (None,)], "l string")
    got = [r[0] for r in df.select(lg.normal_label(df.l, ["cy", "zh-hans"], {"cy": ["cym", "welsh"]})).collect()]
    assert got == ["cy", "cy", "cy", "zh-hans", None, None, None]

import random
import subprocess
import sys
from pathlib import Path
from unittest import mock

import numpy as np
import pytest

from lodeweave.llm import forest
from lodeweave.llm import likeness as lk
from tests.llm.test_neardup import bag, corpus, likeness

ROOT = Path(__file__).resolve().parents[2]


def brute(history, arrivals):
    kept = [b for t in history if (b := bag(t))]
    found = set()
    for no, t in sorted({a for a in arrivals if a[0] is not None}, key=lambda a: a[0]):
        b = bag(t)
        if b is None:
            continue
        if any(likeness(b, k) >= 0.7 for k in kept):
            found.add(no)
        else:
            kept.append(b)
    return found


def test_arrivals_against_brute_force(spark):
    texts = corpus(11, families=60)
    history, fresh = texts[::2][:80], texts[1::2]
    arrivals = [(i, t) for i, t in enumerate(fresh)] + [(500 + i, t) for i, t in enumerate(texts[200:])] + [(7, fresh[7]), (900, None), (901, ""), (902, "a b"), (903, history[0]), (None, fresh[0])]
    h = spark.createDataFrame([(t, "x") for t in [*history, None, "", history[0]]], "text string, _key string")
    a = spark.createDataFrame(arrivals, "arrival_no bigint, text string").selectExpr("*", "5 as _first")
    got = [r.arrival_no for r in forest.repeated_arrivals(h, a).collect()]
    want = brute(history, arrivals)
    assert len(got) == len(set(got)) and set(got) == want


def test_batches_one_after_the_other(spark):
    texts = corpus(13, families=40)
    arrivals = [(i, i // 30, t) for i, t in enumerate(texts[1::2])] + [(3, 0, texts[7]), (90, 3, None)]
    h = spark.createDataFrame([(t,) for t in texts[::8]], "text string")
    a = spark.createDataFrame(arrivals, "arrival_no bigint, batch_no int, text string")
    with mock.patch.object(forest, "MERGE_AFTER", 2), mock.patch.object(forest, "MERGE_SHARE", 9):
        got, at_once = ({r.arrival_no for r in forest.repeated_arrivals(h, a, batch_col="batch_no", together=x).collect()} for x in (0, 10))
    assert got == at_once == brute(texts[::8], [(n, t) for n, _, t in arrivals])


def test_chains_are_decided_in_order(spark):
    classes = spark.createDataFrame([(k, k) for k in range(1, 7)], "_key bigint, _first bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 6)], "_a bigint, _b bigint")
    none = spark.createDataFrame([], "_key bigint")
    assert sorted(r[0] for r in forest.resolve(classes, none, edges).collect()) == [2, 4, 6]
    stored = spark.createDataFrame([(1,)], "_key bigint")
    assert sorted(r[0] for r in forest.resolve(classes, stored, edges).collect()) == [1, 3, 5]


def test_chains_of_any_length_are_decided(spark):
    n = 5000
    classes = spark.createDataFrame([(k, k) for k in range(1, n + 40)], "_key bigint, _first bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(n + 1 + i, n + 2 + i) for i in range(24)], "_a bigint, _b bigint")
    none = spark.createDataFrame([], "_key bigint")
    with mock.patch.object(forest, "ROUNDS", 2):
        assert sorted(r[0] for r in forest.resolve(classes, none, edges).collect()) == [*range(2, n + 1, 2), *range(n + 2, n + 26, 2)]
    short = spark.createDataFrame([(i, i + 1) for i in range(1, 21)], "_a bigint, _b bigint")
    with mock.patch.object(forest, "ROUNDS", 2), mock.patch.object(forest, "COMPONENT", 3):  # too long for one task: in rounds
        assert sorted(r[0] for r in forest.resolve(classes, none, short).collect()) == [*range(2, 22, 2)]


def rows_of(spark, texts):
    return lk.text_rows(spark.createDataFrame([(t,) for t in texts], "text string"), [], "text")


def test_runs_can_be_appended_and_merged(spark, tmp_path, monkeypatch):
    texts = corpus(12, families=12)
    monkeypatch.setattr(forest, "MERGE_SHARE", 9)
    f = forest.HashForest.create(spark, f"file://{tmp_path}/f")
    f.accept(rows_of(spark, texts[:20]))
    f.accept(f.signed(rows_of(spark, texts[20:40])))
    assert f.runs == 2
    query = f.signed(rows_of(spark, texts[40:] + texts[:3]))
    before = {tuple(r) for r in f.search(query).collect()}
    f.merge()
    assert f.runs == 1 and {tuple(r) for r in f.search(query).collect()} == before
    assert sum(r[0] == r[1] and r[2] for r in before) == 3


def test_another_session_opens_the_forest(spark, tmp_path):
    texts = corpus(14, families=12)
    path = f"file://{tmp_path}/f"
    f = forest.HashForest.create(spark, path)
    f.accept(rows_of(spark, texts[:30]))
    f.accept(rows_of(spark, texts[30:36]))
    query = rows_of(spark, texts[36:] + texts[:2])
    before = {tuple(r) for r in f.search(f.signed(query)).collect()}
    code = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from lodeweave.session import local_session
from lodeweave.llm import forest
from lodeweave.llm import likeness as lk
from tests.llm.test_neardup import corpus
spark = local_session(2, 4, "2g")
f = forest.HashForest.open(spark, {path!r})
texts = corpus(14, families=12)
rows = lk.text_rows(spark.createDataFrame([(t,) for t in texts[36:] + texts[:2]], "text string"), [], "text")
print("got", f.runs, sorted(tuple(r) for r in f.search(f.signed(rows)).collect()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=ROOT)
    assert f"got 2 {sorted(before)}" in out.stdout, out.stderr[-2000:]


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    texts = corpus(15, families=4)
    path = f"file://{tmp_path}/f"
    one = forest.HashForest.create(spark, path)
    other = forest.HashForest.open(spark, path)
    one.accept(rows_of(spark, texts[:4]))
    with pytest.raises(Exception, match="exist"):
        other.accept(rows_of(spark, texts[4:8]))
    assert forest.HashForest.open(spark, path).accepted().count() == one.accepted().count() == 4


def test_hot_prefixes_are_dealt_to_several_buckets(spark, tmp_path):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = list(dict.fromkeys(" ".join([*base[: 60 - k % 7], f"x{rng.random()}"]) for k in range(90))) + corpus(16, families=5)
    fresh = [" ".join([*base[:57], f"n{k}"]) for k in range(6)] + texts[:3]
    found = []
    for hot in (10**9, 12):
        with mock.patch.object(forest, "HOT", hot):
            f = forest.HashForest.create(spark, f"file://{tmp_path}/f{hot}")
            f.accept(rows_of(spark, texts))
            assert bool(f.state["hot"]) == (hot == 12)
            found.append({tuple(r) for r in f.search(f.signed(rows_of(spark, fresh))).collect()})
    assert found[0] == found[1] and len(found[0]) > 300


def test_depth_keeps_the_recall_target():
    d = forest.widest_depth(0.7, forest.TREES, forest.RECALL)
    assert 1 - (1 - 0.7**d) ** forest.TREES >= forest.RECALL > 1 - (1 - 0.7 ** (d + 1)) ** forest.TREES


def test_trees_miss_independently():
    labels = forest.Labels()
    own = labels.trees[:, : labels.depth]
    assert len(np.unique(own)) == own.size == forest.TREES * labels.depth
    # recall of the actual layout at the threshold, where the values agree independently of each other
    agree = np.random.default_rng(1).random((20_000, len(labels.factors))) < forest.THRESHOLD
    met = agree[:, own].all(axis=2).any(axis=1).mean()
    assert met >= forest.RECALL


def test_labels_of_texts_at_the_threshold_meet():
    rng = random.Random(2)
    texts = []
    for _ in range(3000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:70])]
    labels = forest.Labels()
    prefix = labels.of(lk.Sets(texts)) >> np.uint64(8 * forest.DEEPER)
    assert (prefix[::2] == prefix[1::2]).any(axis=1).mean() > 0.988


def test_empty(spark):
    none = spark.createDataFrame([], "arrival_no bigint, text string")
    some = spark.createDataFrame([(1, "a b c " * 10)], "arrival_no bigint, text string")
    assert forest.repeated_arrivals(none, none).count() == 0
    assert forest.repeated_arrivals(none, some).count() == 0
    assert [r[0] for r in forest.repeated_arrivals(some, some).collect()] == [1]

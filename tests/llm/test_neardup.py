import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from lodeweave.llm import likeness as lk
from lodeweave.llm import neardup as nd


def bag(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return Counter(w) if 20 <= len(w) <= 400 else None


def likeness(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def corpus(seed, families=40, sizes=(20, 28, 40, 57, 80, 160, 300, 400)):
    """Families of texts that differ by random edits, insertions, deletions and order."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice(sizes))]
        texts.append(" ".join(base))
        for _ in range(3):
            t = list(base)
            for _ in range(int(len(base) * rng.choice([0.02, 0.1, 0.17, 0.25]))):
                kind = rng.random()
                if kind < 0.6:
                    t[rng.randrange(len(t))] = rng.choice(vocabulary)
                elif kind < 0.8:
                    t.insert(rng.randrange(len(t)), rng.choice(vocabulary))
                elif len(t) > 20:
                    t.pop(rng.randrange(len(t)))
            if rng.random() < 0.3:
                rng.shuffle(t)
            texts.append(" ".join(t[:400]).title())
    return texts


def brute(rows):
    bags = {i: b for i, t in rows if i is not None and (b := bag(t))}
    return {(min(a, b), max(a, b)) for a, b in combinations(sorted(bags), 2) if likeness(bags[a], bags[b]) >= 0.7}


def test_pairs_against_brute_force(spark):
    rows = [(f"c{i}", t) for i, t in enumerate(corpus(1))]
    rows += [("copy", rows[0][1]), ("c0", rows[0][1]), ("shuffled", " ".join(reversed(rows[0][1].split()))), ("null", None), ("empty", ""), ("short", "a b c"), (None, rows[0][1]), ("long", "x " * 100_000)]
    df = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 as _key", "2 as _id", "3 as n_links")
    got = {tuple(r) for r in nd.near_duplicates(df).collect()}
    want = brute(rows)
    assert got == want and ("c0", "copy") in got


@pytest.mark.parametrize(("run", "hot"), [(6, 10**6), (50_000, 8), (6, 8), (50_000, 10**6)])
def test_hot_signatures_are_cut_into_blocks(spark, run, hot):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[: 58 - k % 9], f"x{rng.random()}", f"y{k}"]) for k in range(40)] + corpus(8, families=8)
    bags = {frozenset(b.items()): b for t in texts if (b := bag(t))}.values()
    want = sum(likeness(a, b) >= 0.7 for a, b in combinations(bags, 2))
    rows = lk.text_rows(spark.createDataFrame([(t,) for t in texts], "text string"), [], "text")
    pairs = nd.candidates(rows, nd.PartEnum(), run=run, hot=hot)
    assert lk.verified(pairs, lk.feature_rows(rows, b"\xff" * len(lk.key_bitmap(rows))), 0.7).count() == want


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.8, 0.9])
def test_sizes_that_may_be_alike_share_a_band(threshold):
    sizes = np.arange(lk.LEAST_WORDS, lk.MOST_WORDS + 1)
    plan, small, either = nd.PartEnum(threshold), set(), set()
    for number, here, own, lost in plan.bands(sizes):
        small |= {(number, n) for n in sizes[here[own]].tolist()}
        either |= {(number, n) for n in sizes[here].tolist()}
        assert (sizes[here] - plan.parts[number] > lost).all()  # enough features in every case
    for a in sizes.tolist():
        assert sum((k, a) in small for k in range(len(plan.low))) == 1
        k = next(k for k in range(len(plan.low)) if (k, a) in small)
        assert all((k, b) in either for b in range(a, int(a / threshold + 1e-9) + 1) if b <= lk.MOST_WORDS)


@pytest.mark.parametrize("threshold", [0.6, 0.7, 0.85])
def test_what_a_text_may_lack_is_bounded_by_the_sizes(threshold):
    plan = nd.PartEnum(threshold)
    for a in range(20, 60):
        for b in range(a, min(60, int(a / threshold + 1e-9) + 1)):
            shared = min(s for s in range(a + 1) if s >= threshold * (a + b - s) - 1e-9)
            assert plan.lost(np.array([a]), np.array([b]))[0] >= a - shared and plan.lost(np.array([b]), np.array([a]))[0] >= b - shared


def test_contained_texts_at_the_threshold_are_never_missed():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(1500)]
    texts = []
    for small, large in [(20, 28), (39, 55), (42, 60), (59, 84), (79, 112), (113, 160), (126, 180), (159, 226), (280, 400)] * 25:
        base = [rng.choice(vocabulary) for _ in range(large)]
        texts += [" ".join(rng.sample(base, small)), " ".join(base)]
    for n in (20, 51, 100, 200, 399) * 20:  # equal sizes, as many edits as may be
        base = rng.sample(vocabulary, n)
        keep = next(s for s in range(n + 1) if s >= 0.7 * (2 * n - s) - 1e-9)
        texts += [" ".join(base), " ".join(rng.sample(base, keep) + [f"z{i}" for i in range(n - keep)])]
    s = lk.Sets(texts)
    for counts in (None, np.bincount(nd.place_of(s.features), minlength=nd.COUNTS)):
        rows, signatures, small, _ = nd.PartEnum().sign(s, counts)
        of, first = [set() for _ in texts], [set() for _ in texts]
        for row, signature, one in zip(rows.tolist(), signatures.tolist(), small.tolist()):
            of[row].add(signature)
            if one:
                first[row].add(signature)
        for i in range(0, len(texts), 2):
            assert of[i] & of[i + 1] & (first[i] | first[i + 1])
    e = lk.Entries(s.sizes, s.sketches(), nd.THRESHOLD)
    even = np.arange(0, len(texts), 2)
    assert e.close(even, e, even + 1).all()


def test_pairs_at_the_bound_are_all_found(spark):
    rng = random.Random(10)
    rows = []
    for k in range(800):
        base = [f"w{rng.randrange(4000)}" for _ in range(113)]
        rows += [(f"a{k}", " ".join(base[:80])), (f"b{k}", " ".join(base))]
    got = {tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert got == {(f"a{k}", f"b{k}") for k in range(800)}


def test_runs_in_tiles_give_the_pairs_of_steps():
    s = lk.Sets(corpus(21, families=60))
    entries = nd.entries_of(s)
    order = np.concatenate([np.argsort(entries["size"][:40], kind="stable"), 40 + np.argsort(entries["size"][40:], kind="stable")])
    entries = entries[order]
    starts, sizes, small = np.array([0, 40]), np.array([40, len(order) - 40]), np.array([25, 120])
    one = lk.Entries(entries["size"], entries["sketch"], nd.THRESHOLD)
    want = set()
    for a, n, m in zip(starts, sizes, small):
        i, j = (x + a for x in np.triu_indices(n, 1))
        ok = one.close(i, one, j) & (i - a < m)
        want |= {(min(p), max(p)) for p in zip(entries["key"][i[ok]].tolist(), entries["key"][j[ok]].tolist()) if p[0] != p[1]}
    assert {tuple(p) for p in nd.pairs_within(entries, starts, sizes, small, nd.THRESHOLD).T.tolist()} == want


def test_groups(spark):
    texts = corpus(5, families=15)
    rows = [(f"c{i}", t) for i, t in enumerate(texts)] + [("copy", texts[0]), ("null", None)]
    got = {r.chunk_id: r for r in nd.near_duplicate_groups(spark.createDataFrame(rows, "chunk_id string, text string")).collect()}
    assert set(got) == {i for i, t in rows if bag(t)}
    parent = {i: i for i in got}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(rows):
        parent[root(a)] = root(b)
    for a, b in combinations(sorted(got), 2):
        assert (got[a].group_id == got[b].group_id) == (root(a) == root(b))
    assert got["copy"].class_id == got["c0"].class_id and got["c0"].class_size >= 2


def test_components_of_a_long_path(spark):
    n = 10_000
    edges = [(i, i + 1) for i in range(n)] + [(2 * n, 2 * n + 1), (2 * n + 2, 2 * n + 1)]
    got = {r["_key"]: r["_group"] for r in nd.components(spark.createDataFrame(edges, "_a bigint, _b bigint")).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{2 * n + i: 2 * n for i in range(3)}}


def test_copies_of_one_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nd, "COPIES", 4)
    df = spark.createDataFrame([(f"c{i:02}", "a b c d " * 8) for i in range(23)], "chunk_id string, text string")
    assert {tuple(r) for r in nd.near_duplicates(df).collect()} == set(combinations([f"c{i:02}" for i in range(23)], 2))


def test_empty(spark):
    empty = spark.createDataFrame([], "chunk_id string, text string")
    assert nd.near_duplicates(empty).count() == 0 and nd.near_duplicate_groups(empty).count() == 0


def test_sets():
    s = lk.Sets(["a " * 20, "b", None, " ".join("ab" for _ in range(19)) + " c", "a " * 20 + "."])
    assert s.rows.tolist() == [0, 3, 4] and s.keys[0] == s.keys[2] != s.keys[1]
    assert s.sketches().shape == (3, lk.SKETCH_BITS // 64) and len(s.blobs()) == 3


def test_features_shared_by_a_single_pair(spark):
    rows = lk.text_rows(spark.createDataFrame([(t,) for t in ("a b c d " * 8, "a b c e " * 8)], "text string"), [], "text").orderBy("_key").collect()
    one = spark.createDataFrame([(bytes(rows[0]._features), bytes(rows[1]._features))], "x binary, y binary")
    assert one.select(lk.shared_features(one.x, one.y)).first()[0] == 24

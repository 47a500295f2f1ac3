import datetime as dt
from unittest import mock

import numpy as np

from lodeweave.llm import vectors

SCHEMA = "chunk_id string, embedding array<float>, embedding_model string, created_at timestamp_ntz, provider string, _id int"


def table(spark, x, model="m", start=0):
    at = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(f"{model}{i + start}", [float(a) for a in v], model, at, None, 1) for i, v in enumerate(x)], SCHEMA)


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, 64))
    pick = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 12, n))  # a third of all in one topic
    return centres[pick] + 0.6 * rng.standard_normal((n, 64))


def recall(got, x, k=5):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    want = {(f"m{i}", f"m{j}") for i in range(len(x)) for j in np.argsort(-s[i])[:k]}
    return len(want & {(r.chunk_id, r.neighbour) for r in got}) / len(want)


def test_recall_against_brute_force(spark):
    x = clustered(1500)
    with mock.patch.object(vectors, "CELL", 100), mock.patch.object(vectors, "BLOCK", 64), mock.patch.object(vectors, "ASKED", 200):
        got = vectors.nearest(table(spark, x)).collect()
    assert recall(got, x) >= 0.9 and len(got) == 1500 * 5
    assert all(r.chunk_id != r.neighbour for r in got)


def test_recall_with_coarse_cells_and_far_more_cells_than_probes(spark):
    x = clustered(2000, 4)
    with mock.patch.object(vectors, "CELL", 50), mock.patch.object(vectors, "FIRST", 9):
        got = vectors.nearest(table(spark, x), flat=10, sample=600).collect()
    assert recall(got, x) >= 0.9 and len(got) == 2000 * 5


def test_lengths_do_not_matter_and_small_models(spark):
    x = clustered(4)
    got = vectors.nearest(table(spark, x * np.array([[1e-30], [1e20], [3.0], [0.1]]))).collect()
    assert len(got) == 12 and recall(got, x, 3) == 1.0


def test_only_the_latest_usable_record_counts(spark):
    x = clustered(30)
    old, new = dt.datetime(2023, 1, 1), dt.datetime(2025, 1, 1)
    bad = [
        ("m0", [0.0] * 64, "m", new, None, 1),  # the latest of m0 can't be used
        ("m1", [float(a) for a in x[5]], "m", old, None, 1),  # older than m1's
        ("short", [1.0] * 63, "m", old, None, 1), ("nan", [float("nan")] + [1.0] * 63, "m", old, None, 1), ("inf", [float("inf")] + [1.0] * 63, "m", old, None, 1),
        ("hole", [None] + [1.0] * 63, "m", old, None, 1), ("none", None, "m", old, None, 1), (None, [1.0] * 64, "m", old, None, 1), ("x", [1.0] * 64, None, old, None, 1), ("when", [1.0] * 64, "m", None, None, 1),
        ("m2", [float(a) for a in x[2]], "m", dt.datetime(2024, 1, 1), None, 1),  # a repeat
    ]
    df = table(spark, x).unionByName(spark.createDataFrame(bad, SCHEMA)).unionByName(table(spark, x[:3], "other"))
    got = vectors.nearest(df).collect()
    assert {r.chunk_id for r in got if r.model == "m"} == {*(f"m{i}" for i in range(1, 30)), "when"}
    assert {(r.chunk_id, r.neighbour) for r in got if r.model == "other"} == {(f"other{i}", f"other{j}") for i in range(3) for j in range(3) if i != j}
    assert len({(r.chunk_id, r.rank) for r in got if r.model == "m"}) == 150


def test_copies_are_neighbours(spark):
    x = np.repeat(clustered(3), 4, axis=0)
    got = {frozenset(map(str, r)) for r in vectors.similar_pairs(vectors.nearest(table(spark, x))).collect()}
    assert {frozenset((f"m{a}", f"m{b}")) for k in range(3) for a in range(4 * k, 4 * k + 4) for b in range(4 * k, a)} <= got


def test_bounds_hold():
    x = clustered(400, 3)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    turn, centre = vectors.rotation(64), x.mean(0)
    m = vectors.encode(np.arange(400), x, np.broadcast_to(centre, x.shape), turn)
    q = np.zeros(400, vectors.query_type(64))
    q["id"], q["least"], q["vector"] = np.arange(400) + 1000, -np.inf, x
    i, j, c, reranked = vectors.search(m, q, centre, turn, 5)
    assert reranked < 0.25 * 400 * 400
    s = x @ x.T
    best = np.sort(s, axis=1)[:, -5:]
    assert np.isclose(np.sort(c.reshape(400, 5), axis=1), best, atol=1e-5).mean() > 0.97


def test_empty(spark):
    assert vectors.nearest(spark.createDataFrame([], SCHEMA)).count() == 0

import random

import numpy as np

from lodeweave.llm.packing import Plan, best_fit, configurations, pack


def check(rows, sizes, capacity):
    used, pieces = {}, {}
    for r in rows:
        if r.container_id is not None:
            used[r.container_id] = used.get(r.container_id, 0) + r.size
        pieces.setdefault(r.doc_id, []).append((r.seg_no, r.start, r.size))
    assert max(used.values(), default=0) <= capacity
    for doc, n in sizes.items():
        got = sorted(pieces[doc])
        assert sum(p[2] for p in got) == max(n or 0, 0)
        assert len(got) == max(1, -(-max(n or 0, 0) // capacity))
        assert [p[1] for p in got] == [k * capacity for k in range(len(got))]
    return len(used)


def test_every_piece_in_one_container(spark):
    rng = random.Random(7)
    sizes = {i: rng.choice([rng.randint(1, 300), rng.randint(200, 1500), rng.randint(1, 6000)]) for i in range(3000)}
    sizes |= {9001: 2048, 9002: 2049, 9003: 4096, 9004: 0, 9005: None, 9006: -3}
    df = spark.createDataFrame([(i, n, "x") for i, n in sizes.items()], "doc_id bigint, n_tokens int, size string")
    used = check(pack(df).collect(), sizes, 2048)
    assert used <= 1.02 * -(-sum(max(n or 0, 0) for n in sizes.values()) // 2048) + 1


def test_one_size_for_a_third_of_all(spark):
    sizes = {i: 700 if i % 3 else 640 for i in range(2000)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens int")
    assert check(pack(df).collect(), sizes, 2048) <= 680  # 640 and two of 700 make 2040


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([("a", 5), ("a", 5), (None, 7), (None, None)], "doc_id string, n_tokens bigint")
    got = pack(df).collect()
    assert sorted(r.size for r in got) == [0, 5, 5, 7]
    assert sum(r.container_id is None for r in got) == 1
    assert pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0


def test_configurations_reach_the_fractional_optimum():
    patterns, times = configurations(np.array([60, 50, 40]), np.array([10.0, 10.0, 10.0]), 100)
    assert (np.array([60, 50, 40]) @ patterns <= 100).all()
    assert abs(times.sum() - 15) < 1e-6
    assert np.allclose(patterns @ times, 10)


def test_slots_are_used_once():
    plan = Plan({60: 11, 50: 7, 40: 13}, 100, 3, 12)
    seen = {}
    for g, n in ((0, 11), (1, 7), (2, 13)):
        for c in plan.place(np.full(n, g), np.arange(n)).tolist():
            if c >= 0:
                seen.setdefault(c, []).append([60, 50, 40][g])
    assert all(sum(v) <= 100 for v in seen.values())


def test_best_fit_takes_the_tightest_room():
    where, opened = best_fit([30, 12, 50], [12, 30, 45, 87], 100)
    assert where == [1, 0, 2, 3] and opened == 1
    assert best_fit([30], [5, 90], 100) == ([3 - 2, 1], 1)  # the larger opens one, whose rest is tighter than 30

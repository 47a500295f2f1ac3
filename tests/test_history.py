import datetime as dt
import random

import pytest

from lodeweave.operators.history import bare_version, believed, current_versions, ledger

SCHEMA = "update_id bigint, provision_id string, version string, effective_date date, action string, recorded_at timestamp_ntz, document_id string, slice int"
FOREVER = dt.date(9999, 12, 31)


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def moment(n):
    return dt.datetime(2021, 1, 1) + dt.timedelta(hours=n)


def timeline(rows):
    """{version: (from, to)} that the given rows lead to."""
    starts, repeals = {}, set()
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if r[3] is None:
            continue
        if r[4] == "repeal":
            repeals.add(r[3])
        elif r[2] is not None:
            starts[r[2].lower().replace("version", "").strip("v. ")] = r[3]
    edges = sorted(repeals | set(starts.values()))
    return {v: (d, next((e for e in edges if e > d), FOREVER)) for v, d in starts.items()}


def made(seed, provisions=6, rows=60):
    rng, out = random.Random(seed), []
    for p in range(provisions):
        for k in range(rows):
            v = f"{rng.randint(1, 4)}.{rng.randint(0, 1)}"
            action = rng.choices(["amend", "snapshot", "correct", "repeal"], [3, 5, 2, 1])[0]
            out.append((p * 1000 + k, f"P{p}", None if action == "repeal" else rng.choice([v, f"v{v}", f" {v} ", f"Version {v}"]), None if rng.random() < 0.1 else day(rng.randint(0, 40)), action, moment(k * 7 + rng.randint(0, 5)), f"d{v}", 1))
    return out + out[:20]


@pytest.mark.parametrize("hot", [5, 17, 10**6])
def test_what_was_believed_at_any_time(spark, hot):
    rows = made(hot)
    book = ledger(spark.createDataFrame(rows, SCHEMA), hot_rows=hot).collect()
    for p in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == p]
        for t in [moment(n) for n in range(-1, 450, 37)] + [None]:
            want = timeline([r for r in mine if t is None or r[5] <= t])
            held = [b for b in book if b.provision_id == p and (b.recorded_to is None if t is None else b.recorded_from <= t and (b.recorded_to is None or b.recorded_to > t))]
            assert {b.version: (b.valid_from, b.valid_to) for b in held} == want and len(held) == len(want)


def test_slices_change_nothing(spark):
    df = spark.createDataFrame(made(3), SCHEMA)
    assert {tuple(r) for r in ledger(df, hot_rows=4).drop("update_id").collect()} == {tuple(r) for r in ledger(df).drop("update_id").collect()}


def test_nothing_is_overwritten(spark):
    rows = [(1, "P", "1.0", day(0), "amend", moment(0), "a", 1), (2, "P", "2.0", day(30), "amend", moment(1), "b", 1), (3, "P", "2.0", day(20), "correct", moment(2), "b", 1)]
    got = sorted((r.version, r.valid_from, r.valid_to, r.recorded_from, r.recorded_to) for r in ledger(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [(g[0], g[1], g[2]) for g in got] == [("1.0", day(0), day(20)), ("1.0", day(0), day(30)), ("1.0", day(0), FOREVER), ("2.0", day(20), FOREVER), ("2.0", day(30), FOREVER)]
    assert got[2][4] == got[1][3] == moment(1) and got[1][4] == got[0][3] == moment(2) and got[0][4] is None


def test_nulls_ties_and_no_rows(spark):
    rows = [(1, None, "1.0", day(0), "amend", moment(0), None, None), (2, "P", None, day(1), "amend", moment(0), "a", 1), (3, "P", "none", day(1), "amend", moment(0), "a", 1), (4, "P", "1.0", None, "amend", moment(0), "a", 1), (5, "P", "1.0", day(1), "amend", None, "a", 1), (6, "P", None, day(9), "repeal", moment(0), "a", 1), (7, "Q", "1.0", day(1), "amend", moment(0), "a", 1), (8, "Q", "1.0", day(2), "amend", moment(0), "a", 1), (9, "Q", "3.0", day(2), "amend", moment(1), "a", 1)]
    got = sorted(((r.provision_id or ""), r.version, r.valid_from, r.valid_to) for r in believed(ledger(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [("", "1.0", day(0), FOREVER), ("Q", "1.0", day(2), FOREVER), ("Q", "3.0", day(2), FOREVER)]
    assert ledger(spark.createDataFrame([], SCHEMA)).count() == 0


def test_current_and_successor(spark):
    rows = [(1, "P", "1.0", day(0), "amend", moment(0), "a", 1), (2, "P", "2.0", day(30), "amend", moment(1), "b", 1), (3, "R", "1.0", day(0), "amend", moment(0), "c", 1), (4, "R", None, day(5), "repeal", moment(1), "c", 1)]
    book = ledger(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.provision_id, r.version, r.is_current, r.superseded_by) for r in current_versions(book).collect()) == [("P", "1.0", False, "b"), ("P", "2.0", True, None), ("R", "1.0", False, None)]
    assert sorted((r.provision_id, r.version) for r in current_versions(book, "2020-01-03").filter("is_current").collect()) == [("P", "1.0"), ("R", "1.0")]


def test_spellings(spark):
    df = spark.createDataFrame([("v2.1",), (" 2.1 ",), ("Version 2.1",), ("none",), (None,)], "v string")
    assert [r[0] for r in df.select(bare_version(df.v)).collect()] == ["2.1", "2.1", "2.1", None, None]

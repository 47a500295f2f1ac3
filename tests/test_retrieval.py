import math
import random

import numpy as np
import pytest

from lodeweave import session
from lodeweave.operators import dense, fusion
from lodeweave.operators.bm25 import BM25Index, scan_search
from lodeweave.operators.dense import dense_search, scores
from lodeweave.functions import cosine, norm, sigmoid
from lodeweave.plans import retrieval

SMALL = "/root/testdata/sf0.001"


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, id string, score double, rank int")


def test_rrf_values_and_order(spark):
    dense, sparse = hits(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "a", 0.5, 1)]), hits(spark, [(1, "b", 3.0, 1), (1, "a", 2.0, 2), (3, "c", 1.0, 1)])
    got = {(r.query_id, r.id): r for r in fusion.weighted_rrf(dense, sparse).collect()}
    assert got[1, "a"].rrf_score == pytest.approx(0.7 / 61 + 0.3 / 62, abs=1e-9) and got[1, "a"].fused_rank == 1
    assert got[2, "a"].bm25_rank is None and got[3, "c"].dense_rank is None and len(got) == 4
    assert fusion.weighted_rrf(dense.limit(0), sparse.limit(0)).count() == 0


def test_bm25_finds_the_rare_word(spark, tmp_path):
    docs = spark.createDataFrame([("c1", "see ERROR_CODE_0x834 now"), ("c2", "nothing to see"), ("c3", "see this too"), ("c4", None)], "id string, text string")
    index = BM25Index.build(docs, "id", "text")
    q = spark.createDataFrame([(1, "ERROR_CODE_0x834"), (2, "absent"), (3, None)], "query_id int, text string")
    assert [(r.query_id, r.id, r["rank"]) for r in index.search(q).collect()] == [(1, "c1", 1)]
    index.save(str(tmp_path))
    assert BM25Index.load(spark, str(tmp_path)).search(q).collect() == index.search(q).collect()
    assert BM25Index.build(docs.limit(0), "id", "text").search(q).count() == 0


def test_bm25_formula(spark):
    texts = {"a": "x y z z", "b": "x x q", "c": "x", "d": "y w"}
    index = BM25Index.build(spark.createDataFrame(list(texts.items()), "id string, text string"), "id", "text")
    got = {r.id: r.score for r in index.search(spark.createDataFrame([(1, "x y y")], "query_id int, text string")).collect()}
    words = {k: v.split() for k, v in texts.items()}
    n, avg = 4, sum(map(len, words.values())) / 4
    df = {t: sum(t in w for w in words.values()) for t in "xyzqw"}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    want = {k: round(sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ["x", "y", "y"]), 6) for k, w in words.items()}
    assert got == pytest.approx(want)


def test_dense_search_is_exact(spark):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, [0.0] * 6), (61, None), (62, [1.0] * 6), (63, [2.0] * 6)]
    df = spark.createDataFrame(vectors, "id int, embedding array<float>")
    q = df.filter("id % 20 = 2").withColumnRenamed("id", "query_id")
    got = dense_search(q, df, k=4).orderBy("query_id", "rank").collect()
    cos = lambda a, b: 0.0 if not any(b) else sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)
    vectors = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in vectors if v]
    for i, v in vectors:
        if i % 20 == 2:
            want = sorted(((-round(cos(v, w), 6), j) for j, w in vectors))[:4]
            assert [r.id for r in got if r.query_id == i] == [j for _, j in want]
    above = {(r.query_id, r.id) for r in scores(q, df, above=0.5).collect()}
    assert above == {(i, j) for i, v in vectors if i % 20 == 2 for j, w in vectors if round(cos(v, w), 6) > 0.5}


def test_prune(spark):
    def kept(scores_, margin, least=1):
        rows = [(1, i, s) for i, s in enumerate(scores_, 1)]
        return [r.final_rank for r in fusion.prune(spark.createDataFrame(rows, "query_id int, final_rank int, rerank_score double"), margin, least).orderBy("final_rank").collect()]

    assert kept([3.6, -1.2, -2.7, -2.9, -3.4], 0.3) == [1]
    assert kept([-1.0, -1.1, -1.2], 0.5) == [1, 2]
    assert kept([3.6, -1.2, -2.7, -2.9, -3.4], 0.3, 3) == [1, 2, 3]
    assert kept([1.0, None], 0.3) == [1, 2] and kept([1.0, 1.0], 0.3) == [1, 2] and kept([5.0], 0.1) == [1]


def test_merge(spark):
    def merged(rows):
        got = fusion.merge_subqueries(spark.createDataFrame([(1, *r) for r in rows], "query_id int, sub_id int, id string, rerank_score double")).orderBy("final_rank").collect()
        return got, [r.id for r in got]

    got, ids = merged([(0, "c1", 2.0), (0, "c2", 1.0), (1, "c1", 3.0), (1, "c3", 0.5)])
    assert ids == ["c1", "c2", "c3"] and got[0].rerank_score == 3.0 and got[0].all_subqueries == [0, 1] and got[0].primary_subquery == 0
    assert merged([(i, "a", 2.0) for i in range(4)] + [(0, "b", 2.1)])[1] == ["a", "b"]
    assert merged([(i, "a", 1.5) for i in range(8)] + [(0, "b", 2.2)])[1] == ["b", "a"]
    assert merged([(0, "a", None), (0, "b", -5.0)])[1] == ["b", "a"]


def test_neighbours(spark):
    chunks = spark.createDataFrame([("d", i) for i in range(6)] + [("e", 0)], "document_id string, chunk_index int")
    found = spark.createDataFrame([(1, "d", 2, 1, 3.0), (1, "d", 4, 2, 1.0), (1, "e", 0, 3, 0.5)], "query_id int, document_id string, chunk_index int, final_rank int, rerank_score double")
    got = [(r.document_id, r.chunk_index, r.final_rank, r.is_neighbour) for r in fusion.neighbours(found, chunks).orderBy("ord").collect()]
    assert got == [("d", 2, 1, False), ("d", 1, 1, True), ("d", 3, 1, True), ("d", 4, 2, False), ("d", 5, 2, True), ("e", 0, 3, False)]


def test_passthrough_and_rerank(spark):
    fused = spark.createDataFrame([(1, f"c{i}", i, "apple" if i == 7 else "pear") for i in range(1, 12)], "query_id int, id string, fused_rank int, text string")
    assert [r.id for r in fusion.passthrough(fused).orderBy("final_rank").collect()] == [f"c{i}" for i in range(1, 6)]
    from pyspark.sql import functions as F

    got = fusion.rerank(fused, fusion.lexical_score(F.lit("An apple"), F.col("text"))).orderBy("final_rank").collect()
    assert [r.id for r in got] == ["c7", "c1", "c2", "c3", "c4"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>")
    r = df.select(norm(df.a).alias("n"), cosine(df.a, df.b).alias("z"), cosine(df.a, df.a).alias("o"), sigmoid(df.a[0]).alias("s")).first()
    assert r.n == 5.0 and r.z == 0.0 and r.o == pytest.approx(1) and r.s == pytest.approx(1 / (1 + math.exp(-3)))


def test_bounded_search_finds_what_one_pass_finds(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(39, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(5, 40))) for i in range(400)] + [(400, None)], "id int, text string")
    queries = spark.createDataFrame([(i, text(rng.randrange(1, 6))) for i in range(30)] + [(99, "unknown")], "query_id int, text string")
    index = BM25Index.build(docs, "id", "text")
    assert sorted(index.search(queries, k=5, plain=0).collect()) == sorted(index.search(queries, k=5).collect())


def test_scan_finds_what_the_index_finds(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(39, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = spark.createDataFrame([(f"t{i:03}", text(rng.randrange(5, 40))) for i in range(400)] + [("none", None), ("blank", " "), *((f"same{i}", "w1 W2 w3") for i in range(9))], "id string, text string")
    asked = [text(rng.randrange(1, 6)) for _ in range(30)]
    queries = spark.createDataFrame(list(enumerate([*asked, asked[0], "w2, w1 W1", "w1 w1 w2", "unknown", "w5 unknown", None, ""])), "query_id int, text string")
    want = sorted(BM25Index.build(docs, "id", "text").search(queries, k=5).collect())
    for block, rows in ((50_000, 65_536), (4, 7)):  # several passes, and texts of a task not held at once
        got = sorted(scan_search(docs, "id", "text", queries, k=5, block=block, rows=rows).collect())
        assert [(r.query_id, r.id, r["rank"]) for r in got] == [(r.query_id, r.id, r["rank"]) for r in want]
        assert [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-6)
    assert scan_search(docs.limit(0), "id", "text", queries).count() == 0 and scan_search(docs, "id", "text", queries.limit(0)).count() == 0


def test_dense_hits_of_a_part_do_not_grow_with_its_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 4)).round(1)
    x[::3] = x[0]  # a third of all alike
    x[1] = 0
    df = spark.createDataFrame([(f"v{i:05}", row) for i, row in enumerate(x.tolist())], "id string, embedding array<float>")
    q = df.filter("int(substr(id, 2)) < 30").withColumnRenamed("id", "query_id")
    assert scores(q, df, k=3).count() == 90  # once per query: all vectors are one part
    got = dense_search(q, df, k=3).orderBy("query_id", "rank").collect()
    f = x.astype(np.float32).astype(float)
    n = np.linalg.norm(f, axis=1, keepdims=True)
    f = np.divide(f, n, out=np.zeros_like(f), where=n > 0)
    cosines = np.round(f[:30] @ f.T, 6)
    want = [(f"v{i:05}", f"v{j:05}") for i in range(30) for j in np.argsort(-cosines[i], kind="stable")[:3]]
    assert [(r.query_id, r.id) for r in got] == want
    monkeypatch.setattr(dense, "GROUP_BYTES", 8 * 4 * 1_000)
    assert dense_search(q, df, k=3).orderBy("query_id", "rank").collect() == got
    assert scores(q, df, above=0.999).count() == (cosines > 0.999).sum()


def test_fused_hits_leave_no_texts_on_disk(spark):
    held = session._cuts.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    out = retrieval.hybrid_rerank_passthrough(spark, SMALL)
    assert {p.rpartition("/")[2].rpartition("-")[0] for p in held[before:]}.isdisjoint({"postings", "hybrid-chunks", "hybrid-vectors"})
    assert out.count() > 0


def left_by(spark, query):
    held = session._cuts.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    assert query(spark, SMALL).count() > 0
    return {p.rpartition("/")[2].rpartition("-")[0] for p in held[before:]}


def test_hybrid_search_leaves_no_texts_on_disk(spark):
    assert left_by(spark, retrieval.hybrid_search).isdisjoint({"postings", "hybrid-chunks", "hybrid-vectors"})


def test_rrf_fusion_leaves_no_texts_on_disk(spark):
    assert left_by(spark, retrieval.rrf_fusion).isdisjoint({"postings", "hybrid-chunks", "hybrid-vectors"})


def test_neighbor_expand_leaves_no_texts_on_disk(spark):
    assert left_by(spark, retrieval.neighbor_expand).isdisjoint({"postings", "hybrid-chunks", "hybrid-vectors"})


def test_retrieval_trace_leaves_no_texts_on_disk(spark):
    assert left_by(spark, retrieval.retrieval_trace).isdisjoint({"postings", "hybrid-chunks", "hybrid-vectors"})

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodeweave.config import Settings, settings_from
from lodeweave.operators import audit, evaluation, snapshot
from lodeweave.streaming import ingest_batch

CHUNK = "chunk_id string, document_id string, chunk_index int, text string, legal_metadata struct<is_current:boolean,superseded_by:string>"


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id int")
    ranked = spark.createDataFrame([(1, d, i) for i, d in enumerate("AXB", 1)] + [(2, d, i) for i, d in enumerate("AAX", 1)] + [(3, "A", 1)], "query_id int, document_id string, rank int")
    rel = spark.createDataFrame([(1, "X"), (2, "X"), (4, "Z")], "query_id int, document_id string")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(q, ranked, rel).collect()}
    assert (got[1].recall_1, got[1].recall_3, got[1].precision_3, got[1].mrr) == (0.0, 1.0, 0.333333, 0.5)
    assert got[2].mrr == 0.5 and got[3].mrr is None and got[3].recall_1 is None and got[4].mrr == 0.0


def test_summary_counts_only_successes(spark):
    rows = [("a", "success", "CORRECT", True, 1.0), ("a", "error", None, None, None), ("b", "success", "PARTIAL", False, None), ("b", "success", "UNSUPPORTED", True, 0.5)]
    got = {r.category: r for r in evaluation.summary(spark.createDataFrame(rows, "category string, status string, verdict string, verification_pass boolean, mrr double")).collect()}
    assert got[None].accuracy == 0.5 and got[None].mrr == 0.75 and got[None].error_count == 1 and got[None].total == 4 and got["b"].hallucination_rate == 0.5


def test_compare(spark):
    def values(f1, acc, bad=0):
        rows = [(str(i), "citation_f1", f1[i], "success") for i in range(len(f1))] + [(str(i), "accuracy", acc, "success") for i in range(len(f1))] + [(f"e{i}", "coverage", None, "error") for i in range(bad)]
        return spark.createDataFrame(rows, "question_id string, metric string, value double, status string")

    found = {(r.metric, r.scope): r.status for r in evaluation.compare(values([0.9, 0.4], 0.5, 2), values([0.9, 0.9], 0.45)).collect()}
    assert found == {("citation_f1", "aggregate"): "fail", ("accuracy", "aggregate"): "info", ("error_count", "aggregate"): "fail", ("citation_f1", "per_question:1"): "fail"}
    same = evaluation.compare(values([0.9], 0.5), values([0.9], 0.5))
    assert evaluation.overall_status(same).first().status == "ok" and evaluation.overall_status(same.limit(0)).first().status == "ok"
    assert evaluation.config_drift({"k": 1}, {"k": 2})[0]["status"] == "warn" and evaluation.config_drift({}, {"k": 2}) == []


def test_question_files(spark, tmp_path):
    good = {"dataset": {"name": "n", "version": 1}, "questions": [{"id": "q1", "question": "?", "category": "factual", "expected": {"answer": "a", "citation_doc_ids": ["x.md", "y.md"]}}, {"id": "q2", "question": "?", "category": "negative", "expected": {"answer": "a", "citation_doc_ids": []}}]}
    path = tmp_path / "q.json"
    path.write_text(json.dumps(good))
    questions = evaluation.load_questions(spark, str(path))
    assert questions.count() == 2
    names = spark.createDataFrame([("x.md", "h1")], "filename string, document_id string")
    assert [r.id for r in evaluation.with_document_ids(questions, names).collect()] == ["q2"]
    both = names.union(spark.createDataFrame([("y.md", "h2")]))
    assert {r.id: r.citation_doc_ids for r in evaluation.with_document_ids(questions, both).collect()} == {"q1": ["h1", "h2"], "q2": []}
    for change in ({"questions": []}, {"dataset": {}, "questions": [good["questions"][0]] * 2}, {"dataset": {}, "questions": [good["questions"][0] | {"category": "x"}]}, {"dataset": {}, "questions": [{"id": 1}]}):
        path.write_text(json.dumps(change))
        with pytest.raises(ValueError):
            evaluation.load_questions(spark, str(path))


def test_baseline(spark, tmp_path):
    v = spark.createDataFrame([("1", "mrr", 1.0, "success")], "question_id string, metric string, value double, status string")
    evaluation.save_baseline(v.limit(0), str(tmp_path / "b"), "hash")
    evaluation.save_baseline(v, str(tmp_path / "b"), "hash")
    assert evaluation.load_baseline(spark, str(tmp_path / "b"), "hash").collect() == v.collect()
    with pytest.raises(ValueError):
        evaluation.load_baseline(spark, str(tmp_path / "b"), "other")
    assert evaluation.load_thresholds(None) == evaluation.THRESHOLDS


def test_store(spark, tmp_path):
    store = snapshot.ChunkStore(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.chunks() is None
    store.upsert(spark.createDataFrame([("c1", "d1", 0, "alpha", (True, None)), ("c2", "d2", 0, "beta", None)], CHUNK))
    first = store.versions()[-1]
    store.upsert(spark.createDataFrame([("c2", "d2", 0, "gamma", (True, None)), ("c3", "d3", 0, "", None)], CHUNK))
    assert {r.chunk_id: r.text for r in store.chunks().collect()} == {"c1": "alpha", "c2": "gamma", "c3": ""}
    assert {r.text for r in store.chunks(first).collect()} == {"alpha", "beta"}
    assert store.drift().count() == 0
    store.update_metadata(spark.createDataFrame([("c2", False, "d9")], "chunk_id string, is_current boolean, superseded_by string"))
    assert tuple(store.get("c2").first().legal_metadata) == (False, "d9") and tuple(store.get("c1").first().legal_metadata) == (True, None)
    store.delete_document("d1")
    assert {r.chunk_id for r in store.chunks().collect()} == {"c2", "c3"} and {r.id for r in store.index().postings.collect()} == {"c2"}
    with pytest.raises(Exception, match="metadata too large"):
        store.write(spark.createDataFrame([("c", "d", 0, "t", (True, "x" * 50_000))], CHUNK))
    assert store.by_document("d2").count() == 1


def test_drift_and_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in ids], "chunk_id string") for ids in ("abc", "cd"))
    assert sorted(tuple(r) for r in snapshot.drift(a, b).collect()) == [("a", "left"), ("b", "left"), ("d", "right")]
    found = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "source_path string, document_id string")
    known = spark.createDataFrame([("p", "1"), ("q", "x")], "source_path string, document_id string")
    assert {r.source_path: r.state for r in snapshot.change_state(found, known).collect()} == {"p": "unchanged", "q": "changed", "r": "new"}
    assert [r.source_path for r in snapshot.resume(found, known, "source_path").collect()] == ["r"]


def test_file_names(spark):
    d = spark.createDataFrame([("1", "x/Policy A.md"), ("1", "z/copy.md"), ("2", " "), ("3", None)], "document_id string, source_path string")
    assert [r.document_id for r in snapshot.named(d, "policy").collect()] == ["1"]
    assert [tuple(r) for r in snapshot.file_names(d).collect()] == [("1", "Policy A.md")]


def test_two_writers_of_one_version(spark, tmp_path):
    one, other = (snapshot.ChunkStore(spark, str(tmp_path / "s")) for _ in range(2))
    one.upsert(spark.createDataFrame([("c1", "d1", 0, "alpha", None)], CHUNK))
    planned = other._state()
    one.upsert(spark.createDataFrame([("c2", "d2", 0, "beta", None)], CHUNK))
    with pytest.raises(RuntimeError, match="another writer"):
        other._change(planned, spark.createDataFrame([("c3", "d3", 0, "gamma", None)], CHUNK))
    assert {r.text for r in one.chunks().collect()} == {"alpha", "beta"} and one.drift().count() == 0


def test_a_commit_writes_only_the_parts_it_changes(spark, tmp_path):
    store = snapshot.ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([(f"c{i}", f"d{i}", 0, f"text {i}", None) for i in range(40)], CHUNK))
    before = store._state()["parts"]
    store.upsert(spark.createDataFrame([("c3", "d3", 0, "other", None)], CHUNK))
    after = store._state()["parts"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.chunks().count() == 40 and store.by_document("d3").first().text == "other"


def test_indexing_marks_what_is_superseded_in_the_same_commit(spark, tmp_path):
    kind = "chunk_id string, document_id string, chunk_index int, text string, legal_metadata struct<regulation:string,authority:string,jurisdiction:string,article:string,section:string,clause:string,effective_date:date,is_current:boolean,superseded_by:string>"
    meta = lambda clause, year: ("GDPR", None, "EU", "5", None, clause, dt.date(year, 1, 1), True, None)
    store = snapshot.ChunkStore(spark, str(tmp_path / "s"))
    store.upsert(spark.createDataFrame([("a", "d1", 0, "x", meta("5.1", 2019)), ("b", "d1", 1, "y", meta("5.2", 2019)), ("n", "d1", 2, "z", None)], kind), superseding=True)
    store.upsert(spark.createDataFrame([("c", "d2", 0, "x2", meta("5.1", 2022))], kind), superseding=True)
    assert store.versions() == [1, 2]
    state = {r.chunk_id: r.legal_metadata and (r.legal_metadata.is_current, r.legal_metadata.superseded_by) for r in store.chunks().collect()}
    assert state == {"a": (False, "d2"), "b": (True, None), "c": (True, None), "n": None}


def test_ingest_replaces_changed_documents(spark, tmp_path):
    store = snapshot.ChunkStore(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame(rows, "source_path string, content string")
    texts = lambda: sorted(r.text for r in store.chunks().collect())
    ingest_batch(store, batch(("a.md", "# A\none"), ("b.md", "two"), ("n.md", None)))
    ingest_batch(store, batch(("a.md", "# A\nthree"), ("b.md", "two")))
    assert texts() == ["three", "two"] and {r.source_path for r in store.paths().collect()} == {"a.md", "b.md"}


def test_documents_of_several_paths_stay_until_the_last_changes(spark, tmp_path):
    store = snapshot.ChunkStore(spark, str(tmp_path / "s"))
    batch = lambda *rows: spark.createDataFrame(rows, "source_path string, content string, landed_at timestamp")
    texts = lambda: sorted(r.text for r in store.chunks().collect())
    t = [dt.datetime(2024, 1, d) for d in range(1, 9)]
    ingest_batch(store, batch(("a.md", "shared", t[0]), ("b.md", "shared", t[0]), ("a.md", "older", t[0] - dt.timedelta(days=1))))
    assert texts() == ["shared"] and store.paths().count() == 2
    ingest_batch(store, batch(("a.md", "new", t[1])))
    assert texts() == ["new", "shared"]
    ingest_batch(store, batch(("b.md", "late", t[0] - dt.timedelta(days=2))))
    assert texts() == ["new", "shared"]
    ingest_batch(store, batch(("b.md", "new", t[2])))
    assert texts() == ["new"] and {(r.source_path, r.document_id) for r in store.paths().collect()} == {(p, hashlib.sha256(b"new").hexdigest()) for p in ("a.md", "b.md")}


def events(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "query" if i % 2 else "upload", t + dt.timedelta(seconds=20 * i), f"k{i % 2}") for i in range(12)]
    return spark.createDataFrame(rows, "event_id int, event_type string, timestamp timestamp_ntz, key_id string")


def test_audit(spark, tmp_path):
    e = events(spark)
    assert audit.select(e, {"event_type": "query", "key_id": None}, start="2024-01-01 00:01:00", end="2024-01-01 00:03:00").count() == 4
    assert [r.event_id for r in audit.page(e, 1, 2).collect()] == [10, 9] and [r.event_id for r in audit.page(e, 0, 2, descending=False).collect()] == [0, 1]
    with pytest.raises(ValueError):
        audit.page(e, 0, 501)
    audit.append(e.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("event_id", F.col("event_id").cast("string")), str(tmp_path / "log"))
    assert audit.read(spark, str(tmp_path / "log")).count() == 12
    audit.export_csv(e, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 12


def test_rate_limit(spark):
    e = events(spark).withColumnRenamed("timestamp", "ts")
    assert [r.event_id for r in audit.rate_limit(e, 1, "key_id").filter("not allowed").orderBy("event_id").collect()] == [2, 5, 8, 11]
    assert audit.rate_limit(e, 0, "key_id").filter("not allowed").count() == 0


def test_settings():
    assert Settings().provider == "deterministic" and Settings(provider_key="s").shown()["provider_key"] == "***"
    for wrong in ({"dense_weight": 0.9}, {"rerank_top_n": 9}, {"rerank_top_n": 30, "fused_budget": 40}, {"chunk_overlap": 500}, {"environment": "production"}, {"reranker": "hosted"}, {"colour": 1}):
        with pytest.raises(ValueError):
            settings_from(wrong)


def test_numbers_for_tables(spark):
    from lodeweave.functions import approximate_tokens, find, shown

    r = spark.createDataFrame([(1.23456, None, "abcdefgh", "de")], "a double, b double, t string, s string").select(shown(F.col("a")), shown(F.col("a"), True), shown(F.col("b")), approximate_tokens(F.col("t")), find(F.col("t"), F.col("s")), find(F.col("s"), F.col("t"))).first()
    assert tuple(r) == ("1.235", "+1.235", "-", 2, 3, -1)


def test_judges(spark):
    rows = [('{"verdict": "partial", "reasoning": "r"}',), ("broken",), ('{"verdict": "maybe"}',), (None,)]
    got = [r[0].verdict for r in spark.createDataFrame(rows, "r string").select(evaluation.judged(F.col("r"))).collect()]
    assert got == ["PARTIAL", "INCORRECT", "INCORRECT", "INCORRECT"]


def test_question_records(spark):
    q = spark.createDataFrame([(1, "factual", ["A"]), (2, "factual", []), (3, "negative", ["A"])], "query_id int, category string, citation_doc_ids array<string>")
    answers = spark.createDataFrame([(1, "a", ["A", "B"], 0.5, 10.0, None), (2, None, None, None, None, "boom")], "query_id int, answer string, citations array<string>, coverage double, latency_ms double, error string")
    metrics = evaluation.retrieval_metrics(q, spark.createDataFrame([(1, "X", 1), (1, "A", 2)], "query_id int, document_id string, rank int"), q.select("query_id", F.explode("citation_doc_ids").alias("document_id")))
    passed = spark.createDataFrame([(1, True)], "query_id int, verification_pass boolean")
    got = {r.query_id: r for r in evaluation.question_records(q, answers, metrics, passed, spark.createDataFrame([(1, "CORRECT", "r")], "query_id int, verdict string, reasoning string")).collect()}
    assert (got[1].status, got[1].citation_precision, got[1].citation_recall, got[1].recall_3, got[1].mrr, got[1].verification_pass, got[1].verdict) == ("success", 0.5, 1.0, 1.0, 0.5, True, "CORRECT")
    assert (got[2].status, got[2].error_type, got[2].error_message, got[2].citation_f1, got[2].verdict, got[2].citations) == ("error", "pipeline_error", "boom", None, None, [])
    assert got[3].error_message == "no answer"
    summary = {r.category: r for r in evaluation.summary(evaluation.question_records(q, answers, metrics, passed, spark.createDataFrame([(1, "CORRECT", "r")], "query_id int, verdict string, reasoning string"))).collect()}
    assert summary[None].error_count == 2 and summary[None].verification_pass_rate == 1.0
    assert evaluation.numeric_only(q.withColumn("ok", F.lit(True)), ["query_id"]).columns == ["query_id", "ok"]


def test_metrics_by_label_are_those_of_lists(spark):
    q = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "query_id int, label string")
    items = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "document_id string, label string")
    ranked = spark.createDataFrame([(1, "C", 1), (1, "A", 2), (2, "A", 1), (2, "C", 2), (2, "C", 3)], "query_id int, document_id string, rank int")
    lists = evaluation.retrieval_metrics(q, ranked, q.join(items, "label"))
    assert sorted(evaluation.retrieval_metrics_by_label(q, ranked, items).collect()) == sorted(lists.collect())


def test_traces_and_totals(spark):
    before = spark.createDataFrame([(1, c, i, float(-i)) for i, c in enumerate("abc", 1)], "query_id int, id string, final_rank int, rerank_score double")
    t = audit.pruning_trace(before, before.filter("id = 'b'")).first()
    assert (t.before, t.after, t.dropped) == (3, 1, ["a", "c"])
    e = events(spark)
    assert {r.total for r in audit.page_with_total(e, 1, 2).collect()} == {12}
    drafts = spark.createDataFrame([(1, "{}", [("c", ["d1"], "q"), ("c", ["d1"], "")], None)], "query_id int, raw string, claims array<struct<text:string,citation_ids:array<string>,supporting_quote:string>>, error string")
    assert tuple(audit.generation_trace(drafts).first()) == (1, 2, True, 2, 1, None)
    cited = spark.createDataFrame([(1, "d2", "GDPR"), (1, "d1", None), (1, "d2", "")], "query_id int, document_id string, regulation string")
    assert tuple(audit.answered(cited).first()) == (1, ["d1", "d2"], ["GDPR"])

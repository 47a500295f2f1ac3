import datetime as dt
import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lodeweave.operators import answer, compliance
from lodeweave.operators.evaluation import citation_prf


@pytest.fixture
def context(spark):
    rows = [(1, "d1", "Employees get 20 days of paid annual leave per year.", "c1", 1), (1, "d2", "Remote work is allowed two days a week. It starts on", "c2", 2), (1, "d3", "Monday at nine.", "c3", 3)]
    return spark.createDataFrame(rows, "query_id int, label string, text string, chunk_id string, position int")


def claims(spark, *rows):
    return spark.createDataFrame([(1, i, ids, q) for i, (ids, q) in enumerate(rows)], "query_id int, claim_no int, citation_ids array<string>, supporting_quote string")


@pytest.mark.parametrize("score", [answer.containment_score, answer.contained])
def test_verdicts(spark, context, score):
    got = answer.verify_claims(
        claims(spark, (["d1"], "20 days  of paid annual leave"), (["d99"], "20 days of paid annual leave"), (["d1"], "quantum computers are blue"), (["d2"], "20 days of paid annual leave"), (["d1"], "paid annual leave [d1]"), (["d2"], "two days a week. It starts on Monday at nine."), ([], "20 days"), (["d1"], ""), (None, None)),
        context, score,
    ).orderBy("claim_no").collect()
    assert [r.failure_reason for r in got] == [None, "hallucinated_citation_id", "quote_not_found", "citation_reattribution_candidate", "quote_contains_citation_marker", "quote_spans_multiple_chunks", "citation_reattribution_candidate", "quote_not_found", "quote_not_found"]
    assert [r.passed for r in got] == [True] + [False] * 8 and got[0].quote_match_score == 1.0
    report = answer.verification_report(answer.verify_claims(claims(spark, (["d1"], "20 days"), (["d9"], "x")), context, score)).first()
    assert (report.total_claims, report.verified_claims, report.failed_claims, report.hallucinated, report.missing_quotes) == (2, 1, 1, 1, 0)


def test_quotes(spark, context):
    c = spark.createDataFrame([(1, 0, "Remote work two days", ["d2", "d1"]), (1, 1, "x", ["d9"]), (1, 2, "x", [])], "query_id int, claim_no int, text string, citation_ids array<string>")
    got = answer.extract_quotes(c, context).orderBy("claim_no").collect()
    assert got[0].supporting_quote == "Remote work is allowed two days a week." and got[0].citation_ids == ["d2"]
    assert got[1].supporting_quote == "" and got[2].supporting_quote == ""


def test_confidence(spark, context):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    ranked = spark.createDataFrame([(1, 0.0, 1), (1, 5.0, 2)], "query_id int, rerank_score double, final_rank int")
    c = claims(spark, (["d1"], "20 days"), (["d9"], "x"))
    results = answer.verify_claims(c, context)
    got = {r.query_id: r for r in answer.confidence(q, ranked, c, results, context).collect()}
    assert (got[1].retrieval, got[1].citations, got[1].coverage) == (0.5, 0.5, 0.333333) and got[1].overall == pytest.approx(0.466667)
    assert (got[2].retrieval, got[2].citations, got[2].coverage, got[2].overall) == (0.0, 1.0, 0.0, 0.4)
    off = {r.query_id: r for r in answer.confidence(q, ranked, c, results, context, verify=False).collect()}
    assert (off[1].citations, off[1].coverage, off[1].overall) == (0.0, 0.0, 0.2)
    r = spark.range(1).select(answer.confidence_band(F.lit(0.2), F.lit(0.9)), answer.confidence_band(F.lit(0.9), F.lit(0.9)), answer.confidence_band(F.lit(0.9), F.lit(0.7)), answer.confidence_band(F.lit(0.9), F.lit(0.1))).first()
    assert tuple(r) == ("no evidence", "High", "Medium", "Low")


def test_budget_and_layout(spark):
    rows = [(1, "a", 1, "x" * 50), (1, "b", 2, "y" * 30), (1, "a", 3, "x" * 50), (1, "c", 4, "z" * 10), (1, "d", 5, "w" * 20), (2, "big", 1, "v" * 500)]
    got = answer.budget(spark.createDataFrame(rows, "query_id int, chunk_id string, final_rank int, text string"), 23)
    assert sorted((r.query_id, r.label, r.chunk_id) for r in got.collect()) == [(1, "d1", "a"), (1, "d2", "b"), (1, "d3", "c"), (2, "d1", "big")]
    texts = {r.query_id: r.context for r in answer.context_text(got).collect()}
    assert texts[1].startswith("[d1]\n" + "x" * 50 + "\n\n[d2]\n")
    grouped = got.withColumn("primary_subquery", (F.col("position") + 1) % 2).withColumn("sub_text", F.concat(F.lit("q"), "primary_subquery"))
    text = {r.query_id: r.context for r in answer.context_text(grouped, grouped=True).collect()}[1]
    assert text.index("Passages for part 1") < text.index("[d1]") < text.index("[d3]") < text.index("Passages for part 2") < text.index("[d2]")


def test_prompt_takes_text_as_data(spark):
    r = spark.createDataFrame([("{context} $1 \\", "{question}")], "q string, c string").select(answer.prompt(F.col("q"), F.col("c")).alias("p")).first()
    assert "<context>\n{question}\n</context>" in r.p and "{context} $1 \\" in r.p
    with pytest.raises(ValueError):
        answer.prompt(F.col("q"), F.col("c"), "v9")


@pytest.mark.parametrize(
    "raw,want",
    [
        ('{"answer": "a", "claims": [{"text": "t", "citation_ids": ["d1"]}]}', ("a", 1, False)),
        ('{"answer": "the "X" trap: "y": z", "claims": []}', ('the "X" trap: "y": z', 0, False)),
        ('{"answer": "a", "claims": []} and more', ("a", 0, False)),
        ('{"answer": "cut \\"q\\" off", "claims": [{"te', ('cut "q" off', 0, True)),
        ("plain", ("plain", 0, True)),
        ('{"claims": []}', ('{"claims": []}', 0, True)),
        ("[1]", ("[1]", 0, True)),
        (None, (None, 0, True)),
    ],
)
def test_drafts(raw, want):
    text, got, error = answer.parse_draft(raw)
    assert (text, len(got), error is not None) == want


def test_subqueries(spark):
    rows = [('["a", "b", "a", "Q?", "c", "d", "e"]', "q?"), ("no json", "q"), ("[]", "q"), (None, None)]
    got = spark.createDataFrame(rows, "r string, q string").select(answer.parsed_subqueries("r", "q")).collect()
    assert [r[0] for r in got] == [["a", "b", "c", "d"], ["q"], ["q"], [""]]


def test_drift_and_status(spark):
    r = spark.createDataFrame([("x [d2] [d10] [d2]", ["d2"])], "a string, i array<string>").select(answer.drift(F.col("a"), F.col("i")).alias("d"), answer.citation_status(F.lit(1), F.lit(False)), answer.citation_status(F.lit(0), F.lit(False)), answer.citation_status(F.lit(0), F.lit(True))).first()
    assert r.d.inline_ids == ["d2", "d10"] and not r.d.ok and r[1:] == ("verification_failed", "inline_drift", "ok")


@pytest.mark.parametrize(
    "question,kind,filters",
    [
        ("Show Article 17", "structured", {"article": "17"}), ("What does article 17a say?", "mixed", {"article": "17a"}), ("clause 5.2(a) of section 3", "structured", {"clause": "5.2(a)"}), ("Section 164.502", "structured", {"section": "164.502"}),
        ("Duties under gdpr", "metadata", {"regulation": "GDPR"}), ("Rules in India", "metadata", {"jurisdiction": "INDIA"}), ("Rules for us all", "metadata", {"jurisdiction": "US"}), ("Business rules", "semantic", {}), ("HIPAA and CCPA", "metadata", {"regulation": "CCPA"}),
    ],
)
def test_intent(spark, question, kind, filters):
    r = spark.createDataFrame([(question,)], "q string").select(compliance.classify(F.col("q")).alias("i")).first().i
    assert (r.kind, r.filters) == (kind, filters)


def test_comparative(spark):
    got = spark.createDataFrame([("Compare A and B",), ("GDPR vs. CCPA",), ("Which supersedes it?",), ("What is it",), ("comparable",)], "q string").select(compliance.is_comparative(F.col("q"))).collect()
    assert [r[0] for r in got] == [True, True, True, False, False]


META = "struct<regulation:string,authority:string,jurisdiction:string,article:string,section:string,clause:string,effective_date:date,is_current:boolean,page:int,version:string,document_type:string,risk_category:string>"


def meta_rows(spark):
    m = lambda reg, art=None, cl=None, day=None, cur=True, page=None: (reg, None, "EU", art, None, cl, dt.date(2020, 1, day) if day else None, cur, page, None, None, None)
    rows = [("c1", "d1", 0, m("GDPR (EU) 2016", "5", "5.1(a)", 1, page=3)), ("c2", "d2", 0, m("gdpr", "5", "5.2", 9)), ("c3", "d3", 0, m(None, None, None, None, False)), ("c4", "d4", 1, None), ("c5", "d2", 1, m("GDPR (EU) 2016", None, "7", 20, False))]
    return spark.createDataFrame(rows, f"chunk_id string, document_id string, chunk_index int, legal_metadata {META}")


def test_legal_filter(spark):
    df = meta_rows(spark)
    ids = lambda f: [r.chunk_id for r in compliance.legal_filter(df, f).collect()]
    assert ids({"regulation": "GDPR"}) == ["c1", "c2", "c5"] and ids({"regulation": "gdpr", "article": "5"}) == ["c1", "c2"] and ids({}) == [] and ids({"is_current": "false"}) == ["c5", "c3"]
    assert ids({"regulation": "gdpr", "as_of_date": "2020-01-15"}) == ["c2"] and ids({"as_of_date": "2019-01-01"}) == []
    with pytest.raises(ValueError):
        compliance.legal_filter(df, {"colour": "x"})


def test_display(spark):
    got = meta_rows(spark).select("chunk_id", compliance.citation_display(F.lit("T"), F.col("chunk_index"), F.lit(None).cast("int"), F.col("legal_metadata")).alias("d")).collect()
    assert {r.chunk_id: r.d for r in got} == {"c1": "GDPR (EU) 2016 Art. 5(1)(a), p.3", "c2": "gdpr Art. 5(2)", "c3": "T, chunk 0", "c4": "T, chunk 1", "c5": "GDPR (EU) 2016 Clause 7"}


def test_supersession(spark):
    d = lambda n: dt.date(2020, 1, n)
    rows = [("R", "5", "a", d(1), True, None), ("R", "5", "b", d(9), True, None), ("R", "5", "b", d(9), False, "x"), ("R", "6", "a", d(1), True, None), ("R", "7", "a", d(2), True, None), ("R", "7", "b", d(2), True, None), (None, "5", "q", d(1), True, "k"), ("R", "5", "n", None, True, None)]
    got = compliance.supersede(spark.createDataFrame(rows, "regulation string, article string, document_id string, effective_date date, is_current boolean, superseded_by string"), ["regulation", "article"]).collect()
    state = sorted((r.article, r.document_id, r.is_current, r.new_is_current, r.new_superseded_by) for r in got)
    assert state == [("5", "a", True, False, "b"), ("5", "b", False, True, None), ("5", "b", True, True, None), ("5", "n", True, True, None), ("5", "q", True, True, "k"), ("6", "a", True, True, None), ("7", "a", True, True, None), ("7", "b", True, True, None)]


def test_route(spark):
    df = meta_rows(spark)
    q = spark.createDataFrame([(1, "article 5"), (2, "what of article 5"), (3, "Duties under GDPR"), (4, "tell me")], "query_id int, question string").withColumn("intent", compliance.classify(F.col("question")))
    found = spark.createDataFrame([(i, c, 0.1, r) for i in (2, 3, 4) for r, c in enumerate(["c4", "c5", "c2"], 1)], "query_id int, id string, rrf_score double, fused_rank int")
    got = sorted((r.query_id, r.final_rank, r.id) for r in compliance.route(q, df, found).collect())
    assert got == [(1, 1, "c1"), (1, 2, "c2"), (2, 1, "c2"), (3, 1, "c5"), (3, 2, "c2"), (4, 1, "c4"), (4, 2, "c5"), (4, 3, "c2")]


def test_prf(spark):
    rows = [(["a", "b", "a"], ["b", "c"]), ([], []), (None, ["a"]), (["a"], [])]
    got = [tuple(r) for r in spark.createDataFrame(rows, "p array<string>, e array<string>").select(*citation_prf(F.col("p"), F.col("e"))).collect()]
    assert got == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_longest_runs(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("ab ") for _ in range(rng.randrange(12))), "".join(rng.choice("ab ") for _ in range(rng.randrange(30)))) for _ in range(150)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", answer.longest_run(F.col("a"), F.col("b")).alias("n"), answer.longest_run(F.col("a"), F.col("b"), F.lit(4)).alias("m")).collect()
    for r in got:
        n = SequenceMatcher(None, r.a, r.b, autojunk=False).find_longest_match(0, len(r.a), 0, len(r.b)).size
        assert r.n == n and r.m == (n if n >= 4 else 0)


def test_claim_diagnostics(spark):
    claims = spark.createDataFrame([(1, 1, ["d1"], "quick"), (1, 2, ["d1"], "slow"), (1, 3, [], "quick"), (1, 4, ["d9"], None)], "query_id int, claim_no int, citation_ids array<string>, supporting_quote string")
    context = spark.createDataFrame([(1, "d1", "c1", "the quick fox")], "query_id int, label string, chunk_id string, text string")
    results = answer.verify_claims(claims, context)
    got = {r.claim_no: (r.chunk_id, r.quote_length, r.quote_found, r.quote_start, r.quote_end) for r in answer.claim_diagnostics(claims, results, context).collect()}
    assert got == {1: ("c1", 5, True, 4, 9), 2: ("c1", 4, False, -1, -1), 3: (None, 5, False, -1, -1), 4: (None, 0, False, -1, -1)}
    assert [r.verification_pass for r in answer.verification_pass(claims.select("query_id").distinct(), results).collect()] == [False]


def test_provisions_with_missing_fields_match_anything(spark):
    rows = [("a", "GDPR", "5", "5.1", "d1", "2019-01-01"), ("b", "EU GDPR", "5", None, "d2", "2021-01-01"), ("c", "GDPR", "5", "5.2", "d3", "2020-01-01"), ("d", "CCPA", "5", "5.1", "d4", "2023-01-01"), ("e", None, "5", None, "d5", "2024-01-01")]
    df = spark.createDataFrame([(*r[:5], dt.date.fromisoformat(r[5]), True, None) for r in rows], "chunk_id string, regulation string, article string, clause string, document_id string, effective_date date, is_current boolean, superseded_by string")
    got = {r.chunk_id: (r.new_is_current, r.new_superseded_by) for r in compliance.supersede(df, ["regulation", "article", "clause"]).collect()}
    # `EU GDPR` holds no key but its own name's; a provision without clause decides none of `GDPR` alone
    assert got["d"] == (True, None) and got["e"] == (True, None) and got["a"] == (True, None) and got["c"] == (True, None)
    pairs = {tuple(r) for r in compliance.wildcard_matches(df.filter("chunk_id in ('a', 'b')").withColumnRenamed("chunk_id", "key_id"), df.withColumnRenamed("chunk_id", "row_id"), ["regulation", "article", "clause"]).collect()}
    assert pairs == {("a", "a"), ("b", "b")}
    wide = df.filter("chunk_id = 'a'").withColumn("clause", F.lit(None).cast("string")).withColumnRenamed("chunk_id", "key_id")
    assert {r.row_id for r in compliance.wildcard_matches(wide, df.withColumnRenamed("chunk_id", "row_id"), ["regulation", "article", "clause"]).collect()} == {"a", "b", "c"}


def test_structured_citations(spark):
    kind = "query_id int, chunk_id string, document_id string, chunk_index int, page int, text string, rerank_score double, legal_metadata struct<document_title:string,regulation:string,version:string,jurisdiction:string,article:string,section:string,clause:string,effective_date:date,document_type:string,page:int>"
    rows = [(1, "c1", "d1", 0, 3, "t", 0.9, ("Title", "GDPR", "2", "EU", "83", None, "83.5(a)", None, "regulation", None)), (1, "c2", "d2", 4, None, "u", None, None)]
    got = {r.chunk_id: r for r in compliance.citations(spark.createDataFrame(rows, kind), spark.createDataFrame([("d2", "notes.md")], "document_id string, filename string")).collect()}
    assert (got["c1"].display, got["c1"].document_title, got["c1"].confidence, got["c1"].page) == ("GDPR Art. 83(5)(a), p.3", "Title", 0.9, 3)
    assert (got["c2"].display, got["c2"].document_title, got["c2"].confidence, got["c2"].regulation) == ("notes.md, chunk 4", "notes.md", 0.0, None)


def test_repair_of_quotes():
    assert json.loads(answer.repaired('{"answer": "he said "yes", then "no"", "claims": []}')) == {"answer": 'he said "yes", then "no"', "claims": []}
    assert json.loads(answer.repaired('{"a": "x"}')) == {"a": "x"}
    for broken in ("no json", '{"a": "cut', '{"a": }', ""):
        assert answer.repaired(broken) == broken

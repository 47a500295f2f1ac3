"""Evaluation: retrieval and citation metrics, summaries, comparison with a baseline, question sets and thresholds."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import shown

CUTS = (1, 3, 5)
#: Metrics, categories, verdict scores and default thresholds (warn, fail).
OBJECTIVE = ["citation_precision", "citation_recall", "citation_f1", "coverage"]
RETRIEVAL = ["recall_1", "recall_3", "recall_5", "precision_1", "precision_3", "precision_5", "mrr"]
CATEGORIES = ["factual", "comparative", "multi_hop", "numerical", "negative", "definitional"]
VERDICTS = {"CORRECT": 1.0, "PARTIAL": 0.5, "INCORRECT": 0.0, "UNSUPPORTED": 0.0}
THRESHOLDS = {
    "metrics": {"citation_precision": (0.02, 0.05), "citation_recall": (0.02, 0.05), "citation_f1": (0.02, 0.05), "coverage": (0.02, 0.05), "accuracy": (0.05, 0.10)},
    "error_count": (0, 1),
    "per_question_fail": 0.5,
}


def first_ranks(ranked: DataFrame, key: str = "document_id") -> DataFrame:
    """(query_id, key, rank): every document once, at its first rank, ranks closed up."""
    firsts = ranked.groupBy("query_id", key).agg(F.min("rank").alias("_r"))
    return firsts.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r", key))).drop("_r")


def retrieval_metrics(queries: DataFrame, ranked: DataFrame, relevant: DataFrame, key: str = "document_id") -> DataFrame:
    """(query_id, recall_1/3/5, precision_1/3/5, mrr) of every query, of six decimals; all null where nothing is relevant.
    Documents count once, at their first rank; precision divides by the cut even if fewer documents came."""
    want = relevant.select("query_id", key).distinct()
    n = want.groupBy("query_id").agg(F.count("*").alias("_n"))
    return _metrics(queries, n, first_ranks(ranked, key).join(want, ["query_id", key], "left_semi"))


def retrieval_metrics_by_label(queries: DataFrame, ranked: DataFrame, items: DataFrame, key: str = "document_id", label: str = "label") -> DataFrame:
    """As retrieval_metrics, where the items (key, label) of a query's label are relevant: labels are counted and the ranked
    hits looked up, so no list of the relevant items of each query is made. Each item has one label."""
    sizes = items.groupBy(label).agg(F.count_distinct(key).alias("_n"))
    n = queries.select("query_id", label).distinct().join(sizes, label).select("query_id", "_n")
    hits = first_ranks(ranked, key).join(items.select(key, label).distinct(), key).join(queries.select("query_id", label).distinct(), ["query_id", label], "left_semi")
    return _metrics(queries, n, hits)


def _metrics(queries: DataFrame, n: DataFrame, hits: DataFrame) -> DataFrame:
    """hits: the relevant ones among the ranked (query_id, rank); n: how many are relevant (query_id, _n)."""
    found = hits.groupBy("query_id").agg(F.min("rank").alias("_first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"_h{k}") for k in CUTS])
    out = queries.select("query_id").distinct().join(n, "query_id", "left").join(found, "query_id", "left")
    given = lambda c: F.when(F.col("_n").isNotNull(), F.round(F.coalesce(c, F.lit(0.0)), 6))
    return out.select("query_id", *[given(F.col(f"_h{k}") / F.col("_n")).alias(f"recall_{k}") for k in CUTS], *[given(F.col(f"_h{k}") / k).alias(f"precision_{k}") for k in CUTS], given(1 / F.col("_first")).alias("mrr"))


def citation_prf(predicted: Column, expected: Column) -> list[Column]:
    """Precision, recall and F1 of two sets (arrays, null as empty) under the names of OBJECTIVE; 1, 1, 1 if both are empty."""
    p, e = (F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))) for x in (predicted, expected))
    both, none = F.size(F.array_intersect(p, e)), (F.size(p) == 0) & (F.size(e) == 0)
    share = lambda of: F.when(none, 1.0).when(F.size(of) > 0, both / F.size(of)).otherwise(0.0)
    f1 = F.when(none, 1.0).when(both > 0, 2 * share(p) * share(e) / (share(p) + share(e))).otherwise(0.0)
    return [F.round(share(p), 6).alias("citation_precision"), F.round(share(e), 6).alias("citation_recall"), F.round(f1, 6).alias("citation_f1")]


def verdict_score(verdict: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, value in VERDICTS.items():
        out = F.when(verdict == name, value).otherwise(out)
    return out


def judged(raw: Column) -> Column:
    """struct(verdict, reasoning) of a judge's JSON; INCORRECT if it can't be read or names no verdict."""
    got = F.from_json(raw, "verdict string, reasoning string")
    known = F.upper(got["verdict"]).isin(list(VERDICTS))
    return F.struct(F.when(known, F.upper(got["verdict"])).otherwise("INCORRECT").alias("verdict"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning"))


def summary(records: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Means over all (category null) and by category of records (category, status, verdict, verification_pass, metrics...):
    only successes count, a mean over nothing is null; with accuracy, hallucination_rate, verification_pass_rate, error_count and total."""
    names = metrics if metrics is not None else [m for m in [*OBJECTIVE, *RETRIEVAL, "latency_ms"] if m in records.columns]
    good = F.col("status") == "success"
    mean = lambda c: F.round(F.avg(F.when(good, c)), 6)
    columns = [mean(F.col(m).cast("double")).alias(m) for m in names]
    if "verdict" in records.columns:
        columns += [mean(verdict_score(F.col("verdict"))).alias("accuracy"), mean((F.col("verdict") == "UNSUPPORTED").cast("double")).alias("hallucination_rate")]
    if "verification_pass" in records.columns:
        columns.append(mean(F.col("verification_pass").cast("double")).alias("verification_pass_rate"))
    return records.rollup("category").agg(*columns, F.sum((F.col("status") == "error").cast("int")).alias("error_count"), F.count("*").alias("total"), F.grouping("category").cast("int").alias("overall"))


def question_records(questions: DataFrame, answers: DataFrame, metrics: DataFrame, passed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One record per question (query_id, category, citation_doc_ids): what its answer, citations, claims and judge come to.

    answers: (query_id, answer, citations array<string>, coverage, latency_ms, error); metrics: of retrieval_metrics;
    passed: (query_id, verification_pass); verdicts: (query_id, verdict, reasoning). A question whose answer has an error,
    or that has no answer at all, gets an error record: status error, its message, and no metrics, citations or verdict.
    """
    joined = questions.select("query_id", "category", F.col("citation_doc_ids").alias("expected")).join(answers, "query_id", "left").join(metrics, "query_id", "left").join(passed, "query_id", "left").join(verdicts.select("query_id", "verdict", "reasoning"), "query_id", "left")
    known = F.col("latency_ms").isNotNull() | F.col("answer").isNotNull() | F.col("error").isNotNull()
    message = F.when(~known, "no answer").otherwise(F.col("error"))
    good = message.isNull()
    kept = lambda c, name: F.when(good, c).alias(name)
    none = F.array().cast("array<string>")
    prf = [kept(c, n) for c, n in zip(citation_prf(F.col("citations"), F.col("expected")), OBJECTIVE, strict=False)]
    return joined.select(
        "query_id", "category", "expected", kept(F.col("answer"), "model_answer"), F.when(good, F.coalesce("citations", none)).otherwise(none).alias("citations"),
        F.when(good, "success").otherwise("error").alias("status"), F.when(~good, "pipeline_error").alias("error_type"), message.alias("error_message"),
        kept(F.col("latency_ms"), "latency_ms"), *prf, kept(F.coalesce("verification_pass", F.lit(False)), "verification_pass"), kept(F.col("coverage"), "coverage"),
        *[kept(F.col(m), m) for m in RETRIEVAL if m in metrics.columns], kept(F.coalesce("verdict", F.lit("INCORRECT")), "verdict"), kept(F.col("reasoning"), "reasoning"),
    )


def numeric_only(table: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, and of the other columns those of numbers and truth values, as doubles."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")
    return table.select(*keys, *[F.col(c).cast("double").alias(c) for c, t in table.dtypes if c not in keys and t.split("(")[0] in numbers])


def tier(delta: Column, warn: Column, fail: Column) -> Column:
    return F.when(delta <= -fail, "fail").when(delta <= -warn, "warn").when(delta > 0, "info").otherwise("ok")


def thresholds_table(spark: SparkSession, thresholds: dict | None = None) -> DataFrame:
    t = thresholds or THRESHOLDS
    return spark.createDataFrame([(m, float(w), float(f)) for m, (w, f) in t["metrics"].items()], "metric string, warn double, fail double")


def compare(current: DataFrame, baseline: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """Findings (metric, scope, baseline, current, delta, status) of per-question values (question_id, metric, value,
    status), long form, against a baseline of the same form.

    Aggregates: the difference of means over successes, for metrics with a threshold that both sides have. Error count:
    worse if it rises by more than the thresholds. Single questions: a drop of per_question_fail or more fails."""
    t = thresholds or THRESHOLDS
    spark = current.sparkSession
    limits = F.broadcast(thresholds_table(spark, t))
    mean = lambda d, n: d.filter("status = 'success' and value is not null").groupBy("metric").agg(F.round(F.avg("value"), 6).alias(n))
    delta = F.round(F.col("current") - F.col("baseline"), 6)
    aggregate = mean(baseline, "baseline").join(mean(current, "current"), "metric").join(limits, "metric").withColumn("delta", delta)
    out = aggregate.select("metric", F.lit("aggregate").alias("scope"), "baseline", "current", "delta", tier(F.col("delta"), F.col("warn"), F.col("fail")).alias("status"))
    errors = lambda d, n: d.filter("status = 'error'").agg(F.count_distinct("question_id").cast("double").alias(n))
    warn, fail = t["error_count"]
    e = errors(baseline, "baseline").crossJoin(errors(current, "current")).withColumn("delta", delta)  # one row each
    status = F.when(F.col("delta") > fail, "fail").when(F.col("delta") > warn, "warn").when(F.col("delta") < 0, "info").otherwise("ok")
    out = out.unionByName(e.select(F.lit("error_count").alias("metric"), F.lit("aggregate").alias("scope"), "baseline", "current", "delta", status.alias("status")))
    known = limits.filter("metric <> 'accuracy'").select("metric")
    one = baseline.select("question_id", "metric", F.col("value").alias("baseline")).join(current.select("question_id", "metric", F.col("value").alias("current")), ["question_id", "metric"]).join(known, "metric", "left_semi").withColumn("delta", delta)
    drops = one.filter(F.col("delta") <= -t["per_question_fail"])
    return out.unionByName(drops.select("metric", F.concat(F.lit("per_question:"), F.col("question_id").cast("string")).alias("scope"), "baseline", "current", "delta", F.lit("fail").alias("status")))


def overall_status(findings: DataFrame) -> DataFrame:
    """One row: the worst status of all findings; info counts as ok."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    return findings.agg(F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("fail")), F.coalesce(worst, F.lit(0)) + 1).alias("status"))


def config_drift(baseline: dict | None, current: dict | None) -> list[dict]:
    """A warning if both runs have a pipeline configuration and these differ."""
    if baseline and current and baseline != current:
        return [{"metric": "pipeline_config", "scope": "config", "baseline": None, "current": None, "delta": None, "status": "warn"}]
    return []


def comparison_lines(findings: DataFrame) -> DataFrame:
    """Findings as lines of a table."""
    return findings.select("metric", "scope", shown(F.col("baseline")).alias("baseline"), shown(F.col("current")).alias("current"), shown(F.col("delta"), signed=True).alias("delta"), "status")


# ---- files


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, category, answer, citation_doc_ids) of a YAML or JSON question set: {dataset: {name, version}, questions: [...]}.
    Missing keys, unknown categories and repeated ids are errors."""
    text = Path(path).read_text()
    try:
        raw = json.loads(text)
    except ValueError:
        import yaml

        raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or not {"dataset", "questions"} <= set(raw):
        raise ValueError("a question set needs the keys dataset and questions")
    rows = []
    for q in raw["questions"]:
        if missing := {"id", "question", "category", "expected"} - set(q):
            raise ValueError(f"a question has no {sorted(missing)}")
        if missing := {"answer", "citation_doc_ids"} - set(q["expected"]):
            raise ValueError(f"question {q['id']} expects no {sorted(missing)}")
        if q["category"] not in CATEGORIES:
            raise ValueError(f"unknown category {q['category']!r}")
        rows.append((str(q["id"]), q["question"], q["category"], q["expected"]["answer"], [str(x) for x in q["expected"]["citation_doc_ids"]]))
    ids = [r[0] for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"repeated question ids {twice}")
    return spark.createDataFrame(rows, "id string, question string, category string, answer string, citation_doc_ids array<string>")


def load_thresholds(path: str | None) -> dict:
    """The file's thresholds over the defaults; the defaults alone without a file."""
    if path is None or not Path(path).exists():
        return THRESHOLDS
    import yaml

    try:
        section = (yaml.safe_load(Path(path).read_text()) or {}).get("evaluation") or {}
        metrics = THRESHOLDS["metrics"] | {k: (float(v["warn"]), float(v["fail"])) for k, v in (section.get("thresholds") or {}).items()}
        errors = section.get("error_count")
        return {"metrics": metrics, "error_count": (errors["warn"], errors["fail"]) if errors else THRESHOLDS["error_count"], "per_question_fail": section.get("per_question_fail", THRESHOLDS["per_question_fail"])}
    except (KeyError, TypeError, AttributeError, ValueError, yaml.YAMLError) as e:
        raise ValueError(f"invalid thresholds file {path}: {e}") from e


def save_baseline(values: DataFrame, path: str, question_set_hash: str) -> None:
    """Per-question values and the hash of their question set, in a folder of its own; the pointer that makes it the baseline
    is written last and replaced as a whole, so that at every moment one whole baseline can be read."""
    at = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    marked = values.withColumn("question_set_hash", F.lit(question_set_hash)).withColumn("version", F.lit(1))
    marked.write.parquet(at)
    fs, hadoop = _files(values.sparkSession, path)
    fresh, pointer = hadoop(f"{at}.pointer"), hadoop(f"{path.rstrip('/')}/current")
    out = fs.create(fresh, False)
    out.write(at.encode())
    out.close()
    context = values.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    over = values.sparkSession.sparkContext._gateway.new_array(context.Options.Rename, 1)
    over[0] = context.Options.Rename.OVERWRITE
    context.FileContext.getFileContext(fs.getUri()).rename(fs.makeQualified(fresh), fs.makeQualified(pointer), over)


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def load_baseline(spark: SparkSession, path: str, question_set_hash: str) -> DataFrame:
    """The values of a baseline of the same version and question set; anything else is an error."""
    df = spark.read.parquet(spark.read.text(f"{path.rstrip('/')}/current", wholetext=True).first()[0])
    wrong = df.filter((F.col("version") != 1) | (F.col("question_set_hash") != question_set_hash))
    if not wrong.isEmpty():
        raise ValueError("the baseline was made from another question set or version; make a new one")
    return df.drop("version", "question_set_hash")


def write_report(records: DataFrame, path: str) -> None:
    """Records and their summary as JSON lines, and the summary as an HTML table (one row per category)."""
    records.write.mode("overwrite").json(f"{path}/records")
    table = summary(records)
    table.write.mode("overwrite").json(f"{path}/summary")
    cells = F.concat_ws("</td><td>", *[F.coalesce(F.col(c).cast("string"), F.lit("N/A")) for c in table.columns])
    html = table.select(F.concat(F.lit("<tr><td>"), cells, F.lit("</td></tr>")).alias("value"))
    head = "<table><tr><th>" + "</th><th>".join(table.columns) + "</th></tr>"
    html.agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("value")), ""), F.lit("</table>")).alias("value")).write.mode("overwrite").text(f"{path}/html")


def with_document_ids(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Questions whose expected citations are file names, with document ids instead; a question of which any name is unknown is dropped."""
    each = questions.select("id", F.posexplode("citation_doc_ids").alias("_p", "_name")).join(names.select(F.col("filename").alias("_name"), "document_id"), "_name", "left")
    kept = each.groupBy("id").agg(F.bool_and(F.col("document_id").isNotNull()).alias("_all"), F.transform(F.sort_array(F.collect_list(F.struct("_p", "document_id"))), lambda s: s["document_id"]).alias("_ids")).filter("_all")
    return questions.join(kept, "id", "left").filter("_all or size(citation_doc_ids) = 0").withColumn("citation_doc_ids", F.coalesce("_ids", "citation_doc_ids")).drop("_all", "_ids")

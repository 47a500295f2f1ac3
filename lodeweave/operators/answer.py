"""From ranked chunks to a checked answer: context, prompt, parsing, quotes, verdicts, confidence, status."""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import collapse, find, has_citation_mark, inline_citations, sigmoid, strip
from ..functions.udf import lazy_pandas_udf

TOKEN_BUDGET, CHARS_PER_TOKEN = 2000, 4
QUOTE_THRESHOLD = 0.80

PROMPTS = {
    "v1": "Answer the question from the context alone. Reply with one JSON object that has the keys answer and claims; every claim has text, citation_ids and a supporting_quote copied from one passage.\n\n<context>\n{context}\n</context>\n\n<question>\n{question}\n</question>",
    "v2": "Answer the question from the context alone. Reply with one JSON object that has the keys answer and claims; every claim has text and citation_ids. Mark statements in the answer with the ids of their passages, as in [d1].\n\n<context>\n{context}\n</context>\n\n<question>\n{question}\n</question>",
}
DECOMPOSE = "Split the question into at most four independent questions. Reply with a JSON array of strings.\n\n{question}"
JUDGE = "Judge the answer by the expected one. Reply with one JSON object: verdict (CORRECT, PARTIAL, INCORRECT or UNSUPPORTED) and reasoning.\n\nQuestion: {question}\nExpected: {expected}\nAnswer: {answer}"


def budget(ranked: DataFrame, tokens: int = TOKEN_BUDGET) -> DataFrame:
    """Adds label (d1, d2, ...) and ord to the chunks (query_id, chunk_id, final_rank, ord, text) that fit the context:
    each chunk once, in rank order, whole, up to the first that would exceed the budget; the first always fits."""
    order = ["final_rank", "ord", "chunk_id"] if "ord" in ranked.columns else ["final_rank", "chunk_id"]
    once = ranked.withColumn("_rn", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy(*order))).filter("_rn = 1").drop("_rn")
    w = W.partitionBy("query_id").orderBy(*order)
    numbered = once.withColumn("_no", F.row_number().over(w)).withColumn("used_chars", F.sum(F.length("text")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    kept = numbered.filter((F.col("_no") == 1) | (F.col("used_chars") <= tokens * CHARS_PER_TOKEN))
    return kept.withColumn("label", F.concat(F.lit("d"), F.col("_no"))).withColumnRenamed("_no", "position")


def context_text(context: DataFrame, grouped: bool = False) -> DataFrame:
    """(query_id, context): the labelled texts of a query; if grouped, under their primary sub-query (sub_text), numbering unbroken."""
    line = F.concat(F.lit("["), F.col("label"), F.lit("]\n"), strip(F.col("text")))
    if not grouped:
        return context.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))
    part = context.groupBy("query_id", "primary_subquery", "sub_text").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("_p"))
    head = F.concat(F.lit("Passages for part "), F.col("primary_subquery") + 1, F.lit(" ("), F.col("sub_text"), F.lit("):\n\n"), F.col("_p"))
    return part.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("primary_subquery", head.alias("line")))), lambda s: s["line"]), "\n\n").alias("context"))


def render(template: str, **values: Column) -> Column:
    """A template with its {names} filled in; what is filled in is data and never looked at."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p], F.lit("")) for i, p in enumerate(parts)])


def prompt(question: Column, context: Column, version: str = "v2") -> Column:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version {version!r}")
    return render(PROMPTS[version], question=question, context=context)


# ---- parsing of generated text

DRAFT = "answer string, claims array<struct<text:string,citation_ids:array<string>,supporting_quote:string>>, error string"


def repaired(raw: str) -> str:
    """JSON whose strings may hold quotation marks that nobody escaped. A reader that fails does so right after a mark that
    it took for a string's end: that mark is escaped, and reading starts again, until it ends or fails for another reason."""
    text = raw
    for _ in range(raw.count('"')):
        try:
            json.loads(text)
            return text
        except json.JSONDecodeError as e:
            mark = text.rfind('"', 0, e.pos)
            if mark <= 0 or text[mark - 1] == "\\" or not e.msg.startswith(("Expecting ',' delimiter", "Expecting ':' delimiter", "Expecting property name")):
                return text
            text = f"{text[:mark]}\\{text[mark:]}"
    return text


def parse_draft(raw: str | None) -> tuple[str | None, list[dict], str | None]:
    """(answer, claims, error): JSON as it is, then with stray quotes escaped, then its first object alone, then the
    answer of a cut-off object; else the raw text is the answer."""
    if raw is None:
        return None, [], "no output"
    value, problem = None, None
    for attempt in (json.loads, lambda r: json.loads(repaired(r)), lambda r: json.JSONDecoder().raw_decode(r.strip())[0]):
        try:
            value = attempt(raw)
            problem = None
            break
        except ValueError as e:
            problem = f"failed to parse structured generation output: {e}"
    if problem:
        found = re.search(r'"answer"\s*:\s*"((?:[^"\\]|\\.)*)"', raw)
        try:
            return (json.loads(f'"{found.group(1)}"') if found else raw), [], problem
        except ValueError:
            return raw, [], problem
    try:
        claims = [{"text": c["text"], "citation_ids": [str(x) for x in c["citation_ids"]], "supporting_quote": c.get("supporting_quote") or ""} for c in value.get("claims", [])]
        return str(value["answer"]), claims, None
    except (KeyError, TypeError, AttributeError) as e:
        return raw, [], f"generation output has the wrong shape: {e!r}"


@lazy_pandas_udf(DRAFT)
def parsed_draft(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_draft(r) for r in raw], columns=["answer", "claims", "error"])


@lazy_pandas_udf("array<string>")
def parsed_subqueries(raw: pd.Series, question: pd.Series) -> pd.Series:
    """The first four distinct strings of a JSON array that don't only repeat the question; the question itself if there are none."""

    def one(r: str | None, q: str | None) -> list[str]:
        same = " ".join((q or "").split()).lower()
        try:
            found = json.loads(r or "")
            parts = list(dict.fromkeys(s.strip() for s in found if isinstance(s, str) and s.strip() and " ".join(s.split()).lower() != same))
        except (ValueError, TypeError):
            parts = []
        return parts[:4] or [q or ""]

    return pd.Series([one(r, q) for r, q in zip(raw, question, strict=True)])


# ---- quotes and verdicts


def longest_run(a: Column, b: Column, least: Column | None = None) -> Column:
    """Length of the longest run of characters that two texts share, 0 if it is shorter than ``least``; as an expression:
    whether a run of some length is shared can be told for every length, and the longest is found by halving."""
    n = F.length(a)

    def shared(size: Column) -> Column:
        return (size <= n) & F.exists(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.contains(b, F.substring(a, i, size)))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        hit = (s["lo"] < s["hi"]) & shared(middle)
        return F.struct(F.when(hit, middle).otherwise(s["lo"]).alias("lo"), F.when(hit | (s["lo"] >= s["hi"]), s["hi"]).otherwise(middle - 1).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2((n + 1).cast("double"))).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.least(n, F.length(b)).alias("hi")), halve, lambda s: s["lo"])
    return found if least is None else F.when(shared(F.greatest(least, F.lit(1))), found).otherwise(0)


def containment_score(quote: Column, text: Column, least: float = 0.0) -> Column:
    """Length of the longest common run of quote and text (white space collapsed) by the quote's length; 0 for an empty
    quote, and for a share below ``least``, which costs less to tell."""
    both = F.struct(collapse(F.coalesce(quote, F.lit(""))).alias("q"), collapse(F.coalesce(text, F.lit(""))).alias("t"))
    # as a lambda's variable the collapsed texts are computed once, not for each comparison
    share = lambda s: F.when(s["q"] == "", 0.0).when(F.contains(s["t"], s["q"]), 1.0).otherwise(longest_run(s["q"], s["t"], F.ceil(F.length(s["q"]) * least - 1e-9).cast("int") if least else None) / F.length(s["q"]))
    return F.element_at(F.transform(F.array(both), share), 1)


def contained(quote: Column, text: Column) -> Column:
    """1 if the collapsed quote is in the collapsed text, else 0: the exact part of containment_score, without Python."""
    q = collapse(F.coalesce(quote, F.lit("")))
    return F.when((q != "") & F.contains(collapse(F.coalesce(text, F.lit(""))), q), 1.0).otherwise(0.0)


def best_quote(claim: str | None, text: str | None) -> str:
    """The sentence of a text that is most like a claim, with a neighbour if that is strictly better."""
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]
    if not parts:
        return ""
    like = lambda s: SequenceMatcher(None, (claim or "").lower(), s.lower()).ratio()
    scores = [like(s) for s in parts]
    i = scores.index(max(scores))
    best, quote = scores[i], parts[i]
    for pair in (parts[i - 1 : i + 1] if i else [], parts[i : i + 2] if i + 1 < len(parts) else []):
        if pair and (score := like(" ".join(pair))) > best:
            best, quote = score, " ".join(pair)
    return quote


@lazy_pandas_udf("string")
def extracted_quote(claim: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_quote(c, t) for c, t in zip(claim, text, strict=True)])


def extract_quotes(claims: DataFrame, context: DataFrame) -> DataFrame:
    """Claims (query_id, claim_no, text, citation_ids) narrowed to their first id, with the quote taken from its text; an
    empty quote for unknown ids."""
    first = F.expr("try_element_at(citation_ids, 1)")
    known = context.select("query_id", F.col("label").alias("_l"), F.col("text").alias("_t"))
    joined = claims.withColumn("_l", first).join(known, ["query_id", "_l"], "left")
    quote = F.when(F.col("_t").isNotNull(), extracted_quote("text", F.coalesce("_t", F.lit("")))).otherwise("")
    return joined.withColumn("supporting_quote", quote).withColumn("citation_ids", F.slice("citation_ids", 1, 1)).drop("_l", "_t")


def verify_claims(claims: DataFrame, context: DataFrame, score=containment_score, threshold: float = QUOTE_THRESHOLD) -> DataFrame:
    """(query_id, claim_no, doc_ids_valid, quote_match_score, passed, failure_reason) of claims (query_id, claim_no,
    citation_ids, supporting_quote) against the labelled texts (query_id, label, text).

    In this order: hallucinated_citation_id if an id is unknown (a claim without ids has none and scores 0);
    quote_contains_citation_marker; passed if a cited text scores at least the threshold; citation_reattribution_candidate
    if another text of the context does; quote_spans_multiple_chunks if all texts together do; else quote_not_found.
    ``score`` is a function of (quote, text) columns."""
    c = claims.select("query_id", "claim_no", F.coalesce("citation_ids", F.array().cast("array<string>")).alias("_ids"), F.coalesce("supporting_quote", F.lit("")).alias("_quote"))
    ctx = context.select("query_id", "label", "text")
    every = ctx.groupBy("query_id").agg(F.collect_set("label").alias("_labels"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.length("label").alias("n"), "label", "text"))), lambda s: s["text"]), " ").alias("_whole"))
    other = (lambda q, t: containment_score(q, t, threshold)) if score is containment_score else score  # of texts that aren't cited only a good score counts
    base = c.join(every, "query_id", "left").withColumn("doc_ids_valid", F.size(F.array_except("_ids", F.coalesce("_labels", F.array().cast("array<string>")))) == 0)
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # scores cost more than their few rows let on
    pairs = base.select("query_id", "claim_no", "_ids", "_quote").join(ctx, "query_id").repartition(parts, "query_id", "claim_no").withColumn("_cited", F.array_contains("_ids", F.col("label")))
    own = F.round(F.max(F.when(F.col("_cited"), score(F.col("_quote"), F.col("text")))), 6)
    best = pairs.groupBy("query_id", "claim_no").agg(own.alias("_own"), F.round(F.max(F.when(~F.col("_cited"), other(F.col("_quote"), F.col("text")))), 6).alias("_other"))
    marked = has_citation_mark(F.col("_quote")) & (F.col("_quote") != "")
    joined = base.join(best, ["query_id", "claim_no"], "left").withColumn("_own", F.coalesce("_own", F.lit(0.0))).withColumn("_other", F.coalesce("_other", F.lit(0.0)))
    own = F.when(F.col("doc_ids_valid") & ~marked, F.col("_own")).otherwise(0.0)
    passed = F.col("doc_ids_valid") & ~marked & (F.col("_own") >= threshold)
    reason = (
        F.when(~F.col("doc_ids_valid"), "hallucinated_citation_id")
        .when(marked, "quote_contains_citation_marker")
        .when(passed, F.lit(None))
        .when((F.col("_other") >= threshold) & (F.col("_other") > F.col("_own")), "citation_reattribution_candidate")
        .when(other(F.col("_quote"), F.col("_whole")) >= threshold, "quote_spans_multiple_chunks")
        .otherwise("quote_not_found")
    )
    return joined.select("query_id", "claim_no", "doc_ids_valid", own.alias("quote_match_score"), passed.alias("passed"), reason.alias("failure_reason"))


def claim_diagnostics(claims: DataFrame, results: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, claim_no, citation_id, chunk_id, quote_length, quote_found, quote_start, quote_end, crossed_boundary,
    failure_reason) of every claim: where its quote stands in the text of its first label, -1 if it doesn't."""
    known = context.select("query_id", F.col("label").alias("citation_id"), "chunk_id", F.col("text").alias("_t"))
    c = claims.select("query_id", "claim_no", F.expr("try_element_at(citation_ids, 1)").alias("citation_id"), F.coalesce("supporting_quote", F.lit("")).alias("_q"))
    joined = c.join(known, ["query_id", "citation_id"], "left").join(results.select("query_id", "claim_no", "failure_reason"), ["query_id", "claim_no"], "left")
    start = F.when(F.col("_q") == "", -1).otherwise(F.coalesce(find(F.col("_t"), F.col("_q")), F.lit(-1)))
    out = joined.withColumn("_at", start).withColumn("_n", F.length("_q"))
    crossed = F.coalesce(F.col("failure_reason") == "quote_spans_multiple_chunks", F.lit(False))
    return out.select("query_id", "claim_no", "citation_id", "chunk_id", F.col("_n").alias("quote_length"), (F.col("_at") >= 0).alias("quote_found"), F.col("_at").alias("quote_start"), F.when(F.col("_at") >= 0, F.col("_at") + F.col("_n")).otherwise(-1).alias("quote_end"), crossed.alias("crossed_boundary"), "failure_reason")


def verification_pass(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, verification_pass): whether an answer has claims and all of them passed."""
    each = results.groupBy("query_id").agg(F.bool_and("passed").alias("_all"))
    return queries.select("query_id").join(each, "query_id", "left").select("query_id", F.coalesce("_all", F.lit(False)).alias("verification_pass"))


def verification_report(results: DataFrame) -> DataFrame:
    """(query_id, total_claims, verified_claims, failed_claims, hallucinated, missing_quotes) per answer."""
    good = F.sum(F.col("passed").cast("int"))
    other = F.col("failure_reason").isNotNull() & (F.col("failure_reason") != "hallucinated_citation_id")
    return results.groupBy("query_id").agg(F.count("*").alias("total_claims"), good.alias("verified_claims"), (F.count("*") - good).alias("failed_claims"), F.sum((~F.col("doc_ids_valid")).cast("int")).alias("hallucinated"), F.sum(other.cast("int")).alias("missing_quotes"))


def confidence(queries: DataFrame, ranked: DataFrame, claims: DataFrame, results: DataFrame, context: DataFrame, verify: bool = True) -> DataFrame:
    """(query_id, retrieval, citations, coverage, overall) of every query (of six decimals).

    retrieval: sigmoid of the first chunk's rerank score, or one by its rank without score, 0 without chunks; citations:
    the share of verified claims, 1 without claims; coverage: the share of context labels that claims with valid ids cite,
    0 without context; overall: 0.4, 0.4 and 0.2 of them. Without verification only retrieval counts and the rest is 0."""
    first = ranked.groupBy("query_id").agg(F.min_by(F.struct("rerank_score", "final_rank"), "final_rank").alias("_f"))
    retrieval = F.when(F.col("_f").isNull(), 0.0).when(F.col("_f.rerank_score").isNotNull(), sigmoid(F.col("_f.rerank_score"))).otherwise(1 / F.col("_f.final_rank"))
    report = results.groupBy("query_id").agg(F.avg(F.col("passed").cast("double")).alias("_c"))
    cited = claims.join(results.filter("doc_ids_valid"), ["query_id", "claim_no"], "left_semi").select("query_id", F.explode("citation_ids").alias("label")).join(context.select("query_id", "label"), ["query_id", "label"], "left_semi").groupBy("query_id").agg(F.count_distinct("label").alias("_n"))
    size = context.groupBy("query_id").agg(F.count_distinct("label").alias("_m"))
    out = queries.select("query_id").join(first, "query_id", "left").join(report, "query_id", "left").join(cited, "query_id", "left").join(size, "query_id", "left")
    on = 1.0 if verify else 0.0
    out = out.withColumn("retrieval", F.round(retrieval, 6)).withColumn("citations", F.round(on * F.coalesce("_c", F.lit(1.0)), 6)).withColumn("coverage", F.round(on * F.coalesce(F.coalesce("_n", F.lit(0)) / F.col("_m"), F.lit(0.0)), 6))
    total = 0.4 * F.col("retrieval") + 0.4 * F.col("citations") + 0.2 * F.col("coverage")
    return out.select("query_id", "retrieval", "citations", "coverage", F.round(total, 6).alias("overall"))


def zeroed_on_error(scores: DataFrame, errors: DataFrame) -> DataFrame:
    """Confidence of answers, all zero for those of (query_id, error) whose generation failed altogether."""
    failed = errors.filter("error is not null").select("query_id").distinct().withColumn("_failed", F.lit(True))
    names = ["retrieval", "citations", "coverage", "overall"]
    return scores.join(failed, "query_id", "left").select("query_id", *[F.when(F.col("_failed"), 0.0).otherwise(F.col(n)).alias(n) for n in names])


def confidence_band(retrieval: Column, overall: Column) -> Column:
    return F.when(retrieval < 0.35, "no evidence").when(overall > 0.8, "High").when(overall > 0.6, "Medium").otherwise("Low")


def drift(answer: Column, structured_ids: Column) -> Column:
    """struct(inline_ids, ok): labels marked in the answer's text, and whether all are among the claims' ids."""
    inline = inline_citations(answer)
    return F.struct(inline.alias("inline_ids"), (F.size(F.array_except(inline, structured_ids)) == 0).alias("ok"))


def citation_status(failed: Column, drift_ok: Column) -> Column:
    return F.when(failed > 0, "verification_failed").when(~drift_ok, "inline_drift").otherwise("ok")


def cited_documents(claims: DataFrame, context: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, document_ids, documents_used): the distinct documents behind the claims' labels, sorted, and how many; unknown labels are dropped."""
    ids = claims.select("query_id", F.explode("citation_ids").alias("label")).join(context.select("query_id", "label", "chunk_id"), ["query_id", "label"]).join(chunks.select("chunk_id", "document_id").distinct(), "chunk_id")
    return ids.groupBy("query_id").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"), F.count_distinct("document_id").alias("documents_used"))

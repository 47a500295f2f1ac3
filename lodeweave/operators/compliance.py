"""Questions about regulations: intent, routing, filters by metadata, dates, supersession, clauses, citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Regulations and jurisdictions that make a question a filter, the first in the alphabet winning.
REGULATIONS = ["CCPA", "GDPR", "HIPAA", "ISO27001", "PCI-DSS", "SOC2"]
JURISDICTIONS = ["EU", "INDIA", "UK", "US"]
#: Words that ask for more than the text of a clause.
ELABORATION = ["explain", "what", "why", "how", "summarize", "does", "say", "mean"]
#: Words of questions that compare.
COMPARATIVE = [
    "compare", "comparison", "comparative", "difference", "differ", "differs", "different", "versus", r"vs\.?", "across", "contrast",
    "relationship", "related", "relative", "between", "outperform", "underperform", "better", "worse", "superior", "inferior",
    "pros and cons", "advantages?", "disadvantages?", "tradeoffs?", "trade-offs?", "correlation", "correlate",
    "amend", "amends", "amended", "supersede", "supersedes", "superseded", "replace", "replaces", "replaced", "repeal", "repeals", "repealed",
]
MATCHED_LOOSELY = ["regulation", "authority"]
FIELDS = ["regulation", "authority", "jurisdiction", "article", "section", "clause", "version", "document_type", "risk_category", "document_id", "is_current", "as_of_date"]
IDENTITY = ["regulation", "authority", "jurisdiction", "article", "section", "clause"]


def is_comparative(question: Column) -> Column:
    return question.rlike(rf"(?i)\b({'|'.join(COMPARATIVE)})\b")


def classify(question: Column, regulations: list[str] | None = None, jurisdictions: list[str] | None = None) -> Column:
    """struct(kind, filters): structured for a bare reference to a clause, article or section (in that order), mixed if
    the question also asks for an explanation, metadata for a known regulation (anywhere) or jurisdiction (a word), else semantic."""
    filters = F.lit(None).cast("map<string,string>")
    for name in reversed(sorted(jurisdictions or JURISDICTIONS)):
        filters = F.when(F.upper(question).rlike(rf"\b{re.escape(name)}\b"), F.create_map(F.lit("jurisdiction"), F.lit(name))).otherwise(filters)
    for name in reversed(sorted(regulations or REGULATIONS)):
        filters = F.when(F.contains(F.upper(question), F.lit(name.upper())), F.create_map(F.lit("regulation"), F.lit(name))).otherwise(filters)
    reference = F.lit(None).cast("map<string,string>")
    for name, pattern in (("section", r"(?i)\bsection\s+([\d.]+)"), ("article", r"(?i)\barticle\s+(\d+[A-Za-z]?)"), ("clause", r"(?i)\bclause\s+([\d.]+(?:\([a-z]\))?)")):
        reference = F.when(question.rlike(pattern), F.create_map(F.lit(name), F.regexp_extract(question, pattern, 1))).otherwise(reference)
    elaborate = question.rlike(rf"(?i)\b({'|'.join(ELABORATION)})\b")
    kind = F.when(reference.isNotNull(), F.when(elaborate, "mixed").otherwise("structured")).when(filters.isNotNull(), "metadata").otherwise("semantic")
    return F.struct(kind.alias("kind"), F.coalesce(reference, filters, F.create_map().cast("map<string,string>")).alias("filters"))


def matches(field: str, stored: Column, wanted: Column) -> Column:
    """Regulation and authority match anywhere in the stored value, whatever the case; other fields exactly."""
    return F.contains(F.lower(stored), F.lower(wanted)) if field in MATCHED_LOOSELY else stored == wanted


def legal_filter(chunks: DataFrame, filters: dict[str, str], meta: str = "legal_metadata") -> DataFrame:
    """Chunks that match all filters, in the order of document and index. No filter matches nothing; an unknown field is
    an error; is_current is "true" or "false"; as_of_date keeps the rows of the greatest date up to it."""
    unknown = sorted(set(filters) - set(FIELDS))
    if unknown:
        raise ValueError(f"unknown filter fields {unknown}")
    if not filters:
        return chunks.limit(0)
    out = chunks.filter(F.col(meta).isNotNull())
    for field, value in filters.items():
        if field == "as_of_date":
            continue
        stored = F.col(f"{meta}.{field}")
        out = out.filter(stored == F.lit(value == "true") if field == "is_current" else matches(field, stored, F.lit(value)))
    if "as_of_date" in filters:
        out = as_of(out, filters["as_of_date"], F.col(f"{meta}.effective_date"))
    return out.orderBy("document_id", "chunk_index")


def as_of(rows: DataFrame, day: str, date: Column) -> DataFrame:
    """The rows of the latest date up to the given day."""
    dated = rows.withColumn("_d", date).filter(F.col("_d") <= F.lit(day).cast("date"))
    latest = dated.agg(F.max("_d").alias("_m"))  # one row
    return dated.join(F.broadcast(latest), F.col("_d") == F.col("_m")).drop("_d", "_m")


def as_of_days(rows: DataFrame, days: DataFrame, date: Column) -> DataFrame:
    """As ``as_of`` for every day of (day) at once: adds day. Only distinct dates meet the days, then the rows of one date
    are looked up by it."""
    dated = rows.withColumn("_d", date).filter(F.col("_d").isNotNull())
    latest = dated.select("_d").distinct().join(days, F.col("_d") <= F.col("day")).groupBy("day").agg(F.max("_d").alias("_d"))
    return dated.join(latest, "_d").drop("_d")


def match_questions(questions: DataFrame, chunks: DataFrame, meta: str = "legal_metadata") -> DataFrame:
    """(query_id, chunk_id) of all chunks that the filters of (query_id, intent) name. One equi-join per exact field, a
    broadcast of the few distinct values for the loosely matched ones."""
    wanted = questions.select("query_id", F.explode("intent.filters").alias("field", "value"))
    held = chunks.filter(F.col(meta).isNotNull())
    parts = []
    for field in ("clause", "article", "section", "jurisdiction"):
        q = wanted.filter(F.col("field") == field).select("query_id", F.col("value").alias("_v"))
        parts.append(held.select("chunk_id", F.col(f"{meta}.{field}").alias("_v")).join(q, "_v").select("query_id", "chunk_id"))
    q = wanted.filter(F.col("field") == "regulation").select("query_id", F.col("value").alias("_w"))
    # distinct names alone; Spark broadcasts the smaller side if it is small
    names = held.select(F.col(f"{meta}.regulation").alias("_v")).distinct().join(q.select("_w").distinct(), F.contains(F.lower("_v"), F.lower("_w")))
    parts.append(held.select("chunk_id", F.col(f"{meta}.regulation").alias("_v")).join(names, "_v").join(q, "_w").select("query_id", "chunk_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def route(questions: DataFrame, chunks: DataFrame, retrieved: DataFrame, meta: str = "legal_metadata") -> DataFrame:
    """(query_id, id, rrf_score, final_rank, kind): structured questions get the chunks their filters name, in order of
    document and index, with score 1; metadata and mixed ones their retrieved hits among these; semantic ones all hits.

    retrieved: (query_id, id, rrf_score, fused_rank) of the questions that are not structured."""
    kinds = questions.select("query_id", F.col("intent.kind").alias("kind"))
    named = match_questions(questions.filter("intent.kind <> 'semantic'"), chunks, meta)
    w = W.partitionBy("query_id").orderBy("document_id", "chunk_index", "id")
    exact = named.join(kinds.filter("kind = 'structured'"), "query_id").join(chunks.select("chunk_id", "document_id", "chunk_index").dropDuplicates(["chunk_id"]), "chunk_id").withColumnRenamed("chunk_id", "id")
    structured = exact.select("query_id", "id", F.lit(1.0).alias("rrf_score"), F.row_number().over(w).alias("final_rank"), "kind")
    hits = retrieved.join(kinds, "query_id").select("query_id", "id", "rrf_score", F.col("fused_rank").alias("_r"), "kind")
    within = hits.filter("kind in ('metadata', 'mixed')").join(named.withColumnRenamed("chunk_id", "id"), ["query_id", "id"], "left_semi")
    rest = within.unionByName(hits.filter("kind = 'semantic'"))
    ranked = rest.withColumn("final_rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r"))).drop("_r")
    return structured.unionByName(ranked.select(*structured.columns))


def supersede(rows: DataFrame, identity: list[str] | None = None, new: Column | None = None) -> DataFrame:
    """Adds new_is_current and new_superseded_by to rows of (identity fields, document_id, effective_date, is_current, superseded_by).

    Every dated row with a regulation and an article or a section names a provision by its identity, in which missing
    fields match anything and regulation and authority match anywhere in the stored value. Of the dated rows that a
    provision matches (two at least) those of the document of the latest date are current and the others superseded by it,
    unless several documents share that date. Rows whose state is right already, and rows that no provision decides, stay
    as they are; of several provisions the one with the most fields counts, then the smallest by its key. ``new``: which
    rows name provisions (default: all). Rows are first pre-aggregated by identity, date and document, so a frequent
    provision is no large group.
    """
    fields = identity or IDENTITY
    rows = rows.withColumn("_ident", F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("-")) for f in fields])))
    names = F.col("effective_date").isNotNull() & F.col("regulation").isNotNull()
    places = [F.col(c).isNotNull() for c in ("article", "section") if c in fields]
    names = names & (places[0] if len(places) == 1 else places[0] | places[1])
    if new is not None:
        names = names & new
    dated = rows.filter(F.col("effective_date").isNotNull()).groupBy("_ident", *fields, "effective_date", "document_id").agg(F.count("*").alias("_n"), F.max(names.cast("int")).alias("_names"))
    dated = cut(dated, "supersession")
    idents = dated.groupBy("_ident", *fields).agg(F.max("_names").alias("_names"))
    keys = idents.filter("_names = 1").withColumnRenamed("_ident", "key_id")
    match = cut(wildcard_matches(keys, idents.withColumnRenamed("_ident", "row_id"), fields), "supersession-matches")
    seen = match.join(dated.select(F.col("_ident").alias("row_id"), "effective_date", "document_id", "_n"), "row_id")
    days = seen.groupBy("key_id", "effective_date", "document_id").agg(F.sum("_n").alias("_n")).groupBy("key_id", "effective_date").agg(F.count("*").alias("_docs"), F.min("document_id").alias("_doc"), F.sum("_n").alias("_n"))
    best = days.groupBy("key_id").agg(F.max_by(F.struct("_docs", "_doc"), "effective_date").alias("_w"), F.sum("_n").alias("_rows"))
    winners = best.filter("_rows >= 2 and _w._docs = 1 and _w._doc is not null").select("key_id", F.col("_w._doc").alias("_winner"))
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    decided = match.join(winners.join(keys.select("key_id", missing.alias("_missing")), "key_id"), "key_id").groupBy("row_id").agg(F.min_by("_winner", F.struct("_missing", "key_id")).alias("_winner"))
    out = rows.join(decided.withColumnRenamed("row_id", "_ident"), "_ident", "left")
    wins = F.col("document_id").eqNullSafe(F.col("_winner"))
    changes = F.col("_winner").isNotNull() & F.col("effective_date").isNotNull() & ~F.col("is_current").eqNullSafe(wins)
    return out.withColumn("new_is_current", F.when(changes, wins).otherwise(F.col("is_current"))).withColumn("new_superseded_by", F.when(changes & ~wins, F.col("_winner")).when(changes, F.lit(None)).otherwise(F.col("superseded_by"))).drop("_winner", "_ident")


def wildcard_matches(keys: DataFrame, rows: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(key_id, row_id): rows that match keys in which a null field matches anything, regulation and authority anywhere in
    the stored value. Keys with neither article nor section match nothing, as in indexing.

    Each pattern of given fields is one equi-join on all of them; loosely matched names are first replaced by the keys'
    names that they hold, from the distinct names alone."""
    fields = fields or IDENTITY
    place = [c for c in ("article", "section") if c in fields]
    keys = keys.filter(" or ".join(f"{c} is not null" for c in place))
    given = F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in fields])
    patterns = sorted(r[0] for r in keys.select(given.alias("p")).distinct().collect())  # at most 2 ** fields
    loose = {}
    for f in [f for f in fields if f in MATCHED_LOOSELY]:
        held, wanted = rows.select(F.col(f).alias("_held")).distinct(), keys.select(F.col(f).alias("_name")).distinct()
        loose[f] = cut(held.join(wanted, matches(f, F.col("_held"), F.col("_name"))), "names")  # distinct names alone
    parts = []
    for p in patterns:
        on = [f for f, g in zip(fields, p, strict=True) if g == "1"]
        k = keys.filter(given == p).select("key_id", *on)
        r = rows.select("row_id", *on)
        for f in [f for f in on if f in loose]:
            r = r.join(loose[f], F.col(f) == F.col("_held")).drop(f, "_held").withColumnRenamed("_name", f)
        parts.append(r.join(k, on).select("key_id", "row_id"))
    out = parts[0] if parts else keys.select("key_id").crossJoin(rows.select("row_id")).limit(0)
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


#: Lines that are headings, and line starts that are numbered clauses.
HEADINGS = {
    "article": r"^(?:Article|ARTICLE|Art\.)\s+(\d+[A-Za-z]?)\s*$",
    "section": r"^(?:Section|SECTION|Sec\.)\s+([\d.]+)\s*$",
    "chapter": r"^(?:Chapter|CHAPTER)\s+([IVXLCDM]+|\d+)\s*$",
    "annex": r"^(?:Annex|ANNEX|Appendix|APPENDIX)\s+([A-Za-z0-9]+)\s*$",
}
NUMBERED = r"^\(?(\d+(?:\.\d+)*(?:\([a-z]\))?)\)?[\s\p{Z}\x85\x1c-\x1f.:]"
EDGES = r"(?s)^[\s\p{Z}\x85\x1c-\x1f]+|[\s\p{Z}\x85\x1c-\x1f]+$"


def parse_clauses(df: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """(id_col, ord, article, section, clause, text, confidence, fallback): a text cut at Article, Section, Chapter and
    Annex headings and at numbered clauses, each with its lettered items. An article ends the section and the other way
    round; text before the first heading is left out; a text without headings comes out whole, with confidence 0; null
    and blank texts give nothing; repeated rows come out repeatedly. Lines that begin with a number open a clause even
    where they are none (`20 000 EUR`).

    Lines are events: headings and numbers are told by line, the heading in force is the last one so far, and runs of
    lines with the same numbers of headings and clauses so far are one piece."""
    bare = lambda c: F.regexp_replace(c, EDGES, "")
    found = lambda name: F.nullif(F.regexp_extract("_line", f"(?U){HEADINGS[name]}", 1), F.lit(""))
    texts = df.select(F.monotonically_increasing_id().alias("_r"), F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).filter(bare(F.col("_t")) != "")
    lines = texts.select("_r", "_id", F.length("_t").alias("_len"), F.posexplode(F.split("_t", "\n")).alias("_n", "_line"))
    other = F.coalesce(found("chapter"), found("annex"))
    lines = lines.select("*", found("article").alias("_a"), found("section").alias("_s")).withColumn("_head", F.coalesce("_a", "_s", other).isNotNull())
    so_far = W.partitionBy("_r").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    force = F.last(F.when(F.coalesce("_a", "_s").isNotNull(), F.struct("_a", "_s")), ignorenulls=True).over(so_far)
    lines = lines.withColumn("_k", F.sum(F.col("_head").cast("int")).over(so_far)).withColumn("_f", force).filter("_k > 0")
    within = W.partitionBy("_r", "_k")
    # a block ends with its last line that isn't blank, and no line end follows that
    more = F.col("_n") < F.max(F.when(bare(F.col("_line")) != "", F.col("_n"))).over(within)
    number = F.nullif(F.regexp_extract(F.concat("_line", F.when(more, F.lit("\n")).otherwise("")), NUMBERED, 1), F.lit(""))
    lines = lines.withColumn("_num", number).withColumn("_sub", F.count("_num").over(within.orderBy("_n").rowsBetween(W.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    pieces = lines.groupBy("_r", "_id", "_len", "_k", "_sub").agg(F.first("_f").alias("_f"), F.max("_num").alias("_num"), bare(joined).alias("_text"))
    order = within.orderBy("_sub")
    pieces = pieces.withColumn("_next", F.lead("_sub").over(order)).withColumn("_lead", F.when(F.lag("_sub").over(order) == 0, F.lag("_text").over(order))).filter("_sub > 0 or _next is null")
    text = F.when((F.col("_sub") == 1) & (F.col("_lead") != ""), F.concat("_lead", F.lit("\n"), F.col("_text"))).otherwise(F.col("_text"))
    label = F.when(F.col("_f._a").isNull(), F.col("_num")).otherwise(F.concat("_f._a", F.lit("."), "_num"))
    parts = pieces.select("_r", "_id", "_len", (F.row_number().over(W.partitionBy("_r").orderBy("_k", "_sub")) - 1).alias("ord"), F.col("_f._a").alias("article"), F.col("_f._s").alias("section"), label.alias("clause"), text.alias("text"))
    covered = F.least(F.lit(1.0), F.sum(F.length("text")).over(W.partitionBy("_r")) / F.greatest("_len", F.lit(1)))
    cut_up = parts.select(F.col("_id").alias(id_col), "ord", "article", "section", "clause", "text", F.least(F.lit(1.0), 0.5 + 0.5 * covered).alias("confidence"), F.lit(False).alias("fallback"))
    heading = "|".join(f"(?:{h})" for h in HEADINGS.values())
    whole = texts.filter(~F.col("_t").rlike(f"(?Umd){heading.replace(chr(92) + 's', '[^' + chr(92) + 'S' + chr(92) + 'n]')}"))
    none = F.lit(None).cast("string")
    return cut_up.unionByName(whole.select(F.col("_id").alias(id_col), F.lit(0).alias("ord"), none.alias("article"), none.alias("section"), none.alias("clause"), bare(F.col("_t")).alias("text"), F.lit(0.0).alias("confidence"), F.lit(True).alias("fallback")))


def chunk_clauses(df: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Chunks of clauses, oversized ones cut at paragraphs; the heading is the article or the section."""
    from .chunking import as_chunks, pack_paragraphs

    parsed = parse_clauses(df.select(id_col, text_col), id_col, text_col).filter("trim(text) <> ''")
    pieces = parsed.select(id_col, "ord", "article", "section", "clause", F.posexplode(pack_paragraphs(F.col("text"))).alias("_p", "text"))
    counted = pieces.withColumn("chunk_index", F.row_number().over(W.partitionBy(id_col).orderBy("ord", "_p")) - 1).withColumn("heading", F.coalesce("article", "section"))
    chunks = as_chunks(counted, "clause-v1", id_col)
    return chunks.join(counted.select(F.col(id_col).alias("document_id"), F.col("chunk_index"), "article", "section", "clause"), ["document_id", "chunk_index"])


def clause_coverage(parts: DataFrame, texts: DataFrame, id_col: str) -> DataFrame:
    """(id_col, coverage, confidence) of parsed clauses against whole texts."""
    sums = parts.groupBy(id_col).agg(F.sum(F.length("text")).alias("_s"))
    share = F.col("_s") / F.greatest(F.length("_t"), F.lit(1))
    return texts.join(sums, id_col).select(id_col, F.round(share, 6).alias("coverage"), F.round(F.least(F.lit(1.0), 0.5 + 0.5 * F.least(share, F.lit(1.0))), 6).alias("confidence"))


def citations(chunks: DataFrame, titles: DataFrame | None = None, meta: str = "legal_metadata") -> DataFrame:
    """A structured citation of every ranked chunk (query_id, chunk_id, document_id, chunk_index, page, text, rerank_score,
    legal metadata): its id, title, confidence (0 without score), display, text and legal fields. titles: (document_id,
    filename); a document without one is cited by its id. Chunks without legal metadata have null legal fields."""
    rows = chunks.withColumn("filename", F.lit(None).cast("string")) if titles is None else chunks.join(titles.select("document_id", "filename"), "document_id", "left")
    title, legal = F.coalesce("filename", "document_id"), F.col(meta)
    return rows.select(
        "query_id",
        F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), "chunk_id"), 256).alias("citation_id"),
        "document_id",
        F.when(legal.isNotNull(), legal["document_title"]).otherwise(title).alias("document_title"),
        "chunk_id",
        F.coalesce("rerank_score", F.lit(0.0)).alias("confidence"),
        citation_display(title, F.col("chunk_index"), F.col("page"), legal).alias("display"),
        F.col("text").alias("chunk_text"),
        *[legal[f].alias(f) for f in ("regulation", "version", "jurisdiction", "article", "section", "clause", "effective_date", "document_type")],
        F.coalesce(F.nullif(legal["page"], F.lit(0)), "page").alias("page"),
    )


def citation_display(title: Column, chunk_index: Column, page: Column, meta: Column) -> Column:
    """How a chunk is cited: `GDPR Art. 83(5)(a), p.3`, or title, page and number where there is no legal metadata."""
    own, legal_page = F.nullif(page, F.lit(0)), F.nullif(meta["page"], F.lit(0))
    plain = F.concat(title, F.coalesce(F.concat(F.lit(", p."), own), F.lit("")), F.lit(", chunk "), chunk_index)
    tail = F.regexp_extract(meta["clause"], r"(?s)^[^.]*\.(.*)$", 1)
    opens = F.instr(tail, "(")
    suffix = F.when(~F.contains(F.coalesce(meta["clause"], F.lit("")), F.lit(".")), "").when(opens > 0, F.concat(F.lit("("), F.substring(tail, F.lit(1), opens - 1), F.lit(")"), F.substring(tail, opens, F.length(tail)))).otherwise(F.concat(F.lit("("), tail, F.lit(")")))
    place = F.when(meta["article"] != "", F.concat(F.lit("Art. "), meta["article"], suffix)).when(meta["clause"] != "", F.concat(F.lit("Clause "), meta["clause"]))
    name = F.concat_ws(" ", F.nullif(meta["regulation"], F.lit("")), place)
    return F.when(meta.isNull() | (meta["regulation"].isNull() & meta["article"].isNull()), plain).otherwise(F.concat(name, F.coalesce(F.concat(F.lit(", p."), F.coalesce(legal_page, own)), F.lit(""))))

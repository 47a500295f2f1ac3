"""Queries of loading, chunking and content addressing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_hash
from ..operators import chunking, compliance, dedup
from ..providers import deterministic_embedding
from ..session import cut, table
from ..sources import format_of, gutters, load_documents, page_texts, rendered_rows, safe_name, upload_problem
from .retrieval import STORED, stored_chunks


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document once."""
    return table(spark, sf_dir, "source_documents").filter("content is not null").select("document_id", "content").distinct()


def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 500 characters that overlap by 150."""
    return chunking.chunk_fixed(table(spark, sf_dir, "documents"), id_col="doc_id", text_col="text").select("document_id", "chunk_index", "text", "char_count")


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections under markdown headings, windowed."""
    return chunking.chunk_recursive(_sources(spark, sf_dir)).select("document_id", "chunk_index", "heading", "text")


def chunk_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed up to 6000 characters."""
    return chunking.chunk_paragraphs(_sources(spark, sf_dir)).select("document_id", "chunk_index", "char_count", F.md5("text").alias("text_md5"))


def semantic_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring vectors of a label that are alike."""
    return chunking.islands(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("vec_id", "label", "island")


def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sentences of like embedding."""
    return chunking.chunk_semantic(_sources(spark, sf_dir), deterministic_embedding).select("document_id", "chunk_index", "text")


def clause_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, sections and numbered clauses of every document."""
    return compliance.parse_clauses(_sources(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compliance.chunk_clauses(_sources(spark, sf_dir))


def chunk_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause chunks of legal documents, sections of all others."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "document_type")
    return chunking.by_document_type(docs, compliance.chunk_clauses, chunking.chunk_recursive).groupBy("document_id", "strategy_version").agg(F.count("*").alias("chunks"), F.sum("char_count").alias("chars"))


def doc_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by content hash, with how often each occurs and the first document."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(content_hash(F.col("text")).alias("document_id")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made of documents, with script, style, comment and entities, as text again."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    body = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit('<!DOCTYPE html><html><head><style>p { margin: 0 }</style><script>var s = "</p>";</script></head><body><!-- made --><h1>'), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), body, F.lit("</p><p>&copy; &middot; &quot;end&quot;</p></body></html>"))
    files = d.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".html")).alias("path"), F.encode(page, "utf-8").alias("content"))
    return load_documents(files).select(F.regexp_extract("source_path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "content")


def csv_row_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of `name: value`, one text per nation and thousand of numbers, so that no text grows with the table."""
    pages = table(spark, sf_dir, "customer").withColumn("page", F.floor(F.col("c_custkey") / 1000))
    return rendered_rows(pages, ["c_custkey", "c_name", "c_mktsegment"], ["c_nationkey", "page"], ["c_custkey"])


def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files with format, safe name and why their content, taken as text bytes, would be refused."""
    s = table(spark, sf_dir, "source_documents")
    return s.select("source_path", format_of(F.col("source_path")).alias("format"), safe_name(F.col("source_path")).alias("name"), upload_problem(F.col("source_path"), F.encode(F.coalesce("content", F.lit("")), "utf-8"), 20_000).alias("problem"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes made of line items: a page per supplier, two columns on pages of even number."""
    li = table(spark, sf_dir, "lineitem")
    wide = F.when(F.col("l_suppkey") % 2 == 0, F.when(F.col("l_orderkey") % 2 == 0, F.col("l_partkey") % 200).otherwise(F.col("l_partkey") % 200 + 320)).otherwise(F.col("l_partkey") % 520)
    return li.select(F.col("l_suppkey").alias("page_id"), F.lit(600.0).alias("width"), wide.cast("double").alias("x0"), (wide + 40 + F.col("l_linenumber")).cast("double").alias("x1"), F.floor(F.col("l_orderkey") / 100).alias("top"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("word"))


def gutter_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two columns of a page part."""
    return gutters(_words(spark, sf_dir))


def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of pages, left column first."""
    return page_texts(_words(spark, sf_dir)).select("page_id", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


def dedup_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth chunk against all others by vector and text: those that repeat nothing. Chunks with a usable vector of
    any model take part; vectors are compared within a model."""
    v = table(spark, sf_dir, "embedding_records").filter("embedding_model is not null and size(embedding) = 64").filter(~F.exists("embedding", lambda x: F.isnan(x) | x.isNull()))
    v = v.groupBy("chunk_id", "embedding_model").agg(F.max_by("embedding", "created_at").alias("embedding"))
    held = cut(stored_chunks(spark, sf_dir).filter("text is not null").select("chunk_id", "document_id", "chunk_index", "text").join(v, "chunk_id"), "dedup-chunks")
    mine = F.conv(F.substring("chunk_id", -8, 8), 16, 10).cast("bigint") % 20 == 0
    return dedup.survivors(held.filter(mine), held.filter(~mine), model_col="embedding_model").select("chunk_id", "document_id", "chunk_index").distinct()


QUERIES = {
    f.__name__: f
    for f in (chunk_fixed, chunk_recursive, chunk_oversize, semantic_islands, chunk_semantic, clause_parse, clause_chunks, chunk_by_type, doc_hash_dedup, html_to_text, csv_row_render, upload_validation, gutter_detect, page_reading_order, dedup_survivors)
}

_WORDS = """words AS (SELECT l_suppkey AS page_id, 600.0::DOUBLE AS width, x0::DOUBLE AS x0, (x0 + 40 + l_linenumber)::DOUBLE AS x1, l_orderkey // 100 AS top, concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS word
    FROM (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 200 ELSE l_partkey % 200 + 320 END ELSE l_partkey % 520 END AS x0 FROM lineitem))"""
_GUTTERS = (
    f"WITH {_WORDS}"
    + """, places AS (SELECT range AS i, 600.0::DOUBLE * (0.35::DOUBLE + (0.65::DOUBLE - 0.35::DOUBLE) * range / 25) AS x FROM range(26)),
    counts AS (SELECT page_id, i, x, count(*) AS n, sum((x0 < x AND x1 > x)::INT) AS crossing, sum((x1 <= x)::INT) AS b, sum((x0 >= x)::INT) AS a FROM words, places GROUP BY ALL),
    best AS (SELECT page_id, any_value(n) AS n, min((crossing, i, x)) FILTER (b >= 0.25 * n AND a >= 0.25 * n) AS s FROM counts GROUP BY page_id),
    gut AS (SELECT page_id, CASE WHEN n >= 20 AND s[1] <= greatest(2, floor(0.02 * n)) THEN round(s[3], 6) END AS gutter FROM best)"""
)
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x{{85}}\x1c-\x1f]+|[\s\p{{Z}}\x{{85}}\x1c-\x1f]+$', '', 'g')"
SQL = {
    "chunk_fixed": """SELECT doc_id AS document_id, i::INT AS chunk_index, substr(text, (i * 350 + 1)::BIGINT, 500) AS text, length(substr(text, (i * 350 + 1)::BIGINT, 500))::INT AS char_count
        FROM (SELECT doc_id, text, unnest(range(ceil(length(text) / 350)::BIGINT)) AS i FROM documents WHERE text IS NOT NULL)""",
    "chunk_recursive": r"""WITH d AS (SELECT DISTINCT document_id, content FROM source_documents WHERE content IS NOT NULL),
        l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM d),
        h AS (SELECT *, regexp_matches(line, '^#{1,6}\s+.+$') AS head FROM l),
        s AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM h),
        b AS (SELECT document_id, k, max(CASE WHEN head THEN """
    + _STRIP.format(r"regexp_extract(line, '^#{{1,6}}\s+(.+)', 1)".replace("{{", "{").replace("}}", "}").replace("\\\\", "\\"))
    + r""" END) AS heading, """
    + _STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), '')")
    + r""" AS body FROM s GROUP BY document_id, k),
        w AS (SELECT document_id, k, heading, CASE WHEN length(body) <= 500 THEN [body] ELSE list_transform(range(ceil(length(body) / 350)::BIGINT), lambda i: substr(body, i * 350 + 1, 500)) END AS ts FROM b WHERE body <> ''),
        u AS (SELECT document_id, k, heading, unnest(ts) AS text, generate_subscripts(ts, 1) AS i FROM w)
        SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY k, i) - 1)::INT AS chunk_index, heading, text FROM u""",
    "clause_parse": r"""WITH d AS (SELECT DISTINCT document_id, content FROM source_documents WHERE content IS NOT NULL),
        l AS (SELECT document_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM d),
        h AS (SELECT *, nullif(regexp_extract(line, '^(?:Article|ARTICLE|Art\.)\s+(\d+[A-Za-z]?)\s*$', 1), '') AS a, nullif(regexp_extract(line, '^(?:Section|SECTION|Sec\.)\s+([\d.]+)\s*$', 1), '') AS s,
            regexp_matches(line, '^(?:Chapter|CHAPTER)\s+([IVXLCDM]+|\d+)\s*$') OR regexp_matches(line, '^(?:Annex|ANNEX|Appendix|APPENDIX)\s+([A-Za-z0-9]+)\s*$') AS o FROM l),
        b AS (SELECT *, sum((coalesce(a, s) IS NOT NULL OR o)::INT) OVER w AS k, sum((coalesce(a, s) IS NOT NULL)::INT) OVER w AS c FROM h WINDOW w AS (PARTITION BY document_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
        e AS (SELECT *, max(CASE WHEN c > 0 THEN a END) OVER (PARTITION BY document_id, c) AS article, max(CASE WHEN c > 0 THEN s END) OVER (PARTITION BY document_id, c) AS section,
            max(CASE WHEN """
    + _STRIP.format("line")
    + r""" <> '' THEN n END) OVER (PARTITION BY document_id, k) AS last FROM b WHERE k > 0),
        m AS (SELECT *, nullif(regexp_extract(line || CASE WHEN n < last THEN chr(10) ELSE '' END, '^\(?(\d+(?:\.\d+)*(?:\([a-z]\))?)\)?[\s\p{Z}\x{85}\x1c-\x1f.:]', 1), '') AS num FROM e),
        u AS (SELECT *, sum((num IS NOT NULL)::INT) OVER (PARTITION BY document_id, k ORDER BY n ROWS UNBOUNDED PRECEDING) AS sub FROM m),
        p AS (SELECT document_id, k, sub, any_value(article) AS article, any_value(section) AS section, max(num) AS num, """
    + _STRIP.format("string_agg(line, chr(10) ORDER BY n)")
    + r""" AS t FROM u GROUP BY document_id, k, sub),
        j AS (SELECT *, lead(sub) OVER w AS nxt, lag(t) OVER w AS lead_, lag(sub) OVER w AS prev FROM p WINDOW w AS (PARTITION BY document_id, k ORDER BY sub)),
        r AS (SELECT document_id, k, sub, article, section, CASE WHEN num IS NULL THEN NULL WHEN article IS NOT NULL THEN article || '.' || num ELSE num END AS clause,
            CASE WHEN sub = 1 AND prev = 0 AND lead_ <> '' THEN lead_ || chr(10) || t ELSE t END AS text FROM j WHERE NOT (sub = 0 AND nxt IS NOT NULL)),
        g AS (SELECT document_id, sum(length(text)) AS n FROM r GROUP BY document_id)
        SELECT r.document_id, (row_number() OVER (PARTITION BY r.document_id ORDER BY k, sub) - 1)::INT AS ord, article, section, clause, text, round(least(1, 0.5::DOUBLE + 0.5::DOUBLE * least(g.n / greatest(length(d.content), 1), 1)), 6)::DOUBLE AS confidence, FALSE AS fallback
        FROM r JOIN g USING (document_id) JOIN d USING (document_id)
        UNION ALL SELECT document_id, 0, NULL, NULL, NULL, """
    + _STRIP.format("content")
    + r""", 0, TRUE FROM d WHERE """
    + _STRIP.format("content")
    + """ <> '' AND document_id NOT IN (SELECT document_id FROM g)""",
    "semantic_islands": """WITH n AS (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
        SELECT vec_id, label, sum(CASE WHEN p IS NOT NULL AND round(list_cosine_similarity(embedding::DOUBLE[], p::DOUBLE[]), 6) < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::INT AS island FROM n""",
    "doc_hash_dedup": "SELECT sha256(text) AS document_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "csv_row_render": """SELECT c_nationkey, c_custkey // 1000 AS page, string_agg('c_custkey: ' || c_custkey || ', c_name: ' || coalesce(c_name, 'None') || ', c_mktsegment: ' || coalesce(c_mktsegment, 'None'), chr(10) ORDER BY c_custkey) AS content FROM customer GROUP BY c_nationkey, c_custkey // 1000""",
    "upload_validation": r"""WITH s AS (SELECT source_path, nullif(regexp_extract(lower(regexp_extract(source_path, '([^/]*)$', 1)), '(\.[^.]+)$', 1), '') AS x, strlen(coalesce(content, '')) AS n, coalesce(content, '') AS c FROM source_documents),
        f AS (SELECT *, CASE WHEN x IN ('.md', '.markdown') THEN 'markdown' WHEN x IN ('.html', '.htm') THEN 'html' WHEN x = '.txt' THEN 'text' WHEN x IN ('.pdf', '.csv', '.xlsx', '.docx') THEN x[2:] END AS format FROM s)
        SELECT source_path, format, CASE WHEN regexp_extract(source_path, '([^/]*)/*$', 1) NOT IN ('', '.', '..') THEN regexp_extract(source_path, '([^/]*)/*$', 1) END AS name,
        CASE WHEN format IS NULL THEN 'unsupported file type' WHEN n > 20000 THEN 'file too large' WHEN format = 'pdf' AND NOT starts_with(c, '%PDF-') OR format IN ('docx', 'xlsx') AND NOT starts_with(c, 'PK') THEN 'content does not match the file type' END AS problem FROM f""",
    "gutter_detect": _GUTTERS + " SELECT page_id, gutter FROM gut",
    "page_reading_order": _GUTTERS
    + """, lines AS (SELECT page_id, CASE WHEN gutter IS NOT NULL AND (x0 + x1) / 2 >= gutter THEN 1 ELSE 0 END AS side, top, string_agg(word, ' ' ORDER BY x0, word) AS line FROM words JOIN gut USING (page_id) GROUP BY ALL)
    SELECT page_id, length(t)::INT AS chars, md5(t) AS text_md5 FROM (SELECT page_id, string_agg(line, chr(10) ORDER BY side, top) AS t FROM lines GROUP BY page_id)""",
    "html_to_text": r"""WITH p AS (SELECT doc_id, '<!DOCTYPE html><html><head><style>p { margin: 0 }</style><script>var s = "</p>";</script></head><body><!-- made --><h1>' || coalesce(title, '') || '</h1><p>'
            || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><p>&copy; &middot; &quot;end&quot;</p></body></html>' AS h FROM documents WHERE text IS NOT NULL),
        t AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script\s*>', '<x>', 'g'), '(?is)<style\b.*?</style\s*>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g'), '(?s)<[^>]*>') AS cs FROM p),
        u AS (SELECT doc_id, list_transform(cs, lambda c: replace(replace(replace(replace(replace(c, '&lt;', '<'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')) AS cs FROM t)
        SELECT doc_id, array_to_string(list_filter(list_transform(cs, lambda x: """
    + _STRIP.format("x")
    + """), lambda x: x <> ''), chr(10)) AS content FROM u""",
    "chunk_oversize": r"""WITH RECURSIVE d AS (SELECT DISTINCT document_id, content FROM source_documents WHERE content IS NOT NULL AND content <> ''),
        big AS (SELECT document_id, string_split(content, chr(10) || chr(10)) AS ps FROM d WHERE length(content) > 6000),
        fold AS (SELECT document_id, ps, 1::BIGINT AS i, ''::VARCHAR AS now, []::VARCHAR[] AS done FROM big
            UNION ALL SELECT document_id, ps, i + 1,
                CASE WHEN length(CASE WHEN now <> '' THEN now || chr(10) || chr(10) || ps[i] ELSE ps[i] END) <= 6000 THEN CASE WHEN now <> '' THEN now || chr(10) || chr(10) || ps[i] ELSE ps[i] END WHEN length(ps[i]) <= 6000 THEN ps[i] ELSE '' END,
                CASE WHEN length(CASE WHEN now <> '' THEN now || chr(10) || chr(10) || ps[i] ELSE ps[i] END) <= 6000 THEN done
                    WHEN length(ps[i]) <= 6000 THEN list_concat(done, [now])
                    ELSE list_concat(CASE WHEN now <> '' THEN list_concat(done, [now]) ELSE done END, list_transform(range(ceil(length(ps[i]) / 6000)::BIGINT), lambda k: substr(ps[i], k * 6000 + 1, 6000))) END
            FROM fold WHERE i <= len(ps)),
        pieces AS (SELECT document_id, CASE WHEN now <> '' THEN list_concat(done, [now]) ELSE done END AS l FROM fold WHERE i = len(ps) + 1 UNION ALL SELECT document_id, [content] FROM d WHERE length(content) <= 6000),
        rows_ AS (SELECT document_id, unnest(range(len(l))) AS k, l FROM pieces)
        SELECT document_id, k::INT AS chunk_index, length(l[k + 1])::INT AS char_count, md5(l[k + 1]) AS text_md5 FROM rows_ WHERE l[k + 1] <> ''""",
}

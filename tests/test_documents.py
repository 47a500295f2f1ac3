import io
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodeweave.functions import inline_citations, sentences, strip, tokens
from lodeweave.operators import chunking, compliance, dedup
from lodeweave.providers import Refused, TooManyRequests, calling, deterministic_embedding, embed_text
from lodeweave.sources import docx_text, format_of, gutters, html_chain, html_text, load_documents, page_texts, safe_name, table_text, xlsx_text


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, content string")


def test_windows(spark):
    got = chunking.chunk_fixed(docs(spark, "".join(chr(97 + i % 26) for i in range(1000))), 300, 50).orderBy("chunk_index").collect()
    assert len(got) == 4 and len(got[0].text) == 300 and got[0].text[-50:] == got[1].text[:50] and len({r.chunk_id for r in got}) == 4
    assert [r.chunk_index for r in chunking.chunk_fixed(docs(spark, "x" * 250), 100, 0).orderBy("chunk_index").collect()] == [0, 1, 2]
    assert chunking.chunk_fixed(docs(spark, None, "")).count() == 0
    with pytest.raises(ValueError):
        chunking.sliding_window(F.col("x"), 100, 100)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n#", max_size=60), max_size=4), st.integers(5, 30), st.integers(0, 4))
def test_windows_cover(spark, texts, size, overlap):
    got = chunking.chunk_fixed(docs(spark, *texts), size, overlap).collect() if texts else []
    for i, t in enumerate(texts):
        parts = [r.text for r in sorted((r for r in got if r.document_id == f"d{i}"), key=lambda r: r.chunk_index)]
        assert "".join(p[: size - overlap] for p in parts) == t


def test_recursive(spark):
    text = "before\n# One \nbody 1\n\n## Two\n\n### Empty\n" + "y" * 700
    got = chunking.chunk_recursive(docs(spark, text, "plain", "# only", None)).orderBy("document_id", "chunk_index").collect()
    assert [(r.document_id, r.chunk_index, r.heading, len(r.text)) for r in got] == [("d0", 0, None, 6), ("d0", 1, "One", 6), ("d0", 2, "Empty", 500), ("d0", 3, "Empty", 350), ("d1", 0, None, 5)]


def test_paragraph_packing(spark):
    text = "a" * 40 + "\n\n" + "b" * 40 + "\n\n" + "c" * 250 + "\n\n" + "d" * 10
    got = docs(spark, text).select(chunking.pack_paragraphs(F.col("content"), 100)).first()[0]
    assert got == ["a" * 40 + "\n\n" + "b" * 40, "c" * 100, "c" * 100, "c" * 50, "d" * 10]


def test_semantic(spark):
    embed = lambda c: F.when(F.contains(c, F.lit("cat")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    got = chunking.chunk_semantic(docs(spark, "A cat sat. The cat ran! Bonds fell? Rates rose. One cat.", ""), embed).orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["A cat sat. The cat ran!", "Bonds fell? Rates rose.", "One cat."]


def test_clauses(spark):
    text = "lost\nArticle 5\nLead\n1. First:\n(a) item\n2. Second\nSection 164.502\nRule text\nChapter II\n3. Third\nArticle 17a\nwhole"
    got = [(r.article, r.section, r.clause, r.text) for r in compliance.parse_clauses(docs(spark, text)).orderBy("ord").collect()]
    assert got == [
        ("5", None, "5.1", "Article 5\nLead\n1. First:\n(a) item"), ("5", None, "5.2", "2. Second"), (None, "164.502", None, "Section 164.502\nRule text"),
        (None, "164.502", "3", "Chapter II\n3. Third"), ("17a", None, None, "Article 17a\nwhole"),
    ]
    (whole,) = compliance.parse_clauses(docs(spark, " no heading ", None, " ")).collect()
    assert whole.text == "no heading" and whole.confidence == 0.0 and whole.fallback
    chunks = compliance.chunk_clauses(docs(spark, text)).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in chunks] == list(range(5)) and chunks[0].heading == "5"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Ab_1 é\n", "One. Two!  Three", "see [d10] and [d2] [d2] [x]")], "a string, b string, c string")
    r = df.select(strip(F.col("a")), tokens(F.col("a")), sentences(F.col("b")), inline_citations(F.col("c"))).first()
    assert r[0] == "Ab_1 é" and r[1] == ["ab_1"] and r[2] == ["One.", "Two!", "Three"] and r[3] == ["d2", "d10"]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    assert docx_text(zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>T</w:t></w:r><w:r><w:t>wo</w:t></w:r></w:p></w:body></w:document>"})) == "One\nTwo"
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = {
        "xl/workbook.xml": f'<workbook {s} {r}><sheets><sheet name="People" r:id="a"/><sheet name="None" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {s}><si><t>name</t></si><si><t>age</t></si><si><t>Alice</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="B2"><v>30</v></c></row><row><c r="B3"><v>7</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {s}><sheetData/></worksheet>",
    }
    assert xlsx_text(zipped(book)) == "Sheet: People\nname: Alice, age: 30\nname: None, age: 7"


def test_loading_isolates_failures(spark):
    files = [("x/a.md", b"# Hi"), ("b.csv", b"name,age\nAlice,30\nBob\n"), ("c.html", b"<script>var a;</script><h1>T</h1><p>body &amp; more</p>"), ("d.pdf", b"no pdf"), ("e.exe", b""), ("f.txt", b"a\x00b"), ("g.docx", b"PK\x03\x04broken"), ("..", b""), ("h.TXT", b"ok"), ("i.txt", b"\xff\xfe")]
    got = {r.source_path: r for r in load_documents(spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")).collect()}
    assert got["x/a.md"].content == "# Hi" and got["x/a.md"].format == "markdown" and len(got["x/a.md"].document_id) == 64
    assert got["b.csv"].content == "name: Alice, age: 30\nname: Bob, age: None" and got["c.html"].content == "T\nbody & more" and got["h.TXT"].content == "ok"
    assert {p for p, r in got.items() if r.status == "failed"} == {"d.pdf", "e.exe", "f.txt", "g.docx", "..", "i.txt"} and all(r.error for r in got.values() if r.status == "failed")


def test_html_chain_equals_the_parser(spark):
    pages = ["<!doctype html><p>a &lt; b</p><!-- no --><style>x</style><div> c </div>", "<h1>A&nbsp;B</h1>", "plain"]
    got = spark.createDataFrame([(p,) for p in pages], "p string").select(html_chain(F.col("p"))).collect()
    assert [r[0].replace(" ", " ") for r in got] == [html_text(p).replace(" ", " ") for p in pages]


def test_names(spark):
    r = spark.createDataFrame([("../../x.MD",), ("a/",), ("..",), ("noext",)], "p string").select(safe_name(F.col("p")), format_of(F.col("p"))).collect()
    assert [tuple(x) for x in r] == [("x.MD", "markdown"), ("a", None), (None, None), ("noext", None)]


def test_pages(spark):
    words = [(1, 600.0, 10.0 + (i % 3), 200.0, i, f"l{i}") for i in range(15)] + [(1, 600.0, 350.0, 500.0, i, f"r{i}") for i in range(15)] + [(2, 600.0, 10.0, 590.0, i, f"w{i}") for i in range(30)] + [(3, 600.0, 1.0, 2.0, 0, "few")]
    df = spark.createDataFrame(words, "page_id int, width double, x0 double, x1 double, top int, word string")
    g = {r.page_id: r.gutter for r in gutters(df).collect()}
    assert g[1] == 210.0 and g[2] is None and g[3] is None
    t = {r.page_id: r.text for r in page_texts(df).collect()}
    assert t[1].split("\n") == [f"l{i}" for i in range(15)] + [f"r{i}" for i in range(15)]
    assert spark.range(1).select(table_text(F.array(F.array(F.lit("a"), F.lit(None).cast("string")), F.array(F.lit("b"), F.lit("c"))))).first()[0] == "a | \nb | c"


def test_dedup_needs_both(spark):
    rows = [("n1", "d", 0, "same words here", [1.0, 0.0]), ("n2", "d", 1, "same words here!", [1.0, 0.0]), ("n3", "d", 2, "quite another", [1.0, 0.01]), ("n4", "e", 0, "same words here", [0.0, 1.0])]
    new = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, embedding array<float>")
    store = spark.createDataFrame([("s", "z", 0, "quite anothe", [1.0, 0.0])], new.schema)
    assert {r.chunk_id for r in dedup.similar_to_store(new, store).collect()} == {"n3"}
    assert {r.chunk_id for r in dedup.repeats_within(new).collect()} == {"n2"}
    assert {r.chunk_id for r in dedup.survivors(new, store).collect()} == {"n1", "n4"}


def test_dedup_within_each_model(spark):
    rows = [("n1", "d", 0, "same words here", "v1", [1.0, 0.0]), ("n1", "d", 0, "same words here", "v2", [1.0, 0.0]), ("n2", "e", 0, "same words here", "v2", [0.0, 1.0]), ("n3", "e", 1, "same words here", "v2", [0.0, 1.0]), ("n4", "f", 0, "another text", "v1", [0.0, 1.0])]
    new = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, text string, model string, embedding array<float>")
    store = spark.createDataFrame([("s", "z", 0, "same words here", "v2", [1.0, 0.0]), ("t", "z", 1, "another text", "v2", [0.0, 1.0])], new.schema)
    assert [tuple(r) for r in dedup.similar_to_store(new, store, model_col="model").collect()] == [("n1", "s")]
    assert {r.chunk_id for r in dedup.survivors(new, store, model_col="model").collect()} == {"n2", "n4"}
    assert dedup.survivors(new.limit(0), store, model_col="model").count() == 0


def test_dedup_survivors_takes_vectors_of_every_model(spark, tmp_path):
    from lodeweave.plans.documents import dedup_survivors

    e = [1.0] + [0.0] * 63
    chunks = [("c00000014", "d", 0, "held by the second model alone"), ("c00000028", "d", 1, "held by the second model alone"), ("c0000003c", "d", 2, "held by the first")]
    late = F.lit("2024-01-01").cast("timestamp")
    held = spark.createDataFrame(chunks, "chunk_id string, document_id string, chunk_index int, text string")
    held.select("*", F.lit(None).cast("string").alias("heading"), F.lit(None).cast("struct<a:int>").alias("legal_metadata"), late.alias("ingested_at")).write.parquet(f"{tmp_path}/chunks.parquet")
    vectors = [("c00000014", e, "embed-compact-v2"), ("c00000028", e, "embed-compact-v2"), ("c0000003c", e, "embed-compact-v1")]
    spark.createDataFrame(vectors, "chunk_id string, embedding array<float>, embedding_model string").withColumn("created_at", late).write.parquet(f"{tmp_path}/embedding_records.parquet")
    assert {r.chunk_id for r in dedup_survivors(spark, str(tmp_path)).collect()} == {"c00000014", "c0000003c"}


def test_providers(spark):
    assert embed_text("ab") == [0.0] * 8 and sum(x * x for x in embed_text("abcdef")) == pytest.approx(1)
    df = spark.createDataFrame([("hello",), (None,)], "t string")
    assert [len(r[0]) for r in df.select(deterministic_embedding("t")).collect()] == [8, 8]

    def client(texts, state={"n": 0}):
        state["n"] += 1
        if state["n"] == 1:
            raise TooManyRequests
        if any(len(t) > 300 for t in texts):
            raise Refused
        return [[float(len(t))] for t in texts]

    made = calling(client, sleep=lambda s: None)
    got = spark.createDataFrame([("x" * 1000,), ("y",)], "t string").coalesce(1).select(made(F.col("t"))).collect()
    assert [r[0] for r in got] == [[250.0], [1.0]]

"""Loaders by file type, validation, names."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basename, content_hash, suffix
from ..functions.udf import lazy_pandas_udf

#: File types, the first bytes that binary ones must have, and those that must hold no zero byte.
FORMATS = {".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".txt": "text", ".pdf": "pdf", ".csv": "csv", ".xlsx": "xlsx", ".docx": "docx"}
MAGIC = {"pdf": [b"%PDF-"], "docx": [b"PK\x03\x04", b"PK\x05\x06"], "xlsx": [b"PK\x03\x04", b"PK\x05\x06"]}
TEXTS = ["markdown", "html", "text", "csv"]
MAX_BYTES = 20 * 1024 * 1024


class _Text(HTMLParser):
    """The text nodes of a page, stripped, without those of scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_text(page: str | None) -> str:
    p = _Text()
    p.feed(page or "")
    p.close()
    return "\n".join(p.parts)


def csv_text(text: str | None) -> str:
    """Every row as `name: value, name: value`; missing cells print None, cells beyond the header are left out."""
    rows = csv.DictReader(io.StringIO(text or ""))
    return "\n".join(", ".join(f"{k}: {v}" for k, v in r.items() if k is not None) for r in rows)


def _cells(row: ElementTree.Element, ns: str, strings: list[str]) -> list[object]:
    out: list[object] = []
    for c in row.iter(f"{ns}c"):
        letters = re.match(r"[A-Z]+", c.get("r", "")) or None
        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters.group()))) - 1 if letters else len(out)
        out += [None] * (at - len(out))
        v = c.find(f"{ns}v")
        kind = c.get("t")
        if kind == "inlineStr":
            out.append("".join(t.text or "" for t in c.iter(f"{ns}t")))
        elif v is None or v.text is None:
            out.append(None)
        else:
            out.append(strings[int(v.text)] if kind == "s" else v.text)
    return out


def xlsx_text(data: bytes) -> str:
    """Sheets that have rows, each as `Sheet: name` and a line `header: value, ...` per row, parted by blank lines."""
    ns, rel = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        parts = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{ns}sheet"):
            path = targets[sheet.get(rel)].lstrip("/")
            rows = [_cells(r, ns, strings) for r in ElementTree.fromstring(z.read(path if path.startswith("xl/") else f"xl/{path}")).iter(f"{ns}row")]
            if rows:
                lines = [", ".join(f"{h}: {v}" for h, v in zip(rows[0], [*r, *[None] * len(rows[0])], strict=False)) for r in rows[1:]]
                parts.append("\n".join([f"Sheet: {sheet.get('name')}", *lines]))
    return "\n\n".join(parts)


def docx_text(data: bytes) -> str:
    """Paragraphs that are not blank, one per line."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{ns}t")) for p in body.iter(f"{ns}p")]
    return "\n".join(x for x in lines if x.strip())


def pdf_text(data: bytes) -> str:
    """By an installed PDF library; without one an error, which becomes the file's state."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF library is installed; load extracted pages instead") from e
    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def load_bytes(name: str, data: bytes) -> str:
    kind = FORMATS.get("." + name.rsplit(".", 1)[-1].lower() if "." in name else "")
    if kind is None:
        raise ValueError(f"unsupported file type; known are {', '.join(sorted(FORMATS))}")
    if kind in ("xlsx", "docx", "pdf"):
        return {"xlsx": xlsx_text, "docx": docx_text, "pdf": pdf_text}[kind](data)
    text = data.decode("utf-8")
    return html_text(text) if kind == "html" else csv_text(text) if kind == "csv" else text


@lazy_pandas_udf("content string, error string")
def loaded(name: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Content of a file, or why it can't be read."""
    out = []
    for n, d in zip(name, data, strict=True):
        try:
            out.append((load_bytes(n, bytes(d)), None))
        except Exception as e:  # noqa: BLE001 - one bad file is that file's state
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["content", "error"])


def format_of(path: Column) -> Column:
    """Format by suffix; null for unknown ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix(path))


def safe_name(path: Column) -> Column:
    """Last part of a path; null for names that come to nothing (empty, `.`, `..`)."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(~name.isin("", ".", ".."), name)


def upload_problem(path: Column, data: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is refused; null if it isn't."""
    kind = format_of(path)
    out = F.when(safe_name(path).isNull(), "invalid file name").when(kind.isNull(), "unsupported file type").when(F.octet_length(data) > max_bytes, "file too large")
    for name, starts in MAGIC.items():
        begins = F.lit(False)
        for s in starts:
            begins = begins | (F.substring(data, 1, len(s)) == F.lit(s))
        out = out.when((kind == name) & ~begins, "content does not match the file type")
    return out.when(kind.isin(TEXTS) & F.contains(data, F.unhex(F.lit("00"))), "text file holds zero bytes")


def load_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(source_path, format, document_id, content, status, error) of (path, content bytes) rows; a bad file fails alone."""
    problem = upload_problem(F.col("path"), F.col("content"), max_bytes)
    rows = files.select(F.col("path").alias("source_path"), format_of(F.col("path")).alias("format"), problem.alias("_p"), F.col("content").alias("_c"))
    got = rows.withColumn("_l", F.when(F.col("_p").isNull(), loaded(basename(F.col("source_path")), F.col("_c"))))
    error = F.coalesce("_p", "_l.error")
    return got.select("source_path", "format", content_hash(F.col("_l.content")).alias("document_id"), F.col("_l.content").alias("content"), F.when(error.isNull(), "ready").otherwise("failed").alias("status"), error.alias("error"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content bytes) of all files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, document_id, content) of UTF-8 text files, without Python."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_path"), content_hash(F.col("value")).alias("document_id"), F.col("value").alias("content"))


def html_chain(page: Column) -> Column:
    """Text of simple pages by replacements alone: no scripts, styles, comments and tags; common entities; stripped lines."""
    c = page
    for pattern, new in ((r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"(?s)<!--.*?-->", ""), (r"(?i)<!doctype[^>]*>", ""), (r"(?s)<[^>]*>", "\n")):
        c = F.regexp_replace(c, pattern, new)
    #: Entities, the ampersand last.
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("#39", "'"), ("middot", "·"), ("copy", "©"), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(sign))
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def rendered_rows(df: DataFrame, columns: list[str], group: list[str], order: list[str]) -> DataFrame:
    """One text per group of `name: value` lines in the given order; nulls print None."""
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns])
    lines = F.transform(F.sort_array(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"])
    return df.groupBy(*group).agg(F.array_join(lines, "\n").alias("content"))


def stored_row(df: DataFrame, texts: list[str], numbers: list[str]) -> DataFrame:
    """A row of a store without nulls: empty strings and -1 become null again."""
    return df.select(*[F.nullif(c, F.lit("")).alias(c) if c in texts else F.nullif(c, F.lit(-1)).alias(c) if c in numbers else F.col(c) for c in df.columns])

"""Files and pages as rows of text and meta. Executors parse what Spark's readers bring, so any store works."""

from __future__ import annotations

import csv
import io
import json
import re
import urllib.error
import urllib.request
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import DocumentLoadError
from siftwell.functions import text as tx

SCHEMA = "path string, text string, format string, meta map<string,string>, data string, error string"
#: Extensions that a directory is searched for.
EXTENSIONS = (".pdf", ".docx", ".doc", ".xlsx", ".xls", ".json", ".md", ".txt")
FORMATS = {".pdf": "pdf", ".docx": "word", ".doc": "word", ".xlsx": "excel", ".xls": "excel", ".pptx": "slides", ".json": "json", ".md": "markdown", ".markdown": "markdown", ".txt": "text", ".text": "text"}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def word_text(raw: bytes) -> str:
    """Paragraphs of a .docx file."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
    lines = []
    for p in (e for e in root.iter() if _tag(e) == "p"):
        lines.append("".join((e.text or "") if _tag(e) == "t" else "\t" if _tag(e) == "tab" else "\n" if _tag(e) == "br" else "" for e in p.iter()))
    return "\n\n".join(lines)


def excel_sheets(raw: bytes) -> dict[str, list[list[str]]]:
    """Cells of every sheet of an .xlsx file, as text."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
    links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in (e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"):
        target = links[next(v for k, v in s.attrib.items() if k.endswith("}id"))].lstrip("/")
        rows: list[list[str]] = []
        for row in (e for e in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if _tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in (e for e in row if _tag(e) == "c"):
                letters = re.match("[A-Z]+", c.get("r", "A"))[0]
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                cells[at - 1] = shared[int(value)] if c.get("t") == "s" else value
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        out[s.get("name")] = rows
    return out


_PDF_STREAM = re.compile(rb"<<(?P<head>(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.S)
_PDF_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|-?\d+\.?\d*|T\*|Tj|TJ|Td|TD|Tm|ET|BT|['\"\[\]]|/?[A-Za-z]+", re.S)
#: Escapes in a PDF's texts.
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][:1] in b"\r\n" else _PDF_ESCAPES.get(m[1], m[1])
        raw = re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def pdf_text(raw: bytes) -> str:
    """The texts that a PDF's content streams show, a line for each move to a new line.

    For plain and deflated streams and fonts with one byte a character, as most simple files have; pass a library
    as ``parsers={"pdf": ...}`` for others (embedded subsets with their own codes, encryption, object streams).
    """
    if not raw.startswith(b"%PDF"):
        raise DocumentLoadError.parsing_error("pdf", "it does not begin like a PDF")
    if b"/Encrypt" in raw:
        raise DocumentLoadError.dependency_missing("pdf", "a parser for encrypted files")
    pages = []
    for m in _PDF_STREAM.finditer(raw):
        body = m["body"]
        if b"FlateDecode" in m["head"]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body or b"/Image" in m["head"]:
            continue
        lines, held, numbers = [""], [], []
        for token in _PDF_SHOWN.findall(body):
            if token[:1] in b"(<":
                held.append(_pdf_string(token))
            elif re.fullmatch(rb"-?\d+\.?\d*", token):
                numbers.append(float(token))
                if held and numbers[-1] < -200:  # a wide gap within an array of shown texts
                    held.append(" ")
            elif token in (b"[", b"]"):
                continue
            else:
                if token in (b"'", b'"', b"T*") or token in (b"Td", b"TD") and len(numbers) > 1 and numbers[-1] or token == b"Tm":
                    lines.append("")
                if token in (b"Tj", b"TJ", b"'", b'"'):
                    lines[-1] += "".join(held)
                held, numbers = [], []
        pages.append("\n".join(line for line in lines if line))
    return "\n\n".join(p for p in pages if p)


def slides_text(raw: bytes) -> str:
    """The paragraphs of a .pptx file's slides, in order of their numbers."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    paragraphs = lambda n: (p for p in ET.fromstring(z.read(n)).iter() if _tag(p) == "p")
    lines = ("\n".join("".join(e.text or "" for e in p.iter() if _tag(e) == "t") for p in paragraphs(n)) for _, n in slides)
    return "\n\n".join(lines)


def _csv(rows: list[list[str]]) -> str:
    buffer = io.StringIO()
    csv.writer(buffer, lineterminator="\n").writerows(rows)
    return buffer.getvalue()


def js_text(value: object) -> str:
    """A JSON value as JavaScript's ``String`` shows it."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, list):
        return ",".join("" if x is None else js_text(x) for x in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def parse(path: str, raw: bytes, *, encoding: str = "utf-8", text_field: str | None = None, strip: bool = False, sheet: str | None = None, all_sheets: bool = False, parsers: dict[str, Callable[[bytes], str]] | None = None) -> dict:
    """One file's row. ``parsers`` adds or replaces formats (a PDF library, say)."""
    ext = m[0].lower() if (m := re.search(r"\.[^./]+$", path)) else ""
    kind, meta, data = FORMATS.get(ext, "text"), {"fileName": path.rpartition("/")[2], "filePath": path}, None
    if parsers and kind in parsers:
        text = parsers[kind](raw)
    elif kind == "pdf":
        text = pdf_text(raw)
    elif kind == "word":
        text = word_text(raw)
    elif kind == "slides":
        text = slides_text(raw)
    elif kind == "excel":
        sheets = excel_sheets(raw)
        meta["sheetNames"] = ",".join(sheets)
        data = json.dumps({n: [dict(zip(r[0], x, strict=False)) for x in r[1:]] if r else [] for n, r in sheets.items()})
        text = "".join(f"\n\n=== Sheet: {n} ===\n{_csv(r)}" for n, r in sheets.items()) if all_sheets else _csv(sheets[sheet or next(iter(sheets))])
        text = text.strip()
    else:
        text = raw.decode(encoding)
        if kind == "json":
            value = json.loads(text)
            data, field = text, value.get(text_field) if text_field and isinstance(value, dict) else None
            text = js_text(field) if field else json.dumps(value, indent=2, ensure_ascii=False)
        elif kind == "markdown" and strip:
            for pattern, to in tx.MARKDOWN_STEPS:
                text = re.sub(pattern, to.replace("$1", r"\1"), text)
        elif kind == "text":
            meta["encoding"] = encoding
    return {"path": path, "text": text, "format": kind, "meta": meta | {"format": kind}, "data": data, "error": None}


def parse_files(files: DataFrame, *, keep_errors: bool = False, meta: dict[str, str] | None = None, **options) -> DataFrame:
    """Rows of files given as ``path, content``; files that cannot be read are left out (or kept with ``error``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(parse(p, raw, **options))
                except Exception as e:  # noqa: BLE001  any broken file is one row's error
                    rows.append({"path": p, "text": None, "format": None, "meta": {}, "data": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "text", "format", "meta", "data", "error"])

    rows = files.select("path", "content").mapInPandas(run, SCHEMA)
    if meta:
        rows = rows.withColumn("meta", F.map_concat(F.map_filter("meta", lambda k, v: ~k.isin(list(meta))), F.create_map(*[F.lit(x) for kv in meta.items() for x in kv])))
    return rows if keep_errors else rows.where("error IS NULL")


def load(spark: SparkSession, path: str, *, recursive: bool = False, extensions: tuple[str, ...] | None = None, **options) -> DataFrame:
    """``parse_files`` of the file or the files under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    if extensions:
        files = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*extensions))
    return parse_files(files, **options)


def load_directory(spark: SparkSession, path: str, *, recursive: bool = False, extensions: tuple[str, ...] = EXTENSIONS, **options) -> DataFrame:
    return load(spark, path, recursive=recursive, extensions=extensions, **options)


def load_pages(pages: DataFrame, *, content_type: Column | None = None, extract_text: bool = True, fetch: Callable[[str], str] | None = None) -> DataFrame:
    """``url, html`` to ``url, text, meta``. With ``fetch`` the html comes from the url, and failed pages are left out."""
    if fetch:

        @F.pandas_udf("string")
        def get(urls: pd.Series) -> pd.Series:
            def one(u):
                try:
                    return fetch(u)
                except Exception:  # noqa: BLE001
                    return None

            return urls.map(one)

        pages = pages.withColumn("html", get("url")).where("html IS NOT NULL")
    kind = content_type if content_type is not None else F.lit("text/html")
    text = F.when(kind.contains("text/html") & F.lit(extract_text), tx.html_to_text(F.col("html"))).otherwise(F.col("html"))
    return pages.select("url", text.alias("text"), F.create_map(F.lit("url"), F.col("url"), F.lit("contentType"), kind, F.lit("format"), F.lit("url")).alias("meta"))


FETCHED = "url string, status int, content_type string, html string, loaded_at timestamp, error string"


def fetch_pages(urls: DataFrame, *, headers: dict[str, str] | None = None, timeout: float = 30.0, concurrency: int = 4) -> DataFrame:
    """``url, status, content_type, html, loaded_at, error`` by HTTP GET; any status outside 200 to 299 is an error.

    Each task works off its urls with ``concurrency`` requests at a time. Failures are rows, not exceptions.
    """

    def one(url: str) -> tuple:
        now = pd.Timestamp.now(tz="UTC").tz_localize(None)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout) as r:
                charset = r.headers.get_content_charset() or "utf-8"
                return url, r.status, r.headers.get("Content-Type", ""), r.read().decode(charset, "replace"), now, None
        except urllib.error.HTTPError as e:
            return url, e.code, e.headers.get("Content-Type", ""), None, now, f"HTTP {e.code}"
        except Exception as e:  # noqa: BLE001  a url that cannot be read is one row's error
            return url, None, None, None, now, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                yield pd.DataFrame([*pool.map(one, pdf["url"])], columns=["url", "status", "content_type", "html", "loaded_at", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, FETCHED)


def load_urls(urls: DataFrame, *, extract_text: bool = True, keep_errors: bool = False, **options) -> DataFrame:
    """``url, text, meta`` of each ``url`` that can be read (or all, with ``error``); only HTML is turned into text."""
    got = fetch_pages(urls, **options)
    html = F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)) & F.lit(extract_text)
    text = F.when(html, tx.html_to_text(F.col("html"))).otherwise(F.col("html"))
    meta = F.create_map(F.lit("url"), F.col("url"), F.lit("contentType"), F.col("content_type"), F.lit("format"), F.lit("url"), F.lit("loadedAt"), F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    rows = got.select("url", text.alias("text"), meta.alias("meta"), "error")
    return rows if keep_errors else rows.where("error IS NULL").drop("error")


def load_sitemap(maps: DataFrame, xml: str = "xml") -> DataFrame:
    return maps.select(F.explode(tx.sitemap_locs(F.col(xml))).alias("url"))

"""Text, Word, HTML and glossary files as DataFrames, and the matching writers.

Binary formats are parsed in Arrow batches; everything after the paragraph is SQL.
"""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docbraid.functions.text import doc_type
from docbraid.operators.blocks import text_blocks

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_HYPERLINK, _P, _T = f"{_W}hyperlink", f"{_W}p", f"{_W}t"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
GLOSSARY = "source string, target string, doNotTranslate boolean, caseSensitive boolean, notes string"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GLOSSARY).csv(path, header=True)


def read_glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """(ord, source, target) of a JSON list of pairs; a malformed file gives no rows."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "array<struct<source:string,target:string>>")
    return raw.select(F.posexplode(F.coalesce(pairs, F.expr("CAST(array() AS array<struct<source:string,target:string>>)"))).alias("ord", "p")).select("ord", "p.source", "p.target")


def _own_text(paragraph: ElementTree.Element) -> list[tuple[ElementTree.Element, bool]]:
    """Text nodes of a paragraph, insertions and links included, those of nested paragraphs not; and whether each is in a link."""
    out, todo = [], [(child, False) for child in reversed(list(paragraph))]
    while todo:
        node, linked = todo.pop()
        if node.tag == _P:
            continue
        if node.tag == _T:
            out.append((node, linked))
        inside = linked or node.tag == _HYPERLINK
        todo.extend((child, inside) for child in reversed(list(node)))
    return out


def _paragraphs(root: ElementTree.Element, nested: bool = False) -> list[ElementTree.Element]:
    """Paragraphs outside tables first, then those of tables, each in order."""
    body = root.find(f"{_W}body")
    body = root if body is None else body
    plain, tables = [], []
    for child in body:
        if child.tag == _P:
            plain += list(child.iter(_P)) if nested else [child]
        elif child.tag == f"{_W}tbl":
            tables += [p for cell in child.iter(f"{_W}tc") for p in cell.findall(_P)]
    return plain + tables


def _parts(archive: zipfile.ZipFile) -> list[str]:
    names = archive.namelist()
    edge = lambda kind: sorted(n for n in names if n.startswith(f"word/{kind}") and n.endswith(".xml"))
    return [n for n in ["word/document.xml"] if n in names] + edge("header") + edge("footer")


def docx_paragraphs(content: bytes, nested: bool = False) -> list[str]:
    """Non-blank paragraph texts: body, tables, headers, footers. A broken file has none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            roots = [ElementTree.fromstring(archive.read(n)) for n in _parts(archive)]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return []
    texts = ["".join(t.text or "" for t, _ in _own_text(p)) for root in roots for p in _paragraphs(root, nested)]
    return [t for t in texts if t.strip()]


def docx_replaced(content: bytes, texts: list[str]) -> bytes:
    """The file with the non-blank paragraphs' texts replaced in order; layout and links stay.

    A paragraph's new text goes into its first text node outside a link (else the
    first), the others become empty.
    """
    new = iter(texts)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as archive, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        done = {}
        for name in _parts(archive):
            root = ElementTree.fromstring(archive.read(name))
            for p in _paragraphs(root):
                nodes = _own_text(p)
                if not "".join(t.text or "" for t, _ in nodes).strip():
                    continue
                carrier = next((t for t, linked in nodes if not linked), nodes[0][0])
                for t, _ in nodes:
                    t.text = ""
                carrier.text = next(new)
                carrier.set(_SPACE, "preserve")
            done[name] = ElementTree.tostring(root, xml_declaration=True, encoding="UTF-8")
        for name in archive.namelist():
            target.writestr(name, done.get(name, archive.read(name)))
    return out.getvalue()


def docx_blocks(files: DataFrame, nested: bool = False) -> DataFrame:
    """(path, ord, text): paragraphs of Word files in a (path, content) table."""

    @F.arrow_udf("array<string>")
    def paragraphs(contents: pa.Array) -> pa.Array:
        return pa.array([docx_paragraphs(c, nested) if c else [] for c in contents.to_pylist()], pa.list_(pa.string()))

    return files.select("path", F.posexplode(paragraphs("content")).alias("ord", "text"))


class _Blocks(HTMLParser):
    """Top-level blocks of an HTML page; tolerant of unclosed tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.kind, self.level, self.text = "paragraph", None, []
        self.skip = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.out.append({"type": self.kind, "level": self.level, "text": text, "cells": None})
        self.kind, self.level, self.text = "paragraph", None, []

    def end_cell(self) -> None:
        if self.cell is not None and self.rows is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in ("script", "style", "head", "template"):
            self.skip += 1
        elif self.rows is not None and tag in ("tr", "td", "th"):
            self.end_cell()
            if tag == "tr":
                self.rows.append([])
            else:
                self.cell = []
        elif tag == "table":
            self.flush()
            self.rows = []
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "li":
            self.flush()
            self.kind = "list_item"
        elif tag == "img":
            self.flush()
            self.out.append({"type": "figure", "level": None, "text": "", "cells": None})
        elif tag in ("p", "div", "ul", "ol", "nav", "article", "section", "body", "blockquote", "pre", "footer", "header", "main"):
            self.flush()
        elif tag == "br":
            (self.cell if self.cell is not None else self.text).append(" ")

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in ("script", "style", "head", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            rows = [r for r in self.rows if r]
            if rows:
                self.out.append({"type": "table", "level": None, "text": "", "cells": rows})
            self.rows = None
        elif tag in ("td", "th"):
            self.end_cell()
        elif tag in ("p", "li", "div", "ul", "ol", "nav", "article", "section", "body", "blockquote", "pre") or (len(tag) == 2 and tag[0] == "h"):
            self.flush()

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if not self.skip:
            (self.cell if self.cell is not None else self.text).append(data)


def html_page_blocks(page: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.out


def html_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(doc_id, ord, block_id, type, level, text, cells, page): headings, paragraphs, list items, tables and figures."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.list_(pa.string())))]))

    @F.arrow_udf("array<struct<type:string,level:int,text:string,cells:array<array<string>>>>")
    def blocks(column: pa.Array) -> pa.Array:
        return pa.array([html_page_blocks(x) for x in column.to_pylist()], kind)

    rows = pages.select(F.col(page_id).alias("doc_id"), F.posexplode(blocks(html)).alias("ord", "b"))
    cells = F.transform("b.cells", lambda row: F.transform(row, lambda c: F.struct(c.alias("text"))))
    return rows.select("doc_id", "ord", F.concat(F.lit("b"), "ord").alias("block_id"), "b.type", "b.level", "b.text", cells.alias("cells"), F.lit(1).alias("page"))


def extract(files: DataFrame) -> DataFrame:
    """(path, ord, text, type) of a (path, content) table, by the files' types. PDF is not read here: those rows give nothing."""
    typed = files.withColumn("kind", doc_type(F.col("path"), F.lit(None).cast("string")))
    text = text_blocks(typed.filter("kind = 'TXT'").select("path", F.decode("content", "UTF-8").alias("text")), doc_id="path")
    word = docx_blocks(typed.filter("kind = 'DOCX'"))
    return text.select(F.col("doc_id").alias("path"), "ord", "text", "type").unionByName(word.select("path", "ord", "text", F.lit("paragraph").alias("type")))


def write_texts(rows: DataFrame, path: str, joiner: str = "\n\n") -> None:
    """One row a document, its chunks in order apart by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "translated")))
    rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["translated"]), joiner).alias("text")).write.mode("overwrite").parquet(path)


def write_docx(files: DataFrame, translated: DataFrame, folder: str) -> DataFrame:
    """Writes each Word file with its translated paragraphs; returns (path, bytes written). One task holds one file at a time."""
    ordered = translated.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = docx_replaced(row["content"], row["texts"])
                with open(os.path.join(folder, os.path.basename(row["path"])), "wb") as f:
                    f.write(data)
                yield pa.RecordBatch.from_pydict({"path": [row["path"]], "bytes": pa.array([len(data)], pa.int64())})

    return files.join(ordered, "path").mapInArrow(run, "path string, bytes long")


class ObjectStore:
    """Raw and processed bytes under one folder; keys cannot leave it."""

    def __init__(self, root: str) -> None:
        self.root = os.path.realpath(root)

    def path(self, key: str) -> str:
        full = os.path.realpath(os.path.join(self.root, key))
        if not full.startswith(self.root + os.sep):
            raise ValueError(f"key {key!r} leaves the store")
        return full

    def put(self, key: str, data: bytes) -> str:
        full = self.path(key)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(data)
        return key

    def get(self, key: str) -> bytes:
        with open(self.path(key), "rb") as f:
            return f.read()

    def exists(self, key: str) -> bool:
        return os.path.exists(self.path(key))

    def delete(self, key: str) -> None:
        if self.exists(key):
            os.remove(self.path(key))

    def presign(self, key: str, seconds: int = 900) -> str:
        raise NotImplementedError("a local store has no links")


def write_progress(path: str, done: int, total: int) -> None:
    with open(path, "w") as f:
        json.dump({"done": done, "total": total}, f)

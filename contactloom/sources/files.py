"""Scans of files of many formats: text, delimited, HTML, archives and office files.

Files come in as (path, content) by the binaryFile reader and leave as text
units: one row for each page, cell, line block or member.  PDF pages and OCR
text are inputs here, tables of (doc, page, text); nothing decodes PDF.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = "path string, member string, kind string, unit string, text string, error string"
#: Limits of archives: members, bytes of a member, levels, ratio.
MEMBERS, MEMBER_BYTES, DEPTH, RATIO = 1000, 100 << 20, 3, 5000
DENIED = re.compile(r"\.(exe|dll|bat|cmd|js|vbs|scr|msi|com|jar)$", re.I)
TEXT = {"txt", "md", "log", "csv", "tsv", "json", "jsonl", "htm", "html", "xml", "rtf", ""}


def suffix_kind(path: Column) -> Column:
    """Kind of a source by scheme or suffix."""
    s = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]{1,5})$", 1))
    return (
        F.when(F.regexp_like(path, F.lit("(?i)^https?://")), "url")
        .when(s == "pdf", "pdf")
        .when(s == "docx", "docx")
        .when(s == "xlsx", "xlsx")
        .when(s.isin("csv", "tsv"), "csv")
        .when(s == "zip", "zip")
        .when(s.isin("html", "htm"), "html")
        .otherwise("text")
    )


def source_ref(ref: Column) -> Column:
    """Struct of kind, path, member, page, sheet and cell of a source reference."""
    none = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.coalesce(none(F.regexp_extract(ref, "^([a-z]+):", 1)), F.lit("file")).alias("kind"),
        F.regexp_extract(ref, "^(?:[a-z]+:)?([^|#!]*)", 1).alias("path"),
        none(F.regexp_extract(ref, "\\|([^#!]*)", 1)).alias("member"),
        none(F.regexp_extract(ref, "#page=([0-9]+)", 1)).cast("int").alias("page"),
        none(F.regexp_extract(ref, "!([^:!]*):", 1)).alias("sheet"),
        none(F.regexp_extract(ref, "![^:!]*:([A-Z]+[0-9]+)", 1)).alias("cell"),
    )


def decode_bytes(data: bytes, declared: str | None = None) -> str:
    """Declared encoding, then UTF-8, then cp1251, then latin-1."""
    for enc in filter(None, (declared, "utf-8", "cp1251")):
        try:
            return data.decode(enc)
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_pages(data: bytes) -> list[str]:
    """Text of a DOCX, cut at page breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    pages, now = [], []
    for e in root.iter():
        name = _local(e.tag)
        if name == "t":
            now.append(e.text or "")
        elif name in ("p", "tab", "cr"):
            now.append("\n" if name != "tab" else " ")
        elif name == "lastRenderedPageBreak" or (name == "br" and any(_local(k) == "type" and v == "page" for k, v in e.attrib.items())):
            pages.append("".join(now).strip())
            now = []
        elif name == "br":
            now.append("\n")
    return [*pages, "".join(now).strip()]


def xlsx_cells(data: bytes) -> list[tuple[str, str]]:
    """(sheet!cell, text) of the cells of an XLSX."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        titles, target = {}, {}
        if "xl/_rels/workbook.xml.rels" in names:
            for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
                path = e.get("Target", "")
                target[e.get("Id")] = path[1:] if path.startswith("/") else f"xl/{path}"
        if "xl/workbook.xml" in names:
            sheets = [e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
            for i, e in enumerate(sheets):
                # a sheet's file is named by its relation; without relations they are taken in order
                rel = next((v for k, v in e.attrib.items() if _local(k) == "id" and k != "id"), None)
                titles[target.get(rel, f"xl/worksheets/sheet{i + 1}.xml")] = e.get("name", f"sheet{i + 1}")
        out = []
        for n in sorted(x for x in names if x.startswith("xl/worksheets/") and x.endswith(".xml")):
            for c in ElementTree.fromstring(z.read(n)).iter():
                if _local(c.tag) != "c":
                    continue
                v = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                if c.get("t") == "s" and v.isdigit() and int(v) < len(shared):
                    v = shared[int(v)]
                if v:
                    out.append((f"{titles.get(n, n.rsplit('/', 1)[-1][:-4])}!{c.get('r', '')}", v))
        return out


def odt_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    return "\n".join("".join(e.itertext()) for e in root.iter() if _local(e.tag) in ("p", "h"))


def pptx_text(data: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted(n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n))
        return ["\n".join(e.text or "" for e in ElementTree.fromstring(z.read(n)).iter() if _local(e.tag) == "t") for n in slides]


def rtf_text(data: bytes) -> str:
    raw = data.decode("latin-1")
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1251", "replace"), raw)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]", "", re.sub(r"\\par(?![a-z]) ?", "\n", raw))


def units(path: str, data: bytes, member: str = "", depth: int = 0):
    """(member, kind, unit, text, error) of a file; a failure is a row, not an exception."""
    name = member.rsplit("|", 1)[-1] or path
    ext = name.rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else ""
    try:
        if ext == "docx":
            for i, t in enumerate(docx_pages(data)):
                yield member, "docx", f"#page={i + 1}", t, None
        elif ext == "xlsx":
            for cell, t in xlsx_cells(data):
                yield member, "xlsx", f"!{cell}", t, None
        elif ext == "pptx":
            for i, t in enumerate(pptx_text(data)):
                yield member, "pptx", f"#page={i + 1}", t, None
        elif ext == "odt":
            yield member, "odt", "", odt_text(data), None
        elif ext == "rtf":
            yield member, "rtf", "", rtf_text(data), None
        elif ext == "zip":
            if depth >= DEPTH:
                yield member, "zip", "", None, "too_deep"
                return
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for k, info in enumerate(i for i in z.infolist() if not i.is_dir()):
                    inner = f"{member}|{info.filename}" if member else info.filename
                    why = (
                        "too_many" if k >= MEMBERS
                        else "encrypted" if info.flag_bits & 1
                        else "unsafe_path" if info.filename.startswith("/") or ".." in info.filename.split("/")
                        else "denied_suffix" if DENIED.search(info.filename)
                        else "too_large" if info.file_size > MEMBER_BYTES
                        else "bomb_ratio" if info.file_size > RATIO * max(1, info.compress_size)
                        else None
                    )
                    if why:
                        yield inner, "zip", "", None, why
                    else:
                        yield from units(path, z.read(info), inner, depth + 1)
        elif ext in TEXT:
            yield member, {"htm": "html"}.get(ext, ext or "text"), "", decode_bytes(data), None
        else:
            yield member, ext, "", None, "unsupported"
    except Exception as e:  # noqa: BLE001  a bad file becomes a row with its error
        yield member, ext, "", None, type(e).__name__


def extract_units(files: DataFrame) -> DataFrame:
    """Text units of (path, content) rows; archives are opened up to DEPTH levels."""

    def run(batches):
        for b in batches:
            rows = [(p, *u) for p, c in zip(b["path"], b["content"], strict=True) for u in units(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "member", "kind", "unit", "text", "error"])

    return files.select("path", "content").mapInPandas(run, UNITS)


def read_units(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    return extract_units(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder))

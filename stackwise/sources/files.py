"""Document files: which parser reads them, and the parsers, as Arrow functions over binary content."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from stackwise.functions import text as T
from stackwise.session import ship
from stackwise.sources.html import html_document

MOST_UNPACKED = 256 << 20
RESULT = "title string, text string, error string"


def read_folder(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """path, content of the accepted files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).where(T.accepted(F.col("path"))).select("path", "content")


def decode_text(raw: bytes) -> str:
    """UTF-8 without its mark; GB18030 where that has over eight replacement characters, if it decodes."""
    text = raw.decode("utf-8-sig", "replace")
    if text.count("�") > 8:
        try:
            return raw.decode("gb18030")
        except UnicodeDecodeError:
            pass
    return text


def unpacked(raw: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(raw))
    if sum(i.file_size for i in z.infolist()) > MOST_UNPACKED:
        raise ValueError("the archive unpacks to more than 256 MiB")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(xml: bytes, paragraph: str = "p", run: str = "t") -> str:
    lines = []
    for p in ElementTree.fromstring(xml).iter():
        if _local(p.tag) == paragraph:
            lines.append("".join(x.text or "" for x in p.iter() if _local(x.tag) == run))
    return "\n".join(lines)


def parse_docx(raw: bytes) -> str:
    with unpacked(raw) as z:
        text = _runs(z.read("word/document.xml")).strip()
    if not text:
        raise ValueError("the document has no text")
    return text


def parse_pptx(raw: bytes) -> str:
    """Text runs of each slide, slides in the order of their numbers."""
    with unpacked(raw) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        slides = ["".join(x.text or "" for x in ElementTree.fromstring(z.read(n)).iter() if _local(x.tag) == "t") for _, n in names]
    return "\n\n".join(s for s in slides if s.strip())


def parse_xlsx(raw: bytes) -> str:
    """Cells tab-joined, rows on lines, blank rows dropped."""
    with unpacked(raw) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si.tag) == "si"]
        sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        lines = []
        for _, n in sheets:
            for row in (x for x in ElementTree.fromstring(z.read(n)).iter() if _local(x.tag) == "row"):
                cells = []
                for c in (x for x in row if _local(x.tag) == "c"):
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.get("t")
                    if kind == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    cells.append(value)
                if any(c.strip() for c in cells):
                    lines.append("\t".join(cells))
    return "\n".join(lines)


def parse_epub(raw: bytes) -> str:
    """The (x)html entries but navigation, contents and cover."""
    with unpacked(raw) as z:
        names = [n for n in z.namelist() if re.search(r"\.x?html?$", n, re.I) and not re.search(r"(nav|toc|cover)", n.rpartition("/")[2], re.I)]
        parts = [html_document(decode_text(z.read(n)))[1] for n in names]
    return "\n\n".join(p for p in parts if p)


_STREAM = re.compile(rb"<<((?:[^<>]|<[^<]|>[^>]|<<(?:[^<>]|<[^<]|>[^>])*>>)*)>>\s*stream\r?\n")
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?[0-9.]+|[A-Za-z'\"*]+|/[^\s/<>\[\]()]+", re.S)
_ESCAPED = re.compile(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)")
# The escapes of a string, and the operators that begin a new line.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_LINE_OPERATORS = frozenset({b"Td", b"TD", b"T*", b"Tm", b"'", b'"', b"BT"})


def _pdf_string(raw: bytes) -> str:
    if raw.startswith(b"("):
        raw = _ESCAPED.sub(lambda m: _ESCAPES.get(m[1], m[1] if m[1] in b"()\\" else b"" if m[1].endswith(b"\n") else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw[1:-1])
    else:
        digits = re.sub(rb"\s", b"", raw[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def pdf_lines(content: bytes) -> list[str]:
    """The lines of text that a page's content shows."""
    lines, line, args, inside = [], [], [], False
    for m in _SHOWN.finditer(content):
        x = m[0]
        if x[:1] in b"(<":
            args.append(_pdf_string(x))
        elif x[:1] in b"-.0123456789":
            # a wide gap inside an array of strings is a space
            if inside and args and float(x) < -200 and not args[-1].endswith(" "):
                args.append(" ")
        elif x in (b"[", b"]"):
            inside = x == b"["
        elif not x.startswith(b"/"):
            if x in _LINE_OPERATORS and line:
                lines.append("".join(line))
                line = []
            if x in (b"Tj", b"TJ", b"'", b'"'):
                line += args
            args = []
    return lines + (["".join(line)] if line else [])


def parse_pdf(raw: bytes) -> str:
    """The text layer of plain and Flate content streams in Latin or UTF-16 codes; fonts with codes of their own, pictures and encrypted files have none, and are for a text recogniser."""
    if not raw.startswith(b"%PDF") or b"/Encrypt" in raw:
        raise ValueError("no readable text layer")
    lines: list[str] = []
    for m in _STREAM.finditer(raw):
        end = raw.find(b"endstream", m.end())
        body = raw[m.end() : end if end >= 0 else len(raw)]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body, MOST_UNPACKED)
            except zlib.error:
                continue
        elif b"/Filter" in m[1]:
            continue
        if b"BT" in body and b"/Subtype" not in m[1]:
            lines += pdf_lines(body)
    text = "\n".join(x for x in lines if x.strip())
    if not text:
        raise ValueError("no text layer: the pages are for a text recogniser")
    return text


def parse(kind: str, raw: bytes) -> tuple[str, str]:
    """(title, text)."""
    if kind == "html":
        return html_document(decode_text(raw))
    readers = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "epub": parse_epub, "pdf": parse_pdf}
    if kind in readers:
        return "", readers[kind](raw)
    if kind == "text":
        return "", decode_text(raw)
    raise ValueError(f"no parser for {kind} here")


def parsed(files: DataFrame, name_col: str = "path", mime_col: str | None = None) -> DataFrame:
    """files (name, content) with parser, title, text and error; a file that cannot be read has an error and not a failed job."""
    ship(files.sparkSession)

    @F.pandas_udf(RESULT)
    def run(kind: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for k, raw in zip(kind, content):
            try:
                title, text = parse(k, bytes(raw or b""))
                out.append((title, text, None))
            except Exception as e:  # one unreadable file must not stop the others
                out.append((None, None, f"parse_failed: {e}"))
        return pd.DataFrame(out, columns=["title", "text", "error"])

    kind = T.parser_of(F.col(name_col), F.col(mime_col) if mime_col else F.lit(None).cast("string"))
    return files.withColumn("parser", kind).withColumn("_r", run("parser", "content")).select(*files.columns, "parser", "_r.*")

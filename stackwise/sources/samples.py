"""Small files of the kinds that the parsers read, made from lines of text: for checks of the readers."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from html import escape


def packed(entries: dict[str, str], claimed: int = 0) -> bytes:
    """A zip archive; ``claimed`` is put down as the unpacked size of its last entry, if it is set."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name), text)
    raw = bytearray(out.getvalue())
    if claimed:
        # the unpacked size is 24 bytes into the entry of the central directory
        struct.pack_into("<I", raw, raw.rindex(b"PK\x01\x02") + 24, claimed)
    return bytes(raw)


def docx(lines: list[str], claimed: int = 0) -> bytes:
    body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
    return packed({"word/document.xml": f"<w:document xmlns:w='w'><w:body>{body}</w:body></w:document>"}, claimed)


def pptx(lines: list[str]) -> bytes:
    """A slide a line, more than nine of them where there are so many lines."""
    return packed({f"ppt/slides/slide{i + 1}.xml": f"<s xmlns:a='a'><a:t>{escape(x)}</a:t></s>" for i, x in enumerate(lines)})


def xlsx(lines: list[str]) -> bytes:
    """A row a line and a cell a word: the first word shared, the others inline."""
    shared, rows = [], []
    for x in lines:
        cells = []
        for k, word in enumerate(x.split(" ")):
            if k:
                cells.append(f"<c t='inlineStr'><is><t>{escape(word)}</t></is></c>")
            else:
                cells.append(f"<c t='s'><v>{len(shared)}</v></c>")
                shared.append(f"<si><t>{escape(word)}</t></si>")
        rows.append(f"<row>{''.join(cells)}</row>")
    return packed({"xl/sharedStrings.xml": f"<sst>{''.join(shared)}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>"})


def epub(lines: list[str]) -> bytes:
    return packed({"nav.xhtml": "<p>Contents</p>", "text/one.xhtml": "<html><body>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</body></html>"})


def pdf(lines: list[str]) -> bytes:
    """One page of lines, its content compressed, its text in a font of UTF-16 codes."""
    shown = "".join(f"<FEFF{x.encode('utf-16-be').hex()}> Tj 0 -14 Td\n" for x in lines)
    content = zlib.compress(f"BT /F1 12 Tf 72 720 Td\n{shown}ET".encode())
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(content) + content + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, p) for i, p in enumerate(parts)) + b"trailer << /Root 1 0 R >>\n%%EOF"

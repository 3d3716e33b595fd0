"""Markdown blocks as a word-processor file (Office Open XML)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from evidentia.operators.markdown import parse

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPES = f"""<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>"""
RELS = f"""<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{REL}/officeDocument" Target="word/document.xml"/></Relationships>"""
INLINE_RE = re.compile(r"\*\*(.+?)\*\*|\*(.+?)\*|`(.+?)`")
#: Half points of titles and of headings by level; twentieths of a point of a quote's indent (4 cm).
SIZES, INDENT = (36, 32, 28, 26, 24, 24, 24), 2268


def runs(text: str, size: int | None = None, bold: bool = False) -> str:
    """Runs of a text; **bold**, *italic* and `code` are formats."""
    out, at = [], 0
    spans = [(m.start(), m.end(), m) for m in INLINE_RE.finditer(text)]
    for start, end, m in [*spans, (len(text), len(text), None)]:
        if start > at:
            out.append((text[at:start], ""))
        if m:
            k = next(i for i in (1, 2, 3) if m[i] is not None)
            out.append((m[k], ("<w:b/>", "<w:i/>", '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>')[k - 1]))
        at = end
    more = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
    return "".join(f'<w:r><w:rPr>{f}{more}</w:rPr><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t, f in out)


def _paragraph(content: str, layout: str = "") -> str:
    return f"<w:p><w:pPr>{layout}</w:pPr>{content}</w:p>"


def _body(title: str, text: str) -> Iterator[str]:
    even = '<w:jc w:val="both"/>'
    for kind, level, said, cells in parse(text, title):
        if kind in ("title", "heading"):
            yield _paragraph(runs(said, SIZES[level], True), f'<w:keepNext/><w:outlineLvl w:val="{max(0, level - 1)}"/>')
        elif kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(runs(c, bold=not k))}</w:tc>" for c in row) + "</w:tr>" for k, row in enumerate(cells))
            lines = "".join(f'<w:{x} w:val="single" w:sz="4"/>' for x in ("top", "left", "bottom", "right", "insideH", "insideV"))
            yield f"<w:tbl><w:tblPr><w:tblBorders>{lines}</w:tblBorders></w:tblPr>{rows}</w:tbl>{_paragraph('')}"
        elif kind == "bullet":
            yield _paragraph(runs("• " + said), f'<w:ind w:left="360" w:hanging="360"/>{even}')
        elif kind == "quote":
            yield _paragraph(runs(said, 20), f'<w:ind w:left="{INDENT}"/>{even}')
        else:
            yield _paragraph(runs(said), f'<w:spacing w:line="360" w:after="120"/>{even}')


def docx_bytes(title: str, text: str) -> bytes:
    """The file; equal texts give equal bytes."""
    body = "".join(_body(title, text))
    document = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name), part, zipfile.ZIP_DEFLATED)
    return out.getvalue()

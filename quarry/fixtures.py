"""Files made from tables, for queries over sources and sinks: JSON lines, text files and office files."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def folder(spark: SparkSession) -> str:
    """A new folder's path: in the one that driver and executors share, or a temporary one in a session on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/quarry/files-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="quarry-files-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"{own}/files"


def _packed(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


def _rels(**targets: str) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{k}" Target="{v}"/>' for k, v in targets.items()) + "</Relationships>"


def docx(paragraphs: list[str], rows: list[list[str]]) -> bytes:
    """Paragraphs, then a table."""
    p = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in row) + "</w:tr>" for row in rows)
    return _packed({"word/document.xml": f"<w:document {_W}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{table}</w:tbl></w:body></w:document>"})


def pptx(slides: list[str]) -> bytes:
    """A text box on each slide."""
    body = lambda t: f"<p:sld {_P}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>"
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="r{i}"/>' for i in range(1, len(slides) + 1))
    parts = {"ppt/presentation.xml": f"<p:presentation {_P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": _rels(**{f"r{i}": f"slides/slide{i}.xml" for i in range(1, len(slides) + 1)})}
    return _packed(parts | {f"ppt/slides/slide{i}.xml": body(t) for i, t in enumerate(slides, 1)})


def xlsx(name: str, rows: list[list[object]]) -> bytes:
    """One sheet; numbers as numbers, all else as inline strings."""
    cell = lambda v: f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    data = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows)
    return _packed({
        "xl/workbook.xml": f'<workbook {_S}><sheets><sheet name="{name}" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels(r1="worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{data}</sheetData></worksheet>",
    })


def office_files(items: DataFrame) -> DataFrame:
    """(path, relative_path, file_name, extension, content): by item_id a DOCX, PPTX, XLSX, text or, as no reader opens it, PDF file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["item_id"], pdf["text"], strict=True):
                i, text = int(i), text or ""
                kind = (".docx", ".pptx", ".xlsx", ".md", ".pdf")[i % 5]
                content = {
                    ".docx": lambda: docx([text, ""], [[str(i), "cell"]]),
                    ".pptx": lambda: pptx([text]),
                    ".xlsx": lambda: xlsx("Items", [[i, text], ["", ""]]),
                    ".md": lambda: text.encode() + b"\xff",
                    ".pdf": lambda: b"%PDF",
                }[kind]()
                rows.append((f"/in/{kind[1:]}/{i}{kind}", f"{kind[1:]}/{i}{kind}", f"{i}{kind}", kind, content))
            yield pd.DataFrame(rows, columns=["path", "relative_path", "file_name", "extension", "content"])

    return items.select("item_id", "text").mapInPandas(run, "path string, relative_path string, file_name string, extension string, content binary")

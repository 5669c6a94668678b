"""Office documents as a corpus: discovery, per-format readers, error isolation, statistics.

Readers take bytes and return (text, units, method).  DOCX, PPTX and XLSX are
read with the standard library; PDF, OCR and XLS by ``optional_readers``, where
the workers have their libraries, or by a plug-in; without either each such file becomes an error row.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_blank

# The suffixes that are read.
SUPPORTED = (".pdf", ".docx", ".pptx", ".xlsx", ".xlsm", ".xls", ".txt", ".md")

Parts = tuple[str, int, str]
Reader = Callable[[bytes], Parts]

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_text(data: bytes) -> Parts:
    """UTF-8 without invalid bytes, universal line ends; one unit."""
    return re.sub("\r\n?", "\n", data.decode("utf-8", "ignore")), 1, "native"


def _run(r: ET.Element) -> str:
    """A run's own text; breaks of pages and columns have none."""
    out = []
    for e in r:
        if e.tag == _W + "t":
            out.append(e.text or "")
        elif e.tag in (_W + "tab", _W + "ptab"):
            out.append("\t")
        elif e.tag == _W + "noBreakHyphen":
            out.append("-")
        elif e.tag == _W + "cr" or (e.tag == _W + "br" and e.get(_W + "type", "textWrapping") == "textWrapping"):
            out.append("\n")
    return "".join(out)


def _paragraph(p: ET.Element) -> str:
    """The text of a paragraph's runs and of its links' runs: not of text boxes, insertions or deletions."""
    runs = [r for e in p for r in (e.findall(_W + "r") if e.tag == _W + "hyperlink" else [e] if e.tag == _W + "r" else [])]
    return "".join(map(_run, runs))


def _number(e: ET.Element | None, path: str, default: int) -> int:
    found = None if e is None else e.find(path)
    return default if found is None else int(found.get(_W + "val", default))


def _grid(tbl: ET.Element) -> Iterator[list[str]]:
    """A table's rows by grid column: a cell that spans columns or rows stands in each of them."""
    above: dict[int, str] = {}
    for tr in tbl.findall(_W + "tr"):
        at, row, here = _number(tr.find(_W + "trPr"), _W + "gridBefore", 0), [], {}
        for tc in tr.findall(_W + "tc"):
            props = tc.find(_W + "tcPr")
            merge = None if props is None else props.find(_W + "vMerge")
            text = "\n".join(_paragraph(p) for p in tc.findall(_W + "p"))
            if merge is not None and merge.get(_W + "val", "continue") == "continue":
                text = above.get(at, text)
            for _ in range(_number(props, _W + "gridSpan", 1)):
                here[at] = text
                row.append(text)
                at += 1
        above = here
        yield row


def read_docx(data: bytes) -> Parts:
    """Paragraphs that aren't empty, then tables row by row; units count all body paragraphs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
    paragraphs = [_paragraph(p) for p in body.findall(_W + "p")]
    parts = [p.strip() for p in paragraphs if p.strip()]
    for i, tbl in enumerate(body.findall(_W + "tbl"), 1):
        parts.append(f"[TABLE {i}]")
        parts += [" | ".join(c.strip().replace("\n", " ") for c in row) for row in _grid(tbl)]
    return "\n".join(parts), len(paragraphs), "native"


def _related(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    rels = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))) if not r.get("Target").startswith("/") else r.get("Target")[1:] for r in rels}


def read_pptx(data: bytes) -> Parts:
    """Each slide's marker and the text of its top-level shapes."""
    parts = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = _related(z, "ppt/presentation.xml")
        ids = ET.fromstring(z.read("ppt/presentation.xml")).find(_P + "sldIdLst")
        slides = [rels[s.get(_R + "id")] for s in (ids if ids is not None else [])]
        for i, slide in enumerate(slides, 1):
            parts.append(f"[SLIDE {i}]")
            tree = ET.fromstring(z.read(slide)).find(f"{_P}cSld/{_P}spTree")
            for shape in tree.findall(_P + "sp"):
                body = shape.find(_P + "txBody")
                if body is not None:
                    text = "\n".join("".join(map(_slide_text, p)) for p in body.findall(_A + "p"))
                    if text.strip():
                        parts.append(text.strip())
    return "\n".join(parts), len(slides), "native"


def _slide_text(e: ET.Element) -> str:
    """Text of a run or field; a line break within a paragraph is a vertical tab."""
    if e.tag == _A + "br":
        return "\v"
    t = e.find(_A + "t") if e.tag in (_A + "r", _A + "fld") else None
    return "" if t is None else t.text or ""


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


# The built-in number formats that show dates or times, and the one that shows a duration.
_DATE_FORMATS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47)
_DURATION_FORMATS = (46,)


def _temporal(code: str) -> str | None:
    """'duration', 'date' or None for what a number format shows, quoted and bracketed parts aside."""
    if re.search(r"\[(?:h+|m+|s+)\]", code, re.IGNORECASE):
        return "duration"
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|[\\_*].', "", code.split(";")[0])
    return "date" if re.search("[dmhys]", bare, re.IGNORECASE) else None


def _styles(z: zipfile.ZipFile) -> list[str | None]:
    """By cell style, whether its numbers are dates or durations."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ET.fromstring(z.read("xl/styles.xml"))
    kinds = {**dict.fromkeys(_DATE_FORMATS, "date"), **dict.fromkeys(_DURATION_FORMATS, "duration")}
    kinds |= {int(f.get("numFmtId")): _temporal(f.get("formatCode", "")) for f in root.iter(_S + "numFmt")}
    return [kinds.get(int(x.get("numFmtId", "0"))) for x in root.findall(f"{_S}cellXfs/{_S}xf")]


def _moment(days: float, epoch: datetime, kind: str) -> str:
    """A serial number of days as date and time, as a time of day below 1, or as a duration."""
    if kind == "duration":
        return str(timedelta(milliseconds=round(days * 86_400_000)))
    whole, part = divmod(days, 1)
    of_day = timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= days < 1 and of_day < timedelta(days=1):
        return str((datetime.min + of_day).time())
    if 0 < days < 60 and epoch.year < 1904:  # the calendar of these files has a 29 February 1900
        whole += 1
    return str(epoch + timedelta(days=whole) + of_day)


def _cell(c: ET.Element, shared: list[str], styles: list[str | None], epoch: datetime) -> str:
    kind, v = c.get("t", "n"), c.find(_S + "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(_S + "t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind == "d":
        return str(datetime.fromisoformat(v.text))
    if kind == "n":
        x, style = float(v.text), int(c.get("s", "0"))
        if style < len(styles) and styles[style]:
            return _moment(x, epoch, styles[style])
        return str(int(v.text)) if re.fullmatch("[+-]?[0-9]+", v.text) else str(x)
    return v.text


def read_xlsx(data: bytes) -> Parts:
    """Each sheet's marker and its rows that aren't blank, as wide as the sheet says it is; units are those rows."""
    parts, units = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared, styles = [], _styles(z)
        if "xl/sharedStrings.xml" in z.namelist():
            # A string's own text and its runs', not its pronunciation.
            shared = ["".join(t.text or "" for t in (*si.findall(_S + "t"), *si.findall(f"{_S}r/{_S}t"))) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(_S + "si")]
        book, rels = ET.fromstring(z.read("xl/workbook.xml")), _related(z, "xl/workbook.xml")
        props = book.find(_S + "workbookPr")
        epoch = datetime(1904, 1, 1) if props is not None and props.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        for sheet in book.find(_S + "sheets"):
            parts.append(f"[SHEET: {sheet.get('name')}]")
            root = ET.fromstring(z.read(rels[sheet.get(_R + "id")]))
            size = root.find(_S + "dimension")
            width = _column(size.get("ref").rpartition(":")[2]) + 1 if size is not None and size.get("ref") else None
            for row in root.iter(_S + "row"):
                values: list[str] = []
                for c in row.findall(_S + "c"):
                    at = _column(c.get("r", "")) if c.get("r") else len(values)
                    values += [""] * (at - len(values)) + [_cell(c, shared, styles, epoch)]
                if width:
                    values = (values + [""] * (width - len(values)))[:width]
                if any(v.strip() for v in values):
                    parts.append(" | ".join(values))
                    units += 1
    return "\n".join(parts), units, "native"


READERS: dict[str, Reader] = {".txt": read_text, ".md": read_text, ".docx": read_docx, ".pptx": read_pptx, ".xlsx": read_xlsx, ".xlsm": read_xlsx}


def framed_pages(pages: list[str]) -> str:
    return "\n\n".join(f"[PAGE {i}]\n{p}" for i, p in enumerate(pages, 1))


def needs_ocr(text: str, pages: int) -> bool:
    return len(text.strip()) < max(100, 40 * pages)


def _cleaned(text: str) -> str:
    """What ``clean_text`` gives, for lengths that are compared before it."""
    return re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", text.replace("\0", " "))).strip()


def pdf_reader(native: Callable[[bytes], list[str]], ocr: Callable[[bytes], list[str]] | None = None) -> Reader:
    """A PDF reader from page extractors: OCR where the native text is thin, and only if its text is longer."""

    def read(data: bytes) -> Parts:
        pages = native(data)
        text = _cleaned(framed_pages(pages))
        if ocr is not None and needs_ocr(text, len(pages)):
            seen = ocr(data)
            other = _cleaned(framed_pages(seen))
            if len(other) > len(text):
                return other, len(seen), "ocr"
        return text, len(pages), "native"

    return read


def _pdf_pages(data: bytes) -> list[str]:
    from pypdf import PdfReader

    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(data)).pages]


def _ocr_pages(languages: str) -> Callable[[bytes], list[str]]:
    def read(data: bytes) -> list[str]:
        import fitz
        import pytesseract
        from PIL import Image

        with fitz.open(stream=data, filetype="pdf") as document:
            scans = (page.get_pixmap(matrix=fitz.Matrix(2, 2), alpha=False).tobytes("png") for page in document)
            return [pytesseract.image_to_string(Image.open(io.BytesIO(scan)), lang=languages) for scan in scans]

    return read


def _read_xls(data: bytes) -> Parts:
    """As ``read_xlsx``, through pandas, whose column types decide how numbers look."""
    parts, units = [], 0
    for name, sheet in pd.read_excel(io.BytesIO(data), sheet_name=None, header=None, engine="xlrd").items():
        parts.append(f"[SHEET: {name}]")
        rows = [["" if pd.isna(v) else str(v) for v in row] for row in sheet.itertuples(index=False, name=None)]
        parts += [" | ".join(row) for row in rows if any(v.strip() for v in row)]
        units += sum(any(v.strip() for v in row) for row in rows)
    return "\n".join(parts), units, "native"


def optional_readers(ocr: bool = False, languages: str = "rus+eng") -> dict[str, Reader]:
    """Readers of PDF and XLS files by libraries that workers may have (pypdf; PyMuPDF and pytesseract; xlrd); a file fails where they don't."""
    return {".pdf": pdf_reader(_pdf_pages, _ocr_pages(languages) if ocr else None), ".xls": _read_xls}


#: Larger files than a row can hold become error rows.
LARGEST = (1 << 31) - 1


def discovered(spark: SparkSession, root: str, most: int | None = None, largest: int = LARGEST) -> DataFrame:
    """(path, relative_path, file_name, extension, content) of supported files under ``root``, the first ``most`` by path parts.

    Files are chosen by their names alone; only what is chosen is read.  The
    content of files over ``largest`` bytes is null.
    """
    fold = lambda suffix: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    reader = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(map(fold, SUPPORTED)) + "}")
    # Both as plain paths: listing may add or drop a scheme.
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    base = re.sub("^[a-z]+:/+", "/", root).rstrip("/")
    relative = F.substring(plain(F.col("path")), len(base) + 2, 1 << 20)
    all_ = reader().option("recursiveFileLookup", "true").load(root)
    files = all_
    if most is not None:
        # At most ``most`` paths come to the driver: the step's own limit.
        paths = [r["path"] for r in all_.select("path").orderBy(F.split(relative, "/")).limit(most).collect()]
        files = reader().load(paths) if paths else all_.limit(0)
    read = files.where(F.col("length") <= largest).select("path", "content")
    files = read.unionAll(files.where(F.col("length") > largest).select("path", F.lit(None).cast("binary")))
    name = F.element_at(F.split("relative_path", "/"), -1)
    files = files.withColumn("relative_path", relative).withColumns({"file_name": name, "extension": F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))})
    return files.where(F.col("extension").isin(*SUPPORTED)).select("path", "relative_path", "file_name", "extension", "content")


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """The corpus with ``error``: a file that can't be read is a row, not the end of the run."""
    known = READERS if readers is None else READERS | readers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data, ext in zip(pdf["content"], pdf["extension"], strict=True):
                try:
                    if data is None:
                        raise RuntimeError("the file is too large to read")
                    if ext not in known:
                        raise RuntimeError(f"no reader for {ext}")
                    rows.append((*known[ext](bytes(data)), None))
                except Exception as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            yield pdf.drop(columns=["path", "content"]).assign(**dict(zip(("raw", "units", "extraction_method", "error"), map(list, zip(*rows, strict=True)), strict=True)))

    ids = files.withColumn("document_id", F.sha2("content", 256))
    out = ids.mapInPandas(run, "relative_path string, file_name string, extension string, document_id string, raw string, units int, extraction_method string, error string")
    out = out.withColumn("text", clean_text(F.col("raw")))
    return out.select("document_id", "file_name", "relative_path", "extension", "extraction_method", "text", F.length("text").cast("long").alias("text_length"), "units", F.col("document_id").alias("sha256"), F.current_timestamp().alias("extracted_at"), "error")


def corpus_of(rows: DataFrame) -> DataFrame:
    """The documents with text."""
    return rows.where(F.col("error").isNull() & ~is_blank(F.col("text"))).drop("error")


def extraction_stats(rows: DataFrame) -> DataFrame:
    """One row of counts, with extensions of all attempted files and the errors."""
    ok = F.col("error").isNull()
    stats = rows.agg(
        F.count("*").alias("discovered"),
        F.count_if(ok & ~is_blank(F.col("text"))).alias("processed"),
        F.count_if(ok & is_blank(F.col("text"))).alias("empty"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("extraction_method") == "ocr").alias("ocr_documents"),
        F.collect_list(F.when(~ok, F.struct(F.col("relative_path").alias("file"), "error"))).alias("errors"),
    )
    kinds = rows.groupBy("extension").count().agg(F.map_from_entries(F.collect_list(F.struct("extension", "count"))).alias("extensions"))
    return stats.crossJoin(kinds)  # one row each

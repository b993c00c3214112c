"""Documents of many formats read into one long table of text blocks.

``spark.read.format("binaryFile")`` gives paths and bytes; an Arrow batch function parses each file into rows
of doc, block, text, location, kind, section, row and col.  Nothing opens a path itself, so inputs may
lie in any store that Spark reads.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = "doc string, block string, text string, location string, kind string, section int, row int, col int"
Block = tuple[str, str, str, str, int | None, int | None, int | None]

# The extensions a reader exists for, and XML namespaces of the office formats.
EXTENSIONS = ("txt", "csv", "xlsx", "xlsm", "docx", "pptx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: by byte-order mark, else UTF-8, else code page 932, else UTF-8 with marks for errors."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw.decode("utf-8-sig", "replace"), "utf-8-sig"
    for encoding in ("utf-8", "cp932"):
        try:
            return raw.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace"), "utf-8"


def newline(raw: bytes) -> str:
    return next((n.decode() for n in (b"\r\n", b"\n", b"\r") if n in raw), "\n")


def dialect(text: str) -> type[csv.Dialect] | csv.Dialect:
    sample = text[:8192]
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|")
    except csv.Error:
        return csv.excel_tab if "\t" in sample else csv.excel


MOST_CHARS = 3000
_SENTENCE = re.compile("[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+")
_NUMBERS = re.compile(r"[\d\s.,+\-()/%]*")


def sentence_chunks(text: str, limit: int = MOST_CHARS) -> list[str]:
    """Whole sentences in chunks of at most ``limit`` characters, stripped; longer sentences are cut."""
    out, held = [], ""
    for sentence in _SENTENCE.findall(text):
        for piece in (sentence[k : k + limit] for k in range(0, len(sentence), limit)):
            if held and len(held) + len(piece) > limit:
                out.append(held)
                held = ""
            held += piece
    return [x for x in (c.strip() for c in [*out, held]) if x]


def txt_blocks(raw: bytes) -> Iterator[Block]:
    """Paragraphs parted by blank lines, long ones in chunks; those of numbers alone are left out."""
    for i, part in enumerate(decode(raw)[0].replace("\r\n", "\n").split("\n\n")):
        text = part.strip()
        if not text or _NUMBERS.fullmatch(text):
            continue
        chunks = sentence_chunks(text) if len(text) > MOST_CHARS else [text]
        for j, chunk in enumerate(chunks):
            yield f"para_{i}_chunk_{j}" if len(chunks) > 1 else f"para_{i}", chunk, f"Paragraph {i + 1}", "paragraph", None, i, j


def csv_blocks(raw: bytes) -> Iterator[Block]:
    text = decode(raw)[0]
    for r, row in enumerate(csv.reader(io.StringIO(text, newline=""), dialect(text))):
        for c, cell in enumerate(row):
            if cell.strip():
                yield f"r{r}_c{c}", cell, f"Row {r + 1}, Col {c + 1}", "cell", None, r, c


def _column(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def xlsx_blocks(raw: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for i, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")):
            target = rels.get(sheet.get(f"{_R}id"), "").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part not in names:
                continue
            for cell in ElementTree.fromstring(z.read(part)).iter(f"{_S}c"):
                value, kind, ref = cell.find(f"{_S}v"), cell.get("t"), cell.get("r", "")
                if cell.find(f"{_S}f") is not None:
                    continue
                if kind == "s" and value is not None:
                    text = shared[int(value.text or 0)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                else:
                    continue
                at = re.fullmatch(r"([A-Z]+)(\d+)", ref)
                if text.strip() and at:
                    yield f"{sheet.get('name')}_{ref}", text, f"{sheet.get('name')}, {ref}", "cell", i, int(at[2]), _column(at[1])


def docx_blocks(raw: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    p = t = 0
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            text = "".join(x.text or "" for x in child.iter(f"{_W}t"))
            if text.strip():
                yield f"para_{p}", text, f"Paragraph {p + 1}", "paragraph", None, p, None
            p += 1
        elif child.tag == f"{_W}tbl":
            for r, row in enumerate(child.iter(f"{_W}tr")):
                for c, cell in enumerate(row.iter(f"{_W}tc")):
                    text = "\n".join("".join(x.text or "" for x in q.iter(f"{_W}t")) for q in cell.iter(f"{_W}p"))
                    if text.strip():
                        yield f"table_{t}_r{r}_c{c}", text, f"Table {t + 1}, row {r + 1}, column {c + 1}", "cell", t, r, c
            t += 1


def pptx_blocks(raw: bytes) -> Iterator[Block]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for i, (_, name) in enumerate(slides):
            for k, p in enumerate(ElementTree.fromstring(z.read(name)).iter(f"{_A}p")):
                text = "".join(x.text or "" for x in p.iter(f"{_A}t"))
                if text.strip():
                    yield f"s{i}_p{k}", text, f"Slide {i + 1}", "shape", i, k, None
            notes = name.replace("ppt/slides/slide", "ppt/notesSlides/notesSlide")
            if notes in z.namelist():
                for k, p in enumerate(ElementTree.fromstring(z.read(notes)).iter(f"{_A}p")):
                    text = "".join(x.text or "" for x in p.iter(f"{_A}t"))
                    if text.strip():
                        yield f"s{i}_notes_{k}", text, f"Slide {i + 1} notes", "notes", i, k, None


PARSERS: dict[str, Callable[[bytes], Iterator[Block]]] = {
    "txt": txt_blocks, "csv": csv_blocks, "xlsx": xlsx_blocks, "xlsm": xlsx_blocks, "docx": docx_blocks, "pptx": pptx_blocks,
}


def read_blocks(spark: SparkSession, path: str, sections: list[int] | None = None) -> DataFrame:
    """All blocks of the files under ``path``; ``sections`` keeps rows without a section and those listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    files = files.where(ext.isin(*EXTENSIONS)).select("path", ext.alias("ext"), "content")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in BLOCKS.split(", ")]
        for df in frames:
            for file, kind, content in zip(df["path"], df["ext"], df["content"], strict=True):
                try:
                    found = list(PARSERS[kind](bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, csv.Error) as e:  # one broken file is a row, not a failed job
                    found = [("error", f"{type(e).__name__}: {e}", "", "error", None, None, None)]
                rows = pd.DataFrame([(file, *b) for b in found], columns=names)
                yield rows.astype({"section": "Int32", "row": "Int32", "col": "Int32"})

    blocks = files.mapInPandas(parse, BLOCKS)
    return blocks if sections is None else blocks.where(F.col("section").isNull() | F.col("section").isin(sections))


def apply_translations(blocks: DataFrame, translations: DataFrame) -> DataFrame:
    """Blocks with their translation by (doc, block), the original where there is none."""
    joined = blocks.join(translations.select("doc", "block", F.col("text").alias("translated")), ["doc", "block"], "left")
    return joined.withColumn("is_fallback", F.coalesce(F.trim("translated"), F.lit("")) == "").withColumn(
        "translated", F.when(F.col("is_fallback"), F.col("text")).otherwise(F.col("translated"))
    )


def texts_of(blocks: DataFrame) -> DataFrame:
    """doc, value: each document from its translated paragraphs, chunks joined as they are, paragraphs by a blank line."""
    parts = blocks.groupBy("doc", "row").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("col", F.lit(0)).alias("k"), "translated"))).alias("x"))
    parts = parts.select("doc", "row", F.array_join(F.transform("x", lambda x: x["translated"]), "").alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("doc").agg(text.alias("value"))


def csv_of(cells: DataFrame, delimiter: str = ",", newline: str = "\n") -> DataFrame:
    """doc, value: each table from its cells (doc, row, col, translated), gaps empty, quoted where a cell needs it."""
    quoted = F.when(F.regexp_like("translated", F.lit(f'[{re.escape(delimiter)}"\r\n]')), F.concat(F.lit('"'), F.replace("translated", F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("translated"))
    held = cells.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", quoted.alias("t")))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("m"))), lambda c: F.coalesce(F.element_at("m", c), F.lit("")))
    lines = held.select("doc", "row", F.array_join(filled, delimiter).alias("line"))
    return lines.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), newline), F.lit(newline)).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """doc, value: a folder for each document (``doc=...``) that holds one file with its whole text."""
    documents.repartition("doc").write.mode("overwrite").partitionBy("doc").text(path, lineSep="\n")


def write_txt(blocks: DataFrame, path: str) -> None:
    write_documents(texts_of(blocks), path)

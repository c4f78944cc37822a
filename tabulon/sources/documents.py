"""Text of uploaded files, read in parallel from any store; formats that need a missing library give null."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word-processing name space and the file types of each reader.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = ("png", "jpg", "jpeg", "bmp", "tiff", "gif")


def docx_text(data: bytes) -> str | None:
    """Paragraph texts joined by line feeds; null for a broken file."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except Exception:
        return None
    return "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in root.iter(f"{W}p"))


def pdf_text(data: bytes) -> str | None:
    try:
        import pypdf
    except ImportError:
        return None
    try:
        return "".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
    except Exception:
        return None


def image_text(data: bytes) -> str | None:
    try:
        import pytesseract
        from PIL import Image
    except ImportError:
        return None
    try:
        return pytesseract.image_to_string(Image.open(io.BytesIO(data)))
    except Exception:
        return None


def readers() -> dict[str, Callable[[bytes], str | None]]:
    return {"pdf": pdf_text, "docx": docx_text} | dict.fromkeys(IMAGES, image_text)


def read_documents(spark: SparkSession, path: str, extra: dict[str, Callable[[bytes], str | None]] | None = None) -> DataFrame:
    """(filename, extracted_text) of all files at a path or glob; text is null for unknown types and unreadable files."""
    known = readers() | (extra or {})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            kinds = g.filename.str.lower().str.rsplit(".", n=1).str[-1]
            yield pd.DataFrame({"filename": g.filename, "extracted_text": [known[k](bytes(c)) if k in known else None for k, c in zip(kinds, g.content, strict=True)]})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")
    return files.mapInPandas(run, "filename string, extracted_text string")

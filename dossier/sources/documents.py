"""Documents as rows: text, DOCX and PDF files, inline text, standard input. Failures are data in an `error` column."""

from __future__ import annotations

import glob as globbing
import io
import os
import sys
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.sources import pdf

EXTENSIONS = (".pdf", ".docx", ".txt")
ENGINES = ("tesseract",)
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
EMPTY = {"pdf": "Could not extract text from PDF", "docx": "Could not extract text from DOCX"}

Extractor = Callable[[bytes, dict], str]


def file_format(path: Column) -> Column:
    """pdf, docx, or text for everything else."""
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "pdf").when(low.endswith(".docx"), "docx").otherwise("text")


def is_supported(path: str) -> bool:
    return path.lower().endswith(EXTENSIONS)


def discover(inputs: list[str], input_dir: str | None = None, pattern: str | None = None) -> list[str]:
    """Absolute paths, each once, sorted: named files whatever their extension, folders and patterns by extension."""
    found: set[str] = set()
    for path in inputs:
        if not os.path.exists(path):
            raise FileNotFoundError(f"Input path does not exist: {path}")
        found |= {os.path.abspath(path)} if os.path.isfile(path) else set(_below(path))
    if input_dir is not None:
        if not os.path.isdir(input_dir):
            raise NotADirectoryError(f"Input directory does not exist: {input_dir}")
        found |= set(_below(input_dir))
    if pattern:
        found |= {os.path.abspath(p) for p in globbing.glob(pattern, recursive=True) if os.path.isfile(p) and is_supported(p)}
    return sorted(found)


def _below(folder: str) -> Iterator[str]:
    return (os.path.abspath(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if is_supported(n))


def ocr_options(ocr: bool = False, backend: str | None = None, language: str | None = None, dpi: int | None = None) -> dict:
    """Options of the PDF extractor; any of them turns OCR on."""
    if not (ocr or backend or language or dpi):
        return {}
    if (backend or ENGINES[0]) not in ENGINES:
        raise ValueError(f"Unsupported OCR backend: {backend}")
    return {"ocr": True, "backend": backend or ENGINES[0], "language": language or "eng", "dpi": dpi or 150}


def docx_text(content: bytes, options: dict | None = None) -> str:
    """Paragraphs of a DOCX file, one a line; tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return "\n".join("".join((x.text or "") if x.tag == f"{_WORD}t" else signs.get(x.tag, "") for x in p.iter()) for p in body.iter(f"{_WORD}p"))


def pdf_text(content: bytes, options: dict | None = None) -> str:
    """Text of a PDF by `pypdf` where it is installed, else by the plain reader of this package."""
    try:
        import pypdf
    except ImportError:
        return pdf.text_of(content)
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


def read_documents(spark: SparkSession, paths: list[str] | str, pdf: Extractor = pdf_text, docx: Extractor = docx_text, options: dict | None = None, recursive: bool = True) -> DataFrame:
    """input, format, raw_text, error of each file; extraction runs on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return extract(files.select(F.col("path").alias("input"), "content"), pdf, docx, options)


def extract(files: DataFrame, pdf: Extractor = pdf_text, docx: Extractor = docx_text, options: dict | None = None) -> DataFrame:
    """As `read_documents`, for (input, content) rows, streaming ones too.

    Every file is read once: text is decoded in the JVM, and only the bytes of PDF and DOCX files cross to Python. A task's
    files are one input split (`spark.sql.files.maxPartitionBytes`, or a single larger file), which bounds what is held.
    """
    given = options or {}

    @F.pandas_udf("struct<raw_text:string,error:string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for content, kind in batches:
            rows = []
            for data, k in zip(content, kind, strict=True):
                if data is None:
                    rows.append((None, None))
                    continue
                try:
                    text = {"pdf": pdf, "docx": docx}[k](bytes(data), given)
                    rows.append((text, None) if text.strip() else (None, EMPTY[k]))
                except Exception as e:  # one bad file must not end the batch; its message is the result
                    rows.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["raw_text", "error"])

    plain = F.col("format") == "text"
    kinds = files.withColumn("format", file_format(F.col("input")))
    read = kinds.select("input", "format", F.when(plain, F.decode("content", "UTF-8")).alias("plain"), run(F.when(~plain, F.col("content")), F.col("format")).alias("x"))
    return read.select("input", "format", F.when(plain, F.col("plain")).otherwise(F.col("x.raw_text")).alias("raw_text"), F.col("x.error").alias("error"))


def inline(spark: SparkSession, text: str, name: str = "<text>") -> DataFrame:
    return spark.createDataFrame([(name, "text", text, None)], "input string, format string, raw_text string, error string")


def stdin(spark: SparkSession) -> DataFrame:
    return inline(spark, sys.stdin.buffer.read().decode("utf-8", "replace"), "<stdin>")

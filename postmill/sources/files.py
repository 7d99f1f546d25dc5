"""Text of uploaded profile files: PDF, word-processing documents and plain text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Supported types.
TYPES = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/plain": "txt",
}
_ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")]


def pdf_text(data: bytes) -> str:
    """Strings shown in text objects, those in arrays too; else runs of printable characters that are no
    names, comments or object heads. Compressed streams are not unpacked."""
    raw, shown = data.decode("cp1252", errors="replace"), []
    for block in re.findall(r"BT\s([\s\S]*?)ET", raw):
        for single, several in re.findall(r"\(([^)]*)\)\s*Tj|\[([^\]]*)\]\s*TJ", block):
            shown += re.findall(r"\(([^)]*)\)", several) if several else [single]
    if shown:
        return " ".join(_unescaped(s) for s in shown)
    runs = re.findall(r"[\x20-\x7E]{4,}", raw)
    return " ".join(r for r in runs if r[0] not in "/%" and not re.match(r"[0-9]+\s+[0-9]+\s+obj", r))


def _unescaped(s: str) -> str:
    for old, new in _ESCAPES:
        s = s.replace(old, new)
    return s


def docx_xml(data: bytes) -> str | None:
    """The main document's XML, stored or deflated; none if it isn't there."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return z.read("word/document.xml").decode("utf-8", errors="replace")
    except (zipfile.BadZipFile, KeyError):
        return None


def parse_files(files: DataFrame) -> DataFrame:
    """Adds ``text`` and ``error`` to files (mime, content). Bytes are opened in pandas; markup and white
    space are handled by Columns. Unsupported types and documents without a body give an error."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", raw string"

    def one(mime: str | None, content: bytes | None) -> str | None:
        kind = TYPES.get(mime)
        if content is None or kind is None:
            return None
        return pdf_text(content) if kind == "pdf" else docx_xml(content) if kind == "docx" else content.decode("utf-8", errors="replace")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(raw=[one(m, c) for m, c in zip(batch["mime"], batch["content"])])

    kind = F.col("mime")
    docx = [m for m, k in TYPES.items() if k == "docx"]
    plain = F.when(kind.isin(docx), T.strip_xml(F.col("raw"))).otherwise(F.col("raw"))
    error = F.when(~F.coalesce(kind.isin(list(TYPES)), F.lit(False)), F.concat(F.lit("Unsupported file type: "), F.coalesce(kind, F.lit("none")))).when(F.col("raw").isNull(), "Invalid document: no text found")
    return files.mapInPandas(run, schema).withColumns({"text": T.normalize(plain), "error": error}).drop("raw")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with their type by name, and their text."""
    files = spark.read.format("binaryFile").load(path)
    ends = lambda e: F.lower("path").endswith(e)
    mime = F.when(ends(".txt"), "text/plain")
    for m, k in TYPES.items():
        mime = mime.when(ends("." + k), m)
    return parse_files(files.select("path", mime.alias("mime"), "content"))

"""Readers over files: attachments as bytes, docx text, and a synthetic corpus for load tests."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 32 * 1024 * 1024  #: larger files are listed without content


def attachments(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha, content) of the files of a folder tree."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content"))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha"), content.alias("content"))


def docx_text(data: bytes | None) -> str | None:
    """Paragraphs, and table rows with their cells joined by ' | '; None if the file is no docx."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(data or b"")).read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None

    def text(x: str) -> str:
        raw = "".join(re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)</w:t>", x))
        return raw.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&").strip()

    out = []
    for table, para in re.findall(r"(<w:tbl>.*?</w:tbl>)|(<w:p[ >].*?</w:p>)", xml, re.DOTALL):
        if table:
            for row in re.findall(r"<w:tr[ >].*?</w:tr>", table, re.DOTALL):
                cells = [text(c) for c in re.findall(r"<w:tc>.*?</w:tc>", row, re.DOTALL)]
                out.append(" | ".join(c for c in cells if c))
        else:
            out.append(text(para))
    return "\n".join(x for x in out if x)


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the docx files of a folder; the format has no column form, so files are read in Arrow batches."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"path": pdf["path"], "text": [docx_text(c) for c in pdf["content"]]})

    return attachments(spark, folder, "*.docx").select("path", "content").mapInPandas(run, "path string, text string")


def scanned(pages: DataFrame, threshold: int = 200) -> DataFrame:
    """pages (path, chars, pages, status): adds needs_ocr, where a page holds too little text or none was read."""
    return pages.withColumn("needs_ocr", (F.col("status") != "ok") | (F.coalesce(F.try_divide("chars", "pages"), F.lit(0.0)) < threshold))


def zipf_corpus(spark: SparkSession, rows: int, seed: int = 7, vocabulary: int = 32, shape: float = 1.2) -> DataFrame:
    """(id, title, summary, text, quality): words with Pareto-distributed ranks, for load tests."""

    def words(n: int, salt: int):
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: _word(i, salt)), " ")

    def _word(i, salt: int):
        u = (F.pmod(F.xxhash64("id", i, F.lit(seed * 100 + salt)), F.lit(1 << 30)) + 1) / float(1 << 30)
        rank = F.least(F.lit(vocabulary), F.floor(F.pow(u, -1.0 / shape)).cast("int"))
        return F.concat(F.lit("word"), rank.cast("string"))

    base = spark.range(rows)
    return base.select("id", words(8, 1).alias("title"), words(30, 2).alias("summary"), words(60, 3).alias("text"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0).alias("quality"))

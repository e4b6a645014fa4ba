"""Readers and writers: manifests, extracted text, recorded graphs, resumable cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas

MAX_PDF_BYTES = 31_457_280
ORACLE_CHARS = 400_000
HEADING_SCALE = 1.2
DEFAULT_FONT = 12.0


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).option("header", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep).csv(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """source TAB url, without a header."""
    df.select("source", "url").write.mode("overwrite").option("sep", "\t").csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _cells(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """One JSON object a file; the key stands in the file name."""
    d = spark.read.schema(schema).json(path, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    return d.withColumns({k: F.regexp_extract("_file", key, i + 1) for i, k in enumerate(("doc", "chunker")[: key.count("(")])}).drop("_file")


def chunk_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CHUNK_GRAPHS).json(path, multiLine=True).withColumnRenamed("doc_sha", "doc")


def merged_graphs(spark: SparkSession, path: str) -> DataFrame:
    return _cells(spark, path, schemas.MERGED, "^([0-9a-f]+)_(.+)\\.json$")


def oracles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ORACLE).json(path, multiLine=True).withColumnRenamed("doc_sha", "doc")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, text, n_chars, truncated) of <sha>/text.txt files, the oracle's cap applied to ``text``."""
    d = spark.read.text(path, wholetext=True).withColumn("sha256", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1))
    return truncated(d.withColumnRenamed("value", "text"))


def truncated(d: DataFrame, limit: int = ORACLE_CHARS) -> DataFrame:
    return d.withColumns({"n_chars": F.length("text").cast("long"), "truncated": F.length("text") > limit, "text": F.substring("text", 1, limit)})


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, blocks) of <sha>/blocks.jsonl files, in line order."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("sha256"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("l"))
    return lines.select("sha256", F.transform("l", lambda x: F.from_json(x, schemas.struct(schemas.BLOCK))).alias("blocks"))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """Files of at most 30 MiB with their SHA-256."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_PDF_BYTES).withColumn("sha256", F.sha2("content", 256))


def locate(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the path of a file with the wanted hash, one in the source's own folder first."""
    own = F.when(F.col("path").contains(F.concat(F.lit("/"), F.col("source"), F.lit("/"))), 0).otherwise(1)
    # wanted pairs once each: copies of one content would else meet one another
    j = wanted.select("sha256", "source").distinct().join(files.select(F.col("sha256").alias("_h"), "path"), F.col("sha256") == F.col("_h"))
    return j.groupBy("sha256", "source").agg(F.min(F.struct(own.alias("o"), "path"))["path"].alias("path"))


def headings(found: DataFrame) -> DataFrame:
    """(doc, pos, page, text, fonts) to blocks with is_heading: the largest font is at least 1.2 times the document's upper median."""
    sizes = found.select("doc", F.explode("fonts").alias("f")).groupBy("doc").agg(F.array_sort(F.collect_list("f")).alias("s"))
    median = sizes.select("doc", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("median"))
    most = F.array_max("fonts")
    return found.join(median, "doc", "left").withColumn("is_heading", F.coalesce(most >= HEADING_SCALE * F.coalesce("median", F.lit(DEFAULT_FONT)), F.lit(False))).drop("median")


def pdf_pages(files: DataFrame, backend: str | None = None) -> DataFrame:
    """(sha256, page, text) by whichever of the PDF libraries is installed; their absence is an error when rows are read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        name = backend
        if name in (None, "pymupdf"):
            try:
                import fitz

                name = "pymupdf"
            except ImportError:
                name = "pypdf"
        for f in frames:
            for sha, content in zip(f.sha256, f.content, strict=True):
                if name == "pymupdf":
                    pages = [p.get_text() for p in fitz.open(stream=content, filetype="pdf")]
                else:
                    import pypdf

                    pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                yield pd.DataFrame({"sha256": sha, "page": range(1, len(pages) + 1), "text": pages})

    return files.select("sha256", "content").mapInPandas(read, "sha256 string, page int, text string")


def page_text(pages: DataFrame) -> DataFrame:
    """(sha256, text): pages in order, each with its sentinel behind it."""
    marked = F.struct("page", F.concat("text", F.lit("\n\n<<<PAGE_BREAK "), F.col("page").cast("string"), F.lit(">>>\n\n")).alias("t"))
    return pages.groupBy("sha256").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(marked)), lambda x: x["t"])).alias("text"))


def write_text(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").partitionBy("source").parquet(path)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not written yet; append its results and a rerun goes on where the last one stopped."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def resume(spark: SparkSession, work: DataFrame, path: str, keys: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run what is pending, append it to ``path``, and return all."""
    try:
        done = spark.read.parquet(path)
        work = pending(work, done, keys)
    except Exception as x:
        if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
            raise
    run(work).write.mode("append").parquet(path)
    return spark.read.parquet(path)

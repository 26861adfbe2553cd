"""Saved results, source files and bundles as DataFrames, through Spark's readers alone."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes that are taken.
CONVERTIBLE = (".pdf", ".docx", ".doc", ".pptx", ".ppt")
COMPARABLE = (".pdf", ".docx", ".pptx")


def suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = COMPARABLE, with_content: bool = False) -> DataFrame:
    """(path, suffix, bytes, content or sha256-ready columns) of supported files below ``path``, or of one file; raises if there is none.

    Without content only the listing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(suffix(F.col("path")).isin(*suffixes))
    if files.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no {', '.join(suffixes)} file below {path}")
    columns = ["path", suffix(F.col("path")).alias("suffix"), F.col("length").alias("bytes")]
    return files.select(*columns, "content") if with_content else files.select(*columns)


def check_suffix(path: str) -> None:
    if not path.lower().endswith(CONVERTIBLE):
        raise ValueError(f"unsupported file type: {path}")


def fingerprints(files: DataFrame) -> DataFrame:
    """(path, sha256) of files with content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def read_json(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, raw): one row for each JSON file; raises at files beyond ``max_bytes`` and at roots that are no object when parsed."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), F.col("value").alias("raw"))
    if max_bytes is not None:
        rows = rows.withColumn("raw", F.when(F.col("bytes") > max_bytes, F.raise_error(F.concat(F.lit("too large: "), "path"))).otherwise(F.col("raw")))
    return rows.select("path", "raw")


def require_objects(rows: DataFrame, column: str = "raw") -> DataFrame:
    kind = F.schema_of_variant(F.try_parse_json(F.col(column)))
    return rows.withColumn(column, F.when(F.coalesce(kind.like("OBJECT%"), F.lit(False)), F.col(column)).otherwise(F.raise_error(F.lit("the root must be an object"))))


def read_results(spark: SparkSession, folders: list[str], plain: str = "raw.pretty.json", packed: str = "raw.json.gz") -> DataFrame:
    """(folder, raw): the plain file of each folder or, where it is not there, the packed one.  A broken plain file does not fall back."""
    have = {n: [f for f in folders if _exists(spark, f"{f}/{n}")] for n in (plain, packed)}
    parts = [_some(spark, have[n], n, c) if have[n] else spark.createDataFrame([], f"folder string, {c} string") for n, c in ((plain, "a"), (packed, "b"))]
    return parts[0].join(parts[1], "folder", "full").select("folder", F.coalesce("a", "b").alias("raw"))


def _some(spark: SparkSession, folders: list[str], name: str, alias: str) -> DataFrame:
    t = spark.read.text([f"{f}/{name}" for f in folders], wholetext=True)
    return t.select(F.regexp_replace("_metadata.file_path", r"/[^/]*$", "").alias("folder"), F.col("value").alias(alias))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resource_markdown(rows: DataFrame, column: str = "raw") -> DataFrame:
    """``rows`` with markdown (the root's content, null without a string) and warning."""
    root = "try_variant_get(try_parse_json({c}), '$[0][\"{k}\"]', 'string')"
    content = F.coalesce(*[F.expr(root.format(c=column, k=k)) for k in ("tk:content", "X-TIKA:content")])
    return rows.withColumn("markdown", content).withColumn("warning", F.when(content.isNull(), "no content").when(content == "", "empty content"))


def source_profiles(files: DataFrame) -> DataFrame:
    """(path, feature, n): paragraphs and tables of .docx, slides of .pptx; broken packages have the feature ``error``."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, kind, content in zip(p["path"], p["suffix"], p["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        if kind == ".docx":
                            root = ElementTree.fromstring(z.read("word/document.xml"))
                            rows += [(path, name, sum(1 for _ in root.iter(word + tag))) for name, tag in (("paragraphs", "p"), ("tables", "tbl"))]
                        elif kind == ".pptx":
                            names = [n.split("/") for n in z.namelist()]
                            rows.append((path, "slides", sum(len(n) == 3 and n[:2] == ["ppt", "slides"] and n[2].startswith("slide") and n[2].endswith(".xml") for n in names)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    rows.append((path, "error", 1))
            yield pd.DataFrame(rows, columns=["path", "feature", "n"])

    return files.where(F.col("suffix").isin(".docx", ".pptx")).select("path", "suffix", "content").mapInPandas(run, "path string, feature string, n bigint")

"""Taking files in: validation, content hashes, one document for each content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MAX_BYTES = 50 * 1024 * 1024


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def rejection(max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not taken, or null."""
    return (F.when(F.col("length").isNull() | (F.col("length") == 0), "PDF_REQUIRED")
            .when(F.col("length") > max_bytes, "PDF_TOO_LARGE")
            .when(~F.lower("path").endswith(".pdf"), "INVALID_PDF_MIME")
            .when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "INVALID_PDF_SIGNATURE"))


def validate(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted with sha256, rejected with code)."""
    judged = files.withColumn("code", rejection(max_bytes))
    return judged.where("code is null").drop("code").withColumn("sha256", F.sha2("content", 256)), judged.where("code is not null").select("path", "length", "code")


def managed(root: str) -> Column:
    """The file lies below the storage folder, without any step upwards."""
    return F.col("path").startswith(root.rstrip("/") + "/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")


def first_of_content(rows: DataFrame, content: str, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One row for each content hash, the earliest; contents that ``existing`` (sha256) has are left out.

    The rows of a hash are reduced on the map side; no group is gathered.
    """
    hashed = rows.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    if existing is not None:
        hashed = hashed.join(existing.select("sha256").distinct(), "sha256", "left_anti")
    others = [c for c in rows.columns if c != content]
    best = hashed.groupBy("sha256").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("n_copies"))
    return best.select("sha256", "x.*", "n_copies")


def latest_delivery(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of rows delivered again under one key the last."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(key, "x.*")


def numbered(rows: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= limit)

"""Reading tables and documents, writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, path: str, most_bytes: int = 5 << 20) -> DataFrame:
    """One row a Markdown or text file: title (the name without its ending), content, path. Empty files and files over most_bytes are left out."""
    files = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    named = files.filter(F.col("path").rlike(r"(?i)\.(md|txt)$") & (F.trim("value") != "") & (F.octet_length("value") <= most_bytes))
    return named.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("title"), F.col("value").alias("content"), "path")


def connector_rows(rows: DataFrame, id_col: str, url_col: str, title_col: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of a connector's rows: id and url are required, the title falls back to the id, names that start with an underscore go."""
    limit, offset = max(1, min(limit, 100)), max(0, min(offset, 10_000))
    public = [c for c in rows.columns if not c.startswith("_")]
    good = rows.select(public).filter((F.trim(F.col(id_col).cast("string")) != "") & (F.trim(url_col) != ""))
    title = F.coalesce(F.nullif(F.trim(title_col), F.lit("")), F.col(id_col).cast("string")) if title_col else F.col(id_col).cast("string")
    return good.withColumn("title", title).orderBy(id_col).offset(offset).limit(limit)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text in column value."""
    return df.select(F.to_json(F.struct("*")).alias("value"))

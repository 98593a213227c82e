"""Citations of an answer, from the results of its searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECTIONS = "sections array<struct<chunkId string, sourceId string, content string>>"


def citations(calls: DataFrame, session_col: str, order_col: str, most: int = 5) -> DataFrame:
    """The first chunks that the searches of a session returned, each once, numbered from 1.

    calls: tool, status, query and result, JSON with an array of sections. Only searches that succeeded count; results that aren't
    JSON and sections without chunk, source or content are passed over. Output: session, index, chunk_id, source_id, content, query.
    """
    good = calls.filter((F.col("tool") == "search") & (F.col("status") == "SUCCEEDED"))
    parsed = good.select(session_col, order_col, "query", F.from_json("result", SECTIONS)["sections"].alias("sections"))
    found = parsed.select(session_col, order_col, "query", F.posexplode("sections").alias("place", "s"))
    found = found.withColumn("content", F.trim("s.content")).filter("s.chunkId != '' and s.sourceId != '' and content != ''")
    first = F.min(F.struct(order_col, "place", F.col("s.sourceId").alias("source_id"), "content", "query")).alias("first")
    once = found.groupBy(session_col, F.col("s.chunkId").alias("chunk_id")).agg(first)
    at = F.row_number().over(Window.partitionBy(session_col).orderBy(f"first.{order_col}", "first.place"))
    return once.withColumn("index", at).filter(F.col("index") <= most).select(session_col, "index", "chunk_id", "first.source_id", "first.content", "first.query")

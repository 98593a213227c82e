"""Retrieval: exact vector top-k for one or many queries, lexical scoring, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text, vector
from . import nearest, shared

#: Bytes of a cell's vectors on either side; rows that a cell has at least, and how many cells of rows there are as long as they are small enough.
CELL_BYTES, LEAST_ROWS, CELLS = 1 << 25, 4096, 64


def vector_topk(rows: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k rows nearest to a query vector by cosine, those under the threshold left out; ties by id. Each task keeps k rows only."""
    scored = rows.withColumn("score", vector.cosine(F.col(vector_col), F.array(*map(F.lit, query))))
    if threshold is not None:  # the order's key, so filtering first gives the same rows
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def query_vector(rows: DataFrame, id_col: str, id_value: int, vector_col: str = "embedding") -> list[float]:
    """One row's vector, as the query of a search."""
    found = rows.filter(F.col(id_col) == id_value).select(vector_col).first()
    return [float(x) for x in found[0]] if found else []


def multi_topk(rows: DataFrame, queries: DataFrame, k: int, id_col: str, query_col: str, vector_col: str = "embedding", block: int = 16384) -> DataFrame:
    """The k nearest rows of each query, exactly; ties by id. Rows and queries are dealt into cells, every row meets every query in one of them, and of a cell only the k best of
    each query go on; a cell holds `block` queries at most or so, and a bounded number of bytes on either side, so that no table reaches the driver or one task."""
    shared.ship(rows.sparkSession)
    left, right = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), queries.select(F.col(query_col).alias("q"), F.col(vector_col).alias("q_v"))
    sized = lambda df, v: df.agg(F.count("*"), F.coalesce(F.max(F.size(v)), F.lit(0))).first()
    (n, width), (m, other) = sized(left, "v"), sized(right, "q_v")
    most = max(64, CELL_BYTES // (8 * max(1, width, other)))  # vectors of either side of a cell
    across, down = max(1, -(-m // min(block, most))), max(1, -(-n // min(max(LEAST_ROWS, n // CELLS), most)))
    dealt = lambda df, col, own, rest: df.withColumn("at", F.pmod(F.xxhash64(col), F.lit(own)).cast("long")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(rest - 1))))
    left = dealt(left, "id", down, across).select((F.col("at") * across + F.col("to")).alias("cell"), "id", "v")
    right = dealt(right, "q", across, down).select((F.col("to") * across + F.col("at")).alias("cell"), "q", "q_v")
    schema = StructType([StructField("q", right.schema["q"].dataType), StructField("id", left.schema["id"].dataType), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)
    found = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(lambda a, b: nearest.cell(a, b, k, arrow), schema)
    found = found.select(F.col("q").alias(query_col), F.col("id").alias(id_col), "score")
    best = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def entity_scores(rows: DataFrame, query: str, name_col: str, extra_col: str) -> DataFrame:
    """Rows that match the query by trigram similarity, containment, equality or a term, with the greatest of these as score."""
    q, terms = query.lower().strip(), text.query_terms(query)
    name = F.lower(name_col)
    near, near_extra = text.similarity(F.col(name_col), F.lit(q)), text.similarity(F.col(extra_col), F.lit(q))
    held, hit = F.lit(q).contains(name), text.contains_any(F.concat_ws(" ", name_col, extra_col), terms)
    score = F.greatest(near, near_extra, F.when(held, 1.0), F.when(name == q, 1.2), F.when(hit, 0.8))
    return rows.filter((near >= 0.3) | (near_extra >= 0.3) | held | hit).withColumn("score", score)


def lexical_rerank(rows: DataFrame, query: str, text_col: str, score_col: str, id_col: str, k: int) -> DataFrame:
    """Order by how many query terms (split at other than letters and digits, longer than one, repeats kept) the text has, plus the score."""
    terms = [w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split() if len(w) > 1]
    hits = sum((F.lower(text_col).contains(w).cast("int") for w in terms), F.lit(0))
    return rows.withColumn("rerank", hits + F.col(score_col)).orderBy(F.desc("rerank"), id_col).limit(k)


def keyword_rerank(rows: DataFrame, query: str, text_col: str, score_col: str, id_col: str, k: int) -> DataFrame:
    """Order by how many of the query's keywords are the text's keywords too, plus the score."""
    shared = F.size(F.array_intersect(text.keywords(F.lit(query)), text.keywords(F.col(text_col))))
    return rows.withColumn("rerank", shared + F.col(score_col)).orderBy(F.desc("rerank"), id_col).limit(k)


def edge_scores(rows: DataFrame, query: str, subject: str, object_: str, label: str) -> DataFrame:
    """Edges whose ends or label resemble the query or hold one of its terms; score: the greatest of the similarities, 1.0 for a term
    in an end, 0.8 for one in the label."""
    terms = text.query_terms(query)
    near = [text.similarity(F.col(c), F.lit(query.lower())) for c in (subject, object_, label)]
    ends, named = text.contains_any(F.concat_ws(" ", subject, object_), terms), text.contains_any(F.col(label), terms)
    score = F.greatest(*near, F.when(ends, 1.0), F.when(named, 0.8))
    return rows.filter(reduce(lambda a, b: a | b, [x >= 0.3 for x in near]) | ends | named).withColumn("score", score)


def front_merge(sections: DataFrame, extra: DataFrame, most: int, id_col: str) -> DataFrame:
    """id and position: extra ids not among sections stand before them, the last of them first, until most are reached.

    Both have an ord; sections are a page (at most `most` rows). A full page still admits one extra.
    """
    room = max(1, most - sections.count())
    new = extra.join(sections.select(id_col), id_col, "left_anti").groupBy(id_col).agg(F.min("ord").alias("ord")).orderBy("ord").limit(room)
    both = new.select(id_col, F.lit(0).alias("part"), (-F.col("ord")).alias("ord")).unionByName(sections.select(id_col, F.lit(1).alias("part"), "ord"))
    return both.select(id_col, F.row_number().over(Window.orderBy("part", "ord")).alias("position"))  # a page of rows


def backfill(ranked: DataFrame, bridge: DataFrame, event_col: str, entity_col: str, order_col: str, events: int = 5, most: int = 8) -> DataFrame:
    """Entities of the first ranked events (column rank), each once, in the order they come, at most so many."""
    top = F.broadcast(ranked.orderBy("rank").limit(events))
    found = bridge.join(top, event_col).groupBy(entity_col).agg(F.min(F.struct("rank", order_col)).alias("at")).orderBy("at", entity_col).limit(most)
    return found.select(entity_col, F.row_number().over(Window.orderBy("at", entity_col)).alias("position"))

"""Pieces of composite searches: names, ranks, filled and joined lists, sections and why they were found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fulltext, relations, text
from . import graph


def name_match(rows: DataFrame, names: list[str], name_col: str, id_col: str, k: int) -> DataFrame:
    """Rows whose name equals one of the names or resembles it by trigrams; exact ones first, then by similarity and id; score 1."""
    low = [n.lower().strip() for n in names if n.strip()]
    if not low:
        return rows.limit(0).withColumns({"exact": F.lit(False), "near": F.lit(0.0), "score": F.lit(1.0)})
    near = F.greatest(*(text.similarity(F.col(name_col), F.lit(n)) for n in low), F.lit(0.0))
    found = rows.withColumns({"exact": F.lower(F.trim(name_col)).isin(low), "near": near, "score": F.lit(1.0)})
    return found.filter(F.col("exact") | (F.col("near") >= 0.3)).orderBy(F.desc("exact"), F.desc("near"), id_col).limit(k)


def expanded_query(query: str, *more: list[str]) -> str:
    """The query and further terms, each once, joined by blanks."""
    return " ".join(dict.fromkeys(t.strip() for t in (query, *(x for m in more for x in m)) if t.strip()))


def cover_rank(docs: DataFrame, id_col: str, text_col: str, terms: list[str], weight: float = 0.1) -> DataFrame:
    """id and rank of texts with all terms: each shortest stretch that holds them all counts weight, divided by one more than the words
    in it that are no terms.

    Places of terms are numbered within their text only; texts that lack a term have no row. Terms are single lower-case words.
    """
    spots = docs.select(id_col, F.posexplode(fulltext.tokens(F.col(text_col))).alias("at", "term")).filter(F.col("term").isin(terms))
    by = Window.partitionBy(id_col).orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(F.when(F.col("term") == t, F.col("at")), ignorenulls=True).over(so_far) for t in terms]
    first = F.least(*last) if len(last) > 1 else last[0]
    held = reduce(lambda a, b: a & b, [x.isNotNull() for x in last])
    ends = spots.withColumns({"n": F.row_number().over(by), "begin": F.when(held, first)})
    place = ends.select(id_col, F.col("at").alias("begin"), F.col("n").alias("begin_n"))
    covers = ends.filter("begin is not null").groupBy(id_col, "begin").agg(F.min("at").alias("end"), F.min("n").alias("end_n"))
    covers = covers.join(place, [id_col, "begin"])
    noise = (F.col("end") - F.col("begin")) - (F.col("end_n") - F.col("begin_n"))
    return covers.groupBy(id_col).agg(F.sum(weight / (1 + noise)).alias("rank"))


def either(first: DataFrame, then: DataFrame, id_col: str) -> DataFrame:
    """id and ord of a list and another behind it, each id once, where it comes first. Both have an ord."""
    both = first.select(id_col, F.lit(0).alias("part"), "ord").unionByName(then.select(id_col, F.lit(1).alias("part"), "ord"))
    return both.groupBy(id_col).agg(F.min(F.struct("part", "ord")).alias("at"))


def filled(page: DataFrame, spare: DataFrame, id_col: str, most: int) -> DataFrame:
    """A page of at most `most` ids, filled up from spare ids that it lacks; both have an ord, the result a position."""
    found = either(page, spare.join(page.select(id_col), id_col, "left_anti"), id_col).orderBy("at").limit(most)
    return found.select(id_col, F.row_number().over(Window.orderBy("at")).alias("position"))  # a page of rows


def or_else(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """first, or fallback where first has no rows; of one shape."""
    empty = first.limit(1).agg((F.count("*") == 0).alias("_empty"))  # one row
    return first.unionByName(fallback.crossJoin(F.broadcast(empty)).filter("_empty").drop("_empty"))


def sections(selected: DataFrame, coarse: DataFrame, chunks: DataFrame, event_col: str, chunk_col: str) -> DataFrame:
    """Chunks of selected events (event, position), each chunk once, at its first event; score of the event's coarse rank, else 0."""
    rows = chunks.join(selected, event_col).join(coarse.select(event_col, "score"), event_col, "left")
    first = rows.groupBy(chunk_col).agg(F.min(F.struct("position", event_col, F.coalesce("score", F.lit(0.0)).alias("score"))).alias("first"))
    return first.select(chunk_col, F.col(f"first.{event_col}").alias(event_col), "first.position", "first.score")


def why(in_path: Column, has_edge: Column, has_entity: Column, fallback: Column) -> Column:
    """How a section was found, by the strongest reason."""
    return F.when(in_path, "graph_path").when(has_edge, "knowledge_edge").when(has_entity, "entity").when(fallback, "fallback").otherwise("vector")


def paths_both_ways(edges: DataFrame, seeds: DataFrame, depth: int, limit: int) -> DataFrame:
    """The best paths of 1 to depth edges from seeds: an edge is followed from whichever end the path has reached.

    edges: edge_id, subject, object, kind, confidence, quality, strength and reasoning. The first edge may be of any kind; later ones
    must serve reasoning and not be RELATED_TO; no edge or node comes twice. Nodes stand in the first edge's order, so a path goes on
    from that edge's object. Score as for paths; ties by the edges' ids.
    """
    step = F.struct("edge_id", "confidence", "quality", "strength")
    at_seed = graph.edges_at(edges, seeds.select("node").distinct(), "subject", "object")
    now = at_seed.select(F.array("subject", "object").alias("nodes"), F.array(step).alias("steps"))
    more = edges.filter(F.col("reasoning") & (F.col("kind") != "RELATED_TO"))
    there = more.select(F.col("subject").alias("tail"), F.col("object").alias("head"), step.alias("step"))
    back = more.filter("subject != object").select(F.col("object").alias("tail"), F.col("subject").alias("head"), step.alias("step"))
    both, out = there.unionByName(back), now
    for _ in range(1, depth):
        now = now.join(both, F.element_at("nodes", -1) == F.col("tail"))
        now = now.filter(~F.array_contains("nodes", F.col("head")) & ~F.array_contains("steps.edge_id", F.col("step.edge_id")))
        now = now.select(F.array_append("nodes", F.col("head")).alias("nodes"), F.array_append("steps", F.col("step")).alias("steps"))
        out = out.unionByName(now)
    scored = out.withColumn("score", relations.path_score(F.col("steps.confidence"), F.col("steps.quality"), F.col("steps.strength")))
    return scored.withColumn("path", F.array_join("steps.edge_id", ">")).orderBy(F.desc(F.round("score", 9)), "path").limit(limit)

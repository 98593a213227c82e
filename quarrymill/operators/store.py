"""Changes as new snapshots: upserts, archiving and cascading deletes return the tables as they are afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by (source, type, lower-case trimmed name): the latest name wins, a description stays unless it is empty.

    new has an ordinal; within it the last name and the first description that isn't empty count.
    """
    key = F.lower(F.trim("name"))
    incoming = new.withColumn("key", key).groupBy("source", "type", "key").agg(F.max_by("name", "ordinal").alias("new_name"), F.min_by(F.nullif(F.trim("description"), F.lit("")), F.when(F.trim("description") != "", F.col("ordinal"))).alias("new_description"))
    both = old.withColumn("key", key).join(incoming, ["source", "type", "key"], "full")
    return both.select("source", "type", "key", F.coalesce("new_name", "name").alias("name"), F.coalesce(F.nullif(F.trim("description"), F.lit("")), "new_description").alias("description"))


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (subject, relation, object): confidence and quality only rise, CONFIRMED stays, any other status becomes AUTO again."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    keys = ["subject", "relation", "object"]
    incoming = new.groupBy(keys).agg(F.max(clamp(F.col("confidence"))).alias("new_confidence"), F.max(clamp(F.col("quality"))).alias("new_quality"))
    both = old.join(incoming, keys, "full")
    touched = F.col("new_confidence").isNotNull()
    status = F.when(touched & ~F.coalesce(F.col("status") == "CONFIRMED", F.lit(False)), "AUTO").otherwise(F.col("status"))
    return both.select(*keys, F.greatest("confidence", "new_confidence").alias("confidence"), F.greatest("quality", "new_quality").alias("quality"), status.alias("status"))


def latest(rows: DataFrame, keys: list[str], order: list, most: int = 1) -> DataFrame:
    """Of rows with equal keys, the first in the given order, or the first few."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(keys).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def delete_documents(documents: DataFrame, events: DataFrame, bridge: DataFrame, entities: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the gone documents, their events and bridge rows, and entities that only these had."""
    lost = events.join(gone, "document_id", "left_semi").select("event_id")
    kept_bridge = bridge.join(lost, "event_id", "left_anti")
    touched = bridge.join(lost, "event_id", "left_semi").select("entity_id").distinct()
    orphans = touched.join(kept_bridge, "entity_id", "left_anti")
    return {
        "documents": documents.join(gone, "document_id", "left_anti"),
        "events": events.join(gone, "document_id", "left_anti"),
        "bridge": kept_bridge,
        "entities": entities.join(orphans, "entity_id", "left_anti"),
    }


def merge_metadata(old, new):
    """Two maps as one, in which new's keys win; nulls count as empty."""
    none = F.create_map().cast("map<string,string>")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)


def archive(rows: DataFrame, which, at: str, column: str = "archived_at") -> DataFrame:
    """Rows with the given condition archived at that time; those already archived keep their first time."""
    return rows.withColumn(column, F.when(which, F.coalesce(column, F.lit(at).cast(rows.schema[column].dataType))).otherwise(F.col(column)))


def restore(rows: DataFrame, which, column: str = "archived_at") -> DataFrame:
    """Rows with the given condition live again."""
    return rows.withColumn(column, F.when(which, F.lit(None)).otherwise(F.col(column)))


def merge_sources(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Sources after new ones arrive: name and description of those known stay, metadata maps are merged, unknown ones are added."""
    n = new.select(key, *(F.col(c).alias(f"new_{c}") for c in ("name", "description", "metadata")))
    both = old.join(n, key, "full")
    merged = merge_metadata(F.col("metadata"), F.col("new_metadata")).alias("metadata")
    return both.select(key, F.coalesce("name", "new_name").alias("name"), F.coalesce("description", "new_description").alias("description"), merged)


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new rows in place of those with the same keys: an upsert that replaces every other column."""
    return old.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new)


def reviewed(edges: DataFrame, reviews: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Edges after reviews (new_status, new_confidence; null keeps), and the audit: key, before, after and the action that after tells."""
    both = edges.join(reviews, key, "left")
    after = F.coalesce("new_status", "status")
    out = both.select(key, after.alias("status"), F.coalesce("new_confidence", "confidence").alias("confidence"))
    action = F.when(after == "CONFIRMED", "confirm").when(after == "REJECTED", "reject").when(after == "DISABLED", "disable").otherwise("update")
    audit = edges.join(reviews, key).select(key, F.col("status").alias("before"), after.alias("after"), action.alias("action"))
    return out, audit


def delete_source(source_col: str, gone: DataFrame, documents: DataFrame, events: DataFrame, bridge: DataFrame) -> dict[str, DataFrame]:
    """The tables without the gone sources and all that hangs on them."""
    docs = documents.join(gone, source_col, "left_anti")
    left = events.join(docs.select("document_id"), "document_id", "left_semi")
    return {"documents": docs, "events": left, "bridge": bridge.join(left.select("event_id"), "event_id", "left_semi")}

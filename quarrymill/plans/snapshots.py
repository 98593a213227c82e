"""After-images of tables in a snapshot store, read back after their commits."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ingest, shared, snapshots
from ..sources import table
from .catalog import query

c = F.col
ORDER = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"


def fresh(spark) -> snapshots.Store:
    return snapshots.Store(spark, f"{shared.folder(spark)}/store-{uuid.uuid4().hex}")


@query(f"""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_name LIKE '%7'),
lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone)),
b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
orphans AS (SELECT l_partkey FROM b WHERE l_orderkey IN (SELECT o_orderkey FROM lost) EXCEPT SELECT l_partkey FROM b WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)),
e AS (SELECT l_orderkey, l_partkey AS s, lead(l_partkey) {ORDER} AS o, row_number() {ORDER} AS n FROM lineitem)
SELECT 'documents' AS name, c_custkey AS id, 0 AS other FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'events', o_orderkey, 0 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'bridge', l_orderkey, l_partkey FROM b WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)
UNION ALL SELECT 'entities', p_partkey, 0 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM orphans)
UNION ALL SELECT 'edges', l_orderkey * 100 + n, 0 FROM e WHERE o IS NOT NULL AND o <> s AND l_orderkey NOT IN (SELECT o_orderkey FROM lost)""")
def store_cascade_delete(spark, d) -> DataFrame:
    """Five tables after documents were deleted from a store: entities go when the count of their holders falls to nothing, edges with them."""
    store, lines = fresh(spark), table(spark, d, "lineitem")
    events = table(spark, d, "orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("document_id"))
    bridge = lines.select(c("l_orderkey").alias("event_id"), c("l_partkey").alias("entity_id")).distinct().join(events, "event_id")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    edges = lines.select("l_orderkey", c("l_partkey").alias("subject"), F.lead("l_partkey").over(by).alias("object"), F.row_number().over(by).alias("n")).filter("object is not null and object != subject")
    edges = edges.select((c("l_orderkey") * 100 + c("n")).alias("edge_id"), c("l_orderkey").alias("event_id"), "subject", "object").join(events, "event_id")
    commit = store.begin("load")
    held = commit.append("bridge", bridge)
    commit.append("documents", table(spark, d, "customer").select(c("c_custkey").alias("document_id"), "c_name"))
    commit.append("events", events)
    commit.append("entities", table(spark, d, "part").select(c("p_partkey").alias("entity_id"), "p_name"))
    commit.append("edges", edges)
    commit.append("holders", held.groupBy("entity_id").agg(F.count("*").alias("delta")))
    commit.publish()
    ingest.delete(store, store.read("documents").filter(c("c_name").endswith("7")), "delete")
    keys = {"documents": "document_id", "events": "event_id", "bridge": "event_id", "entities": "entity_id", "edges": "edge_id"}
    rows = [store.read(t).select(F.lit(t).alias("name"), c(k).alias("id"), (c("entity_id") if t == "bridge" else F.lit(0).cast("long")).alias("other")) for t, k in keys.items()]
    return reduce(DataFrame.unionByName, rows)


@query(r"""
WITH m AS (SELECT conv_id, CAST(turn AS VARCHAR) AS turn, max(text) AS text, bool_or(role = 'assistant') AS again FROM conversations WHERE regexp_replace(coalesce(text, ''), '\s+', '', 'g') <> '' GROUP BY 1, 2)
SELECT conv_id AS source_id, turn AS external_id, CASE WHEN again THEN 'second' ELSE 'first' END AS commit_id, length(text) + CASE WHEN again THEN 9 ELSE 0 END AS n_chars, NOT again AS same, 0 AS n_stale FROM m""")
def store_replaced_documents(spark, d) -> DataFrame:
    """Messages taken in as documents, those of one role again with other texts: what a store holds then, and how many chunks, events and bridge rows have lost their document."""
    store = fresh(spark)
    rows = table(spark, d, "conversations")
    docs = rows.select(c("conv_id").alias("source_id"), c("turn").cast("string").alias("external_id"), "role", c("text").alias("content")).withColumn("title", c("role"))
    ingest.ingest(store, docs, "first")
    ingest.ingest(store, docs.filter("role = 'assistant'").withColumn("content", F.concat("content", F.lit(" (edited)"))), "second", replace=True)
    now = store.read("documents")
    stale = reduce(DataFrame.unionByName, [store.read(t).select("document_id") for t in ("chunks", "events", "bridge", "edges")]).join(now, "document_id", "left_anti").agg(F.count("*").alias("n_stale"))
    own = docs.groupBy("source_id", "external_id").agg(F.max("content").alias("was"))
    both = now.join(own, ["source_id", "external_id"]).crossJoin(F.broadcast(stale))  # one row
    return both.select("source_id", "external_id", "commit_id", F.length("content").alias("n_chars"), (c("content") == c("was")).alias("same"), c("n_stale").cast("int").alias("n_stale"))

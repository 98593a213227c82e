"""Events, entities and citations drawn from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction, kinds, text
from ..operators import citations as cited
from ..sources import table
from .catalog import query
from .service import ENTITY

c = F.col


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_concise(t: str) -> str:
    """extraction.concise for text that isn't Han."""
    s = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    f = f"list_filter(list_transform(regexp_extract_all({s}, '[^.!?;]+[.!?;]?'), lambda x: trim(x)), lambda x: x <> '')[1:3]"
    size = lambda n: f"list_sum(list_transform({f}[1:{n}], lambda x: length(x)))"
    said = f"CASE WHEN len({f}) = 0 THEN {s} ELSE array_to_string({f}[1:CASE WHEN {size(2)} > 360 THEN 1 WHEN {size(3)} > 360 THEN 2 ELSE 3 END], ' ') END"
    return f"CASE WHEN length({s}) <= 360 THEN {s} WHEN length({said}) <= 360 THEN {said} ELSE trim(substr({said}, 1, 359)) || '…' END"


TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
FIRST = rf"substr(CASE WHEN regexp_extract({TRIMMED}, '(?s)^(.*?[.!?。！？])\s', 1) <> '' THEN regexp_extract({TRIMMED}, '(?s)^(.*?[.!?。！？])\s', 1) ELSE {TRIMMED} END, 1, 120)"


@query(f"""
SELECT doc_id, first, {sql_concise('first')} AS summary, {sql_concise('text')} AS content FROM (SELECT doc_id, text, {FIRST} AS first FROM documents WHERE text IS NOT NULL)""")
def local_events(spark, d):
    """Each document as one event: its first sentence, a summary and a shortened text."""
    docs = table(spark, d, "documents").filter("text is not null")
    read = docs.select("doc_id", "text", extraction.first_sentence(c("text")).alias("first"), kinds.mostly_han(c("text")).alias("han"))
    return read.select("doc_id", "first", extraction.concise(c("first"), c("han")).alias("summary"), extraction.concise(c("text"), c("han")).alias("content"))


NOISE = " OR ".join(["length(name) NOT BETWEEN 2 AND 28", f"name IN {extraction.GENERIC}", *(f"regexp_matches(name, {quoted(p)})" for p in extraction.NO_NAME)])
KIND = f"CASE WHEN regexp_matches(name, '[0-9]') THEN 'metric' WHEN regexp_matches(name, '(?i){kinds.ORGANIZATION}') THEN 'organization' WHEN regexp_matches(name, '(?i){kinds.PRODUCT}') THEN 'product' ELSE 'subject' END"


@query(f"""
WITH m AS (SELECT doc_id, w AS name, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{ENTITY}') AS ws FROM documents)) GROUP BY 1, 2),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 12),
s AS (SELECT doc_id, name, pos, {KIND} AS kind, CAST(CASE WHEN {KIND} <> 'subject' THEN 8 ELSE 0 END + CASE WHEN length(name) BETWEEN 4 AND 12 THEN 4 ELSE 0 END - CASE WHEN regexp_matches(name, '^[A-Za-z0-9_-]+$') THEN 3 ELSE 0 END AS INTEGER) AS score
  FROM n WHERE NOT ({NOISE}))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS INTEGER) AS position, name, kind, score FROM s QUALIFY position <= 24""")
def cleaned_entities(spark, d):
    """The first twelve capitalised names of each document, cleaned, without noise, the best first."""
    names = text.named_entities(c("text"), 12)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(extraction.clean_entities(names, kinds.mostly_han(c("text")))).alias("at", "e"))
    return rows.select("doc_id", (c("at") + 1).alias("position"), "e.name", "e.kind", "e.score")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{Han}')) = 0 AND len(regexp_extract_all(text, '[A-Za-z]{2,}')) >= 4 AS drifted FROM documents WHERE text IS NOT NULL")
def language_drift(spark, d):
    """Whether each document would count as drifted if it were drawn from Han text."""
    return table(spark, d, "documents").filter("text is not null").select("doc_id", extraction.drifts(c("text"), F.lit(True)).alias("drifted"))


@query("""
WITH f AS (SELECT o_custkey AS session, l_partkey, min((o_orderkey, l_linenumber, l_suppkey)) AS first FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' AND l_returnflag <> 'R' GROUP BY 1, 2)
SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY first, l_partkey) AS INTEGER) AS index, CAST(l_partkey AS VARCHAR) AS chunk_id FROM f QUALIFY index <= 5""")
def answer_citations(spark, d):
    """The first five chunks that each customer's successful searches returned; an order stands for a search, its lines for sections."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct(
        "l_linenumber", "l_suppkey", c("l_partkey").alias("part"), c("l_partkey").cast("string").alias("chunkId"), c("l_suppkey").cast("string").alias("sourceId"),
        F.when(c("l_returnflag") != "R", "line").otherwise("").alias("content")).alias("s"))
    results = lines.groupBy("l_orderkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list("s")).alias("sections"))).alias("result"))  # an order's few lines
    orders = table(spark, d, "orders").select(c("o_custkey").alias("session"), c("o_orderkey").alias("l_orderkey"), F.when(c("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED").alias("status"))
    calls = orders.join(results, "l_orderkey").withColumns({"tool": F.lit("search"), "query": F.lit("q")})
    return cited.citations(calls, "session", "l_orderkey").select("session", "index", "chunk_id")

"""Composite searches over the tables: parts are entities, live orders events, neighbouring lines of an order edges, suppliers chunks; vectors come from embeddings."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology
from ..operators import composite, search, shared
from ..sources import table
from .catalog import KEYWORDS, LIVE, SIM, live_events, query, sql_similarity
from .service import KIND_SQL, part_kind, sql_field

c = F.col
ASKED, ALIASES, NAMES = "red widget urgent building", ("gadget",), ("Red Widget", "blue gear")
QUERY_ID, NAME_IDS, PAGE = 3, (7, 11), 10
OPTIONS = composite.Options(similarity=0.15, hops=2, rerank_top=PAGE, sections=PAGE)


def graph_of(spark, d) -> composite.Graph:
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    part = table(spark, d, "part")
    of = lambda rows, key, name: rows.join(vectors.withColumnRenamed("embedding", name), c(key) == c("vec_id"), "left").drop("vec_id")
    entities = of(part.select(c("p_partkey").alias("entity_id"), c("p_name").alias("name"), c("p_type").alias("type"), c("p_type").alias("description")), "entity_id", "embedding")
    events = live_events(spark, d).select(c("o_orderkey").alias("event_id"), F.concat_ws(" ", "n_name", "c_mktsegment", "o_orderpriority").alias("text"), c("o_custkey").alias("document_id"))
    events = of(of(events, "event_id", "title_vector"), "document_id", "content_vector")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, d, "lineitem").join(live_events(spark, d).select(c("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    lines = lines.withColumns({"n": F.row_number().over(by), "next": F.lead("l_partkey").over(by)})  # an order's few lines
    named = lambda k: part.select(c("p_partkey").alias(k), c("p_name").alias(f"{k}_name"))
    edges = lines.filter("next is not null and next != l_partkey and l_returnflag != 'R'").withColumnsRenamed({"l_partkey": "subject", "next": "object"})
    edges = edges.join(named("subject").join(part.select(c("p_partkey").alias("subject"), part_kind().alias("kind")), "subject"), "subject").join(named("object"), "object")
    edges = edges.select(
        (c("l_orderkey") * 100 + c("n")).alias("edge_id"), c("l_orderkey").alias("event_id"), c("l_suppkey").alias("chunk_id"), "subject", "object", "subject_name", "object_name", "kind", F.lower("kind").alias("label"),
        (1 - 4 * c("l_discount")).alias("confidence"), (c("l_quantity") / 50).alias("quality"), ontology.of_type(c("kind"), 2, False).alias("strong"), ontology.of_type(c("kind"), 3, False).alias("reasoning"),
        F.concat_ws(" ", "subject_name", F.lower("kind"), "object_name").alias("evidence"), c("l_orderkey").alias("created"),
    )
    chunks = of(table(spark, d, "supplier").select(c("s_suppkey").alias("chunk_id"), c("s_suppkey").alias("rank")), "chunk_id", "embedding")
    bridge = lines.groupBy(c("l_orderkey").alias("event_id"), c("l_partkey").alias("entity_id")).agg(F.min("n").alias("at"))
    event_chunks = lines.filter("n = 1").select(c("l_orderkey").alias("event_id"), c("l_suppkey").alias("chunk_id"))
    made = {"entities": entities, "events": events, "bridge": bridge, "edges": edges, "chunks": chunks, "event_chunks": event_chunks}
    return composite.Graph(**{name: shared.cut(rows, name) for name, rows in made.items()})  # derived once, as a store would have them


@cache
def sql_recall(mode: str) -> str:
    """The steps of a composite search up to its page, as common tables."""
    lines = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)"
    asked = " ".join((ASKED, *ALIASES))
    q = f"'{asked}'"
    near, more = sql_similarity("p_name", q), sql_similarity("p_type", q)
    hit = " OR ".join(f"contains(lower(p_name || ' ' || p_type), '{w}')" for w in asked.split())
    first = f"""
    SELECT p_partkey AS id, row_number() OVER (ORDER BY s DESC, p_name, p_partkey) AS rank FROM (SELECT *, {near} AS a, {more} AS b,
      greatest({near}, {more}, CASE WHEN contains({q}, lower(p_name)) THEN 1.0 END, CASE WHEN lower(p_name) = {q} THEN 1.2 END, CASE WHEN {hit} THEN 0.8 END) AS s FROM part)
    WHERE (a >= 0.3 OR b >= 0.3 OR contains({q}, lower(p_name)) OR {hit}) AND p_partkey IN (SELECT entity_id FROM b) QUALIFY rank <= 20"""
    if mode == "standard":
        low = [f"'{n.lower()}'" for n in NAMES]
        alike = "greatest(" + ", ".join(sql_similarity("p_name", n) for n in low) + ")"
        by_vector = " UNION ALL ".join(
            f"SELECT * FROM (SELECT vec_id AS id, {k + 1} AS list, row_number() OVER (ORDER BY {SIM} DESC, vec_id) AS rank FROM embeddings e JOIN part ON p_partkey = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = {v}) q WHERE {SIM} >= 0.9 AND vec_id IN (SELECT entity_id FROM b)) WHERE rank <= 20"
            for k, v in enumerate(NAME_IDS)
        )
        first = f"""
    SELECT id, row_number() OVER (ORDER BY list, rank) AS rank FROM (SELECT id, min((list, rank)) AS x, x[1] AS list, x[2] AS rank FROM (
      SELECT * FROM (SELECT p_partkey AS id, 0 AS list, row_number() OVER (ORDER BY lower(trim(p_name)) IN ({", ".join(low)}) DESC, {alike} DESC, p_partkey) AS rank FROM part
        WHERE (lower(trim(p_name)) IN ({", ".join(low)}) OR {alike} >= 0.3) AND p_partkey IN (SELECT entity_id FROM b)) WHERE rank <= 20
      UNION ALL {by_vector}) GROUP BY id)""".replace("min((list, rank)) AS x, x[1] AS list, x[2] AS rank", "arg_min(list, list * 1000 + rank) AS list, arg_min(rank, list * 1000 + rank) AS rank")
    again = "+".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in ASKED.split())
    if mode == "standard":
        again = f"len(list_intersect(list_distinct({KEYWORDS.format(t='text')}), [{', '.join(repr(w) for w in ASKED.split())}]))"
    order = "qual DESC, conf DESC, event_id DESC, id"
    best = "greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1)))"
    near_edge = [sql_similarity(x, q) for x in ("sn", "obn", "lower(kind)")]
    return f"""
  q AS (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}),
  live AS (SELECT o_orderkey AS event_id, o_custkey AS document_id, n_name || ' ' || c_mktsegment || ' ' || o_orderpriority AS text FROM {LIVE}),
  lines AS (SELECT *, row_number() {lines} AS n, lead(l_partkey) {lines} AS next FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM live)),
  b AS (SELECT l_orderkey AS event_id, l_partkey AS entity_id, min(n) AS at FROM lines GROUP BY 1, 2),
  k AS (SELECT l_orderkey * 100 + n AS id, l_orderkey AS event_id, l_suppkey AS chunk_id, s.p_partkey AS s, o.p_partkey AS o, s.p_name AS sn, o.p_name AS obn, {KIND_SQL.replace("p_type", "s.p_type")} AS kind, 1 - 4 * l_discount AS conf, l_quantity / 50 AS qual,
    s.p_name || ' ' || lower(kind) || ' ' || o.p_name AS said FROM lines JOIN part s ON s.p_partkey = l_partkey JOIN part o ON o.p_partkey = next WHERE next <> l_partkey AND l_returnflag <> 'R'),
  sure AS (SELECT *, {sql_field("kind", 3, False)} AND kind <> 'RELATED_TO' AS more, CASE WHEN {sql_field("kind", 2, False)} THEN 0.08 ELSE -0.08 END AS w FROM k WHERE conf >= 0.65),
  ent AS ({first}),
  titles AS (SELECT event_id, rank FROM (SELECT event_id, {SIM} AS s, row_number() OVER (ORDER BY {SIM} DESC, event_id) AS rank FROM live JOIN embeddings e ON vec_id = event_id, q) WHERE rank <= 20 AND s >= {OPTIONS.similarity}),
  ee AS (SELECT DISTINCT event_id FROM b WHERE entity_id IN (SELECT id FROM ent)),
  near AS (SELECT event_id FROM ee UNION SELECT event_id FROM titles),
  ed AS (SELECT *, row_number() OVER (ORDER BY score DESC, {order}) AS rank FROM (SELECT *,
      greatest({", ".join(near_edge)}, CASE WHEN s IN (SELECT id FROM ent) OR o IN (SELECT id FROM ent) THEN 1.0 ELSE 0 END, CASE WHEN event_id IN (SELECT event_id FROM near) THEN 0.8 ELSE 0 END) AS score, greatest({", ".join(near_edge)}) AS alike FROM sure)
    WHERE alike >= 0.3 OR s IN (SELECT id FROM ent) OR o IN (SELECT id FROM ent) OR event_id IN (SELECT event_id FROM near) QUALIFY rank <= 20),
  start AS (SELECT id FROM ent UNION SELECT s FROM ed UNION SELECT o FROM ed),
  p1 AS (SELECT row_number() OVER (ORDER BY {order}) AS rank, [s, o] AS nodes, [id] AS ids, conf AS c, qual AS q, w, 1 AS n FROM sure WHERE s IN (SELECT id FROM start) OR o IN (SELECT id FROM start) QUALIFY rank <= 60),
  ends AS (SELECT s AS tail, o AS head, * FROM sure UNION ALL SELECT o, s, * FROM sure WHERE s <> o),
  steps AS (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY {order}) AS nth FROM ends QUALIFY nth <= 30),
  p2 AS (SELECT row_number() OVER (ORDER BY p1.rank, nth) AS rank, list_append(nodes, head) AS nodes, list_append(ids, id) AS ids, c + conf AS c, q + qual AS q, p1.w + steps.w AS w, n + 1 AS n
    FROM p1 JOIN steps ON tail = nodes[-1] WHERE more AND NOT list_contains(nodes, head) AND NOT list_contains(ids, id) QUALIFY rank <= 60),
  queue AS (SELECT * FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) ORDER BY n, rank LIMIT 60),
  paths AS (SELECT row_number() OVER (ORDER BY round({best}, 9) DESC, n, rank) AS place, ids, n, {best} AS score FROM queue QUALIFY place <= 20),
  stepped AS (SELECT place, unnest(ids) AS id, generate_subscripts(ids, 1) AS nth FROM paths),
  seeds AS (SELECT event_id FROM near UNION SELECT event_id FROM ed UNION SELECT event_id FROM k WHERE id IN (SELECT id FROM stepped)),
  x1 AS (SELECT DISTINCT entity_id FROM b WHERE event_id IN (SELECT event_id FROM seeds) AND entity_id NOT IN (SELECT id FROM ent)),
  h1 AS (SELECT DISTINCT event_id FROM b WHERE entity_id IN (SELECT entity_id FROM x1) AND event_id NOT IN (SELECT event_id FROM seeds)),
  x2 AS (SELECT DISTINCT entity_id FROM b WHERE event_id IN (SELECT event_id FROM h1) AND entity_id NOT IN (SELECT id FROM ent UNION SELECT entity_id FROM x1)),
  h2 AS (SELECT DISTINCT event_id FROM b WHERE entity_id IN (SELECT entity_id FROM x2) AND event_id NOT IN (SELECT event_id FROM seeds UNION SELECT event_id FROM h1)),
  coarse AS (SELECT event_id, text, score, rank FROM (SELECT event_id, text, {SIM} AS score, row_number() OVER (ORDER BY {SIM} DESC, event_id) AS rank FROM live JOIN embeddings e ON vec_id = document_id, q
    WHERE event_id IN (SELECT event_id FROM seeds UNION SELECT event_id FROM h1 UNION SELECT event_id FROM h2)) WHERE rank <= 100),
  chosen AS (SELECT event_id, score, row_number() OVER (ORDER BY {again} + score DESC, event_id) AS position FROM coarse QUALIFY position <= {PAGE}),
  es AS (SELECT chunk_id, position, score, row_number() OVER (ORDER BY position, chunk_id) AS ord FROM (SELECT l_suppkey AS chunk_id, min(position) AS position, arg_min(score, position) AS score FROM chosen JOIN lines ON l_orderkey = event_id WHERE lines.n = 1 GROUP BY 1) QUALIFY ord <= {PAGE}),
  gs AS (SELECT chunk_id, score, row_number() OVER (ORDER BY ord, chunk_id) AS ord FROM (SELECT chunk_id, min(ord) AS ord, arg_min(greatest(qual, conf), ord) AS score FROM (
    SELECT chunk_id, qual, conf, rank AS ord FROM ed UNION ALL SELECT chunk_id, qual, conf, 1000 * place + nth - 1 FROM stepped JOIN k USING (id)) GROUP BY 1)),
  spare AS (SELECT s_suppkey AS chunk_id, {SIM} AS score, row_number() OVER (ORDER BY {SIM} DESC, s_suppkey) AS ord FROM supplier JOIN embeddings e ON vec_id = s_suppkey, q QUALIFY ord <= {2 * PAGE}),
  front AS (SELECT chunk_id, greatest(score, 0.75) AS score, row_number() OVER (ORDER BY ord) AS nth FROM gs WHERE chunk_id NOT IN (SELECT chunk_id FROM es) QUALIFY nth <= greatest(1, {PAGE} - (SELECT count(*) FROM es))),
  page AS (SELECT chunk_id, score, row_number() OVER (ORDER BY part, ord) AS position FROM (
    SELECT chunk_id, score, 0 AS part, -nth AS ord FROM front UNION ALL SELECT chunk_id, score, 1, ord FROM es
    UNION ALL SELECT chunk_id, score, 2, ord FROM spare WHERE chunk_id NOT IN (SELECT chunk_id FROM es UNION SELECT chunk_id FROM front)) QUALIFY position <= {PAGE})"""


@cache
def sql_search(mode: str) -> str:
    return f"""
WITH {sql_recall(mode)},
  here AS (SELECT k.*, row_number() OVER (PARTITION BY chunk_id ORDER BY -qual, -conf, id) AS nth FROM k WHERE chunk_id IN (SELECT chunk_id FROM page)),
  on_path AS (SELECT DISTINCT chunk_id, place FROM here JOIN stepped USING (id)),
  said AS (SELECT chunk_id, nth, said FROM here WHERE nth <= 200 UNION ALL SELECT on_path.chunk_id, 1000000 * place + nth, k.said FROM on_path JOIN stepped USING (place) JOIN k USING (id)),
  told AS (SELECT chunk_id, said, min(nth) AS nth FROM said GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY min(nth)) <= 6),
  names AS (SELECT string_agg(id, ',' ORDER BY rank) AS entities FROM ent),
  edges AS (SELECT chunk_id, count(*) AS n_edges, string_agg(id, ',' ORDER BY nth) FILTER (WHERE nth <= 200) AS edges FROM here GROUP BY 1),
  texts AS (SELECT chunk_id, string_agg(said, '|' ORDER BY nth) AS evidence FROM told GROUP BY 1),
  over_paths AS (SELECT chunk_id, string_agg(array_to_string(ids, '>'), '|' ORDER BY place) AS paths FROM on_path JOIN paths USING (place) GROUP BY 1)
SELECT chunk_id, CAST(position AS INTEGER) AS position, round(score, 6) AS score,
  CASE WHEN paths IS NOT NULL THEN 'graph_path' WHEN n_edges IS NOT NULL THEN 'knowledge_edge' WHEN (SELECT count(*) FROM ent) > 0 THEN 'entity' ELSE 'vector' END AS why,
  coalesce(entities, '') AS entities, coalesce(n_edges, 0) AS n_edges, coalesce(edges, '') AS edges, coalesce(paths, '') AS paths, coalesce(evidence, '') AS evidence
FROM page LEFT JOIN edges USING (chunk_id) LEFT JOIN texts USING (chunk_id) LEFT JOIN over_paths USING (chunk_id), names"""


def run(spark, d, mode: str) -> composite.Found:
    rows = table(spark, d, "embeddings")
    vectors = [search.query_vector(rows, "vec_id", k) for k in (QUERY_ID, *(NAME_IDS if mode == "standard" else ()))]
    return composite.multi_search(graph_of(spark, d), ASKED, vectors[0], mode, NAMES, tuple(vectors[1:]), ALIASES, OPTIONS)


def shown(found: composite.Found) -> DataFrame:
    joined = lambda name, by: F.array_join(F.transform(f"why.{name}", lambda x: x.cast("string")), by).alias(name)
    return found.sections.select("chunk_id", "position", F.round("score", 6).alias("score"), c("why.kind").alias("why"), joined("entities", ","), "why.n_edges", joined("edges", ","), joined("paths", "|"), joined("evidence", "|"))


@query(sql_search("fast"))
def composite_search_fast(spark, d):
    """Sections for a query by text, title and content vectors, edges and paths, each with why it was found."""
    return shown(run(spark, d, "fast"))


@query(sql_search("standard"))
def composite_search_standard(spark, d):
    """The same with entities by names and by the names' vectors."""
    return shown(run(spark, d, "standard"))


STAGES = {
    "entities": "ent", "title_events": "titles", "entity_events": "ee", "edges": "ed", "paths": "paths", "seed_events": "seeds", "near_chunks": "spare", "entities_used": "ent",
    "expanded_events": "(SELECT event_id FROM h1 UNION ALL SELECT event_id FROM h2)", "coarse_events": "coarse", "selected_events": "chosen", "sections": "page",
}


@query(f"WITH {sql_recall('fast')} " + " UNION ALL ".join(f"SELECT '{name}' AS stage, count(*) AS n FROM {of}" for name, of in STAGES.items()))
def search_trace(spark, d):
    """How many rows each step of a composite search had, counted on the way."""
    return spark.createDataFrame(list(run(spark, d, "fast").counts.items()), "stage string, n long")


@cache
def sql_paths(seed: int, depth: int, limit: int) -> str:
    """Paths in queue order from one seed over the composite searches' edges."""
    order, budget = "qual DESC, conf DESC, event_id DESC, id", 3 * limit
    best = "greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1)))"
    edges = sql_recall("fast").split("  ent AS (")[0]
    hops = [f"p1 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY {order}) AS rank, [s, o] AS nodes, [id] AS ids, conf AS c, qual AS q, w, 1 AS n FROM sure WHERE s = {seed} OR o = {seed}) WHERE rank <= {min(max(8 * limit, 80), budget)})"]
    for k in range(2, depth + 1):
        hops.append(f"""p{k} AS (SELECT row_number() OVER (ORDER BY p.rank, nth) AS rank, list_append(nodes, head) AS nodes, list_append(ids, id) AS ids, c + conf AS c, q + qual AS q, p.w + steps.w AS w, n + 1 AS n
    FROM p{k - 1} p JOIN steps ON tail = nodes[-1] WHERE more AND NOT list_contains(nodes, head) AND NOT list_contains(ids, id) QUALIFY rank <= {budget})""")
    return f"""
WITH {edges}
  ends AS (SELECT s AS tail, o AS head, * FROM sure UNION ALL SELECT o, s, * FROM sure WHERE s <> o),
  steps AS (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY {order}) AS nth FROM ends QUALIFY nth <= 30),
  {", ".join(hops)},
  queue AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(1, depth + 1))}) ORDER BY n, rank LIMIT {budget})
SELECT CAST(row_number() OVER (ORDER BY round({best}, 9) DESC, n, rank) AS INTEGER) AS place, array_to_string(ids, '>') AS path, CAST(n AS INTEGER) AS hops, round({best}, 6) AS score FROM queue QUALIFY place <= {limit}"""


@query(sql_paths(4, 3, 200))
def paths_in_queue_order(spark, d):
    """The 200 best of the first 600 paths that a queue finds from one part: its own edges first, then the best 30 edges at each tail."""
    edges = graph_of(spark, d).edges.filter(f"confidence >= {OPTIONS.confidence}")
    found = composite.budgeted_paths(shared.cut(edges, "edges"), table(spark, d, "part").filter("p_partkey = 4").select(c("p_partkey").alias("entity_id")), 3, 200)
    return found.select(c("rank").alias("place"), F.array_join("steps.edge_id", ">").alias("path"), c("hop").alias("hops"), F.round("score", 6).alias("score"))

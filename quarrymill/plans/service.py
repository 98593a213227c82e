"""Composite searches, relation types, changes with audit, and further reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sources
from ..functions import ontology, relations, text, vector
from ..operators import chunking, graph, recall, search, store
from ..sources import table
from .catalog import ALL_EDGES, E_Q, E_SCORE, LIVE, QUERIES, SIM, bridge, live_chunks, live_events, query, sql_similarity

c = F.col


def sql_kind(t: str) -> str:
    """The CASE of ontology.relation_type."""
    types = ", ".join(f"'{r[0]}'" for r in ontology.RELATIONS)
    names = " ".join("WHEN " + " OR ".join(f"contains(lower(trim({t})), '{n}')" for n in r[-1]) + f" THEN '{r[0]}'" for r in ontology.RELATIONS)
    return f"CASE WHEN upper(trim({t})) IN ({types}) THEN upper(trim({t})) {names} ELSE '{ontology.OTHER}' END"


def sql_field(kind: str, field: int, default) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{r[0]}' THEN {r[field]}" for r in ontology.RELATIONS) + f" ELSE {default} END"


@query(f"""
SELECT relation, count(*) AS n, round(min({sql_field('relation', 4, 0.82)}), 6) AS least
FROM (SELECT {sql_kind('text')} AS relation FROM conversations) GROUP BY relation""")
def relation_normalizer(spark, d):
    """The relation that each message names, and the least confidence it needs."""
    kind = table(spark, d, "conversations").select(ontology.relation_type(c("text")).alias("relation"))
    return kind.groupBy("relation").agg(F.count("*").alias("n")).select("relation", "n", F.round(ontology.least_confidence(c("relation")).cast("double"), 6).alias("least"))


KINDS = {"SMALL": "CONTAINS", "MEDIUM": "REQUIRES", "LARGE": "SIMILAR_TO", "PROMO": "RELATED_TO", "ECONOMY": "USES", "STANDARD": "CAUSES"}
KIND_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
KNOWN = "kind IN (" + ", ".join(f"'{r[0]}'" for r in ontology.RELATIONS) + ")"


def part_kind():
    return F.coalesce(*(F.when(c("p_type") == k, v) for k, v in KINDS.items()))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind
FROM (SELECT *, {KIND_SQL} AS kind, 1 - 4 * l_discount AS conf FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
WHERE {KNOWN} AND p_name <> '' AND NOT (kind = 'RELATED_TO' AND conf < 0.82) AND NOT (kind = 'USES' AND s_acctbal < 0)
  AND conf >= CASE WHEN kind = 'CAUSES' THEN 0.9 ELSE {sql_field('kind', 4, 0.82)} END""")
def relation_gate(spark, d):
    """Extracted relations that are good enough; some suppliers disable one type, and one type's least confidence is configured."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey"))
    rows = rows.withColumn("kind", part_kind())
    disabled = F.when(c("s_acctbal") < 0, F.array(F.lit("USES"))).otherwise(F.array().cast("array<string>"))
    good = ontology.passes(c("kind"), 1 - 4 * c("l_discount"), c("p_name"), F.when(c("kind") == "CAUSES", 0.9), disabled)
    return rows.filter(good).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind")


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM {LIVE}) AND l_returnflag NOT IN ('R') AND 1 - 4 * l_discount >= 0.7""")
def live_edges(spark, d):
    """Edges of live documents that aren't rejected and are sure enough; an empty list of types filters nothing."""
    rows = table(spark, d, "lineitem").filter(~c("l_returnflag").isin("R") & (1 - 4 * c("l_discount") >= 0.7))
    live = live_events(spark, d).select(c("o_orderkey").alias("l_orderkey"))
    return rows.join(live, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""
WITH off AS (SELECT p_brand, list(DISTINCT p_type) AS off FROM part WHERE p_size = 1 GROUP BY 1)
SELECT p_brand AS source, coalesce(string_agg(DISTINCT p_type, ',' ORDER BY p_type) FILTER (WHERE NOT coalesce(list_contains(off, p_type), false)), '') AS asked
FROM part LEFT JOIN off USING (p_brand) GROUP BY 1""")
def enabled_relations(spark, d):
    """The types that each source asks for without those its configuration disables."""
    part = table(spark, d, "part")
    off = part.filter("p_size = 1").groupBy("p_brand").agg(F.collect_set("p_type").alias("off"))
    asked = part.groupBy("p_brand").agg(F.collect_set("p_type").alias("asked")).join(off, "p_brand", "left")
    left = F.array_sort(F.array_except("asked", F.coalesce("off", F.array().cast("array<string>"))))
    return asked.select(c("p_brand").alias("source"), F.array_join(left, ",").alias("asked"))


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment ELSE coalesce(CASE WHEN c_acctbal > 5000 THEN 'GOLD' END, c_mktsegment) END AS segment,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name FROM customer""")
def optional_update(spark, d):
    """An update whose null fields keep what was there, but for a field whose flag sets it to null."""
    rows = table(spark, d, "customer").withColumns({"new_segment": F.when(c("c_acctbal") > 5000, "GOLD"), "clear_name": c("c_acctbal") < 0})
    return rows.select("c_custkey", F.coalesce("new_segment", "c_mktsegment").alias("segment"), F.when(c("clear_name"), F.lit(None)).otherwise(c("c_name")).alias("name"))


@query("""
SELECT c_custkey, CASE WHEN r_name = 'ASIA' THEN n_name || '/' || c_name ELSE c_name END AS name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def update_from(spark, d):
    """Documents of one tenant renamed from their source; all others stay."""
    sources = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter("r_name = 'ASIA'")), c("n_regionkey") == c("r_regionkey"))
    both = table(spark, d, "customer").join(F.broadcast(sources), c("c_nationkey") == c("n_nationkey"), "left")
    return both.select("c_custkey", F.when(c("n_name").isNotNull(), F.concat_ws("/", "n_name", "c_name")).otherwise(c("c_name")).alias("name"))


NAMES = ("red widget", "blue bolts")
NEAR = f"greatest({', '.join(sql_similarity('p_name', chr(39) + n + chr(39)) for n in NAMES)})"


@query(f"""
SELECT p_partkey, exact, round(near, 6) AS near FROM (SELECT p_partkey, lower(trim(p_name)) IN {NAMES} AS exact, {NEAR} AS near FROM part)
WHERE exact OR near >= 0.3 ORDER BY exact DESC, near DESC, p_partkey LIMIT 60""")
def entity_name_match(spark, d):
    found = recall.name_match(table(spark, d, "part"), list(NAMES), "p_name", "p_partkey", 60)
    return found.select("p_partkey", "exact", F.round("near", 6).alias("near"))


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, t FROM (SELECT doc_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM w) WHERE t IN ('the', 'and')),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n,
  max(CASE WHEN t = 'the' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS a, max(CASE WHEN t = 'and' THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s),
v AS (SELECT doc_id, least(a, b) AS f, min(i) AS l, min(n) AS ln FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)
SELECT v.doc_id, round(sum(0.1 / (1 + (l - f) - (ln - e.n))), 6) AS rank FROM v JOIN e ON v.doc_id = e.doc_id AND e.i = v.f GROUP BY 1""")
def cover_density_rank(spark, d):
    got = recall.cover_rank(table(spark, d, "documents"), "doc_id", "text", ["the", "and"])
    return got.select("doc_id", F.round("rank", 6).alias("rank"))


EXPANDED = recall.expanded_query("red widget", ["bolt"], ["red widget", "gear"])


@query(f"""
SELECT p_partkey, CAST((contains(lower(p_name), 'red'))::INT + (contains(lower(p_name), 'widget'))::INT + (contains(lower(p_name), 'bolt'))::INT + (contains(lower(p_name), 'gear'))::INT AS INTEGER) AS hits
FROM part WHERE '{EXPANDED}' = 'red widget bolt gear'""")
def expanded_query_hits(spark, d):
    """How many terms of a query and its expansions each name holds."""
    hits = sum((F.lower("p_name").contains(t).cast("int") for t in text.query_terms(EXPANDED)), F.lit(0))
    return table(spark, d, "part").select("p_partkey", hits.alias("hits"))


@query("""
SELECT a.l_orderkey AS event_id, a.l_partkey AS subject, b.l_partkey AS object
FROM (SELECT DISTINCT l_orderkey, l_partkey, p_type, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) a
JOIN (SELECT DISTINCT l_orderkey, l_partkey, p_type, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) b USING (l_orderkey)
WHERE a.p_name <> b.p_name AND (a.p_type, b.p_type) IN (('SMALL', 'LARGE'), ('PROMO', 'ECONOMY'))""")
def entity_pairs_in_event(spark, d):
    """Ordered pairs of an event's entities whose types a rule allows."""
    rules = F.broadcast(spark.createDataFrame([("SMALL", "LARGE"), ("PROMO", "ECONOMY")], "s_type string, o_type string"))
    named = bridge(spark, d).join(table(spark, d, "part").select(c("p_partkey").alias("entity_id"), "p_type", "p_name"), "entity_id")
    a = named.select("event_id", c("entity_id").alias("subject"), c("p_type").alias("s_type"), c("p_name").alias("s_name")).join(rules, "s_type")
    b = named.select("event_id", c("entity_id").alias("object"), c("p_type").alias("o_type"), c("p_name").alias("o_name"))
    return a.join(b, ["event_id", "o_type"]).filter("s_name != o_name").select("event_id", "subject", "object")


@query("""
WITH o AS (SELECT p_brand AS doc, p_type AS type, p_name AS name, count(*) AS n FROM part GROUP BY 1, 2, 3),
r AS (SELECT a.doc, a.name AS subject, b.name AS object, a.type AS s_type, b.type AS o_type, least(0.65, 0.4 + 0.05 * least(a.n, b.n)) AS conf
  FROM o a JOIN o b ON a.doc = b.doc AND (a.type, b.type) IN (('SMALL', 'LARGE'), ('PROMO', 'ECONOMY')) AND a.name <> b.name)
SELECT doc, subject, object, s_type, round(conf, 6) AS confidence FROM r
QUALIFY row_number() OVER (PARTITION BY doc ORDER BY conf DESC, subject, object, s_type) <= 40""")
def profile_relations(spark, d):
    """Relations among a document's objects by pairs of types, the surest 40 of a document."""
    rules = F.broadcast(spark.createDataFrame([("SMALL", "LARGE"), ("PROMO", "ECONOMY")], "s_type string, o_type string"))
    objects = table(spark, d, "part").groupBy(c("p_brand").alias("doc"), c("p_type").alias("type"), c("p_name").alias("name")).agg(F.count("*").alias("n"))
    a = objects.select("doc", c("name").alias("subject"), c("type").alias("s_type"), c("n").alias("s_n")).join(rules, "s_type")
    both = a.join(objects.select("doc", c("name").alias("object"), c("type").alias("o_type"), c("n").alias("o_n")), ["doc", "o_type"]).filter("subject != object")
    sure = both.withColumn("conf", F.least(F.lit(0.65), 0.4 + 0.05 * F.least("s_n", "o_n")))
    best = store.latest(sure, ["doc"], [F.desc("conf"), "subject", "object", "s_type"], 40)
    return best.select("doc", "subject", "object", "s_type", F.round("conf", 6).alias("confidence"))


@query("""
WITH n AS (SELECT p_brand AS source, p_name AS name, min(p_partkey) AS id FROM part WHERE p_size <> 2 GROUP BY 1, 2)
SELECT p_partkey AS edge_id, s.id AS subject_id, o.id AS object_id FROM part e
JOIN n s ON s.source = e.p_brand AND s.name = e.p_name JOIN n o ON o.source = e.p_brand AND o.name = 'red widget' WHERE s.id <> o.id""")
def edge_names_to_ids(spark, d):
    """Edges between names become edges between saved entities; edges with an unknown end, or one end only, go."""
    part = table(spark, d, "part")
    saved = part.filter("p_size != 2").groupBy(c("p_brand").alias("source"), c("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    edges = part.select(c("p_partkey").alias("edge_id"), c("p_brand").alias("source"), c("p_name").alias("subject"), F.lit("red widget").alias("object"))
    ends = edges.join(saved.select("source", c("name").alias("subject"), c("id").alias("subject_id")), ["source", "subject"])
    ends = ends.join(saved.select("source", c("name").alias("object"), c("id").alias("object_id")), ["source", "object"])
    return ends.filter("subject_id != object_id").select("edge_id", "subject_id", "object_id")


@query("""
SELECT l_orderkey AS chunk_id, count(*) AS n_edges, string_agg(l_suppkey || '>' || l_partkey, '|' ORDER BY l_linenumber, l_suppkey, l_partkey) AS edges
FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def edges_for_sections(spark, d):
    """Each section's edges that aren't rejected, in order; no check of liveness."""
    rows = table(spark, d, "lineitem").filter("l_returnflag != 'R'")
    got = rows.groupBy(c("l_orderkey").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))).alias("e"))
    return got.select("chunk_id", F.size("e").cast("long").alias("n_edges"), F.array_join(F.transform("e", lambda x: F.concat_ws(">", x["l_suppkey"], x["l_partkey"])), "|").alias("edges"))


@query("""
SELECT p_type AS relation, max(p_name) AS label, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_active, round(avg(1 - 4 * l_discount), 6) AS confidence,
  round(avg(least(1, l_quantity / 50)), 6) AS quality, CAST(row_number() OVER (ORDER BY count(*) FILTER (WHERE l_linestatus = 'O') DESC, count(*) DESC, p_type) AS INTEGER) AS position
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def relation_stats_ordered(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey"))
    got = rows.groupBy(c("p_type").alias("relation")).agg(
        F.max("p_name").alias("label"), F.count("*").alias("n"), F.count_if(c("l_linestatus") == "O").alias("n_active"),
        F.round(F.avg(1 - 4 * c("l_discount")), 6).alias("confidence"), F.round(F.avg(F.least(F.lit(1.0), c("l_quantity") / 50)), 6).alias("quality"),
    )
    return got.withColumn("position", F.row_number().over(Window.orderBy(F.desc("n_active"), F.desc("n"), "relation")))  # a row a type


@query("""
SELECT p_type AS type, lower(p_name) AS name, count(*) AS n, CAST(row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, max(p_size) DESC, lower(p_name)) AS INTEGER) AS position
FROM part GROUP BY 1, 2 QUALIFY position <= 10""")
def candidate_frequency(spark, d):
    """How often each candidate is met, by type and lower-case name; the first ten of a type."""
    got = table(spark, d, "part").groupBy(c("p_type").alias("type"), F.lower("p_name").alias("name")).agg(F.count("*").alias("n"), F.max("p_size").alias("score"))
    at = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("n"), F.desc("score"), "name"))
    return got.withColumn("position", at).filter("position <= 10").select("type", "name", "n", "position")


@query("""
SELECT name, CAST(sum(n) AS BIGINT) AS n, arg_min(type, CASE WHEN type = 'STANDARD' THEN 1 ELSE 0 END * 1000 + ord) AS type
FROM (SELECT lower(p_name) AS name, p_type AS type, count(*) AS n, ascii(p_type) + length(p_type) AS ord FROM part GROUP BY 1, 2) GROUP BY 1""")
def merged_candidates(spark, d):
    """Candidates of one name become one: counts add up, and a type other than the default wins."""
    per = table(spark, d, "part").groupBy(F.lower("p_name").alias("name"), c("p_type").alias("type")).agg(F.count("*").alias("n"))
    order = F.when(c("type") == "STANDARD", 1).otherwise(0) * 1000 + F.ascii("type") + F.length("type")
    return per.groupBy("name").agg(F.sum("n").alias("n"), F.min_by("type", order).alias("type"))


@query("SELECT doc_id, greatest(1, CAST((length(lower(text)) - length(replace(lower(text), 'queue', ''))) / 5 AS BIGINT)) AS n FROM documents")
def occurrences_at_least_one(spark, d):
    return table(spark, d, "documents").select("doc_id", F.greatest(text.occurrences(c("text"), "queue"), F.lit(1)).cast("long").alias("n"))


@query(f"""
WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY {SIM} DESC, e.vec_id) AS ord FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 3 QUALIFY ord <= 4),
s AS (SELECT vec_id, row_number() OVER (ORDER BY {SIM} DESC, e.vec_id) AS ord FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label <> 9 QUALIFY ord <= 20),
b AS (SELECT vec_id, 0 AS part, ord FROM p UNION ALL SELECT vec_id, 1, ord FROM s WHERE vec_id NOT IN (SELECT vec_id FROM p))
SELECT vec_id, CAST(row_number() OVER (ORDER BY part, ord) AS INTEGER) AS position FROM b QUALIFY position <= 10""")
def supplemental_fill(spark, d):
    """A short page of one label is filled up from the twice as long list of a plain vector search."""
    rows = table(spark, d, "embeddings")
    q = search.query_vector(rows, "vec_id", 7)

    def ranked(of, k):
        found = search.vector_topk(of, q, k, "vec_id")
        return found.select("vec_id", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("ord"))  # a page of rows

    return recall.filled(ranked(rows.filter("label = 3"), 4), ranked(live_chunks(spark, d), 20), "vec_id", 10)


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS ord FROM documents QUALIFY ord <= 30),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord FROM labels WHERE quality = 0 QUALIFY ord <= 30),
u AS (SELECT doc_id, min(part * 1000 + ord) AS place FROM (SELECT *, 0 AS part FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY 1)
SELECT doc_id, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS position FROM u QUALIFY position <= 25""")
def joined_lists(spark, d):
    """Two ranked lists, one behind the other, each document once, oversampled and cut at the end."""
    a = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(30).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("ord"))
    b = table(spark, d, "labels").filter("quality = 0").orderBy("doc_id").limit(30).select("doc_id", F.row_number().over(Window.orderBy("doc_id")).alias("ord"))
    first = recall.either(a, b, "doc_id").orderBy("at").limit(25)
    return first.select("doc_id", F.row_number().over(Window.orderBy("at")).alias("position"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem), r AS (SELECT s FROM e GROUP BY s ORDER BY count(*) DESC, s LIMIT 8),
v AS (SELECT 's' || s AS id FROM r UNION SELECT 'p' || o FROM e WHERE s IN (SELECT s FROM r)) SELECT s, o FROM e WHERE 's' || s IN (SELECT id FROM v) AND 'p' || o IN (SELECT id FROM v)""")
def visible_subgraph(spark, d):
    """The eight best connected roots, their neighbours, and the edges with both ends among these."""
    edges = table(spark, d, "lineitem").select(c("l_suppkey").alias("s"), c("l_partkey").alias("o")).distinct()
    roots = edges.groupBy("s").count().orderBy(F.desc("count"), "s").limit(8).select("s")
    near = edges.join(F.broadcast(roots), "s", "left_semi").select("o").distinct()
    return edges.join(F.broadcast(roots), "s", "left_semi").join(near, "o", "left_semi").select("s", "o")


@query("SELECT source, doc_id, 'doc-' || doc_id AS external_id, text AS content FROM documents")
def document_contents(spark, d):
    return table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("doc-"), "doc_id").alias("external_id"), c("text").alias("content"))


@query("""
SELECT o_custkey AS document_id, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal >= 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_partkey) <= 20""")
def edges_by_document(spark, d):
    """Each live document's edges, the best first, twenty at most."""
    own = table(spark, d, "orders").join(table(spark, d, "customer").filter("c_acctbal >= 0"), c("o_custkey") == c("c_custkey"), "left_semi")
    rows = table(spark, d, "lineitem").join(own, c("l_orderkey") == c("o_orderkey")).withColumnRenamed("o_custkey", "document_id")
    ids = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    return store.latest(rows, ["document_id"], [F.desc("l_quantity"), *ids], 20).select("document_id", *ids)


@query("SELECT c_custkey AS document_id, c_name AS title, n_name AS source, r_name AS tenant FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def document_detail(spark, d):
    sources = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), c("n_regionkey") == c("r_regionkey"))
    both = table(spark, d, "customer").join(F.broadcast(sources), c("c_nationkey") == c("n_nationkey"))
    return both.select(c("c_custkey").alias("document_id"), c("c_name").alias("title"), c("n_name").alias("source"), c("r_name").alias("tenant"))


@query("""
SELECT label AS document_id, vec_id AS chunk_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS rank, CAST(len(embedding) AS INTEGER) AS dimensions,
  array_to_string(list_transform(embedding[1:8], lambda x: CAST(CAST(round(x::DOUBLE * 1000) AS INTEGER) AS VARCHAR)), ' ') AS preview FROM embeddings""")
def chunks_by_document(spark, d):
    """Each document's chunks in order, with the first numbers of their vectors."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    p = table(spark, d, "embeddings").select(c("label").alias("document_id"), c("vec_id").alias("chunk_id"), rank.alias("rank"), vector.preview("embedding").alias("p"))
    shown = F.array_join(F.transform("p.values", lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), " ")
    return p.select("document_id", "chunk_id", "rank", "p.dimensions", shown.alias("preview"))


@query("""
SELECT conv_id, string_agg(substr(text, 1, 700), chr(10) ORDER BY turn) AS kept, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 3 GROUP BY 1""")
def observation_compaction(spark, d):
    """The last three observations of a session, 700 characters of each."""
    last = store.latest(table(spark, d, "conversations").filter("role != 'system'"), ["conv_id"], [F.desc("turn")], 3)
    kept = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 700).alias("t")))).alias("m"), F.count("*").alias("n"))
    return kept.select("conv_id", F.array_join("m.t", "\n").alias("kept"), "n")


@query("""
SELECT user_id, event_type, first AS event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first) AS INTEGER) AS sequence
FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY 1, 2)""")
def log_import_sequence(spark, d):
    """Log entries that come again go; those that stay get new numbers within their user."""
    first = store.latest(table(spark, d, "events"), ["user_id", "event_type"], ["event_id"])
    return first.select("user_id", "event_type", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("sequence"))


@query("""
WITH o AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'old' END AS description FROM supplier WHERE s_suppkey % 3 <> 0),
n AS (SELECT s_suppkey AS k, upper(s_name) AS name, 'new' AS description, s_nationkey AS tier FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.name, n.name) AS name, coalesce(o.description, n.description) AS description, coalesce(CAST(tier AS VARCHAR), CASE WHEN o.k IS NOT NULL THEN 'none' END) AS tier
FROM o FULL JOIN n ON o.k = n.k""")
def merge_sources(spark, d):
    s = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "k")
    old = s.filter("k % 3 != 0").select("k", c("s_name").alias("name"), F.when(c("s_acctbal") >= 0, "old").alias("description"), F.create_map(F.lit("tier"), F.lit("none")).alias("metadata"))
    new = s.filter("k % 2 = 0").select("k", F.upper("s_name").alias("name"), F.lit("new").alias("description"), F.create_map(F.lit("tier"), c("s_nationkey").cast("string")).alias("metadata"))
    return store.merge_sources(old, new, "k").select("k", "name", "description", c("metadata.tier").alias("tier"))


@query("""
WITH b AS (SELECT l_orderkey AS event_id, l_partkey AS entity_id, arg_max(l_quantity, l_linenumber) AS description FROM lineitem GROUP BY 1, 2)
SELECT event_id, entity_id, CASE WHEN event_id % 2 = 0 THEN -description ELSE description END AS description FROM b""")
def upsert_bridge(spark, d):
    """Rows between events and entities: the last line of a pair counts, and what comes anew replaces."""
    lines = table(spark, d, "lineitem").select(c("l_orderkey").alias("event_id"), c("l_partkey").alias("entity_id"), "l_linenumber", c("l_quantity").alias("description"))
    old = store.latest(lines, ["event_id", "entity_id"], [F.desc("l_linenumber")]).drop("l_linenumber")
    new = old.filter("event_id % 2 = 0").withColumn("description", -c("description"))
    return store.replace_rows(old, new, ["event_id", "entity_id"])


REVIEW = "CASE WHEN quality = 0 THEN 'REJECTED' WHEN toxic = 1 THEN 'DISABLED' ELSE NULL END"


@query(f"""
SELECT doc_id, coalesce({REVIEW}, 'AUTO') AS status, round(CASE WHEN quality = 0 THEN 0.1 ELSE least(1, n_chars / 10000) END, 6) AS confidence FROM documents LEFT JOIN labels USING (doc_id)""")
def reviewed_edges(spark, d):
    return review(spark, d)[0].select("doc_id", "status", F.round("confidence", 6).alias("confidence"))


@query(f"""
SELECT doc_id, 'AUTO' AS before, coalesce({REVIEW}, 'AUTO') AS after,
  CASE coalesce({REVIEW}, 'AUTO') WHEN 'REJECTED' THEN 'reject' WHEN 'DISABLED' THEN 'disable' ELSE 'update' END AS action FROM documents JOIN labels USING (doc_id)""")
def review_audit(spark, d):
    return review(spark, d)[1]


def review(spark, d):
    edges = table(spark, d, "documents").select("doc_id", F.lit("AUTO").alias("status"), F.least(F.lit(1.0), c("n_chars") / 10000).alias("confidence"))
    status = F.when(c("quality") == 0, "REJECTED").when(c("toxic") == 1, "DISABLED")
    reviews = table(spark, d, "labels").select("doc_id", status.alias("new_status"), F.when(c("quality") == 0, 0.1).alias("new_confidence"))
    return store.reviewed(edges, reviews, "doc_id")


@query("""
SELECT n_nationkey AS source, CASE WHEN n_regionkey = 1 THEN '' WHEN n_regionkey = 2 THEN 'none' ELSE 'USES' END AS disabled FROM nation""")
def relation_config(spark, d):
    """Configurations replaced as a whole: a field that the new one lacks becomes empty; sources without a configuration have the default."""
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "source")
    old = nation.filter("n_regionkey != 2").select("source", F.lit("USES").alias("disabled"))
    new = nation.filter("n_regionkey = 1").select("source", F.lit("").alias("disabled"))
    now = store.replace_rows(old, new, ["source"])
    return nation.select("source").join(now, "source", "left").select("source", F.coalesce("disabled", F.lit("none")).alias("disabled"))


@query("""
SELECT count(*) AS n_bridge, count(DISTINCT l_orderkey) AS n_events, count(DISTINCT o_custkey) AS n_documents
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 4 <> 1""")
def delete_sources(spark, d):
    """What is left of the bridge when sources go with all that hangs on them."""
    docs = table(spark, d, "customer").select(c("c_custkey").alias("document_id"), c("c_nationkey").alias("source"))
    events = table(spark, d, "orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("document_id"))
    gone = table(spark, d, "nation").filter("n_nationkey % 4 = 1").select(c("n_nationkey").alias("source"))
    left = store.delete_source("source", gone, docs, events, bridge(spark, d))
    both = left["bridge"].join(left["events"], "event_id")
    return both.agg(F.count("*").alias("n_bridge"), F.count_distinct("event_id").alias("n_events"), F.count_distinct("document_id").alias("n_documents"))


@query("""
WITH n AS (SELECT doc_id FROM labels WHERE quality = 1)
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM n) THEN upper(source) ELSE source END AS source FROM documents""")
def replace_existing(spark, d):
    """Documents that come again under a known external id take the old ones' place; the rest stays."""
    old = table(spark, d, "documents").select("doc_id", "source")
    again = old.join(table(spark, d, "labels").filter("quality = 1"), "doc_id", "left_semi").withColumn("source", F.upper("source"))
    return store.replace_rows(old, again, ["doc_id"])


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def clear_sessions(spark, d):
    """Sessions of one kind are cleared: their messages go, those of all others stay."""
    rows = table(spark, d, "conversations")
    return rows.join(rows.filter("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn", "role")


@query(f"""
WITH RECURSIVE {ALL_EDGES}, k AS (SELECT *, s % 3 <> 0 AS reasoning, CASE WHEN o % 5 = 0 THEN 'RELATED_TO' ELSE 'USES' END AS kind FROM e),
p(nodes, ids, c, q, w, n) AS (
  SELECT [s, o], [id], c, q, w, 1 FROM k WHERE s = 1 OR o = 1
  UNION ALL
  SELECT list_append(nodes, CASE WHEN k.s = nodes[-1] THEN k.o ELSE k.s END), list_append(ids, k.id), p.c + k.c, p.q + k.q, p.w + k.w, n + 1
  FROM p JOIN k ON (nodes[-1] = k.s OR nodes[-1] = k.o) WHERE n < 3 AND reasoning AND kind <> 'RELATED_TO' AND NOT list_contains(ids, k.id)
    AND NOT list_contains(nodes, CASE WHEN k.s = nodes[-1] THEN k.o ELSE k.s END))
SELECT array_to_string(ids, '>') AS path, CAST(n AS INTEGER) AS depth, round(greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1))), 6) AS score
FROM p ORDER BY round(greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1))), 9) DESC, path LIMIT 200""")
def paths_from_either_end(spark, d):
    """The 200 best paths of up to three edges from one nation, over edges from either end; an edge's kind depends on its ends."""
    from .catalog import nation_edges

    edges = nation_edges(spark, d).withColumns({"reasoning": c("subject") % 3 != 0, "kind": F.when(c("object") % 5 == 0, "RELATED_TO").otherwise("USES")})
    seeds = table(spark, d, "nation").filter("n_nationkey = 1").select(c("n_nationkey").alias("node"))
    found = recall.paths_both_ways(graph.settle(edges), seeds, 3, 200)
    return found.select("path", F.size("steps").alias("depth"), F.round("score", 6).alias("score"))


@query(f"""
SELECT vec_id AS chunk_id, label AS document_id, CAST(row_number() OVER (ORDER BY {SIM} DESC, e.vec_id) AS INTEGER) AS position, round({SIM}, 6) AS score, 'vector' AS why
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE e.label <> 9 QUALIFY position <= 10""")
def search_vector(spark, d):
    """The plain vector search as sections: chunk, document, position and score."""
    found = search.vector_topk(live_chunks(spark, d), search.query_vector(table(spark, d, "embeddings"), "vec_id", 11), 10, "vec_id")
    at = F.row_number().over(Window.orderBy(F.desc("score"), "vec_id"))
    return found.select(c("vec_id").alias("chunk_id"), c("label").alias("document_id"), at.alias("position"), F.round("score", 6).alias("score"), F.lit("vector").alias("why"))


FAST = f"""
WITH m AS (SELECT p_partkey, row_number() OVER (ORDER BY s DESC, p_name, p_partkey) AS r FROM (SELECT *, {E_SCORE} AS s, {sql_similarity('p_name', E_Q)} AS a, {sql_similarity('p_type', E_Q)} AS b FROM part)
  WHERE a >= 0.3 OR b >= 0.3 OR contains({E_Q}, lower(p_name)) OR contains(lower(p_name || ' ' || p_type), 'red') OR contains(lower(p_name || ' ' || p_type), 'widget') QUALIFY r <= 5),
live AS (SELECT o_orderkey FROM {LIVE}),
a AS (SELECT DISTINCT l_orderkey AS event_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM m) AND l_orderkey IN (SELECT o_orderkey FROM live)),
x AS (SELECT DISTINCT l_partkey AS entity_id FROM lineitem WHERE l_orderkey IN (SELECT event_id FROM a)),
h AS (SELECT DISTINCT l_orderkey AS event_id FROM lineitem WHERE l_partkey IN (SELECT entity_id FROM x) AND l_orderkey IN (SELECT o_orderkey FROM live)),
r AS (SELECT o_orderkey AS event_id, o_totalprice / 1000000 + CASE WHEN o_orderkey IN (SELECT event_id FROM a) THEN 1 ELSE 0 END AS score
  FROM orders WHERE o_orderkey IN (SELECT event_id FROM a UNION SELECT event_id FROM h)),
t AS (SELECT event_id, score, CAST(row_number() OVER (ORDER BY score DESC, event_id) AS INTEGER) AS position FROM r QUALIFY position <= 10)
SELECT event_id, position, round(score, 6) AS score,
  CASE WHEN event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_partkey IN (SELECT p_partkey FROM m)) THEN 'graph_path'
    WHEN event_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') THEN 'knowledge_edge' WHEN event_id IN (SELECT event_id FROM a) THEN 'entity' ELSE 'vector' END AS why
FROM t"""


@query(FAST)
def search_multi_fast(spark, d):
    """Entities by text, their live events, one hop on, coarse rank, the first ten as sections, and why each was found."""
    part, lines, b = table(spark, d, "part"), table(spark, d, "lineitem"), bridge(spark, d)
    met = search.entity_scores(part, "red widget", "p_name", "p_type").orderBy(F.desc("score"), "p_name", "p_partkey").limit(5).select(c("p_partkey").alias("entity_id"))
    live = live_events(spark, d).select(c("o_orderkey").alias("event_id"))
    direct = graph.settle(graph.neighbours(met, b, "entity_id", "event_id").join(live, "event_id", "left_semi"))
    hop = graph.neighbours(graph.neighbours(direct, b, "event_id", "entity_id"), b, "entity_id", "event_id").join(live, "event_id", "left_semi")
    reached = direct.withColumn("direct", F.lit(1)).unionByName(hop.withColumn("direct", F.lit(0))).groupBy("event_id").agg(F.max("direct").alias("direct"))
    scored = table(spark, d, "orders").withColumnRenamed("o_orderkey", "event_id").join(reached, "event_id").withColumn("score", c("o_totalprice") / 1000000 + c("direct"))
    top = scored.orderBy(F.desc("score"), "event_id").limit(10)
    top = top.select("event_id", "direct", "score", F.row_number().over(Window.orderBy(F.desc("score"), "event_id")).alias("position"))  # a page of rows
    strong = lines.filter("l_returnflag = 'A'").join(F.broadcast(top.select(c("event_id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    seen = strong.join(F.broadcast(met.withColumn("met", F.lit(True))), c("l_partkey") == c("entity_id"), "left").groupBy(c("l_orderkey").alias("event_id")).agg(F.coalesce(F.max("met"), F.lit(False)).alias("path"))
    out = top.join(seen, "event_id", "left")
    reason = recall.why(F.coalesce("path", F.lit(False)), c("path").isNotNull(), c("direct") == 1, F.lit(False))
    return out.select("event_id", "position", F.round("score", 6).alias("score"), reason.alias("why"))


@query("""
WITH s AS (SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, o_totalprice / 1000000 AS score FROM orders QUALIFY position <= 40),
r AS (SELECT l_suppkey AS chunk_id, event_id, position, CASE WHEN position <= 20 THEN score ELSE 0 END AS score FROM s JOIN lineitem ON l_orderkey = event_id)
SELECT chunk_id, arg_min(event_id, position) AS event_id, CAST(min(position) AS INTEGER) AS position, round(arg_min(score, position), 6) AS score FROM r GROUP BY 1""")
def sections_for_events(spark, d):
    """Chunks of selected events in the events' order, each chunk once; an event that the coarse rank lacks scores 0."""
    top = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    top = top.select(c("o_orderkey").alias("event_id"), (c("o_totalprice") / 1000000).alias("score"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("position"))
    chunks = table(spark, d, "lineitem").select(c("l_orderkey").alias("event_id"), c("l_suppkey").alias("chunk_id"))
    got = recall.sections(F.broadcast(top.select("event_id", "position")), top.filter("position <= 20"), chunks, "event_id", "chunk_id")
    return got.select("chunk_id", "event_id", "position", F.round("score", 6).alias("score"))


@query("SELECT e.vec_id, round(list_sum(list_transform(e.embedding, lambda x: abs(x::DOUBLE) / sqrt(list_sum(list_transform(e.embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 5) AS total FROM embeddings e")
def vector_normalize_whole(spark, d):
    """All elements of each vector at length 1, as the sum of their sizes."""
    v = table(spark, d, "embeddings").select("vec_id", vector.normalized("embedding").alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x)), 5).alias("total"))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1, 1 - 4 * l_discount + CASE WHEN {sql_field('kind', 2, False)} THEN 0.12 ELSE -0.08 END
  + CASE WHEN {sql_field('kind', 3, False)} THEN 0.06 ELSE -0.04 END + CASE WHEN length(p_name) >= 8 THEN 0.08 ELSE -0.25 END + CASE WHEN kind = 'RELATED_TO' THEN -0.18 ELSE 0 END)), 6) AS score
FROM (SELECT *, {KIND_SQL} AS kind FROM lineitem JOIN part ON l_partkey = p_partkey)""")
def score_relation_by_type(spark, d):
    """Scores of edges whose strength and use in reasoning come from their type."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).withColumn("kind", part_kind())
    strong, reasoning = (ontology.of_type(c("kind"), k, False) for k in (2, 3))
    score = relations.relation_score(1 - 4 * c("l_discount"), strong, reasoning, c("p_name"), F.lit(False), F.lit("AUTO"), c("kind") == "RELATED_TO")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query(f"""
SELECT vec_id AS chunk_id, CAST(row_number() OVER (ORDER BY {SIM} DESC, e.vec_id) AS INTEGER) AS position, round({SIM}, 6) AS score, 'fallback' AS why
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 11) q WHERE e.label <> 9 QUALIFY position <= 10""")
def search_without_seeds(spark, d):
    """A search whose names match no entity falls back to the vector search."""
    met = recall.name_match(table(spark, d, "part"), ["zzzz"], "p_name", "p_partkey", 5).select(c("p_partkey").alias("entity_id"))
    events = graph.neighbours(met, bridge(spark, d), "entity_id", "event_id").select(c("event_id").alias("chunk_id"), F.lit(0).alias("position"), F.lit(0.0).alias("score"), F.lit("entity").alias("why"))
    plain = search_vector(spark, d).select("chunk_id", "position", "score", F.lit("fallback").alias("why"))
    return recall.or_else(events, plain)


@query(f"""
WITH m AS (SELECT p_partkey FROM (SELECT p_partkey, lower(trim(p_name)) IN {NAMES} AS exact, {NEAR} AS near FROM part) WHERE exact OR near >= 0.3 ORDER BY exact DESC, near DESC, p_partkey LIMIT 8),
a AS (SELECT l_orderkey AS event_id, count(DISTINCT l_partkey) AS hits FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM m) AND l_orderkey IN (SELECT o_orderkey FROM {LIVE}) GROUP BY 1),
t AS (SELECT event_id, hits + o_totalprice / 1000000 AS score, CAST(row_number() OVER (ORDER BY hits + o_totalprice / 1000000 DESC, event_id) AS INTEGER) AS position FROM a JOIN orders ON o_orderkey = event_id QUALIFY position <= 10)
SELECT event_id, position, round(score, 6) AS score, 'entity' AS why FROM t""")
def search_multi_standard(spark, d):
    """Entities by name, their live events, reranked by how many of the entities they hold, the first ten as sections."""
    met = recall.name_match(table(spark, d, "part"), list(NAMES), "p_name", "p_partkey", 8).select(c("p_partkey").alias("entity_id"))
    live = live_events(spark, d).select(c("o_orderkey").alias("event_id"), "o_totalprice")
    hits = bridge(spark, d).join(F.broadcast(met), "entity_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("hits"))
    top = hits.join(live, "event_id").withColumn("score", c("hits") + c("o_totalprice") / 1000000).orderBy(F.desc("score"), "event_id").limit(10)
    at = F.row_number().over(Window.orderBy(F.desc("score"), "event_id"))  # a page of rows
    return top.select("event_id", at.alias("position"), F.round("score", 6).alias("score"), F.lit("entity").alias("why"))


STRATEGIES = {"vector": search_vector, "multi": search_multi_fast, "multi1": search_multi_standard, "fallback": search_without_seeds}


def run_search(spark, d, strategy: str):
    """The search of a strategy; unknown ones are refused."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    return STRATEGIES[strategy](spark, d)


ENTITY = r"\b[A-Z][A-Za-z0-9]+(?:[- ][A-Z][A-Za-z0-9]+){0,4}\b"


@query(f"""
SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(ws), lambda w: [lpad(CAST(list_position(ws, w) AS VARCHAR), 9, '0'), w]))[1:20], lambda p: p[2]), '|') AS entities
FROM (SELECT doc_id, regexp_extract_all(text, '{ENTITY}') AS ws FROM documents)""")
def local_entities(spark, d):
    """Runs of capitalised words, the first twenty different ones of a document."""
    return table(spark, d, "documents").select("doc_id", F.array_join(text.named_entities(c("text")), "|").alias("entities"))


@query("SELECT page_id, url, CAST(page_id AS VARCHAR) AS title FROM pages WHERE trim(url) <> '' ORDER BY page_id LIMIT 100 OFFSET 10")
def connector_preview(spark, d):
    """A page of a connector's rows: the limit is held to 100."""
    return sources.connector_rows(table(spark, d, "pages").select("page_id", "url"), "page_id", "url", limit=1000, offset=10)


@query("""SELECT '{"doc_id":' || doc_id || ',"source":"' || source || '","n_chars":' || n_chars || '}' AS value FROM documents""")
def rows_as_json(spark, d):
    return sources.as_json(table(spark, d, "documents").select("doc_id", "source", "n_chars"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, len(ws) > 0 AS ok, CASE WHEN len(ws) = 0 THEN 'content is empty' END AS error,
  CASE WHEN len(ws) = 0 THEN 0 ELSE 1 + CAST(greatest(ceil((len(ws) - 200) / 160), 0) AS BIGINT) END AS n_chunks,
  CASE WHEN len(ws) > 0 THEN CASE WHEN length(array_to_string(ws, ' ')) <= 64 THEN array_to_string(ws, ' ') ELSE substr(array_to_string(ws, ' '), 1, 63) || '…' END END AS title
FROM w""")
def ingest_batch(spark, d):
    """A batch of documents into chunks: each document's own outcome, so that one that fails stops no other."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.word_windows(docs, 200, 40).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    good = F.col("n_chunks").isNotNull()
    got = docs.join(chunks, "doc_id", "left")
    return got.select("doc_id", good.alias("ok"), F.when(~good, "content is empty").alias("error"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(good, text.preview(c("text"), 64)).alias("title"))


@query("""
WITH gone AS (SELECT c_custkey FROM customer WHERE c_name LIKE '%7'), lost AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT l_orderkey AS event_id, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost) GROUP BY 1""")
def delete_by_external_id(spark, d):
    """All documents with certain external ids go with their graph; what is left between events and entities."""
    people = table(spark, d, "customer").select(c("c_custkey").alias("document_id"), c("c_name").alias("external_id"))
    events = table(spark, d, "orders").select(c("o_orderkey").alias("event_id"), c("o_custkey").alias("document_id"))
    entities = table(spark, d, "part").select(c("p_partkey").alias("entity_id"))
    gone = people.filter(c("external_id").endswith("7")).select("document_id")
    left = store.delete_documents(people, events, bridge(spark, d), entities, gone)["bridge"]
    return left.groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_custkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS archived_on FROM orders")
def restore_documents(spark, d):
    rows = table(spark, d, "orders").withColumn("archived_at", F.when(c("o_orderstatus") == "F", c("o_orderdate")))
    return store.restore(rows, c("o_custkey") % 2 == 1).select("o_orderkey", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"))


def chunk_documents_tokens(spark, d):
    """All documents in windows of 256 tokens that overlap by 64. No SQL has the tokenizer; tests hold it against fixtures."""
    return chunking.chunk_markdown(table(spark, d, "documents"), max_tokens=256, overlap=64)


def chunk_paragraph_pack(spark, d):
    """All documents by headings, packed from paragraphs, sentences and pieces of 128 tokens at most."""
    return chunking.chunk_markdown(table(spark, d, "documents"), "heading_strict", 128)


QUERIES |= {f.__name__: f for f in (chunk_documents_tokens, chunk_paragraph_pack)}

"""Detail and list queries, further searches, and rules on names and texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fulltext, kinds, text, vector
from ..operators import graph, search, store
from ..sources import table
from .catalog import KEYWORDS, ORACLES, bridge, query, sql_similarity

TOKENS = r"' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' ') || ' '"
HASHED = "list_transform(range(0, 64), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::INT / 255::DOUBLE * 2 - 1)"


@query(f"SELECT doc_id, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT doc_id, {HASHED} AS v FROM (SELECT doc_id, sha256(lower(trim(text)) || ':0') || sha256(lower(trim(text)) || ':32') AS x FROM documents)))")
def hashed_embedding(spark, d):
    v = table(spark, d, "documents").select("doc_id", vector.hashed(F.col("text"), 64).alias("v"))
    return v.select("doc_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"))


@query("SELECT o_orderkey AS event_id, n_name AS source, d.c_name AS document, coalesce(e.entities, '') AS entities FROM orders JOIN customer c ON o_custkey = c.c_custkey JOIN nation ON c.c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) d ON d.c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, string_agg(p_type || ':' || p_name, '|' ORDER BY p_type, p_name) AS entities FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1) e ON e.l_orderkey = o_orderkey")
def event_detail(spark, d):
    """Each event with its source, its document unless archived, and its entities by type and name."""
    people = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    people = people.select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("source"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("document"))
    named = bridge(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.concat_ws(":", "p_type", "p_name").alias("name"), "p_type", "p_name"), "entity_id")
    entities = named.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("p_type", "p_name", "name"))).alias("e"))
    out = table(spark, d, "orders").withColumnRenamed("o_orderkey", "event_id").join(people, "o_custkey").join(entities, "event_id", "left")
    return out.select("event_id", "source", "document", F.coalesce(F.array_join("e.name", "|"), F.lit("")).alias("entities"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON o_custkey = c_custkey WHERE s_nationkey % 5 = 3 AND (c_custkey IS NULL OR c_acctbal >= 0) ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_quantity DESC, l_discount, l_orderkey, l_linenumber, l_suppkey, l_partkey LIMIT 300")
def edges_by_source(spark, d):
    """A source's edges, those of archived documents left out, confirmed ones first."""
    own = table(spark, d, "supplier").filter("s_nationkey % 5 = 3").select(F.col("s_suppkey").alias("l_suppkey"))
    some = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", F.lit(True).alias("known"))
    lines = table(spark, d, "lineitem").join(own, "l_suppkey").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey", "left")
    order = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    ids = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
    return lines.join(some, "o_custkey", "left").filter("known is null or c_acctbal >= 0").orderBy(order, F.desc("l_quantity"), "l_discount", *ids).limit(300).select(*ids)


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_suppkey, l_partkey LIMIT 500")
def edges_by_entities(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    nodes = table(spark, d, "part").filter("p_size = 7").select(F.col("p_partkey").alias("node"))
    return graph.edges_at(lines, nodes, "l_suppkey", "l_partkey").orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").limit(500)


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(greatest(1 - 4 * l_discount, l_quantity / 50), 6) AS score FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_partkey IN (SELECT p_partkey FROM part)")
def edges_by_events(spark, d):
    """Edges of given events that have a chunk, scored by the better of confidence and quality."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").filter("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    lines = lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(F.greatest(1 - 4 * F.col("l_discount"), F.col("l_quantity") / 50), 6).alias("score"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 5), e AS (SELECT l_partkey AS entity_id, min(r * 1000 + l_linenumber) AS first_at FROM lineitem JOIN r ON l_orderkey = o_orderkey GROUP BY 1) SELECT entity_id, CAST(row_number() OVER (ORDER BY first_at, entity_id) AS INTEGER) AS position FROM e QUALIFY position <= 8")
def entity_backfill(spark, d):
    ranked = table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select(F.col("o_orderkey").alias("l_orderkey"), F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return search.backfill(ranked, table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", "l_partkey", "l_linenumber").withColumnRenamed("l_partkey", "entity_id")


@query("WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS i FROM documents QUALIFY i <= 6), g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) WHERE doc_id NOT IN (SELECT doc_id FROM e) QUALIFY i <= 4), a AS (SELECT doc_id, 0 AS b, -i AS o FROM g UNION ALL SELECT doc_id, 1, i FROM e) SELECT doc_id, CAST(row_number() OVER (ORDER BY b, o) AS INTEGER) AS position FROM a")
def merged_sections(spark, d):
    page = table(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(6).select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("ord"))
    extra = table(spark, d, "labels").filter("quality = 1").select("doc_id", F.col("doc_id").alias("ord"))
    return search.front_merge(page, extra, 10, "doc_id")


@query(ORACLES["one_hop_events"])
def dynamic_expansion(spark, d):
    """One hop reaches the target of 100 events at every size of these tables."""
    b = bridge(spark, d)
    return graph.expand_until(b.filter("entity_id = 5").select("event_id"), b, "event_id", "entity_id", 100, 3)


@query("WITH s AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey = 5), p1 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM s)), h1 AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p FROM p1) AND l_orderkey NOT IN (SELECT e FROM s)), p2 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM h1) AND l_partkey NOT IN (SELECT p FROM p1)), h2 AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p FROM p2) AND l_orderkey NOT IN (SELECT e FROM s UNION ALL SELECT e FROM h1) AND (SELECT count(*) FROM h1) < 5000), p3 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM h2) AND l_partkey NOT IN (SELECT p FROM p1 UNION ALL SELECT p FROM p2)), h3 AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p FROM p3) AND l_orderkey NOT IN (SELECT e FROM s UNION ALL SELECT e FROM h1 UNION ALL SELECT e FROM h2) AND (SELECT count(*) FROM h1) + (SELECT count(*) FROM h2) < 5000) SELECT e AS event_id FROM h1 UNION ALL SELECT e FROM h2 UNION ALL SELECT e FROM h3")
def dynamic_expansion_retries(spark, d):
    """One hop falls short of 5000 events at every size of these tables, so that further ones are tried, three at most."""
    b = bridge(spark, d)
    return graph.expand_until(b.filter("entity_id = 5").select("event_id"), b, "event_id", "entity_id", 5000, 3)


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY text")
def keep_first_text(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY user_id")
def parsed_arguments(spark, d):
    """Call arguments in JSON, read with a schema."""
    rows = table(spark, d, "events").select("user_id", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"))


@query("SELECT c_custkey, c_mktsegment AS segment, CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'base' END AS tier FROM customer")
def metadata_merge(spark, d):
    old = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("tier"), F.lit("base"))
    new = F.when(F.col("c_acctbal") > 5000, F.create_map(F.lit("tier"), F.lit("gold")))
    return table(spark, d, "customer").select("c_custkey", store.merge_metadata(old, new).alias("m")).select("c_custkey", F.col("m.segment").alias("segment"), F.col("m.tier").alias("tier"))


@query("SELECT o_orderkey, strftime(CASE WHEN o_custkey % 10 = 0 OR o_orderstatus = 'F' THEN coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '2024-02-01') END, '%Y-%m-%d') AS archived_on FROM orders")
def archive_documents(spark, d):
    rows = table(spark, d, "orders").withColumn("archived_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return store.archive(rows, F.col("o_custkey") % 10 == 0, "2024-02-01").select("o_orderkey", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"))


@query("SELECT o_custkey AS document_id, o_orderkey AS event_id, count(DISTINCT p_partkey) AS n_entities, coalesce(string_agg(DISTINCT p_name, ',' ORDER BY p_name), '') AS names FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def events_by_document(spark, d):
    named = bridge(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), "p_name"), "entity_id")
    per = named.groupBy("event_id").agg(F.count("*").alias("n_entities"), F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("names"))
    events = table(spark, d, "orders").filter("o_orderstatus != 'F'").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("event_id"))
    return events.join(per, "event_id", "left").select("document_id", "event_id", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("names", F.lit("")).alias("names"))


@query("SELECT o_custkey AS document_id, l_partkey AS entity_id, count(DISTINCT o_orderkey) AS n_events FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1, 2")
def entities_by_document(spark, d):
    events = table(spark, d, "orders").filter("o_orderstatus != 'F'").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("event_id"))
    return bridge(spark, d).join(events, "event_id").groupBy("document_id", "entity_id").agg(F.count("*").alias("n_events"))


@query("WITH b AS (SELECT DISTINCT l_partkey AS entity_id, l_orderkey AS event_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 3)) SELECT entity_id, event_id, count(*) OVER (PARTITION BY entity_id) AS n_events, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY o_orderdate, event_id) AS INTEGER) AS position FROM b JOIN orders ON event_id = o_orderkey JOIN customer ON o_custkey = c_custkey")
def entity_detail(spark, d):
    asked = table(spark, d, "part").filter("p_size = 3").select(F.col("p_partkey").alias("entity_id"))
    b = bridge(spark, d).join(asked, "entity_id", "left_semi").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_custkey", "o_orderdate"), "event_id")
    b = b.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    of = Window.partitionBy("entity_id")
    return b.select("entity_id", "event_id", F.count("*").over(of).alias("n_events"), F.row_number().over(of.orderBy("o_orderdate", "event_id")).alias("position"))


@query("SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def documents_by_source(spark, d):
    return store.latest(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 5)


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def session_detail(spark, d):
    got = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("m"), F.count("*").alias("n"))
    return got.select("conv_id", F.array_join("m.role", ">").alias("roles"), "n")


@query("SELECT conv_id, turn, CAST(greatest(ceil(length(text) / 24), 1) AS INTEGER) AS n, substr(text, 1, 24) AS first FROM conversations")
def stream_slices(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", text.slices(F.col("text"), 24).alias("s"))
    return s.select("conv_id", "turn", F.size("s").alias("n"), F.element_at("s", 1).alias("first"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE, 8))), 6) AS total FROM embeddings")
def vector_literal(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(vector.literal("embedding"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY 1, 2")
def log_import(spark, d):
    """Of log entries that come again, the first."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {TOKENS} AS t FROM documents) WHERE contains(t, ' the ') AND (contains(t, ' is and ') OR contains(t, ' on ')) AND NOT contains(t, ' queue ')")
def websearch_match(spark, d):
    return table(spark, d, "documents").filter(fulltext.matches(F.col("text"), 'the "is and" or on -queue')).select("doc_id")


@query(f"SELECT doc_id, round(r, 6) AS rerank FROM (SELECT doc_id, len(list_filter(['queue', 'this', 'are', 'une'], lambda q: list_contains(first10, q))) + n_chars / 1000000 AS r FROM (SELECT doc_id, n_chars, ws, list_transform(list_sort(list_transform(list_distinct(ws), lambda w: [lpad(CAST(list_position(ws, w) AS VARCHAR), 9, '0'), w]))[1:10], lambda p: p[2]) AS first10 FROM (SELECT doc_id, n_chars, {KEYWORDS.format(t='text')} AS ws FROM documents))) ORDER BY r DESC, doc_id LIMIT 25")
def keyword_rerank(spark, d):
    scored = table(spark, d, "documents").withColumn("score", F.col("n_chars") / 1000000)
    return search.keyword_rerank(scored, "queue this are une", "text", "score", "doc_id", 25).select("doc_id", F.round("rerank", 6).alias("rerank"))


W_Q = "'red small'"
W_NEAR = ", ".join(sql_similarity(c, W_Q) for c in ("p_name", "p_brand", "p_type"))
W_HIT = "(contains(lower({c}), 'red') OR contains(lower({c}), 'small'))"
W_ENDS, W_LABEL = W_HIT.format(c="p_name || ' ' || p_brand"), W_HIT.format(c="p_type")


@query(f"SELECT p_partkey, round(s, 6) AS score FROM (SELECT p_partkey, p_retailprice, greatest({W_NEAR}) AS near, {W_ENDS} OR {W_LABEL} AS hit, greatest({W_NEAR}, CASE WHEN {W_ENDS} THEN 1.0 END, CASE WHEN {W_LABEL} THEN 0.8 END) AS s FROM part) WHERE near >= 0.3 OR hit ORDER BY s DESC, p_retailprice DESC, p_partkey LIMIT 40")
def edge_text_search(spark, d):
    found = search.edge_scores(table(spark, d, "part"), "red small", "p_name", "p_brand", "p_type")
    return found.orderBy(F.desc("score"), F.desc("p_retailprice"), "p_partkey").limit(40).select("p_partkey", F.round("score", 6).alias("score"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{Han}')) AS INTEGER) AS han, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS INTEGER) AS latin, len(regexp_extract_all(text, '\p{Han}')) > 2 * len(regexp_extract_all(text, '[A-Za-z]+')) AS mostly_han FROM documents")
def script_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", kinds.han_count(t).alias("han"), kinds.latin_words(t).alias("latin"), kinds.mostly_han(t).alias("mostly_han"))


@query(f"WITH n AS (SELECT s_name AS name FROM supplier UNION ALL SELECT p_name || CASE p_size % 3 WHEN 0 THEN ' Corp' WHEN 1 THEN ' platform' ELSE '' END FROM part) SELECT name, CASE WHEN regexp_matches(name, '[0-9]') THEN 'metric' WHEN regexp_matches(name, '(?i){kinds.ORGANIZATION}') THEN 'organization' WHEN regexp_matches(name, '(?i){kinds.PRODUCT}') THEN 'product' ELSE 'subject' END AS kind, count(*) AS n FROM n GROUP BY 1, 2")
def entity_types(spark, d):
    ending = F.when(F.col("p_size") % 3 == 0, " Corp").when(F.col("p_size") % 3 == 1, " platform").otherwise("")
    names = table(spark, d, "supplier").select(F.col("s_name").alias("name")).union(table(spark, d, "part").select(F.concat("p_name", ending)))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", kinds.entity_type(F.col("name")).alias("kind"), "n")


@query("SELECT p_brand AS document, p_type AS object, round(greatest(0, least(0.9, 0.55 + least(0.3, 0.04 * count(*)) + least(0.1, 0.02 * avg(p_size) / 10))), 6) AS confidence FROM part GROUP BY 1, 2")
def profile_confidence(spark, d):
    got = table(spark, d, "part").groupBy(F.col("p_brand").alias("document"), F.col("p_type").alias("object")).agg(F.count("*").alias("n"), F.avg("p_size").alias("size"))
    return got.select("document", "object", F.round(kinds.profile_confidence(F.col("n"), F.col("size") / 10), 6).alias("confidence"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), 'the') ORDER BY doc_id LIMIT 10 OFFSET 10")
def keyword_page(spark, d):
    return table(spark, d, "documents").filter(F.lower("text").contains("the")).orderBy("doc_id").offset(10).limit(10).select("doc_id", "source")


@query("SELECT CASE WHEN toxic = 1 THEN 'graph_path' WHEN toxic IS NOT NULL THEN 'knowledge_edge' ELSE 'vector' END AS recall, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def recall_types(spark, d):
    """Why a section was found: a path through its edges, an edge, or the vector search."""
    edges = table(spark, d, "labels").select("doc_id", "toxic")
    both = table(spark, d, "documents").select("doc_id").join(edges, "doc_id", "left")
    kind = F.when(F.col("toxic") == 1, "graph_path").when(F.col("toxic").isNotNull(), "knowledge_edge").otherwise("vector")
    return both.groupBy(kind.alias("recall")).agg(F.count("*").alias("n"))

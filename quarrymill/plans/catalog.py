"""Registered queries over the driver's tables, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import relations, text, vector
from ..operators import chunking, graph, search, store
from ..sources import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SIM = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
ARCHIVED_LABEL, ARCHIVED_REGION = 9, "AFRICA"


def live_chunks(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter((F.col("label") != ARCHIVED_LABEL) & F.col("embedding").isNotNull())


@query(f"SELECT e.vec_id, e.label, round({SIM}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label <> 9 ORDER BY {SIM} DESC, e.vec_id LIMIT 10")
def vector_topk_chunks(spark, d):
    q = search.query_vector(table(spark, d, "embeddings"), "vec_id", 0)
    return search.vector_topk(live_chunks(spark, d), q, 10, "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {SIM} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE e.label <> 9 ORDER BY s DESC, e.vec_id LIMIT 20) WHERE s >= 0.4")
def vector_topk_threshold(spark, d):
    q = search.query_vector(table(spark, d, "embeddings"), "vec_id", 3)
    return search.vector_topk(live_chunks(spark, d), q, 20, "vec_id", threshold=0.4).select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, round({SIM}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 5) q WHERE e.vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY {SIM} DESC, e.vec_id LIMIT 30")
def coarse_rank_candidates(spark, d):
    rows = table(spark, d, "embeddings")
    among = rows.join(table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return search.vector_topk(among, search.query_vector(rows, "vec_id", 5), 30, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT query_id, vec_id, rank, score FROM (SELECT q.vec_id AS query_id, e.vec_id, round({SIM}, 6) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.label <> 9) WHERE rank <= 5")
def multi_query_entity_recall(spark, d):
    asked = table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return search.multi_topk(live_chunks(spark, d), asked, 5, "vec_id", "query_id").select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings")
def vector_normalize(spark, d):
    rows = table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(vector.norm("embedding"), 6).alias("norm"), F.round(F.element_at(vector.normalized("embedding"), 1), 6).alias("first"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) AS shown FROM embeddings")
def embedding_preview(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", vector.preview("embedding").alias("p"))
    return p.select("vec_id", "p.dimensions", F.round(F.aggregate(vector.doubles("p.values"), F.lit(0.0), lambda s, x: s + x), 6).alias("shown"))


def live_events(spark, d) -> DataFrame:
    """Orders that aren't deleted, of customers and regions that aren't archived."""
    sources = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter(F.col("r_name") != ARCHIVED_REGION)), F.col("n_regionkey") == F.col("r_regionkey"))
    documents = table(spark, d, "customer").filter("c_acctbal >= 0").join(F.broadcast(sources), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "orders").filter("o_orderstatus != 'F'").join(documents, F.col("o_custkey") == F.col("c_custkey"))


LIVE = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus <> 'F' AND c_acctbal >= 0 AND r_name <> 'AFRICA'"


@query(f"SELECT n_name, count(*) AS n_events, round(sum(o_totalprice), 2) AS total FROM {LIVE} GROUP BY n_name")
def live_event_chain(spark, d):
    return live_events(spark, d).groupBy("n_name").agg(F.count("*").alias("n_events"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_orderkey IN (SELECT o_orderkey FROM {LIVE}))")
def semi_join_live_entities(spark, d):
    live = table(spark, d, "lineitem").join(live_events(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return table(spark, d, "part").join(live, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query(f"SELECT DISTINCT l_orderkey AS event_id FROM lineitem WHERE l_partkey IN (1, 2, 3, 4, 5) AND l_orderkey IN (SELECT o_orderkey FROM {LIVE}) AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_partkey = 7)")
def anti_join_excluded(spark, d):
    lines = table(spark, d, "lineitem")
    excluded = lines.filter("l_partkey = 7").select("l_orderkey")
    hit = lines.filter(F.col("l_partkey").isin(1, 2, 3, 4, 5)).join(excluded, "l_orderkey", "left_anti")
    return hit.join(live_events(spark, d).select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("event_id")).distinct()


@query("SELECT r.id AS missing FROM (SELECT DISTINCT label AS id FROM embeddings UNION SELECT 20 + label FROM embeddings) r LEFT JOIN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA') n ON r.id = n.n_nationkey WHERE n.n_nationkey IS NULL")
def access_check_missing(spark, d):
    labels = table(spark, d, "embeddings")
    asked = labels.select(F.col("label").alias("id")).union(labels.select(F.col("label") + 20)).distinct()
    open_ = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").filter(F.col("r_name") != ARCHIVED_REGION)), F.col("n_regionkey") == F.col("r_regionkey"))
    return asked.join(F.broadcast(open_), F.col("id") == F.col("n_nationkey"), "left_anti").select(F.col("id").alias("missing"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) c ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_acctbal >= 0")
def left_join_optional_doc(spark, d):
    some = table(spark, d, "customer").filter("c_custkey % 3 = 0")
    return table(spark, d, "orders").join(some, F.col("o_custkey") == F.col("c_custkey"), "left").filter("c_custkey is null or c_acctbal >= 0").select("o_orderkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE CAST(doc_id AS VARCHAR) > '150' ORDER BY CAST(doc_id AS VARCHAR) LIMIT 50")
def keyset_page(spark, d):
    docs = table(spark, d, "documents").withColumn("id", F.col("doc_id").cast("string"))
    return docs.filter("id > '150'").orderBy("id").limit(50).select("doc_id", "source")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_discount, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 300")
def status_case_order(spark, d):
    order = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "R", 2).otherwise(3)
    return table(spark, d, "lineitem").orderBy(order, "l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(300).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT n_nationkey AS source_id, count(DISTINCT c_custkey) AS n_documents, count(DISTINCT o_orderkey) AS n_events, count(DISTINCT l_partkey) AS n_entities, count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS n_deleted FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY n_nationkey")
def project_stats(spark, d):
    """Each measure is an aggregate of its own, so no fan-out of one table multiplies another."""
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("source_id"))
    events = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").join(docs, F.col("o_custkey") == F.col("c_custkey"))
    entities = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(events.select("o_orderkey", "source_id"), F.col("l_orderkey") == F.col("o_orderkey")).select("source_id", "l_partkey").distinct()
    parts = [
        docs.groupBy("source_id").agg(F.count_distinct("c_custkey").alias("n_documents")),
        events.groupBy("source_id").agg(F.count_distinct("o_orderkey").alias("n_events"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("n_deleted")),
        entities.groupBy("source_id").agg(F.count("*").alias("n_entities")),
    ]
    out = table(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"))
    for p in parts:
        out = out.join(p, "source_id", "left")
    return out.select("source_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_events", "n_entities", "n_deleted")))


@query("SELECT l_returnflag AS relation, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_active, round(avg(1 - 4 * l_discount), 6) AS confidence, round(avg(l_quantity), 6) AS quality FROM lineitem GROUP BY l_returnflag")
def relation_stats_by_type(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("relation")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_active"), F.round(F.avg(1 - 4 * F.col("l_discount")), 6).alias("confidence"), F.round(F.avg("l_quantity"), 6).alias("quality"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'O') AS n_auto, count(*) FILTER (WHERE l_returnflag = 'A') AS n_confirmed, count(*) FILTER (WHERE l_returnflag = 'R') AS n_rejected, count(*) FILTER (WHERE 1 - 4 * l_discount < 0.65) AS n_low FROM lineitem")
def relation_summary(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "O").alias("n_auto"), F.count_if(F.col("l_returnflag") == "A").alias("n_confirmed"), F.count_if(F.col("l_returnflag") == "R").alias("n_rejected"), F.count_if(1 - 4 * F.col("l_discount") < 0.65).alias("n_low"))


@query(f"SELECT l_partkey AS entity_id, count(DISTINCT l_orderkey) AS n_events FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM {LIVE}) GROUP BY l_partkey ORDER BY n_events DESC, entity_id LIMIT 50")
def graph_entities(spark, d):
    live = table(spark, d, "lineitem").join(live_events(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return live.groupBy(F.col("l_partkey").alias("entity_id")).agg(F.count_distinct("l_orderkey").alias("n_events")).orderBy(F.desc("n_events"), "entity_id").limit(50)


@query("SELECT l_orderkey AS event_id, string_agg(p_name || ':' || p_partkey, '|' ORDER BY p_name, p_partkey) AS entities FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def graph_events_array_agg(spark, d):
    pairs = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    found = pairs.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct("p_name", "p_partkey"))).alias("e"))
    return found.select("event_id", F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["p_name"], x["p_partkey"])), "|").alias("entities"))


@query("SELECT o_orderkey AS event_id, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS entity_ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def events_with_entities(spark, d):
    bridge = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("entity")).distinct()
    return table(spark, d, "orders").join(bridge, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderkey").alias("event_id")).agg(F.array_join(F.array_sort(F.collect_list("entity")), ",").alias("entity_ids"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def log_status_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_distinct("user_id").alias("n_users"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_id > 500 ORDER BY event_id DESC LIMIT 500")
def log_ring_buffer(spark, d):
    return table(spark, d, "events").filter("event_id > 500").orderBy(F.desc("event_id")).limit(500).select("event_id", "event_type", "user_id")


def sql_replace(expr: str, *rules: tuple[str, str, str]) -> str:
    for pattern, to, flags in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{to}', '{flags}')"
    return expr


MARKDOWN = (("```.*?```", " ", "gs"), ("`([^`]+)`", r"\1", "g"), (r"!\[[^\]]*\]\([^)]*\)", " ", "g"), (r"\[([^\]]+)\]\([^)]*\)", r"\1", "g"), (r"(?m)^#{1,6}\s+", "", "g"), ("[*_~>#-]+", " ", "g"), (r"\s+", " ", "g"))


@query(f"SELECT page_id, trim({sql_replace('html', *MARKDOWN)}) AS plain FROM pages")
def strip_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", text.strip_markdown(F.col("html")).alias("plain"))


KEYWORDS = r"list_filter(string_split_regex(regexp_replace(lower({t}), '[^\p{{L}}\p{{N}}\s_-]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'for', 'with', 'from', 'that'))"


@query(f"WITH k AS (SELECT doc_id, {KEYWORDS.format(t='text')} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM k), f AS (SELECT doc_id, w, min(i) AS i FROM u GROUP BY doc_id, w), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f) SELECT doc_id, coalesce(s, '') AS keywords FROM documents LEFT JOIN (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS s FROM n WHERE n <= 10 GROUP BY doc_id) USING (doc_id)")
def local_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({t}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"
SIMILAR = "(len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))))"


def sql_similarity(a: str, b: str) -> str:
    return SIMILAR.format(a=TRI.format(t=a), b=TRI.format(t=b))


@query(f"SELECT p_partkey, round({sql_similarity('p_name', chr(39) + 'red wodget' + chr(39))}, 6) AS similarity FROM part")
def trigram_similarity(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.lit("red wodget")), 6).alias("similarity"))


@query("SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the ', ''))) / 4 AS BIGINT) AS n FROM documents")
def count_occurrences(spark, d):
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), "the ").alias("n"))


@query(r"SELECT doc_id, CASE WHEN length(s) <= 120 THEN s ELSE substr(s, 1, 119) || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents)")
def text_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", text.preview(F.col("text"), 120).alias("preview"))


TITLE_SQL = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), '`([^`]+)`', '\1', 'g'), '[#>*_\-\[\](){}]', ' ', 'g'), '\s+', ' ', 'g')), '^(please )?(could you|can you|would you|help me|tell me) ', '', 'i'), '^(please )?(explain|summarize|analyze) ', '', 'i'))"


@query(rf"SELECT conv_id, turn, CASE WHEN t = '' THEN 'New conversation' ELSE t END AS title FROM (SELECT conv_id, turn, array_to_string(list_filter(string_split(regexp_replace({TITLE_SQL}, '[?.!,;:]+$', ''), ' '), lambda w: w <> '')[1:8], ' ') AS t FROM conversations)")
def conversation_title(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.conversation_title(F.col("text")).alias("title"))


@query("SELECT conv_id, turn, substr(text, 1, 800) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def message_window(spark, d):
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(last)).filter("n <= 4").select("conv_id", "turn", F.substring("text", 1, 800).alias("text"))


@query("SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id HAVING list_contains(list(role), 'system')")
def sessions_containing(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.count("*").alias("n_turns")).filter(F.array_contains("roles", "system")).select("conv_id", "n_turns")


E_Q = "'red widget'"
E_SCORE = f"greatest({sql_similarity('p_name', E_Q)}, {sql_similarity('p_type', E_Q)}, CASE WHEN contains({E_Q}, lower(p_name)) THEN 1.0 END, CASE WHEN lower(p_name) = {E_Q} THEN 1.2 END, CASE WHEN contains(lower(p_name || ' ' || p_type), 'red') OR contains(lower(p_name || ' ' || p_type), 'widget') THEN 0.8 END)"


@query(f"SELECT p_partkey, p_name, round(s, 6) AS score FROM (SELECT *, {E_SCORE} AS s, {sql_similarity('p_name', E_Q)} AS a, {sql_similarity('p_type', E_Q)} AS b FROM part) WHERE a >= 0.3 OR b >= 0.3 OR contains({E_Q}, lower(p_name)) OR contains(lower(p_name || ' ' || p_type), 'red') OR contains(lower(p_name || ' ' || p_type), 'widget') ORDER BY s DESC, p_name, p_partkey LIMIT 20")
def entity_text_search(spark, d):
    found = search.entity_scores(table(spark, d, "part"), "red widget", "p_name", "p_type")
    return found.orderBy(F.desc("score"), "p_name", "p_partkey").limit(20).select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@query("SELECT doc_id, round(r, 6) AS rerank FROM (SELECT doc_id, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT + (contains(lower(text), 'the'))::INT + (contains(lower(text), 'queue'))::INT + n_chars / 1000000 AS r FROM documents) ORDER BY r DESC, doc_id LIMIT 25")
def lexical_rerank(spark, d):
    scored = table(spark, d, "documents").withColumn("score", F.col("n_chars") / 1000000)
    return search.lexical_rerank(scored, "the, and the queue", "text", "score", "doc_id", 25).select("doc_id", F.round("rerank", 6).alias("rerank"))


def bridge(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id")).distinct()


@query("WITH s AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey = 5), n AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM s)) SELECT DISTINCT l_orderkey AS event_id FROM lineitem WHERE l_partkey IN (SELECT p FROM n) AND l_orderkey NOT IN (SELECT e FROM s)")
def one_hop_events(spark, d):
    b = bridge(spark, d)
    seeds = b.filter("entity_id = 5").select("event_id").distinct()
    return graph.neighbours(graph.neighbours(seeds, b, "event_id", "entity_id"), b, "entity_id", "event_id", seeds)


@query("WITH s AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey = 5), p1 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM s)), h1 AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p FROM p1) AND l_orderkey NOT IN (SELECT e FROM s)), p2 AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey IN (SELECT e FROM h1) AND l_partkey NOT IN (SELECT p FROM p1)), h2 AS (SELECT DISTINCT l_orderkey AS e FROM lineitem WHERE l_partkey IN (SELECT p FROM p2) AND l_orderkey NOT IN (SELECT e FROM s) AND l_orderkey NOT IN (SELECT e FROM h1)) SELECT e AS event_id, 0 AS hop FROM s UNION ALL SELECT e, 1 FROM h1 UNION ALL SELECT e, 2 FROM h2")
def k_hop_expansion(spark, d):
    b = bridge(spark, d)
    return graph.expand(b.filter("entity_id = 5").select("event_id"), b, "event_id", "entity_id", 2)


def nation_edges(spark, d) -> DataFrame:
    """Trade between nations as knowledge edges: who supplies whom, by what share of lines was returned."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = lines.groupBy(F.col("s_nationkey").alias("subject"), F.col("c_nationkey").alias("object")).agg(F.avg(1 - 4 * F.col("l_discount")).alias("confidence"), F.avg(F.col("l_quantity") / 50).alias("quality"), F.count("*").alias("n"))
    return g.select((F.col("subject") * 100 + F.col("object")).alias("edge_id"), "subject", "object", "confidence", "quality", F.when(F.col("n") % 2 == 0, 0.08).otherwise(-0.08).alias("strength"))


EDGES = "e AS (SELECT s_nationkey * 100 + c_nationkey AS id, s_nationkey AS s, c_nationkey AS o, avg(1 - 4 * l_discount) AS c, avg(l_quantity / 50) AS q, CASE WHEN count(*) % 2 = 0 THEN 0.08 ELSE -0.08 END AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey < 8 AND c_nationkey < 8 GROUP BY s_nationkey, c_nationkey)"


@query(f"WITH RECURSIVE {EDGES}, p(nodes, ids, c, q, w, n) AS (SELECT [s, o], [id], c, q, w, 1 FROM e WHERE (s = 1 OR o = 1) AND s <> o UNION ALL SELECT list_append(nodes, e.o), list_append(ids, e.id), p.c + e.c, p.q + e.q, p.w + e.w, n + 1 FROM p JOIN e ON p.nodes[-1] = e.s WHERE n < 3 AND e.w > 0 AND NOT list_contains(nodes, e.o)) SELECT array_to_string(ids, '>') AS path, CAST(n AS INTEGER) AS depth, round(greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1))), 6) AS score FROM p")
def path_expansion_depth3(spark, d):
    """Only the edges among nations 0 to 7, as its SQL has it; path_expansion_all_nations searches the whole graph."""
    return nation_paths(spark, d, nation_edges(spark, d).filter("subject < 8 and object < 8"))


ALL_EDGES = "e AS (SELECT s_nationkey * 100 + c_nationkey AS id, s_nationkey AS s, c_nationkey AS o, avg(1 - 4 * l_discount) AS c, avg(l_quantity / 50) AS q, CASE WHEN count(*) % 2 = 0 THEN 0.08 ELSE -0.08 END AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY s_nationkey, c_nationkey)"


@query(f"WITH RECURSIVE {ALL_EDGES}, p(nodes, ids, c, q, w, n) AS (SELECT [s, o], [id], c, q, w, 1 FROM e WHERE (s = 1 OR o = 1) AND s <> o UNION ALL SELECT list_append(nodes, e.o), list_append(ids, e.id), p.c + e.c, p.q + e.q, p.w + e.w, n + 1 FROM p JOIN e ON p.nodes[-1] = e.s WHERE n < 3 AND e.w > 0 AND NOT list_contains(nodes, e.o)) SELECT array_to_string(ids, '>') AS path, CAST(n AS INTEGER) AS depth, round(greatest(0, least(1, 0.45 * c / n + 0.45 * q / n + w - 0.03 * (n - 1))), 6) AS score FROM p")
def path_expansion_all_nations(spark, d):
    return nation_paths(spark, d, nation_edges(spark, d))


def nation_paths(spark, d, edges: DataFrame) -> DataFrame:
    """The paths of up to three edges from nation 1, scored."""
    seeds = table(spark, d, "nation").filter("n_nationkey = 1").select(F.col("n_nationkey").alias("node"))
    found = graph.paths(graph.settle(edges), seeds, 3)
    return found.select(F.array_join(F.col("steps.edge_id"), ">").alias("path"), F.size("steps").alias("depth"), F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT p_partkey AS id, p_brand AS source, p_size AS s, lower(p_name) AS o, 0.5 + p_size / 100 AS c FROM part) SELECT r.id AS r_edge, m.id AS m_edge, round(greatest(0.5, 0.86 * least(r.c, m.c)), 6) AS confidence FROM e r JOIN e m ON r.source = m.source AND r.s % 5 = 0 AND m.s % 5 = 1 AND r.s <> m.s AND r.id <> m.id AND (r.o = m.o OR contains(r.o, m.o) OR contains(m.o, r.o))")
def alignment_theta_join(spark, d):
    """Only parts whose size leaves 0 or 1 modulo 5, as its SQL has it; alignment_all_parts puts every part on a side."""
    edges = part_edges(spark, d)
    return graph.align(edges.filter("subject % 5 = 0"), edges.filter("subject % 5 = 1")).select("r_edge", "m_edge", F.round("confidence", 6).alias("confidence"))


def part_edges(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("edge_id"), F.col("p_brand").alias("source"), F.col("p_size").alias("subject"), F.col("p_name").alias("object"), (0.5 + F.col("p_size") / 100).alias("confidence"), F.coalesce(F.col("p_type").isin("SMALL", "MEDIUM", "LARGE"), F.lit(False)).alias("required"))


@query("WITH e AS (SELECT p_partkey AS id, p_brand AS source, p_size AS s, lower(p_name) AS o, 0.5 + p_size / 100 AS c, coalesce(p_type IN ('SMALL', 'MEDIUM', 'LARGE'), false) AS required FROM part) SELECT r.id AS r_edge, m.id AS m_edge, round(greatest(0.5, 0.86 * least(r.c, m.c)), 6) AS confidence FROM e r JOIN e m ON r.source = m.source AND r.required AND NOT m.required AND r.s <> m.s AND r.id <> m.id AND (r.o = m.o OR contains(r.o, m.o) OR contains(m.o, r.o))")
def alignment_all_parts(spark, d):
    """Parts of a size type are requirements, all others materials."""
    edges = part_edges(spark, d)
    return graph.align(edges.filter("required"), edges.filter("not required")).select("r_edge", "m_edge", F.round("confidence", 6).alias("confidence"))


@query("SELECT l_suppkey AS subject, l_partkey AS object, l_returnflag AS relation, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_discount, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def dedupe_keep_max(spark, d):
    best = store.latest(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"], ["l_discount", "l_orderkey", "l_linenumber"])
    return best.select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("object"), F.col("l_returnflag").alias("relation"), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1, (1 - 4 * l_discount) + CASE WHEN l_returnflag = 'A' THEN 0.12 ELSE -0.08 END + CASE WHEN l_linestatus = 'O' THEN 0.06 ELSE -0.04 END + CASE WHEN length(p_name) >= 8 THEN 0.08 ELSE -0.25 END + CASE WHEN contains(p_name, 'red') THEN 0.06 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0.12 ELSE 0 END + CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 0 END + CASE WHEN l_returnflag = 'N' THEN -0.18 ELSE 0 END)), 6) AS score FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey")
def score_relation(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), c("l_partkey") == c("p_partkey")).join(table(spark, d, "orders"), c("l_orderkey") == c("o_orderkey"))
    status = F.when(c("o_orderstatus") == "F", "CONFIRMED").when(c("o_orderstatus") == "P", "REJECTED").otherwise("AUTO")
    score = relations.relation_score(1 - 4 * c("l_discount"), c("l_returnflag") == "A", c("l_linestatus") == "O", c("p_name"), c("p_name").contains("red"), status, c("l_returnflag") == "N")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query("WITH n AS (SELECT p_brand AS source, p_type AS type, lower(trim(p_name)) AS key, arg_max(p_name, p_partkey) AS name, arg_min(p_brand || ' ' || p_size, p_partkey) AS description FROM part WHERE p_partkey % 2 = 1 GROUP BY 1, 2, 3), o AS (SELECT DISTINCT p_brand AS source, p_type AS type, lower(trim(p_name)) AS key, upper(p_name) AS name, CASE WHEN p_brand LIKE '%1' THEN '' ELSE 'kept' END AS description FROM part WHERE p_partkey % 2 = 0) SELECT source, type, key, coalesce(n.name, o.name) AS name, coalesce(nullif(o.description, ''), n.description) AS description FROM o FULL JOIN n USING (source, type, key)")
def upsert_entities(spark, d):
    part = table(spark, d, "part").withColumnsRenamed({"p_brand": "source", "p_type": "type"})
    old = part.filter("p_partkey % 2 = 0").select("source", "type", F.upper("p_name").alias("name"), F.when(F.col("source").endswith("1"), "").otherwise("kept").alias("description")).distinct()
    new = part.filter("p_partkey % 2 = 1").select("source", "type", F.col("p_name").alias("name"), F.concat_ws(" ", "source", "p_size").alias("description"), F.col("p_partkey").alias("ordinal"))
    return store.upsert_entities(old, new)


@query("WITH l AS (SELECT l_suppkey AS subject, l_returnflag AS relation, l_partkey AS object, l_orderkey, 1 - 4 * l_discount AS c, l_quantity / 40 AS q FROM lineitem), o AS (SELECT subject, relation, object, max(c) AS c, max(least(q, 1)) AS q, CASE WHEN relation = 'A' THEN 'CONFIRMED' ELSE 'REJECTED' END AS status FROM l WHERE l_orderkey % 2 = 0 GROUP BY 1, 2, 3), n AS (SELECT subject, relation, object, max(greatest(0, least(1, c))) AS c, max(greatest(0, least(1, q))) AS q FROM l WHERE l_orderkey % 2 = 1 GROUP BY 1, 2, 3) SELECT subject, relation, object, round(greatest(o.c, n.c), 6) AS confidence, round(greatest(o.q, n.q), 6) AS quality, CASE WHEN n.c IS NOT NULL AND coalesce(o.status, '') <> 'CONFIRMED' THEN 'AUTO' ELSE o.status END AS status FROM o FULL JOIN n USING (subject, relation, object)")
def upsert_edges(spark, d):
    c = F.col
    rows = table(spark, d, "lineitem").select(c("l_suppkey").alias("subject"), c("l_returnflag").alias("relation"), c("l_partkey").alias("object"), "l_orderkey", (1 - 4 * c("l_discount")).alias("confidence"), (c("l_quantity") / 40).alias("quality"))
    old = rows.filter("l_orderkey % 2 = 0").groupBy("subject", "relation", "object").agg(F.max("confidence").alias("confidence"), F.max(F.least("quality", F.lit(1.0))).alias("quality"))
    old = old.withColumn("status", F.when(c("relation") == "A", "CONFIRMED").otherwise("REJECTED"))
    got = store.upsert_edges(old, rows.filter("l_orderkey % 2 = 1"))
    return got.select("subject", "relation", "object", F.round("confidence", 6).alias("confidence"), F.round("quality", 6).alias("quality"), "status")


@query("WITH lost AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0), keep AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM lost)), touched AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM lost)) SELECT p_partkey AS entity_id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM touched WHERE l_partkey NOT IN (SELECT l_partkey FROM keep))")
def delete_document_graph(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"))
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("document_id"))
    entities = table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"))
    return store.delete_documents(docs, events, bridge(spark, d), entities, docs.filter("document_id % 10 = 0"))["entities"]


@query("WITH t AS (SELECT p_brand AS name, p_type AS type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1, 2), m AS (SELECT name, arg_max(type, n * 10000000000 - first) AS main_type FROM t GROUP BY name), g AS (SELECT p_brand AS name, CAST(sum(p_size) AS BIGINT) AS count, round(max(p_retailprice), 2) AS top, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS aliases, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1) SELECT name, count, top, aliases, n_names, main_type FROM g JOIN m USING (name)")
def domain_analysis(spark, d):
    part = table(spark, d, "part").withColumnRenamed("p_brand", "name")
    types = part.groupBy("name", "p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).groupBy("name").agg(F.max_by("p_type", F.struct("n", -F.col("first"))).alias("main_type"))
    got = part.groupBy("name").agg(F.sum("p_size").alias("count"), F.round(F.max("p_retailprice"), 2).alias("top"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("aliases"), F.count_distinct("p_name").alias("n_names"))
    return got.join(types, "name")


@query("SELECT p_partkey, p_name, CAST(list_position([77, 3, 150, 12, 9], p_partkey) AS INTEGER) AS position FROM part WHERE p_partkey IN (77, 3, 150, 12, 9) ORDER BY position LIMIT 4")
def entity_lookup_by_ids(spark, d):
    asked = [77, 3, 150, 12, 9]
    at = F.array_position(F.array(*(F.lit(x).cast("long") for x in asked)), F.col("p_partkey")).cast("int")
    return table(spark, d, "part").filter(F.col("p_partkey").isin(asked)).withColumn("position", at).orderBy("position").limit(4).select("p_partkey", "p_name", "position")


@query(r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM documents), r AS (SELECT doc_id, ws, unnest(range(0, 1 + CAST(greatest(ceil((len(ws) - 200) / 160), 0) AS BIGINT))) AS rank FROM w WHERE len(ws) > 0) SELECT doc_id, CAST(rank AS INTEGER) AS rank, array_to_string(ws[rank * 160 + 1 : rank * 160 + 200], ' ') AS content FROM r")
def chunk_windows(spark, d):
    return chunking.word_windows(table(spark, d, "documents"), 200, 40)


@query("SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE quality = 0) AS n_rejected, count(*) FILTER (WHERE toxic = 1) AS n_disabled, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def review_status_by_source(spark, d):
    both = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return both.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(F.col("quality") == 0).alias("n_rejected"), F.count_if(F.col("toxic") == 1).alias("n_disabled"), F.sum("n_chars").alias("n_chars"))

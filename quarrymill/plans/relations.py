"""Relations drawn from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extraction, kinds, ontology, profiles, relation_text, text
from ..operators import graph, objects
from ..sources import table
from .catalog import query
from .extraction import KIND, NOISE
from .service import ENTITY

c = F.col
#: The tables have no Han text, so their rules go by the prose they have; the default rules are tested on fixtures.
def word(w: str) -> str:
    """A word between other characters than ASCII letters."""
    return f"(^|[^A-Za-z])({w})([^A-Za-z]|$)"


RULES = (
    relation_text.Rule(None, ("[0-9]",), subject="metric"),
    relation_text.Rule("REQUIRES", (word("to"),), "subject"),
    relation_text.Rule("CAUSES_RISK", (word("of"), word("in"))),
    relation_text.Rule("SIMILAR_TO", (word("is"),)),
    relation_text.Rule("PROVES", (word("the|und"),)),
    relation_text.Rule("CONTAINS", (word("and|der|les|el"),)),
)
LEAST = {"SIMILAR_TO": 0.6}


def sql_rules() -> str:
    """The CASE of relation_text.predicate over stype, otype and evidence."""
    cases = []
    for r in RULES:
        tests = [("evidence", p) for p in r.evidence] + [("stype || otype || evidence", r.around), ("stype", r.subject), ("otype", r.object)]
        fits = " AND ".join(f"regexp_matches({of}, '{p}')" for of, p in tests if p)
        cases.append(f"WHEN {fits} THEN " + (f"'{r.kind}'" if r.kind else "NULL"))
    return "CASE " + " ".join(cases) + " END"


def sql_of(kind: str, field: int) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{r[0]}' THEN {r[field]}" for r in ontology.RELATIONS) + " END"


MARKS = "。！？.!?；;"


@query(rf"""
WITH m AS (SELECT doc_id, w AS name, min(pos) AS pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{ENTITY}') AS ws FROM documents)) GROUP BY 1, 2),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 12),
e AS (SELECT doc_id, name, {KIND} AS type, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {KIND} <> 'subject' THEN 8 ELSE 0 END + CASE WHEN length(name) BETWEEN 4 AND 12 THEN 4 ELSE 0 END - CASE WHEN regexp_matches(name, '^[A-Za-z0-9_-]+$') THEN 3 ELSE 0 END DESC, pos) AS i
  FROM n WHERE NOT ({NOISE})),
s AS (SELECT doc_id, k, said FROM (SELECT doc_id, unnest(ss) AS said, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^{MARKS}\n]*[{MARKS}]|[^{MARKS}\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents))),
h AS (SELECT e.doc_id, e.i, k, said FROM e JOIN s ON s.doc_id = e.doc_id AND contains(said, name)),
b AS (SELECT x.doc_id, x.i AS sa, y.i AS oa, arg_min(x.said, x.k) AS said FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i <> y.i WHERE length(x.said) <= 260 GROUP BY 1, 2, 3),
a AS (SELECT doc_id, i AS sa, arg_min(said, k) AS said FROM h WHERE length(said) <= 220 GROUP BY 1, 2),
p AS (SELECT x.doc_id, x.name AS subject, y.name AS object, x.type AS stype, y.type AS otype, x.i AS sa, y.i AS oa, coalesce(b.said, a.said) AS evidence
  FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.i <> y.i LEFT JOIN b ON b.doc_id = x.doc_id AND b.sa = x.i AND b.oa = y.i LEFT JOIN a ON a.doc_id = x.doc_id AND a.sa = x.i WHERE coalesce(b.said, a.said) IS NOT NULL),
r AS (SELECT *, {sql_rules()} AS predicate FROM p),
g AS (SELECT *, round(greatest(0, least(1, 0.68 + CASE WHEN {sql_of('predicate', 2)} THEN 0.12 ELSE -0.08 END + CASE WHEN {sql_of('predicate', 3)} THEN 0.06 ELSE -0.04 END + CASE WHEN length(evidence) >= 8 THEN 0.08 ELSE -0.25 END
  + CASE WHEN contains(evidence, subject) AND contains(evidence, object) THEN 0.06 ELSE 0 END)), 9) AS quality FROM r WHERE 0.68 >= CASE WHEN predicate = 'SIMILAR_TO' THEN 0.6 ELSE {sql_of('predicate', 4)} END)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY -quality, sa, oa) AS INTEGER) AS position, subject, predicate, object, round(quality, 6) AS quality, instr(text, evidence) - 1 AS start, instr(text, evidence) - 1 + length(evidence) AS "end"
FROM g JOIN documents USING (doc_id) QUALIFY position <= 12""")
def local_relations(spark, d):
    """Up to twelve relations of each document between its cleaned entities, with where the evidence stands."""
    names = F.transform(extraction.clean_entities(text.named_entities(c("text"), 12), kinds.mostly_han(c("text"))), lambda e: F.struct(e["name"].alias("name"), e["kind"].alias("type")))
    rows = table(spark, d, "documents").select("doc_id", "text", names.alias("names"))
    rows = rows.select("doc_id", F.posexplode(relation_text.extracted(c("text"), c("names"), RULES, LEAST)).alias("at", "r"))
    return rows.select("doc_id", (c("at") + 1).alias("position"), "r.subject", "r.predicate", "r.object", F.round("r.quality", 6).alias("quality"), "r.start", "r.end")


#: Endings of Latin names, as the tables have no Han text.
GROUPS = (objects.Group("process", "process", ("tion", "ing")), objects.Group("requirement", "requirement", ("keit", "ble")), objects.Group("data_object", "data object", ("elle", "ing")))
ENDINGS = ", ".join(f"({n}, '{g.type}', {k}, '{e}')" for n, g in enumerate(GROUPS) for k, e in enumerate(g.endings))


@query(rf"""
WITH g(n, type, k, ending) AS (VALUES {ENDINGS}),
s AS (SELECT doc_id, trim(x) AS p, i FROM (SELECT doc_id, unnest(ps) AS x, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\s+', ' ', 'g'), '[。！？；;，,、\n\r\t]') AS ps FROM documents))),
t AS (SELECT doc_id, n, i, k, type, regexp_extract(regexp_extract(p, '^(.*' || ending || ')', 1), '[A-Za-z0-9_-]+$') AS token FROM s JOIN g ON contains(p, ending) WHERE length(p) BETWEEN 2 AND 40),
m AS (SELECT *, trim(right(token, 12)) AS name FROM t),
c AS (SELECT doc_id, type, arg_min(name, m.n * 10000000000 + i * 100 + k) AS name, count(*) AS n, min(m.n) AS place FROM m WHERE length(name) >= 2 AND regexp_matches(name, '[A-Za-z]{{3,}}') GROUP BY doc_id, type, lower(name))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, CASE WHEN length(name) BETWEEN 4 AND 12 THEN 2 ELSE 0 END DESC, name, place) AS INTEGER) AS position, name, type, n AS count FROM c QUALIFY position <= 24""")
def domain_objects(spark, d):
    """Things that each document names, by how their words end."""
    found = objects.domain_objects(table(spark, d, "documents"), "doc_id", "text", groups=GROUPS)
    return found.select(c("id").alias("doc_id"), "position", "name", "type", "count")


TURN_NAMES = f"(SELECT conv_id, turn, w AS name, min(pos) AS pos FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '{ENTITY}') AS ws FROM conversations)) GROUP BY conv_id, turn, w QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(pos)) <= 12)"


@query(f"""
WITH n AS (SELECT *, {KIND} AS type FROM {TURN_NAMES}),
o AS (SELECT conv_id, name, type, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM n WHERE turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = n.conv_id)),
m AS (SELECT c.conv_id, c.turn, name, type, i FROM conversations c JOIN o USING (conv_id) WHERE contains(text, name) OR contains(text, lower(name)) QUALIFY row_number() OVER (PARTITION BY c.conv_id, c.turn, type, lower(name) ORDER BY i) = 1),
w AS (SELECT conv_id, turn, name, type, pos, EXISTS (SELECT 1 FROM m WHERE m.conv_id = n.conv_id AND m.turn = n.turn) AS led, EXISTS (SELECT 1 FROM m WHERE m.conv_id = n.conv_id AND m.turn = n.turn AND m.type = n.type AND lower(m.name) = lower(n.name)) AS known FROM n),
s AS (SELECT * FROM w WHERE led AND NOT known AND type NOT IN ('subject', 'metric', 'product') AND regexp_matches(name, '(tion|ing|er)$') QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) <= 3),
e AS (SELECT conv_id, turn, name, i AS x FROM m UNION ALL SELECT conv_id, turn, name, 1000 + pos FROM s UNION ALL SELECT conv_id, turn, name, pos FROM w WHERE NOT led),
r AS (SELECT c.conv_id, c.turn, a.i, a.name || '>' || b.name AS r FROM conversations c JOIN o a USING (conv_id) JOIN o b ON b.conv_id = a.conv_id AND b.i = a.i + 1
  WHERE (c.conv_id, c.turn, a.name) IN (SELECT (conv_id, turn, name) FROM e) AND (c.conv_id, c.turn, b.name) IN (SELECT (conv_id, turn, name) FROM e)),
en AS (SELECT conv_id, turn, string_agg(name, '|' ORDER BY x) AS entities FROM e GROUP BY 1, 2),
rn AS (SELECT conv_id, turn, string_agg(r, '|' ORDER BY i) AS relations FROM r GROUP BY 1, 2)
SELECT conv_id, turn, coalesce(entities, '') AS entities, coalesce(relations, '') AS relations FROM conversations LEFT JOIN en USING (conv_id, turn) LEFT JOIN rn USING (conv_id, turn)""")
def profiled_events(spark, d):
    """Turns as events of their conversation: which objects of its first turn each names, what else supports them, and the profile's relations that hold."""
    named = F.transform(text.named_entities(c("text"), 12), lambda n: F.struct(n.alias("name"), kinds.entity_type(n).alias("type"), F.lit("").alias("description")))
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text", named.alias("own"))
    profile = turns.groupBy("conv_id").agg(F.min_by("own", "turn").alias("first"))  # one row a conversation
    objects_ = F.transform("first", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description"), F.array(F.lower(x["name"])).alias("aliases")))
    pairs = F.transform(F.slice("first", F.lit(1), F.greatest(F.size("first") - 1, F.lit(0))), lambda x, i: F.struct(x["name"].alias("source"), F.get(c("first"), i + 1)["name"].alias("target")))
    rows = turns.join(profile.select("conv_id", objects_.alias("objects"), pairs.alias("pairs")), "conv_id")
    rows = rows.withColumn("found", profiles.entities(c("text"), c("objects"), c("own"), "(tion|ing|er)$"))
    names = F.array_join(F.transform("found", lambda x: x["name"]), "|")
    held = F.array_join(F.transform(profiles.relations_for(c("pairs"), c("found")), lambda r: F.concat(r["source"], F.lit(">"), r["target"])), "|")
    return rows.select("conv_id", "turn", names.alias("entities"), held.alias("relations"))


@query(f"""
WITH e AS (SELECT p_partkey AS id, p_brand AS source, p_size AS s, 'lot ' || p_size AS sn, lower(p_name) AS o, CASE WHEN p_type = 'PROMO' THEN 'PROVES' ELSE 'HOLDS' END AS kind, p_name || ' of lot ' || p_size AS said, 0.5 + p_size / 100 AS c, coalesce(p_type IN ('SMALL', 'MEDIUM', 'LARGE'), false) AS required FROM part),
p AS (SELECT r.source, m.s AS subject, CASE WHEN m.kind = 'PROVES' OR contains(m.sn, '7') THEN 'PROVES' ELSE 'SATISFIES' END AS kind, r.s AS object, r.id AS r_edge, m.id AS m_edge, greatest(0.5, 0.86 * least(r.c, m.c)) AS confidence, m.said || ' / ' || r.said AS evidence, m.sn AS mn, r.sn AS rn
  FROM e r JOIN e m ON r.source = m.source AND r.required AND NOT m.required AND r.s <> m.s AND r.id <> m.id AND (r.o = m.o OR contains(r.o, m.o) OR contains(m.o, r.o))),
n AS (SELECT * FROM p WHERE (subject, kind, object) NOT IN (SELECT (p_size, 'SATISFIES', p_size + 1) FROM part) QUALIFY row_number() OVER (PARTITION BY source, subject, kind, object ORDER BY r_edge, m_edge) = 1)
SELECT source, subject, kind, object, round(confidence, 6) AS confidence, round(greatest(0, least(1, confidence + 0.12 + 0.06 + CASE WHEN length(evidence) >= 8 THEN 0.08 ELSE -0.25 END + CASE WHEN contains(evidence, mn) AND contains(evidence, rn) THEN 0.06 ELSE 0 END)), 6) AS quality, evidence, r_edge, m_edge FROM n""")
def alignment_edges(spark, d):
    """New edges that alignments of parts give: PROVES or SATISFIES, with evidence; known triples are left out."""
    part = table(spark, d, "part")
    edges = part.select(
        c("p_partkey").alias("edge_id"), c("p_brand").alias("source"), c("p_size").alias("subject"), F.concat(F.lit("lot "), c("p_size").cast("string")).alias("subject_name"), c("p_name").alias("object"), F.when(c("p_type") == "PROMO", "PROVES").otherwise("HOLDS").alias("kind"),
        F.concat("p_name", F.lit(" of lot "), c("p_size").cast("string")).alias("evidence"), (0.5 + c("p_size") / 100).alias("confidence"), F.coalesce(c("p_type").isin("SMALL", "MEDIUM", "LARGE"), F.lit(False)).alias("required"),
    )
    known = part.select(c("p_size").alias("subject"), F.lit("SATISFIES").alias("kind"), (c("p_size") + 1).alias("object"))
    got = graph.aligned_edges(edges.filter("required"), edges.filter("not required"), known, "7")
    return got.withColumns({"confidence": F.round("confidence", 6), "quality": F.round("quality", 6)})

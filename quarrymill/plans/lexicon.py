"""Terms of a lexicon in documents, and queries expanded by it. The lexicon is drawn from the benchmark's items: three words a name, others as rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexicon
from ..sources import table
from .catalog import query

c = F.col
TRIGGERS = ("the ", "und ")
#: list, kind, first and last word of each term of an item, by order; one term for each pair.
LAYOUT = (("canonical", "match", ((1, 3),)), ("expansion", "match", ((4, 5),)), ("expansion", "term", tuple((k, k) for k in range(6, 14))), ("type", "match", ((14, 15), (16, 16), (17, 17), (18, 18), (19, 19))))


def of_benchmark(spark, d) -> DataFrame:
    words = table(spark, d, "benchmark").select(c("item_id").alias("rule"), F.split("text", " ").alias("w"))
    places = [(name, kind, n, a, b) for name, kind, places in LAYOUT for n, (a, b) in enumerate(places)]
    terms = F.array(*(F.struct(F.lit(name).alias("list"), c("rule").cast("long").alias("rule"), F.lit(kind).alias("kind"), F.lit(n).alias("ord"), F.array_join(F.slice("w", a, b - a + 1), " ").alias("term")) for name, kind, n, a, b in places))
    return words.select(F.inline(terms))


PARTS = " UNION ALL ".join(f"SELECT '{name}' AS list, item_id AS rule, '{kind}' AS kind, {n} AS ord, array_to_string(string_split(text, ' ')[{a}:{b}], ' ') AS term FROM benchmark" for name, kind, places in LAYOUT for n, (a, b) in enumerate(places))
LEX = f"l AS (SELECT list, rule, kind, min(ord) AS ord, trim(term) AS term FROM ({PARTS}) WHERE trim(term) <> '' GROUP BY list, rule, kind, trim(term))"


@query(f"""
WITH {LEX},
d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE {" OR ".join(f"contains(lower(text), '{w}')" for w in TRIGGERS)}),
g AS (SELECT DISTINCT lower(term) AS low FROM l),
h AS (SELECT doc_id, low FROM d JOIN g ON contains(t, low)),
hl AS (SELECT h.doc_id, l.* FROM h JOIN l ON lower(l.term) = h.low),
n AS (SELECT *, row_number() OVER (PARTITION BY list, rule ORDER BY ord) AS n FROM l WHERE (list = 'expansion' AND kind = 'term') OR (list = 'type' AND kind = 'match')),
a AS (SELECT doc_id, term, (CASE list WHEN 'canonical' THEN 1 WHEN 'expansion' THEN 2 ELSE 3 END) AS x, rule, 1 AS part, ord FROM hl WHERE list = 'canonical' OR (list = 'expansion' AND kind = 'term')
  UNION ALL SELECT r.doc_id, n.term, CASE n.list WHEN 'expansion' THEN 2 ELSE 3 END, n.rule, 0, n.ord FROM (SELECT DISTINCT doc_id, list, rule FROM hl WHERE list <> 'canonical') r JOIN n ON n.list = r.list AND n.rule = r.rule WHERE n.n <= CASE n.list WHEN 'type' THEN 4 ELSE 6 END),
f AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id, term ORDER BY x, rule, part, ord) AS k, x, rule, part, ord FROM a),
o AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY x, rule, part, ord) AS k FROM f WHERE k = 1)
SELECT doc_id, string_agg(term, '|' ORDER BY k) AS terms FROM o WHERE k <= 40 GROUP BY doc_id""")
def lexicon_entities(spark, d):
    """The lexicon's names and terms for each document that holds a trigger."""
    found = lexicon.domain_entities(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", of_benchmark(spark, d), TRIGGERS)
    return found.select(c("id").alias("doc_id"), F.array_join("terms", "|").alias("terms"))


@query(f"""
WITH {LEX},
q AS (SELECT doc_id, text FROM documents),
r AS (SELECT DISTINCT doc_id, rule FROM q JOIN (SELECT * FROM l WHERE list = 'expansion' AND kind = 'match') l ON contains(lower(text), lower(term))),
a AS (SELECT doc_id, term, 0 AS part, r.rule, ord FROM r JOIN l ON l.rule = r.rule AND list = 'expansion' AND kind = 'term'),
f AS (SELECT doc_id, term, min((rule, ord)) AS x FROM a GROUP BY 1, 2)
SELECT doc_id, count(*) AS n_terms, string_agg(term, ' ' ORDER BY x) AS added FROM f GROUP BY doc_id""")
def lexicon_expansions(spark, d):
    """Texts as queries: the terms of the expansion rules whose match they hold."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = lexicon.expanded(docs, "doc_id", "text", of_benchmark(spark, d)).filter(F.size("terms") > 0)
    return found.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_join("terms", " ").alias("added"))

"""Relations between entities of one text, drawn by rules from the sentences that hold them; columns only.

Each entity has postings: the sentences it stands in. A pair's evidence is the first sentence in both postings, or else the first short one of
its subject; rules on the evidence and on both types tell the relation. All of it stays in the row: texts aren't exploded, and a pair costs a meeting of two
short lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ontology, relations
from .extraction import let

SENTENCE = r"[^。！？.!?；;\n]*[。！？.!?；;]|[^。！？.!?；;\n]+"
#: Characters of a sentence with both, and of one with the subject; relations of a text; confidence of a rule.
BOTH, ALONE, MOST, CONFIDENCE = 260, 220, 12, 0.68


@dataclass(frozen=True)
class Rule:
    """kind (None: no relation) where the evidence has all patterns, types and evidence together `around`, and the types theirs."""

    kind: str | None
    evidence: tuple[str, ...]
    around: str = ""
    subject: str = ""
    object: str = ""


# fixed values: what tells a relation, the first that fits
RULES = (
    Rule(None, ("持有|具备|拥有|取得|须|必须|应当|需",), subject="certificate|proof_material|document_material", object="personnel|requirement|subject"),
    Rule("REQUIRES", ("须|必须|应当|需|要求|提供|具备",), "要求|资格|人员|证书|资质|材料|条件", subject="requirement"),
    Rule("HOLDS", ("须|必须|应当|需|要求|提供|具备",), "要求|资格|人员|证书|资质|材料|条件"),
    Rule("PROVES", ("证明|佐证|支撑|可用于响应|用于响应",)),
    Rule("SATISFIES", ("满足|符合|响应|匹配",)),
    Rule("HOLDS", ("持有|具备|拥有|取得",)),
    Rule("HAS_EXPERIENCE", ("业绩|案例|经验", "具备|具有|拥有|提供")),
    Rule("SCORES_FOR", ("评分|得分|加分",)),
    Rule("CAUSES_RISK", ("废标|无效响应|风险|扣分",)),
    Rule("PRODUCES", ("生成|产生|输出|形成",)),
    Rule("CONTAINS", ("包含|包括|组成",)),
)


def sentences(t: Column) -> Column:
    """Sentences in order: they end at a mark or a line's end; blank ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), 0), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def postings(said: Column, entities: Column) -> Column:
    """Of each entity (name, type): the sentences up to BOTH characters that hold its name (`both`), and the first up to ALONE (`alone`, -1 without)."""

    every = F.when(F.size(said) > 0, F.sequence(F.lit(0), F.size(said) - 1)).otherwise(F.array().cast("array<int>"))

    def of(e: Column, short: Column) -> Column:
        held = F.filter(short, lambda k: F.get(said, k).contains(e["name"]))
        alone = lambda b: F.coalesce(F.get(F.filter(b, lambda k: F.length(F.get(said, k)) <= ALONE), F.lit(0)), F.lit(-1))
        return let(held, lambda b: F.struct(e["name"].alias("name"), e["type"].alias("type"), b.alias("both"), alone(b).alias("alone")))

    return let(F.filter(every, lambda k: F.length(F.get(said, k)) <= BOTH), lambda short: F.transform(entities, lambda e: of(e, short)))


def predicate(subject: Column, object_: Column, evidence: Column, rules: tuple[Rule, ...]) -> Column:
    """The relation's type by the first rule that fits; null where none does or the rule says so."""
    around, out = F.concat(subject, object_, evidence), None
    for r in rules:
        fits = F.lit(True)
        for value, patterns in ((evidence, r.evidence), (around, (r.around,)), (subject, (r.subject,)), (object_, (r.object,))):
            for p in filter(None, patterns):
                fits = fits & value.rlike(p)
        kind = F.lit(r.kind).cast("string")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def extracted(t: Column, entities: Column, rules: tuple[Rule, ...] = RULES, least: dict[str, float] | None = None, disabled: tuple[str, ...] = ()) -> Column:
    """An array of the relations of a text: subject, predicate, object, label, evidence, confidence, quality, start, end; the MOST best, by quality, then in the
    entities' order.

    entities: array of (name, type) with different names, as many as an event has; those that the text lacks take no part. A relation needs the
    least confidence of its type (least: configured ones) and a type that isn't disabled. A null text has none.
    """
    said = F.transform(F.array(F.coalesce(t, F.lit(""))), sentences)
    there = F.filter(entities, lambda e: (e["name"] != "") & F.coalesce(t.contains(e["name"]), F.lit(False)))
    configured = F.create_map(*(F.lit(x) for k, v in least.items() for x in (k, v))) if least else None

    def relation(s: Column, o: Column, own: Column) -> Column:
        shared = F.array_min(F.array_intersect(s["both"], o["both"]))
        evidence = F.coalesce(F.get(own, F.coalesce(shared, F.when(s["alone"] >= 0, s["alone"]))), F.lit(""))

        def of(x: Column) -> Column:
            kind = x["kind"]
            score = relations.relation_score(F.lit(CONFIDENCE), ontology.of_type(kind, 2, False), ontology.of_type(kind, 3, False), x["evidence"], x["evidence"].contains(s["name"]) & x["evidence"].contains(o["name"]), F.lit("AUTO"), kind == ontology.OTHER)
            start = F.instr(t, x["evidence"]) - 1
            good = ontology.passes(kind, F.lit(CONFIDENCE), x["evidence"], F.try_element_at(configured, kind) if configured is not None else F.lit(None).cast("double"), F.array(*map(F.lit, disabled)) if disabled else F.array().cast("array<string>"))
            return F.when(good, F.struct(
                s["name"].alias("subject"), kind.alias("predicate"), o["name"].alias("object"), ontology.of_type(kind, 1, "").alias("label"), x["evidence"].alias("evidence"), F.lit(CONFIDENCE).alias("confidence"), F.round(score, 9).alias("quality"),
                start.cast("long").alias("start"), (start + F.length(x["evidence"])).cast("long").alias("end")))

        found = let(F.struct(evidence.alias("evidence")), lambda x: F.struct(x["evidence"].alias("evidence"), F.when(x["evidence"] != "", predicate(s["type"], o["type"], x["evidence"], rules)).alias("kind")))
        return let(found, of)

    def every(own: Column) -> Column:
        index = F.transform(F.array(postings(own, there)), lambda p: F.flatten(F.transform(p, lambda s: F.transform(F.filter(p, lambda o: o["name"] != s["name"]), lambda o: relation(s, o, own)))))
        return F.array_compact(F.element_at(index, 1))

    def ordered(r: Column) -> Column:
        keyed = F.transform(r, lambda x, i: F.struct((-x["quality"]).alias("q"), i.alias("i"), x.alias("x")))
        return F.transform(F.slice(F.array_sort(keyed), 1, MOST), lambda k: k["x"])

    return F.element_at(F.transform(said, lambda own: let(every(own), ordered)), 1)

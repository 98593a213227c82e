"""What a document's profile adds to its events: objects that an event's text names, relations between them, and entities that relations need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .extraction import let

#: Entities of an event, of its own ones beside matched objects, and relations of an event; keywords.
ENTITIES, SUPPORT, RELATIONS, KEYWORDS = 24, 3, 12, 24
# fixed values: types whose own entities give no support, and endings of those that do
UNSPECIFIC = ("subject", "metric", "product")
SUPPORTING = "(公司|集团|单位|部门|人员|证书|材料|文件|要求|规则|标准|期限|金额|评分|权限|数据|报告|知识库|系统|流程|预审)$"
# fixed values: the type of an entity that only a relation names, by its name
BY_NAME = (
    ("证书|资质|资格|许可|认证", "certificate"),
    ("人员|负责人|经理|工程师|专家|团队|张|李|王|赵", "personnel_requirement"),
    ("业绩|合同|项目|案例|经验", "performance_requirement"),
    ("材料|扫描件|附件|承诺函|证明", "proof_material"),
    ("评分|得分|分值", "scoring_item"),
    ("废标|无效|风险", "invalid_response_clause"),
)


def key(x: Column) -> Column:
    return F.concat(F.lower(F.trim(x["type"])), F.lit("\0"), F.lower(F.trim(x["name"])))


def first_by(rows: Column, of) -> Column:
    """Of structs those that come first with their key."""
    return let(F.transform(rows, of), lambda keys: F.filter(rows, lambda x, i: F.array_position(keys, of(x)) == i + 1))


def matched(t: Column, objects: Column) -> Column:
    """The objects (name, type, description, aliases) whose name or an alias stands in a text, each once by type and name, in the profile's order."""
    names = lambda o: F.array_compact(F.concat(F.array(o["name"]), F.coalesce(o["aliases"], F.array().cast("array<string>"))))
    return first_by(F.filter(objects, lambda o: F.exists(names(o), lambda n: (n != "") & t.contains(n))), key)


def entities(t: Column, objects: Column, own: Column, supporting: str = SUPPORTING) -> Column:
    """name, type and description of an event's entities: matched objects first, then the first SUPPORT of its own that a text has, of a specific type and with a
    telling ending; without a matched object all of its own."""
    plain = lambda a: F.transform(a, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), x["description"].alias("description")))

    def of(found: Column) -> Column:
        keys = F.transform(found, key)
        kept = F.filter(own, lambda e: ~F.array_contains(keys, key(e)) & t.contains(e["name"]) & ~e["type"].isin(*UNSPECIFIC) & e["name"].rlike(supporting))
        return F.slice(F.when(F.size(found) > 0, F.concat(plain(found), plain(F.slice(kept, 1, SUPPORT)))).otherwise(plain(own)), 1, ENTITIES)

    return let(F.coalesce(matched(t, objects), objects), of)


def keywords(words: Column, found: Column) -> Column:
    """An event's keywords and the names of matched objects behind them, each once, letter case aside."""
    every = F.filter(F.transform(F.concat(words, F.transform(found, lambda x: x["name"])), lambda w: F.struct(F.trim(w).alias("w"))), lambda x: x["w"] != "")
    return F.slice(F.transform(first_by(every, lambda x: F.lower(x["w"])), lambda x: x["w"]), 1, KEYWORDS)


def relations_for(relations: Column, found: Column) -> Column:
    """The first RELATIONS of a profile's relations (source, target, ...) both of whose ends are among an event's entities."""
    return let(F.transform(found, lambda x: x["name"]), lambda names: F.slice(F.filter(relations, lambda r: F.array_contains(names, r["source"]) & F.array_contains(names, r["target"])), 1, RELATIONS))


def type_by_name(name: Column, predicate: Column, subject: bool) -> Column:
    out = None
    for pattern, kind in BY_NAME:
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.when(predicate == "PROVES", "proof_material").otherwise("subject") if subject else out.when(predicate == "REQUIRES", "requirement").otherwise("subject")


def with_ends(found: Column, relations: Column) -> Column:
    """Entities with the ends of relations (subject, predicate, object, label) that they lack, in the relations' order, each typed by its name or
    its part in the relation and told why."""

    def end(r: Column, side: str) -> Column:
        said = F.concat(F.lit("由强关系抽取补充："), r["subject"], F.lit(" "), r["label"], F.lit(" "), r["object"])
        return F.struct(r[side].alias("name"), type_by_name(r[side], r["predicate"], side == "subject").alias("type"), said.alias("description"))

    def of(names: Column) -> Column:
        ends = F.flatten(F.transform(relations, lambda r: F.array(end(r, "subject"), end(r, "object"))))
        return F.concat(found, first_by(F.filter(ends, lambda e: ~F.array_contains(names, e["name"])), lambda e: e["name"]))

    return let(F.transform(found, lambda x: x["name"]), of)

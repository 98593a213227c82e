"""Relation types: their names in text, strength, use in reasoning and least confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: type, label, whether strong, whether used in reasoning, least confidence, names in text
RELATIONS = (
    ("CONTAINS", "包含", True, True, 0.62, ("包含", "包括", "含有", "由...组成", "组成", "覆盖", "contain", "include", "has part")),
    ("PART_OF", "属于/组成部分", True, True, 0.62, ("属于", "隶属", "组成部分", "一部分", "归属", "part of", "belongs to")),
    ("IS_A", "是一种", True, True, 0.65, ("是一种", "属于类型", "类型为", "类别为", "is a", "subclass")),
    ("INSTANCE_OF", "实例属于", True, True, 0.65, ("实例", "实例属于", "是具体", "instance of")),
    ("EQUIVALENT_TO", "等价/同义", True, True, 0.72, ("等价", "同义", "别名", "即", "也称", "简称", "equivalent", "same as", "exact match")),
    ("SIMILAR_TO", "相似", False, False, 0.78, ("相似", "类似", "近似", "similar", "close match")),
    ("REFERS_TO", "引用/指向", False, False, 0.72, ("引用", "指向", "提到", "参见", "refer", "mention", "citation")),
    ("BASED_ON", "基于/来源于", True, True, 0.66, ("基于", "依据", "来源于", "根据", "based on", "source")),
    ("DERIVED_FROM", "派生自", True, True, 0.66, ("派生自", "转换自", "改写自", "生成自", "derived from")),
    ("USES", "使用", True, True, 0.62, ("使用", "采用", "调用", "利用", "依托", "use", "used")),
    ("PRODUCES", "产生/输出", True, True, 0.62, ("产生", "生成", "输出", "形成", "产出", "produce", "generate", "output")),
    ("DEPENDS_ON", "依赖/前置", True, True, 0.68, ("依赖", "前置", "前提", "取决于", "depends on", "requires before")),
    ("PRECEDES", "先于", True, True, 0.68, ("先于", "之前", "前置步骤", "然后", "precedes", "before")),
    ("REQUIRES", "要求/需要", True, True, 0.65, ("要求", "需要", "必须", "须", "应当", "需提供", "require", "must")),
    ("SATISFIES", "满足/符合", True, True, 0.65, ("满足", "符合", "响应", "匹配", "达成", "satisfy", "match", "comply")),
    ("PROVES", "证明/支撑", True, True, 0.65, ("证明", "支撑", "佐证", "证明材料", "证据", "prove", "support", "evidence")),
    ("LIMITS", "限制/约束", True, True, 0.68, ("限制", "约束", "不得", "不超过", "不少于", "期限", "金额", "limit", "constraint")),
    ("CAUSES", "导致", True, True, 0.7, ("导致", "造成", "引起", "触发", "cause", "lead to", "result in")),
    ("AFFECTS", "影响", False, False, 0.75, ("影响", "关系到", "关联影响", "affect", "impact")),
    ("RELATED_TO", "相关", False, False, 0.82, ("相关", "关联", "有关", "related")),
    ("HOLDS", "持有/具备", True, True, 0.66, ("持有", "具备", "拥有", "取得", "hold", "has")),
    ("HAS_EXPERIENCE", "具备业绩", True, True, 0.66, ("具备业绩", "具有业绩", "项目经验", "类似业绩", "experience")),
    ("MATCHES_TYPE", "匹配项目类型", True, True, 0.66, ("匹配项目类型", "类似项目", "同类项目", "符合项目类型", "matches type")),
    ("SCORES_FOR", "对应评分项", True, True, 0.66, ("评分", "得分", "对应评分项", "加分", "score")),
    ("CAUSES_RISK", "导致风险/废标", True, True, 0.7, ("废标", "无效响应", "扣分", "风险", "导致风险", "reject", "risk")),
    ("SUBMITS", "提交/响应材料", True, True, 0.64, ("提交", "递交", "提供", "响应材料", "submit")),
)
OTHER = "RELATED_TO"


def relation_type(named: Column) -> Column:
    """The type a relation's name stands for: its own name in any case, else the first type one of whose names it holds, else RELATED_TO."""
    raw = F.trim(named)
    out = F.when(F.upper(raw).isin(*(r[0] for r in RELATIONS)), F.upper(raw))
    for name, *_, names in RELATIONS:
        hit = F.lit(False)
        for n in names:
            hit = hit | F.lower(raw).contains(n)
        out = out.when(hit, name)
    return out.otherwise(OTHER)


def of_type(kind: Column, field: int, default) -> Column:
    """A field of RELATIONS by type."""
    out = None
    for r in RELATIONS:
        out = F.when(kind == r[0], r[field]) if out is None else out.when(kind == r[0], r[field])
    return out.otherwise(default)


def least_confidence(kind: Column) -> Column:
    return of_type(kind, 4, 0.82)


def passes(kind: Column, confidence: Column, evidence: Column, configured: Column, disabled: Column) -> Column:
    """Whether an extracted relation is good enough: evidence, 0.82 for RELATED_TO, else the configured or the type's own least
    confidence, and a type that isn't disabled (disabled: array)."""
    known = kind.isin(*(r[0] for r in RELATIONS))
    own = F.coalesce(configured, least_confidence(kind))
    weak = (kind == OTHER) & (confidence < 0.82)
    return F.coalesce((evidence != "") & known & ~weak & (confidence >= own) & ~F.array_contains(disabled, kind), F.lit(False))

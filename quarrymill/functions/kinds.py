"""Kinds of names and of scripts, by fixed rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what names of a kind end with
ORGANIZATION = "(Inc|Corp|LLC|Ltd|Company|Group|公司|集团|大学|组织)$"
PRODUCT = "(System|Platform|Product|系统|平台|产品|模型|数据库)$"

# fixed values: words of a question, and the relations they ask for
INTENTS = (
    ("要求|需要|必须|须|资质|证书|资格|条件", ("REQUIRES",)),
    ("证明|佐证|支撑|材料|依据|为什么|链路", ("PROVES",)),
    ("满足|符合|响应|怎么响应|匹配", ("SATISFIES",)),
    ("持有|具备|人员|证书", ("HOLDS",)),
    ("业绩|案例|经验|项目类型", ("HAS_EXPERIENCE", "MATCHES_TYPE")),
    ("评分|得分|加分", ("SCORES_FOR",)),
    ("废标|无效|风险|扣分", ("CAUSES_RISK",)),
    ("提交|递交|提供|响应文件", ("SUBMITS",)),
)


def entity_type(name: Column) -> Column:
    """metric for a name with a digit, else organization or product by its ending, else subject."""
    return F.when(name.rlike("[0-9]"), "metric").when(name.rlike(f"(?i){ORGANIZATION}"), "organization").when(name.rlike(f"(?i){PRODUCT}"), "product").otherwise("subject")


def relation_intents(question: Column) -> Column:
    """The relation types a question asks for, each once, in the rules' order."""
    found = [F.when(question.rlike(words), F.array(*map(F.lit, types))).otherwise(F.array().cast("array<string>")) for words, types in INTENTS]
    return F.array_distinct(F.concat(*found))


def han_count(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit(r"\p{IsHan}"), 0))


def latin_words(t: Column) -> Column:
    return F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]+"), 0))


def mostly_han(t: Column) -> Column:
    """Whether a text has more than two Han characters for each word in Latin letters."""
    return han_count(t) > 2 * latin_words(t)


def profile_confidence(count: Column, score: Column) -> Column:
    """Trust in an object that a document names so often, between 0 and 0.9."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.9), 0.55 + F.least(F.lit(0.3), 0.04 * count) + F.least(F.lit(0.1), 0.02 * score)))

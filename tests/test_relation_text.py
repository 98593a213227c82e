"""Relations by rules on the texts of the survey's cases, and against a plain form."""

import random

from pyspark.sql import functions as F

from quarrymill.functions import relation_text

ENTITY = "text string, names array<struct<name:string,type:string>>"


def drawn(spark, text, names, **more):
    row = spark.createDataFrame([(text, names)], ENTITY).select(relation_text.extracted(F.col("text"), F.col("names"), **more).alias("r")).first()
    return row.r


def test_a_requirement_of_a_role(spark):
    text = "拟派项目负责人须具备信息系统项目管理师证书。"
    got = drawn(spark, text, [("项目负责人", "personnel_requirement"), ("信息系统项目管理师证书", "certificate")])
    assert [(r.subject, r.predicate, r.object, r.label) for r in got] == [("项目负责人", "REQUIRES", "信息系统项目管理师证书", "要求/需要")]
    assert got[0].evidence == text and (got[0].start, got[0].end) == (0, len(text)) and got[0].quality == 1.0 and got[0].confidence == 0.68


def test_disabled_and_configured_types(spark):
    text, names = "证书扫描件证明人员能力。系统输出报告。", [("证书扫描件", "x"), ("人员能力", "y"), ("系统", "s"), ("报告", "r")]
    kinds = lambda **m: {(r.subject, r.predicate, r.object) for r in drawn(spark, text, names, **m)}
    assert ("证书扫描件", "PROVES", "人员能力") in kinds() and ("系统", "PRODUCES", "报告") in kinds()
    assert all(p != "PROVES" for _, p, _ in kinds(disabled=("PROVES",)))
    assert all(p != "PRODUCES" for _, p, _ in kinds(least={"PRODUCES": 0.7}))


def test_risk_needs_more_confidence_and_no_rule_no_relation(spark):
    names = [("甲", "a"), ("乙", "b")]
    assert drawn(spark, "甲可能导致乙废标。", names) == [] and drawn(spark, "甲在乙旁边。", names) == []
    assert drawn(spark, None, names) == [] and drawn(spark, "", names) == [] and drawn(spark, "甲包含乙。", []) == []


def plain(text, names, rules):
    import re

    said, out = [x.strip() for x in re.findall(relation_text.SENTENCE, text) if x.strip()], []
    names = [n for n in names if n[0] in text]
    for s in names:
        for o in names:
            if s[0] == o[0]:
                continue
            evidence = next((x for x in said if s[0] in x and o[0] in x and len(x) <= 260), None) or next((x for x in said if s[0] in x and len(x) <= 220), "")
            rule = next((r for r in rules if evidence and all(re.search(p, evidence) for p in r.evidence) and re.search(r.around, s[1] + o[1] + evidence) and re.search(r.subject, s[1]) and re.search(r.object, o[1])), None)
            if rule and rule.kind:
                strong = rule.kind != "SIMILAR_TO"
                q = 0.68 + (0.18 if strong else -0.12) + (0.08 if len(evidence) >= 8 else -0.25) + (0.06 if s[0] in evidence and o[0] in evidence else 0)
                out.append((round(-min(1, q), 9), s[0], rule.kind, o[0], evidence))
    return [r[1:] for r in sorted(out, key=lambda r: r[0])][:12]


def test_rules_equal_a_plain_form(spark):
    rules = (relation_text.Rule(None, ("no",), subject="b"), relation_text.Rule("REQUIRES", ("needs",), "a", subject="a"), relation_text.Rule("PROVES", ("shows", "well")), relation_text.Rule("SIMILAR_TO", ("like",)), relation_text.Rule("CONTAINS", ("with|shows",)))
    rnd = random.Random(5)
    words = ["Ada", "Bo", "Cy", "Dee", "needs", "shows", "well", "like", "with", "no", "x" * 60, ".", "!", "\n", "; "]
    names = [("Ada", "a"), ("Bo", "b"), ("Cy", "c"), ("Dee", "a"), ("Absent", "a")]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(60)] + ["", " . . "]
    table = spark.createDataFrame([(t, names) for t in texts], ENTITY)
    got = table.select("text", relation_text.extracted(F.col("text"), F.col("names"), rules, {"SIMILAR_TO": 0.5}).alias("r")).collect()
    for row in got:
        assert [(r.subject, r.predicate, r.object, r.evidence) for r in row.r] == plain(row.text, names, rules)
        assert all(row.text[r.start : r.end] == r.evidence for r in row.r)

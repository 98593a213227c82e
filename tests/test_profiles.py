"""Profile objects, relations and relation ends on events, on the survey's cases."""

from pyspark.sql import functions as F

from quarrymill.functions import profiles

OWN = "array<struct<name:string,type:string,description:string>>"
ROW = f"t string, objects array<struct<name:string,type:string,description:string,aliases:array<string>>>, own {OWN}, relations array<struct<source:string,target:string,predicate:string>>"
OBJECTS = [("文件上传", "process", "核心流程", ["上传文件"]), ("报告生成", "document_material", "核心产物", ["生成报告", None]), ("别的", "x", "y", None), ("文件上传", "process", "again", None)]


def run(spark, t, objects=OBJECTS, own=(("系统", "system_object", "原始抽取实体"),), relations=()):
    row = spark.createDataFrame([(t, objects, list(own), list(relations))], ROW)
    row = row.withColumn("e", profiles.entities(F.col("t"), F.col("objects"), F.col("own")))
    return row.select("e", profiles.relations_for(F.col("relations"), F.col("e")).alias("r"), profiles.keywords(F.array(F.lit("Upload"), F.lit("文件上传 ")), F.col("e")).alias("k")).first()


def test_matching_objects_become_entities_with_their_relations(spark):
    got = run(spark, "上传后生成报告\n用户上传文件后，会生成报告供查看。", relations=[("文件上传", "报告生成", "PRODUCES"), ("文件上传", "别的", "USES")])
    assert [(e.name, e.description) for e in got.e] == [("文件上传", "核心流程"), ("报告生成", "核心产物")]
    assert [tuple(r) for r in got.r] == [("文件上传", "报告生成", "PRODUCES")] and got.k == ["Upload", "文件上传", "报告生成"]


def test_own_entities_support_or_stand_alone(spark):
    own = [("预审系统", "system_object", "a"), ("甲公司", "organization", "b"), ("乙标准", "rule", "c"), ("丙报告", "doc", "d"), ("丁系统", "subject", "e"), ("缺席材料", "doc", "f"), ("随便", "doc", "g")]
    text = "预审系统由甲公司按乙标准生成报告和丙报告，丁系统随便。"
    assert [e.name for e in run(spark, text, own=own).e] == ["报告生成", "预审系统", "甲公司", "乙标准"]
    assert [e.name for e in run(spark, "无关", own=own).e] == [x[0] for x in own] and run(spark, "无关", objects=[], own=[]).e == []
    many = [(f"物{k}", "t", "d", None) for k in range(40)]
    assert len(run(spark, " ".join(x[0] for x in many), objects=many).e) == 24


def test_ends_of_relations_are_added_with_a_type(spark):
    row = spark.createDataFrame([([("甲", "x", "")], [("甲", "REQUIRES", "信息证书", "要求/需要"), ("某物", "PROVES", "甲", "证明/支撑"), ("某物", "REQUIRES", "别物", "要求/需要")])], f"e {OWN}, r array<struct<subject:string,predicate:string,object:string,label:string>>")
    got = row.select(profiles.with_ends(F.col("e"), F.col("r")).alias("e")).first().e
    assert [(e.name, e.type) for e in got] == [("甲", "x"), ("信息证书", "certificate"), ("某物", "proof_material"), ("别物", "requirement")]
    assert got[1].description == "由强关系抽取补充：甲 要求/需要 信息证书"

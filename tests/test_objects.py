"""Domain objects of the survey's texts."""

from quarrymill.operators import objects


def test_objects_of_a_manual():
    text = "用户在模型选择页面选择对话模型。\n系统支持文件上传、材料解析、预审任务创建和报告生成。\n管理员可以维护权限配置并查看历史记录。"
    assert {"模型选择页面", "对话模型", "文件上传", "预审任务", "报告生成", "权限配置", "历史记录"} <= {x[0] for x in objects.discovered(text)}


def test_objects_of_a_tender():
    text = "供应商须提供类似业绩证明材料，响应文件应满足服务期限要求和技术评分标准。"
    assert {"类似业绩证明材料", "响应文件", "服务期限要求", "技术评分标准"} <= {x[0] for x in objects.discovered(text)}


def test_counts_order_limits_and_nothing():
    got = objects.discovered("技术标准。技术标准，服务期限要求；12；文件。ab标准")
    assert got[0][:2] == ("技术标准", "requirement") and got[0][3] == 2 and got[0][2].endswith("：技术标准")
    assert "文件" not in {x[0] for x in got} and objects.discovered(None) == [] == objects.discovered("")
    assert len(objects.discovered("。".join(f"第{k}号技术标准" for k in range(60)))) == 24


def test_enrichment_keeps_entities_first_and_adds_missing_objects():
    got = objects.enriched([("响应文件", "doc"), ("甲", "x")], "响应文件应满足服务期限要求和技术评分标准。")
    assert got[:2] == [("响应文件", "doc"), ("甲", "x")] and {"服务期限要求", "技术评分标准"} <= {n for n, _ in got[2:]} and [n for n, _ in got].count("响应文件") == 1
    assert objects.enriched([(str(k), "t") for k in range(30)], "技术标准", 24) == [(str(k), "t") for k in range(30)]


def test_objects_of_rows(spark):
    rows = spark.createDataFrame([(1, "技术标准。", "x"), (2, None, "x"), (3, "", "x"), (1, "技术标准。", "x")], "k long, t string, name string")
    got = objects.domain_objects(rows, "k", "t").collect()
    assert [(r.id, r.position, r.name, r["count"]) for r in got] == [(1, 1, "技术标准", 1)] * 2
    assert objects.domain_objects(rows.limit(0), "k", "t").count() == 0

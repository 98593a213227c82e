"""Domain objects of texts: things named by how their phrase ends, without a lexicon.

A text is cut into phrases; in each, the last place of a group's ending closes a name, which begins behind whatever leads to it: another mark, an opening, an
action. Endings are looked up by one pattern a group that finds all that a phrase has. A text's names are counted in its row, by Arrow batches; texts aren't moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Group:
    type: str
    about: str
    endings: tuple[str, ...]


# fixed values: types, what they are, and the endings of their names
GROUPS = (
    Group("requirement", "从文件内容自动发现的要求、条件、规则或约束对象", ("要求", "条件", "规则", "标准", "规范", "约束", "限制", "指标", "参数")),
    Group("document_material", "从文件内容自动发现的文档、材料、附件、报告或表单对象", ("文件", "材料", "附件", "报告", "表格", "表单", "清单", "一览表", "说明书", "手册", "证明", "承诺函")),
    Group("process", "从文件内容自动发现的流程、任务、步骤或操作对象", ("流程", "任务", "步骤", "操作", "处理", "审核", "审批", "预审", "生成", "上传", "下载", "导入", "导出", "同步", "解析", "维护")),
    Group("system_object", "从文件内容自动发现的系统、平台、模块、功能或页面对象", ("系统", "平台", "模块", "功能", "页面", "界面", "工具", "助手", "模型", "智能体", "应用", "场景")),
    Group("data_object", "从文件内容自动发现的数据、字段、记录、日志或权限对象", ("数据", "字段", "记录", "日志", "权限", "账号", "用户", "角色", "配置", "状态", "结果", "历史")),
    Group("time_constraint", "从文件内容自动发现的时间、期限、周期或截止对象", ("时间", "期限", "周期", "日期", "截止", "有效期", "服务期", "工期")),
    Group("amount_or_score", "从文件内容自动发现的金额、报价、费用、分值或数量对象", ("金额", "报价", "费用", "价格", "分值", "评分", "得分", "数量", "比例", "限价", "预算")),
    Group("risk_or_exception", "从文件内容自动发现的风险、异常、错误、限制或失败对象", ("风险", "异常", "错误", "失败", "无效", "限制", "告警", "问题", "提示")),
)
# fixed values: what parts phrases, marks around names, openings of a name's words, actions before a name, and names that say nothing
PARTING = re.compile(r"[。！？；;，,、\n\r\t]|(?:并且|以及|同时|然后|并|且|及|和|与|或)")
MARKS = "，。、；：,.!?！？;: \"'“”‘’（）()【】[]<>《》\n\r\t"
OPENING = re.compile(
    "^(用户在|系统支持|系统可|管理员可以|管理员可|供应商须提供|供应商应提供|供应商需要提供|供应商|投标人须提供|投标人应提供|应满足|须满足|需要满足|满足|提供|查看|选择|点击|输入|进行|完成|支持|可以|可|应|须|需要)"
)
BEGINNINGS = ("点击", "选择", "输入", "查看", "进入", "进行", "通过", "支持", "可以", "需要", "如果", "然后", "当前", "本页", "该")
ACTIONS = ("应满足", "须满足", "需要满足", "满足", "选择", "维护", "查看", "点击", "输入", "提供", "创建", "生成")
PLAIN = ("文件", "材料", "报告", "系统", "页面", "权限", "历史", "用户", "维护", "预审")
TELLING = re.compile("(要求|材料|文件|系统|平台|模块|功能|流程|任务|权限|数据|报告|标准|规则)$")
WEAK = re.compile("(的|了|和|与|或)$")
SHORT_BUT_GOOD = re.compile("要求|材料|文件|任务|报告|配置|权限|系统|助手|模型")
TOKEN, HAN, LATIN = re.compile("[一-龥A-Za-z0-9_-]+"), re.compile("[一-龥]"), re.compile("[A-Za-z]{3,}")
LONGEST, MOST = 12, 24


def named(phrase: str, ending: str) -> str:
    """The name that an ending closes at its last place in a phrase."""
    upto = phrase[: phrase.rindex(ending) + len(ending)]
    tokens = TOKEN.findall(upto)
    name = OPENING.sub("", tokens[-1] if tokens else upto).strip()
    place = name.rfind(ending)
    if place > 0:
        screen = ending in ("页面", "界面")  # a screen to choose on is named by the choosing
        cuts = [k + len(a) for a in ACTIONS if (k := name.rfind(a, 0, place + len(a))) >= 0 and k + len(a) <= place and not (screen and a == "选择" and k + len(a) == place)]
        name = name[max(cuts, default=0) :]
    if len(name) > LONGEST:
        name = name[-LONGEST:]
        seam = re.search("[的之及与和]", name)
        name = name[seam.end() :] if seam and seam.start() < len(name) - 2 else name
    return trimmed(name)


def trimmed(name: str) -> str:
    name = name.strip(MARKS)
    for b in BEGINNINGS:
        if name.startswith(b) and len(name) > len(b) + 2:
            name = name[len(b) :]
    return name.strip()


def good(name: str) -> bool:
    if not 2 <= len(name) <= 28 or name in PLAIN or name.isdecimal() or re.fullmatch("[A-Za-z]{1,2}", name):
        return False
    return bool(HAN.search(name) or LATIN.search(name))


def weight(name: str) -> int:
    return 2 * (4 <= len(name) <= 12) + 3 * bool(TELLING.search(name)) - 2 * bool(WEAK.search(name))


def discovered(text: str | None, most: int = MOST, groups: tuple[Group, ...] = GROUPS) -> list[tuple[str, str, str, int]]:
    """name, type, description and count of a text's objects: the most frequent first, then the most telling, then by name."""
    phrases = [p for x in PARTING.split(re.sub(r"\s+", " ", text or "")) if 2 <= len(p := x.strip()) <= 40]
    found: dict[tuple[str, str], list] = {}
    for g in groups:
        for p in phrases:
            for ending in g.endings:
                if ending in p and good(name := named(p, ending)):
                    found.setdefault((g.type, name.lower()), [name, g.type, f"{g.about}：{name}", 0])[3] += 1
    return [tuple(x) for x in sorted(found.values(), key=lambda x: (-x[3], -weight(x[0]), x[0]))[:most]]


def enriched(entities: list[tuple[str, str]], text: str | None, most: int = MOST, groups: tuple[Group, ...] = GROUPS) -> list[tuple[str, str]]:
    """name and type of a text's entities and, behind them, of objects that they lack; as many as `most`, or as there were entities."""
    merged: dict[str, list] = {}
    for name, type_, _, n in discovered(text, 3 * most, groups):
        merged.setdefault(name, [name, type_, 0])[2] += n
    kept = sorted((x for x in merged.values() if x[2] > 1 or len(x[0]) >= 4 or SHORT_BUT_GOOD.search(x[0])), key=lambda x: (-x[2], -weight(x[0])))[:most]
    out, known = list(entities), {name.strip().lower() for name, _ in entities}
    for name, type_, _ in kept:
        if name.lower() not in known:
            known.add(name.lower())
            out.append((name, type_))
    return out[: max(most, len(entities))]


def domain_objects(texts: DataFrame, id_col: str, text_col: str, most: int = MOST, groups: tuple[Group, ...] = GROUPS) -> DataFrame:
    """id, position (from 1), name, type, description and count of every text's objects. A null or empty text has none; ties of names in
    code point order; repeated rows each give theirs."""
    shared.ship(texts.sparkSession)
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(k, n + 1, *x) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, x in enumerate(discovered(t, most, groups))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["id", "position", "name", "type", "description", "count"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "id long, position int, name string, type string, description string, count long")

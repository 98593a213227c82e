"""Events and entities drawn from text by rules, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kinds, text

# fixed values: names that say nothing
GENERIC = (
    "任务", "生成", "上传", "下载", "操作", "规则", "时间", "记录", "功能", "模型", "文件", "材料", "报告", "问题", "证明", "修改", "配置", "用户", "系统", "页面", "维护", "历史", "结果",
)
# fixed values: Latin words that are no names within Han text
LATIN_NOISE = ("introduction", "ctrl", "shift", "alt", "esc", "enter", "tab", "mb", "ai", "pdf", "word", "excel", "ppt", "ofd", "txt", "v1", "xxxx")
# fixed values: how pieces of sentences begin
PREFIXES = (
    "一个", "一种", "一份", "这份", "该", "本", "其", "以", "于", "关于", "为了", "可能", "如果", "点击", "选择", "输入", "查看", "进入", "进行", "通过", "支持", "可以", "需要", "将", "对", "在",
    "后续", "如明确", "能会", "确认", "确保", "帮助", "提升", "建议", "默认", "帮我", "分析这份", "总结", "选中", "移动到", "降移动", "对文件", "他用", "这是", "的",
)
# fixed values: marks around names, and patterns of what isn't a name
MARKS = r"""[#*\-—:：，。、；;,.!?！？\s"'“”‘’（）()【】\[\]<>《》]+"""
NO_NAME = (
    r"^\d+(?:\.\d+)?$",
    r"[。！？；;]",
    r"(?i)\.(docx?|xlsx?|pptx?|pdf|ofd|txt|md)$",
    r"^[A-Za-z]{1,2}\d*$",
    r"(的|了|和|与|或|及|于|为)$",
    r"(您的问题|仅供参考|准确回答|常规提示|软件实际界面|可能还需要|缺乏直接相关|符合所有适用标准|内容由AI生成|内容由 AI 生成)",
    r"(帮我|请你|如何|怎么|这份文件|这份材料|选中需要|如明确|他用|调查研究是|先做学生)",
)
THING = r"(要求|材料|文件|系统|平台|模块|功能|流程|任务|权限|数据|报告|标准|规则|配置|助手|模型|证书)$"
CLAUSE = r"(是否|如果|可以|需要|通过|进行|确保|帮助|提升|建议|位于|包括|特别是)"
# fixed values: an action on an object, and the name it goes by
ACTIONS = (
    (r"^(上传|导入)(本地)?文件$", "文件上传"),
    (r"^下载(有下载权限的)?文件$", "文件下载"),
    (r"^(单独)?修改文件$", "文件修改"),
    (r"^删除(选中的)?文件$", "文件删除"),
    (r"^(总结|提取).{0,4}会议记录$", "会议记录"),
    (r"^预审规则配置$", "预审规则"),
)
# fixed values: names in quotation marks, and names by their last word
QUOTED = "[\"'“”]([^\"'“”]{2,80})[\"'“”]"
BY_ENDING = "[一-龥A-Za-z0-9_-]{2,24}(?:公司|集团|大学|模型|系统|产品|项目|技术|平台|算法|数据库|方案)"


def let(x: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), lambda v: f(v)), 1)


def drifts(t: Column, han_input: Column) -> Column:
    """Whether a text is in another script than the one it was made from."""
    han, latin = kinds.han_count(t), F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), 0))
    return F.when(han_input, (han == 0) & (latin >= 4)).otherwise((han >= 8) & (latin <= 2))


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def first_sentence(t: Column, most: int = 120) -> Column:
    """Up to the first full stop, exclamation or question mark before white space, else the whole text; cut to most characters."""
    begin = lambda s: let(F.regexp_extract(s, r"(?s)^(.*?[.!?。！？])\s", 1), lambda x: F.when(x != "", x).otherwise(s))
    return F.substring(let(stripped(t), begin), 1, most)


def concise(t: Column, han: Column) -> Column:
    """A text that is short enough as it is, else its first sentences, three at most, as far as they fit; a first one that is too long is cut.

    180 characters for Han text, else 360. White space is squeezed.
    """
    def of(v: Column) -> Column:
        s, by_han = v["s"], v["han"]
        room = F.when(by_han, 180).otherwise(360)
        pieces = F.when(by_han, F.regexp_extract_all(s, F.lit("[^。！？；;]+[。！？；;]?"), 0)).otherwise(F.regexp_extract_all(s, F.lit("[^.!?;]+[.!?;]?"), 0))
        first = F.slice(F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != ""), 1, 3)
        upto = lambda f, n: F.aggregate(F.slice(f, 1, n), F.lit(0), lambda a, x: a + F.length(x))
        fit = lambda f: F.slice(f, F.lit(1), F.when(upto(f, 2) > room, 1).when(upto(f, 3) > room, 2).otherwise(3))
        said = let(let(first, lambda f: F.when(F.size(f) > 0, fit(f)).otherwise(F.array(s))), lambda f: F.when(by_han, F.array_join(f, "")).otherwise(F.array_join(f, " ")))
        cut = let(said, lambda x: F.when(F.length(x) <= room, x).otherwise(F.concat(F.trim(F.substr(x, F.lit(1), room - 1)), F.lit("…"))))
        return F.when(F.length(s) <= room, s).otherwise(cut)

    return F.when(t.isNotNull(), let(F.struct(text.squeeze(t).alias("s"), han.alias("han")), of))


def mentions(t: Column, most: int = 12) -> Column:
    """Names in a text, each once: capitalised runs, then what stands in quotation marks, then runs with a telling last word."""
    quoted = F.transform(F.regexp_extract_all(t, F.lit(QUOTED), 1), lambda x: F.trim(x))
    found = F.concat(text.named_entities(t, 2**31 - 1), quoted, F.regexp_extract_all(t, F.lit(BY_ENDING), 0))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x) > 1)), 1, most)


def clean_name(name: Column) -> Column:
    """A name without marks around it; an action on an object gets its usual name; empty if nothing is left."""
    def usual(s: Column, compact: Column) -> Column:
        out = s
        for pattern, to in reversed(ACTIONS):
            out = F.when(compact.rlike(pattern), to).otherwise(out)
        return out

    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\s+", " "), f"^{MARKS}", ""), f"{MARKS}$", "")
    return let(s, lambda x: let(F.regexp_replace(x, r"\s+", ""), lambda compact: usual(x, compact)))


def is_noise(name: Column, han_input: Column) -> Column:
    """Whether a cleaned name isn't worth an entity: too short or long, a number, a file, a generic word or a piece of a sentence."""
    bad = (F.length(name) < 2) | (F.length(name) > 28) | name.isin(*GENERIC)
    for pattern in NO_NAME:
        bad = bad | name.rlike(pattern)
    bad = bad | ((kinds.han_count(name) >= 15) & ~name.rlike(THING)) | ((F.length(name) > 18) & name.rlike(CLAUSE))
    known = F.forall(F.split(F.lower(name), " "), lambda w: w.isin(*LATIN_NOISE))
    bad = bad | (han_input & (F.lower(name).isin(*LATIN_NOISE) | (name.rlike(r"^[A-Za-z]+(?: [A-Za-z]+){0,2}$") & known)))
    return bad | F.exists(F.array(*map(F.lit, PREFIXES)), lambda p: F.startswith(name, p) & (F.length(name) > F.length(p) + 2))


def entity_score(kind: Column, name: Column, kept: Column | None = None) -> Column:
    """How much a name looks like an entity; names to be kept come before all others."""
    score = F.when(kind != "subject", 8).otherwise(0) + F.when(name.rlike("[一-龥]"), 6).otherwise(0) + F.when(F.length(name).between(4, 12), 4).otherwise(0)
    score = score + F.when(name.rlike(THING), 6).otherwise(0) - F.when(name.rlike("^[A-Za-z0-9_-]+$"), 3).otherwise(0)
    return score if kept is None else score + F.when(kept, 100).otherwise(0)


def clean_entities(names: Column, han_input: Column, keep: Column | None = None, most: int = 24) -> Column:
    """Array of (score, name, kind) from an array of names: cleaned, each once, without noise, the best first, then in the names' order.

    keep: array of names that are never noise. Null names give null; everything stays within the row.
    """
    def of(v: Column) -> Column:
        kept = lambda n: F.array_contains(v["wanted"], n)
        good = F.filter(v["names"], lambda n: (n != "") & (kept(n) | ~is_noise(n, v["han"])))
        kinded = F.transform(good, lambda n, i: F.struct(i.alias("at"), n.alias("name"), kinds.entity_type(n).alias("kind")))
        rated = F.transform(kinded, lambda e: F.struct((-entity_score(e["kind"], e["name"], kept(e["name"]))).alias("less"), e["at"].alias("at"), e["name"].alias("name"), e["kind"].alias("kind")))
        return F.transform(F.slice(F.array_sort(rated), 1, most), lambda e: F.struct((-e["less"]).alias("score"), e["name"].alias("name"), e["kind"].alias("kind")))

    wanted = F.array().cast("array<string>") if keep is None else F.transform(keep, clean_name)
    whole = F.struct(F.array_distinct(F.transform(names, clean_name)).alias("names"), wanted.alias("wanted"), han_input.alias("han"))
    return let(whole, of)

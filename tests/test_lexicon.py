"""Lexicon matching and expansion against plain forms."""

import random

import pytest

from quarrymill.operators import automaton, lexicon

LEX = "list string, rule long, kind string, ord int, term string"


def rows(canonical=(), expansions=(), types=()):
    out = [("canonical", k, "match", 0, t) for k, t in enumerate(canonical)]
    out += [("expansion", k, kind, n, t) for k, (match, terms) in enumerate(expansions) for kind, ts in (("match", match), ("term", terms)) for n, t in enumerate(ts)]
    return out + [("type", k, "match", n, t) for k, match in enumerate(types) for n, t in enumerate(match)]


def plain(text, canonical, expansions, types, triggers):
    low = (text or "").lower()
    if text is None or not any(t.lower() in low for t in triggers):
        return []
    has = lambda ts: any(t.lower() in low for t in ts)
    out = [t for t in canonical if has([t])]
    for match, terms in expansions:
        if has(match) or has(terms):
            out += terms[:6] + [t for t in terms if has([t])]
    for match in types:
        out += match[:4] if has(match) else []
    return list(dict.fromkeys(out))[:40]


def test_terms_of_a_tender(spark):
    canonical, expansions, types = ["项目负责人", "采购标的"], [(["业绩"], ["类似项目", "合同", "验收", "业主证明", "中标通知书", "发票", "用户评价"]), (["没有"], ["无关"])], [["证书", "资格证", "职称", "执业", "多余"]]
    texts = [(1, "供应商须提供类似业绩证明材料,项目负责人具备证书,附用户评价。"), (2, "项目负责人"), (3, None), (4, ""), (5, "投标")]
    lex = spark.createDataFrame(rows(canonical, expansions, types) + [("canonical", 9, "match", 0, "  ")], LEX)
    got = {r.id: r.terms for r in lexicon.domain_entities(spark.createDataFrame(texts, "k long, t string"), "k", "t", lex).collect()}
    assert got == {1: ["项目负责人", "类似项目", "合同", "验收", "业主证明", "中标通知书", "发票", "用户评价", "证书", "资格证", "职称", "执业"]}


@pytest.mark.parametrize("small", [0, 10_000])
def test_terms_equal_a_plain_form(spark, monkeypatch, small):
    monkeypatch.setattr(lexicon, "SMALL", small)  # by join, and to every task
    rnd = random.Random(small)
    word = lambda n: "".join(rnd.choice("abäX ") for _ in range(rnd.randint(1, n)))
    pick = lambda n: list(dict.fromkeys(w for w in (word(4).strip() for _ in range(n)) if w))
    canonical, expansions, types = pick(40), [(pick(2), pick(9)) for _ in range(15)], [pick(6) for _ in range(9)]
    expansions = [(m, t) for m, t in expansions if m and t]
    texts = [(k, word(60)) for k in range(80)] + [(80, None), (81, "")]
    lex = spark.createDataFrame(rows(canonical, expansions, types), LEX)
    got = {r.id: r.terms for r in lexicon.domain_entities(spark.createDataFrame(texts, "k long, t string"), "k", "t", lex, ("A", "b")).collect()}
    want = {k: w for k, t in texts if (w := plain(t, canonical, expansions, types, ("A", "b")))}
    assert got == want


def test_queries_are_expanded_by_rules_and_aliases(spark):
    lex = spark.createDataFrame(rows(expansions=[(["risk"], ["danger", "loss"]), (["cost"], ["price", "loss"])]), LEX)
    aliases = spark.createDataFrame([(1, "PM", "project lead"), (1, "CA", "certificate"), (2, "x", "y")], "source long, alias string, canonical string")
    queries = spark.createDataFrame([(1, 1, "Cost and RISK"), (2, 3, "plain"), (3, 2, "danger")], "k long, source long, t string")
    got = {r.k: (r.terms, r.expanded) for r in lexicon.expanded(queries, "k", "t", lex, aliases).collect()}
    assert got[1] == (["danger", "loss", "price", "CA", "certificate", "PM", "project lead"], "Cost and RISK danger loss price CA certificate PM project lead")
    assert got[2] == ([], "plain") and got[3] == (["x", "y"], "danger x y")
    assert lexicon.expanded(queries, "k", "t", lex).count() == 3


def test_words_that_texts_hold(monkeypatch):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("aab中\U0001f600 ") for _ in range(rnd.randint(1, n)))
    words = list(dict.fromkeys(word(6) for _ in range(120)))
    texts = [word(300) for _ in range(40)] + ["", "xyz", words[3], "a" * 500]
    want = [[w in t for w in words] for t in texts]
    for dense, places, cells in ((1 << 23, 1 << 20, 1 << 24), (0, 1 << 20, 1 << 24), (1 << 23, 64, 1), (0, 100, 700)):
        for name, value in (("DENSE", dense), ("PLACES", places), ("CELLS", cells)):
            monkeypatch.setattr(automaton, name, value)
        assert [row.tolist() for held in automaton.Words(words).held(texts) for row in held] == want
    assert [held.shape for held in automaton.Words([]).held(["a", ""])] == [(2, 0)]


@pytest.mark.parametrize("small", [0, 10_000])
def test_rows_of_one_id_are_one_text(spark, monkeypatch, small):
    monkeypatch.setattr(lexicon, "SMALL", small)
    lex = spark.createDataFrame(rows(["x1"], [(["b1"], [f"e{k}" for k in range(9)])], [["t1", "t2"]]), LEX)
    texts = [(1, "go t1"), (1, "go e8 b1"), (None, "go x1"), (None, "go t2"), (2, "e1"), (3, "go"), (1, "go x1 e7")]
    got = {r.id: r.terms for r in lexicon.domain_entities(spark.createDataFrame(texts, "id long, t string"), "id", "t", lex, ("GO",)).collect()}
    lent = [f"e{k}" for k in range(6)]
    assert got == {1: ["x1", *lent, "e7", "e8", "t1", "t2"], None: ["x1", "t1", "t2"]}
    assert lexicon.domain_entities(spark.createDataFrame(texts, "id long, t string"), "id", "t", lex.limit(0), ("GO",)).count() == 0


def test_a_small_lexicon_makes_no_row_a_term_held(spark):
    lex = spark.createDataFrame(rows(["ab"]), LEX)
    plan = lexicon.domain_entities(spark.createDataFrame([(1, "ab go")], "id long, t string"), "id", "t", lex, ("go",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "Window" not in plan


def test_terms_are_told_in_steps_of_few_texts(monkeypatch):
    from pyspark.sql import Row

    lex = [Row(list=a, rule=b, kind=k, ord=o, term=t, low=t.lower()) for a, b, k, o, t in rows(["A", "Bc"], [(["c"], ["d", "E"])], [["e", "f"]])]
    texts = ["a bc", "d", "c e", "", "f a"]
    want = [["A", "Bc", "d", "E"], ["d", "E"], ["d", "E", "e", "f"], [], ["A", "e", "f"]]
    for cells in (1, 1 << 24):
        monkeypatch.setattr(automaton, "CELLS", cells)
        terms = lexicon.Terms(lex, True, 40)
        assert [[terms.items[x] for x in items] for items in terms.of(texts)] == want
    assert [[terms.items[x] for x in items] for items in lexicon.Terms(lex, True, 2).of(texts)] == [w[:2] for w in want]

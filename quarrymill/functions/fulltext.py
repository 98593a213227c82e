"""Token matching for searches written as on the web: words, "phrases", or, -not."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(t: Column) -> Column:
    """Lower-case runs of letters and digits, without stemming or stop words."""
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def matches(t: Column, query: str) -> Column:
    """Whether a text has all words and phrases of a query, or either side of its or, and none that a minus precedes.

    A query without a word matches nothing; so does a null text.
    """
    padded = F.concat(F.lit(" "), F.array_join(tokens(t), " "), F.lit(" "))
    groups: list[Column] = []
    either = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query.lower()):
        if word == "or" and not minus:
            either = bool(groups)
            continue
        terms = " ".join(re.findall(r"[^\W_]+", phrase or word))
        if not terms:
            continue
        hit = padded.contains(f" {terms} ")
        hit = ~hit if minus else hit
        groups[-1:] = [groups[-1] | hit] if either else [*groups[-1:], hit]
        either = False
    return F.coalesce(reduce(lambda a, b: a & b, groups), F.lit(False)) if groups else F.lit(False)


def cover_density(t: Column, query: str, weight: float = 0.1) -> Column:
    """The rank of a text that has all words of a query of plain words, else 0: each shortest stretch that holds them all counts weight, divided by one
    more than the words in it that are none of them. One fold over the text's words, within the row.

    A query with quotes, an or or a minus counts its words all the same.
    """
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))
    if not terms:
        return F.lit(0.0)
    state = F.struct(
        F.array_repeat(F.lit(-1), len(terms)).alias("last"), F.array_repeat(F.lit(0), len(terms)).alias("nth"), F.lit(0).alias("n"), F.lit(-1).alias("at"), F.lit(-1).alias("begun"), F.lit(0.0).alias("rank")
    )
    names = F.array(*map(F.lit, terms))

    def step(s: Column, word: Column) -> Column:
        at, n, k = s["at"] + 1, s["n"] + 1, F.array_position(names, word)
        put = lambda a, x: F.transform(a, lambda old, i: F.when(i == k - 1, x).otherwise(old))
        last, nth = put(s["last"], at), put(s["nth"], n)
        first = F.array_min(last)
        whole = (first >= 0) & (first != s["begun"])
        noise = (at - first) - (n - F.array_min(nth))
        hit = F.struct(last.alias("last"), nth.alias("nth"), n.alias("n"), at.alias("at"), F.when(whole, first).otherwise(s["begun"]).alias("begun"), (s["rank"] + F.when(whole, weight / (1 + noise)).otherwise(0.0)).alias("rank"))
        miss = F.struct(s["last"].alias("last"), s["nth"].alias("nth"), s["n"].alias("n"), at.alias("at"), s["begun"].alias("begun"), s["rank"].alias("rank"))
        return F.when(k > 0, hit).otherwise(miss)

    return F.coalesce(F.aggregate(tokens(t), state, step, lambda s: s["rank"]), F.lit(0.0))

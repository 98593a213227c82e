"""License scans by a positional rare-token index, in DataFrame functions only.

The index has a posting (template, place) for each place of each template's words. Of a file's licence words those with the highest inverse document
frequency over all documents are looked up: place in the file less place in the template is where a copy would start. Of a template
that the file has all key words of, the rarest key word is looked up; of one that it has enough words of, so many of the rarest that a copy with
MATCHED of its words in place can't lack them all (it may lack one place fewer than are looked up). Starts that postings agree on are verified:
the key phrase must stand there whole, and the share of words in place is the score; without the key phrase the copy is a damaged one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The share of a template's words that a copy must have in place to be told as damaged; words of templates that can be.
MATCHED, LONG = 0.7, 5
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """words: what is looked for; the key phrase, from key up to end, must be there; base: a label that any place of the phrase gives."""

    label: str
    words: tuple[str, ...]
    key: int = 0
    end: int = 0
    base: bool = False

    @staticmethod
    def of(label: str, text: str, key: str | None = None, base: bool = False) -> Template:
        words, k = tuple(text.split()), tuple((key or text).split())
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        return Template(label, words, at, at + len(k), base)


BASE = (
    Template.of("cc-by", "cc by", base=True),
    Template.of("gpl", "general public license", base=True),
    Template.of("reserved", "all rights reserved", base=True),
)
TEMPLATES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    Template.of("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template.of("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template.of("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template.of("cc0", "dedicated to the public domain under cc0 1 0 universal", "public domain under cc0"),
    Template.of("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template.of("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template.of("mit", "released under the mit license", "mit license"),
    Template.of("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template.of("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template.of("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing"),
    Template.of("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it under the terms of the gnu general public license"),
    Template.of("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "the software is provided as is without warranty of any kind"),
)


def word_list(text: Column) -> Column:
    return F.filter(F.split(common.ascii_lower(text), SEPARATOR), lambda w: w != "")


def frequencies(rows: DataFrame) -> dict[str, int]:
    """In how many documents each licence word (array `present`) occurs; as many rows as the templates have words, whatever the input."""
    return {r["word"]: r["count"] for r in rows.select(F.explode("present").alias("word")).groupBy("word").count().collect()}


def looked_up(n: int) -> int:
    """Places of a template to look up so that a copy with MATCHED of n places right has one of them right."""
    return n - math.ceil(MATCHED * n) + 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = BASE + TEMPLATES) -> DataFrame:
    """doc_id, n_words, base (starts of all base phrases, sorted), base_labels, labels, damaged (arrays) and score of every row.

    labels: of templates whose key phrase stands in the file; damaged: of templates with LONG words or more, MATCHED of which stand in place
    around a key phrase that isn't whole. Two passes over the texts without a shuffle of rows: one counts in how many documents each licence word occurs, one
    looks up. A null or empty text has no words and no labels; an empty table gives an empty result; words equally rare are looked up in
    alphabetical order, which doesn't change what is found; repeated rows each give a row; other columns, whatever their names, aren't
    read; texts are never cut.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    words = common.id_text(docs, id_col, text_col).select("doc_id", word_list(F.col("text")).alias("words"))
    words = words.select("doc_id", "words", F.array_intersect(F.array(*map(F.lit, vocabulary)), "words").alias("present"))
    often = frequencies(words)
    rarest = lambda places, t: sorted(places, key=lambda k: (often.get(t.words[k], 0), t.words[k], k))

    texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    index: dict[str, list[int]] = {}
    known = []
    for n, t in enumerate(templates):
        for k, w in enumerate(t.words):
            index.setdefault(w, []).append((n << 40) - k)
        key = sorted(set(t.words[t.key : t.end]))
        known.append(F.struct(
            texts(t.words).alias("words"), F.lit(t.key).alias("key"), F.lit(t.end).alias("end"), texts(key).alias("keys"), F.lit(t.words[rarest(range(t.key, t.end), t)[0]]).alias("rare"),
            texts([t.words[k] for k in rarest(range(len(t.words)), t)] if len(t.words) >= LONG and not t.base else []).alias("by_rarity"), F.lit(looked_up(len(t.words))).alias("most"),
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base")))
    table = F.array(*known)
    postings = F.create_map(*(x for w in vocabulary for x in (F.lit(w), F.array(*(F.lit(p).cast("long") for p in index[w])))))

    def asked(t: Column) -> Column:
        """The words of a template to look up in a file, repeated words once a place."""
        here = F.filter(t["by_rarity"], lambda w: F.array_contains("present", w))
        rare = F.when(F.size(F.array_except(t["keys"], F.col("present"))) == 0, F.array(t["rare"])).otherwise(F.array().cast("array<string>"))
        enough = F.size(here) >= F.size(t["by_rarity"]) - t["most"] + 1
        return F.concat(rare, F.when(enough, F.slice(here, F.lit(1), t["most"])).otherwise(F.array().cast("array<string>")))

    found = words.select("doc_id", "words", F.array_distinct(F.flatten(F.transform(table, asked))).alias("asked"))
    spots = F.filter(F.transform("words", lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("word"))), lambda s: F.array_contains("asked", s["word"]))
    far = 1 << 20  # keeps starts before the text positive
    starts = F.flatten(F.transform(spots, lambda s: F.transform(F.element_at(postings, s["word"]), lambda p: p + s["at"] + far)))
    found = found.select("doc_id", "words", F.when(F.size("asked") > 0, F.array_distinct(starts)).otherwise(F.array().cast("array<bigint>")).alias("starts"))

    def verified(code: Column) -> Column:
        t, start = F.get(table, F.shiftright(code, 40).cast("int")), code.bitwiseAND((1 << 40) - 1) - far
        hits = F.transform(t["words"], lambda w, k: F.coalesce(F.get(F.col("words"), (start + k).cast("int")) == w, F.lit(False)))
        key = F.forall(F.slice(hits, t["key"] + 1, t["end"] - t["key"]), lambda x: x)
        share = F.size(F.filter(hits, lambda x: x)) / F.size(hits)
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), (F.size(t["by_rarity"]) > 0).alias("long"), start.alias("start"), key.alias("key"), share.alias("share"))

    found = found.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(F.transform("starts", verified), lambda x: x["key"] | (x["long"] & (x["share"] >= MATCHED))).alias("hits"))
    labels = lambda f: F.array_sort(F.array_distinct(F.transform(F.filter("hits", f), lambda x: x["label"])))
    base = F.array_sort(F.transform(F.filter("hits", lambda x: x["base"]), lambda x: x["start"]))
    score = F.coalesce(F.array_max(F.transform(F.filter("hits", lambda x: x["key"]), lambda x: x["share"])), F.lit(0.0))
    return found.select("doc_id", "n_words", base.alias("base"), labels(lambda x: x["base"]).alias("base_labels"), labels(lambda x: x["key"]).alias("labels"), labels(lambda x: ~x["key"]).alias("damaged"), F.round(score, 6).alias("score"))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """Words, base places and labels of every document."""
    got = scan(common.table(spark, sf_dir, "documents"))
    edge = lambda f: f("base").cast("long")
    return got.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), edge(F.array_min).alias("first_word"), edge(F.array_max).alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score", F.array_join("damaged", ",").alias("damaged"))


def sql_rows() -> str:
    quote = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {quote(t.words)}, {t.key}, {t.end})" for k, t in enumerate(BASE + TEMPLATES))


ORACLE = rf"""
WITH templates(id, label, base, words, k, e) AS (VALUES {sql_rows()}),
w AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}'), '{SEPARATOR}'), lambda x: x <> '') AS ws
  FROM documents),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS at FROM w),
t AS (SELECT id, label, base, words, k, e, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM templates),
c AS (
  SELECT r, id, label, base, p.at - place AS start, count(*) / len(words) AS share, count(*) FILTER (WHERE place >= k AND place < e) = e - k AS key, len(words) AS n
  FROM p JOIN t USING (word) GROUP BY r, id, label, base, p.at - place, words, k, e),
per AS (
  SELECT r, count(*) FILTER (WHERE base AND key) AS n_base, min(start) FILTER (WHERE base AND key) AS first_word, max(start) FILTER (WHERE base AND key) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base AND key) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE key) AS labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE NOT key AND NOT base AND n >= {LONG} AND share >= {MATCHED}) AS damaged, max(share) FILTER (WHERE key) AS score
  FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0), 6) AS score, coalesce(damaged, '') AS damaged
FROM w LEFT JOIN per USING (r)
"""

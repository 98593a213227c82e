"""A lexicon as a table: which of its terms texts hold, and what a text or a query is expanded by.

A lexicon has rows list, rule, kind, ord, term: canonical names (list "canonical", each a rule), expansion rules (list "expansion", with kind "match" and "term")
and type rules (list "type", kind "match"). A term is looked for by its anchor, the rarest of its pieces of GRAM letters among all terms
(a shorter term is its own anchor): a text's distinct pieces meet anchors in one join, and only terms whose anchor is there are compared with the text.
For what domain_entities gives, a lexicon that fits a task is looked for by one walk over each text instead, and a text's terms are told where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import automaton, shared

c = F.col
GRAM, FIRST_TERMS, FIRST_MATCHES, MOST = 3, 6, 4, 40
#: A lexicon of so many terms goes to every task; a larger one is joined by its anchors.
SMALL = 200_000
LISTS = ("canonical", "expansion", "type")
# fixed values: words that tell a text of the domain
TRIGGERS = (
    "招标", "投标", "应标", "编标", "采购", "供应商", "响应文件", "响应", "资格", "资质", "业绩", "评分", "评审", "评标", "证书", "废标", "无效响应", "报价", "最高限价", "证明材料", "承诺函", "采购标的",
)


def normalized(rows: DataFrame) -> DataFrame:
    """A lexicon with trimmed terms, without blank ones and with each term of a rule's kind once, where it comes first."""
    rows = rows.withColumn("term", F.trim("term")).filter("term != ''")
    first = rows.groupBy("list", "rule", "kind", "term").agg(F.min("ord").alias("ord"))
    return first.select("list", "rule", "kind", "ord", "term")


def pieces(t: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of so many letters; one walk over the text a size (substrings by place would each walk from its start)."""
    return F.array_distinct(F.concat(*(F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sizes)))


def anchored(terms: DataFrame) -> DataFrame:
    """low (a term in lower case) and anchor: its piece that the fewest terms share."""
    low = terms.select(F.lower("term").alias("low")).distinct()
    each = low.select("low", F.explode(F.when(F.length("low") < GRAM, F.array("low")).otherwise(pieces(c("low"), (GRAM,)))).alias("anchor"))
    often = each.groupBy("anchor").agg(F.count("*").alias("n"))
    return each.join(often, "anchor").groupBy("low").agg(F.min_by("anchor", F.struct("n", "anchor")).alias("anchor"))


def sized(rows: DataFrame, size: int) -> DataFrame:
    """A table for every task where a lexicon has SMALL terms at most."""
    return F.broadcast(rows) if size <= SMALL else rows


def hits(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """id and low of every term that a text holds, letter case aside; each once, dealt out by id. A null text holds none."""
    anchors = sized(anchored(lexicon), lexicon.count())
    low = texts.select(c(id_col).alias("id"), F.lower(text_col).alias("_text")).filter("_text is not null")
    met = low.select("id", "_text", F.explode(pieces(c("_text"), tuple(range(1, GRAM + 1)))).alias("anchor")).join(anchors, "anchor")
    return met.filter(F.contains("_text", "low")).select("id", "low").repartition("id").distinct()  # what follows stays with its id


def ordered(found: DataFrame, most: int | None) -> DataFrame:
    """id and terms: each once, where it comes first, in order."""
    first = found.groupBy("id", "term").agg(F.min("at").alias("at"))
    if most:
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("at"))).filter(c("n") <= most)
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("terms"))


class Terms:
    """A small lexicon's terms in the order in which a text is given them, as items: a canonical name, or what a rule lends and what it owns. Groups are what is held at once."""

    def __init__(self, rows: list[Row], expansions: bool, most: int):
        self.most = most
        nulls_first = lambda x: (x is not None, x)
        rows = sorted((r for r in rows if r.list in LISTS), key=lambda r: (LISTS.index(r.list), nulls_first(r.rule), nulls_first(r.ord), r.term))
        self.words = automaton.Words(list(dict.fromkeys(r.low for r in rows)))
        number = {w: k for k, w in enumerate(dict.fromkeys(r.low for r in rows))}
        groups: dict = {}
        for n, r in enumerate(rows):
            groups.setdefault((r.list, n if r.list == "canonical" else r.rule), []).append(r)
        self.items, self.groups, self.held_by, self.starts, same = [], [], [], [], {}
        for (kind, rule), own in groups.items():
            lent = [r for r in own if r.kind == ("match" if kind == "type" else "term")] if kind != "canonical" and rule is not None else []
            lent = lent[: FIRST_MATCHES if kind == "type" else FIRST_TERMS if expansions else 0]
            told = [(r, None) for r in lent] + [(r, number[r.low]) for r in own if kind == "canonical" or kind == "expansion" and r.kind == "term"]
            self.groups.append([(len(self.items) + n, same.setdefault(r.term, len(same)), w) for n, (r, w) in enumerate(told)])
            self.items += [r.term for r, _ in told]
            self.starts.append(len(self.held_by))
            self.held_by += [number[r.low] for r in own]
        self.held_by = np.array(self.held_by, np.int64)

    def of(self, texts: list[str]) -> Iterator[list[int]]:
        """Every text's items, the first of each term, in order."""
        if not self.groups:
            yield from ([] for _ in texts)
            return
        step = max(1, automaton.CELLS // len(self.held_by))
        for held in (h[k : k + step] for h in self.words.held(texts) for k in range(0, len(h), step)):
            groups = np.logical_or.reduceat(held[:, self.held_by], self.starts, axis=1)
            for has, at in zip(held, groups, strict=True):
                out: dict[int, int] = {}
                for g in np.flatnonzero(at).tolist():
                    for item, term, word in self.groups[g]:
                        if word is None or has[word]:
                            out.setdefault(term, item)
                    if len(out) >= self.most:
                        break
                yield list(out.values())[: self.most]

    def together(self, found: list[list[int]]) -> list[int]:
        """The items of texts under one id: the first ones of them all, and of a term the first."""
        first: dict[str, int] = {}
        for item in sorted(x for items in found for x in items):
            first.setdefault(self.items[item], item)
        return list(first.values())[: self.most]


def told_in_place(texts: DataFrame, id_col: str, text_col: str, rows: list[Row], triggers: list[str], expansions: bool) -> DataFrame:
    """domain_entities by one walk over the texts; only ids and numbers of terms are shuffled, as rows of one id count as one text."""
    spark = texts.sparkSession
    shared.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    terms = Terms(rows, expansions, MOST)
    low = texts.select(c(id_col).alias("id"), F.lower(text_col).alias("text")).filter("text is not null")
    kind = to_arrow_type(low.schema["id"].dataType)
    batch = lambda ids, items: pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(items, pa.list_(pa.int32()))], ["id", "items"])

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, own = b.column(0), b.column(1).to_pylist()
            at = [k for k, t in enumerate(own) if any(w in t for w in triggers)]
            found = [(k, items) for k, items in zip(at, terms.of([own[k] for k in at]), strict=True) if items]
            yield batch(ids.take(pa.array([k for k, _ in found], pa.int64())), [items for _, items in found])

    def name(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = pa.array(terms.items, pa.string()), None

        def named(ids: list, items: list[list[int]]) -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, items)])
            flat = names.take(pa.array([x for i in items for x in i], pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["id", "terms"])

        for b in it:
            ids, items = [], []
            for k, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last is not None and last[0] == k:
                    last[1].append(own)
                    continue
                if last is not None:
                    ids.append(last[0])
                    items.append(last[1][0] if len(last[1]) == 1 else terms.together(last[1]))
                last = k, [own]
            yield named(ids, items)
        if last is not None:
            yield named([last[0]], [terms.together(last[1])])

    id_type = low.schema["id"].dataType.simpleString()
    return low.mapInArrow(walk, f"id {id_type}, items array<int>").repartition("id").sortWithinPartitions("id").mapInArrow(name, f"id {id_type}, terms array<string>")


def domain_entities(texts: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, triggers: tuple[str, ...] = TRIGGERS, expansions: bool = True) -> DataFrame:
    """id and terms (MOST at most) of texts that hold a trigger: canonical names they hold, then by rule the first FIRST_TERMS terms of expansion rules of
    which they hold a match or a term, with the terms they hold, then the first FIRST_MATCHES matches of type rules of which they hold one.

    Texts without any have no row. Without expansions an expansion rule gives only the terms that are held.
    """
    lexicon = normalized(lexicon)
    size = lexicon.count()
    if size <= SMALL:
        own = lexicon.sparkSession.range(1).select(*(F.lower(F.lit(w)).alias(str(n)) for n, w in enumerate(triggers))).first()
        return told_in_place(texts, id_col, text_col, lexicon.withColumn("low", F.lower("term")).collect(), list(own), expansions)
    told = c(text_col).isNotNull() & F.exists(F.array(*map(F.lit, triggers)), lambda w: F.lower(text_col).contains(F.lower(w)))
    held = hits(texts.filter(told), id_col, text_col, lexicon).join(sized(lexicon.withColumn("low", F.lower("term")), size), "low").select("id", "list", "rule", "kind", "ord", "term")
    place = F.array_position(F.array(*map(F.lit, LISTS)), c("list")).cast("int")
    own = held.filter("list = 'canonical' or (list = 'expansion' and kind = 'term')").select("id", "term", F.struct(place.alias("list"), "rule", F.lit(1).alias("part"), "ord").alias("at"))
    rules = held.filter("list != 'canonical'").select("id", "list", "rule").distinct()
    by = Window.partitionBy("list", "rule").orderBy("ord")
    first = lexicon.filter("(list = 'expansion' and kind = 'term') or (list = 'type' and kind = 'match')").withColumn("n", F.row_number().over(by))
    first = first.filter(c("n") <= F.when(c("list") == "type", FIRST_MATCHES).otherwise(FIRST_TERMS if expansions else 0))
    lent = rules.join(sized(first, size), ["list", "rule"]).select("id", "term", F.struct(place.alias("list"), "rule", F.lit(0).alias("part"), "ord").alias("at"))
    return ordered(own.unionByName(lent), MOST)


def expanded(queries: DataFrame, id_col: str, text_col: str, lexicon: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every query with terms and text: the terms of expansion rules of which it holds a match, in the rules' order, and the query with them behind it,
    each word list once.

    aliases: source, alias, canonical of the sources a query asks (queries have a source then); all aliases of its source are added, each followed by its
    canonical name.
    """
    lexicon = normalized(lexicon).filter("list = 'expansion'")
    held = hits(queries, id_col, text_col, lexicon.filter("kind = 'match'")).join(lexicon.filter("kind = 'match'").withColumn("low", F.lower("term")), "low").select("id", "rule").distinct()
    found = held.join(lexicon.filter("kind = 'term'"), "rule").select("id", "term", F.struct(F.lit(0).alias("part"), "rule", "ord").alias("at"))
    if aliases is not None:
        both = aliases.select("source", F.posexplode(F.array("alias", "canonical")).alias("nth", "term"), "alias")
        rank = both.withColumn("rule", F.dense_rank().over(Window.partitionBy("source").orderBy("alias"))).select("source", "term", F.struct(F.lit(1).alias("part"), c("rule").cast("long").alias("rule"), c("nth").cast("long").alias("ord")).alias("at"))
        asked = queries.select(c(id_col).alias("id"), "source").join(rank, "source").select("id", "term", "at")
        found = found.select("id", "term", F.struct("at.part", c("at.rule").cast("long").alias("rule"), c("at.ord").cast("long").alias("ord")).alias("at")).unionByName(asked)
    terms = ordered(found, None)
    out = queries.join(terms.withColumnRenamed("id", id_col), id_col, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    return out.withColumn("expanded", F.array_join(F.array_distinct(F.concat(F.array(F.trim(text_col)), "terms")), " "))

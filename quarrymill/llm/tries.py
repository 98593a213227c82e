"""Conversation prefix trie by padded matrices of turn ids.

Conversations are dealt out by ranges of their sequences of turn ids. A range is a padded matrix, a row a conversation and a column a turn, sorted by
numpy's lexsort; where a row differs from the one above in a column or one before it, nodes start, and reduceat sums every depth. Nodes of a range's first and last row may go on in other
ranges: their parts are recombined on Spark. Long conversations are cut into parts of PART turns, a level each: a part's matrix stands under the node of all
turns before it. Levels that several conversations share are done from the deepest up; where a conversation goes on alone, its nodes
follow from its turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Turns of a part; conversations of a range; ids of one text of ends.
PART, RANGE, ENDS = 64, 20_000, 8192
#: The rebuild of the query: turns lent by the first of FAMILY conversations, at most HEAD.
FAMILY, HEAD = 5, 8
NOTHING = hashlib.sha256(b"").hexdigest()
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: kind: 0 a whole node, 1 a part of one that other ranges may share, 2 some of such a node's ends.
FOUND = "kind int, k1 long, k2 long, depth long, q1 long, q2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, bytes long, ends string, above array<struct<k1:long,k2:long>>"
KEY = ["depth", "k1", "k2"]


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place, a, b (128 bits that stand for role and text) and bytes of every turn; places from 0, by turn (null first), role, and a hash of
    the text. Rows without a conversation are left out. Texts aren't moved; one endless conversation is dealt out to many tasks."""
    c = F.col
    role, text = (F.coalesce(c(n).cast("string"), F.lit("")) for n in ("role", "text"))
    rows = turns.filter(c("conv_id").isNotNull()).select(
        c("conv_id").cast("long").alias("conv_id"), c("turn").cast("long").alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("long").alias("bytes")
    )
    order = ("turn", "role", "a", "b", "copy")
    dealt = common.cut(rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange("conv_id", *order).withColumn("task", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("conv_id", "task").agg(F.count("*").alias("size")).select("conv_id", "task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "task").orderBy(*order)))
    return own.join(base, ["conv_id", "task"]).select("conv_id", (c("base") + c("own") - 1).alias("place"), "a", "b", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, place, a, b, bytes: the first h turns of conversation c - c % 5, then c's own after its first h; h = crc32(c) % 9. A turnless
    conversation has one row with a null place."""
    c = F.col
    rows = common.cut(placed(turns), "places")
    h = lambda conv: F.crc32(conv.cast("string")) % (HEAD + 1)
    heads = rows.filter(c("place") < HEAD).groupBy(c("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "a", "b", "bytes"))).alias("head"))
    convs = rows.select("conv_id").distinct().withColumn("base", c("conv_id") - c("conv_id") % FAMILY).join(heads, "base", "left")
    convs = convs.select("conv_id", F.coalesce(F.slice("head", F.lit(1), h(c("conv_id")).cast("int")), F.array().cast(heads.schema["head"].dataType)).alias("head"))
    lent = convs.select("conv_id", F.explode_outer("head").alias("x")).select("conv_id", "x.*")
    own = rows.filter(c("place") >= h(c("conv_id"))).join(convs.select("conv_id", F.size("head").alias("n")), "conv_id")
    return lent.unionByName(own.select("conv_id", (c("place") - h(c("conv_id")) + c("n")).alias("place"), "a", "b", "bytes"))


def parts(turns: DataFrame, size: int) -> DataFrame:
    """conv_id, part, last, p1, p2 (what stands for all turns before the part) and turns (u, v, bytes): a row a part of size turns at most."""
    c = F.col
    turn = F.when(c("place").isNotNull(), F.struct("place", F.xxhash64("place", "a", "b").alias("u"), F.xxhash64("b", "place", "a").alias("v"), "bytes"))
    rows = turns.groupBy("conv_id", F.coalesce(F.floor(c("place") / size), F.lit(0)).alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.select("conv_id", "part", F.transform("turns", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v"), x["bytes"].alias("bytes"))).alias("turns"))
    by = Window.partitionBy("conv_id").orderBy("part")
    before = by.rowsBetween(Window.unboundedPreceding, -1)

    def folded(k: str) -> Column:
        one = F.aggregate("turns", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x[k]))
        return F.coalesce(F.bit_xor(one).over(before), F.lit(0))

    rows = rows.withColumns({"p1": folded("u"), "p2": folded("v")})
    return rows.withColumn("last", F.lead("part").over(by).isNull())


def ranges(rows: DataFrame, level: int, size: int) -> DataFrame:
    """FOUND rows of one level: rows with conv_id, last, p1, p2, turns and what hangs below each row's end (x_children, x_leaves, x_saved)."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE))
    ids = F.transform("turns", lambda x: F.struct(x["u"].alias("u"), x["v"].alias("v")))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in it if b.num_rows]
        if read:
            t = pa.Table.from_batches(read).combine_chunks()
            yield from trie(t, level * size)

    dealt = rows.withColumn("ids", ids).repartitionByRange(tasks, "p1", "p2", "ids", "conv_id")
    return common.cut(dealt.select("conv_id", "last", "p1", "p2", "turns", "x_children", "x_leaves", "x_saved").mapInArrow(common.lean(task), FOUND), "nodes")


def trie(t: pa.Table, depth: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one range, a batch each depth; depth: that of the node above the level."""
    col = lambda n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False)
    lists = t.column("turns").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, length = lists.flatten(), np.diff(lists.offsets.to_numpy())
    u, v, size = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("u", "v", "bytes"))
    width = int(length.max())
    there = np.arange(width) < length[:, None]

    def padded(x: np.ndarray, fill: int) -> np.ndarray:
        out = np.full(there.shape, fill, np.int64)
        out[there] = x
        return out

    by = np.lexsort((v, u))
    differs = (u[by][1:] != u[by][:-1]) | (v[by][1:] != v[by][:-1])
    turn = np.empty(len(u), np.int64)
    turn[by] = np.concatenate(([0], np.cumsum(differs)))[: len(u)]
    turn = padded(turn, -1)
    conv, p1, p2 = col("conv_id"), col("p1"), col("p2")
    order = np.lexsort((conv, *turn.T[::-1], p2, p1))
    turn, conv, length = turn[order], conv[order], length[order]
    last, below = col("last")[order], [col(n)[order] for n in ("x_children", "x_leaves", "x_saved")]
    keys = [np.bitwise_xor.accumulate(np.column_stack((p, padded(x, 0)))[order], axis=1) for p, x in ((p1, u), (p2, v))]
    size = padded(size, 0)[order]

    new = np.ones((len(conv), width + 1), bool)  # whether the first so many turns are others than in the row above
    new[1:, 0] = (p1[order][1:] != p1[order][:-1]) | (p2[order][1:] != p2[order][:-1])
    new[1:, 1:] = turn[1:] != turn[:-1]
    np.logical_or.accumulate(new, axis=1, out=new)
    starts = new & (np.arange(width + 1) <= length[:, None])
    first = [np.flatnonzero(new[:, d]) for d in range(width + 1)]
    edge = []
    for d, at in enumerate(first):
        e = np.zeros(len(at), bool)
        e[[0, -1]] = True
        edge.append(e & (length[at] >= d))
    shared = np.zeros_like(starts)  # starts of nodes that may go on in other ranges
    for d, at in enumerate(first):
        shared[at[edge[d]], d] = True

    whole = starts & ~shared
    count, children = [], []
    saved, leaves = np.zeros((len(conv), width + 2), np.int64), np.zeros((len(conv), width + 2), np.int64)
    for d, at in enumerate(first):
        n = np.diff(np.append(at, len(conv)))
        kids = np.add.reduceat(whole[:, d + 1].astype(np.int64), at) if d < width else np.zeros(len(at), np.int64)
        kids += np.add.reduceat(np.where(length == d, below[0], 0), at)
        mine = whole[at, d]
        if d:
            saved[at[mine], d] = (n[mine] - 1) * size[at[mine], d - 1]
        leaves[at[mine & (kids == 0)], d] = 1
        count.append(n)
        children.append(kids)
    for total, more in ((leaves, below[1]), (saved, below[2])):
        total[np.arange(len(conv)), length] += more
        total[:] = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]  # of a row, from each depth down

    ended = np.flatnonzero(last)
    names: dict[int, list[np.ndarray]] = {}
    for d in np.unique(length[ended]).tolist():
        rows = ended[length[ended] == d]
        names[d] = [rows, np.searchsorted(first[d], rows, side="right") - 1]

    for d, at in enumerate(first):
        pick = length[at] >= d
        digest, some = np.full(len(at), NOTHING, object), []
        if d in names:
            rows, node = names[d]
            cut = np.flatnonzero(np.diff(node, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
                if edge[d][node[a]]:
                    some += [(node[a], conv[rows[k]], ",".join(map(str, conv[rows[k : min(k + ENDS, b)]].tolist()))) for k in range(a, b, ENDS)]
                else:
                    digest[node[a]] = hashlib.sha256(",".join(map(str, conv[rows[a:b]].tolist())).encode()).hexdigest()
        owner = np.minimum.reduceat(conv, at)
        parent = np.zeros(len(at), np.int64)
        known = np.zeros(len(at), bool)
        if d > 1 or d == 1 and depth == 0:
            up = np.searchsorted(first[d - 1], at, side="right") - 1
            parent, known = before[up], ~edge[d - 1][up]
        above = [[{"k1": int(keys[0][r, j]), "k2": int(keys[1][r, j])} for j in range(d + 1)] if e else None for r, e in zip(at[pick].tolist(), edge[d][pick].tolist(), strict=True)]
        q = keys[0][at, d - 1] if d else np.zeros(len(at), np.int64), keys[1][at, d - 1] if d else np.zeros(len(at), np.int64)
        columns = [
            pa.array(edge[d][pick].astype(np.int32)), pa.array(keys[0][at, d][pick]), pa.array(keys[1][at, d][pick]), pa.array(np.full(pick.sum(), depth + d)), pa.array(q[0][pick]), pa.array(q[1][pick]), pa.array(owner[pick]),
            pa.array(parent[pick], mask=~known[pick]), pa.array(count[d][pick]), pa.array(children[d][pick]), pa.array(np.add.reduceat(leaves[:, d], at)[pick]), pa.array(np.add.reduceat(saved[:, d], at)[pick]),
            pa.array(size[at, d - 1][pick] if d else np.zeros(pick.sum(), np.int64)), pa.array(digest[pick], pa.string()), pa.array(above, pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))),
        ]
        fields = ["kind", "k1", "k2", "depth", "q1", "q2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "bytes", "ends", "above"]
        batch = pa.RecordBatch.from_arrays(columns, fields)
        yield batch
        for node, least, text in some:
            values = {"kind": 2, "k1": keys[0][at[node], d], "k2": keys[1][at[node], d], "depth": depth + d, "conv_id": least, "ends": text}
            yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in batch.schema], fields)
        before = owner


def digests(some: DataFrame) -> DataFrame:
    """The digest of each node's ends, which come in several texts; a task reads a node's texts one after another and holds none of them."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for b in it:
            for *own, text in zip(*(b.column(c).to_pylist() for c in (*KEY, "ends")), strict=True):
                if own == key:
                    digest.update(b"," + text.encode())
                    continue
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "own_ends"])
                key, digest = own, hashlib.sha256(text.encode())
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "own_ends"])

    return some.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id").select(*KEY, "ends").mapInArrow(common.lean(task), "depth long, k1 long, k2 long, own_ends string")


def recombined(found: DataFrame) -> DataFrame:
    """The nodes of a level: whole ones as they are, parts of shared ones summed, with what shared nodes below them add."""
    c = F.col
    edges = found.filter("kind = 1").groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(n).alias(n) for n in ("n_convs", "n_children", "n_leaves", "saved")), *(F.min(n).alias(n) for n in ("bytes", "q1", "q2")), F.first("above").alias("above")
    )
    kids = edges.filter(F.size("above") > 1).groupBy((c("depth") - 1).alias("depth"), c("q1").alias("k1"), c("q2").alias("k2")).agg(F.count("*").alias("kids"))
    edges = edges.join(kids, KEY, "left").withColumn("n_children", c("n_children") + F.coalesce("kids", F.lit(0)))
    own = edges.select("depth", F.size("above").alias("n"), F.posexplode("above").alias("at", "x"), F.when(F.size("above") > 1, (c("n_convs") - 1) * c("bytes")).otherwise(0).alias("more"), (c("n_children") == 0).cast("long").alias("leaf"))
    added = own.groupBy((c("depth") - c("n") + 1 + c("at")).alias("depth"), c("x.k1").alias("k1"), c("x.k2").alias("k2")).agg(F.sum("more").alias("more"), F.sum("leaf").alias("leaf"))
    edges = edges.join(added, KEY).join(digests(found.filter("kind = 2")), KEY, "left")
    edges = edges.select(*KEY, "q1", "q2", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", (c("n_leaves") + c("leaf")).alias("n_leaves"), (c("saved") + c("more")).alias("saved"), F.coalesce("own_ends", F.lit(NOTHING)).alias("ends"))
    edges = common.cut(edges, "edges")
    upper = edges.select((c("depth") + 1).alias("depth"), c("k1").alias("q1"), c("k2").alias("q2"), c("conv_id").alias("up"))
    nodes = found.filter("kind = 0").select(*edges.columns).unionByName(edges)
    return nodes.join(upper, ["depth", "q1", "q2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up")).drop("up")


def nodes(turns: DataFrame, size: int = PART) -> DataFrame:
    """The trie of conversations with rows conv_id, place, a, b, bytes (see rebuilt), by the columns of RESULT.

    A hash of 128 bits stands for a prefix. No conversation, no node; turnless ones are members of the root alone. Repeated conversations are
    members each; a prefix that a third of all conversations share lies in many ranges. The digest of a node's ends is one hash over all of
    them in order, so one task computes it, reading ids as a stream.
    """
    c = F.col
    cut = common.cut(parts(turns, size), "parts")
    deepest = cut.agg(F.max("part")).first()[0]
    if deepest is None:
        return cut.sparkSession.createDataFrame([], RESULT)
    none = [F.lit(0).cast("long").alias(n) for n in ("x_children", "x_leaves", "x_saved")]
    if not deepest:
        return finished(recombined(ranges(cut.select("*", *none), 0, size)))

    group = ["part", "p1", "p2"]
    shared = cut.filter("part > 0").groupBy(*group).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    alone = cut.filter("part > 0").join(shared, group, "left_anti")
    first = alone.groupBy("conv_id").agg(F.min("part").alias("first"))
    levels, under = [], None
    for level in range(shared.agg(F.max("part")).first()[0] or 0, -1, -1):
        rows = cut.filter(c("part") == level)
        rows = rows.join(shared, group, "left_semi") if level else rows
        hung = first.filter(c("first") == level + 1).select("conv_id", F.lit(1).cast("long").alias("x_children"), F.lit(1).cast("long").alias("x_leaves"), none[2])
        if under is not None:
            hung = hung.unionByName(under.select("conv_id", c("n_children").alias("x_children"), c("n_leaves").alias("x_leaves"), c("saved").alias("x_saved")))
        rows = rows.join(hung, "conv_id", "left").fillna(0, ["x_children", "x_leaves", "x_saved"])
        made = common.cut(recombined(ranges(rows, level, size)), "level")
        under = made.filter(c("depth") == level * size) if level else None
        levels.append(made.filter(c("depth") > level * size) if level else made)
    every = levels[0]
    for made in levels[1:]:
        every = every.unionByName(made)
    i, end = c("i"), c("last") & (c("i") == F.size("turns") - 1)
    chain = alone.join(first, "conv_id").select("*", F.posexplode("turns").alias("i", "turn"))
    chain = chain.select(
        (c("part") * size + i + 1).alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), c("p1").alias("q1"), c("p2").alias("q2"), "conv_id", F.when((i > 0) | (c("part") > c("first")), c("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), (~end).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"), F.when(end, F.sha2(c("conv_id").cast("string"), 256)).otherwise(NOTHING).alias("ends"),
    )
    upper = every.filter((c("depth") > 0) & (c("depth") % size == 0)).select((c("depth") + 1).alias("depth"), c("k1").alias("q1"), c("k2").alias("q2"), c("conv_id").alias("up"))
    every = every.unionByName(chain).join(upper, ["depth", "q1", "q2"], "left")
    return finished(every.withColumn("parent_conv_id", F.coalesce(F.when((c("depth") - 1) % size == 0, c("up")), "parent_conv_id")).drop("up"))


def finished(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.select("conv_id", "depth", F.when(c("depth") > 0, c("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", c("saved").alias("saved_tokens"), c("ends").alias("ends_sha256"))


def op12_tries(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    common.ship(spark)
    common.small_batches(spark)
    return nodes(rebuilt(common.table(spark, sf_dir, "conversations")))

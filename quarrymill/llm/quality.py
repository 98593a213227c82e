"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_long_words", "n_letters", "n_ended_lines", "n_distinct_words", "n_bare_words")
WINDOW = 8
SYMBOL, LETTER, LINE_END = (np.isin(np.arange(256), list(s)) for s in (b"#*$%&|<>", bytes([*range(65, 91), *range(97, 123)]), b".!?:;\"')"))
LETTER[0x80:] = True
PLAIN = LETTER | np.isin(np.arange(256), list(b"0123456789"))
FOLLOWS = (np.arange(256) & 0xC0) == 0x80  # bytes that continue a code point

#: Prior belief that a document is good, the accuracy that the first step assumes, and the posterior that keeps a document.
PRIOR, FIRST_ACCURACY, KEEP, STEPS = 0.8, 0.8, 0.4, 50
#: A rule votes bad on so small a share of good documents at most: junk of a rare kind, which few rules see, still counts as junk.
FALSE_ALARM = 0.005


def counts(text: np.ndarray) -> list[int]:
    """The figures of COUNTS for the bytes of one text."""
    start, end, h = common.words(text, lower=False)
    n = len(h)
    if not n:
        return [0, 0, int(SYMBOL[text].sum()), *[0] * 8]
    follows = np.concatenate(([0], np.cumsum(FOLLOWS[text])))
    size = (end - start) - (follows[end] - follows[start])
    newline = np.flatnonzero(text == 10)
    line_of = np.searchsorted(newline, start)  # the line a word stands in
    head = np.flatnonzero(np.concatenate(([True], line_of[1:] != line_of[:-1])))
    lines, at = line_of[head], np.concatenate(([0], newline + 1))
    stop = np.concatenate((newline, [len(text)]))
    seen, dup = set(), 0
    raw = text.tobytes()
    for a, b in zip(at[lines].tolist(), stop[lines].tolist(), strict=True):
        line = raw[a:b]
        dup += line in seen
        seen.add(line)
    runs, repeat = common.windows(h, WINDOW), 0
    if len(runs) > 1:
        _, where, times = np.unique(runs, return_inverse=True, return_counts=True)
        often = np.flatnonzero(times[where] > 1)
        if len(often):
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, often, 1)
            np.add.at(cover, often + WINDOW, -1)
            repeat = int((np.cumsum(cover[:n]) > 0).sum())
    last = end[np.concatenate((head[1:], [n])) - 1] - 1
    plain = np.concatenate(([0], np.cumsum(PLAIN[text])))
    bare = int((plain[end] == plain[start]).sum())
    return [n, int(size.sum()), int(SYMBOL[text].sum()), dup, repeat, len(lines), int((size > 30).sum()), int(LETTER[text].sum() - FOLLOWS[text].sum()), int(LINE_END[text[last]].sum()), len(np.unique(h)), bare]


def figures(texts: pa.Array) -> list[pa.Array]:
    """The columns of COUNTS for a column of texts without nulls."""
    data, at = common.utf8(texts)
    rows = np.array([counts(data[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)], np.int64).reshape(-1, len(COUNTS))
    return [pa.array(rows[:, k]) for k in range(len(COUNTS))]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the figures of COUNTS for the whole text of every row; a null text counts as empty, all its figures are 0."""
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), *figures(b.column(1))], ["doc_id", *COUNTS])

    return common.id_text(docs, id_col, text_col).mapInArrow(common.lean(task), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 for good, -1 for bad, 0 where it abstains. Two limits leave a gap in which a rule has no opinion."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    return {
        "length": rule(c("n_words") < 20, c("n_words") >= 40),
        "repeats": rule(100 * c("n_repeat_words") > 30 * c("n_words"), 100 * c("n_repeat_words") <= 10 * c("n_words")),
        "symbols": rule(100 * c("n_symbols") > 20 * n, 100 * c("n_symbols") <= 1 * n),
        "bare_words": rule(100 * c("n_bare_words") > 15 * n, 100 * c("n_bare_words") <= 2 * n),
        "same_lines": rule((c("n_lines") >= 5) & (100 * c("n_dup_lines") > 30 * c("n_lines")), 100 * c("n_dup_lines") <= 10 * c("n_lines")),
        "word_size": rule((c("word_chars") < 2 * n) | (c("word_chars") > 12 * n), (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n)),
        "long_words": rule(100 * c("n_long_words") > 5 * n, c("n_long_words") == 0),
        "letters": rule(100 * c("n_letters") < 70 * c("word_chars"), 100 * c("n_letters") >= 85 * c("word_chars")),
        "ended_lines": rule((c("n_lines") >= 5) & (100 * c("n_ended_lines") < 10 * c("n_lines")), 100 * c("n_ended_lines") >= 60 * c("n_lines")),
        "vocabulary": rule(100 * c("n_distinct_words") < 10 * F.least(n, F.lit(1000)), 100 * c("n_distinct_words") >= 20 * F.least(n, F.lit(1000))),
    }


def fit(patterns: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the two-class model with independent rules over vote patterns and how often each occurs.

    Returns, by rule, class (bad, good) and vote (-1, 0, 1), the probability of a vote given the class, and the share of good documents.
    The first step takes every rule to be FIRST_ACCURACY accurate; each class keeps a little of that belief as a pseudo-count, so
    that the classes can't change places, bad votes on good documents are held to FALSE_ALARM, and a rule that one class never meets stays defined.
    """
    rules = patterns.shape[1]
    share = np.array([[(patterns[:, r] == v) @ weight for v in (-1, 0, 1)] for r in range(rules)]) / max(weight.sum(), 1)
    abstain = np.clip(share[:, 1], 0.0, 0.98)
    first = np.empty((rules, 2, 3))
    for cls in (0, 1):
        right = FIRST_ACCURACY * (1 - abstain)
        first[:, cls] = np.stack([right if cls == 0 else 1 - abstain - right, abstain, right if cls == 1 else 1 - abstain - right], 1)
    first = np.clip(first, 1e-4, None)
    p, good = first.copy(), PRIOR
    held = 0.02 * weight.sum() + 1
    for _ in range(STEPS):
        q = posterior(patterns, p, good)
        for cls, part in ((0, weight * (1 - q)), (1, weight * q)):
            for k, v in enumerate((-1, 0, 1)):
                p[:, cls, k] = ((patterns == v) * part[:, None]).sum(0) + held * first[:, cls, k]
            p[:, cls] /= p[:, cls].sum(1, keepdims=True)
        p[:, 1, 0] = np.minimum(p[:, 1, 0], FALSE_ALARM)
        p[:, 1] /= p[:, 1].sum(1, keepdims=True)
        good = float(np.clip((weight @ q + held * PRIOR) / (weight.sum() + held), 0.01, 0.99))
    return p, good


def posterior(patterns: np.ndarray, p: np.ndarray, good: float) -> np.ndarray:
    """The probability that a document with such votes is good."""
    rules = np.arange(patterns.shape[1])
    logs = np.log(p)
    bad, fine = (logs[rules, cls, patterns + 1].sum(1) for cls in (0, 1))
    return 1 / (1 + np.exp(np.clip(bad + np.log(1 - good) - fine - np.log(good), -700, 700)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """doc_id, the figures of COUNTS, base_failed, posterior and kept of every row.

    The rules' accuracies are estimated from all documents: their vote patterns are counted (at most 3 to the power of the
    number of rules, whatever the input), only those counts reach the driver, and the posterior of each pattern goes back as a
    small table. kept is false where base_failed, else posterior >= keep. An empty or null text fails; an empty table gives an
    empty result; repeated rows are judged alike; other columns aren't read.
    """
    seen = common.cut(features(docs, id_col, text_col).withColumn("pattern", pattern()), "quality")
    got = verdicts(seen, posteriors(seen), keep)
    return got.select("doc_id", *COUNTS, "base_failed", "posterior", "kept")


def kept_rows(docs: DataFrame, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns.

    A row carries its own verdict and no id is read: rows with a null id are judged as others are, and of rows that share an id each
    stays or goes by its own text. Texts are read twice, for the rules' accuracies and for the verdicts, rather than written between.
    """
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)
    rows = docs.toDF(*(cells := [f"cell{k}" for k in range(len(docs.columns))]))
    at = docs.columns.index(text_col)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, *figures(b.column(at).cast(pa.string()).fill_null(""))], [*cells, *COUNTS])

    schema = StructType([*rows.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    scores = posteriors(features(rows.withColumn("id", F.lit(0)), "id", cells[at]).select(pattern().alias("pattern")))
    return verdicts(rows.mapInArrow(common.lean(task), schema).withColumn("pattern", pattern()), scores, keep).filter("kept").select(cells).toDF(*docs.columns)


def pattern() -> Column:
    """All votes as one number."""
    return sum(((v + 1) * 3**k for k, v in enumerate(votes().values())), F.lit(0)).cast("int")


def posteriors(seen: DataFrame) -> DataFrame:
    """pattern and posterior of the vote patterns in seen: a row a pattern."""
    rules, found, table = len(votes()), seen.groupBy("pattern").count().collect(), {}
    if found:
        codes = np.array([r["pattern"] for r in found])
        patterns = np.stack([codes // 3**k % 3 - 1 for k in range(rules)], 1)
        p, good = fit(patterns, np.array([r["count"] for r in found], float))
        table = dict(zip(codes.tolist(), posterior(patterns, p, good).round(9).tolist(), strict=True))
    return seen.sparkSession.createDataFrame([(k, v) for k, v in table.items()], "pattern int, posterior double")


def verdicts(rows: DataFrame, scores: DataFrame, keep: float) -> DataFrame:
    """rows, which have the figures of COUNTS and their pattern, with base_failed, posterior and kept."""
    return rows.join(F.broadcast(scores), "pattern").withColumns({"base_failed": base_failed(), "kept": ~base_failed() & (F.col("posterior") >= keep)})


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's figures and the verdict on every document."""
    got = judge(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

"""Documents into chunks: by headings and what a chunk may hold, by windows of tokens, or by windows of words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Splits a text into pieces that, joined, are the text again; a text has as many tokens as pieces, one at least.
Tokenizer = Callable[[str], list[str]]
HEADING, PARAGRAPH, SENTENCE = re.compile(r"(#{1,6})\s+(.+)"), re.compile(r"\n{2,}"), re.compile(r"[^。！？!?；;\n]+[。！？!?；;\n]?|\n+")
MOST_TOKENS, LEAST, MOST, OVERLAP = 512, 64, 8192, 100


def pieces(t: str) -> list[str]:
    """A plain tokenizer: words, up to three digits and single marks, each with the white space before it."""
    return re.findall(r"\s*(?:[^\W\d_]+|\d{1,3}|[^\w\s]|_)|\s+", t)


@cache
def vocabulary(path: str):
    """One vocabulary a worker."""
    from tokenizers import Tokenizer as Vocabulary

    return Vocabulary.from_file(path)


def bpe(path: str) -> Tokenizer:
    """The tokens of a vocabulary file of the tokenizers library, as pieces of the text; a token within a character is an empty piece."""

    def split(t: str) -> list[str]:
        ends = [e for _, e in vocabulary(path).encode(t, add_special_tokens=False).offsets]
        last = 0
        out = []
        for k, e in enumerate(ends):
            e = len(t) if k == len(ends) - 1 else max(e, last)
            out.append(t[last:e])
            last = e
        return out

    return split


def sized(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(int(default if value is None else value), high))


def by_heading(t: str) -> list[tuple[str, str]]:
    """Heading and lines of each section; a heading's own line belongs to it, and what stands before the first goes if it is blank."""
    out: list[tuple[str, list[str]]] = [("Introduction", [])]
    for line in t.replace("\r\n", "\n").split("\n"):
        if m := HEADING.fullmatch(line):
            out.append((m[2].strip(), [line]))
        else:
            out[-1][1].append(line)
    return [(h, body) for h, lines in out if (body := "\n".join(lines).strip())]


def packed(parts: list[str], joiner: str, most: int, count: Callable[[str], int], divide: Callable[[str], list[str]]) -> list[str]:
    """Parts joined in order while their own tokens, joiners not counted, are most or fewer; a part that is larger is divided."""
    out, now, n = [], [], 0
    for part in parts:
        size = count(part)
        if now and (size > most or n + size > most):
            out.append(joiner.join(now))
            now, n = [], 0
        if size > most:
            out += divide(part)
        else:
            now.append(part)
            n += size
    return [*out, joiner.join(now)] if now else out


def forced(t: str, most: int, tokenize: Tokenizer) -> list[str]:
    """Pieces of most tokens or fewer, white space between them left out. The text is tokenized once; a piece that has more tokens on its own gives its
    last ones to the next."""
    tokens, out, at = tokenize(t.strip()), [], 0
    while at < len(tokens):
        end = min(at + most, len(tokens))
        while len(tokenize(piece := "".join(tokens[at:end]).strip())) > most and end > at + 1:
            end -= 1
        out.append(piece)
        at = end
    return [x for x in out if x]


def chunk(t: str, mode: str | None, most: int | None, overlap: int | None, tokenize: Tokenizer) -> list[tuple[str, str]]:
    """Heading and text of each chunk of one document."""

    def count(x: str) -> int:
        return max(1, len(tokenize(x)))

    limit = sized(most, MOST_TOKENS, LEAST, MOST)
    if (mode or ("heading_strict" if most is None and overlap is None else "token")) == "heading_strict":
        sentences = lambda x: [y for p in packed(SENTENCE.findall(x) or [x], "", limit, count, lambda s: forced(s, limit, tokenize)) if (y := p.strip())]
        return [(h, p) for h, body in by_heading(t) for p in (packed(PARAGRAPH.split(body), "\n\n", limit, count, sentences) if count(body) > limit else [body])]
    tokens, out = tokenize(t), []
    stride = max(1, limit - sized(overlap, OVERLAP, 0, limit - 1))
    for start in range(0, len(tokens), stride):
        end = min(start + limit, len(tokens))
        while count(text := "".join(tokens[start:end]).strip()) > limit and end > start + 1:
            end -= 1
        if text:
            out.append((next((m[2].strip() for line in text.split("\n") if (m := HEADING.fullmatch(line))), "Introduction"), text))
        if end >= len(tokens):
            break
    return out


def chunk_markdown(docs: DataFrame, mode: str | None = None, max_tokens: int | None = None, overlap: int | None = None, tokenize: Tokenizer = pieces) -> DataFrame:
    """doc_id, rank, heading, content and n_tokens of each document's chunks.

    mode heading_strict, the default unless a size is given: a section for each Markdown heading, in order; one of more than
    max_tokens is packed from its paragraphs, a larger paragraph from its sentences, a larger sentence cut. mode token: windows of
    max_tokens that overlap. max_tokens is held to 64 to 8192, overlap to less than that. A null or blank text gives no rows. Time grows with a
    text's length, whatever its sentences are. Each row is chunked within its task; only an input of fewer files than cores is dealt out anew.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(doc, k, h, x, max(1, len(tokenize(x)))) for doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, (h, x) in enumerate(chunk(t or "", mode, max_tokens, overlap, tokenize))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64()), strict=True)], ["doc_id", "rank", "heading", "content", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cores = spark.sparkContext.defaultParallelism
    rows = rows.repartition(cores) if len(docs.inputFiles()) < cores else rows
    return rows.mapInArrow(task, "doc_id long, rank int, heading string, content string, n_tokens long")


def word_windows(docs: DataFrame, size: int = 512, overlap: int = 100) -> DataFrame:
    """doc_id, rank and content of windows of size words, each starting size - overlap words after the last; none starts past the end."""
    size = max(1, size)
    stride = size - max(0, min(overlap, size - 1))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - size) / stride), F.lit(0)).cast("int"))
    cut = docs.select("doc_id", words.alias("words")).filter(F.size("words") > 0).select("doc_id", "words", F.explode(starts).alias("rank"))
    return cut.select("doc_id", "rank", F.array_join(F.slice("words", F.col("rank") * stride + 1, size), " ").alias("content"))

"""Text as columns, without Python on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that aren't keywords
STOP_WORDS = ("the", "and", "for", "with", "from", "that")


def squeeze(t: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip_markdown(t: Column) -> Column:
    """Plain text of Markdown: code, images, links, headings and marks go, their words stay."""
    for pattern, to in ((r"(?s)```.*?```", " "), (r"`([^`]+)`", "$1"), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]+)\]\([^)]*\)", "$1"), (r"(?m)^#{1,6}\s+", ""), (r"[*_~>#-]+", " ")):
        t = F.regexp_replace(t, pattern, to)
    return squeeze(t)


def keywords(t: Column, most: int = 10) -> Column:
    """The first distinct words of three letters or more, lower case, without stop words."""
    words = F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}\s_-]", " "), r"\s+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))), 1, most)


def named_entities(t: Column, most: int = 20) -> Column:
    """Runs of up to five capitalised words, in order, each once; words end at what isn't an ASCII letter, digit or underscore."""
    found = F.regexp_extract_all(t, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Za-z0-9]+(?:[- ][A-Z][A-Za-z0-9]+){0,4}(?![A-Za-z0-9_])"), 0)
    return F.slice(F.array_distinct(found), 1, most)


def trigrams(t: Column) -> Column:
    """Distinct three-letter pieces of the words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substr(w, k, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def occurrences(t: Column, term: str) -> Column:
    """Non-overlapping places of a term, letter case aside."""
    low = F.lower(t)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")


def preview(t: Column, most: int) -> Column:
    """White space squeezed; cut to most characters, the last an ellipsis."""
    s = squeeze(t)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most - 1), F.lit("…")))


def slices(t: Column, size: int) -> Column:
    """The text in pieces of so many characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / size).cast("int") - 1, F.lit(0))), lambda k: F.substr(t, k * size + 1, F.lit(size)))


def conversation_title(t: Column, most_words: int = 8, default: str = "New conversation") -> Column:
    """The first words of a message without Markdown marks, polite openings and final punctuation."""
    s = F.regexp_replace(F.regexp_replace(t, r"(?s)```.*?```", " "), r"`([^`]+)`", "$1")
    s = squeeze(F.regexp_replace(s, r"[#>*_\-\[\](){}]", " "))
    s = F.regexp_replace(s, r"(?i)^(please )?(could you|can you|would you|help me|tell me) ", "")
    s = F.trim(F.regexp_replace(s, r"(?i)^(please )?(explain|summarize|analyze) ", ""))
    title = F.array_join(F.slice(F.filter(F.split(F.regexp_replace(s, r"[?.!,;:]+$", ""), " "), lambda w: w != ""), 1, most_words), " ")
    return F.when(title == "", default).otherwise(title)


def query_terms(query: str) -> list[str]:
    return [w for w in query.lower().split() if len(w) >= 2]


def contains_any(t: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for w in terms:
        out = out | F.lower(t).contains(w)
    return out

"""Personal data by anchor expansion: an Aho-Corasick pass finds cues, local parsers expand and validate the spans around them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("account", "url")
#: Cues after which an account or identity number stands.
ACCOUNT_CUES = ("iban", "account", "acct", "ssn", "passport", "swift", "routing", "konto", "cuenta", "compte")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | DIGITS
LOCAL, DOMAIN = ALNUM | frozenset("._%+-"), ALNUM | frozenset("-")
PHONE_RUN, ACCOUNT_RUN = DIGITS | frozenset(" ().-"), ALNUM | frozenset(" -")
SCHEME, URL_END = ALNUM | frozenset("+.-"), frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^")
#: Most letters and digits of an account number; lengths of IBANs by country.
LONGEST = 34
IBAN_SIZES = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for s in ("@", "+", "://", *DIGITS):
        a.add_word(s, (s, len(s)))
    for s in ACCOUNT_CUES:
        for form in {s, s.upper(), s.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def run_end(t: str, at: int, of: frozenset) -> int:
    n = len(t)
    while at < n and t[at] in of:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """Expand an at-sign: local part to the left, not before floor; labels joined by dots to the right."""
    start = at
    while start > floor and t[start - 1] in LOCAL:
        start -= 1
    end = run_end(t, at + 1, DOMAIN)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end < len(t) and t[end] == "." and (more := run_end(t, end + 1, DOMAIN)) > end + 1:
        end, labels = more, labels + 1
    return (start, end) if labels else None


def address_chain(t: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The address candidates in the chain of dotted numbers that starts at a digit, four numbers each, and where the chain ends."""
    parts, end = [], at
    while True:
        stop = run_end(t, end, DIGITS)
        parts.append((end, stop))
        if stop < len(t) - 1 and t[stop] == "." and t[stop + 1] in DIGITS:
            end = stop + 1
        else:
            break
    good = [(parts[k][0], parts[k + 3][1]) for k in range(0, len(parts) - 3, 4) if all(len(p := t[a:b].lstrip("0")) <= 3 and int(p or 0) <= 255 for a, b in parts[k : k + 4])]
    return good, parts[-1][1]


def card_chain(t: str, at: int) -> tuple[tuple[int, int] | None, int]:
    """The chain of digits with single blanks or hyphens between that starts at a digit, if it is a card number, and where it ends."""
    end, digits, n = at + 1, [t[at]], len(t)
    while end < n:
        step = 1 if t[end] in DIGITS else 2 if t[end] in " -" and end + 1 < n and t[end + 1] in DIGITS else 0
        if not step:
            break
        digits.append(t[end + step - 1])
        end += step
    return ((at, end) if 14 <= len(digits) <= 19 and luhn("".join(digits)) else None), end


def phone_at(t: str, at: int) -> tuple[int, int] | None:
    """Expand a plus sign to the last digit of the run of phone characters behind it."""
    if at + 1 >= len(t) or t[at + 1] not in DIGITS:
        return None
    end = run_end(t, at + 2, PHONE_RUN)
    while end > at + 2 and t[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 and 10 <= sum(c in DIGITS for c in t[at:end]) <= 15 else None


def iban_end(t: str, at: int) -> int | None:
    """Where the IBAN that starts at at ends: its country's length, single blanks or hyphens between, remainder 1 modulo 97."""
    size, code, end = IBAN_SIZES.get(t[at : at + 2].upper(), 0), "", at
    while len(code) < size and end < len(t):
        if t[end] in ALNUM:
            code += t[end].upper()
        elif t[end] not in " -" or t[end - 1] in " -":
            return None
        end += 1
    if not size or len(code) < size or (end < len(t) and t[end] in ALNUM):
        return None
    return end if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def account_after(t: str, at: int) -> tuple[int, int] | None:
    """The number behind a cue that ends at at: up to 12 separators, then an IBAN, or 6 to 34 letters and digits, 5 digits at least.

    A number other than an IBAN ends before a token without a digit and before one that would make it longer than that; separators
    in it don't count.
    """
    if at < len(t) and t[at] in ALNUM:
        return None
    start = at
    while start < min(len(t), at + 12) and t[start] not in ALNUM:
        start += 1
    end = here = start
    size = digits = 0
    while True:
        if not digits and (whole := iban_end(t, here)):
            return start, whole
        stop, more, more_digits = here, 0, 0
        while stop < len(t) and t[stop] in DOMAIN and size + more <= LONGEST:
            more, more_digits, stop = more + (t[stop] in ALNUM), more_digits + (t[stop] in DIGITS), stop + 1
        token = t[here : here + 48].split(" ", 1)[0]
        if not more_digits and not any(c in DIGITS for c in token) and not (end == start and token.lower().strip(":#.") in ("no", "nr", "number", "num")):
            break
        if size + more > LONGEST:
            break
        end, size, digits = stop, size + more, digits + more_digits
        if stop == len(t) or t[stop] != " ":
            break
        here = stop + 1
    return (start, end) if digits >= 5 and size >= 6 else None


def url_at(t: str, at: int) -> tuple[int, int] | None:
    """Expand '://' to a scheme on the left and to white space or a quote on the right; final punctuation is left out."""
    start = at
    while start and t[start - 1] in SCHEME:
        start -= 1
    end, n = at + 3, len(t)
    while end < n and t[end] not in URL_END:
        end += 1
    while end > at + 3 and t[end - 1] in ".,;:!?)]":
        end -= 1
    return (start, end) if start < at and end > at + 3 else None


def find(t: str) -> list[tuple[int, int, str, int]]:
    """All spans of one text as (start, order of kind, kind, end), sorted. Base kinds equal leftmost non-overlapping matches of their patterns."""
    out, email_floor, chain_end, card_end, phone_end, url_end = [], 0, 0, 0, 0, 0
    accounts = []
    for last, (cue, size) in automaton().iter(t):
        at = last - size + 1
        if cue == "@":
            if at >= email_floor and (x := email_at(t, at, email_floor)):
                out.append((x[0], 0, "email", x[1]))
                email_floor = x[1]
        elif cue == "+":
            if at >= phone_end and (x := phone_at(t, at)):
                out.append((x[0], 3, "phone", x[1]))
                phone_end = x[1]
        elif cue == "://":
            if at >= url_end and (x := url_at(t, at)):
                out.append((x[0], 5, "url", x[1]))
                url_end = x[1]
        elif cue == "cue":
            if (at == 0 or t[at - 1] not in ALNUM) and (x := account_after(t, last + 1)):
                accounts.append((x[0], 4, "account", x[1]))
        else:
            if at >= chain_end:
                good, chain_end = address_chain(t, at)
                out += [(a, 1, "ip", b) for a, b in good]
            if at >= card_end:
                x, card_end = card_chain(t, at)
                if x:
                    out.append((x[0], 2, "card", x[1]))
    taken = {(s[0], s[3]) for s in out}
    floor = 0
    for s in sorted(accounts):
        if s[0] >= floor and (s[0], s[3]) not in taken:
            out.append(s)
            floor = s[3]
    return sorted(out)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every document.

    A null text counts as empty and has no spans; repeated rows each give a row; other columns aren't read. Texts are never cut.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in it:
            spans = [[{"kind": s[2], "start": s[0], "end": s[3]} for s in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return common.id_text(docs, id_col, text_col).mapInArrow(common.lean(task), SPANS)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets, as [EMAIL]; overlapping spans become one mark of the first kind.

    Other columns, null texts and texts without spans stay as they are. Work is one pass over the rows, without a shuffle.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    at = docs.columns.index(text_col)

    def clean(t: str | None) -> str | None:
        spans = find(t) if t else ()
        if not spans:
            return t
        out, done, mark_end = [], 0, -1
        for start, _, kind, end in spans:
            if start >= mark_end:
                out += [t[done:start], f"[{kind.upper()}]"]
                mark_end = end
            mark_end = max(mark_end, end)
            done = mark_end
        return "".join([*out, t[done:]])

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            columns = list(b.columns)
            columns[at] = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(common.lean(task), docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans in every document."""
    found = find_pii(common.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def summary(spans: DataFrame) -> DataFrame:
    """Documents and spans of each kind."""
    return spans.select("doc_id", F.explode("spans").alias("s")).groupBy(F.col("s.kind").alias("kind")).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_spans"))

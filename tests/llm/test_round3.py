"""Fingerprints, tries and hard negatives against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import fingerprints, licenses, negatives, packing, records, tokens, tries

WORDS = "amber boat cedar delta ember field grain harbor island jacket kettle lantern meadow needle orchard pepper quarry river saddle timber".split()


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "é"]) for _ in range(n))


def plain_class(window: bytes) -> int:
    return sum(round(c * math.log2(c) * (1 << 20)) for c in Counter(window).values())


def plain_features(text: bytes, rank: dict[int, int]) -> list[int]:
    n = len(text) - fingerprints.WINDOW + 1
    place = [rank.get(plain_class(text[k : k + fingerprints.WINDOW]), -1) for k in range(n)]
    found = []
    for a in range(max(n - fingerprints.RUN + 1, 1) if n > 0 else 0):
        run = range(a, min(a + fingerprints.RUN, n))
        best = min(run, key=lambda k: (place[k], k))
        found += [best] if not found or found[-1] != best else []
    return found


def test_fingerprint_features_equal_plain_ones(spark):
    rnd = random.Random(1)
    texts = ["", "short", "x" * 15, "y" * 16, prose(rnd, 4), "é" * 90, prose(rnd, 60), prose(rnd, 400), "ab" * 300, prose(rnd, 9)]
    data = [t.encode() for t in texts]
    counts = Counter(plain_class(d[k : k + 16]) for d in data for k in range(len(d) - 15))
    got, size = fingerprints.class_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert got == counts and size == sum(map(len, data))
    known, rank = fingerprints.ranks(got)
    by = dict(zip(known.tolist(), rank.tolist(), strict=True))
    assert sorted(by.values()) == list(range(len(by)))
    low = [c for c in counts if fingerprints.entropy(c) < fingerprints.PLAIN]
    assert low and min(by[c] for c in low) > max(by[c] for c in counts if c not in low)
    at = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    places = fingerprints.picked(np.frombuffer(b"".join(data), np.uint8), at, known, rank)
    for k, d in enumerate(data):
        mine = (places[(places >= at[k]) & (places < at[k + 1])] - at[k]).tolist()
        assert mine == plain_features(d, by)
    chains = fingerprints.fingerprints(data, known, rank)
    assert [len(c) for c in chains[:3]] == [0, 1, 1] and len({c.tobytes() for c in chains}) == len(texts)
    for d, c in zip(data, chains, strict=True):
        bits = [np.zeros(fingerprints.BITS, bool) for _ in range(-(-len(plain_features(d, by)) // fingerprints.EACH))]
        for k, p in enumerate(plain_features(d, by)):
            h = int(fingerprints.hashed(np.frombuffer(d, np.uint8), np.array([p]))[0])
            for j in range(fingerprints.HASHES):
                bits[k // fingerprints.EACH][(h >> 11 * j) % fingerprints.BITS] = True
        if len(d) >= 16:
            assert np.array_equal(np.packbits(np.array(bits), axis=1), c)


def test_long_texts_by_pieces_and_in_a_batch_are_alike(monkeypatch):
    rnd = random.Random(2)
    data = [prose(rnd, n).encode() for n in (3, 50, 700, 1200)]
    known, rank = fingerprints.ranks(Counter(plain_class(d[k : k + 16]) for d in data for k in range(len(d) - 15)))
    whole = fingerprints.fingerprints(data, known, rank)
    monkeypatch.setattr(fingerprints, "AT_ONCE", 300)
    monkeypatch.setattr(fingerprints, "TOGETHER", 100)
    assert all(np.array_equal(a, b) for a, b in zip(whole, fingerprints.fingerprints(data, known, rank), strict=True))
    assert fingerprints.likeness(whole[2], whole[2]) == 1 and fingerprints.likeness(whole[2], whole[3]) < 0.1
    assert fingerprints.likeness(whole[0][:0], whole[0][:0]) == 1 and fingerprints.likeness(whole[0][:0], whole[3]) == 0


def test_fingerprints_of_rows_and_edited_texts(spark):
    rnd = random.Random(3)
    texts = {k: prose(rnd, rnd.randint(40, 300)) for k in range(0, 120, 3)} | {40: None, 41: "", 7: "brief"}
    texts[50] = texts[48]
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in texts.items()], "doc_id long, text string, range string, guest boolean").repartition(4)
    got = {r.doc_id: r for r in fingerprints.compare(docs).collect()}
    assert len(got) == len(texts)
    order = sorted(texts)
    for k, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, after = texts[k] or "", texts[nxt] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other = fingerprints.filters_of(got[k].fingerprint), fingerprints.filters_of(got[nxt].fingerprint)
        assert got[k].near_next == fingerprints.likeness(own, other)
        if len(t) > 200 and after and nxt != 50:
            assert got[k].near_edited > 0.2 > got[k].near_next
    assert got[48].near_next == 1 and got[48].fingerprint == got[50].fingerprint
    twice = fingerprints.compare(spark.createDataFrame([(None, "a" * 40), (5, "b" * 40), (5, "b" * 40)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.near_next) for r in twice) == [(0, 0.0), (5, 0.0), (5, 1.0)]
    assert fingerprints.compare(docs.limit(0)).collect() == []
    assert [r.near_next for r in fingerprints.compare(docs.filter("doc_id = 3")).collect()] == [1.0]


def plain_trie(rows: list[tuple]) -> list[tuple]:
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for v in turns.values():
        v.sort()
    made = {}
    for conv, v in turns.items():
        h = zlib.crc32(str(conv).encode()) % 9
        made[conv] = tuple(x[2:] for x in turns.get(conv - conv % 5, [])[:h]) + tuple(x[2:] for x in v[h:])
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for conv, s in made.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(conv)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in kids
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1].encode()) if node else 0
    digest = lambda node: hashlib.sha256(",".join(map(str, sorted(c for c in members[node] if made[c] == node))).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], digest(n)) for n, m in members.items()), key=repr)


@pytest.mark.parametrize("size", [2, 5, 64])
def test_trie_equals_plain_one(spark, monkeypatch, size):
    rnd = random.Random(size)
    rows = [(c, None if t == 0 and rnd.random() < 0.1 else t, rnd.choice(["u", None]) if c % 3 else "u", rnd.choice(["x", "é", None]) if c % 4 else "x", "e", 0) for c in range(60) for t in range(12 if c % 7 == 0 else rnd.randint(1, 9))]
    rows += [(None, 1, "u", "x", "e", 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ends string, depth int")
    monkeypatch.setattr(tries, "RANGE", 9)  # many ranges, so that nodes go on in others
    monkeypatch.setattr(tries, "ENDS", 3)
    got = tries.nodes(tries.rebuilt(table), size).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie([r[:4] for r in rows])


def test_trie_of_one_common_conversation_and_of_none(spark):
    rows = [(c, t, "u", "same") for c in range(0, 400, 5) for t in range(3)] + [(1, 0, "u", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, tries.nodes(tries.rebuilt(table), 2).collect()), key=repr) == plain_trie(rows)
    assert tries.nodes(tries.rebuilt(table.limit(0))).collect() == []


def plain_negatives(rows: list[tuple], every: int) -> list[tuple]:
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in good:
        if i % every == 0:
            ranked = sorted(((-score(v, w), j, other) for j, other, w in good), key=lambda x: x[:2])
            for p, j, _ in [x for x in ranked if x[2] == label and x[1] != i][:5]:
                fits = [x for x in ranked if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
                out += [(i, j, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dims,spread", [(6, 0.05), (9, 0.6), (2, 30.0)])
def test_negatives_equal_brute_force(spark, monkeypatch, dims, spread):
    rnd = random.Random(dims)
    centres = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + rnd.gauss(0, spread) for x in rnd.choice(centres)], rnd.randint(0, 3)) for i in range(400)]
    rows += [(i, rows[0][1], i % 2) for i in range(400, 520)]  # one vector with many copies
    rows += [(520, None, 1), (530, [1.0] * dims, None), (540, [float("nan")] * dims, 1), (550, [None] * dims, 1), (560, [float("inf")] * dims, 1), (570, [], 2), (580, [0.5], 2)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, data string, part int").repartition(3)
    for name, value in (("PER_CELL", 8), ("CHUNK", 16), ("FIRST_ROWS", 40), ("BLOCK", 16)):
        monkeypatch.setattr(negatives, name, value)
    got = negatives.mine(table, F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == plain_negatives(rows, 10)


def test_negatives_in_whole_numbers_and_without_rows(spark):
    rows = [(i, [float(1 << 20) * (i % 7), -3.0 * i, 1e300], i % 3) for i in range(40)]  # scores beyond 53 bits, a component beyond what is held
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    held = [(i, [max(-float(1 << 26), min(float(1 << 26), 256 * x)) / 256 for x in v], label) for i, v, label in rows]
    assert sorted(map(tuple, negatives.mine(table, F.col("vec_id") % 10 == 0).collect())) == plain_negatives(held, 10)
    assert negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(table, F.col("vec_id") < 0).collect() == []


def plain_licenses(text, templates):
    import re

    from quarrymill.llm import common

    words = [w for w in re.split(licenses.SEPARATOR, (text or "").translate(str.maketrans(common.UPPER, common.LOWER))) if w]
    base, labels, damaged, score = [], set(), set(), 0.0
    for t in templates:
        n = len(t.words)
        for start in range(-n, len(words)):
            hits = [0 <= start + k < len(words) and words[start + k] == t.words[k] for k in range(n)]
            if all(hits[t.key : t.end]):
                labels.add(t.label)
                base += [start] if t.base else []
                score = max(score, sum(hits) / n)
            elif n >= licenses.LONG and not t.base and sum(hits) / n >= licenses.MATCHED:
                damaged.add(t.label)
    return len(words), sorted(base), sorted({t.label for t in templates if t.base} & labels), sorted(labels), sorted(damaged), round(score, 6)


def test_licenses_equal_a_plain_scan(spark):
    rnd = random.Random(11)
    templates = licenses.BASE + licenses.TEMPLATES
    texts = [None, "", " .. ", "cc by cc by", "All rights reserved. ALL-RIGHTS reserved x"]
    for _ in range(150):
        words = []
        for _ in range(rnd.randint(1, 4)):
            own = list(rnd.choice(templates).words)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):  # damage
                k = rnd.randrange(len(own))
                own[k] = rnd.choice(["spoiled", "the", "license", own[rnd.randrange(len(own))]])
            cut = rnd.choice([0, 0, 0, rnd.randrange(len(own))])
            words += own[cut:] + [rnd.choice(["and", "of", "zebra", "mit", "gnu"]) for _ in range(rnd.randint(0, 6))]
        texts.append(rnd.choice([" ", ", "]).join(w.upper() if rnd.random() < 0.1 else w for w in words))
    texts += texts[5:8]
    docs = spark.createDataFrame([(k, t, ["x"], 1) for k, t in enumerate(texts)], "doc_id long, text string, words array<string>, spots int").repartition(3)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert sum(bool(r.damaged) for r in got.values()) > 20 and len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.base, r.base_labels, r.labels, r.damaged, r.score) == plain_licenses(t, templates), t
    assert licenses.scan(docs.limit(0)).collect() == []


def test_packing_fit_is_close_and_places_most_pieces():
    rnd = np.random.default_rng(4)
    lengths = np.clip(rnd.lognormal(6, 1.0, 60_000).astype(int), 1, 2048)
    count = np.bincount(lengths, minlength=2049)
    found = packing.patterns(count, 2048)
    assert all(2048 - packing.SLACK <= sum(p) <= 2048 and len(p) <= packing.DOCUMENTS + 2 and (count[list(p)] > 0).all() for p in found)
    x, error = packing.fit(found, count.astype(float))
    assert (x >= 0).all() and error < 0.15
    left = count.copy()
    used = packing.rounded(found, x, left)
    placed = sum(len(found[k]) * n for k, n in used)
    assert left.min() >= 0 and placed == count.sum() - left.sum() and placed > 0.6 * count.sum()
    rows = packing.plan({n: int(c) for n, c in enumerate(count) if c})
    ends: dict[int, int] = {}
    for n in np.flatnonzero(count).tolist():
        own = rows[rows[:, 0] == n]
        ranks = np.append(own[:, 1], count[n])
        assert ranks[0] == 0 and (np.diff(ranks) > 0).all()
        for (_, first, sequence, _), after in zip(own.tolist(), ranks[1:].tolist(), strict=True):
            for k in range(after - first):
                ends[sequence + k] = ends.get(sequence + k, 0) + n
    assert max(ends.values()) <= 2048 and len(ends) <= lengths.sum() / 2048 * 1.002 + 2


def test_packing_splits_a_hot_id(spark):
    rows = [(7, "one word")] * 300 + [(None, "two words more")] * 300
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("sequence_id", "offset").collect()
    ends: dict[int, int] = {}
    for p in packed:
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert len(packed) == 600 and max(ends.values()) <= 2048 and len(ends) <= sum(p.length for p in packed) / 2048 + 2


def test_op4_records_equal_the_librarys_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path(records.FILE))
    ids_of = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, records.END_ID], "<u4")
    rnd, ties = random.Random(4), []
    while len(ties) < 5:  # texts that zstd neither shortens nor lengthens
        text = prose(rnd, rnd.randint(20, 90))
        raw = ids_of(text).astype("<u2").tobytes()
        ties += [text] if len(records.press().compress(raw)) == len(raw) else []
    for t in ties:
        assert records.unframe(records.frame(1, ids_of(t)))[1].tolist() == ids_of(t).tolist()
    texts = [*ties, "<|endoftext|>", "a <|endoftext|> b", "x\n<|endoftext|>\n\n's, <|endoftext|><|endoftext|> ", "<|endoftext| >", None, "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want, at = [], 0
    for k, t in enumerate(texts):
        ids = ids_of(t)
        want.append((k, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in records.op4_records(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("file", [records.FILE, packing.FILE])
def test_encoder_has_the_library_encode_words_alone(file):
    from tokenizers import Tokenizer

    path = tokens.default_path(file)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rnd, letters = random.Random(9), [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0x100)) if c not in (0xD7, 0xF7)]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 14))) for _ in range(3000)]
    odd = [w + rnd.choice(["'s", "$$$", "́", "Ġ", "×", "9", "-x", ".", "\n", "\n\n", "  ", "<|", "</w>", "ł", "中"]) for w in words[:600]]
    texts = [" ".join(words[k : k + 7]) for k in range(0, 3000, 7)] + [" ".join(rnd.choices(words + odd, k=9)) for _ in range(300)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encode = tokens.Encoder(path)
    assert [x.tolist() for x in encode(pa.array(texts))] == want == [x.tolist() for x in encode(pa.array(texts))]

    class Spy:
        def encode_batch_fast(self, texts, **_):
            made.extend(e for e in encoder.encode_batch_fast(texts, **_))
            return made[-len(texts) :]

        def __getattr__(self, name):
            return getattr(encoder, name)

    made, encode = [], tokens.Encoder(path)
    encoder, encode.marked = encode.marked, Spy()
    (ids,) = encode(pa.array(["x " + " ".join(dict.fromkeys(words))]))
    assert sum(len(e.ids) for e in made) == len(ids)  # no token but the words' own: nothing stands between them

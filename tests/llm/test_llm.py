"""The text operators against brute force, with nulls, empties, ties, repeated rows and clashing columns."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import chat, decontaminate, jaccard, language, licenses, packing, pii, quality, records, tokens, urls

WORDS = [f"w{k}" for k in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(3)
    long = [" ".join(r.choice(WORDS) for _ in range(r.randint(30, 120))) for _ in range(30)]
    near = [t.replace(t.split()[7], "changed", 1) for t in long[:10]]
    texts = [None, "", "   \n", "one", "one", "A a A a", *long, *near, *long[:4], "x " * 9000]
    rows = [(k, t, "en", k, "b", 1, 2) for k, t in enumerate(texts)] + [(6, long[0], "en", 6, "b", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, print string, node int, key int")


def collect(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def shingles(t):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_jaccard_components_equal_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    sets, root = {k: shingles(t) for k, t in rows.items()}, {k: k for k in rows}
    ids = sorted(rows)
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = collect(jaccard.cluster(docs), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == sorted([(k, len(sets[k]), root[k]) for k in ids] + [(6, len(sets[6]), root[6])])
    assert jaccard.cluster(docs.limit(0)).count() == 0


def one_set(tokens):
    return jaccard.Sets(tokens, np.array([0, len(tokens)]))


def test_jaccard_index_finds_every_similar_pair():
    r = np.random.default_rng(5)
    bands = jaccard.Bands()
    for turn in range(600):
        n = int(r.integers(4, 400 if turn % 3 else 30))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        if turn % 5 == 0:  # so uneven that few segments are filled: neighbourhoods
            a = np.unique(a >> np.uint64(6) | np.uint64(turn) << np.uint64(50))
        lost = int(r.integers(0, max(1, len(a) // 9) + 1))
        b = np.unique(np.concatenate((a[lost:], r.integers(0, 2**63, int(r.integers(0, lost + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        (ka, _, need), (kb, _, want) = bands.entries(one_set(a)), bands.entries(one_set(b))
        assert len(set(ka) & set(kb)) >= max(need[0], want[0])
        maps = [one_set(x).sketches()[0] for x in (a, b)]
        assert len(jaccard.near_pairs(np.array([len(a), len(b)]), maps, None, np.zeros(2), 80, 100)[0]) == 1


def test_jaccard_sets_equal_plain_shingles(docs):
    texts = [r.text or "" for r in docs.collect()]
    data, at = jaccard.common.utf8(pa.array(texts))
    whole = jaccard.Sets.of(data, at)
    assert whole.n.tolist() == [len(shingles(t)) for t in texts]
    alone = [jaccard.Sets.of(*jaccard.common.utf8(pa.array([t]))).tokens for t in texts]
    assert all(np.array_equal(whole[k], t) for k, t in enumerate(alone))
    keys, whose, _ = jaccard.Bands().entries(whole)
    for k, t in enumerate(alone):
        assert sorted(keys[whose == k].tolist()) == sorted(jaccard.Bands().entries(one_set(t))[0].tolist())


@pytest.mark.parametrize("block, hot, star", [(8, 4, 3), (2048, 256, 256)])
def test_jaccard_large_groups_in_pieces(spark, monkeypatch, block, hot, star):
    """A group of near copies, some beyond the threshold, over several blocks, with hot keys, equals brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_LEAST", hot)
    monkeypatch.setattr(jaccard, "STAR", star)
    r = random.Random(11)
    base, rows = [[r.choice(WORDS) + str(r.randrange(40)) for _ in range(90)] for _ in range(3)], []
    for k in range(150):
        t = list(base[k % 3])
        for _ in range(r.choice((0, 1, 1, 2, 3, 4))):
            t[r.randrange(len(t))] = f"x{k}"
        rows.append((k + 1, " ".join(t)))
    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, _ in rows:
        for b, _ in rows:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    got = collect(jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == [(k, len(sets[k]), top(k)) for k, _ in rows]
    assert len({top(k) for k, _ in rows}) > 3


def test_pii_base_equals_patterns():
    r = random.Random(5)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    for _ in range(5000):
        t = "".join(r.choice("0123+-. ()@aZ.19_%é") for _ in range(r.randint(0, 40)))
        want = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        want += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        want += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert [s for s in pii.find(t) if s[1] < 4] == sorted(want)


def test_pii_redacts_and_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de, iban DE44 5001 0517 5407 now", "x"), (2, None, "y")], "doc_id long, text string, spans string")
    got = pii.redact(docs).orderBy("doc_id").collect()
    assert got[0].text == "mail [EMAIL], iban [ACCOUNT] now" and got[1].text is None and got[1].spans == "y"


def test_myers_equals_edit_distance():
    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    r = random.Random(2)
    for turn in range(160):
        item = "".join(r.choice("abcde ") for _ in range(r.choice((8, 20, 39, 41, 60, 90)))).strip()
        item = decontaminate.normal(item)
        text = list(item)
        for _ in range(r.randint(0, 8) if turn % 2 else decontaminate.budget(len(item))):
            text[r.randrange(len(text))] = r.choice("abcde")
        text = decontaminate.normal("zz " + "".join(text) + " yy")
        got, want = decontaminate.Block([(1, item)]).matches(text), least(item, text)
        assert bool(got) == (want <= decontaminate.budget(len(item))) and (not got or got[0][1] == want)
        if got:
            assert whole(item, text[got[0][2] : got[0][3]]) == want  # the distance to just that part


def whole(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


@pytest.mark.parametrize("block", [10, 4_000_000])
def test_items_in_blocks_equal_plain_search(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    docs = spark.createDataFrame([(1, "The quick  brown fox"), (1, "a LAZY dog sleeps"), (None, "quick brown"), (4, None), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown"), (None, "lazy dog"), (8, "absent here"), (9, None), (9, ""), (7, "Quick Brown")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance, r.start, r.end) for r in decontaminate.find_items(docs, items).collect()), key=repr)
    assert got == sorted([(1, 7, 0, 4, 15), (1, None, 0, 2, 10), (None, 7, 0, 0, 11)], key=repr)
    assert sorted(r.text or "" for r in decontaminate.clean(docs, items).collect()) == ["", ""]
    assert decontaminate.find_items(docs, items.limit(0)).count() == decontaminate.find_items(docs.limit(0), items).count() == 0


def test_chat_parts_join_into_whole_dialogues(spark):
    r = random.Random(8)
    rows = [(1, r.choice((k, 10**12 + k, None)), r.choice(("ann", "bob", "system", None)), r.choice((None, "", "x" * r.randint(0, 9), "häß🙂"))) for k in range(230)]
    rows += [(2, 5, "ann", "again")] * 150 + [(3, 0, "system", "s"), (None, 0, "ann", "x")]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for conv, speakers in ((1, ("ann", "bob", "unknown")), (2, ("ann",))):
        own = sorted(((-1 if t is None else 1, t or 0, role or "unknown", x or "") for c, t, role, x in rows if c == conv))
        for who in speakers:
            text, mask = "", []
            for _, _, role, x in own:
                text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                at = len(text)
                text += x + "<|end|>\n"
                mask += [f"{at}:{len(text)}"] if role == who else []
            parts = sorted((p for p in got if p.conv_id == conv and p.speaker == who), key=lambda p: p.part)
            assert "".join(p.text for p in parts) == text and ",".join(p["mask"] for p in parts if p["mask"]) == ",".join(mask)
            assert [p.n_turns for p in parts] == [64] * (len(own) // 64) + [len(own) % 64] * (len(own) % 64 > 0)
            assert [p.start for p in parts] == [sum(len(q.text) for q in parts[:k]) for k in range(len(parts))]
    assert {p.conv_id for p in got} == {1, 2} and chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_quality_counts_and_verdicts(spark, docs):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
        runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        cover = {j for k, x in enumerate(runs) if runs.count(x) > 1 for j in range(k, k + 8)} if len(w) < 500 else set(range(len(w)))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert g.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (g.kept and g.base_failed)
    assert quality.judge(docs.limit(0)).count() == 0


def test_tokens_records_and_packing(spark, docs):
    from tokenizers import Tokenizer

    byte, word = (Tokenizer.from_file(tokens.default_path(f)) for f in (records.FILE, packing.FILE))
    byte.encode_special_tokens = word.encode_special_tokens = True
    odd = ["a  b", " a", "a ", "a\n b\n\n c \n", "<|endoftext|> x", "é É\tß", "a \xa0 b", "\n ", "", "Él.\nBé; x\u0301,\n\n7%", "a×. b÷, it's.\n'll", "\nx\n\u0301y <|", "中文. Σ.\r\n"]
    for t, file in ((byte, records.FILE), (word, packing.FILE)):
        assert [x.tolist() for x in tokens.Encoder(tokens.default_path(file))(pa.array(odd))] == [e.ids for e in t.encode_batch(odd, add_special_tokens=False)]
    import tempfile

    path = f"file://{tempfile.mkdtemp()}/r"
    records.write(docs, path)
    got = sorted(collect(records.digests(records.read(spark, path)), "doc_id", "start", "n_tokens", "ids_crc32"))
    assert got == sorted(collect(records.digests(records.read(spark, path, packed=True)), "doc_id", "start", "n_tokens", "ids_crc32"))
    at = 0
    for (k, start, n, crc), r in zip(got, sorted(docs.collect(), key=lambda r: r.doc_id), strict=True):
        ids = np.array([*byte.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (k, start, n, crc) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    packed = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    ends = {}
    for p in packed:
        assert p.offset == ends.get(p.sequence_id, 0)
        ends[p.sequence_id] = p.offset + p.length
    assert max(ends.values()) <= 2048 and len(ends) <= sum(p.length for p in packed) / 2048 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_records_define_null_ids_ties_and_empty_tables(spark, tmp_path):
    rows = [(None, "b c"), (5, "z y"), (5, "a"), (None, None), (-3, "b"), (5, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    records.write(docs, f"file://{tmp_path}/r", files=2)
    got = collect(records.digests(records.read(spark, f"file://{tmp_path}/r")).orderBy("start"), "doc_id", "start", "n_tokens")
    from tokenizers import Tokenizer

    size = lambda t: len(Tokenizer.from_file(tokens.default_path(records.FILE)).encode(t, add_special_tokens=False).ids) + 1
    want, at = [], 0
    for i, t in [(None, ""), (None, "b c"), (-3, "b"), (5, "a"), (5, "a"), (5, "z y")]:
        want.append((i, at, size(t)))
        at += size(t)
    assert got == want
    records.write(docs.limit(0), f"file://{tmp_path}/none")
    assert records.read(spark, f"file://{tmp_path}/none").count() == 0


def test_packing_pieces_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    word = Tokenizer.from_file(tokens.default_path(packing.FILE))
    word.encode_special_tokens = True
    want = []
    for r in docs.collect():
        ids = np.array([*word.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r.doc_id, k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(collect(packing.pack(docs), "doc_id", "piece", "start", "length", "ids_crc32")) == sorted(want)


def test_damaged_records_are_noticed():
    good = records.frame(7, np.arange(50, dtype=np.uint32))
    assert records.unframe(good)[0] == 7
    assert records.unframe(records.frame(None, np.arange(3)))[0] is None
    for bad in (good[:-1], good[:12] + b"\xff" + good[13:], struct.pack("<I", 9) + good[4:]):
        with pytest.raises(ValueError):
            records.unframe(bad)


def test_urls_licenses_and_chat(spark):
    pages = spark.createDataFrame([(1, "HTTPS://A.Example.COM/en/7?x"), (2, None), (3, "nothing"), (4, "x://spam-farm.example.net#a"), (5, "u://v.org/es/://w")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (got[2].host, got[3].path) == ("", "") and got[4].verdict == "block" and got[5].rule == "org/es/"
    docs = spark.createDataFrame([(1, "All rights reserved. ALL RIGHTS, reserved; Licensed under CC BY-NC 4.0."), (2, None)], "doc_id long, text string")
    one, none = licenses.scan(docs).orderBy("doc_id").collect()
    assert (one.n_words, one.base, one.labels, one.score) == (13, [0, 3, 8], ["cc-by", "cc-by-nc", "reserved"], 1.0) and (none.n_words, none.labels) == (0, [])
    turns = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, "bob", "yo"), (1, 2, None, None), (None, 0, "ann", "x"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    seen = {r.speaker: r for r in chat.rotate(turns).collect()}
    assert set(seen) == {"ann", "bob", "unknown"} and seen["ann"].text.startswith("<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo")
    a, b = map(int, seen["bob"].mask.split(":"))
    assert seen["bob"].text[a:b] == "yo<|end|>\n"


def test_url_model_on_urls_it_has_not_seen():
    good = """https://gov.uk/tax https://nature.com/articles/1 https://en.wikipedia.org/wiki/Cat https://www.esa.int/Science https://spark.apache.org/docs/latest
        https://www.oxfam.org/en/about https://lists.debian.org/archives http://old-mill.org/visit https://www.reuters.com/world/europe https://music-school.net/de/kurse""".split()
    bad = """http://cheap-viagra-pills.top/buy https://casino-bonus-slots.win/spin http://adult-xxx-cams.club/live https://free-prize-claim.click/win http://keygen-crack-warez.cc/setup.exe
        http://seo-link-spam.biz/backlinks https://fast-payday-cash.top/loan http://replica-watches-sale.shop/cheap""".split()
    w, bias = urls.train()

    def p(u):
        return urls.p_block(*urls.split(u), w, bias)

    assert [u for u in good if p(u) >= urls.BLOCK_AT] == [] and p("") < urls.BLOCK_AT
    assert len([u for u in bad if p(u) >= urls.BLOCK_AT]) >= 7


def test_url_model_blocks_whole_urls_of_bad_kinds(spark):
    """Names the table lacks, in all the hosts and paths of ordinary pages; both error rates of held-out names."""
    kinds = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x", "poker-jackpot", "discount-viagra")
    plain = ("ththan", "tionble", "m.therer", "blog.thernd", "garden-notes", "oak-school", "www.history-review")
    assert not set(kinds) & set(urls.BLOCKED) and not set(plain) & set(urls.ALLOWED)
    forms = ("http://{}.example.com/de/1523/", "https://www.{}.example.net/fr/33.html?page=2&ref=x", "http://m.{}.example.org/it/9#top", "http://{}.org", "https://{}.sites.net/" + "a/" * 3000)
    rows = [(k, f.format(name), 1, "host", "path") for k, (name, f) in enumerate((n, f) for n in kinds + plain for f in forms)]
    got = urls.judge(spark.createDataFrame(rows * 2, "page_id long, url string, verdict int, host string, path string"), rules=()).collect()
    assert len(got) == 2 * len(rows)
    verdicts = {r.page_id: r.verdict for r in got}
    bad = [verdicts[k] for k in range(len(kinds) * len(forms))]
    good = [verdicts[k] for k in range(len(bad), len(rows))]
    assert bad.count("block") >= 0.9 * len(bad) and good.count("block") == 0
    rates = urls.errors()
    assert rates["rows"] > 100 and rates["missed"] < 0.35 and rates["wrongly_blocked"] < 0.2


def test_url_parts_equal_the_columns(spark):
    r = random.Random(6)
    rows = [(k, "".join(r.choice(("://", "/", "?", "#", "A", "b", "é", ".", "\n")) for _ in range(r.randint(0, 12)))) for k in range(400)] + [(400, None)]
    got = {x.page_id: (x.host, x.path) for x in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got == {k: urls.split(u or "") for k, u in rows} and urls.judge(spark.createDataFrame(rows[:0], "page_id long, url string")).count() == 0


def test_language_holds_out(spark):
    r = random.Random(1)
    make = lambda s: " ".join("".join(r.choice(s) for _ in range(r.randint(2, 7))) for _ in range(30))
    rows = [(k, make("aeiou") if k % 2 else make("xyzkr"), "v" if k % 2 else "c") for k in range(160)] + [(900, None, "v"), (901, "12 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {x.doc_id: x for x in language.identify(docs, model).collect()}
    held = [k for k, _, lang in rows[:160] if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([got[k].lang_pred == rows[k][2] for k in held]) > 0.95
    assert got[900].lang_pred == got[901].lang_pred == "und" and docs.filter(F.col("doc_id") < 0).count() == 0

"""The language network and the weak supervision against plain forms."""

import math
import random
import re

import numpy as np
import pytest

from quarrymill.llm import language, quality


def small_network():
    return {k: v.astype(np.float64) for k, v in language.weights(3, seed=5).items()}


def plain_states(w, d, column):
    """One window, unit by unit: the gated update, with a rest at padding."""
    soft = lambda x: x / (1 + abs(x))
    n = language.HIDDEN
    h, out = [0.0] * n, []
    for byte in column:
        row = w[f"x{d}"][byte]
        gate = [0.5 + 0.5 * soft(row[k] + sum(h[j] * w[f"u{d}"][j][k] for j in range(n))) for k in range(2 * n)]
        z, r = gate[:n], gate[n:]
        new = [soft(row[2 * n + k] + sum(r[j] * h[j] * w[f"c{d}"][j][k] for j in range(n))) for k in range(n)]
        h = [h[k] + z[k] * (new[k] - h[k]) if byte != language.PAD else h[k] for k in range(n)]
        out.append(h)
    return np.array(out)


def test_states_equal_a_plain_loop_in_both_forms():
    w = small_network()
    x = np.random.default_rng(1).integers(0, 256, (9, 4)).astype(np.int16)
    x[6:, 1] = language.PAD
    x[:, 3] = language.PAD
    trained, _ = language.run(w, "f", x)
    fast = language.states({k: v.astype(np.float32) for k, v in w.items()}, "f", x, ~(x == language.PAD).any(1))
    for column in range(4):
        want = plain_states(w, "f", x[:, column])
        assert np.allclose(trained[:, column], want, atol=1e-5) and np.allclose(fast[:, :, column], want, atol=1e-5)


def test_gradients_equal_differences():
    w = small_network()
    x = np.random.default_rng(2).integers(0, 6, (7, 3)).astype(np.int16)
    x[5:, 2] = language.PAD
    g = np.random.default_rng(3).normal(size=(7, 3, language.HIDDEN))
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    language.back(w, "f", x, language.run(w, "f", x)[1], g, grads)

    def loss():
        return float((g * language.run(w, "f", x)[0].astype(np.float64)).sum())

    rnd = random.Random(4)
    for name in ("xf", "uf", "cf"):
        worth = [tuple(k) for k in np.argwhere(np.abs(grads[name]) > 1e-3)]
        for k in rnd.sample(worth, 12):
            old, eps = w[name][k], 1e-2
            w[name][k] = old + eps
            up = loss()
            w[name][k] = old - eps
            down = loss()
            w[name][k] = old
            assert abs((up - down) / (2 * eps) - grads[name][k]) < 0.02 * max(1, abs(grads[name][k])), (name, k)


def test_pooled_equals_a_plain_loop():
    w = {k: v.astype(np.float32) for k, v in small_network().items()}
    texts = [b"", b"abc", bytes(range(100, 230)), b"z" * 64, b"y" * 65]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = language.Model(["a", "b", "c"], w).pooled(np.frombuffer(b"".join(texts), np.uint8), at)
    for k, t in enumerate(texts):
        total = np.zeros(3)
        for a in range(0, len(t), language.WINDOW):
            part = list(t[a : a + language.WINDOW])
            both = np.concatenate((plain_states(w, "f", part), plain_states(w, "b", part[::-1])[::-1]), 1)
            s = np.exp(both @ w["o"] + w["ob"])
            total += (s / s.sum(1, keepdims=True)).sum(0)
        assert np.allclose(got[k], total / max(len(t), 1), atol=1e-4)


def test_language_edges(spark):
    rows = [(k, t, lang, 1) for k, (t, lang) in enumerate([("alpha beta gamma " * 20, "aa"), ("один два три " * 20, "bb")] * 30)] + [(900, None, None, 1), (901, "12 34", None, 1), (902, "alpha beta gamma " * 20, None, 1), (902, "alpha beta gamma " * 20, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    model = language.fit(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, model).collect()]
    assert len(got) == len(rows) and [x[1:] for x in got if x[0] in (900, 901)] == [("und", 0.0)] * 2
    same = [x[1:] for x in got if x[0] == 902]
    assert same[0] == same[1] and same[0][0] == "aa"
    none = language.fit(docs.filter("lang is null"))
    assert none.names == [] and {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).collect() == []


def test_base_counts_equal_plain_python(spark):
    rnd = random.Random(9)
    words = ["a", "bb#", "c$|", "d\té", "longer", "x<y>", "\n", "\n\n", "same line\n", "  ", "&&", "ß" * 40]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " "]) for _ in range(rnd.randint(0, 80))) for _ in range(120)] + ["", None, "\n\n", "one two three four five six seven eight " * 4]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        said = re.findall("[^\x20\x09-\x0d]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search("[^\x20\x09-\x0d]", line):
                dup += line in seen
                seen.add(line)
        runs: dict[tuple, list[int]] = {}
        for a in range(len(said) - 7):
            runs.setdefault(tuple(said[a : a + 8]), []).append(a)
        repeat = {a + j for where in runs.values() if len(where) > 1 for a in where for j in range(8)}
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(said), sum(map(len, said)), len(re.findall("[#*$%&|<>]", t)), dup, len(repeat)), t
        assert r.base_failed == (len(said) < 20 or 100 * len(repeat) > 30 * len(said)) and (not r.base_failed or not r.kept)


def plain_em(patterns, weight):
    rules, total = len(patterns[0]), sum(weight)
    first = {}
    for r in range(rules):
        abstain = min(max(sum(w for p, w in zip(patterns, weight, strict=True) if p[r] == 0) / total, 0.0), 0.98)
        right = quality.FIRST_ACCURACY * (1 - abstain)
        for cls in (0, 1):
            for v in (-1, 0, 1):
                first[r, cls, v] = max(1e-4, abstain if v == 0 else right if (v == 1) == (cls == 1) else 1 - abstain - right)
    p, good, held = dict(first), quality.PRIOR, 0.02 * total + 1

    def posterior(votes):
        logs = [math.log(1 - good), math.log(good)]
        for cls in (0, 1):
            logs[cls] += sum(math.log(p[r, cls, v]) for r, v in enumerate(votes))
        return 1 / (1 + math.exp(logs[0] - logs[1]))

    for _ in range(quality.STEPS):
        q = [posterior(v) for v in patterns]
        new = {}
        for r in range(rules):
            for cls in (0, 1):
                got = {v: sum(w * (x if cls else 1 - x) for votes, w, x in zip(patterns, weight, q, strict=True) if votes[r] == v) + held * first[r, cls, v] for v in (-1, 0, 1)}
                share = {v: n / sum(got.values()) for v, n in got.items()}
                if cls:
                    share[-1] = min(share[-1], quality.FALSE_ALARM)
                    share = {v: n / sum(share.values()) for v, n in share.items()}
                new |= {(r, cls, v): n for v, n in share.items()}
        good = min(max((sum(w * x for w, x in zip(weight, q, strict=True)) + held * quality.PRIOR) / (total + held), 0.01), 0.99)
        p = new
    return [posterior(v) for v in patterns], good


@pytest.mark.parametrize("seed", [1, 2])
def test_expectation_maximisation_equals_a_plain_form(seed):
    rnd = random.Random(seed)
    rows = {tuple(rnd.choice([-1, 0, 1, 1, 1]) for _ in range(5)) for _ in range(40)}
    patterns, weight = sorted(rows), [rnd.randint(1, 300) for _ in rows]
    p, good = quality.fit(np.array(patterns), np.array(weight, float))
    want, share = plain_em(patterns, weight)
    assert abs(good - share) < 1e-6 and np.allclose(quality.posterior(np.array(patterns), p, good), want, atol=1e-6)

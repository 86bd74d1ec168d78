"""The language model holds exact n-grams, and drops only rare ones into the back-off mass."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyframe.llm import language_id


def total(model, context, lang):
    """Sum of the probabilities of all 65536 next characters of a context of three characters."""
    base = np.uint64(0)
    for c in context:
        base = (base << np.uint64(16)) | np.uint64(ord(c))
    packed = (base << np.uint64(16)) | np.arange(65536, dtype=np.uint64)
    p = np.full((len(packed), len(model.langs)), 1 / 65536)
    for k in range(1, language_id.ORDER + 1):
        own = packed & np.uint64((1 << 16 * k) - 1 if k < 4 else (1 << 64) - 1)
        p = model.look_up(k, "gram", language_id.fold(own)) + model.look_up(k, "context", language_id.fold(own >> np.uint64(16))) * p
    return p[:, model.langs.index(lang)].sum()


def test_many_distinct_n_grams(spark, monkeypatch):
    """A language of many characters gains nothing for foreign n-grams; with the rarest dropped, the mass stays one."""
    rng = random.Random(6)
    rows = [("".join(chr(rng.randint(0x4E00, 0x9FA0)) for _ in range(4000)), "zh") for _ in range(150)] + [("aba abc abd abc abc", "x")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.train(docs)
    foreign = np.unique(np.array([language_id.grams(["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4))])[0][3] for _ in range(3000)], np.uint64))
    hits = model.look_up(4, "gram", language_id.fold(foreign))[:, model.langs.index("zh")] > 0
    assert not hits.any()
    assert total(model, "abc", "x") == pytest.approx(1, abs=1e-3) and total(model, "abc", "zh") == pytest.approx(1, abs=1e-3)
    monkeypatch.setattr(language_id, "MOST", 40)
    small = language_id.train(docs)
    assert total(small, "\x01ab", "x") == pytest.approx(1, abs=1e-3) and total(small, "abc", "zh") == pytest.approx(1, abs=1e-3)
    assert all(len(small.arrays[k, "gram", i][0]) <= 5 for k in range(1, 5) for i in range(2))


def plain_entropies(rows, text):
    """Cross-entropy of a text in each language by interpolated Kneser-Ney over dictionaries."""
    chars = lambda w: [w.encode("utf-16-le")[i : i + 2] for i in range(0, 2 * language_id.units(w), 2)]
    padded = lambda w: [b"<"] * 3 + chars(w) + [b">"]
    out = {}
    for lang in {r[1] for r in rows}:
        levels = {4: Counter(tuple(p[i - 3 : i + 1]) for t, x in rows if x == lang for w in language_id.words_in(t) for p in [padded(w)] for i in range(3, len(p)))}
        for k in (3, 2, 1):
            levels[k] = Counter(g[1:] for g in levels[k + 1])
        discounts, totals, kinds = {}, {k: Counter() for k in levels}, {k: Counter() for k in levels}
        for k, counts in levels.items():
            of = Counter(counts.values())
            discounts[k] = min(max(of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else 0.5, 0.1), 0.9)
            for g, n in counts.items():
                totals[k][g[:-1]] += n
                kinds[k][g[:-1]] += 1
        logs = []
        for w in language_id.words_in(text):
            p = padded(w)
            for i in range(3, len(p)):
                value = 1 / 65536
                for k in range(1, 5):
                    g = tuple(p[i - k + 1 : i + 1])
                    if total := totals[k][g[:-1]]:
                        value = max(levels[k][g] - discounts[k], 0) / total + discounts[k] * kinds[k][g[:-1]] / total * value
                logs.append(-math.log(value))
        out[lang] = sum(logs) / len(logs)
    return out


ASTRAL = ["\U00010001", "\U00020001", "\U00020002", "\U0001E900"]


def test_plain_kneser_ney_agrees(spark):
    rng = random.Random(8)
    letters = {"x": "abcde", "y": "cdefé", "z": "abक" + "".join(ASTRAL)}
    rows = [(" ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 7))) for _ in range(30)), lang) for lang in letters for _ in range(6)]
    scorer = language_id.Scorer(language_id.train(spark.createDataFrame(rows, "text string, lang string")))
    for text in [r[0] for r in rows[::4]] + ["abc zzz", "".join(ASTRAL) + " ab", "नमस्ते de", "é"]:
        want = plain_entropies(rows, text)
        lang, _, entropy = scorer.score([text])[0]
        assert entropy == pytest.approx(min(want.values()), rel=1e-4) and want[lang] == pytest.approx(min(want.values()), rel=1e-4)


def test_letters_beyond_the_first_plane(spark):
    """They train, score like any unknown letter, and alias neither signs nor other letters."""
    rows = [(f"ab{c}c word", "x") for c in ASTRAL] + [("le mot est", "y")] * 4
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    scorer = language_id.Scorer(model)
    base = scorer.score(["word ab"])[0][2]
    assert all(scorer.score([f"word ab {c}"])[0][2] > base for c in ("\U00030001", "\U00020003", "中"))
    packed, of_word = language_id.grams(["a", ASTRAL[1], "b"])
    assert len(packed) == len(of_word) == 2 + 3 + 2 and len(set(packed.tolist())) == 7


def test_marks_stay_in_words():
    assert language_id.words_in("नमस्ते दुनिया 12") == ["नमस्ते", "दुनिया"]
    assert language_id.words_in("e\u0301a ก็ \u0301") == ["e\u0301a", "ก็"]
    assert language_id.words_in("\u0301 12 _") == []


def test_model_beyond_what_workers_hold(spark, monkeypatch):
    """A larger model is joined, whole: the same languages and entropies, with no n-gram dropped."""
    rng = random.Random(9)
    letters = {"x": "abcde", "y": "cdefé", "z": "abk" + "".join(ASTRAL)}
    rows = [(i, " ".join("".join(rng.choices(letters[lang], k=rng.randrange(1, 7))) for _ in range(rng.randrange(1, 30))), lang) for i, lang in enumerate([*letters] * 20)]
    rows += [(None, "abc abc", "x"), (60, None, "y"), (61, "12 .", "x"), (62, "aaaaaa 中 ab", None), (62, "aaaaaa 中 ab", None), (63, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    order = lambda df: sorted(df.collect(), key=str)
    whole = order(language_id.identify(docs))
    used = []
    real = language_id.scored_by_join
    monkeypatch.setattr(language_id, "scored_by_join", lambda *a: used.append(1) or real(*a))
    monkeypatch.setattr(language_id, "MOST", 40)
    joined = order(language_id.identify(docs))
    assert used and len(joined) == len(whole) == len(rows)
    for a, b in zip(whole, joined):
        assert (a["doc_id"], a["held_out"], a["lang_pred"]) == (b["doc_id"], b["held_out"], b["lang_pred"])
        assert b["score"] == pytest.approx(a["score"], abs=1e-4)
        assert (a["cross_entropy"] is None) == (b["cross_entropy"] is None)
        assert a["cross_entropy"] is None or b["cross_entropy"] == pytest.approx(a["cross_entropy"], rel=1e-5)


def test_only_train_bounds_a_model(spark, monkeypatch):
    """``identify`` gives what it gave when the limit is too small for its n-grams; no row is learned otherwise."""
    monkeypatch.setattr(language_id, "MOST", 0)
    rows = language_id.identify(spark.createDataFrame([(1, "ab", None), (2, None, None)], "doc_id long, text string, lang string")).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in rows} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert not language_id.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count()

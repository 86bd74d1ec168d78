"""Passages against what was planted: several in one pair of texts, scattered seeds, repeats in one text, recall."""

import random

import numpy as np

from tallyframe.llm import passages


def zipf(seed, size=5000):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(size)]
    weights = [1 / (i + 10) for i in range(size)]
    return rng, lambda n: rng.choices(vocabulary, weights, k=n)


def found_spans(spark, texts):
    """{id: set of word positions in passage or source rows}"""
    rows = passages.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    out = {i: set() for i in range(len(texts))}
    for r in rows:
        out[r["doc_id"]].update(range(r["start"], r["end"]))
    return out


def test_two_passages_of_one_pair(spark):
    """Header and footer: two shared passages with unrelated words of 0.5 to 2 times their length between them."""
    _, some = zipf(1)
    texts, planted = [], []
    for n in (60, 100, 200):
        for gap in (n // 2, n, 2 * n):
            for _ in range(4):
                one, two = some(n), some(n)
                for _ in range(2):
                    texts.append(some(20) + one + some(gap) + two + some(20))
                    planted.append([range(20, 20 + n), range(20 + n + gap, 20 + 2 * n + gap)])
    got = found_spans(spark, texts)
    for i, spans in enumerate(planted):
        assert all(len(got[i].intersection(span)) >= 0.9 * len(span) for span in spans), (i, [len(got[i].intersection(s)) for s in spans])


def test_passage_repeated_within_a_text(spark):
    """Every place of a passage is reported: again in its own text, alone or beside another holder."""
    _, some = zipf(2)
    alone, both = some(80), some(80)
    texts = [some(50) + alone + some(150) + alone + some(150) + alone, some(40) + both + some(160) + both + some(30), some(70) + both, some(300)]
    got = found_spans(spark, texts)
    planted = [(0, 50), (0, 280), (0, 510), (1, 40), (1, 280), (2, 70)]
    assert [len(got[i].intersection(range(at, at + 80))) >= 72 for i, at in planted] == [True] * 6
    assert not got[3]


def test_seeds_with_other_first_holders(spark):
    """Stock sentences stand singly in many other texts; the two texts that share them in a row still meet."""
    rng, some = zipf(3)
    texts, planted = [], []
    for n, sentence in ((60, 20), (90, 20), (60, 30), (90, 30)):
        for _ in range(6):
            parts = [some(sentence) for _ in range(n // sentence)]
            for part in parts:
                for _ in range(4):  # one of them has a smaller hash than both, nearly always
                    texts.append(some(30) + part + some(30))
            passage = [w for part in parts for w in part]
            for _ in range(2):
                planted.append((len(texts), len(passage)))
                texts.append(some(25) + passage + some(25))
    got = found_spans(spark, texts)
    missed = [i for i, n in planted if len(got[i].intersection(range(25, 25 + n))) < 0.9 * n]
    assert not missed
    assert all(not got[i] for i in set(range(len(texts))) - {i for i, _ in planted})


def test_recall_of_edited_passages(spark):
    """60 to 100 words of which 5 to 18% are replaced; with a replaced word at neither end, all are passages by definition."""
    rng, some = zipf(4)
    texts, planted = [], []
    for case in range(120):
        n, share = (60, 70, 85, 100)[case % 4], (0.05, 0.1, 0.15, 0.18)[case // 4 % 4]
        passage = some(n)
        edited = list(passage)
        for at in rng.sample(range(1, n - 1), int(share * n)):
            edited[at] = f"edit{rng.randrange(10**6)}"
        for words in (passage, edited):
            planted.append((len(texts), n))
            texts.append(some(80) + words + some(80))
    got = found_spans(spark, texts)
    assert sum(len(got[i].intersection(range(80, 80 + n))) >= 0.8 * n for i, n in planted) >= 0.95 * len(planted)


def test_pairs_of_seeds_as_long_as_a_run(spark):
    """A pair of seeds that spans ``RUN`` words in one text and fewer in the other, at its end, is no run."""
    _, some = zipf(5, 200_000)
    texts, whole = [], some(60)
    for gap in [17, 18, 19, 20, 21, 22, 23] * 8:
        for less in (11, 16):
            one, two = some(10), some(10)
            texts += [some(40) + one + some(gap) + two + some(40), some(40) + one + some(gap - less) + two]
    texts += [whole + some(30), some(30) + whole]
    got = found_spans(spark, texts)
    assert not any(got[i] for i in range(len(texts) - 2))
    assert got[len(texts) - 2] >= set(range(60)) and got[len(texts) - 1] >= set(range(30, 90))


def test_points_lie_in_both_texts():
    at, other_at = np.array([(40 << passages.SPAN) | passages.RUN]), np.array([(25 << passages.SPAN) | 29])
    assert passages.points(at, other_at) == [(40, 25), (70, 49)]
    keys, places = passages.longer_keys(np.arange(0, 56, 5), np.arange(12).astype(np.uint64), np.arange(60, dtype=np.uint16))
    runs = places[(places & passages.LOW) == passages.IS_RUN]
    assert len(runs) and len(keys) == 11 + len(runs)
    assert {q - p for p, q in passages.points(runs, runs + (7 << passages.SPAN))} == {7}


def test_short_chains_settled_at_once():
    """All at once as one by one: random texts that agree in most words around a few equal ones, some cut off."""
    rng = np.random.default_rng(6)
    cases, want = [], []
    for _ in range(1500):
        before, size, after = rng.integers(0, 80), rng.integers(5, 40), rng.integers(0, 80)
        a = rng.integers(0, 5000, before + size + after).astype("<u2")
        b = np.where(rng.random(len(a)) < rng.choice([0.02, 0.1, 0.2, 0.5]), rng.integers(0, 5000, len(a)), a).astype("<u2")
        if rng.random() < 0.8:
            b[before : before + size] = a[before : before + size]
        skip, other_skip = (rng.integers(0, before + 1) if rng.random() < 0.3 else 0 for _ in range(2))
        p, q, a, b = before - skip, before - other_skip, a[skip:], b[other_skip:]
        cases.append((p, q, size, a.tobytes(), b.tobytes()))
        at, to = np.array([p, p + size - passages.KMER]), np.array([q, q + size - passages.KMER])
        want.append((passages.aligned(at, to, a, b), passages.widened(p, q, p + size, q + size, int(size), a, b)))
    number, rows = passages.settled(*(np.array(c) for c in list(zip(*cases))[:3]), *(list(c) for c in list(zip(*cases))[3:]))
    assert {-2, -1, 0, 1} <= set(number.tolist())
    for n, row, (one_by_one, wide) in zip(number.tolist(), rows.tolist(), want):
        assert n == -2 or one_by_one == (wide if n == -1 else [tuple(row)][:n])


def test_rolled_hashes_word_by_word():
    hashes = np.random.default_rng(7).integers(0, 1 << 63, 80).astype(np.uint64)
    for k in (1, passages.KMER, passages.RUN, 80):
        want = hashes[: 81 - k].copy()
        for i in range(1, k):
            want = want * passages.ODD + hashes[i : i + 81 - k]
        want *= passages.MIX
        assert (passages.rolled(hashes, k) == want ^ (want >> np.uint64(31))).all()

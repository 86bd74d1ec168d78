"""Runs of words against a search of every period."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from pyspark.sql import functions as F

from tallyframe.llm import periodic_runs, queries


def brute(words):
    """(start, period, length) of every run: all maximal stretches of each period, the smallest period of each."""
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - i + q >= max(6, 4 * q):
                found.setdefault((i, end - i + q), q)
            i = max(end, i + 1)
    return sorted((a, q, length) for (a, length), q in found.items())


def without(words, runs):
    gone = {i for a, q, length in runs for i in range(a + q, a + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(9)
    out = ["", "a", "a " * 5, "a " * 6, "a b " * 3, "a b " * 4, "a b c " * 4, "a b c " * 3 + "a b", "x " + "a a b " * 40 + "a a", ("a " * 6 + "b ") * 5]
    for _ in range(150):  # few words, so that runs of many periods meet, nest and touch
        out.append(" ".join(rng.choices("ab", weights=[3, 1], k=rng.randrange(80))))
    for _ in range(60):
        words = [str(rng.randrange(400)) for _ in range(rng.randrange(1, 900))]
        for _ in range(rng.randrange(3)):
            at, p = rng.randrange(len(words)), rng.randrange(1, 260)
            words[at:at] = (words[at : at + p] or ["z"]) * rng.randrange(2, 9)
        out.append("\n".join(words))
    base = [str(i) for i in range(1500)]
    return [*out, " ".join(base * 4), " ".join(base * 4 + base[:7]), " ".join(base * 3 + base[:-1]), " ".join(["q", *base * 5, "r"])]


def test_like_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in periodic_runs.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    some = 0
    for i, text in rows:
        words = text.split()
        want = brute(words)
        assert [tuple(r) for r in got[i]["runs"]] == want, i
        assert got[i]["collapsed"] == without(words, want) and got[i]["n_words"] == len(words)
        some += bool(want)
    assert some > 60


def test_z_function():
    rng = random.Random(2)
    for _ in range(300):
        t = rng.choices([0, 1], k=rng.randrange(1, 30))
        want = [next((k for k in range(len(t) - i) if t[k] != t[i + k]), len(t) - i) for i in range(len(t))]
        assert periodic_runs.z_function(t, len(t)) == want


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a " * 7), (3, "a " * 7), (None, "b " * 9), (4, "a " * 7), (5, "word " * 40_000), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "doc", "tiles", "runs", "n_words", "start", "found")})
    got = {}
    for r in periodic_runs.periodic_runs(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"][:9]))
    assert got == {
        1: [(0, [], "")], 2: [(0, [], "")], 3: [(7, [(0, 1, 7)], "a")] * 2, None: [(9, [(0, 1, 9)], "b")], 4: [(7, [(0, 1, 7)], "a")],
        5: [(40_000, [(0, 1, 40_000)], "word")], 6: [(1, [], "x" * 9)],
    }
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark):
    small = "/root/testdata/sf0.001"
    want = {}
    for doc_id, text in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]), default=None)
        top = (best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{a},{length},{q}\n" for a, q, length in runs), without(words, runs))]
        want[doc_id] = (doc_id, len(runs), *top, *digests)
    assert {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()} == want

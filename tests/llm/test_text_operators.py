"""Operators against brute force, the library, or held-out accuracy."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import bpe_codec, decontaminate, language_id, passages, private_data, quality_model, quality_rules, simhash, token_counts, word_bpe

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.text(alphabet="abethings'lσΣİéß1 2.,!\n\t\x1c<|endoftext|>中👍́", max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    return [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_bpe_is_the_library(text):
    source = word_bpe.load(PATH)
    library = Tokenizer.from_file(PATH) if not hasattr(test_bpe_is_the_library, "t") else test_bpe_is_the_library.t
    test_bpe_is_the_library.t = library
    want = library.encode(text, add_special_tokens=False).ids
    codec = bpe_codec.codec(source)
    got = bpe_codec.unpacked(codec.encode(text))
    assert got == want
    assert bpe_codec.decode(got, bpe_codec.Names(codec.rules.names)) == library.decode(want, skip_special_tokens=False)
    assert token_counts.counter(source, frozenset(token_counts.proven_single(source)))(text) == len(want)


def test_bpe_on_documents_and_long_words(texts, library):
    source = word_bpe.load(PATH)
    count, codec = token_counts.counter(source, frozenset(token_counts.proven_single(source))), bpe_codec.codec(source)
    for text in [*texts[:80], "theing" * 3000, "é" * 700, "中文" * 400]:
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe_codec.unpacked(codec.encode(text)) == want and count(text) == len(want)


def test_forced_boundaries_are_certain():
    """No merge result and no vocabulary token spans a cut."""
    rules = word_bpe.rules(word_bpe.load(PATH))
    inside = bpe_codec.inner_pairs(rules)
    names = [n.removesuffix(word_bpe.WORD_END) for n in rules.ids]
    assert all(bpe_codec.fragments(n, inside) == [n] for n in names if n)
    word = "".join(rules.alphabet[b] for b in "naïveçé中".encode())
    assert len(bpe_codec.fragments(word, inside)) > 1 and "".join(bpe_codec.fragments(word, inside)) == word


def brute_base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 12 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["a", ".", "@", "-", "b@c.d", "+1 (2", "3", ")", " ", "4111 1111 1111 1111", "1.2.3.4", "256", "_%", "é", "00000", "9"]), max_size=24).map("".join))
def test_base_spans(text):
    assert [(s["start"], s["kind"], s["end"]) for s in private_data.spans_of(text) if s["base"]] == brute_base(text)


def test_weak_supervision_separates(spark):
    """Labelled-by-construction candidates: random tokens behind a secret word are accepted, failing card numbers are not."""
    rng = random.Random(5)
    rows = []
    for i in range(600):
        hexes = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        digits = "".join(rng.choice("0123456789") for _ in range(16))
        rows.append((i, f'the token = "{hexes}" then {digits} by mail a{i}@b.org and 10.0.{i % 250}.1'))
    found = private_data.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kinds = [[private_data.KINDS[s["kind"]] for s in r["found"]] for r in found]
    assert sum("secret" in k for k in kinds) > 590
    assert all("email" in k and "ip" in k for k in kinds)
    extra = [s for r in found for s in r["found"] if not s["base"] and s["kind"] in (2, 5)]
    assert len(extra) < 30
    masked = private_data.redact(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 3").first()["text"]
    assert masked.startswith('the token = "<secret>" then ') and "<email> and <ip>" in masked


def brute_components(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = sorted(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in values}


@pytest.mark.parametrize("dense", [5, 64])
def test_pigeonring_finds_all_links(spark, monkeypatch, dense):
    """Random fingerprints, chains of near ones and one crowded ball, with and without dense keys."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    prints = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << bit
    center = rng.getrandbits(64)
    for _ in range(150):
        x = center
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            x ^= 1 << bit
        prints.add(x)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    rows = spark.createDataFrame([(signed(p), i) for i, p in enumerate(sorted(prints))], "fp long, first_id long")
    got = {r["fp"] & (1 << 64) - 1: r["root"] for r in simhash.component_of(rows).collect()}
    want = brute_components(prints)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_fingerprints(texts):
    import xxhash

    for text in [*texts[:40], "One two", "a\x0bb\x0cc d É e"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) & (1 << 64) - 1 == want


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            hit.update(p + k for p in places for k in range(8))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a ", "b ", "c\n", "a b c d e f g h i ", "é\x0b", "#\n", "\n", "\xa0"]), max_size=60).map("".join))
def test_base_statistics(text):
    assert quality_rules.statistics(text)[:5] == brute_repeats(text)


def test_decision_list_on_held_out_rows(spark):
    """A rule hidden in two statistics is found again, and held-out rows obey it."""
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        bad = rng.random() < 0.2
        words = [rng.choice("abcdefghij") * rng.randint(2, 6) + ("***" if bad and rng.random() < 0.6 else "") for _ in range(rng.randint(25, 60))]
        rows.append((i, " ".join(words) + ".", int(not bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    out = quality_rules.judge(docs, labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in out]) > 0.97
    assert any("symbol_share" in (r["dropped_by"] or "") for r in out)


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) > 0.93
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) > 0.98
    assert np.mean([r["accepted"] for r in out]) > 0.95


def test_language_model_is_a_distribution(spark):
    """The probabilities of all 65536 next characters of a context sum to one; all unknown ones are equal."""
    docs = spark.createDataFrame([("aba abc abd", "x"), ("zz zy", "y")], "text string, lang string")
    model = language_id.train(docs)
    packed = [language_id.grams([f"ab{c}"])[0][2] for c in "abcdq"] + [language_id.grams(["ab"])[0][2]]
    p = np.full((len(packed), 2), 1 / 65536)
    for k in range(1, language_id.ORDER + 1):
        own = np.array(packed, np.uint64) & np.uint64((1 << 16 * k) - 1 if k < 4 else (1 << 64) - 1)
        p = model.look_up(k, "gram", language_id.fold(own)) + model.look_up(k, "context", language_id.fold(own >> np.uint64(16))) * p
    of_x = p[:, model.langs.index("x")]
    assert of_x[4] < min(np.delete(of_x, 4)) and of_x.sum() + of_x[4] * (65536 - len(packed)) == pytest.approx(1, abs=1e-3)


def brute_hits(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = lambda s: re.findall(pattern, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    words, hit, names = low(text), set(), set()
    for name, item in items:
        w = low(item)
        m = min(window, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in windows:
                hit.update(range(i, i + m))
                names.add(name)
    return len(words), len(hit), sorted(names)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from("abcdé"), max_size=60).map(" ".join), st.lists(st.lists(st.sampled_from("abcdé"), max_size=14).map("-".join), max_size=4))
def test_wu_manber(text, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    found_by = decontaminate.machines([(n, decontaminate.words_of(t)) for n, t in named], 10)
    n, hits, names = decontaminate.search_text(text, [], [], found_by)
    assert (n, sum(hits[1::2]) - sum(hits[::2]), names) == brute_hits(text, named)


def test_benchmark_in_several_passes(spark, monkeypatch):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 2500)
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == want and any(r["contaminated"] for r in want.values())


def test_chains_take_the_best_order():
    """Collinear matches under a gap cost, against trying every predecessor."""
    rng = random.Random(2)
    for _ in range(200):
        matches = sorted({(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(rng.randint(1, 25))})
        best = {}
        for a, b in matches:
            before = [best[p] - passages.GAP * (a + b - sum(p)) for p in best if p[0] < a and p[1] < b]
            best[a, b] = passages.KMER + max(0.0, *before) if before else passages.KMER
        chains = passages.chains(matches)
        if chains:
            c = chains[0]
            score = passages.KMER * len(c) - passages.GAP * (sum(c[-1]) - sum(c[0]))
            top = max(best.values())
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(c, c[1:])) and score == pytest.approx(top, abs=1e-6)


def test_planted_passages_are_found(spark):
    """Exact and edited passages of over 50 words inside other text; clean texts have no row."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, planted = [], set()
    for group in range(12):
        passage = some(rng.randint(51, 140))
        for copy in range(3):
            words = list(passage)
            if copy == 2:
                for _ in range(2):
                    words[rng.randrange(len(words))] = "edited"
            i = len(rows)
            planted.add(i)
            rows.append((i, " ".join(some(rng.randint(0, 200)) + words + some(rng.randint(0, 200)))))
    for _ in range(60):
        rows.append((len(rows), " ".join(some(200))))
    out = passages.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r["doc_id"] for r in out}
    assert found <= planted and len(found) >= len(planted) - 1
    assert all(r["end"] - r["start"] >= 45 for r in out)

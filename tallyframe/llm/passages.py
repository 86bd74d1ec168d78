"""Fuzzy passages that documents share, by collinear chaining.

Texts with the same words are one text from here on. Of each text's k-mers of words the
minimum of every window is a seed. A seed that several texts hold is matched with its first
holder only, so matches grow with the seeds, not with pairs; where the holder itself repeats it, with
its first place there. Pairs of neighbouring shared seeds, and runs of ``RUN`` words that lie in
shared seeds, are matched with their own first holders, so that a passage whose
seeds have different first holders still meets a text that holds most of it. Per text and holder the matches
are chained in order under a gap cost, with a Fenwick tree for the best predecessor, and each
chain is aligned word by word, between its seeds and beyond its ends. A chain that does not
agree enough as a whole is split, and its parts are judged by themselves.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Scratch, small_batches
from tallyframe.llm.decontaminate import united, words_of

#: Words in a k-mer, k-mers in a window: equal runs of KMER + WINDOW - 1 words always share a seed.
KMER, WINDOW = 5, 6
#: Least words of a passage, least share of words that agree.
MIN_WORDS, IDENTITY = 50, 0.8
#: Words in a run, and runs in a window: of these the minimal one is a key, so that any ``MIN_WORDS`` equal words share one.
RUN = 35
RUNS = MIN_WORDS - RUN + 1
#: Cost of a word of gap (a seed is worth KMER), seeds a chain needs.
GAP, SEEDS = 0.1, 2
#: Words beyond a chain's ends that alignment may take in, cost of a differing word, loss at which it stops.
REACH, MISMATCH, DROP = 64, 2, 8
#: Bits of a packed place that hold its length in words, below its position.
SPAN = 20
LOW = (1 << SPAN) - 1
#: Length by which a packed place says that it is a run, as a pair of seeds may have ``RUN`` words too.
IS_RUN = LOW
#: Texts that a task remembers to have emitted.
EMITTED = 1_000_000

ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def minimal(keys: np.ndarray, window: int) -> np.ndarray:
    """Places of the minima of all windows; of fewer keys than a window the least."""
    views = np.lib.stride_tricks.sliding_window_view(keys, min(window, len(keys)))
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def mixed(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of 16-bit word hashes."""
    h = (words.astype(np.uint64) + np.uint64(1)) * MIX
    return h ^ (h >> np.uint64(29))


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` words that follow each other."""
    m = len(hashes) - k + 1
    out, have, block, size = np.zeros(m, np.uint64), 0, hashes, 1
    while size <= k:  # blocks of doubled size, of which those that add up to k words are put together
        times = np.uint64(pow(int(ODD), size, 1 << 64))
        if k & size:
            out, have = out * times + block[have : have + m], have + size
        block, size = block[: max(len(block) - size, 0)] * times + block[size:], 2 * size
    out *= MIX
    return out ^ (out >> np.uint64(31))


def seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the minimal k-mers of all windows, every occurrence, in order of position."""
    if len(hashes) < KMER:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kmers = rolled(hashes, KMER)
    at = minimal(kmers, WINDOW)
    return kmers[at], at


def scanned(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, tid, n) of all rows with the text's own hash, and (tid, words) of each text once, words as 16-bit hashes."""
    small_batches(docs.sparkSession)
    names = ["tid", "n", "words"]
    kinds = [pa.int64(), pa.int32(), pa.binary()]

    @F.arrow_udf("struct<tid: bigint, n: int, words: binary>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emitted: set[int] = set()  # a task gives the words of a text once, so copies add one row each and no more
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                words = words_of(text)
                tid = xxhash.xxh64_intdigest(b" ".join(words))
                signed = tid - (1 << 64) if tid >> 63 else tid
                if tid in emitted or len(words) < MIN_WORDS * IDENTITY:
                    rows.append((signed, len(words), None))
                    continue
                if len(emitted) >= EMITTED:
                    emitted.clear()
                emitted.add(tid)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
                rows.append((signed, len(words), (hashes >> np.uint64(48)).astype("<u2").tobytes()))
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    scan_rows = scratch.write(docs.select(F.col(id_col).alias("id"), scan(F.col(text_col)).alias("s")).select("id", "s.*"), "scanned")
    texts = scratch.write(scan_rows.filter("words is not null").groupBy("tid").agg(F.first("words").alias("words")), "texts")
    members = scratch.write(scan_rows.select("id", "tid", "n"), "members")
    scratch.drop("scanned")
    return members, texts


def seed_keys(texts: DataFrame) -> DataFrame:
    """(tid, h, at): the seeds of every text with their packed places."""

    @F.arrow_udf("struct<h: array<bigint>, at: array<bigint>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [seeds(mixed(np.frombuffer(words.as_py(), "<u2"))) for words in batch]
            parts = [[h.view(np.int64) for h, _ in rows], [(at << SPAN) | KMER for _, at in rows]]
            yield pa.StructArray.from_arrays([pa.array(p, pa.list_(pa.int64())) for p in parts], names=["h", "at"])

    return exploded(texts.select("tid", find("words").alias("k")))


def exploded(keys: DataFrame) -> DataFrame:
    """(tid, h, at) of rows (tid, k) with ``k`` a struct of two arrays."""
    pairs = keys.select("tid", F.explode(F.arrays_zip(F.col("k.h").alias("h"), F.col("k.at").alias("at"))).alias("k"))
    return pairs.select("tid", "k.h", "k.at")


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Local chains of (pos, other) matches, best first; each match is in one chain at most.

    A predecessor lies before in both texts; the gap cost is linear in both distances, so the
    best one is a prefix maximum over the other text's positions.
    """
    matches = sorted(set(matches))
    if len(matches) == 2:  # by far the most; as below
        (a, b), (x, y) = matches
        return [matches] if a < x and b < y and KMER + GAP * (a + b) - GAP * (x + y) > 0 else []
    rank = {v: i + 1 for i, v in enumerate(sorted({b for _, b in matches}))}
    size = len(rank)
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (size + 1)
    score, back = [0.0] * len(matches), [-1] * len(matches)
    at = 0
    while at < len(matches):
        stop = at
        while stop < len(matches) and matches[stop][0] == matches[at][0]:
            stop += 1
        for j in range(at, stop):  # those of one position see only earlier ones
            a, b = matches[j]
            best, k = (-1e300, -1), rank[b] - 1
            while k:
                best, k = max(best, tree[k]), k & (k - 1)
            gained = best[0] - GAP * (a + b)
            score[j], back[j] = (KMER + gained, best[1]) if gained > 0 else (float(KMER), -1)
        for j in range(at, stop):
            entry, k = (score[j] + GAP * sum(matches[j]), j), rank[matches[j][1]]
            while k <= size:
                if tree[k] < entry:
                    tree[k] = entry
                k += k & -k
        at = stop
    used, out = [False] * len(matches), []
    for j in sorted(range(len(matches)), key=lambda j: -score[j]):
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(matches[j])
            j = back[j]
        if len(chain) >= SEEDS:
            out.append(chain[::-1])
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; a bit per word of one text, a step per word of the other."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = defaultdict(int)
    for i, x in enumerate(b.tolist()):
        places[x] |= 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words further two texts agree without gaps, and how many of them are equal; stops after a loss of ``DROP``."""
    n = min(len(a), len(b), REACH)
    best = equal = score = top = at = 0
    for seen, m in enumerate((a[:n] != b[:n]).nonzero()[0].tolist()):
        score += m - at
        if score > top:
            top, best, equal = score, m, m - seen
        score -= MISMATCH
        if top - score >= DROP:
            return best, equal
        at, equal_rest = m + 1, n - seen - 1
    if not at:
        return n, n
    return (n, equal_rest) if score + n - at > top else (best, equal)


def extended_all(same: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``extended`` for a row of words each, of which ``same`` says where they agree and ``inside`` where both texts have one."""
    score = np.where(same, 1, -MISMATCH).cumsum(axis=1)
    top = np.maximum(np.maximum.accumulate(score, axis=1), 0)
    over = (top - score >= DROP) | ~inside
    seen = np.where(over.any(axis=1), over.argmax(axis=1), over.shape[1])  # words before the one that stops
    score[np.arange(over.shape[1]) >= seen[:, None]] = -1
    best = np.where(score.max(axis=1) > 0, score.argmax(axis=1) + 1, 0)
    return best, (same & (np.arange(over.shape[1]) < best[:, None])).sum(axis=1)


def settled(p: np.ndarray, q: np.ndarray, size: np.ndarray, cuts: list[bytes], other_cuts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What ``aligned`` gives for short chains at one distance, for all at once where that is simple.

    Of each chain of ``size`` words from ``p`` and ``q``: the number of its passages, -1 where ``widened`` has to
    say and -2 where ``aligned`` has, and the passage. Simple are chains of equal words that make a passage as a
    whole, or have too few equal words within ``REACH`` for any.
    """
    a, b = (np.frombuffer(b"".join(c), "<u2") for c in (cuts, other_cuts))
    ends, other_ends = (np.cumsum([len(x) // 2 for x in c]) for c in (cuts, other_cuts))
    start, other_start = (np.concatenate(([0], e[:-1])) for e in (ends, other_ends))

    def compared(i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``n`` words from each of ``i`` and ``j`` agree, and which there are."""
        away = np.arange(max(int(n.max()), 1))
        inside = away < n[:, None]
        i, j = (np.where(inside, x[:, None] + step * away, 0) for x in (i, j))
        return (a[i] == b[j]) & inside, inside

    x, y = p + size, q + size
    core, inside = compared(start + p, other_start + q, size, 1)
    equal_core = (core == inside).all(axis=1)
    before = compared(start + p - 1, other_start + q - 1, np.minimum(np.minimum(p, q), REACH), -1)
    after = compared(start + x, other_start + y, np.minimum(np.minimum(ends - start - x, other_ends - other_start - y), REACH), 1)
    (left, more_left), (right, more_right) = extended_all(*before), extended_all(*after)
    length, equal = size + left + right, size + more_left + more_right
    whole = equal_core & (length >= MIN_WORDS) & (equal >= IDENTITY * length)
    hopeless = size + before[0].sum(axis=1) + after[0].sum(axis=1) < IDENTITY * MIN_WORDS
    return np.where(whole, 1, np.where(hopeless, 0, np.where(equal_core & (length < MIN_WORDS), -1, -2))), np.stack([p - left, x + right, q - left, y + right, equal], axis=1)


def linked(at: np.ndarray, to: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common words from each position of a chain to the next; stretches at one distance are compared at once."""
    gap, other_gap = np.diff(at), np.diff(to)
    out = np.where(gap == other_gap, gap, -1)
    turns = [0, *(np.flatnonzero(gap != other_gap) + 1).tolist(), len(at)]
    for i, j in zip(turns, turns[1:]):
        if j - i > 1:
            low, high = int(at[i]), int(at[j - 1])
            unlike = (a[low:high] != b[to[i] : to[j - 1]]).nonzero()[0]
            if len(unlike):
                out[i + np.searchsorted(at[i:j] - low, unlike, side="right") - 1] = -1
    for k in np.flatnonzero(out < 0).tolist():
        out[k] = common_words(a[at[k] : at[k + 1]], b[to[k] : to[k + 1]])
    return out


def stretched(size: int, equal: int, before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, int] | None:
    """Words to take in before and after ``size`` words, and all equal ones then, so that they make a passage that ends in equal words and agrees best."""
    left, right = (np.concatenate(([0], np.flatnonzero(a == b) + 1)) for a, b in (before, after))
    if equal + len(left) + len(right) - 2 < IDENTITY * MIN_WORDS:
        return None
    sizes = size + left[:, None] + right
    same = equal + np.arange(len(left))[:, None] + np.arange(len(right))
    over = np.where(sizes >= MIN_WORDS, same - IDENTITY * sizes, -1.0)
    i, j = np.unravel_index(int(over.argmax()), over.shape)
    return (int(left[i]), int(right[j]), int(same[i, j])) if over[i, j] > -1e-9 else None


def widened(p: int, q: int, x: int, y: int, equal: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The passage, if any, that the words from ``p`` to ``x`` and ``q`` to ``y`` make with more beyond their ends."""
    n, m = min(p, q, REACH), min(len(a) - x, len(b) - y, REACH)
    more = stretched(max(x - p, y - q), equal, (a[p - n : p][::-1], b[q - n : q][::-1]), (a[x : x + m], b[y : y + m]))
    return [(p - more[0], x + more[1], q - more[0], y + more[1], more[2])] if more else []


def aligned(at: np.ndarray, to: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain: start and end in both texts and the number of equal words. Chain positions ``at`` and ``to`` count from the arrays' starts.

    The whole chain is one passage if enough of its words agree; one of too few words takes in
    more beyond its ends while enough agree. Otherwise the longest run of
    its seeds that makes a passage is one, and so on to the left and right of it.
    """
    before = np.concatenate(([0], np.cumsum(linked(at, to, a, b), dtype=np.int64)))

    def ends(js: list[int]) -> tuple[np.ndarray, np.ndarray]:
        return (np.array([extended(a[: at[j]][::-1], b[: to[j]][::-1]) for j in js]).T, np.array([extended(a[at[j] + KMER :], b[to[j] + KMER :]) for j in js]).T)

    last = len(at) - 1
    p, q, x, y = int(at[0]), int(to[0]), int(at[last]) + KMER, int(to[last]) + KMER
    (left, more_left), (right, more_right) = extended(a[:p][::-1], b[:q][::-1]), extended(a[x:], b[y:])
    whole = (p - left, x + right, q - left, y + right, int(before[last]) + KMER + more_left + more_right)
    longer = max(whole[1] - whole[0], whole[3] - whole[2])
    if whole[4] >= IDENTITY * longer and longer >= MIN_WORDS:
        return [whole]
    if longer < MIN_WORDS:  # ends with edits, at which ``extended`` stops
        return widened(p, q, x, y, int(before[last]) + KMER, a, b)
    left, right = ends(list(range(last + 1)))
    start, other_start, stop, other_stop = at - left[0], to - left[0], at + KMER + right[0], to + KMER + right[0]
    out, open_runs = [], [(0, last + 1)]
    while open_runs:
        low, high = open_runs.pop()
        best = (0, 0, 0, 0)
        for i in range(low, high):
            size = np.maximum(stop[i:high] - start[i], other_stop[i:high] - other_start[i])
            equal = before[i:high] - before[i] + KMER + left[1, i] + right[1, i:high]
            size = np.where((size >= MIN_WORDS) & (equal >= IDENTITY * size), size, 0)
            j = int(size.argmax())
            best = max(best, (int(size[j]), -i, i + j, int(equal[j])))
        if best[0]:
            i, j = -best[1], best[2]
            out.append((int(start[i]), int(stop[j]), int(other_start[i]), int(other_stop[j]), best[3]))
            open_runs += [(low, i), (j + 1, high)]
    return sorted(out)


CHAIN = "array<struct<other: bigint, at: array<int>, other_at: array<int>>>"
CHAIN_ARROW = pa.list_(pa.struct([("other", pa.int64()), ("at", pa.list_(pa.int32())), ("other_at", pa.list_(pa.int32()))]))

PASSAGE = "array<struct<start: int, end: int, other_start: int, other_end: int, equal: int>>"
PASSAGE_ARROW = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "other_start", "other_end", "equal")]))


def met(keys: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of (h, tid, at): the rows of shared keys with their first holder (``other``), and from these (tid, other, at, other_at).

    A key is shared between texts, or held twice by its only holder, which may so meet itself.
    """
    first = keys.groupBy("h").agg(F.min("tid").alias("other"), F.max("tid").alias("last"), F.min("at").alias("low"), F.max("at").alias("high")).filter("other < last or low < high").select("h", "other")
    # the holder's own position comes with its row of the same join; written, so that of the two shuffles of all keys one is held at a time
    held = scratch.write(keys.join(scratch.write(first, f"first-{name}"), "h"), f"held-{name}")
    scratch.drop(f"first-{name}")
    # written, so that the join below can split a key that very many texts hold
    where = scratch.write(held.filter("tid = other").groupBy("h").agg(F.min("at").alias("other_at")), f"holders-{name}")
    return held, held.join(where, "h").filter("tid <> other or at <> other_at").select("tid", "other", "at", "other_at")


def longer_keys(at: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and packed places of what shared seeds of a text make: neighbouring pairs, and the minimal runs of ``RUN`` words.

    ``MIN_WORDS`` words that another text holds too have a shared seed in any ``WINDOW`` of their k-mers, so only
    stretches of such seeds have runs; of ``RUNS`` runs that follow each other the one of the least hash is a key in both texts.
    """
    near = np.flatnonzero(np.diff(at) < MIN_WORDS - KMER)
    pairs = (h[near] * ODD + h[near + 1]) * MIX
    keys, places = [pairs ^ (pairs >> np.uint64(32))], [(at[near] << SPAN) | (at[near + 1] - at[near] + KMER)]
    hashes = mixed(words)
    cut = np.flatnonzero(np.diff(at) > WINDOW)
    for u, v in zip(at[np.concatenate(([0], cut + 1))].tolist(), at[np.concatenate((cut, [len(at) - 1]))].tolist()):
        low, high = max(u - WINDOW + 1, 0), min(v + WINDOW + KMER - 1, len(words))  # words that such runs may take in
        if high - low < MIN_WORDS:
            continue
        run = rolled(hashes[low:high], RUN)
        at_run = minimal(run, RUNS)
        keys.append(run[at_run])
        places.append(((low + at_run) << SPAN) | IS_RUN)
    return np.concatenate(keys).view(np.int64), np.concatenate(places)


def points(at: np.ndarray, other_at: np.ndarray) -> list[tuple[int, int]]:
    """Matching positions of a text and one holder, from packed places.

    Runs that overlap or touch at one distance are joined, and of these as few are taken as cover the same
    words. A run with seeds of its own needs no more positions; another one has one every 2 * KMER words.
    """
    p, q, span, other_span = at >> SPAN, other_at >> SPAN, at & LOW, other_at & LOW
    full = (span == IS_RUN) & (other_span == IS_RUN)
    seeded = (span != IS_RUN) & (other_span != IS_RUN)  # a run and a pair of one hash are no match
    out = set(zip(p[seeded].tolist(), q[seeded].tolist()))
    out.update(zip((p + span - KMER)[seeded].tolist(), (q + other_span - KMER)[seeded].tolist()))
    if full.any():
        p, q = p[full], q[full]
        order = np.lexsort((p, q - p))
        p, q = p[order], q[order]
        cut = np.flatnonzero((np.diff(p) > RUN) | (np.diff(p) != np.diff(q))) + 1
        starts, stops = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(p) - 1]))
        runs = sorted((int(p[i]), int(q[i]), int(p[j] + RUN)) for i, j in zip(starts.tolist(), stops.tolist()))
        own = np.array(sorted(out), np.int64).reshape(-1, 2)
        covered, k = 0, 0
        while k < len(runs):
            covered = max(covered, runs[k][0])
            best = runs[k]
            while k < len(runs) and runs[k][0] <= covered:
                best, k = max(best, runs[k], key=lambda r: r[2]), k + 1
            if best[2] <= covered:
                continue
            x, y, stop = best
            covered = stop
            if ((own[:, 1] - own[:, 0] == y - x) & (own[:, 0] >= x) & (own[:, 0] <= stop - KMER)).sum() * 2 * KMER < stop - x:
                out.update((x + i, y + i) for i in [*range(0, stop - x - KMER, 2 * KMER), stop - x - KMER])
    return sorted(out)


def chained(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, other, at, other_at): chains of positions between a text and the first holder of its seeds, pairs of seeds or runs."""
    held, by_seed = met(seed_keys(texts), "seeds", scratch)

    @F.arrow_udf("struct<h: array<bigint>, at: array<bigint>>")
    def lengthen(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for shared, words in batches:
            rows = []
            for i in range(len(shared)):
                s = shared[i].values
                at, h = s.field("at").to_numpy(), s.field("h").to_numpy()
                order = np.argsort(at)
                rows.append(longer_keys(at[order] >> SPAN, h[order].view(np.uint64), np.frombuffer(words[i].as_py(), "<u2")))
            parts = list(zip(*rows)) or [[]] * 2
            yield pa.StructArray.from_arrays([pa.array(p, pa.list_(pa.int64())) for p in parts], names=["h", "at"])

    shared = held.groupBy("tid").agg(F.collect_set(F.struct("at", "h")).alias("shared"))  # at most the text's own seeds
    keys = exploded(shared.join(texts, "tid").select("tid", lengthen("shared", "words").alias("k")))
    _, by_run = met(scratch.write(keys, "longer"), "longer", scratch)
    scratch.drop("longer")
    by_text = by_seed.unionByName(by_run).groupBy("tid").agg(F.collect_set(F.struct("other", "at", "other_at")).alias("m"))

    @F.arrow_udf(CHAIN)
    def chain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield pa.array([], CHAIN_ARROW)
                continue
            m, ends = batch.flatten(), batch.offsets.to_numpy() - batch.offsets[0].as_py()
            other, at, other_at = (m.field(c).to_numpy() for c in ("other", "at", "other_at"))
            row = np.repeat(np.arange(len(batch)), np.diff(ends))
            order = np.lexsort((other, row))
            other, at, other_at = other[order], at[order], other_at[order]
            starts = np.concatenate(([0], np.flatnonzero(np.diff(other) | np.diff(row)) + 1))
            span, other_span = at & LOW, other_at & LOW
            with_run = np.maximum.reduceat((span == IS_RUN) | (other_span == IS_RUN), starts).tolist()
            p, q = at >> SPAN, other_at >> SPAN
            firsts, lasts = list(zip(p.tolist(), q.tolist())), list(zip((p + span - KMER).tolist(), (q + other_span - KMER).tolist()))
            sizes, others, places, other_places = np.zeros(len(batch), np.int64), [], [], []
            for low, high, run, of, i in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], with_run, other[starts].tolist(), row[starts].tolist()):
                if high - low < SEEDS and at[low] & LOW == KMER:
                    continue
                found = chains(points(at[low:high], other_at[low:high]) if run else [*firsts[low:high], *lasts[low:high]])
                sizes[i] += len(found)
                for c in found:
                    others.append(of)
                    places.append([x for x, _ in c])
                    other_places.append([y for _, y in c])
            kind = CHAIN_ARROW.value_type
            parts = pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip((others, places, other_places), kind)], fields=list(kind))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), parts)

    found = by_text.select("tid", F.explode(chain(F.col("m"))).alias("c")).select("tid", "c.*")
    out = scratch.write(found, "chains")
    scratch.drop("held-seeds", "holders-seeds", "held-longer", "holders-longer")
    return out


def passages(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(tid, start, end, other, other_start, other_end, equal): aligned chains that make passages."""
    found = chained(texts, scratch)
    key = ["tid", "first", "other", "other_first"]
    spans = found.select(
        "tid", F.element_at("at", 1).alias("first"), F.element_at("at", -1).alias("last"),
        "other", F.element_at("other_at", 1).alias("other_first"), F.element_at("other_at", -1).alias("other_last"), "at", "other_at",
    )
    # both texts' words around the chain, asked for by one join with the words
    asked = spans.select("*", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("tid").alias("of"), F.col("first").alias("a"), F.col("last").alias("b")),
        F.struct(F.lit(1).alias("side"), F.col("other").alias("of"), F.col("other_first").alias("a"), F.col("other_last").alias("b")),
    )).alias("x")).select(*key, "x.*", F.when(F.col("x.side") == 0, F.col("at")).alias("at"), F.when(F.col("x.side") == 0, F.col("other_at")).alias("other_at"))
    words = texts.withColumnRenamed("tid", "of")
    low = F.greatest(F.col("a") - REACH, F.lit(0))
    cut = asked.join(words, "of").select(
        *key, "side", "at", "other_at", low.alias("low"),
        F.expr(f"substring(words, 2 * greatest(a - {REACH}, 0) + 1, 2 * (b + {KMER + REACH} - greatest(a - {REACH}, 0)))").alias("cut"),
    )
    sides = cut.groupBy(*key).agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("low", "cut")],
        F.max("at").alias("at"), F.max("other_at").alias("other_at"),
    )

    @F.arrow_udf(PASSAGE)
    def align(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            if not len(columns[0]):
                yield pa.array([], PASSAGE_ARROW)
                continue
            low, other_low = (columns[c].to_numpy().astype(np.int64) for c in (0, 2))
            cuts, other_cuts = (columns[c].to_pylist() for c in (1, 3))
            (at, ends), (to, _) = ((c.flatten().to_numpy().astype(np.int64), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in columns[4:])
            p, q, size = at[ends[:-1]] - low, to[ends[:-1]] - other_low, at[ends[1:] - 1] + KMER - at[ends[:-1]]
            apart = at - to
            short = np.flatnonzero((np.maximum.reduceat(apart, ends[:-1]) == np.minimum.reduceat(apart, ends[:-1])) & (size <= REACH))
            found: list = [-2] * len(low)
            if len(short):
                number, whole = settled(p[short], q[short], size[short], [cuts[i] for i in short], [other_cuts[i] for i in short])
                for i, n, one in zip(short.tolist(), number.tolist(), whole.tolist()):
                    found[i] = [one][:n] if n >= 0 else n
            for i, rows in enumerate(found):
                if not isinstance(rows, list):
                    a, b = np.frombuffer(cuts[i], "<u2"), np.frombuffer(other_cuts[i], "<u2")
                    if rows == -1:
                        found[i] = widened(int(p[i]), int(q[i]), int(p[i] + size[i]), int(q[i] + size[i]), int(size[i]), a, b)
                    else:
                        found[i] = aligned(at[ends[i] : ends[i + 1]] - low[i], to[ends[i] : ends[i + 1]] - other_low[i], a, b)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.array([row for rows in found for row in rows], np.int64).reshape(-1, 5)
            flat += np.repeat(np.stack([low, low, other_low, other_low, 0 * low], axis=1), sizes, axis=0)
            parts = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in flat.T], fields=list(PASSAGE_ARROW.value_type))
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), parts).cast(PASSAGE_ARROW)

    out = sides.select("tid", "other", F.explode(align("low0", "cut0", "low1", "cut1", "at", "other_at")).alias("p")).select("tid", "other", "p.*")
    rows = scratch.write(out, "passages")
    scratch.drop("chains", "texts")
    return rows


def shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per occurrence of a shared passage.

    id, ``start`` and ``end`` (words, end exclusive), ``rep_id``, ``rep_start``, ``rep_end``
    (the text that represents the passage, by its smallest id), ``equal`` (words that agree) and
    ``kind``: ``passage`` in a text that shares it with the representative, ``source`` for the
    representative's own united spans, ``copy`` for each document whose words are all those of
    another one (its whole text, unless it is shorter than ``MIN_WORDS``).

    Words are runs of letters, digits and non-ASCII characters, lower-cased. Documents without
    a shared passage have no row; so NULL and empty texts have none. A text that repeats itself, a
    periodic one too, shares passages with its own first place: it has such rows whether or not it has copies. NULL ids keep their rows,
    and represent only texts without any id; repeated rows are copies of each other. Only id
    and text are read; an empty table gives an empty result. Ids must be of one ordered type.
    """
    scratch = Scratch(docs.sparkSession)
    members, words = scanned(docs, id_col, text_col, scratch)
    found = passages(words, scratch)
    texts = members.groupBy("tid").agg(F.min("id").alias("rep_id"), F.count("*").alias("copies"))
    shared = found.join(texts.select(F.col("tid").alias("other"), "rep_id"), "other").select(
        "tid", "start", "end", "rep_id", F.col("other_start").alias("rep_start"), F.col("other_end").alias("rep_end"), "equal", F.lit("passage").alias("kind"),
    )

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def unite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([[{"start": a, "end": b} for a, b in united([(s["start"], s["end"]) for s in spans])] for spans in batch.to_pylist()], kind)

    spans = found.groupBy(F.col("other").alias("tid")).agg(F.collect_set(F.struct(F.col("other_start").alias("start"), F.col("other_end").alias("end"))).alias("spans"))
    sources = spans.select("tid", F.explode(unite(F.col("spans"))).alias("s")).join(texts, "tid").select(
        "tid", "s.start", "s.end", "rep_id", F.col("s.start").alias("rep_start"), F.col("s.end").alias("rep_end"), (F.col("s.end") - F.col("s.start")).alias("equal"), F.lit("source").alias("kind"),
    )
    partial = members.join(shared.unionByName(sources), "tid").select("id", "start", "end", "rep_id", "rep_start", "rep_end", "equal", "kind")
    whole = members.filter(F.col("n") >= MIN_WORDS).join(texts.filter("copies > 1"), "tid").select(
        "id", F.lit(0).alias("start"), F.col("n").alias("end"), "rep_id", F.lit(0).alias("rep_start"), F.col("n").alias("rep_end"), F.col("n").alias("equal"), F.lit("copy").alias("kind"),
    )
    return partial.unionByName(whole).withColumnRenamed("id", id_col)

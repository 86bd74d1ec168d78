"""BPE encoding with forced boundaries, and decoding.

Two bytes that are neighbours inside no vocabulary token can never be joined by a merge: every
merge makes a vocabulary token. So a pre-token is cut at all such pairs beforehand, the
fragments are merged on their own, and the ids are concatenated.

The chunks of a batch of texts that a worker does not remember are cut and merged together: every
round joins one pair in each fragment that still has one, as array operations over all fragments.
"""

import itertools
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import kept_by_worker, small_batches
from tallyframe.llm.word_bpe import LONG_WORD, WORD_END, Rules, chunks, load

#: Chunks and pre-tokens that a worker remembers (about 200 bytes each), and their length at most: long ones hardly come twice.
CHUNKS, WORDS, LENGTH = 500_000, 300_000, 64
#: Texts that are encoded together.
TOGETHER = 500


def inner_pairs(r: Rules) -> frozenset[str]:
    """All pairs of neighbouring byte symbols inside vocabulary tokens."""
    names = (t[: -len(WORD_END)] if t.endswith(WORD_END) else t for t in r.ids)
    return frozenset(a + b for t in names for a, b in itertools.pairwise(t))


def fragments(word: str, inside: frozenset[str]) -> list[str]:
    """The word cut between every two symbols that no token holds side by side."""
    cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in inside]
    return [word[a:b] for a, b in itertools.pairwise([0, *cuts, len(word)])] if cuts else [word]


class Memory:
    """What a worker has worked out lately: about ``bound`` short keys, the older half is dropped when full."""

    def __init__(self, bound: int):
        self.half, self.now, self.older = bound // 2, {}, {}

    def lacking(self, keys: Iterable) -> list:
        """Those of the keys that have to be worked out; the others are then in ``now``."""
        absent = set(keys).difference(self.now)
        again = absent.intersection(self.older)
        self.now.update(zip(again, map(self.older.__getitem__, again)))
        return list(absent.difference(again))

    def trim(self, new: list) -> None:
        """Forget the long ones of the new keys, and the older half when ``now`` is full."""
        for key in new:
            if len(key) > LENGTH:
                del self.now[key]
        if len(self.now) >= self.half:
            self.now, self.older = {}, self.now


class Codec:
    """Encoder and decoder of one vocabulary, with bounded memory of chunks and pre-tokens."""

    def __init__(self, source: str):
        self.rules = r = Rules(source)
        byte_of = {c: b for b, c in enumerate(r.alphabet)}
        self.inside = np.zeros((256, 256), bool)
        for a, b in inner_pairs(r):
            self.inside[byte_of[a], byte_of[b]] = True
        self.first = np.array([r.ids[c] for c in r.alphabet], np.int64)
        self.last = np.array([r.ids[c + WORD_END] for c in r.alphabet], np.int64)
        pairs = np.array([r.ids[a] << 32 | r.ids[b] for a, b in r.rank], np.int64)
        self.ranks = np.append(np.argsort(pairs), len(pairs))
        self.pairs = np.append(np.sort(pairs), np.iinfo(np.int64).max)
        self.joined = np.array([r.ids[t] for t in r.joined], np.int64)
        self.chunks, self.words = Memory(CHUNKS), Memory(WORDS)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours; those without one rank behind all."""
        pair = left << 32 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], len(self.joined))

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens, all merged together; none may be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word_starts = np.cumsum(lengths) - lengths
        symbols, alive = self.first[raw], np.ones(len(raw), bool)
        symbols[word_starts + lengths - 1] = self.last[raw[word_starts + lengths - 1]]
        cut = np.append(True, ~self.inside[raw[:-1], raw[1:]])
        cut[word_starts] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(raw)))
        for at, size in zip(starts[sizes > LONG_WORD].tolist(), sizes[sizes > LONG_WORD].tolist()):
            names = self.rules.names
            ids = [self.rules.ids[t] for t in self.rules.merge_long([names[i] for i in symbols[at : at + size].tolist()])]
            symbols[at : at + len(ids)] = ids
            alive[at + len(ids) : at + size] = False
        self._merge(symbols, alive, starts, sizes, (sizes > 1) & (sizes <= LONG_WORD))
        packed = symbols[alive].astype(np.int32).tobytes()
        ends = np.cumsum(np.add.reduceat(alive, word_starts, dtype=np.int64)) * 4
        return [packed[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])]

    def _merge(self, symbols: np.ndarray, alive: np.ndarray, starts: np.ndarray, sizes: np.ndarray, go: np.ndarray) -> None:
        """Merge the fragments marked in ``go`` in place: per round the best pair of each, the leftmost among equals."""
        none = len(self.joined)
        sizes = sizes[go]
        # of each symbol still in work: its place, itself, and the rank with its successor
        place = np.repeat(starts[go] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        symbol = symbols[place]
        ranks = np.full(len(place), none)
        if len(place):
            inner = np.ones(len(place), bool)
            inner[np.cumsum(sizes) - 1] = False
            inner = np.flatnonzero(inner)
            ranks[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(place):
            best = np.minimum.reduceat(ranks, np.cumsum(sizes) - sizes)
            more = best < none
            if not more.all():
                keep = np.repeat(more, sizes)
                place, symbol, ranks, sizes, best = place[keep], symbol[keep], ranks[keep], sizes[more], best[more]
                if not len(place):
                    return
            fragment = np.repeat(np.arange(len(sizes)), sizes)
            hits = np.flatnonzero(ranks == best[fragment])
            at = hits[np.append(True, np.diff(fragment[hits]) > 0)]
            symbol[at] = self.joined[best]
            symbols[place[at]] = symbol[at]
            alive[place[at + 1]] = False
            keep = np.ones(len(place), bool)
            keep[at + 1] = False
            place, symbol, ranks, sizes = place[keep], symbol[keep], ranks[keep], sizes - 1
            at, ends = at - np.arange(len(at)), np.cumsum(sizes)
            ranks[at] = none
            followed, led = at[at < ends - 1], at[at > ends - sizes]
            ranks[followed] = self.rank(symbol[followed], symbol[followed + 1])
            ranks[led - 1] = self.rank(symbol[led - 1], symbol[led])

    def pieces(self, text: str) -> list[str]:
        """Chunks and special strings of a text, in order."""
        first, *rest = self.rules.segments(text)
        out = chunks(first)
        for special, between in zip(rest[::2], rest[1::2]):
            out += [special, *chunks(between)]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as 32-bit integers."""
        r = self.rules
        parts = [self.pieces(text) for text in texts]
        new = self.chunks.lacking(itertools.chain.from_iterable(parts))
        of = [r.words(c) for c in new]
        unknown = self.words.lacking(itertools.chain.from_iterable(of))
        known, words = self.chunks.now, self.words.now
        if unknown:
            words.update(zip(unknown, self.merged([w.encode("utf-8") for w in unknown])))
        known.update(zip(new, [b"".join(map(words.__getitem__, w)) for w in of]))
        known.update((s, array("i", [i]).tobytes()) for s, i in r.specials.items())
        out = [b"".join(map(known.__getitem__, text)) for text in parts]
        self.chunks.trim(new)
        self.words.trim(unknown)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of many texts, NULL as empty, ``TOGETHER`` at a time."""
        return [ids for at in range(0, len(texts), TOGETHER) for ids in self.encode_all([t or "" for t in texts[at : at + TOGETHER]])]


def unpacked(packed: bytes) -> list[int]:
    return array("i", packed).tolist()


def id_lists(packed: list[bytes]) -> pa.Array:
    """Packed ids of several texts as one list column."""
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


class Names(dict):
    """Token strings by id; an unknown id has none."""

    def __missing__(self, key):
        return None


def decode(ids: list[int], names: Names) -> str:
    """Token strings joined by spaces, as a file without a decoder section asks; unknown ids are left out."""
    found = list(map(names.__getitem__, ids))
    return " ".join(filter(None, found) if None in found else found)


def codec(source: str) -> Codec:
    """The worker's codec, made once."""
    return kept_by_worker(("codec", source), lambda: Codec(source))


def encode_column(docs: DataFrame, vocabulary: str, text: Column) -> Column:
    """Token ids of a text as array<int>; NULL and empty texts give an empty array."""
    sent = small_batches(docs.sparkSession).sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield id_lists(codec(sent.value).encoded(batch.to_pylist()))

    return encoded(text)


def decode_column(docs: DataFrame, vocabulary: str, ids: Column) -> Column:
    """The text of token ids, special tokens included; NULL or empty arrays give the empty text, NULL and unknown ids are left out."""
    sent = small_batches(docs.sparkSession).sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Names(codec(sent.value).rules.names)
        for batch in batches:
            yield pa.array([decode(v or [], names) for v in batch.to_pylist()], type=pa.string())

    return decoded(ids)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns named in ``keep``, ``ids`` array<int>, and ``decoded`` from these ids.

    Both directions run in one pass over the texts. NULL texts count as empty: no ids, empty
    decoded text. NULL and repeated ids keep a row each; other columns are not read. An empty
    table gives an empty result. No shuffle.
    """
    sent = small_batches(docs.sparkSession).sparkContext.broadcast(load(vocabulary))

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Names(codec(sent.value).rules.names)
        for batch in batches:
            packed = codec(sent.value).encoded(batch.to_pylist())
            texts = pa.array([decode(unpacked(p), names) for p in packed], pa.string())
            yield pa.StructArray.from_arrays([id_lists(packed), texts], names=["ids", "decoded"])

    return docs.select(id_col, *keep, both(F.col(text_col)).alias("coded")).select(id_col, *keep, "coded.ids", "coded.decoded")


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by single spaces."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Count of ids and SHA-256 of the ids joined by spaces and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )

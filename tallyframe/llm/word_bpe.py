"""The rules of a lower-casing word-end BPE vocabulary, as small functions for use inside tasks.

A text is cut at special strings, then at white space into chunks. A chunk is normalised
(NFC, lower case per character) and cut into pre-tokens; a pre-token becomes byte symbols,
the last one marked as word end, and merges are applied by rank. White space never reaches a
pre-token, so a chunk's result does not depend on its neighbours and can be remembered.
"""

import functools
import heapq
import itertools
import json
import re
import sys
import unicodedata

WORD_END = "</w>"
#: From this many symbols on, merges are picked from a heap: the plain search would be quadratic.
LONG_WORD = 200

# Fixed values of the vocabulary file's format: which characters stand for which bytes.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100."""
    spare = iter(range(0x100, 0x200))
    keep = set(PRINTABLE)
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


@functools.lru_cache(maxsize=4)
def load(path: str) -> str:
    """The vocabulary file with the library's own character tables, as one JSON text for ``rules``.

    Python's Unicode tables are older than the library's: letters, numbers and lower-case
    forms are asked from the library once, on the driver.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
    spec = json.loads(open(path, encoding="utf-8").read())
    for key, name in (("letters", "L"), ("numbers", "N")):
        pieces = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), "removed", invert=True).pre_tokenize_str(points)
        runs = itertools.groupby(enumerate(ord(c) for c, _ in pieces), lambda x: x[1] - x[0])
        spec[key] = "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in ([p for _, p in g] for _, g in runs))
    low, newer = normalizers.Lowercase(), [c for c in points if unicodedata.category(c) == "Cn"]
    spec["lower"] = {c: x for c in newer if (x := low.normalize_str(c)) != c}
    return json.dumps(spec)


#: White space of the vocabulary file: the Unicode property, without Python's separators 1C to 1F.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Rules:
    """Vocabulary, merges and pre-tokenisation, parsed from what ``load`` gives."""

    def __init__(self, source: str):
        spec = json.loads(source)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = re.compile(pattern.replace(r"\p{L}", spec["letters"]).replace(r"\p{N}", spec["numbers"]).replace(r"[^\s", "[^" + WHITE))
        self.lower = spec["lower"]
        self.special_lower = re.compile("[\u03a3" + "".join(map(re.escape, self.lower)) + "]")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.ids = spec["model"]["vocab"]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in spec["model"]["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.joined = [a + b for a, b in pairs]
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.specials.items()}
        self.alphabet = byte_alphabet()

    def segments(self, text: str) -> list[str]:
        """Special strings and the text between them, in order."""
        return self.special_cut.split(text) if self.special_cut else [text]

    def words(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space, as normalised text."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk.isprintable():
                return self.pattern.findall(chunk.lower())
        normal = unicodedata.normalize("NFC", chunk)
        # lower case goes by single characters: no final form of sigma
        low = "".join([self.lower.get(c) or c.lower() for c in normal]) if self.special_lower.search(normal) else normal.lower()
        return self.pattern.findall(low)

    def pretokens(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space, in byte symbols."""
        words = self.words(chunk)
        if chunk.isascii() and chunk.isprintable():
            return words
        letters = self.alphabet
        return ["".join([letters[b] for b in word.encode("utf-8")]) for word in words]

    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the lowest-ranked merge until none is left; among equals the leftmost goes first."""
        rank, joined, none = self.rank.get, self.joined, len(self.joined)
        ranks = [rank(p, none) for p in zip(symbols, symbols[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at : at + 2] = [joined[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], joined[best]), none)
            if at < len(ranks):
                ranks[at] = rank((joined[best], symbols[at + 1]), none)
        return symbols

    def tokens(self, word: str) -> list[str]:
        """Token strings of one pre-token."""
        return self.merged([*word[:-1], word[-1] + WORD_END])

    def merged(self, symbols: list[str]) -> list[str]:
        return self.merge_long(symbols) if len(symbols) > LONG_WORD else self.merge(symbols)

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same result as ``merge`` in n log n, for very long pre-tokens."""
        rank, joined, n = self.rank.get, self.joined, len(symbols)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i) for i, p in enumerate(zip(symbols, symbols[1:])) if (m := rank(p)) is not None]
        heapq.heapify(heap)
        while heap:
            best, at = heapq.heappop(heap)
            right = after[at]
            if symbols[at] is None or right < 0 or rank((symbols[at], symbols[right])) != best:
                continue
            symbols[at], symbols[right] = joined[best], None
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
                if (m := rank((symbols[at], symbols[after[at]]))) is not None:
                    heapq.heappush(heap, (m, at))
            if before[at] >= 0 and (m := rank((symbols[before[at]], symbols[at]))) is not None:
                heapq.heappush(heap, (m, before[at]))
        return [s for s in symbols if s is not None]


#: Control characters that Python's split() takes for white space and the vocabulary does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")
SPACES = re.compile(f"[{WHITE}]+")


def chunks(text: str) -> list[str]:
    """Maximal runs without white space."""
    if NOT_SPACE.search(text):
        return [c for c in SPACES.split(text) if c]
    return text.split()


class Remembered(dict):
    """A dict that computes what it lacks and holds ``bound`` recent keys: the older half is dropped when full."""

    def __init__(self, compute, bound: int):
        super().__init__()
        self.compute, self.half, self.older = compute, bound // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:  # long keys hardly come twice
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


@functools.lru_cache(maxsize=4)
def rules(source: str) -> Rules:
    """Parsed rules, once per worker."""
    return Rules(source)

"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``window`` consecutive words of the benchmark items. The
matcher slides along a document's words and looks at the last ``BLOCK`` words of its position:
a block that no test string holds moves it on by window - BLOCK + 1 words, one that test
strings hold further left by their distance from the end, and one that ends test strings opens
its bucket, where the first words select candidates and a direct comparison confirms them.
"""

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import kept_by_worker, small_batches, written

#: Words in a block of the shift table.
BLOCK = 3
#: Bytes of benchmark text that one pass searches for; a larger benchmark is searched in several passes.
PASS_BYTES = 1 << 20
#: An item of more words is cut into pieces that overlap by a window less one word.
PIECE_WORDS = 20_000

#: Bytes to bytes: A-Z lower-cased, other ASCII than letters and digits to a space, the rest as it is.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))

SCHEMA = "n_words: bigint, hits: array<int>, items: array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and non-ASCII characters, in UTF-8."""
    return (text or "").encode("utf-8").translate(FOLD).split()


class Machine:
    """Shift table and buckets for test strings of one length."""

    def __init__(self, length: int, block: int = BLOCK):
        self.length, self.block = length, min(block, length)
        self.step = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set]]] = {}

    def add(self, string: tuple, item: str | None) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            piece = string[end - b : end]
            self.shift[piece] = min(self.shift.get(piece, self.step), self.length - end)
        self.buckets.setdefault(string[-b:], {}).setdefault(string[:b], {}).setdefault(string, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set]]:
        """First word and items of every occurrence."""
        b, m, shift, step, buckets = self.block, self.length, self.shift.get, self.step, self.buckets
        end, n = m, len(words)
        while end <= n:
            block = tuple(words[end - b : end])
            move = shift(block, step)
            if move:
                end += move
                continue
            at = end - m
            selected = buckets[block].get(tuple(words[at : at + b]))
            if selected and (items := selected.get(tuple(words[at:end]))):
                yield at, items
            end += 1


def machines(items: list[tuple[str | None, list[bytes]]], window: int) -> list[Machine]:
    """One machine for each length of test strings: full windows, and short items as one window each."""
    by_length: dict[int, Machine] = {}
    for name, words in items:
        m = min(window, len(words))
        machine = by_length.setdefault(m, Machine(m)) if m else None
        for at in range(len(words) - m + 1 if m else 0):
            machine.add(tuple(words[at : at + m]), name)
    return list(by_length.values())


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(s) for s in out]


def search_text(text: str | None, hits: list[int], items: list[str], found_by: list[Machine]):
    """Words, hit spans (flat starts and ends) and items of a text, added to those of earlier passes."""
    words = words_of(text)
    spans, names = list(zip(hits[::2], hits[1::2])), set(items)
    for machine in found_by:
        for at, of in machine.search(words):
            spans.append((at, at + machine.length))
            names |= of
    names.discard(None)
    return len(words), [x for s in united(spans) for x in s], sorted(names)


def passes(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark's pieces (item, words joined), in lists of at most ``PASS_BYTES``."""
    overlap = window - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                starts = range(0, max(len(words) - overlap, 1), PIECE_WORDS) if words else ()
                pieces = [b" ".join(words[a : a + PIECE_WORDS + overlap]).decode("utf-8") for a in starts]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces), pa.string()), pa.array(pieces, pa.string())], names=["item", "words"])

    pieces = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(cut, "item string, words string")
    held, size = [], 0
    for row in pieces.toLocalIterator():
        if held and size + len(row.words) > PASS_BYTES:
            yield held
            held, size = [], 0
        held.append((row["item"], row["words"]))
        size += len(row["words"])
    yield held


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "bench") -> DataFrame:
    """Every row of ``docs`` with all its columns, and ``out_col`` struct<n_words, hits, items>.

    ``hits`` holds starts and ends (exclusive) of hit word spans, flat and in order; ``items``
    the ids (as text, sorted) of the items with an occurring window. An item of fewer words
    than ``window``, but not none, is one window. NULL and empty texts have no words, on
    either side; items with a NULL id hit words but are not listed; repeated items count once.
    Empty tables are fine. A column of ``docs`` named as ``out_col`` is replaced.

    The benchmark is a stated query set: it goes to the workers in passes of ``PASS_BYTES``;
    a benchmark within one pass costs one scan of the documents and no shuffle.
    """
    spark = small_batches(docs.sparkSession)
    out = docs.withColumn(out_col, F.lit(None).cast(f"struct<{SCHEMA}>"))
    for k, held in enumerate(passes(benchmark, window, item_col, item_text_col)):
        if k:  # a further pass starts from what the earlier ones have found
            out = written(out, "bench-pass")
        sent = spark.sparkContext.broadcast(held)

        @F.arrow_udf(f"struct<{SCHEMA}>")
        def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            pieces = sent.value
            found_by = kept_by_worker(("machines", window, tuple(pieces)), lambda: machines([(n, w.encode("utf-8").split()) for n, w in pieces], window))
            for texts, before in batches:
                rows = [search_text(t, *((b["hits"], b["items"]) if b else ([], [])), found_by) for t, b in zip(texts.to_pylist(), before.to_pylist())]
                n, hits, items = zip(*rows) if rows else ((), (), ())
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["n_words", "hits", "items"])

        out = out.withColumn(out_col, search(F.col(text_col), F.col(out_col)))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``hits``, ``items``, ``contaminated``; see ``occurrences``."""
    found = occurrences(docs.select(id_col, text_col), benchmark, window, text_col, item_col)
    n_hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("bench.hits") - 1, F.lit(0))), F.lit(0).cast("long"),
        lambda acc, i: acc + F.coalesce(F.get("bench.hits", i), F.lit(0)) * F.when(i % 2 == 1, 1).otherwise(-1),
    )
    return found.select(id_col, "bench.n_words", n_hit.alias("n_hit"), "bench.hits", "bench.items", (F.size("bench.hits") > 0).alias("contaminated"))

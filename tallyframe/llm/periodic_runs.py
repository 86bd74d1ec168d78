"""Periodic runs of words: stretches that repeat themselves four times or more.

A run is a stretch of words with a smallest period, at least ``EXPONENT`` periods and
``SHORTEST`` words long, that no neighbouring word extends. Periods are taken by octave, from 2^k
up to 2^(k+1) words, and for each octave a document is a row of overlapping tiles:

1. Blocks of 2^(k+1) words get exact names by doubling (pairs of names of half the size). A run
   of an octave shows at each of its blocks: the block's next occurrence is exactly one period
   on. Only tiles with such a block are exploded; all others hold no run of the octave.
2. Tiles are dealt over the cluster and solved on their own. Around boundaries every 2^(k+1)
   words, the Z-function to the right and the Z-function of the reversed text to the left tell for
   every period at once how far the text repeats itself across the boundary.
3. What a tile sees of a run ends at the tile. Fragments go to (document, period), where those
   that overlap or touch are stitched; runs that are long enough go to their document.

Documents of the same words are solved once.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import written

#: Words that a run has at least, and periods.
SHORTEST, EXPONENT = 6, 4
#: Words that the boundaries of a tile span at least, and texts named together.
SPAN, TOGETHER = 256, 500

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spacing(octave: int) -> int:
    """Words between boundaries, and of a named block: more than any period of the octave, no more than any run's repeats."""
    return 2 << octave


def tile_span(octave: int) -> int:
    return max(SPAN, spacing(octave))


def numbered(words: list[str]) -> np.ndarray:
    """The words as numbers in order of first occurrence."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def repeating(names: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, positions) of the blocks whose next occurrence is a period of that octave away.

    ``names`` are numbers of the words of several documents, no number in two of them; ``ends``
    is where each position's document ends.
    """
    at = np.flatnonzero(np.bincount(names)[names] > 1) if len(names) else np.zeros(0, np.int64)
    name, octave = names.astype(np.int64), 0
    while len(at):
        half, size = 1 << octave, 2 << octave
        known = np.full(len(names) + 1, -1)
        known[at] = name[at]
        at = at[at + size <= ends[at]]
        second = known[at + half]
        at, second = at[second >= 0], second[second >= 0]
        if not len(at):
            return
        pair = known[at] * (second.max() + 1) + second
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        on = at[order][1:] - at[order][:-1]
        yield octave, at[order][:-1][same & (on >= half) & (on < size)]
        group = np.cumsum(np.concatenate([[0], ~same])) if len(order) else order
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        name = np.full(len(names), -1)
        name[at[order]] = group
        at, octave = np.sort(at[order][again]), octave + 1


def tiles_of(docs: list[np.ndarray]) -> list[list[tuple[int, int, int, bytes]]]:
    """Per document its (octave, first boundary, words before it, words as packed numbers) of tiles that may hold runs."""
    lengths = [len(d) for d in docs]
    starts = np.array([0, *accumulate(lengths)])
    firsts = np.array([0, *accumulate(int(d.max()) + 1 if len(d) else 0 for d in docs)])
    names = np.concatenate([d + f for d, f in zip(docs, firsts)]) if docs else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(docs)), lengths)
    out: list[list[tuple[int, int, int, bytes]]] = [[] for _ in docs]
    for octave, at in repeating(names, starts[1:][of]):
        step, span = spacing(octave), tile_span(octave)
        doc, place = of[at], at - starts[:-1][of[at]]
        # words that repeat lie from the block's first word up to its end: its boundaries are in these two tiles
        both = np.unique(np.concatenate([np.stack([doc, place // span]), np.stack([doc, (place + step) // span])], axis=1), axis=1)
        for d, tile in both.T.tolist():
            low = max(tile * span - step, 0)
            high = min(tile * span + span + step, lengths[d])
            if tile * span < lengths[d]:
                out[d].append((octave, tile * span, tile * span - low, docs[d][low:high].astype(np.int32).tobytes()))
    return out


def z_function(text: list[int], count: int) -> list[int]:
    """For each start below ``count``, how many words from there equal the first ones of the text."""
    n, left, right = len(text), 0, 0
    z = [n] + [0] * (count - 1)
    for i in range(1, min(count, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and text[k] == text[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def primitive(block: list[int]) -> bool:
    """Whether a block is not a smaller one repeated."""
    q = len(block)
    return not any(q % d == 0 and block[d:] == block[:-d] for d in range(1, q // 2 + 1))


def fragments(words: list[int], before: int, octave: int, opens: bool, closes: bool) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the words that equal the word one period on, as far as this tile sees.

    ``words`` begin ``before`` words ahead of the tile's first boundary; ``opens`` and ``closes``
    say that the document begins or ends with them. What neighbouring boundaries see of one
    stretch is joined. A stretch that ends inside the tile at both sides is given if it makes a
    run; one cut off by the tile always.
    """
    step, low, n = spacing(octave), 1 << octave, len(words)
    seen: dict[int, list[list[int]]] = {}
    for c in range(before, min(before + tile_span(octave), n), step):
        first, last = max(c - step, 0), min(c + 2 * step, n)
        right = z_function(words[c:last], step)
        # the reversed left part, then the reversed words up to the farthest period beyond the boundary
        beyond = min(c + step, n)
        left = words[first:c][::-1]
        back = z_function([*left, -1, *words[first:beyond][::-1]], len(left) + 1 + beyond - c)
        for q in range(low, min(step, last - c)):
            start, end = c - back[len(left) + 1 + beyond - c - q], c + right[q]
            if end - start > q or end - start >= SHORTEST - q:
                of = seen.setdefault(q, [])
                if of and start <= of[-1][1]:
                    of[-1][1] = max(of[-1][1], end)
                else:
                    of.append([start, end])
    for q, of in seen.items():
        for start, end in of:
            cut = (start == max(before - step, 0) and not (opens and start == 0)) or (end + q == n and not closes)
            if (cut or end - start >= max(EXPONENT * q, SHORTEST) - q) and primitive(words[start : start + q]):
                yield q, start - before, end - before


def digest_of(words: list[str]) -> str:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


STAGED = "text string, n_words long, doc string, tiles array<struct<octave: int, at: long, before: int, n: long, words: binary>>"


def tile_column(text: Column) -> Column:
    """Words joined by one space, their number, and for documents that may hold runs a digest and tiles."""

    @F.arrow_udf(f"struct<{STAGED}>")
    def tiled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("octave", pa.int32()), ("at", pa.int64()), ("before", pa.int32()), ("n", pa.int64()), ("words", pa.binary())]))
        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                words = [WORD.findall(t or "") for t in batch.slice(at, TOGETHER).to_pylist()]
                found = tiles_of([numbered(w) for w in words])
                yield pa.StructArray.from_arrays([
                    pa.array([" ".join(w) for w in words], pa.string()),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([digest_of(w) if t else None for w, t in zip(words, found)], pa.string()),
                    pa.array([[{"octave": k, "at": a, "before": b, "n": len(w), "words": x} for k, a, b, x in t] for w, t in zip(words, found)], kind),
                ], names=["text", "n_words", "doc", "tiles"])

    return tiled(text)


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments of each tile."""
    for batch in batches:
        doc, period, start, end = [], [], [], []
        for row in batch.to_pylist():
            tile, low = row["tile"], row["at"] - row["tile"]["before"]
            words = np.frombuffer(tile["words"], np.int32).tolist()
            for q, a, b in fragments(words, tile["before"], row["octave"], low == 0, low + len(words) == tile["n"]):
                doc.append(row["doc"])
                period.append(q)
                start.append(row["at"] + a)
                end.append(row["at"] + b)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.string()), pa.array(period, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=["doc", "period", "start", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """(doc, runs): fragments of one document and period that overlap or touch are one stretch; long ones are runs."""
    along = Window.partitionBy("doc", "period").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    whole = (
        found.distinct().withColumn("reach", reach).withColumn("stretch", apart)
        .groupBy("doc", "period", "stretch").agg(F.min("start").alias("start"), (F.max("end") - F.min("start") + F.col("period")).alias("length"))
        .filter(F.col("length") >= F.greatest(F.col("period") * EXPONENT, F.lit(SHORTEST)))
    )
    return whole.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def collapsed(text: Column, runs: Column) -> Column:
    """The words without those that a run holds after its first period, joined by one space."""

    @F.arrow_udf("string")
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            out = []
            for words, of in zip((t.split(" ") if t else [] for t in texts.to_pylist()), found.to_pylist()):
                edges = np.zeros(len(words) + 1, np.int64)
                for r in of:
                    edges[r["start"] + r["period"]] += 1
                    edges[r["start"] + r["length"]] -= 1
                out.append(" ".join(w for w, inside in zip(words, np.cumsum(edges).tolist()) if not inside))
            yield pa.array(out, pa.string())

    return kept(text, runs)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``runs`` array<struct<start, period, length>>, ``collapsed`` text.

    Runs are in order of start and period, in words from 0. ``collapsed`` has each run's first
    period only, words joined by one space. NULL and empty texts have no words and no runs; NULL
    and repeated ids keep a row each; other columns are not read; an empty table gives an empty
    result.

    Whole texts are named in one scan, without a shuffle. Only tiles that may hold runs are
    shuffled, by (words of the document, octave, tile), where copies meet and one is solved, and
    then fragments of runs. A fragment list grows with its document alone.
    """
    staged = written(docs.select(F.col(id_col).alias("id"), tile_column(F.col(text_col)).alias("found")).select("id", "found.*"), "periodic-tiles", "zstd")
    tiles = staged.filter(F.col("doc").isNotNull()).select("doc", F.explode("tiles").alias("t")).groupBy("doc", "t.octave", "t.at").agg(F.min(F.struct("t.before", "t.n", "t.words")).alias("tile"))
    runs = stitched(tiles.mapInArrow(solve, "doc string, period long, start long, end long"))
    nothing = F.array().cast("array<struct<start: bigint, period: bigint, length: bigint>>")
    plain = staged.filter(F.col("doc").isNull()).select("id", "n_words", nothing.alias("runs"), F.col("text").alias("collapsed"))
    others = staged.filter(F.col("doc").isNotNull()).select("id", "n_words", "doc", "text").join(runs, "doc", "left").withColumn("runs", F.coalesce("runs", nothing))
    others = others.select("id", "n_words", "runs", collapsed(F.col("text"), F.col("runs")).alias("collapsed"))
    return plain.unionByName(others).withColumnRenamed("id", id_col)

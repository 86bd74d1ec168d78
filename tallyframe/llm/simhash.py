"""SimHash near-duplicates, found by the pigeonring.

Fingerprints of 64 bits lie on a ring of five segments. If two differ in at most four bits,
there is a segment from which every run of k consecutive segments differs in at most
k * 4 / 5 bits: none in the first, one in two, two in three, three in four. The first two
budgets make the join key (the second segment may differ by one flipped bit); the other two
prune candidates before the full Hamming check.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import small_batches, spare_name, written
from tallyframe.llm.components import components

#: Words in a shingle, seed of its hash, differing bits of a link.
SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Start and width of the segments; one more than the distance.
SEGMENTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
#: A key with more fingerprints is dense: its members are first linked through pivots.
DENSE, PIVOTS = 64, 8
#: Shingles whose bits are counted at once.
SLICE = 50_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    """SimHash of word shingles, as a signed 64-bit number; zero for a text without words."""
    words = (text or "").encode("utf-8").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    first, last, digest = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + SLICE], last[at : at + SLICE])], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(first), bitorder="little")
    return int(bits.view("<i8")[0])


@F.arrow_udf(T.LongType())
def fingerprint_column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([fingerprint(t) for t in batch.to_pylist()], pa.int64())


def segment(fp: Column, i: int) -> Column:
    start, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def own_key(fp: Column, i: int) -> Column:
    """Number of the starting segment, its bits and the next segment's bits."""
    return F.lit(i << 26).cast("long").bitwiseOR(F.shiftleft(segment(fp, i), 13)).bitwiseOR(segment(fp, i + 1))


def index_keys(fp: Column) -> Column:
    return F.array(*[own_key(fp, i) for i in range(len(SEGMENTS))])


def probe_keys(fp: Column) -> Column:
    """(key, flipped): own keys, and those with one bit of the second segment flipped.

    Of two segments one bit apart exactly one has odd parity; only that side flips.
    """
    found = []
    for i in range(len(SEGMENTS)):
        key, width = own_key(fp, i), SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        flips = F.array(*[F.struct(key.bitwiseXOR(F.lit(1 << j).cast("long")).alias("key"), F.lit(True).alias("flipped")) for j in range(width)])
        own = F.array(F.struct(key.alias("key"), F.lit(False).alias("flipped")))
        odd = F.bit_count(segment(fp, i + 1)) % 2 == 1
        found.append(F.when(odd, F.concat(own, flips)).otherwise(own))
    return F.concat(*found)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def run_masks(length: int) -> Column:
    """For each starting segment the bits of a run of ``length`` segments."""
    masks = []
    for i in range(len(SEGMENTS)):
        ring = [SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(length)]
        masks.append(F.lit(signed(sum(((1 << w) - 1) << s for s, w in ring))).cast("long"))
    return F.array(*masks)


def close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= DISTANCE


def chain(key: Column, a: Column, b: Column) -> Column:
    """The budgets of runs of three and four segments from the key's segment, then the whole ring."""
    at, xor = F.shiftright(key, 26).cast("int"), a.bitwiseXOR(b)
    runs = [F.bit_count(xor.bitwiseAND(F.get(run_masks(k), at))) <= k * DISTANCE // len(SEGMENTS) for k in (3, 4)]
    return runs[0] & runs[1] & close(a, b)


def exploded(prints: DataFrame, keys: Column, *names: str) -> DataFrame:
    return prints.select("fp", "root", F.explode(keys).alias("k")).select("fp", "root", *names)


def meet(probes: DataFrame, index: DataFrame, ordered: bool) -> DataFrame:
    """Links (a, b) between probes and index entries of one key whose roots differ."""
    p, i = probes.alias("p"), index.alias("i")
    a, b = F.col("p.fp"), F.col("i.fp")
    once = F.col("p.flipped") | ((a < b) if ordered else (a != b))
    on = (F.col("p.key") == F.col("i.key")) & (F.col("p.root") != F.col("i.root")) & once & chain(F.col("i.key"), a, b)
    return p.join(i, on).select(F.col("p.root").alias("a"), F.col("i.root").alias("b"))


def linked(prints: DataFrame) -> DataFrame:
    """``(fp, root)`` of distinct fingerprints that have a link; the root is the smallest of the component."""
    base = prints.select("fp", F.col("fp").alias("root"))
    index = exploded(base, index_keys(F.col("fp")), F.col("k").alias("key"))
    pivots = [F.min_by("fp", F.xxhash64("fp", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
    dense = written(
        index.groupBy("key").agg(F.count("*").alias("n"), *pivots).filter(F.col("n") > DENSE)
        .select("key", F.array(*[f"p{j}" for j in range(PIVOTS)]).alias("pivots")), "dense",
    )
    has_dense = not dense.isEmpty()
    first = None
    if has_dense:
        star = index.join(dense, "key").select("fp", F.explode(F.filter("pivots", lambda p: (p != F.col("fp")) & close(p, F.col("fp")))).alias("b"))
        first = components(star.select(F.col("fp").alias("a"), "b"))
        base = written(base.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
        index = exploded(base, index_keys(F.col("fp")), F.col("k").alias("key"))
    probes = exploded(base, probe_keys(F.col("fp")), "k.key", "k.flipped")
    if not has_dense:
        links = meet(probes, index, ordered=True)
    else:
        keys = dense.select("key")
        links = meet(probes.join(keys, "key", "left_anti"), index.join(keys, "key", "left_anti"), ordered=True)
        # in a dense key most members share a root by now: only the others are compared with all
        some_probes = written(probes.join(keys, "key", "left_semi"), "dense-probes")
        some_index = index.join(keys, "key", "left_semi")
        major = some_probes.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
        tagged, entries = some_probes.join(major, "key"), some_index.join(major, "key")
        is_major = F.col("root") == F.col("major")
        links = links.unionByName(meet(tagged.filter(~is_major), entries, ordered=False)).unionByName(meet(tagged.filter(is_major), entries.filter(~is_major), ordered=False))
    second = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
    if first is None:
        return second.select(F.col("root").alias("fp"), F.col("top").alias("root"))
    return base.join(second, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def component_of(prints: DataFrame) -> DataFrame:
    """``(fp, first_id, root, component_id)`` for distinct fingerprints ``(fp, first_id)``; the id is the smallest reachable, NULLs aside."""
    roots = linked(prints)
    rooted = written(prints.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "components")
    tops = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(tops, "root").select("fp", "first_id", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable over links).

    Texts of one fingerprint count once from the start, so copies cost no pairs. NULL texts and
    texts without words have fingerprint zero and link like others. A NULL id keeps its row and
    never names a component unless all its members have none. Repeated rows keep a row each;
    only id and text are read; an empty table gives an empty result. Ids must be of one ordered type.
    """
    small_batches(docs.sparkSession)
    pairs = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    found = component_of(pairs.groupBy("fp").agg(F.min("id").alias("first_id")))
    return pairs.join(found.select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one document of each component: the one with the smallest id, of equal rows one.

    Rows that share the winning id and fingerprint count as repeats of one document; if their texts
    differ, that of the smallest hash stays. A component whose ids are all NULL keeps one row of
    its smallest fingerprint.
    """
    small_batches(docs.sparkSession)
    prints = written(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col)).alias("fp")), "fingerprints")
    found = component_of(prints.groupBy("fp").agg(F.min("id").alias("first_id")))
    best = found.filter(F.col("first_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("fp", "component_id")).alias("w"))
    keep = best.select(F.col("w.fp").alias("kept_fp"), F.col("w.component_id").alias("kept_id"))
    # fingerprints are taken again rather than writing all texts a second time
    fp = spare_name(docs, "fp")
    again = docs.withColumn(fp, fingerprint_column(F.col(text_col)))
    kept = again.join(keep, (again[fp] == keep["kept_fp"]) & again[id_col].eqNullSafe(keep["kept_id"]), "left_semi")
    one = kept.groupBy(id_col, fp).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text_col)).alias(fp + "_row"))
    return one.select(f"{fp}_row.*")

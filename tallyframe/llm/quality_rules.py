"""Quality rules: text statistics and a learned decision list.

Sequential covering learns rules for low quality: a rule grows by threshold conditions of the
best information gain, is pruned on rows kept aside, and the rows it covers leave the table.
Every step is one aggregate over the labelled statistics, of which only counts by statistic
and bin come to the driver. The list is emitted as ordered Spark conditions.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ARROW, doc_remainder, small_batches, written

# Fixed values of the contract.
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that rules may speak of; shares are of the words unless they say otherwise.
FEATURES = [
    "n_words", "mean_chars", "symbol_share", "bang_share", "digit_share", "upper_share", "stutter_share", "distinct_share", "top_share",
    "dup_line_share", "repeat_share", "pipe_share", "words_per_line", "plain_line_share",
]

#: Bins per statistic, conditions per rule, rules, precision and rows that a rule needs on the rows kept aside.
BINS, CONDITIONS, RULES, PRECISION, SUPPORT = 32, 3, 12, 0.95, 5
ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = ids[:n].copy()
    for k in range(1, WINDOW):
        rolled = rolled * ODD + ids[k : k + n]
    ordered = np.sort(rolled)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # equal windows have equal hashes
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    code = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    for step in (1, 2, 4):  # exact names of windows of 2, 4 and 8 words
        code = np.unique((code[:-step] << 32) | code[step:], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """Base counts, then the features, of one text."""
    text = text or ""
    words = text.encode("utf-8").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    some, some_lines = max(n, 1), max(len(lines), 1)
    counts = Counter(words)
    features = (
        float(n), chars / some, symbols / some, text.count("!") / some, sum(map(bytes.isdigit, words)) / some,
        sum(map(bytes.isupper, words)) / some, sum(a == b for a, b in zip(words, words[1:])) / some, len(counts) / some,
        max(counts.values(), default=0) / some, dup_lines / some_lines, repeats / some, text.count("|") / some, n / some_lines,
        sum(x.rstrip(SPACES)[-1:] not in ".!?:;\"'…" for x in lines) / some_lines,
    )
    return n, chars, symbols, dup_lines, repeats, list(features)


def stats_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, base counts, ``features`` array), written to the shared folder: rules are learned and applied on it."""
    small_batches(docs.sparkSession)
    kinds = [ARROW["long"]] * len(BASE) + [pa.list_(pa.float64())]

    @F.arrow_udf("struct<" + ", ".join(f"{c}: bigint" for c in BASE) + ", features: array<double>>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = list(zip(*map(statistics, batch.to_pylist()))) or [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*BASE, "features"])

    return written(docs.select(F.col(id_col).alias("id"), measure(F.col(text_col)).alias("s")).select("id", "s.*"), "statistics")


@dataclass(frozen=True)
class Condition:
    """A statistic at least (``above``) or below a threshold; ``bin`` is the threshold's place."""

    feature: int
    bin: int
    above: bool
    threshold: float

    def holds(self, values: Column, kind: str = "value") -> Column:
        """On an array of statistics, or (``kind="bin"``) of their bins."""
        x, limit = F.get(values, self.feature), self.bin if kind == "bin" else self.threshold
        return x >= limit if self.above else x < limit

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>=' if self.above else '<'} {self.threshold:g}"


Rule = tuple[Condition, ...]


def all_hold(rule: Rule, values: Column, kind: str = "value") -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds(values, kind)
    return out


def gain(p: int, n: int, base: float) -> float:
    """Information gained on p low-quality rows when n others come along."""
    return p * (math.log2(p / (p + n)) - base) if p else 0.0


def best_condition(rows: DataFrame, thresholds: list[list[float]]) -> tuple[Condition | None, int, int]:
    """The condition of the greatest gain on ``rows(bins, bad)``, and the counts of both classes among them."""
    cells = (
        rows.select("bad", F.posexplode("bins").alias("f", "b")).groupBy("f", "b")
        .agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()
    )  # at most statistics x bins rows
    bad = np.zeros((len(FEATURES), BINS + 1), np.int64)
    good = bad.copy()
    for c in cells:
        bad[c["f"], c["b"]], good[c["f"], c["b"]] = c["bad"], c["n"] - c["bad"]
    p, n = int(bad[0].sum()), int(good[0].sum())
    if not p or not n:
        return None, p, n
    base = math.log2(p / (p + n))
    best, chosen = 1e-9, None
    for f, limits in enumerate(thresholds):
        for b, limit in enumerate(limits, start=1):
            for above in (True, False):
                part = slice(b, None) if above else slice(0, b)
                g = gain(int(bad[f, part].sum()), int(good[f, part].sum()), base)
                if g > best:
                    best, chosen = g, Condition(f, b, above, limit)
    return chosen, p, n


def bin_of(value: Column, limits: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in limits]).cast("array<double>"), lambda t: t <= value))


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for low quality from ``(id, features, bad)``, in order; none if nothing can be told apart."""
    cuts = [k / BINS for k in range(1, BINS)]
    picked = labelled.agg(*[F.percentile_approx(F.get("features", f), cuts, 10_000).alias(f"q{f}") for f in range(len(FEATURES))]).first()
    # a statistic that is mostly zero still gets a threshold just above it
    thresholds = [sorted({*(picked[f] or []), *([1e-9] if (picked[f] or [1])[0] == 0 else [])})[:BINS] for f in range(len(FEATURES))]
    bins = F.array(*[bin_of(F.get("features", f), limits) for f, limits in enumerate(thresholds)])
    rows = written(labelled.select("bad", bins.alias("bins"), (F.pmod(F.xxhash64("id", F.lit("aside")), F.lit(3)) == 0).alias("aside")), "rule-rows")
    rules: list[Rule] = []
    left = rows
    while len(rules) < RULES:
        rule: Rule = ()
        grow = left.filter(~F.col("aside"))
        while len(rule) < CONDITIONS:
            condition, _, n = best_condition(grow.filter(all_hold(rule, F.col("bins"), "bin")), thresholds)
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        # prune: the shortest leading part that is best on the rows kept aside
        parts = [rule[:k] for k in range(1, len(rule) + 1)]
        sums = [F.sum(F.when(all_hold(r, F.col("bins"), "bin"), v)).alias(f"{c}{i}") for i, r in enumerate(parts) for c, v in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]
        seen = left.filter("aside").agg(*sums).first()
        worth = [((seen[f"p{i}"] or 0), (seen[f"n{i}"] or 0)) for i in range(len(parts))]
        at = max(range(len(parts)), key=lambda i: ((worth[i][0] - worth[i][1]) / (sum(worth[i]) or 1), worth[i][0], -i))
        p, n = worth[at]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(parts[at])
        left = left.filter(~all_hold(parts[at], F.col("bins"), "bin"))
    return rules


def verdict(rules: list[Rule], features: Column) -> Column:
    """The list as ordered conditions: the text of the first rule that holds, else NULL."""
    out = None
    for rule in rules:
        said = F.lit(" and ".join(map(str, rule)))
        out = F.when(all_hold(rule, features), said) if out is None else out.when(all_hold(rule, features), said)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: id, base counts, ``base_failed``, ``kept``, ``dropped_by`` (the rule's text).

    Rules are learned from all labelled rows whose crc32(id as text) modulo ``folds`` is not 0;
    repeated labels of an id are averaged and rounded, rows with a NULL id or label are not
    learned from. NULL texts have no words and fail the base. Repeated rows keep a row each;
    only id and text are read. Without labels only the base decides; empty tables are fine.
    """
    stats = stats_table(docs, id_col, text_col)
    marks = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
        .filter(doc_remainder(F.col("id"), folds) != 0).groupBy("id").agg((F.avg("y") < 0.5).cast("int").alias("bad"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rules = learn(stats.filter(~failed).join(marks, "id").select("id", "features", "bad"))
    out = stats.withColumn("base_failed", failed).withColumn("dropped_by", verdict(rules, F.col("features")))
    return out.select(F.col("id").alias(id_col), *BASE, "base_failed", (~F.col("base_failed") & F.col("dropped_by").isNull()).alias("kept"), "dropped_by")

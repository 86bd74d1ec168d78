"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's features are its words, word pairs and triples, each once as written and once by
outline (letter case, attached signs, length), hashed into a fixed number of weights. A value
is the share of the text's n-grams. Workers train on shards of a bounded sample of labelled
rows; the shard weights are averaged. A score is one sparse dot product.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import doc_remainder, kept_by_worker, small_batches
from tallyframe.llm.word_bpe import Remembered

#: Weights of a model: 2 ** BITS, 1 MB as float32.
BITS = 18
#: Labelled rows that training reads at most, and about how many make a shard.
MAX_ROWS, SHARD_ROWS = 16_000, 1_000
#: Passes over a shard, and the constants of the learner.
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.02, 0.05
#: Words that a worker remembers the hashes of.
REMEMBERED = 100_000
#: Scale of the features: a text's shares sum to this in each of the two kinds.
SCALE = 12.0

MIX = np.uint64(0x9E3779B97F4A7C15)
SIGNS = re.compile(r"[^\w]+")


def outline(word: str) -> str:
    """Case, signs (as written, runs shortened) and length class of a word."""
    letters = SIGNS.sub("", word)
    case = "0" if not letters else "d" if letters.isdigit() else "U" if len(letters) > 1 and letters.isupper() else "u" if letters[0].isupper() else "l"
    return f"{case}{min(len(letters), 16) // 4}{''.join(SIGNS.findall(word))[:4]}"


def hash_word(word: str) -> int:
    """Hash of the word as written in the upper half, of its outline in the lower."""
    return zlib.crc32(word.encode("utf-8")) << 32 | zlib.crc32(outline(word).encode("utf-8"))


def hasher():
    """A remembered ``hash_word``."""
    return Remembered(hash_word, REMEMBERED).__getitem__


def features(text: str, get) -> tuple[np.ndarray, float]:
    """Weight positions of all n-grams, repeats included, and the value that each adds."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), 0.0
    both = np.fromiter(map(get, words), np.uint64, n)
    found = []
    for kind, ids in enumerate((both >> np.uint64(32), both & np.uint64(0xFFFFFFFF))):
        gram = ids + np.uint64(kind + 1)
        found.append(gram * MIX)
        for k in (1, 2):
            if n > k:
                gram = gram[:-1] * MIX + ids[k:] + np.uint64(1)
                found.append(gram * MIX)
    at = np.concatenate(found) >> np.uint64(64 - BITS)
    return at.astype(np.int64), SCALE / max(len(at), 1) * 2


def sparse(at: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct positions and their values, 8 bytes each."""
    distinct, counts = np.unique(at.astype(np.int32), return_counts=True)
    return distinct, (counts * value).astype(np.float32)


def probability(margin: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))))


def train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """FTRL-Proximal over the rows in the given order; weights and bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, seen = 0.0, 0.0
    get = shared_hasher()
    rows = [sparse(*features(t, get)) for t in texts]
    for _ in range(EPOCHS):
        for (at, x), label in zip(rows, labels):
            w = weights_of(z[at], n[at])
            g = probability(w @ x + bias) - label
            seen += g * g
            bias -= g * ALPHA * 0.3 / (BETA + seen ** 0.5)
            gx = g * x
            z[at] += gx - (np.sqrt(n[at] + gx * gx) - np.sqrt(n[at])) / ALPHA * w
            n[at] += gx * gx
    return weights_of(z, n).astype(np.float32), bias


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights from the leader's state."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


class Model:
    """Averaged weights and bias; ``column`` scores a text column."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def column(self, docs: DataFrame, text: Column) -> Column:
        """Score from 0 to 1; NULL and empty texts get the score of the bias alone."""
        sent = small_batches(docs.sparkSession).sparkContext.broadcast((self.weights, self.bias))

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            (weights, bias), get = sent.value, shared_hasher()
            for batch in batches:
                out = []
                for text in batch.to_pylist():
                    at, value = features(text or "", get)
                    out.append(probability(float(weights[at].sum(dtype=np.float64)) * value + bias))
                yield pa.array(out, pa.float64())

        return score(text)


def shared_hasher():
    """The worker's remembered hashes."""
    return kept_by_worker(("hasher",), hasher)


def labelled_sample(docs: DataFrame, labels: DataFrame, keep: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(shard, place, text, label) of at most ``MAX_ROWS`` ids, those of the smallest id hashes.

    Repeated labels of an id are averaged and rounded, NULL ids and labels left out; of
    repeated documents the smallest text stands for the id.
    """
    ids = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
        .filter(keep).groupBy("id").agg(F.avg("label").alias("label"))
        .select("id", (F.col("label") >= 0.5).cast("int").alias("label"), F.xxhash64("id").alias("place"))
        .orderBy("place", "id").limit(MAX_ROWS)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = -(-ids.count() // SHARD_ROWS) or 1
    # the ids are at most MAX_ROWS rows of three numbers
    rows = texts.join(F.broadcast(ids), "id").groupBy("id", "label", "place").agg(F.min("text").alias("text"))
    return rows.select(F.pmod("place", F.lit(shards)).cast("int").alias("shard"), "place", F.coalesce("text", F.lit("")).alias("text"), "label")


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Train on the labelled rows whose ``id`` satisfies ``keep`` (a condition on the column ``id``).

    Reads at most ``MAX_ROWS`` labelled texts, whole; each shard is trained in its
    own task in hash order, so the model depends on the rows alone. Only shard weights (1 MB
    each) come to the driver. Without labelled rows all scores are 0.5.
    """
    sample = labelled_sample(docs, labels, F.lit(True) if keep is None else keep, id_col, text_col, label_col)

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        weights, bias = train(rows["text"].to_pylist(), rows["label"].to_pylist())
        return pa.table({"rows": [rows.num_rows], "bias": [bias], "weights": [weights.tobytes()]})

    trained = sample.groupBy("shard").applyInArrow(shard, "rows long, bias double, weights binary").collect()
    total = sum(r["rows"] for r in trained)
    if not total:
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    trained.sort(key=lambda r: r["weights"])
    weights = sum(np.frombuffer(r["weights"], np.float32).astype(np.float64) * (r["rows"] / total) for r in trained)
    return Model(weights.astype(np.float32), sum(r["bias"] * r["rows"] / total for r in trained))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``.

    Rows whose crc32(id as text) modulo ``folds`` is 0 are held out of training; a NULL id
    counts as held out. NULL texts count as empty. Only id and text of ``docs`` are read, and
    only text enters a score. Repeated rows keep a row each; empty tables are fine.
    """
    model = fit(docs, labels, doc_remainder(F.col("id"), folds) != 0, id_col, text_col)
    held_out = F.coalesce(doc_remainder(F.col(id_col), folds) == 0, F.lit(True))
    scored = docs.select(F.col(id_col), held_out.alias("held_out"), model.column(docs, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

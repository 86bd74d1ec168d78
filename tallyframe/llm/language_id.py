"""Language identification by interpolated Kneser-Ney character models.

Words of letters are padded at the front and closed by an end sign, so each character has one
n-gram of the full order; the lower orders of a model follow from the distinct n-grams above.
Discounts, continuation counts and back-off weights are Spark aggregates over all training
texts. A model is the values of exact n-grams and contexts, in sorted arrays of each language; one
too large for a worker stays a table, and is joined with the n-grams of the distinct words.

Characters are UTF-16 units, 16 bits each: a letter beyond U+FFFF is two of them, neither of which
is any other letter or a sign, so n-grams stay exact for all of Unicode.
"""

import itertools
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import doc_remainder, kept_by_worker, small_batches, spare_name, written

ORDER = 4
#: n-grams and contexts of a model that workers hold whole; ``identify`` joins a larger one. Only ``train``, which makes
#: a model of bounded size, moves the rarest n-grams beyond a language's and order's equal part into the back-off mass.
MOST = 1 << 24
#: Signs before and after a word.
START, END = "\x01", "\x02"


def mark_ranges() -> str:
    """All combining marks, as ranges of a character class."""
    marks = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M")
    runs = ([c for _, c in run] for _, run in itertools.groupby(enumerate(marks), lambda x: x[1] - x[0]))
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


#: A letter with the letters and marks that follow it.
WORD = re.compile(rf"[^\W\d_]+(?:[{mark_ranges()}][^\W\d_]*)*")
#: Distinct words that a task counts before it hands on their n-grams, and words that a worker remembers the scores of.
FLUSH, REMEMBERED = 200_000, 200_000
#: Texts whose new words are scored together.
TOGETHER = 256
#: Share of the training texts of a language whose cross-entropy is accepted; characters beyond which a text is no surer.
ACCEPT, SURE = 0.999, 40


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters with their marks; empty if the text has no letter."""
    words = WORD.findall((text or "").lower())
    if not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
        return []
    return words


def units(word: str) -> int:
    """16-bit units of a word."""
    return len(word) if word.isascii() else len(word.encode("utf-16-le")) // 2


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (16 bits a character) of all characters and end signs, and the word that each belongs to."""
    joined = "".join([f"{START * (ORDER - 1)}{w}{END}" for w in words])
    codes = np.frombuffer(joined.encode("utf-16-le"), np.uint16).astype(np.uint64)
    packed = codes.copy()
    for k in range(1, ORDER):
        packed[k:] |= codes[:-k] << np.uint64(16 * k)
    own = codes != np.uint64(ord(START))
    of_word = np.repeat(np.arange(len(words)), [units(w) + 1 for w in words]) if words else np.zeros(0, np.int64)
    return packed[own], of_word


def fold(x):
    """Key of a packed n-gram in a model: all of its bits, signed as Spark has them."""
    return x if isinstance(x, Column) else x.view(np.int64)


def counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, g, n): counts of packed full-order n-grams over all texts; tasks sum before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                packed, of_word = grams(list(words))
                if not len(packed):
                    continue
                found, place = np.unique(packed, return_inverse=True)
                n = np.bincount(place, np.fromiter(words.values(), np.int64, len(words))[of_word]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.view(np.int64)), pa.array(n)], names=["lang", "g", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                held[lang].update(words_in(text))
                if sum(map(len, held.values())) > FLUSH:
                    yield from handed_on()
        yield from handed_on()

    parts = docs.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(count, "lang string, g long, n long")
    return parts.groupBy("lang", "g").agg(F.sum("n").alias("n"))


def model_rows(full: DataFrame, most: int | None = None) -> DataFrame:
    """(lang, k, part, h, v): by order and key, the discounted probability of an n-gram ("gram") and the back-off weight of a context ("context").

    All n-grams are kept, unless ``most`` is given: then a language with more n-grams of an order than
    its part of these keeps those of the counts above the least threshold that leaves so many; the
    probability of the others goes to the back-off weight of their context, so the sum stays one. A
    context without any kept n-gram backs off wholly, as an unknown one does.
    """
    out, level = None, full
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts: distinct n-grams one longer that end so
            cut = F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long"))
            level = level.select("lang", cut.alias("g")).groupBy("lang", "g").agg(F.count("*").alias("n"))
        level = written(level, f"order-{k}")
        ones, twos = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
        discount = level.groupBy("lang").agg(F.least(F.greatest(F.coalesce(F.try_divide(ones, ones + 2 * twos), F.lit(0.5)), F.lit(0.1)), F.lit(0.9)).alias("d"))
        tagged = level.withColumn("context", F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long"))
        least = {} if most is None else rarest_kept(level, most)
        kept = F.col("n") >= F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("lang")), F.lit(0)) if least else F.lit(True)
        contexts = (
            tagged.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.count_if(kept).alias("kept"), F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("dropped"))
            .filter("kept > 0").join(discount, "lang")
        )
        own = tagged.filter(kept).join(contexts, ["lang", "context"])
        for part, rows, key, value in (
            (0, own, "g", (F.col("n") - F.col("d")) / F.col("total")), (1, contexts, "context", (F.col("d") * F.col("kept") + F.col("dropped")) / F.col("total")),
        ):
            found = rows.select("lang", F.lit(k).cast("byte").alias("k"), F.lit(part).cast("byte").alias("part"), fold(F.col(key)).alias("h"), value.cast("float").alias("v"))
            out = found if out is None else out.unionByName(found)
    return out


def rarest_kept(level: DataFrame, most: int) -> dict[str, int]:
    """Least count of an n-gram that is kept, of each language with more n-grams than its part of ``most``."""
    sizes = {r["lang"]: r["size"] for r in level.groupBy("lang").agg(F.count("*").alias("size")).collect()}
    most //= ORDER * max(len(sizes), 1)
    large = [lang for lang, size in sizes.items() if size > most]
    if not large:
        return {}
    # of all n-grams in order of their counts; a row per distinct count
    counts = level.filter(F.col("lang").isin(large)).groupBy("lang", "n").agg(F.count("*").alias("size"))
    above = F.sum("size").over(Window.partitionBy("lang").orderBy(F.desc("n")))
    held = {r["lang"]: r["n"] for r in counts.select("lang", "n", above.alias("above")).filter(F.col("above") <= most).groupBy("lang").agg(F.min("n").alias("n")).collect()}
    top = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.max("n").alias("n")).collect()}
    return {lang: held.get(lang, top[lang] + 1) for lang in large}


class Model:
    """Sorted arrays of keys and values per language, order and part."""

    def __init__(self, rows: pa.Table, langs: list[str]):
        self.langs = langs
        lang, k, part, h, v = (rows[c].to_numpy() for c in ("lang", "k", "part", "h", "v"))
        self.arrays = {}
        for order in range(1, ORDER + 1):
            for number, name in enumerate(("gram", "context")):
                for i in range(len(langs)):
                    here = (k == order) & (part == number) & (lang == i)
                    by_key = np.argsort(h[here])
                    self.arrays[order, name, i] = (h[here][by_key], v[here][by_key])

    def look_up(self, order: int, name: str, keys: np.ndarray) -> np.ndarray:
        out = np.full((len(keys), len(self.langs)), 0.0 if name == "gram" else 1.0, np.float32)
        for i in range(len(self.langs)):
            known, values = self.arrays[order, name, i]
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                out[hit, i] = values[at[hit]]
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        packed, of_word = grams(words)
        found, place = np.unique(packed, return_inverse=True)
        p = np.full((len(found), len(self.langs)), 1.0 / 65536, np.float32)
        for k in range(1, ORDER + 1):
            own = found & np.uint64((1 << 16 * k) - 1) if k < 4 else found
            context = own >> np.uint64(16)
            p = self.look_up(k, "gram", fold(own)) + self.look_up(k, "context", fold(context)) * p
        logs = np.log(np.maximum(p, 1e-12))[place]
        ends = np.cumsum([units(w) + 1 for w in words])
        return np.add.reduceat(logs, np.concatenate(([0], ends[:-1])), axis=0) if words else np.zeros((0, len(self.langs)), np.float32)


class Scorer:
    """A model with the remembered scores of recent words."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def score(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, cross-entropy per character) of each text."""
        out = []
        for at in range(0, len(texts), TOGETHER):
            split = [words_in(t) for t in texts[at : at + TOGETHER]]
            if len(self.place) > REMEMBERED:
                self.place, self.table = {}, self.table[:0]
            if new := list(dict.fromkeys(w for words in split for w in words if w not in self.place)):
                self.grow(new)
            out += map(self.best, split)
        return out

    def best(self, words: list[str]) -> tuple[str, float, float | None]:
        langs = self.model.langs
        if not words or not langs:
            return "und", 0.0, None
        n = sum(map(units, words)) + len(words)
        entropy = -self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64) / n
        first = int(entropy.argmin())
        weights = np.exp((entropy[first] - entropy) * min(n, SURE))
        return langs[first], float(1.0 / weights.sum()), float(entropy[first])

    def grow(self, new: list[str]) -> None:
        size = len(self.place)
        if size + len(new) > len(self.table):
            wider = np.zeros((max(2 * (size + len(new)), 4096), len(self.model.langs)), np.float32)
            wider[:size] = self.table[:size]
            self.table = wider
        self.table[size : size + len(new)] = self.model.word_scores(new)
        self.place.update(zip(new, range(size, size + len(new))))


def learned(docs: DataFrame, text_col: str, lang_col: str, most: int | None = None) -> tuple[DataFrame, list[str]]:
    """The rows of a model with a number for the language, and the languages by number."""
    small_batches(docs.sparkSession)
    full = written(counted(docs.filter(F.col(lang_col).isNotNull()), text_col, lang_col), "order-full")
    langs = sorted(r["lang"] for r in full.select("lang").distinct().collect())
    numbers = F.create_map(*[F.lit(x) for pair in zip(langs, range(len(langs))) for x in pair]) if langs else None
    return model_rows(full, most).withColumn("lang", (numbers[F.col("lang")] if langs else F.lit(0)).cast("int")), langs


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of bounded size from all rows with a language; at most ``MOST`` n-grams and as many contexts come to the driver, as numbers."""
    rows, langs = learned(docs, text_col, lang_col, MOST)
    return Model(rows.toArrow(), langs)


def scored_by_worker(docs: DataFrame, rows: DataFrame, langs: list[str], text_col: str) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``cross_entropy`` in place of the text, by a model that each worker holds."""
    model = Model(rows.toArrow(), langs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, cross_entropy: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        scorer = kept_by_worker(("scorer", model), lambda: Scorer(model))
        for batch in batches:
            rows = scorer.score(batch.to_pylist())
            langs, scores, entropies = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(entropies, pa.float64())], names=["lang_pred", "score", "cross_entropy"])

    return docs.withColumn("p", predict(F.col(text_col))).select(*[c for c in docs.columns if c != text_col], "p.*")


def log_probabilities(grams_needed: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(g, logs): the log probability of each full-order n-gram in each of ``size`` languages, by joins with the model order by order."""

    def by_key(k: int, part: int, key: str, value: str, unknown: float) -> DataFrame:
        of = rows.filter((F.col("k") == k) & (F.col("part") == part)).groupBy(F.col("h").alias(key))
        return of.agg(F.array(*[F.coalesce(F.max(F.when(F.col("lang") == i, F.col("v"))), F.lit(unknown)).cast("double") for i in range(size)]).alias(value))

    def every(value: float) -> Column:
        return F.array_repeat(F.lit(value).cast("double"), size)

    def lowest(k: int, g: str = "g") -> Column:
        return F.col(g).bitwiseAND(F.lit((1 << 16 * k) - 1).cast("long")) if k < ORDER else F.col(g)

    below = None
    for k in range(1, ORDER + 1):
        own = grams_needed.select(lowest(k).alias("g")).distinct()
        own = own.withColumn("context", F.shiftrightunsigned("g", 16) if k > 1 else F.lit(0).cast("long"))
        found = own.join(by_key(k, 0, "g", "p", 0.0), "g", "left").join(by_key(k, 1, "context", "back", 1.0), "context", "left")
        found = found.withColumn("lower", every(1.0 / 65536)) if below is None else found.withColumn("end", lowest(k - 1)).join(below, "end")
        weighed = F.zip_with(F.coalesce("back", every(1.0)), "lower", lambda x, y: x * y)
        below = found.select(F.col("g").alias("end"), F.zip_with(F.coalesce("p", every(0.0)), weighed, lambda x, y: x + y).alias("lower"))
        below = written(below, f"scores-{k}")
    return below.select(F.col("end").alias("g"), F.transform("lower", lambda p: F.log(F.greatest(p, F.lit(1e-12)))).alias("logs"))


def scored_by_join(docs: DataFrame, rows: DataFrame, langs: list[str], text_col: str) -> DataFrame:
    """As ``scored_by_worker``, for a model of any size: n-grams of distinct words are joined with it, and words with their sums."""
    size = len(langs)

    @F.arrow_udf("struct<n: bigint, words: array<struct<word: string, times: bigint>>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())]))
        for batch in batches:
            found = [words_in(text) for text in batch.to_pylist()]
            n = [sum(map(units, words)) + len(words) for words in found]
            counts = [[{"word": w, "times": t} for w, t in Counter(words).items()] for words in found]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(counts, kind)], names=["n", "words"])

    @F.arrow_udf("array<bigint>")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([grams([w])[0].view(np.int64) for w in batch.to_pylist()], pa.list_(pa.int64()))

    def summed(values: str, times: Column | int) -> Column:
        return F.array(*[F.sum(F.element_at(values, i + 1) * times) for i in range(size)]).alias(values)

    # written, so that the number of a row stays the same
    number, of = spare_name(docs, "row"), spare_name(docs, "words")
    numbered = written(docs.withColumn(of, cut(F.col(text_col))).drop(text_col).withColumn(number, F.monotonically_increasing_id()), "words")
    tokens = numbered.select(F.col(number).alias("row"), F.explode(F.col(of)["words"]).alias("w")).select("row", "w.*")
    parts = written(tokens.select("word").distinct().select("word", F.explode(packed("word")).alias("g")), "word-grams")
    words = parts.join(log_probabilities(parts, rows, size), "g").groupBy("word").agg(summed("logs", 1))
    sums = tokens.join(words, "word").groupBy("row").agg(summed("logs", F.col("times"))).select(F.col("row").alias(number), F.col("logs").alias("sums_"))
    entropies = F.transform("sums_", lambda x: -x / F.col(of)["n"])
    least = F.array_min("e_")
    weights = F.aggregate("e_", F.lit(0.0), lambda total, e: total + F.exp((least - e) * F.least(F.col(of)["n"], F.lit(SURE))))
    return numbered.join(sums, number, "left").withColumn("e_", entropies).select(
        *[c for c in docs.columns if c != text_col],
        F.when(F.col("e_").isNull(), "und").otherwise(F.element_at(F.array(*map(F.lit, langs)), F.array_position("e_", least).cast("int"))).alias("lang_pred"),
        F.coalesce(1 / weights, F.lit(0.0)).alias("score"), least.alias("cross_entropy"),
    )


def identify(docs: DataFrame, folds: int = 3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy``, ``accepted``.

    Trained on rows with a language whose crc32(id as text) modulo ``folds`` is not 1; a NULL id
    is held out. ``lang_pred`` is the language of the lowest cross-entropy per character (ties:
    first by name), ``und`` with score 0 if the text is NULL or has no letter, or nothing was
    learned. ``accepted`` is false where the cross-entropy exceeds what ``ACCEPT`` of the
    training texts of that language stay below. Every n-gram of the training texts counts: a model of
    more than ``MOST`` values is joined as a table instead of sent to the workers. Only id, text and language are read; repeated
    rows keep a row each; an empty table gives an empty result.
    """
    remainder = doc_remainder(F.col(id_col), folds)
    rows, langs = learned(docs.filter(remainder != 1), text_col, lang_col)
    rows = written(rows, "model")
    score = scored_by_join if langs and rows.count() > MOST else scored_by_worker
    text = spare_name(docs.select(id_col), "text_")
    texts = docs.select(
        F.col(id_col), F.coalesce(remainder == 1, F.lit(True)).alias("held_out"), F.col(lang_col).cast("string").alias("true_lang"), F.col(text_col).alias(text),
    )
    scored = written(score(texts, rows, langs, text), "languages")
    limits = (
        scored.filter(~F.col("held_out") & (F.col("true_lang") == F.col("lang_pred")))
        .groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", ACCEPT, 10_000).alias("limit"))
    )
    return scored.join(F.broadcast(limits), "lang_pred", "left").select(  # a row per language
        id_col, "held_out", "lang_pred", "score", "cross_entropy", F.coalesce(F.col("cross_entropy") <= F.col("limit"), F.lit(False)).alias("accepted"),
    )

"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that can be a pre-token is put through the merges once; those
that come out as a single token are proven. In the tasks a pre-token in the proven set counts
one, and only the rest is merged. Nothing is shuffled: a count needs its own text alone.
"""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import kept_by_worker, small_batches, struct_udf
from tallyframe.llm.word_bpe import WORD_END, Remembered, Rules, chunks, load, rules

#: Chunks that a worker remembers (about 100 bytes each).
REMEMBERED = 400_000


@functools.lru_cache(maxsize=4)
def proven_single(source: str) -> tuple[str, ...]:
    """Pre-tokens in byte symbols that the merges turn into one token, from the vocabulary alone."""
    r = rules(source)
    words = [t[: -len(WORD_END)] for t in r.ids if t.endswith(WORD_END) and t != WORD_END]
    return tuple(w for w in words if len(r.tokens(w)) == 1)


def counter(source: str, single: frozenset[str]):
    """The function from a text to its number of tokens."""
    r = Rules(source)
    rest = Remembered(lambda word: len(r.tokens(word)), REMEMBERED)

    def of_chunk(chunk: str) -> int:
        return sum(1 if word in single else rest[word] for word in r.pretokens(chunk))

    known = Remembered(of_chunk, REMEMBERED)
    get = known.__getitem__

    def count(text: str) -> int:
        return sum(1 if part in r.specials else sum(map(get, chunks(part))) for part in r.segments(text))

    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``, as the tokenizer counts.

    ``vocabulary`` is the path of the vocabulary file on the driver; its text (a few MB, the
    file's own size) is sent to the workers. NULL texts count as empty: 0 bytes, 0 tokens.
    NULL and repeated ids keep a row each. Other columns are not read, so their names cannot
    clash. An empty table gives an empty result.
    """
    source = load(vocabulary)
    sent = small_batches(docs.sparkSession).sparkContext.broadcast((source, proven_single(source)))

    def per_text():
        source, single = sent.value
        count = kept_by_worker(("counter", source), lambda: counter(source, frozenset(single)))
        return lambda text: (len(text.encode("utf-8")), count(text))

    counts = struct_udf(per_text, [("n_bytes", "long"), ("n_tokens", "long")], "struct<n_bytes: bigint, n_tokens: bigint>")
    out = docs.select(F.col(id_col), counts(F.col(text_col)).alias("counts"))
    return out.select(id_col, "counts.n_bytes", "counts.n_tokens", (F.col("counts.n_tokens") > limit).alias("over_limit"))

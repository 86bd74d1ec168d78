"""Personal data by weak supervision.

Fixed patterns give the base spans. Around them, looser candidates are voted on by labelers
that look at form, word lists and context, each of which may abstain. Votes and features of a
candidate are discrete and packed into one code, so counts by code are all that learning needs:
expectation-maximisation estimates each labeler's reliability from how votes fall together,
and a logistic span classifier is trained on the resulting probabilities. It decides by code.
"""

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import small_batches, written

# Fixed values of the contract.
BASE_KINDS = ["email", "ip", "card", "phone"]
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Kinds that only the method adds: long random-looking strings and number groups.
KINDS = [*BASE_KINDS, "secret", "number"]
SECRET = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
NUMBER = re.compile(r"(?<![0-9])[0-9](?:[ .()-]{0,2}[0-9]){6,}+")
DATE = re.compile(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}\Z|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}\Z")
GROUPED = re.compile(r"\+?[0-9]{0,3} ?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\Z|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}\Z|[0-9]{3}-[0-9]{2}-[0-9]{4}\Z")

#: Words before a candidate that speak for personal data, by theme, and words that speak against it.
CONTACT = frozenset("email mail e-mail contact phone tel telephone fax mobile cell call ip host address addr".split())
FINANCE = frozenset("card visa mastercard amex account iban bank payment ssn passport licence license".split())
SECRETS = frozenset("token key secret password passwd pwd api apikey api_key bearer auth credential session".split())
PUBLIC = frozenset("isbn issn doi version v sha commit page pages chapter section figure table no price total sum".split())
WORD = re.compile(r"[A-Za-z_-]+")
#: Characters before a candidate that are searched for such words.
REACH = 24

LABELERS = ["form", "checksum", "theme", "public", "assigned", "random", "alone", "grouped"]
ABSTAIN, NO, YES = 0, 1, 2
#: What is believed of a labeler beforehand, and the weight of that belief.
BELIEF, ANCHOR = 0.8, 0.5
LENGTHS = [8, 12, 16, 24]  # bounds of the length classes
RADICES = [len(KINDS), *[3] * len(LABELERS), len(LENGTHS) + 1, 3, 4]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether digits, of any length, make a number of at most 255."""
    bare = part.lstrip("0") or "0"
    return len(bare) <= 3 and int(bare) <= 255


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs cost no more than their length."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last))
        else:
            last = max(last, at)  # nothing before this @ can match any more
        at = text.find("@", at + 1)
    return found


def base_forms(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, passes) of every match of the four patterns, in order."""
    out = [(a, 0, b, True) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            out.append((m.start(), 1, m.end(), all(small(p) for p in m.group().split("."))))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = digits_of(m.group())
                if len(d) >= 12:
                    out.append((m.start(), 2, m.end(), len(d) <= 19 and luhn(d)))
        if "+" in text:
            for m in PHONE.finditer(text):
                out.append((m.start(), 3, m.end(), 9 <= len(digits_of(m.group())) <= 15))
    out.sort()
    return out


def candidates(text: str, forms: list) -> list[tuple[int, int, int, bool]]:
    """Failed base forms, then secrets, then number groups, as far as they overlap nothing chosen before."""
    chosen = [f for f in forms if f[3]]
    loose = [f for f in forms if not f[3]]
    if DIGIT.search(text):
        loose += [(m.start(), 4, m.end(), False) for m in SECRET.finditer(text) if DIGIT.search(m.group())]
        loose += [(m.start(), 5, m.end(), False) for m in NUMBER.finditer(text)]
    taken = sorted((a, b) for a, _, b, _ in chosen)
    if loose:
        # sweep in order; of overlapping loose candidates the earlier and then the longer stays
        loose.sort(key=lambda c: (c[0], -c[2], c[1]))
        last = 0
        starts = [a for a, _ in taken]
        reach = []  # running furthest end of base spans
        for a, b in taken:
            reach.append(max(b, reach[-1] if reach else 0))
        for c in loose:
            at = bisect_left(starts, c[2])  # base spans that start before the candidate's own end
            if c[0] >= last and not (at and reach[at - 1] > c[0]):
                chosen.append(c)
                last = c[2]
    return chosen


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def code_of(text: str, start: int, kind: int, end: int, passes: bool) -> int:
    """Kind, votes and features of a candidate, packed."""
    span = text[start:end]
    before = WORD.findall(text[max(0, start - REACH) : start].lower())[-3:]
    theme = next((i for i, words in enumerate((CONTACT, FINANCE, SECRETS), 1) if any(w in words for w in before)), 0)
    digits = digits_of(span)
    mixed = entropy(span)
    left, right = text[start - 1 : start] if start else " ", text[end : end + 1] or " "
    votes = [
        YES if passes else NO if kind < len(BASE_KINDS) else ABSTAIN,
        ABSTAIN if len(digits) < 12 or len(digits) < len(span) // 2 else YES if len(digits) <= 19 and luhn(digits) else NO,
        YES if theme else ABSTAIN,
        NO if any(w in PUBLIC for w in before) or DATE.match(span) else ABSTAIN,
        YES if left in "\"'" and text[max(0, start - 8) : start - 1].rstrip(" ")[-1:] in ("=", ":") else ABSTAIN,
        YES if kind == 4 and mixed > 3 else NO if len(set(span)) <= 2 else ABSTAIN,
        NO if left.isalnum() or right.isalnum() else YES,
        YES if GROUPED.match(span) else ABSTAIN,
    ]
    parts = [kind, *votes, sum(len(span) >= x for x in LENGTHS), 0 if mixed < 2 else 1 if mixed < 3.2 else 2, theme]
    code = 0
    for value, radix in zip(parts, RADICES):
        code = code * radix + value
    return code


def unpack(codes: list[int]) -> np.ndarray:
    """One row of parts per code."""
    rows = []
    for code in codes:
        parts = []
        for radix in reversed(RADICES):
            code, value = divmod(code, radix)
            parts.append(value)
        rows.append(parts[::-1])
    return np.array(rows, int).reshape(len(rows), len(RADICES))


def reliabilities(parts: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over two classes: P(vote | class) for each labeler, and each code's probability of personal data.

    The prior is one per kind. It starts from the majority of votes. Each labeler is believed to
    be right ``BELIEF`` of the time where it votes, with the weight of ``ANCHOR`` of all
    candidates, which keeps the classes from changing their meaning.
    """
    votes, kinds = parts[:, 1 : 1 + len(LABELERS)], parts[:, 0]
    shown = np.stack([votes == v for v in (ABSTAIN, NO, YES)], axis=2).astype(float)  # code x labeler x vote
    post = 1 / (1 + np.exp((votes == NO).sum(1) - (votes == YES).sum(1)))
    share = np.einsum("n,nlv->lv", counts, shown)
    voted = share[:, NO] + share[:, YES]
    anchor = ANCHOR * np.stack([np.stack([share[:, ABSTAIN], voted * no, voted * (1 - no)], axis=1) for no in (BELIEF, 1 - BELIEF)])
    for _ in range(rounds):
        both = np.stack([1 - post, post])  # class x code
        table = np.einsum("cn,n,nlv->clv", both, counts, shown) + anchor + 1
        table /= table.sum(2, keepdims=True)
        prior = np.array([[(counts * b)[kinds == k].sum() + 1 for k in range(len(KINDS))] for b in both])
        prior /= prior.sum(0)
        log = np.einsum("nlv,clv->cn", shown, np.log(table)) + np.log(prior)[:, kinds]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return table, post


def one_hot(parts: np.ndarray) -> np.ndarray:
    """Indicator features of every part, and a constant."""
    columns = [(parts[:, [i]] == np.arange(radix)) for i, radix in enumerate(RADICES)]
    return np.concatenate([*columns, np.ones((len(parts), 1), bool)], axis=1).astype(float)


def span_classifier(parts: np.ndarray, counts: np.ndarray, target: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps over the counted codes."""
    x, w = one_hot(parts), np.zeros(sum(RADICES) + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (target - p)) - ridge * w
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def accepted(counted: list[tuple[int, int]], threshold: float = 0.5) -> list[int]:
    """Codes that the trained classifier takes for personal data."""
    if not counted:
        return []
    counted = sorted(counted)
    codes, counts = [c for c, _ in counted], np.array([n for _, n in counted], float)
    parts = unpack(codes)
    weights = span_classifier(parts, counts, reliabilities(parts, counts)[1])
    scores = one_hot(parts) @ weights
    return [c for c, s in zip(codes, scores) if 1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) >= threshold]


SPAN = "struct<kind: int, start: int, end: int, base: boolean, code: bigint>"
SPAN_ARROW = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int64())])


def spans_of(text: str | None) -> list[dict]:
    """Base spans and candidates of a text, by start and kind."""
    text = text or ""
    if not DIGIT.search(text) and "@" not in text:
        return []
    found = candidates(text, base_forms(text))
    found.sort()
    return [{"kind": k, "start": a, "end": b, "base": ok, "code": code_of(text, a, k, b, ok)} for a, k, b, ok in found]


def span_column(text: Column) -> Column:
    """Base spans and candidates, each with its code."""

    @F.arrow_udf(f"array<{SPAN}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([spans_of(t) for t in batch.to_pylist()], pa.list_(SPAN_ARROW))

    return find(text)


def accepted_codes(spans: DataFrame, name: str) -> list[int]:
    """Codes of column ``name`` that count as personal data, from counts over all rows; one count per code comes to the driver."""
    counted = spans.select(F.explode(F.col(name)["code"]).alias("code")).groupBy("code").count().collect()
    return accepted([(r["code"], r["count"]) for r in counted])


def decided(staged: DataFrame, name: str) -> DataFrame:
    """The written table with only the spans that stay in column ``name``: all base spans, and those the classifier adds."""
    keep = F.array(*[F.lit(c) for c in accepted_codes(staged, name)]).cast("array<bigint>")
    return staged.withColumn(name, F.filter(name, lambda s: s["base"] | F.array_contains(keep, s["code"])))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``found`` array<kind, start, end, base, code>, ``described`` text of all spans.

    Offsets are code points, ends exclusive. NULL texts count as empty and have no spans.
    Repeated rows and NULL ids keep a row each; only id and text are read, and an empty table
    gives an empty result. An added span never overlaps a base span.
    """
    small_batches(docs.sparkSession)
    staged = written(docs.select(F.col(id_col), span_column(F.col(text_col)).alias("found")), "spans")
    return decided(staged, "found").withColumn("described", described(F.col("found")))


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; ``length_col``, if there, follows.

    Spans of different kinds that overlap are replaced as one, under the kind that starts first.
    NULL texts stay NULL; all columns, repeated rows and NULL ids stay. Candidates are found
    twice, for the counts and for the texts, rather than writing all texts in between.
    """
    small_batches(docs.sparkSession)
    keep = frozenset(accepted_codes(docs.select(span_column(F.col(text_col)).alias("found")), "found"))

    @F.arrow_udf("string")
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array([masked(t, [s for s in spans_of(t) if s["base"] or s["code"] in keep]) for t in texts], pa.string())

    out = docs.withColumn(text_col, replace(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.select(docs.columns)


def masked(text: str | None, spans: list[dict]) -> str | None:
    """The text with its spans replaced."""
    if not text or not spans:
        return text
    out, last = [], 0
    for s in spans:
        if s["start"] >= last:
            out += [text[last : s["start"]], f"<{KINDS[s['kind']]}>"]
        last = max(last, s["end"])
    return "".join([*out, text[last:]])

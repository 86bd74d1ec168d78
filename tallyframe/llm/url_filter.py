"""URL filter lists by hashed host-suffix and path-prefix expressions.

A rule is a host with all its subdomains and a path prefix. Each URL is expanded into every
(host suffix, path prefix) that a rule of that shape could equal. Both sides are hashed with
SHA-256; they meet on a short prefix of the digest and are confirmed by the full one. The
longest rule wins. DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join goes by.
SHORT = 8
#: URLs of one expression (a hot host) are dealt over so many join keys.
SALTS = 16


def url_host(url: Column) -> Column:
    """Lower-cased (A-Z) host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def shape(host: Column, path: Column) -> Column:
    """Number of host labels and length of the path: what an expression must share with a rule."""
    return F.struct(labels_of(host).alias("labels"), F.length(path).alias("chars"))


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every page with ``host``, ``path``, the winning ``rule`` (host and path, NULL if none fits) and ``verdict``.

    ``rules`` has host, path, verdict. A rule fits its host and all subdomains of it if the
    URL's path starts with the rule's path; the longest (host and path together) wins, and of
    one rule listed with both verdicts ``block``. Rules with a NULL field or an empty host are
    ignored. Without a fitting rule the verdict is ``default``. NULL URLs and URLs without
    ``://`` have empty host and path, which no rule fits. Rows with NULL or repeated ids keep a
    row each; other columns of ``pages`` are not read. An empty side is fine.

    Repeated URLs are judged once. The shapes of the rules (label count, path length) are the only thing that every URL is
    expanded by; they come to one row of at most (labels x path lengths in use) pairs. The
    hot expression of a big host is salted over ``SALTS`` keys; the optimiser broadcasts the
    rules if it measures them as small.
    """
    known = (
        rules.dropna(subset=["host", "path", "verdict"]).filter(F.col("host") != "")
        .groupBy("host", "path").agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("is_allow"))
        .withColumn("digest", expression(F.col("host"), F.col("path")))
        .select(
            F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("rule_digest"),
            F.concat("host", "path").alias("rule"),
            F.when(F.col("is_allow") == 0, "block").otherwise("allow").alias("rule_verdict"),
            labels_of(F.col("host")).alias("labels"), F.length("path").alias("chars"),
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
    )
    shapes = [tuple(r) for r in known.select("labels", "chars").distinct().collect()]  # bounded: see above
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    parts = F.split("host", r"\.", -1)
    wanted = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in sorted(shapes)]) if shapes else F.expr("array()").cast("array<struct<labels:int,chars:int>>")
    fits = F.filter(wanted, lambda s: (s["labels"] <= F.size(parts)) & (s["chars"] <= F.length("path")))
    tails = F.transform(fits, lambda s: expression(
        F.array_join(F.slice(parts, F.size(parts) - s["labels"] + 1, s["labels"]), "."),
        F.col("path").substr(F.lit(1), s["chars"]),
    ))
    expanded = (
        urls.select("host", "path").distinct().select("host", "path", F.explode(tails).alias("digest"))
        .withColumn("short", F.substring("digest", 1, SHORT)).withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(SALTS)))
    )
    hits = (
        expanded.join(known, ["short", "salt"]).filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.col("labels"))).alias("won"))
    )
    return urls.join(hits, ["host", "path"], "left").select(
        id_col, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.rule_verdict", F.lit(default)).alias("verdict"),
    )

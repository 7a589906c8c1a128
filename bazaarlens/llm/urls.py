"""URL filters by host and path: expand each URL, join on short hash prefixes, confirm full digests, apply precedence.

Each distinct URL is expanded once into pairs of a host suffix (at dots, with no more labels than a rule has) and a path
prefix (of the lengths that rules have). The pairs meet the rules by the first 32 bits of a digest; equal digests are
hits, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def apply_rules(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to each page.

    ``rules``: host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; of those
    that fit, the one with the longest host and path wins, on ties ``block``, then the first in order. No rule (also for a
    null URL or one without ``://``): rule null, verdict ``default``. Repeated pages are each judged; repeated rules count
    once; an empty rule table leaves all to ``default``.
    """
    ruled = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter("r_host IS NOT NULL").distinct()
    ruled = ruled.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
    ruled = ruled.withColumn("r_short", F.substring("r_digest", 1, 8))
    # the lengths of URLs' parts bound both
    labels = ruled.agg(F.max(F.size(F.split("r_host", r"\.")))).first()[0] or 0
    lengths = sorted(r[0] for r in ruled.select(F.length("r_path")).distinct().collect())

    urls = pages.select(F.col(url_col).alias("__url")).filter("__url IS NOT NULL").distinct()
    urls = urls.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    parts = F.split("__host", r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))),
        lambda i: F.array_join(F.slice(parts, -i, i), "."),
    )
    paths = [F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in lengths]
    prefixes = F.filter(F.array(*paths) if paths else F.array().cast("array<string>"), lambda p: p.isNotNull())
    expanded = urls.select("__url", F.explode(hosts).alias("__suffix"), prefixes.alias("__prefixes"))
    expanded = expanded.select("__url", "__suffix", F.explode("__prefixes").alias("__prefix"))
    expanded = expanded.withColumn("__digest", _digest(F.col("__suffix"), F.col("__prefix")))
    hits = expanded.join(ruled, F.substring("__digest", 1, 8) == F.col("r_short")).filter("__digest = r_digest")
    name = F.concat("r_host", "r_path")
    order = F.struct(F.length(name), (F.col("r_verdict") == "block").cast("int"), name)
    best = hits.groupBy("__url").agg(F.max_by(F.struct(name.alias("rule"), "r_verdict"), order).alias("__best"))
    out = pages.drop("host", "path", "rule", "verdict").join(best, F.col(url_col) == F.col("__url"), "left")
    return out.withColumns(
        {
            "host": host_of(F.col(url_col)),
            "path": path_of(F.col(url_col)),
            "rule": F.col("__best.rule"),
            "verdict": F.coalesce("__best.r_verdict", F.lit(default)),
        }
    ).drop("__url", "__best")

"""URL filter: host and path rules, and a character language model for the URLs that no rule decides.

Two variable-order Markov models, one of accepted and one of rejected URLs, are counted from the URLs that the rules
decide. The probability of a character is interpolated from the longest context down, each order smoothed by the number
of different characters seen after its context (Witten-Bell), so a context nobody has seen says nothing.
A URL's score is the mean difference of log-likelihood per character; the threshold is calibrated on labelled URLs that
were kept out of the counts. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage

#: The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER, ALPHABET, FOLDS, UNIT, BIN = 5, 256, 5, 1_000_000, 100
EDGE = "\x02"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z in lower case) and path; both empty where there is no ``://`` or no URL."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^(?s:.*?)://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def by_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):  # the last to fit wins
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def windows(url: str) -> Column:
    """For every character of a URL, it and the ORDER characters before it."""
    return F.expr(f"transform(sequence(1, length(`{url}`)), i -> substring(concat(repeat('{EDGE}', {ORDER}), `{url}`), i, {ORDER + 1}))")


@dataclass(frozen=True)
class Model:
    """Log-ratio of every window, in millionths, and the threshold of the mean."""

    ratios: DataFrame
    threshold: float


def ratios(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Log of accepted over rejected probability of each window in ``wanted``.

    ``counts`` has window, n1 (accepted) and n0 (rejected). Both are summed to all shorter contexts at once.
    """
    parts = F.explode(F.expr(f"transform(sequence(1, {ORDER + 1}), k -> right(window, k))"))
    grams = counts.withColumn("gram", parts).groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    grams = stage(grams.withColumn("context", F.expr("left(gram, length(gram) - 1)")), "grams")
    contexts = stage(grams.groupBy("context").agg(*[f(c) for c in ("n1", "n0") for f in (lambda c: F.sum(c).alias(f"all_{c}"), lambda c: F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))]), "contexts")
    each = wanted.withColumn("gram", parts).withColumn("context", F.expr("left(gram, length(gram) - 1)"))
    each = each.join(contexts, "context").join(grams.drop("context"), "gram", "left")
    rows = F.array_sort(F.collect_list(F.struct(F.length("gram").alias("k"), "n1", "n0", "all_n1", "all_n0", "kinds_n1", "kinds_n0")))
    each = each.groupBy("window").agg(rows.alias("orders"))
    chance = {c: f"aggregate(orders, 1D / {ALPHABET}, (p, x) -> CASE WHEN x.all_{c} > 0 THEN (coalesce(x.{c}, 0) + x.kinds_{c} * p) / (x.all_{c} + x.kinds_{c}) ELSE p END)" for c in ("n1", "n0")}
    return each.selectExpr("window", f"CAST(round((ln({chance['n1']}) - ln({chance['n0']})) * {UNIT}) AS BIGINT) AS ratio")


def scored(urls: DataFrame, ratio: DataFrame, url: str = "url") -> DataFrame:
    """Mean log-ratio of each distinct URL, in millionths: url, total, n. Whole numbers, so any order of adding gives the same."""
    each = urls.select(url).where(f"length(`{url}`) > 0").distinct().withColumn("window", F.explode(windows(url)))
    return each.join(ratio, "window", "left").groupBy(url).agg(F.sum(F.coalesce("ratio", F.lit(0))).alias("total"), F.count("*").alias("n"))


def fit(urls: DataFrame, url: str = "url", verdict: str = "verdict") -> Model:
    """Models of all URLs whose verdict is ``allow`` or ``block``, and ratios for the windows of all URLs.

    One distinct URL in FOLDS, by hash, is kept out of the counts; on these the threshold with the best mean of the two
    classes' hit rates is chosen (the lowest of them). Without URLs of both classes there the threshold is 0.
    """
    known = F.when(F.col(verdict) == "allow", 1).when(F.col(verdict) == "block", 0)
    rows = urls.select(F.col(f"`{url}`").alias("url"), known.alias("_y")).where("length(url) > 0")
    rows = rows.withColumn("_kept", F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0)
    seen = rows.groupBy("url", "_kept").agg(F.sum("_y").alias("n1"), (F.count("_y") - F.sum("_y")).alias("n0"))
    counts = stage(
        seen.withColumn("window", F.explode(windows("url"))).groupBy("window")
        .agg(F.sum(F.expr("if(_kept, 0, coalesce(n1, 0))")).alias("n1"), F.sum(F.expr("if(_kept, 0, coalesce(n0, 0))")).alias("n0")), "windows",
    )
    ratio = stage(ratios(counts.where("n1 + n0 > 0"), counts.select("window")), "ratios")
    held = seen.where("_kept AND (n1 > 0 OR n0 > 0)").join(scored(rows.where("_kept AND _y IS NOT NULL"), ratio), "url")
    bins = held.groupBy(F.floor(F.col("total") / F.col("n") / (UNIT // BIN)).alias("bin")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # a mean log-ratio lies within some ten units, so there are a few thousand bins at most
    below = bins.selectExpr("bin", "sum(n1) OVER () AS all1", "sum(n0) OVER () AS all0", "sum(n1) OVER (ORDER BY bin DESC) AS n1", "sum(n0) OVER (ORDER BY bin) - n0 AS n0")
    best = below.where("all1 > 0 AND all0 > 0").orderBy(F.expr("n1 / all1 + n0 / all0").desc(), "bin").first()
    return Model(ratio, best["bin"] / BIN if best else 0.0)


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """Every page with key, host, path, rule, score and verdict (``allow`` or ``block``).

    The longest rule decides; the others go by the model: ``allow`` at the threshold or above. A null or empty URL has
    score 0. Every row stays, also with a null or repeated key; other columns are ignored; an empty table gives none.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = by_rule("host", "path", rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    model = fit(rows)
    scores = scored(rows, model.ratios).withColumn("score", F.col("total") / F.col("n") / UNIT)
    out = rows.join(scores.select(F.col("url").alias("_url"), "score"), F.col("url") == F.col("_url"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    says = F.coalesce("verdict", F.when(F.col("score") >= model.threshold, "allow").otherwise("block"))
    return out.select(key, "host", "path", "rule", "score", says.alias("verdict"))

"""Secrets in texts: a trigram index picks the documents on which a rule is worth running.

For each rule a Boolean query of trigrams is worked out from its pattern: strings that every match must hold, each as
the set of its trigrams. The index lists, for every trigram of these queries, the documents that hold it (in lower
case). Its postings are intersected to find a rule's candidates, on which the pattern itself decides. A rule whose
pattern has no such string is run on every document. Only DataFrame functions are used.
"""

from __future__ import annotations

import itertools
import re._constants as op
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.lineage import stage

CLASS, STRINGS = 8, 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` in syntax that Java and Python share; a match counts if its ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules. The lengths within the last two say the same as a filter behind them, as their runs can't overlap.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def required(pattern: str) -> list[set[str]]:
    """Sets of strings in lower case: every match holds at least one string of each set."""
    found: list[set[str]] = []

    def keep(strings: set[str]) -> None:
        strings = {x for x in strings if not any(y in x for y in strings if y != x)}  # the shorter one says as much
        if strings and min(map(len, strings)) >= 3:
            found.append(strings)

    def exact(items) -> set[str] | None:
        """All strings that these items match, if there are few."""
        out = {""}
        for kind, what in items:
            if kind is op.LITERAL:
                more = {chr(what).lower()}
            elif kind is op.IN:
                more = set()
                for k, x in what:
                    if k is op.LITERAL:
                        more.add(chr(x).lower())
                    elif k is op.RANGE and x[1] - x[0] < CLASS:
                        more |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                    else:
                        return None
                if len(more) > CLASS:
                    return None
            elif kind is op.SUBPATTERN:
                more = exact(what[3])
            elif kind is op.BRANCH:
                each = [exact(x) for x in what[1]]
                more = None if None in each else set().union(*each)
            elif kind is op.MAX_REPEAT and what[1] <= CLASS:
                once = exact(what[2])
                more = once and {"".join(x) for n in range(what[0], what[1] + 1) for x in itertools.islice(itertools.product(once, repeat=n), STRINGS + 1)}
            else:
                return None
            if more is None or len(out) * len(more) > STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def walk(items) -> None:
        now = {""}
        for item in items:
            more = exact([item])
            if more is not None and len(now) * len(more) <= STRINGS:
                now = {a + b for a in now for b in more}
                continue
            keep(now)
            now = more if more is not None else {""}
            if more is None and item[0] is op.SUBPATTERN:
                walk(item[1][3])
            elif more is None and item[0] is op.MAX_REPEAT and item[1][0] > 0:
                walk(item[1][2])
        keep(now)

    walk(parser.parse(pattern))
    return found


def trigrams(string: str) -> list[str]:
    return sorted({string[i : i + 3] for i in range(len(string) - 2)})


def of_rule(rules: tuple[Rule, ...], make) -> Column:
    out = F.lit(None)
    for i, r in enumerate(rules):
        out = F.when(F.col("_rule") == i, make(r)) if i == 0 else out.when(F.col("_rule") == i, make(r))
    return out


def postings(texts: DataFrame, grams: list[str]) -> DataFrame:
    """The inverted index: a row for each trigram of ``grams`` and document that holds it."""
    low = texts.select("_key", "_print", F.lower("_text").alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("_key", "_print", F.explode(held).alias("_gram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """Documents and, for each, the rules whose trigram query it answers."""
    spark = texts.sparkSession
    need = [required(r.pattern) for r in rules]
    grams = sorted({g for sets in need for s in sets for x in s for g in trigrams(x)})
    if not grams:
        return None
    rows = [
        (grams.index(g), i, j, k, 1 << n, (1 << len(trigrams(x))) - 1)
        for i, sets in enumerate(need) for j, s in enumerate(sets) for k, x in enumerate(sorted(s)) for n, g in enumerate(trigrams(x))
    ]
    wanted = spark.createDataFrame(rows, "_gram int, _rule int, _set int, _string int, _bit long, _all long")
    sets = spark.createDataFrame([(i, (1 << len(s)) - 1) for i, s in enumerate(need) if s], "_rule int, _sets long")
    # both lists are as long as the rules are, not the corpus
    strings = postings(texts, grams).join(F.broadcast(wanted), "_gram").groupBy("_key", "_print", "_rule", "_set", "_string")
    strings = strings.agg(F.bit_or("_bit").alias("_bits"), F.first("_all").alias("_all")).where("_bits = _all")
    held = strings.groupBy("_key", "_print", "_rule").agg(F.expr("bit_or(shiftleft(1L, _set))").alias("_bits"))
    return held.join(F.broadcast(sets), "_rule").where("_bits = _sets").groupBy("_key", "_print").agg(F.collect_set("_rule").alias("_rules"))


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, a hash of the text and the text. Rows alike in both have the same secrets and count once in the search."""
    out = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    return out.select("_key", F.xxhash64("_text").alias("_print"), "_text")


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per secret: key, text_hash, kind, rule (its number), start, end in code points, end exclusive.

    Matches of a rule go from left to right and don't overlap; those of different rules may. ``text_hash`` is
    xxhash64 of the text (null: of an empty one), so that documents that share a key, or have none, stay apart; rows alike in
    both give their spans once. Null and empty texts and an empty table have none; other columns are ignored.
    """
    texts = keyed(docs, key, text)
    scanned = [i for i, r in enumerate(rules) if not required(r.pattern)]
    found = None
    if scanned:
        hit = F.array_compact(F.array(*[F.when(F.col("_text").rlike(rules[i].pattern), F.lit(i)) for i in scanned]))
        found = texts.withColumn("_rules", hit).where(F.size("_rules") > 0)
    picked = candidates(texts, rules)
    if picked is not None:
        picked = stage(picked, "candidates").withColumnsRenamed({"_key": "_k", "_print": "_p"})
        both = texts.join(picked, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p"))).drop("_k", "_p")
        found = both if found is None else found.unionByName(both)
    one = found.withColumn("_rule", F.explode("_rules")).drop("_rules").dropDuplicates(["_key", "_print", "_rule"])
    one = one.select(
        "_key", "_print", "_rule",
        of_rule(rules, lambda r: F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(0))).alias("_whole"),
        of_rule(rules, lambda r: F.regexp_extract_all("_text", F.lit(r.pattern), F.lit(r.group))).alias("_part"),
        of_rule(rules, lambda r: F.split("_text", r.pattern, -1)).alias("_between"),
    ).where(F.size("_whole") > 0)
    each = one.select("_key", "_print", "_rule", F.posexplode(F.arrays_zip("_whole", "_part", F.slice("_between", F.lit(1), F.size("_whole")).alias("_between"))))
    each = each.selectExpr("_key", "_print", "_rule", "pos", "length(col._whole) AS _len", "length(col._part) AS _size", "length(col._between) AS _skip")
    each = each.withColumn("end", F.expr("sum(_skip + _len) OVER (PARTITION BY _key, _print, _rule ORDER BY pos)"))
    kinds, least = F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(r.least) for r in rules])
    each = each.where(F.col("_size") >= least[F.col("_rule")])
    return each.select(F.col("_key").alias(key), F.col("_print").alias("text_hash"), kinds[F.col("_rule")].alias("kind"), F.col("_rule").alias("rule"), (F.col("end") - F.col("_len")).alias("start"), "end")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mask: str = "[secret]", length: str | None = None) -> DataFrame:
    """The documents with every stretch that spans cover replaced by ``mask``; spans that touch or overlap share one.

    Columns and rows stay as they are otherwise, null texts too. ``length`` names a column with the text's length, which is
    then counted anew where a mask was set.
    """
    own = stage(spans(docs, rules, key, text), "spans").select(F.col(key).alias("_key"), F.col("text_hash").alias("_print"), "start", "end")
    own = own.withColumn("_reach", F.expr("max(end) OVER (PARTITION BY _key, _print ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    own = own.withColumn("_run", F.expr("sum(CASE WHEN start <= _reach THEN 0 ELSE 1 END) OVER (PARTITION BY _key, _print ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    own = own.groupBy("_key", "_print", "_run").agg(F.min("start").alias("a"), F.max("end").alias("z"))
    cuts = own.groupBy("_key", "_print").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("_cuts"))
    cuts = stage(cuts, "cuts").withColumnsRenamed({"_key": "_k", "_print": "_p"})
    body = F.col(f"`{text}`")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{key}`").alias("_key"), F.coalesce(body, F.lit("")).alias("_text"))
    joined = marked.join(cuts, F.col("_key").eqNullSafe(F.col("_k")) & (F.xxhash64("_text") == F.col("_p")), "left")
    # what stands before the first cut, between two, and after the last
    between = F.expr("""transform(sequence(0, size(_cuts)), i -> substring(_text,
        int(if(i = 0, 0, _cuts[i - 1].z)) + 1, int(if(i = size(_cuts), length(_text), _cuts[i].a) - if(i = 0, 0, _cuts[i - 1].z))))""")
    joined = joined.withColumn("_new", F.when(F.col("_cuts").isNotNull(), F.array_join(between, mask)))
    columns = {f.name: F.col("_doc").getField(f.name) for f in docs.schema.fields}
    columns[text] = F.coalesce(F.col("_new"), columns[text])
    if length is not None:
        columns[length] = F.when(F.col("_new").isNotNull(), F.length("_new").cast(docs.schema[length].dataType)).otherwise(columns[length])
    return joined.select(*[c.alias(n) for n, c in columns.items()])

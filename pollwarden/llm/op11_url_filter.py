"""URL filter: rules first, then the ratio of two character models, in DataFrame operations only.

URLs that a rule allows or blocks teach two variable-order Markov models (interpolated Witten-Bell smoothing, contexts of
up to five characters); the other URLs are judged by the difference of the two log-likelihoods per character,
against a threshold calibrated on hosts that took no part in the learning.

A substring belongs to a model if it makes up at least one part in `share` of the substrings of its length, so a model holds at most `share` of each
length and is small enough to send to every task, however long the table. Smoothing is written
in back-off form: ln p(c | context) = sum over the suffixes of the context of (ln backoff of the suffix) + (correction of suffix + c, if the
model holds it). So a URL's log-likelihood is the sum of one weight for each of its substrings that a model holds: one lookup and one sum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import LOWER, UPPER, table
from pollwarden.session import cut_lineage

#: Rule (host and path prefix) and its verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Longest substring: five characters of context and the one that follows.
ORDER = 6
SHARE = 10_000
#: One host in so many is kept from the models and calibrates the threshold.
FOLDS = 5
START, END = "\u0002", "\u0003"
CODE_POINTS = 1_114_112
#: Weights are summed as whole numbers of 1e-9, so that sums do not depend on their order.
UNIT = 1_000_000_000
SIDES = ("allow", "block")


def host_of(url: str | Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host, up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def after_scheme(url: str | Column) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def rule_of(host: str, path: str, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the host or a parent domain of it and whose path begins the path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest is asked first
        name, _, rest = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith("/" + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def windows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """For every character of host and path, and the two end marks, the next ORDER characters from it on (w)."""
    text = F.translate(F.concat("host", "path"), START + END, "")
    chars = rows.select(*columns, F.split(F.concat(F.lit(START), text, F.lit(END)), "").alias("__chars"))
    at = F.sequence(F.lit(0), F.size("__chars") - 1)
    # single entries are read in place; slice() would copy the whole array for every position
    return chars.select(*columns, F.explode(F.transform(at, lambda i: F.concat_ws("", *[F.get("__chars", i + k) for k in range(ORDER)]))).alias("w"))


def substrings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """All prefixes (s, of k characters) of the column w."""
    each = rows.select(*columns, "w", F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("k"))
    return each.select(*columns, "k", F.substr("w", F.lit(1), "k").alias("s"))


def learn(labelled: DataFrame, share: int = SHARE) -> tuple[DataFrame, float] | None:
    """Weights (s, weight long) of the substrings and the constant of a character, from rows (side, host, path).

    Both stand for the model of "allow" less that of "block". None if one of the sides has no rows.
    """
    seen = windows(labelled, ["side"]).groupBy("side", "w").agg(F.count("*").alias("c"))
    counts = substrings(seen, ["side", "c"]).groupBy("side", "k", "s").agg(F.sum("c").alias("c"))
    counts = cut_lineage(counts)
    totals = {r.side: r.n for r in counts.where((F.col("k") == 1) & (F.col("s") != START)).groupBy("side").agg(F.sum("c").alias("n")).collect()}
    if set(totals) != set(SIDES):
        return None
    total = F.when(F.col("side") == SIDES[0], F.lit(totals[SIDES[0]])).otherwise(F.lit(totals[SIDES[1]]))
    kept = cut_lineage(counts.where(F.col("c") * share >= total))  # at most 2 * share rows of a length and side
    after = kept.where(F.col("s") != START).groupBy("side", F.substr("s", F.lit(1), F.col("k") - 1).alias("context")).agg(
        F.sum("c").alias("held"), F.count("*").alias("kinds"))
    seen_as = kept.select("side", F.col("s").alias("context"), F.col("c").alias("n"))
    after = after.join(seen_as, ["side", "context"], "left").withColumn("n", F.coalesce("n", total))  # the empty context stands everywhere
    backoff = (F.col("n") - F.col("held") + F.col("kinds")) / (F.col("n") + F.col("kinds"))
    after = cut_lineage(after.select("side", "context", (F.col("n") + F.col("kinds")).alias("of"), backoff.alias("backoff")))
    base = {r.side: math.log(r.backoff / CODE_POINTS) for r in after.where("context = ''").collect()}
    level, weights = None, []
    for k in range(1, ORDER + 1):
        own = kept.where((F.col("k") == k) & (F.col("s") != START)).withColumn("context", F.substr("s", F.lit(1), F.lit(k - 1)))
        own = own.join(after, ["side", "context"])
        if level is None:
            own = own.withColumn("lower", F.lit(1.0 / CODE_POINTS))
        else:
            own = own.withColumn("rest", F.substr("s", F.lit(2))).join(
                level.select("side", F.col("s").alias("rest"), F.col("p").alias("lower")), ["side", "rest"])
        p = F.col("c") / F.col("of") + F.col("backoff") * F.col("lower")
        level = cut_lineage(own.select("side", "s", p.alias("p"), (F.log(p) - F.log("backoff") - F.log("lower")).alias("weight")))
        weights.append(level.select("side", "s", "weight"))
    weights.append(after.where("context != ''").select("side", F.col("context").alias("s"), F.log("backoff").alias("weight")))
    every = weights[0]
    for more in weights[1:]:
        every = every.union(more)
    signed = F.when(F.col("side") == SIDES[0], F.col("weight")).otherwise(-F.col("weight"))
    return every.groupBy("s").agg(F.sum(F.round(signed * UNIT).cast("long")).alias("weight")), base[SIDES[0]] - base[SIDES[1]]


def scored(rows: DataFrame, model: DataFrame, constant: float) -> DataFrame:
    """rows (row, host, path, ...) with `score`: log-likelihood difference for each character of host and path and the end mark."""
    looked = substrings(windows(rows, ["row"]), ["row"])
    symbols = F.sum(F.when((F.col("k") == 1) & (F.col("s") != START), 1).otherwise(0))
    found = looked.join(F.broadcast(model), "s", "left")  # at most 2 * share rows of each of ORDER lengths
    sums = found.groupBy("row").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("__w"), symbols.alias("__n"))
    # the row's own columns come back by a join: beside every substring of a very long URL they would fill the disk
    return rows.join(sums, "row").select(*rows.columns, (F.col("__w") / F.lit(float(UNIT)) / F.col("__n") + F.lit(constant)).alias("score"))


def threshold(labelled: DataFrame) -> float:
    """The score under which a URL is blocked: the cut with the largest share of blocked less share of allowed rows under it.

    labelled: (side, score). Scores are counted in hundredths, at most 4,001 of them; of equally good cuts the middle one is taken, and 0
    without rows of both sides.
    """
    mark = F.least(F.greatest(F.round(F.col("score") * 100), F.lit(-2000)), F.lit(2000)).cast("int")
    rows = labelled.groupBy(mark.alias("mark")).agg(*[F.sum((F.col("side") == s).cast("long")).alias(s) for s in SIDES]).orderBy("mark").collect()
    good, bad = sum(r.allow for r in rows), sum(r.block for r in rows)
    if not good or not bad:
        return 0.0
    best, cuts, under = -1.0, [], [0, 0]
    for r, after in zip(rows, [*rows[1:], None]):
        under = [under[0] + r.allow, under[1] + r.block]
        gain = under[1] / bad - under[0] / good
        if gain > best + 1e-12:
            best, cuts = gain, []
        if gain > best - 1e-12:
            cuts.append((r.mark + (after.mark if after else r.mark + 1)) / 200)
    return cuts[len(cuts) // 2]


def judge_urls(pages: DataFrame, rules: dict[str, str], url: str = "url", share: int = SHARE, folds: int = FOLDS) -> DataFrame:
    """pages' columns, except those of the names added, with host, path, rule, score (above the threshold: allow), threshold and verdict.

    Null URLs and URLs without :// have an empty host and path and are judged by the models like any other; very long ones are read whole.
    Repeated rows are judged alike. If no allowed or no blocked URL is left to learn from, score is null and what no rule decides is allowed. An
    empty table gives no rows. Columns of the names host, path, rule, score, threshold and verdict are replaced.
    """
    added = ["row", "host", "path", "rule", "score", "threshold", "verdict"]
    kept = [c for c in pages.columns if c not in added]
    own_columns = [F.col("other")[c].alias(c) for c in kept]  # carried as one column, so that no name can clash
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.struct(*kept).alias("other"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = cut_lineage(rows.withColumn("rule", rule_of("host", "path", rules)))
    side = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None)) if rules else F.lit(None).cast("string")
    aside = F.crc32(F.col("host").cast("binary")) % folds == 0
    labelled = rows.select("host", "path", side.alias("side")).where("side is not null")
    model = learn(labelled.where(~aside), share)
    if model is None:
        return rows.select(*own_columns, "host", "path", "rule", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"),
                           F.coalesce(side, F.lit("allow")).alias("verdict"))
    rated = cut_lineage(scored(rows, *model))
    cut = threshold(rated.where(aside).select(side.alias("side"), "score").where("side is not null"))
    own = F.when(F.col("score") < cut, F.lit("block")).otherwise(F.lit("allow"))
    return rated.select(*own_columns, "host", "path", "rule", "score", F.lit(cut).alias("threshold"), F.coalesce(side, own).alias("verdict"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "score", "threshold")

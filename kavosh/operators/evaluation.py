"""Retrieval metrics, paired significance tests, multiple-testing correction, gates, agreement, conflation indices."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recall_mrr(runs: DataFrame, *by: str) -> DataFrame:
    """n, recall and MRR of the ranks (0: missing) of each group."""
    found = F.col("rank") > 0
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(found, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(found, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of a share."""
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def kept_rate(runs: DataFrame, *by: str) -> DataFrame:
    """kept: of the variants whose canonical row was found, the share found as well. runs: base, type, rank."""
    canonical = runs.where("type = 'canonical' and rank > 0").select("base").distinct()
    return runs.where("type <> 'canonical'").join(canonical, "base", "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("rank") > 0, 1.0).otherwise(0.0)).alias("kept"))


def macro_mean(rows: DataFrame, value: str, inner: str, *by: str) -> DataFrame:
    """The mean of the means of each inner group; a null group is '?'."""
    named = rows.withColumn(inner, F.coalesce(inner, F.lit("?")))
    return named.groupBy(*by, inner).agg(F.avg(value).alias("mean")).groupBy(*by).agg(F.avg("mean").alias("macro"), F.count(F.lit(1)).alias("groups"))


def paired(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """rank_a and rank_b of two runs; a query that one run lacks counts as missing there."""
    left, right = a.select(*on, F.col("rank").alias("rank_a")), b.select(*on, F.col("rank").alias("rank_b"))
    return left.join(right, on, "left").withColumn("rank_b", F.coalesce("rank_b", F.lit(0)))


def _log_factorial(n: Column) -> Column:
    """ln n!, exactly up to 20 and by Stirling's series beyond (to 1e-13)."""
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.lit(math.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _log_choose_tail(n: Column, k: Column) -> Column:
    """sum over i <= k of C(n, i) / 2**n for k <= n / 2: the largest term, times a falling series.

    Its j-th member is below exp(-2 j**2 / n), so about five roots of n are all that a double can tell.
    """
    largest = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) - n * F.log(F.lit(2.0)))
    upto = F.least(k, F.ceil(5 * F.sqrt(n)) + 50).cast("int")

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    places = F.when(upto >= 1, F.sequence(F.lit(1), F.greatest(upto, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return largest * F.aggregate(places, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]


def mcnemar(pairs: DataFrame, *by: str) -> DataFrame:
    """lost, gained and the exact two-sided p of found-or-not, by group."""
    a, b = F.col("rank_a") > 0, F.col("rank_b") > 0
    counts = pairs.groupBy(*by).agg(F.count_if(a & ~b).alias("lost"), F.count_if(~a & b).alias("gained"))
    n = F.col("lost") + F.col("gained")
    p = F.least(F.lit(1.0), 2 * _log_choose_tail(n, F.least("lost", "gained")))
    return counts.withColumn("p", F.when(n == 0, 1.0).otherwise(p))


def normal_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0, by a polynomial that errs by less than 2e-7."""
    # The coefficients of the approximation.
    c = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = F.lit(0.0)
    for k in reversed(c):
        poly = (poly + k) * t
    return poly * F.exp(-x * x) / 2


def wilcoxon(pairs: DataFrame, *by: str, a: str = "a", b: str = "b") -> DataFrame:
    """n (non-zero differences), w (sum of positive ranks) and two-sided p with tie and continuity corrections."""
    diff = pairs.withColumn("d", F.col(b) - F.col(a)).where(F.abs("d") > 1e-12).withColumn("size", F.round(F.abs("d"), 12))
    # Equal sizes share their mean rank; counts by size come first, so no group's rows meet in one task.
    sizes = diff.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    window = Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = sizes.withColumn("rank", F.sum("t").over(window) - (F.col("t") - 1) / 2)
    total = ranked.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.greatest(F.lit(0.0), F.abs(F.col("w") - n * (n + 1) / 4) - 0.5) / F.sqrt(var)
    return total.select(*by, "n", "w", F.when(var > 0, F.least(F.lit(1.0), 2 * normal_tail(z))).otherwise(1.0).alias("p"))


def benjamini_hochberg(cells: DataFrame, p: str = "p", *by: str, parts: int = 64) -> DataFrame:
    """q of each p within its group: the step-up running minimum of p * m / rank.

    Equal p have one q, by their last rank, so they are counted first. Ranks and minima run within ranges of p, cut at
    about the quantiles, and are carried over from range to range; no task gets a whole group.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    counts = cells.groupBy(*(F.col(c).alias(g) for c, g in zip(by, groups, strict=True)), F.col(p).cast("double").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sorted(set(counts.approxQuantile("_p", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    ranged = counts.withColumn("_part", sum((F.coalesce(F.col("_p") >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0)))

    def carried(left: DataFrame, right: DataFrame) -> DataFrame:
        """left with the columns of right, a row for each group and range."""
        names = [*groups, "_part"]
        other = right.withColumnsRenamed({c: f"{c}_" for c in names})
        return left.join(other, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"{c}_")) for c in names))).drop(*(f"{c}_" for c in names))

    group, inside = Window.partitionBy(*groups), Window.partitionBy(*groups, "_part")
    ahead = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda window: window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_size"))
    starts = sizes.select(*groups, "_part", F.sum("_size").over(group).alias("_m"), F.coalesce(F.sum("_size").over(ahead(group.orderBy("_part"))), F.lit(0)).alias("_start"))
    ranked = carried(ranged, starts).withColumn("_r", F.col("_start") + F.sum("_n").over(so_far(inside.orderBy("_p"))))
    stepped = ranked.select(*groups, "_part", "_p", (F.col("_p") * F.col("_m") / F.col("_r")).alias("_step"))
    least = stepped.groupBy(*groups, "_part").agg(F.min("_step").alias("_least"))
    later = least.select(*groups, "_part", F.min("_least").over(ahead(group.orderBy(F.desc("_part")))).alias("_later"))
    q = F.least(F.lit(1.0), F.min("_step").over(so_far(inside.orderBy(F.desc("_p")))), F.col("_later"))
    found = carried(stepped, later).select(*groups, "_p", q.alias("_q"))
    on = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(g)) for c, g in zip(by, groups, strict=True)), F.col(p).cast("double").eqNullSafe(F.col("_p")))
    return cells.drop("q").join(found, on).drop(*groups, "_p").withColumnRenamed("_q", "q")


def gate(cells: DataFrame, q: str = "q", delta: str = "delta", n: str = "n", level: float = 0.05, loss: float = -0.02, least: int = 10) -> DataFrame:
    """verdict of each cell: up, down, block (a clear loss of two points), or none."""
    clear = (F.col(q) < level) & (F.col(n) >= least)
    return cells.withColumn("verdict", F.when(clear & (F.col(delta) <= loss), "block").when(clear & (F.col(delta) < 0), "down").when(clear & (F.col(delta) > 0), "up").otherwise("none"))


def kappa(rows: DataFrame, a: str, b: str, *by: str) -> DataFrame:
    """Agreement and Cohen's kappa of two yes-or-no raters."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    t = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg((x == y).cast("double")).alias("agreement"), F.avg(x).alias("_x"), F.avg(y).alias("_y"))
    chance = F.col("_x") * F.col("_y") + (1 - F.col("_x")) * (1 - F.col("_y"))
    return t.withColumn("kappa", F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).otherwise(1.0)).drop("_x", "_y")


def dominant(rows: DataFrame, key: str, target: str, share: float = 0.9) -> DataFrame:
    """key, target, n, total where one target has at least the share of a key's rows."""
    counts = rows.groupBy(key, target).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), F.col(target).alias("t"))).alias("best"))
    return best.select(key, F.col("best.t").alias(target), (-F.col("best.n")).alias("n"), "total").where(F.col("n") >= share * F.col("total"))


def nearest_rank(rows: DataFrame, value: str, p: float, *by: str, inner: bool = False) -> DataFrame:
    """The value at floor(p * n) of the sorted ones, or at floor(p * (n - 1)) with inner.

    Equal values are counted first, so a window runs over distinct values, not over rows.
    """
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    n = F.sum("_n").over(Window.partitionBy(*by))
    at = F.floor((n - 1) * p) if inner else F.least(F.floor(n * p), n - 1)
    placed = counts.select(*by, F.col(value).alias("value"), upto.alias("_upto"), (upto - F.col("_n")).alias("_from"), at.alias("_at"))
    return placed.where("_from <= _at and _at < _upto").select(*by, "value")


def conflation(entries: DataFrame, lemma: str, term: str, form: str) -> DataFrame:
    """Under- and over-stemming of forms: pairs within a lemma that got apart, pairs across lemmas that met.

    One row: within, apart, across, met, ui, oi. Pairs are counted as n(n-1)/2 of group sizes, never made.
    """
    pairs = lambda n: n * (n - 1) / 2
    forms = entries.select(lemma, term, form).distinct()
    cell = forms.groupBy(lemma, term).agg(F.count(F.lit(1)).alias("n"))
    by_lemma = cell.groupBy(lemma).agg(pairs(F.sum("n")).alias("within"), F.sum(pairs(F.col("n"))).alias("together"))
    by_term = cell.groupBy(term).agg(pairs(F.sum("n")).alias("same"), F.sum(pairs(F.col("n"))).alias("own"))
    a = by_lemma.agg(F.sum("within").alias("within"), F.sum(F.col("within") - F.col("together")).alias("apart"))
    b = by_term.agg(F.sum(F.col("same") - F.col("own")).alias("met"))
    total = forms.agg(pairs(F.count(F.lit(1))).alias("all"))
    out = a.join(F.broadcast(b)).join(F.broadcast(total)).withColumn("across", F.col("all") - F.col("within"))  # one row each
    return out.select("within", "apart", "across", "met", (F.col("apart") / F.col("within")).alias("ui"), (F.col("met") / F.col("across")).alias("oi"))


def collisions(words: DataFrame, word: str, before: Column, after: Column, n: str) -> DataFrame:
    """Keys that forms with different keys before share after: key, forms, weight (the second most frequent's count)."""
    keyed = words.select(after.alias("key"), before.alias("form"), F.col(n).alias("n")).groupBy("key", "form").agg(F.sum("n").alias("n"))
    # The two largest: the largest one's form, then the largest of the others.
    largest = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.max(F.struct("n", "form")).alias("top")).where("forms >= 2")
    others = keyed.join(largest, "key").where(F.col("form") != F.col("top.form"))
    return others.groupBy("key", "forms").agg(F.max("n").alias("weight"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """A hash of a table's content whatever its order: row digests are summed, so no task gathers all rows."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)), 256)
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(w).alias(f"s{i}") for i, w in enumerate(words)))
    return sums.select("n", F.substring(F.sha2(F.concat_ws(",", F.coalesce("s0", F.lit(0)), F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0)), F.coalesce("s3", F.lit(0)), "n"), 256), 1, 16).alias("fingerprint"))


def max_window(rows: DataFrame, hit: Column, size: int, order: str, *by: str) -> DataFrame:
    """Of each group, the first position at which most hits lie in the next `size` rows, and how many."""
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, size - 1)
    scored = rows.withColumn("_hits", F.sum(F.when(hit, 1).otherwise(0)).over(ahead))
    best = scored.groupBy(*by).agg(F.min(F.struct((-F.col("_hits")).alias("h"), F.col(order).alias("at"))).alias("best"))
    return best.select(*by, F.col("best.at").alias("at"), (-F.col("best.h")).alias("hits"))


def cell_means(cells: DataFrame, value: str, row: str, column: str) -> DataFrame:
    """row, mean: the mean over a row's cells of each cell's mean, so every cell counts alike whatever its size."""
    return cells.groupBy(row, column).agg(F.avg(value).alias("m")).groupBy(row).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("cells"))


def families(entries: DataFrame, lemma: str, term: str) -> DataFrame:
    """lemma, forms, terms, whole: how many terms a lemma's forms fall into, and whether into one."""
    return entries.groupBy(lemma).agg(F.count(F.lit(1)).alias("forms"), F.countDistinct(term).alias("terms")).withColumn("whole", F.col("terms") == 1)


def fixed_broken(pairs: DataFrame, *by: str) -> DataFrame:
    """fixed, broken, net of paired ranks: found now and not before, and the other way (G23). pairs: rank_a (before), rank_b."""
    a, b = F.col("rank_a") > 0, F.col("rank_b") > 0
    counts = pairs.groupBy(*by).agg(F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"))
    return counts.withColumn("net", F.col("fixed") - F.col("broken"))


def join_precision(joins: DataFrame, *by: str) -> DataFrame:
    """right, made, wanted, precision, recall of joins(made, wanted: booleans): rejoined words against a treebank's."""
    made, wanted = F.col("made"), F.col("wanted")
    t = joins.groupBy(*by).agg(F.count_if(made & wanted).alias("right"), F.count_if(made).alias("made"), F.count_if(wanted).alias("wanted"))
    return t.withColumns({"precision": F.when(F.col("made") > 0, F.col("right") / F.col("made")), "recall": F.when(F.col("wanted") > 0, F.col("right") / F.col("wanted"))})


def notice_rates(queries: DataFrame, *by: str) -> DataFrame:
    """n, noticed, helped, harmed of queries(rank, fixed_rank: null where no fix was offered): rates of fixes shown.

    noticed: a fix was offered; helped: it finds a target that was missed; harmed: it loses one that was found.
    """
    offered, before, after = F.col("fixed_rank").isNotNull(), F.col("rank") > 0, F.coalesce(F.col("fixed_rank"), F.lit(0)) > 0
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return queries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share(offered).alias("noticed"), share(offered & ~before & after).alias("helped"), share(offered & before & ~after).alias("harmed"))


def one_click(queries: DataFrame, *by: str) -> DataFrame:
    """n, reached: the share of queries whose target is among the results as typed or behind the one fix offered."""
    hit = (F.col("rank") > 0) | (F.coalesce(F.col("fixed_rank"), F.lit(0)) > 0)
    return queries.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("reached"))


def excerpt_rates(excerpts: DataFrame, text: str, *by: str) -> DataFrame:
    """n, marked, mean_marks, words of excerpts with <mark> around hits: how many show one, and how many."""
    marks = F.size(F.regexp_extract_all(text, F.lit("<mark>"), F.lit(0)))
    words = F.size(F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0)))
    return excerpts.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(marks > 0, 1.0).otherwise(0.0)).alias("marked"), F.avg(marks).alias("mean_marks"), F.sum(words).alias("words"))


def wrong_merges(entries: DataFrame, lemma: str, term: str) -> DataFrame:
    """term, lemmas, pairs: terms that forms of different lemmas share, and how many pairs of lemmas that merges."""
    groups = entries.select(lemma, term).distinct().groupBy(term).agg(F.count(F.lit(1)).alias("lemmas")).where("lemmas >= 2")
    return groups.select(term, "lemmas", (F.col("lemmas") * (F.col("lemmas") - 1) / 2).cast("long").alias("pairs"))


def pair_metrics(pairs: DataFrame, gold: str, said: str, *by: str) -> DataFrame:
    """precision, recall, f1 of yes-or-no decisions against gold (Q13)."""
    g, x = F.col(gold), F.col(said)
    t = pairs.groupBy(*by).agg(F.count_if(g & x).alias("tp"), F.count_if(~g & x).alias("fp"), F.count_if(g & ~x).alias("fn"))
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return t.withColumns({"precision": p, "recall": r}).withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))

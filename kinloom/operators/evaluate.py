"""Evaluation of clusterings against labelled pairs and owner groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components

RATIOS = ("precision", "recall", "f1", "accuracy", "balanced_accuracy", "splitting", "lumping")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def assigned(aliases: DataFrame, assignments: DataFrame) -> DataFrame:
    """(alias, cluster): the assignment of each alias, itself without one."""
    return aliases.join(assignments.withColumnRenamed("searched", "alias"), "alias", "left").withColumn("cluster", F.coalesce("assigned", "alias")).drop("assigned")


def mapped(aliases: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, cluster) of aliases (id, alias) from a mapping (source, target) of aliases, closed transitively: chains and
    cycles of the mapping are one cluster, an alias without one is its own. A cluster is called as its least alias."""
    of = connected_components(mapping, "source", "target")
    return aliases.join(of.withColumnRenamed("node", "alias"), "alias", "left").select("id", F.coalesce("label", "alias").alias("cluster"))


def external(aliases: DataFrame, authors: DataFrame) -> DataFrame:
    """(id, cluster) from another tool's rows (id, author_id) in the aliases' order; aliases that it left out are their own."""
    own = F.concat(F.lit("own "), F.col("id").cast("string"))
    return aliases.select("id").join(authors.select("id", F.col("author_id").cast("string").alias("author_id")), "id", "left").select("id", F.coalesce("author_id", own).alias("cluster"))


def coverage(aliases: DataFrame, assignments: DataFrame) -> DataFrame:
    d = aliases.select("alias").distinct().join(assignments.withColumnRenamed("searched", "alias"), "alias", "left")
    return d.agg(F.count(F.lit(1)).alias("authors"), F.count("assigned").alias("mapped")).withColumn("coverage", ratio(F.col("mapped"), F.col("authors")))


def judged(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds outcome to (id1, id2, label): tp, fp, tn, fn; null if an id has no cluster."""
    side = lambda i: clusters.select(F.col("id").alias(f"id{i}"), F.col("cluster").alias(f"c{i}"))
    d = pairs.join(side(1), "id1", "left").join(side(2), "id2", "left")
    same = F.col("c1") == F.col("c2")
    out = F.when(same & (F.col("label") == 1), "tp").when(same, "fp").when(~same & (F.col("label") == 1), "fn").when(~same, "tn")
    return d.select("id1", "id2", "label", out.alias("outcome"))


def confusion(j: DataFrame) -> DataFrame:
    return j.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("tp", "fp", "tn", "fn")], F.count(F.lit(1)).alias("total_pairs"))


def metrics(c: DataFrame) -> DataFrame:
    """Adds the seven ratios to tp, fp, tn, fn; a ratio without denominator is 0."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = (p, r, ratio(2 * p * r, p + r), ratio(tp + tn, tp + fp + tn + fn), (r + ratio(tn, tn + fp)) / 2, ratio(fn, tp + fn), ratio(fp, tp + fn))
    return c.withColumns(dict(zip(RATIOS, values, strict=True)))


def errors(j: DataFrame, aliases: DataFrame, outcome: str) -> DataFrame:
    """The wrong pairs of one kind with both aliases' details; aliases: (id, name, email)."""
    side = lambda i: aliases.select(F.col("id").alias(f"id{i}"), F.col("name").alias(f"name{i}"), F.col("email").alias(f"email{i}"))
    return j.where(F.col("outcome") == outcome).join(side(1), "id1").join(side(2), "id2").select("id1", "name1", "email1", "id2", "name2", "email2")


def filtered_groups(df: DataFrame, max_entries: int | None = None, org: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that stay, and one row of statistics; df: (pos, grp, org_flag, ...)."""
    g = df.groupBy("grp").agg(F.count(F.lit(1)).alias("all_n"), F.min_by("org_flag", "pos").alias("first_flag"), F.count_if(F.col("org_flag") == 0).alias("n"))
    gone = (F.col("first_flag") != 0) if org else F.lit(False)
    size = F.col("n") if org else F.col("all_n")
    left = size > 0
    fits = left & (size <= max_entries) if max_entries else left
    stat = lambda cond, c, name: [f(F.when(cond, c)).alias(f"{k}_{name}") for k, f in (("avg", F.avg), ("median", F.median), ("std", F.stddev_pop), ("max", F.max))]
    stats = g.agg(F.count(F.lit(1)).alias("initial"), F.count_if(left).alias("after_org"), F.count_if(fits).alias("after_max"), *stat(gone, F.col("all_n"), "removed"), *stat(fits, size, "kept"))
    kept = df.where("org_flag = 0") if org else df
    return kept.join(g.where(fits).select("grp"), "grp", "left_semi"), stats


def first_groups(df: DataFrame, n: int) -> DataFrame:
    first = df.groupBy("grp").agg(F.min("pos").alias("at")).orderBy("at").limit(n).select("grp")
    return df.join(F.broadcast(first), "grp", "left_semi")


def per_group(df: DataFrame) -> DataFrame:
    """Metrics of each group of (grp, cluster), in which all pairs should merge: pairs are counted
    from cluster sizes, never made."""
    sizes = df.groupBy("grp", "cluster").agg(F.count(F.lit(1)).alias("k"))
    g = sizes.groupBy("grp").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("clusters"), F.max("k").alias("largest"), F.sum(F.expr("k * (k - 1) div 2")).alias("tp"))
    every = F.expr("n * (n - 1) div 2")
    g = g.withColumn("fn", every - F.col("tp"))
    one = F.col("n") == 1
    r = ratio(F.col("tp"), every)
    p = (F.col("tp") > 0).cast("double")
    value = lambda x: F.when(one, 1.0).otherwise(x)
    return g.select(
        "grp", "n", "clusters", "tp", "fn",
        F.when(one, 100.0).otherwise(r * 100).alias("merge_percentage"),
        value(p).alias("precision"), value(r).alias("recall"), value(ratio(2 * p * r, p + r)).alias("f1"), value(r).alias("accuracy"), value(r / 2).alias("balanced_accuracy"),
        F.when(one, 0.0).otherwise(ratio(F.col("fn"), every)).alias("splitting"), F.lit(0.0).alias("lumping"),
    )


def merge_reasons(df: DataFrame, width: int | None = None) -> DataFrame:
    """(grp, all_merged, reason) of (grp, cluster, alias): which clusters a group fell into."""
    shown = F.substring("cluster", 1, width) if width else F.col("cluster")
    c = df.groupBy("grp", "cluster").agg(F.array_join(F.array_sort(F.collect_list("alias")), ", ").alias("members"))
    c = c.groupBy("grp").agg(F.count(F.lit(1)).alias("k"), F.array_sort(F.collect_list(F.struct("cluster", F.concat(F.lit("Cluster "), shown, F.lit(": "), "members").alias("t")))).alias("parts"))
    text = F.concat(F.col("k").cast("string"), F.lit(" separate clusters found. "), F.array_join(F.transform("parts", lambda x: x["t"]), "; "))
    return c.select("grp", (F.col("k") == 1).alias("all_merged"), F.when(F.col("k") > 1, text).otherwise("").alias("reason"))


def summary(groups: DataFrame) -> DataFrame:
    cols = ("merge_percentage", *RATIOS)
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("clusters") == 1).alias("merged"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if((F.col("n") > 1) & (F.col("clusters") == 1)).alias("multi_merged"), *[F.avg(c).alias(f"avg_{c}") for c in cols])


def cluster_sizes(df: DataFrame) -> DataFrame:
    c = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    return c.agg(F.count_if(F.col("k") > 1).alias("merged_clusters"), F.max("k").alias("largest"), F.count(F.lit(1)).alias("clusters"))


def t_quantile(p: float, df: int) -> float:
    """Inverse of Student's t distribution, by bisection on its integral."""
    log_c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)

    def below(t: float, n: int = 4000) -> float:  # with x = tan(u) the range is finite
        top = math.atan(t)
        f = lambda u: math.exp(log_c - (df + 1) / 2 * math.log1p(math.tan(u) ** 2 / df)) / math.cos(u) ** 2
        h = top / n
        return 0.5 + h / 3 * (f(0) + f(top) + sum((4 if i % 2 else 2) * f(i * h) for i in range(1, n)))

    low, high = 0.0, 1.0
    while below(high) < p and high < 1e6:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def unpivot(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]))).where("value is not null and not isnan(value)")


def t_intervals(long: DataFrame, ci: float = 0.95) -> DataFrame:
    """n, mean, std (population), median and the t interval of (metric, value). The quantile is
    looked up per number of values, of which there are at most as many as metrics."""
    g = long.groupBy("metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.median("value").alias("median"), F.stddev_samp("value").alias("sd"))
    sizes = sorted({r[0] for r in g.select("n").distinct().collect()})
    q = F.create_map(*[x for n in sizes for x in (F.lit(n), F.lit(t_quantile((1 + ci) / 2, n - 1) if n > 1 else 0.0))]) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(0.0))
    half = F.coalesce(F.col("sd"), F.lit(0.0)) / F.sqrt("n") * F.try_element_at(q, F.col("n"))
    return g.select("metric", "n", "mean", "std", "median", (F.col("mean") - half).alias("t_lower"), (F.col("mean") + half).alias("t_upper"))


def bootstrap_intervals(long: DataFrame, resamples: int = 10_000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile bootstrap of each metric's mean. Each value meets each resample a Poisson(1)
    number of times, drawn from a hash of metric, row and resample: one partial aggregation, no
    resample is ever gathered, and reruns agree."""
    d = long.withColumn("row", F.xxhash64("metric", "value", F.monotonically_increasing_id()))
    d = d.select("metric", "value", "row", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row", "b"), 11) / float(1 << 53)
    cut, k, total = F.lit(0), 0, 0.0
    while total < 1 - 1e-12:
        total += math.exp(-1) / math.factorial(k)
        cut, k = cut + (u >= total).cast("int"), k + 1
    means = d.withColumn("w", cut).groupBy("metric", "b").agg(F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m"))
    low, high = (1 - ci) / 2, (1 + ci) / 2
    return means.groupBy("metric").agg(F.percentile("m", F.lit(low)).alias("boot_lower"), F.percentile("m", F.lit(high)).alias("boot_upper"))


def interval_table(long: DataFrame, ci: int = 95, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row per metric of (metric, value): n, mean, std, median, and the bounds of both intervals at ``ci`` percent."""
    both = t_intervals(long, ci / 100).join(bootstrap_intervals(long, resamples, ci / 100, seed), "metric")
    bounds = [F.col(f"{c}_{side}").alias(f"{name}_ci_{ci}_{side}") for c, name in (("boot", "bootstrap"), ("t", "normal")) for side in ("lower", "upper")]
    return both.select("metric", "n", "mean", "std", "median", *bounds)

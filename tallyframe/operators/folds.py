"""Nested leave-one-source-out evaluation, and a probe within sources, from sufficient statistics.

The statistics of a fit (here of normal densities by class and feature) add up over rows. So one aggregation by
(source, inner fold, class) holds those of every training set there is: the total, less the source left out, less the
inner fold validated on. Every choice of the grid is then validated in one pass over the rows, and every source is
predicted by its own model in another, however many sources there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.storage import materialize

#: The tables of models are broadcast up to so many rows; they have sources * inner folds * choices rows.
BROADCAST_MODELS = 20_000


def inner_fold(group: Column, folds: int) -> Column:
    """The inner fold of a group, from a hash of its name: whole groups stay together."""
    return (F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def _with_terms(models: DataFrame, features: list[str], classes: list[str], choice: Column) -> DataFrame:
    """models with the terms of each class's log density, _t{class}_{term}, in place of the model: log n (-inf without
    training rows), and each feature's mean, variance and log variance for a smoothing. They are told once for each
    model, so that a row costs no logarithm, and its code stays small enough to be compiled."""
    terms = {}
    for i in range(len(classes)):
        m = F.col("model")[i]
        terms[f"_t{i}_p"] = F.when(m["n"] > 0, F.log(m["n"])).otherwise(F.lit(float("-inf")))
        for j in range(len(features)):
            mean = m["s"][j] / F.nullif(m["n"], F.lit(0.0))
            var = F.greatest(m["ss"][j] / F.nullif(m["n"], F.lit(0.0)) - mean * mean, F.lit(0.0)) + choice
            for x, term in (("m", mean), ("v", var), ("l", F.log(var))):
                terms[f"_t{i}_{x}{j}"] = F.when(m["n"] > 0, term)
    return models.withColumns(terms).drop("model")


def _with_said(df: DataFrame, features: list[str], classes: list[str]) -> DataFrame:
    """df, which has the terms of a model, with said: the class with the greatest joint log density; the first of equals,
    one without training rows never, null where no class has any."""
    scores = {}
    for i in range(len(classes)):
        score = F.col(f"_t{i}_p")
        for j, f in enumerate(features):
            away = F.col(f) - F.col(f"_t{i}_m{j}")
            score = score + -(F.col(f"_t{i}_l{j}") + away * away / F.col(f"_t{i}_v{j}")) / 2
        scores[f"_p{i}"] = F.coalesce(score, F.lit(float("-inf")))
    own = [F.col(x) for x in scores]
    top, pick = F.greatest(*own) if len(own) > 1 else own[0], F.lit(None).cast("string")
    for c, x in list(zip(classes, own, strict=True))[::-1]:
        pick = F.when(x == top, c).otherwise(pick)
    terms = [c for c in df.columns if c.startswith("_t")]
    return df.withColumns(scores).withColumn("said", F.when(top > float("-inf"), pick)).drop(*scores, *terms)


def macro_f1(counts: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """by.., rows, acc and macro_f1 (over the classes in truth, 0 where undefined) from counts n by truth and said."""
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    g = counts.groupBy(*by).agg(F.sum("n").alias("rows"), some(F.col("truth") == F.col("said")).alias("hits"), *[x for i, c in enumerate(classes) for x in (some((F.col("truth") == c) & (F.col("said") == c)).alias(f"h{i}"), some(F.col("truth") == c).alias(f"t{i}"), some(F.col("said") == c).alias(f"s{i}"))])
    there = [F.when(F.col(f"t{i}") > 0, 2 * F.col(f"h{i}") / (F.col(f"t{i}") + F.col(f"s{i}"))) for i in range(len(classes))]
    total, present = F.lit(0.0), F.lit(0)
    for f in there:
        total, present = total + F.coalesce(f, F.lit(0.0)), present + f.isNotNull().cast("int")
    return g.select(*by, "rows", (F.col("hits") / F.col("rows")).alias("acc"), (total / present).alias("macro_f1"))


def _rows(df: DataFrame, source: str, inner: Column, label: str, classes: list[str], features: list[str], mask: Column | None, *more: Column) -> DataFrame:
    """The rows that can be trained on or tested, as _source, _inner, truth, _use, the features and more."""
    use = F.coalesce(mask, F.lit(False)) if mask is not None else F.lit(True)
    own = df.select(F.col(source).alias("_source"), F.coalesce(inner, F.lit(0)).alias("_inner"), F.col(label).alias("truth"), use.alias("_use"), *[F.col(f).cast("double").alias(f) for f in features], *more)
    rows = own.where(F.col("truth").isin(classes)).dropna(subset=["_source", "truth", *features])
    for f in features:
        rows = rows.where(~F.isnan(f))
    return rows


def _names(features: list[str]) -> list[str]:
    """The columns of the statistics: rows, and each feature's sum and sum of squares."""
    return ["n", *[f"s{j}" for j in range(len(features))], *[f"q{j}" for j in range(len(features))]]


def _statistics(trained: DataFrame, features: list[str], *by: str) -> DataFrame:
    squares = [F.sum(F.col(f) * F.col(f)).alias(f"q{j}") for j, f in enumerate(features)]
    sums = [F.count("*").alias("n"), *[F.sum(f).alias(f"s{j}") for j, f in enumerate(features)], *squares]
    return materialize(trained.groupBy("_source", "_inner", "truth", *by).agg(*sums), "fold-statistics")


def _figures(stats: DataFrame) -> list[str]:
    return [c for c in stats.columns if c != "truth" and not c.startswith("_")]


def _added(stats: DataFrame, *by: str) -> DataFrame:
    return stats.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _figures(stats)])


def _without(part: DataFrame, by: list[str], base: DataFrame) -> DataFrame:
    """base less part, by class and by."""
    names = _figures(base)
    less = part.select("truth", *by, *[F.col(c).alias(f"_{c}") for c in names])
    return base.join(less, ["truth", *by], "left").select("truth", *by, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in names])


def _everywhere(stats: DataFrame, by: list[str], sources: DataFrame) -> DataFrame:
    """The rows of a table of classes (and inner folds), of which there are few, for each source."""
    found = stats.collect()  # at most classes * inner folds rows
    each = [F.struct(*[F.lit(r[c]).alias(c) for c in ("truth", *by, *_figures(stats))]) for r in found]
    return sources.select("_source", F.explode(F.array(*each)).alias("x")).select("_source", "x.*")


def _models(stats: DataFrame, by: list[str], classes: list[str], features: list[str]) -> DataFrame:
    """One row for each training set: by.. and model, the classes' statistics in an array."""
    arrays = lambda n, s, q: F.struct(n.cast("double").alias("n"), F.array(*s).alias("s"), F.array(*q).alias("ss"))
    places = range(len(features))
    told = arrays(F.col("n"), [F.col(f"s{j}") for j in places], [F.col(f"q{j}") for j in places])
    none = arrays(F.lit(0.0), [F.lit(0.0) for _ in places], [F.lit(0.0) for _ in places])
    return stats.groupBy(*by).agg(F.array(*[F.coalesce(F.max(F.when(F.col("truth") == c, told)), none) for c in classes]).alias("model"))


def _small(t: DataFrame, n: int) -> DataFrame:
    return F.broadcast(t) if n <= BROADCAST_MODELS else t


def _for_choices(models: DataFrame, grid: list[float], features: list[str], classes: list[str]) -> DataFrame:
    """Each model with each smoothing of a grid, as choice and terms."""
    each = models.withColumn("choice", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    return _with_terms(each, features, classes, F.col("choice"))


def nested_leave_one_out(df: DataFrame, source: str, group: Column, label: str, classes: list[str], features: list[str], grid: list[float], folds: int = 3, mask: Column | None = None) -> DataFrame:
    """fold, train, test, choice, inner_f1, acc, macro_f1: each source once as the test fold.

    For each source, every smoothing of the grid is fitted on the other sources' training rows without each inner fold
    and validated on that fold; the one with the greatest macro F1 over all inner folds (to nine places; the first of
    equals) is fitted on all the other sources' training rows and judged on the source's own rows. mask: the rows that
    may train (all are tested). Rows with a null or NaN in source, label or a feature, or of another class, are left
    out. A source for which no class can be trained says nothing and has null figures; without a training row there
    are no rows.
    """
    rows = _rows(df, source, inner_fold(group, folds), label, classes, features, mask)
    trained = rows.where("_use")
    if trained.limit(1).count() == 0:
        none = "fold string, train long, test long, choice double, inner_f1 double, acc double, macro_f1 double"
        return df.sparkSession.createDataFrame([], none)
    stats = _statistics(trained, features)
    sources = rows.select("_source").distinct()
    outer = _without(_added(stats, "truth", "_source"), ["_source"], _everywhere(_added(stats, "truth"), [], sources))  # classes x sources
    # from those the inner fold's rows of the other sources go too
    others = _without(stats, ["_source", "_inner"], _everywhere(_added(stats, "truth", "_inner"), ["_inner"], sources))
    spread = outer.withColumn("_inner", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    inner = _without(others, ["_source", "_inner"], spread)
    inner_models = _for_choices(_models(inner, ["_source", "_inner"], classes, features), grid, features, classes)
    inner_models = materialize(inner_models, "inner-models").withColumnRenamed("_source", "_held")
    n_models = inner_models.count()
    met = trained.join(_small(inner_models, n_models), "_inner").where(F.col("_source") != F.col("_held"))
    counts = _with_said(met, features, classes).groupBy("_held", "choice", "truth", "said").agg(F.count("*").alias("n"))
    scored = macro_f1(counts, ["_held", "choice"], classes)
    order = F.struct(F.round(-F.col("macro_f1"), 9).alias("f"), F.array_position(F.array(*[F.lit(float(g)) for g in grid]), F.col("choice")).alias("p"))
    chosen = scored.groupBy("_held").agg(F.min_by(F.struct("choice", "macro_f1"), order).alias("c"))
    sizes = outer.groupBy("_source").agg(F.sum("n").alias("train"))
    final = _models(outer, ["_source"], classes, features).join(chosen.withColumnRenamed("_held", "_source"), "_source", "left").join(sizes, "_source")
    final = final.select("_source", "model", "train", F.col("c.choice").alias("choice"), F.col("c.macro_f1").alias("inner_f1"))
    final = materialize(_with_terms(final, features, classes, F.col("choice")), "outer-models")
    met = _with_said(rows.join(_small(final, final.count()), "_source"), features, classes)
    tested = met.groupBy("_source", "train", "choice", "inner_f1", "truth", "said").agg(F.count("*").alias("n"))
    judged = macro_f1(tested, ["_source", "train", "choice", "inner_f1"], classes)
    told_any = F.col("choice").isNotNull()
    return judged.select(F.col("_source").alias("fold"), "train", F.col("rows").alias("test"), "choice", "inner_f1", F.when(told_any, F.col("acc")).alias("acc"), F.when(told_any, F.col("macro_f1")).alias("macro_f1"))


def leave_one_out_sweep(df: DataFrame, source: str, label: str, classes: list[str], features: list[str], grid: list[float], below: list[float], mask: Column | None = None, known: dict[float, float] | None = None, tolerance: float = 1e-6) -> DataFrame:
    """choice, mean_f1, worst_f1, pooled_f1, extended, best: every smoothing of the grid judged by leaving one source out.

    The whole grid goes through one pass over the rows, as all sources' models are at hand from their statistics. known:
    mean figures of earlier runs; one that is not met within the tolerance is an error, and nothing is chosen. If the best
    mean (the least choice of equals) is at the grid's lower end, the values of `below` are judged too, once. Rows are
    left out as in nested_leave_one_out; without a training row nothing is judged.
    """
    rows = _rows(df, source, F.lit(0), label, classes, features, mask)
    trained = rows.where("_use")
    if trained.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], "choice double, mean_f1 double, worst_f1 double, pooled_f1 double, extended boolean, best boolean")
    stats = _statistics(trained, features)
    outer = _without(_added(stats, "truth", "_source"), ["_source"], _everywhere(_added(stats, "truth"), [], rows.select("_source").distinct()))
    fitted = materialize(_models(outer, ["_source"], classes, features), "outer-models")
    n_models = fitted.count()

    def judged(choices: list[float]) -> DataFrame:
        terms = materialize(_for_choices(fitted, choices, features, classes), "choice-models")
        told = _with_said(rows.join(_small(terms, n_models * len(choices)), "_source"), features, classes)
        counts = materialize(told.groupBy("_source", "choice", "truth", "said").agg(F.count("*").alias("n")), "sweep")
        each = macro_f1(counts, ["_source", "choice"], classes).groupBy("choice").agg(F.avg("macro_f1").alias("mean_f1"), F.min("macro_f1").alias("worst_f1"))
        return each.join(macro_f1(counts, ["choice"], classes).select("choice", F.col("macro_f1").alias("pooled_f1")), "choice")

    found = judged(grid)
    means = {r["choice"]: r["mean_f1"] for r in found.collect()}  # a row a choice
    for choice, expected in (known or {}).items():
        if abs(means[float(choice)] - expected) > tolerance:
            raise ValueError(f"{choice} gives {means[float(choice)]}, not {expected} as before")
    top = lambda m: min(m, key=lambda g: (-round(m[g], 9), g))
    extended = bool(below) and top(means) == float(min(grid))
    if extended:
        more = judged(below)
        means |= {r["choice"]: r["mean_f1"] for r in more.collect()}
        found = found.unionByName(more)
    return found.select("choice", "mean_f1", "worst_f1", "pooled_f1", F.lit(extended).alias("extended"), (F.col("choice") == top(means)).alias("best"))


def within_source_probe(df: DataFrame, source: str, group: str, label: str, classes: list[str], features: list[str], smooth: float = 0.01, folds: int = 5, draws: int = 20, seed: int = 7) -> DataFrame:
    """source, rows, groups, acc, macro_f1, null_mean, null_low, null_high, p_value: can the features tell the class within
    one source? Features that should not know it (of borders, of a camera) and yet can are a shortcut.

    Groups are dealt to folds by a hash; each fold is predicted from the source's other folds. The null: `draws` times,
    each group gets one class for all its rows, drawn by a hash from the source's shares of groups (a group counts for its
    commonest class, of equals the first), and the same folds are judged again; its mean, least and greatest macro F1 and
    the share of draws, the real one among them, that do as well. Statistics of groups add up, so that the draws relabel
    groups, not rows, and all draws of all sources are one aggregation and one pass. A source of one group or one class has
    null figures; a row whose fold is all of its source counts as missed. Rows are left out as in nested_leave_one_out,
    those without a group too.
    """
    named = df.where(F.col(group).isNotNull())
    rows = _rows(named, source, inner_fold(F.col(group), folds), label, classes, features, None, F.col(group).cast("string").alias("_group"))
    stats = _statistics(rows, features, "_group")
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("truth"))
    own = stats.groupBy("_source", "_group").agg(F.max_by("truth", F.struct("n", -place)).alias("y"))
    per_class = [F.count_if(F.col("y") == c).alias(f"_c{i}") for i, c in enumerate(classes)]
    shares = own.groupBy("_source").agg(F.count("*").alias("_groups"), *per_class)
    shares = materialize(shares.join(stats.groupBy("_source").agg(F.count_distinct("truth").alias("_classes")), "_source"), "group-shares")
    n_sources = shares.count()

    def drawn() -> Column:
        """The class of _group in draw _draw; in draw 0 the row's own."""
        h = F.md5(F.concat_ws(":", F.lit(seed), "_draw", F.col("_source").cast("string"), "_group"))
        u = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(2.0**32) * F.col("_groups")
        below, pick = F.lit(0), F.lit(None).cast("string")
        cases = []
        for i, c in enumerate(classes):
            below = below + F.col(f"_c{i}")
            cases.append((u < below, c))
        for met, c in cases[::-1]:
            pick = F.when(met, c).otherwise(pick)
        return F.when(F.col("_draw") == 0, F.col("truth")).otherwise(pick)

    kept = ["_source", "_inner", "_draw", "truth", *_names(features)]
    spread = stats.join(_small(shares, n_sources), "_source").withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws))))
    per = materialize(_added(spread.withColumn("truth", drawn()).select(*kept), "_source", "_inner", "_draw", "truth"), "draw-statistics")
    each = _added(per, "_source", "_draw", "truth").withColumn("_inner", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    models = _models(_without(per, ["_source", "_inner", "_draw"], each), ["_source", "_inner", "_draw"], classes, features)
    models = _with_terms(models, features, classes, F.lit(float(smooth)))
    models = materialize(models.join(_small(shares, n_sources), "_source"), "draw-models")
    met = rows.join(_small(models, n_sources * folds * (draws + 1)), ["_source", "_inner"]).withColumn("truth", drawn())
    told = _with_said(met, features, classes)
    counts = told.groupBy("_source", "_draw", "truth", "said").agg(F.count("*").alias("n"))
    judged = macro_f1(counts, ["_source", "_draw"], classes).withColumn("_f", F.round("macro_f1", 9))
    real, null = F.col("_draw") == 0, F.when(F.col("_draw") > 0, F.col("macro_f1"))
    of = judged.groupBy("_source").agg(
        F.max(F.when(real, F.col("rows"))).alias("rows"), F.max(F.when(real, F.col("acc"))).alias("acc"), F.max(F.when(real, F.col("macro_f1"))).alias("macro_f1"),
        F.avg(null).alias("null_mean"), F.min(null).alias("null_low"), F.max(null).alias("null_high"), F.array_agg("_f").alias("_all"), F.max(F.when(real, F.col("_f"))).alias("_real"),
    )
    judgable = (F.col("_groups") > 1) & (F.col("_classes") > 1)
    p = F.size(F.filter("_all", lambda f: f >= F.col("_real"))) / (draws + 1)
    figures = {**{c: F.col(c) for c in ("acc", "macro_f1", "null_mean", "null_low", "null_high")}, "p_value": p}
    out = of.join(_small(shares, n_sources), "_source")
    return out.select(F.col("_source").alias("source"), "rows", F.col("_groups").alias("groups"), *[F.when(judgable, c).alias(n) for n, c in figures.items()])

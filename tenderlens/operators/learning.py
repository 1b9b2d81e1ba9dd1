"""Features and models: median imputation, isolation forest, vendor risk and price models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.storage import durable, partitions, stored

TREES, SAMPLE = 64, 256


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """The exact median of each column's values, 0 without any: equal values are merged and the middle ranks found by ranges' offsets, so no task holds a column."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in cols])).alias("v")).select("v.c", "v.x").filter("x is not null")
    per = long.groupBy("c", "x").agg(F.count(F.lit(1)).alias("k"))
    placed = durable(durable(per).repartitionByRange(partitions(df), "c", "x").withColumn("part", F.spark_partition_id()))
    runs = placed.groupBy("c", "part").agg(F.sum("k").alias("rows"))
    before = W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per column and range
    whole = W.partitionBy("c")
    runs = runs.select("c", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("n"))
    within = F.sum("k").over(W.partitionBy("c", "part").orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    ranked = placed.withColumn("last", within).join(F.broadcast(runs), ["c", "part"]).withColumn("last", F.col("last") + F.col("offset"))
    middle = lambda at: F.min(F.when(F.col("last") >= at, F.col("x")))
    found = ranked.groupBy("c").agg(((middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)) / 2).alias("m"))
    return {c: 0.0 for c in cols} | {r["c"]: r["m"] for r in found.collect()}  # one row per column


def impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls replaced by the column's exact median; ``df`` is written once, and only columns that hold nulls are ranked."""
    df = stored(df)
    nulls = df.agg(*[F.count_if(F.col(c).cast("double").isNull()).alias(c) for c in cols]).first()
    gaps = [c for c in cols if nulls[c]]
    middle = medians(df, gaps) if gaps else {}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c]))) if c in middle else F.col(c).cast("double") for c in cols})


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns in population standard deviations from their mean (0 where all are equal)."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    z = lambda c: F.when(F.col(f"__s_{c}") > 0, (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}"))).otherwise(0.0)
    return out.withColumns({c: z(c) for c in cols}).drop(*[f"__{n}_{c}" for c in cols for n in "ms"])


def path_norm(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[list[float]]:
    """Nodes (feature or -1, cut or leaf depth, left, right) of one tree."""
    nodes: list[list[float]] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, depth + path_norm(len(rows)), -1, -1])
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            low = rows[:, f] < cut
            if low.any() and not low.all():
                nodes[at] = [f, cut, add(rows[low], depth + 1), add(rows[~low], depth + 1)]
        return at

    add(x, 0)
    return nodes


def walkable(tree: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(levels, feature, cut, right child, leaf depth) of a tree whose left children stand just before the right ones; a leaf is its own right child and no value is below its cut."""
    order, level, last = [0], [0], 0
    place = np.zeros(len(tree), np.int64)
    while last < len(order):  # by levels, both children together
        at = order[last]
        if tree[at, 0] >= 0:
            for child in tree[at, 2:].astype(np.int64).tolist():
                place[child] = len(order)
                order.append(child)
                level.append(level[last] + 1)
        last += 1
    nodes = tree[order]
    inner = nodes[:, 0] >= 0
    right = np.where(inner, place[nodes[:, 3].astype(np.int64)], np.arange(len(order)))
    return max(level), np.maximum(nodes[:, 0], 0).astype(np.int64), np.where(inner, nodes[:, 1], -np.inf), right, np.where(inner, 0.0, nodes[:, 1])


def depths(tree: tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    levels, feature, cut, right, depth = tree
    flat, row = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    at = np.zeros(len(x), np.int64)
    for _ in range(levels):
        at = right.take(at) - (flat.take(row + feature.take(at)) < cut.take(at))
    return depth.take(at)


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], contamination: float = 0.1, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(key, score, is_anomaly, top_feature): one tree per group on a hashed sample of about ``sample`` rows, scored in batches.

    The forest (trees x about twice the sample in nodes) is bounded and sent to all tasks; a row is
    scored once, and the scores are written.
    Members are drawn alike at every size: each row belongs to a tree with the same chance.
    """
    z = stored(standardise(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]), cols))
    n = z.count()
    # a row's number of trees follows from one hash; most rows of a large table are in none and are not multiplied
    chance = min(1.0, sample / max(n, 1))
    drawn = lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col(key), t), F.lit(1_000_000_000)) < int(chance * 1_000_000_000)
    picked = z.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), drawn)))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(key)[list(cols)].to_numpy(float)
        nodes = grow(rows, np.random.default_rng(seed * 1000 + tree), max(1, math.ceil(math.log2(max(2, len(rows))))))
        return pd.DataFrame({"tree": [tree], "size": [len(rows)], "nodes": [np.asarray(nodes, float).ravel().tolist()]})

    forest = [(r["size"], walkable(np.asarray(r["nodes"]).reshape(-1, 4))) for r in picked.groupBy("tree").applyInPandas(fit, "tree int, size int, nodes array<double>").orderBy("tree").collect()]
    norm = float(np.mean([path_norm(max(2, s)) for s, _ in forest])) if forest else 1.0
    names = list(cols)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[names].to_numpy(float)
            depth = np.mean([depths(t, x) for _, t in forest], axis=0) if len(x) else np.zeros(0)
            top = [names[i] for i in np.abs(x).argmax(axis=1)] if len(x) else []
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-depth / norm), "top_feature": top})

    kind = dict(df.dtypes)[key]
    scored = stored(z.mapInPandas(score, f"{key} {kind}, score double, top_feature string"))
    bar = scored.agg(F.percentile_approx("score", 1 - contamination, 10000).alias("bar"))
    return scored.crossJoin(F.broadcast(bar)).select(key, "score", (F.col("score") >= F.col("bar")).alias("is_anomaly"), "top_feature")  # one row


#: Values tried of each model of the vote: depths of boosted trees and of the forest, strengths of the regression's penalty.
GRID = {"boosted": (2, 3), "forest": (4, 6), "logistic": (0.01, 0.1)}


def soft_vote(train: DataFrame, rows: DataFrame, cols: Sequence[str], label: str, key: str, least: int = 10, folds: int = 3, grid: dict[str, Sequence] = GRID) -> DataFrame | None:
    """Adds ``probability``: the mean of boosted trees, random forest and logistic regression; None below ``least`` rows or with one class.

    Each model's value of ``grid`` is the one with the best area under the curve over folds given
    by a hash of ``key``, so that reruns agree.  Where some fold lacks a class there is nothing to
    compare, and the first values are taken.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    fold = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(folds)).cast("int")
    train = train.withColumn("label", F.col(label).cast("double")).withColumn("fold", fold)
    seen = train.groupBy("label", "fold").count().collect()  # two rows a fold
    if len({r["label"] for r in seen}) < 2 or sum(r["count"] for r in seen) < least:
        return None
    prepare = Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(train)
    data, out = durable(prepare.transform(train).select("features", "label", "fold")), prepare.transform(rows)
    boosted, forest, logistic = GBTClassifier(maxIter=10, maxDepth=grid["boosted"][0], seed=7), RandomForestClassifier(numTrees=30, maxDepth=grid["forest"][0], seed=7), LogisticRegression(regParam=grid["logistic"][0])
    tried = [(boosted, boosted.maxDepth, grid["boosted"]), (forest, forest.maxDepth, grid["forest"]), (logistic, logistic.regParam, grid["logistic"])]
    for i, (model, param, values) in enumerate(tried):
        if len(seen) == 2 * folds and len(values) > 1:
            search = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().addGrid(param, list(values)).build(), evaluator=BinaryClassificationEvaluator(), numFolds=folds, foldCol="fold", parallelism=4)
            fitted = search.fit(data).bestModel
        else:
            fitted = model.fit(data)
        out = fitted.transform(out).withColumn(f"p{i}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    return out.withColumn("probability", (F.col("p0") + F.col("p1") + F.col("p2")) / 3).drop("p0", "p1", "p2", "raw", "features")


def linear_forecast(series: DataFrame, key: str, month: str, price: str, horizon: int = 3, margin: float = 0.02) -> DataFrame:
    """(key, step, month, forecast, low, high, optimistic, pessimistic, error, last): each series' least-squares line, continued.

    The bounds are ``margin`` of the forecast for each step ahead; ``error`` is the standard error
    of a new value on the line, null under three values.  One value is continued as it is.
    """
    w = W.partitionBy(key).orderBy(month)
    o = series.select(key, month, F.col(price).alias("y"), F.row_number().over(w).cast("double").alias("x"))
    a = o.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.max(month).alias("m"), F.max_by("y", "x").alias("last"),
    )
    steps = a.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("away", F.col("n") + F.col("step") - F.col("mx"))
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")) / F.when(F.col("n") > 2, F.col("n") - 2)
    y, wide = F.col("my") + F.col("slope") * F.col("away"), F.lit(margin) * F.col("step")
    out = steps.withColumn("forecast", y).withColumn("error", F.sqrt(rest * (1 + 1 / F.col("n") + F.col("away") * F.col("away") / F.when(F.col("sxx") > 0, F.col("sxx")))))
    f = F.col("forecast")
    return out.select(key, "step", F.add_months("m", F.col("step")).alias("month"), "forecast", (f - F.abs(f) * wide).alias("low"), (f + F.abs(f) * wide).alias("high"), (f * 0.96).alias("optimistic"), (f * 1.05).alias("pessimistic"), "error", "last")


def forecast(series: DataFrame, key: str, month: str, price: str, horizon: int = 3, least: int = 12, held: int = 3) -> DataFrame:
    """(key, step, forecast, low, high, last, engine): the next months' prices of each series of monthly means.

    Series with ``least`` usable months and more: boosted trees and a forest over seasonal and
    lagged features, blended by a ridge regression on the last ``held`` months and fed with their
    own forecasts; bounds are the series' mean relative error on these months.  Shorter ones, and
    all where no series is long enough, are continued by ``linear_forecast``.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    base = durable(series.select(F.col(key).alias("k"), F.col(month).cast("timestamp").alias("m"), F.col(price).cast("double").alias("p")))
    w = W.partitionBy("k").orderBy("m")
    season = lambda m: (F.sin(2 * F.pi() * F.month(m) / 12).alias("s"), F.cos(2 * F.pi() * F.month(m) / 12).alias("c"))
    lags = (F.lag("p").over(w).alias("l1"), F.avg("p").over(w.rowsBetween(-3, -1)).alias("sma"), (F.lag("p").over(w) - F.lag("p", 2).over(w)).alias("momentum"))
    lagged = base.select("k", "m", "p", F.row_number().over(w).cast("double").alias("idx"), F.count(F.lit(1)).over(W.partitionBy("k")).alias("n"), *season("m"), *lags).dropna()
    lagged = lagged.filter(F.col("n") - 2 >= least)  # the first two months have no momentum
    cols = ["idx", "s", "c", "l1", "sma", "momentum"]
    make = VectorAssembler(inputCols=cols, outputCol="features")
    data = durable(make.transform(lagged))
    line = lambda rows: linear_forecast(rows, "k", "m", "p", horizon).select(F.col("k").alias(key), "step", "forecast", "low", "high", "last", F.lit("linear").alias("engine"))
    if data.isEmpty():
        return line(base)
    train, late = data.filter(F.col("idx") <= F.col("n") - held), data.filter(F.col("idx") > F.col("n") - held)
    models = [GBTRegressor(labelCol="p", maxIter=10, maxDepth=3, seed=7).fit(train), RandomForestRegressor(labelCol="p", numTrees=20, maxDepth=4, seed=7).fit(train)]

    def predict(df: DataFrame) -> DataFrame:
        for i, m in enumerate(models):
            df = m.transform(df).withColumnRenamed("prediction", f"y{i}")
        return VectorAssembler(inputCols=["y0", "y1"], outputCol="meta").transform(df)

    blend = LinearRegression(labelCol="p", featuresCol="meta", regParam=1.0).fit(predict(late))
    error = blend.transform(predict(late)).groupBy("k").agg(F.avg(F.abs(F.col("prediction") - F.col("p")) / F.abs(F.when(F.col("p") != 0, F.col("p")))).alias("mape"))
    state, out = data.filter(F.col("idx") == F.col("n")).drop("features").withColumn("last", F.col("p")), None
    for h in range(1, horizon + 1):
        ahead = state.select("k", F.add_months("m", 1).cast("timestamp").alias("m"), (F.col("idx") + 1).alias("idx"), F.col("p").alias("l1"), ((2 * F.col("sma") + F.col("p")) / 3).alias("sma"), (F.col("p") - F.col("l1")).alias("momentum"), "last")
        step = blend.transform(predict(make.transform(ahead.select("*", *season("m")))))
        state = durable(step.select("k", "m", "idx", F.col("prediction").alias("p"), "l1", "sma", "last"))
        one = state.select("k", F.lit(h).alias("step"), F.col("p").alias("forecast"), "last")
        out = one if out is None else out.unionByName(one)
    f, e = F.col("forecast"), F.coalesce("mape", F.lit(0.0))
    long = out.join(error, "k").select(F.col("k").alias(key), "step", "forecast", (f - F.abs(f) * e).alias("low"), (f + F.abs(f) * e).alias("high"), "last", F.lit("ensemble").alias("engine"))
    return long.unionByName(line(base.join(data.select("k").distinct(), "k", "left_anti")))

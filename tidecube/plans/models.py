"""Models: forests, boosting and clusters on Spark ML; mixtures and a self-organising map by sums over tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecube.operators.ordering import quantiles, written
from tidecube.sources.store import shared_folder


@dataclass(frozen=True)
class Size:
    """Sizes of the tree models; the defaults are the production ones."""

    trees: int = 300
    depth: int = 20
    leaf: int = 5
    rounds: int = 300
    step: float = 0.05


def vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(df)


def forest(df: DataFrame, features: Sequence[str], target: str, size: Size = Size(), weight: str | None = None, bootstrap: bool = True, seed: int = 42) -> PipelineModel:
    """A random forest; without ``bootstrap`` every tree sees all rows and a third of the features a split, which stands in for extremely randomised trees."""
    options = {"weightCol": weight} if weight else {}
    model = RandomForestRegressor(featuresCol="__x", labelCol=target, numTrees=size.trees, maxDepth=size.depth, minInstancesPerNode=size.leaf, featureSubsetStrategy="all" if bootstrap else "onethird", bootstrap=bootstrap, seed=seed, **options)
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")
    return PipelineModel([assembler, model.fit(assembler.transform(df))])


def boosting(df: DataFrame, features: Sequence[str], target: str, size: Size = Size(), depth: int = 5, seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip")
    model = GBTRegressor(featuresCol="__x", labelCol=target, maxIter=size.rounds, stepSize=size.step, maxDepth=depth, seed=seed)
    return PipelineModel([assembler, model.fit(assembler.transform(df))])


def predict(model: PipelineModel, df: DataFrame, name: str = "prediction") -> DataFrame:
    """df with the prediction, never below 0."""
    return model.transform(df).withColumn(name, F.greatest("prediction", F.lit(0.0))).drop("__x", *(["prediction"] if name != "prediction" else []))


def importances(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """(feature, importance), the greatest first."""
    values = model.stages[-1].featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


@dataclass(frozen=True)
class Mixture:
    """A Gaussian mixture over scaled features."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) [row, component] of raw feature rows."""
        z = (x - self.mean) / self.scale
        out = np.empty((len(z), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances)):
            root = jittered_root(c)
            y = np.linalg.solve(root, (z - m).T)
            out[:, k] = np.log(max(w, 1e-300)) - 0.5 * ((y * y).sum(0) + len(m) * np.log(2 * np.pi)) - np.log(np.diag(root)).sum()
        return out

    def marginal(self, features: Sequence[str]) -> Mixture:
        """The same mixture over some of its features: the others' rows and columns are dropped."""
        at = [self.features.index(f) for f in features]
        return Mixture(tuple(features), self.mean[at], self.scale[at], self.weights, self.means[:, at], self.covariances[:, at][:, :, at])

    def report(self) -> list[dict]:
        """Weight, and mean and deviation of every feature in its own unit, for each component."""
        raw = self.means * self.scale + self.mean
        dev = np.sqrt(np.diagonal(self.covariances, axis1=1, axis2=2)) * self.scale
        return [{"component": k, "weight": float(w), **{f"{f}_mean": float(raw[k, i]) for i, f in enumerate(self.features)}, **{f"{f}_std": float(dev[k, i]) for i, f in enumerate(self.features)}} for k, w in enumerate(self.weights)]


def jittered_root(c: np.ndarray, jitter: float = 1e-6, tries: int = 5) -> np.ndarray:
    """The Cholesky root, with more and more on the diagonal until there is one."""
    for _ in range(tries):
        try:
            return np.linalg.cholesky(c + np.eye(len(c)) * jitter)
        except np.linalg.LinAlgError:
            jitter *= 10
    raise np.linalg.LinAlgError("covariance is not positive")


#: Rows of a block that a pass over a mixture's rows reads at once, rows of which densities are in memory, and rows for each component that its start is found on.
BLOCK_ROWS, SLICE_ROWS, START_ROWS = 32_768, 4_096, 200
#: A fit ends when a row's mean log likelihood gains less.
GAIN = 1e-3


def mixture(df: DataFrame, features: Sequence[str], k: int = 30, seed: int = 42, rounds: int = 100) -> tuple[Mixture, float]:
    """(mixture, log likelihood) of features that are scaled by their population deviation, by expectation and maximisation over all rows.

    Rows are written once, as blocks of scaled columns. In a round each task sums responsibilities times (1, x, products of x) over its blocks: what
    returns is one short row a component and task. The start is a clustering of some rows, the first by hash; rounds end when a row's mean log likelihood
    gains less than GAIN, as in the surveyed code. No rows are an error.
    """
    f = list(features)
    own = written(df.select(*(F.col(c).cast("double").alias(c) for c in f)).na.drop())
    n, *stats = own.agg(F.count("*"), *(x for c in f for x in (F.avg(c), F.stddev_pop(c)))).first()
    if not n:
        raise ValueError("no rows to fit a mixture to")
    mean, scale = np.array(stats[::2], float), np.array([s or 1.0 for s in stats[1::2]], float)
    first = np.array(own.orderBy(F.xxhash64(*f, F.lit(seed)), *f).limit(START_ROWS * k).collect(), float).reshape(-1, len(f))
    m = _start((first - mean) / scale, k, seed, tuple(f), mean, scale)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([((np.concatenate(held) - mean) / scale).tobytes()], pa.binary())], names=["z"])
                held, rows = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([((np.concatenate(held) - mean) / scale).tobytes()], pa.binary())], names=["z"])

    blocks = written(own.mapInArrow(packed, "z binary").repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, n * len(f) * 8 >> 26)))
    before = -np.inf
    for _ in range(rounds):
        total, sums = _expected(blocks, m)
        if total / n - before < GAIN:
            break
        before, last = total / n, m
        m = _maximised(sums, last)
    else:
        total, _ = _expected(blocks, m)
    return m, float(total)


def _products(z: np.ndarray) -> np.ndarray:
    """1, x and the products of every two x (i <= j) of each row."""
    i, j = np.triu_indices(z.shape[1])
    return np.concatenate([np.ones((len(z), 1)), z, z[:, i] * z[:, j]], 1)


def _expected(blocks: DataFrame, m: Mixture) -> tuple[float, np.ndarray]:
    """(log likelihood, sums of responsibility * products [component, product]) over all rows."""
    d, (i, j) = len(m.features), np.triu_indices(len(m.features))
    table = np.empty((1 + d + len(i), len(m.weights)))  # a row's products times this are its log(weight * density)
    for c, (w, mu, cov) in enumerate(zip(m.weights, m.means, m.covariances)):
        root = jittered_root(cov)
        inverse = np.linalg.inv(root)
        p = inverse.T @ inverse
        table[0, c] = np.log(max(w, 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + mu @ p @ mu) - np.log(np.diag(root)).sum()
        table[1 : 1 + d, c] = p @ mu
        table[1 + d :, c] = np.where(i == j, -0.5, -1.0) * p[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0.0, np.zeros(table.shape[::-1])
        for batch in batches:
            for cell in batch.column(0):
                z = np.frombuffer(cell.as_buffer()).reshape(-1, d)
                for lo in range(0, len(z), SLICE_ROWS):
                    x = _products(z[lo : lo + SLICE_ROWS])
                    r = x @ table
                    top = r.max(1)
                    r -= top[:, None]
                    np.exp(r, out=r)
                    whole = r.sum(1)
                    total += float((top + np.log(whole)).sum())
                    sums += (r / whole[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([sums.tobytes()], pa.binary())], names=["total", "sums"])

    got = blocks.mapInArrow(run, "total double, sums binary").collect()  # one row a task
    return sum(r.total for r in got), np.sum([np.frombuffer(r.sums).reshape(table.shape[::-1]) for r in got], axis=0)


def _maximised(sums: np.ndarray, m: Mixture) -> Mixture:
    """The mixture of these sums; a component without rows stays where it is."""
    d, (i, j) = len(m.features), np.triu_indices(len(m.features))
    n = sums[:, 0]
    some = n > 10 * np.finfo(float).eps
    x = sums / np.where(some, n, 1.0)[:, None]
    cov = np.zeros((len(n), d, d))
    cov[:, i, j] = cov[:, j, i] = x[:, 1 + d :] - x[:, 1 + i] * x[:, 1 + j]
    means = np.where(some[:, None], x[:, 1 : 1 + d], m.means)
    return Mixture(m.features, m.mean, m.scale, n / n.sum(), means, np.where(some[:, None, None], cov, m.covariances))


def _start(z: np.ndarray, k: int, seed: int, features: tuple[str, ...], mean: np.ndarray, scale: np.ndarray, rounds: int = 20) -> Mixture:
    """The mixture of k clusters of a few rows: centres drawn far apart, then moved to their rows' means."""
    draw = np.random.default_rng(seed)
    centres = z[[int(draw.integers(len(z)))]]
    near = ((z - centres[0]) ** 2).sum(1)
    while len(centres) < k:
        pick = int(draw.choice(len(z), p=near / near.sum())) if near.sum() > 0 else int(draw.integers(len(z)))
        centres = np.concatenate([centres, z[[pick]]])
        near = np.minimum(near, ((z - z[pick]) ** 2).sum(1))
    for _ in range(rounds):
        at = ((z[:, None] - centres[None, :]) ** 2).sum(2).argmin(1)
        count = np.bincount(at, minlength=k)
        moved = np.stack([np.bincount(at, z[:, i], k) for i in range(z.shape[1])], 1) / np.maximum(count, 1)[:, None]
        centres = np.where(count[:, None] > 0, moved, centres)
    one = np.eye(k)[((z[:, None] - centres[None, :]) ** 2).sum(2).argmin(1)]
    whole = np.cov(z.T, bias=True).reshape(z.shape[1], z.shape[1])
    return _maximised(one.T @ _products(z), Mixture(features, mean, scale, np.full(k, 1 / k), centres, np.repeat(whole[None], k, 0)))


def information_criteria(log_likelihood: float, n: int, k: int, d: int) -> dict[str, float]:
    params = k * (1 + d + d * (d + 1) / 2) - 1
    return {"bic": -2 * log_likelihood + params * np.log(n), "aic": -2 * log_likelihood + 2 * params, "score": log_likelihood / n}


def component_sweep(df: DataFrame, features: Sequence[str], target: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """One row for each k: criteria of the mixture of the positive rows, and how many of them (and which share) each component has; null beyond k."""
    pos = df.where(F.col(target) > 0).na.drop(subset=list(features))
    n = pos.count()
    rows = []
    for k in ks:
        m, ll = mixture(pos, features, k, seed)
        counts = dict(with_component(pos.select(*features), m, probabilities=False).groupBy("component").count().collect())  # one row a component
        own = [counts.get(c, 0) if c < len(m.weights) else None for c in range(max(ks))]
        parts = [x for c in own for x in (c, None if c is None else c / n)]
        rows.append((k, n, *(float(v) for v in information_criteria(ll, n, k, len(features)).values()), *parts))
    kinds = ", ".join(f"component_{c}_positive_rows long, component_{c}_positive_fraction double" for c in range(max(ks)))
    return df.sparkSession.createDataFrame(rows, f"k long, positive_rows long, bic double, aic double, score double, {kinds}").orderBy("bic", "k")


def with_log_density(df: DataFrame, m: Mixture, name: str = "log_density") -> DataFrame:
    return _scored(df, m, {name: "double"}, lambda j: {name: np.logaddexp.reduce(j, axis=1)})


def with_component(df: DataFrame, m: Mixture, probabilities: bool = True) -> DataFrame:
    """df with component, its probability, the normalised entropy and, if asked for, all probabilities (an array)."""

    def of(j: np.ndarray) -> dict:
        p = np.exp(j - np.logaddexp.reduce(j, axis=1)[:, None])
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1) / np.log(max(2, p.shape[1]))
        return {"component": p.argmax(1), "component_probability": p.max(1), "component_entropy": h, **({"probabilities": p} if probabilities else {})}

    kinds = {"component": "long", "component_probability": "double", "component_entropy": "double"}
    return _scored(df, m, {**kinds, **({"probabilities": "array<double>"} if probabilities else {})}, of)


def _scored(df: DataFrame, m: Mixture, kinds: dict[str, str], of) -> DataFrame:
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(", ".join(f"{k} {t}" for k, t in kinds.items())).fields])

    def column(v: np.ndarray) -> pa.Array:
        return pa.array(v) if v.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.int32()), pa.array(v.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False).astype(float) for c in m.features], 1)
            found = of(m.log_joint(x))
            yield pa.RecordBatch.from_arrays([*b.columns, *(column(found[c]) for c in kinds)], names=schema.names)

    return df.na.drop(subset=list(m.features)).mapInArrow(run, schema)


def from_probabilities(df: DataFrame, column: str = "probabilities") -> DataFrame:
    """df with component (the first of the greatest), component_probability and component_entropy of an array of probabilities."""
    p = F.col(column)
    top = F.array_max(p)
    terms = F.transform(p, lambda x: F.when(x > 0, -x * F.ln(x)).otherwise(0.0))
    entropy = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.ln(F.greatest(F.size(p), F.lit(2)).cast("double"))
    return df.withColumn("component", F.array_position(p, top) - 1).withColumn("component_probability", top).withColumn("component_entropy", entropy)


def density_regressor(df: DataFrame, features: Sequence[str], target: str, k: int = 30, seed: int = 42) -> tuple[Mixture, float, float, float]:
    """(mixture of the positive rows, 1 % and 99 % quantiles of their log density, 99 % quantile of their target)."""
    pos = written(df.where(F.col(target) > 0).select(*dict.fromkeys([*features, target])))  # read four times
    m, _ = mixture(pos, features, k, seed)
    lo, hi = quantiles(with_log_density(pos, m), F.col("log_density"), [0.01, 0.99]).first()[0]
    return m, lo, hi, quantiles(pos, F.col(target), [0.99]).first()[0][0]


def density_score(df: DataFrame, model: tuple[Mixture, float, float, float], name: str = "density_log") -> DataFrame:
    from tidecube.plans.scoring import plausibility

    m, lo, hi, top = model
    return with_log_density(df, m).withColumn("plausibility", plausibility(F.col("log_density"), F.lit(lo), F.lit(hi))).withColumn(name, F.col("plausibility") * top)


def blended(df: DataFrame, density: str, prior: str, name: str) -> DataFrame:
    """Half the density score, half the boosted prior."""
    return df.withColumn(name, 0.5 * F.col(density) + 0.5 * F.greatest(F.col(prior), F.lit(0.0)))


def density_and_prior(train: DataFrame, df: DataFrame, features: Sequence[str], target: str, k: int = 30, size: Size = Size(rounds=150), seed: int = 42) -> DataFrame:
    """df with density_log, prior and their blend, score; both models are fitted to ``train``.

    The production prior has 15 leaves a tree; Spark has no cap of leaves, and depth 4 (16 leaves) is the nearest.
    """
    density = density_regressor(train, features, target, k, seed)
    prior = boosting(train, features, target, size, depth=4, seed=seed)
    return blended(predict(prior, density_score(df, density), "prior"), "density_log", "prior", "score")


def clusters(df: DataFrame, features: Sequence[str], k: int = 30, seed: int = 42) -> DataFrame:
    """df with seascape and seascape_distance of k means on scaled features."""
    x = vectors(df, features)
    z = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(x).transform(x)
    model = KMeans(featuresCol="__z", predictionCol="seascape", k=k, seed=seed).fit(z)
    centres = [c.tolist() for c in model.clusterCenters()]
    out = model.transform(z).withColumn("__a", vector_to_array("__z"))
    return out.withColumn("seascape", F.col("seascape").cast("long")).withColumn("seascape_distance", _distance(F.col("__a"), F.element_at(F.lit(centres), (F.col("seascape") + 1).cast("int")))).drop("__x", "__z", "__a")


def _distance(a, b):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def silhouette(df: DataFrame, features: Sequence[str], cls: str = "seascape") -> float:
    return ClusteringEvaluator(featuresCol="__x", predictionCol=cls).evaluate(vectors(df, features))


def nearest_prototype(df: DataFrame, prototypes: DataFrame, vector: str, key: str = "prototype", tie_digits: int = 9) -> DataFrame:
    """df with the nearest prototype (key, prototype_vector) and its distance; ties go to the lowest key.

    Prototypes are a few hundred: they are one array, and each row takes the least (distance, key) of it.
    """
    every = prototypes.agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("prototype_vector").alias("v"))).alias("__p"))
    found = F.array_min(F.transform("__p", lambda p: F.struct(F.round(_distance(F.col(vector), p["v"]), tie_digits).alias("d"), p["k"].alias("k"))))
    return df.join(every, F.lit(True)).withColumn("__f", found).withColumn(key, F.col("__f.k")).withColumn("distance", F.col("__f.d")).drop("__p", "__f")


@dataclass(frozen=True)
class Map:
    """A self-organising map: a vector for each node of a side * side grid, in scaled units."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    nodes: np.ndarray
    side: int

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest node, its distance, second nearest node) of raw rows."""
        z = (x - self.mean) / self.scale
        d = np.maximum((z * z).sum(1)[:, None] - 2 * z @ self.nodes.T + (self.nodes * self.nodes).sum(1)[None, :], 0)
        every, first = np.arange(len(z)), d.argmin(1)  # of equals the first, as a stable order has it
        least = d[every, first]
        d[every, first] = np.inf
        return first, np.sqrt(least), d.argmin(1)

    def nearest_one(self, x: np.ndarray) -> np.ndarray:
        """The nearest node of raw rows, by the same numbers as ``nearest``."""
        z = (x - self.mean) / self.scale
        return np.maximum((z * z).sum(1)[:, None] - 2 * z @ self.nodes.T + (self.nodes * self.nodes).sum(1)[None, :], 0).argmin(1)


def self_organising_map(df: DataFrame, features: Sequence[str], side: int = 15, epochs: int = 12, sigma: float = 2.0, seed: int = 42) -> Map:
    """Batch training: each epoch every task sums its rows by nearest node, and the sums, smoothed over the grid, give the nodes.

    What returns from an epoch is one row a node. The start is a plane spanned by the two main axes of the data. The
    features are written once, and every epoch reads them.
    """
    f = list(features)
    path = shared_folder(df.sparkSession, "map")
    df.select(*f).na.drop().repartition(4 * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)  # every epoch keeps all cores busy
    own = df.sparkSession.read.parquet(path)
    stats = own.agg(*(x for c in f for x in (F.avg(c), F.stddev_pop(c))), *(F.covar_pop(a, b) for a in f for b in f)).first()
    mean = np.array(stats[0 : 2 * len(f) : 2], float)
    scale = np.array([s or 1.0 for s in stats[1 : 2 * len(f) : 2]], float)
    cov = np.array(stats[2 * len(f) :], float).reshape(len(f), len(f)) / np.outer(scale, scale)
    values, axes = np.linalg.eigh(cov)
    steps = np.linspace(-1, 1, side)
    second = axes[:, -2] * np.sqrt(max(values[-2], 0)) if len(f) > 1 else np.zeros(len(f))
    nodes = np.array([a * axes[:, -1] * np.sqrt(max(values[-1], 0)) + b * second for a in steps for b in steps])
    at = np.array([(i, j) for i in range(side) for j in range(side)], float)
    apart = ((at[:, None] - at[None, :]) ** 2).sum(2)
    for epoch in range(epochs):
        m = Map(tuple(f), mean, scale, nodes, side)

        def run(parts: Iterator[pd.DataFrame], m: Map = m) -> Iterator[pd.DataFrame]:
            n, total = np.zeros(side * side, np.int64), np.zeros((side * side, len(f)))
            for p in parts:
                x = p.to_numpy(float)
                best = m.nearest_one(x)
                n += np.bincount(best, minlength=len(n))
                for i, z in enumerate(((x - m.mean) / m.scale).T):
                    total[:, i] += np.bincount(best, z, len(n))
            hit = np.flatnonzero(n)
            yield pd.DataFrame({"node": hit, "n": n[hit], "total": list(total[hit])})

        sums = own.mapInPandas(run, "node long, n long, total array<double>").groupBy("node").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(len(f)))).toPandas()
        count, total = np.zeros(side * side), np.zeros((side * side, len(f)))
        count[sums["node"]] = sums["n"]
        total[sums["node"]] = sums[[f"t{i}" for i in range(len(f))]].to_numpy(float)
        width = sigma * (1 - epoch / epochs) + 0.3
        h = np.exp(-apart / (2 * width * width))
        weight = h @ count
        nodes = np.where(weight[:, None] > 0, (h @ total) / np.maximum(weight, 1e-12)[:, None], nodes)
    return Map(tuple(f), mean, scale, nodes, side)


def with_prototype(df: DataFrame, m: Map) -> DataFrame:
    """df with som_prototype, seascape_distance and neighbors (whether the two nearest nodes are beside each other)."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string("som_prototype long, seascape_distance double, beside boolean").fields])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            a, d, b = m.nearest(p[list(m.features)].to_numpy(float))
            beside = np.maximum(np.abs(a // m.side - b // m.side), np.abs(a % m.side - b % m.side)) <= 1
            yield p.assign(som_prototype=a, seascape_distance=d, beside=beside)

    return df.na.drop(subset=list(m.features)).mapInPandas(run, schema)


def map_errors(placed: DataFrame) -> DataFrame:
    """One row: mean distance to the nearest node, and the share of rows whose two nearest nodes are apart."""
    return placed.agg(F.avg("seascape_distance").alias("quantization_error"), F.avg((~F.col("beside")).cast("double")).alias("topographic_error"))


def ward(nodes: np.ndarray, k: int) -> np.ndarray:
    """Classes 0 to k-1 of a few hundred prototypes by Ward's linkage, numbered by their first member."""
    n = len(nodes)
    size, alive, member = np.ones(n), list(range(n)), {i: [i] for i in range(n)}
    d = ((nodes[:, None] - nodes[None, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    while len(alive) > k:
        sub = d[np.ix_(alive, alive)]
        i, j = sorted(alive[x] for x in np.unravel_index(sub.argmin(), sub.shape))
        for o in alive:
            if o not in (i, j):
                total = size[i] + size[j] + size[o]
                d[i, o] = d[o, i] = ((size[i] + size[o]) * d[i, o] + (size[j] + size[o]) * d[j, o] - size[o] * d[i, j]) / total
        size[i] += size[j]
        member[i] += member.pop(j)
        alive.remove(j)
    out = np.empty(n, np.int64)
    for c, i in enumerate(sorted(alive, key=lambda a: min(member[a]))):
        out[member[i]] = c
    return out


def compare_cuts(nodes: np.ndarray, ks: Sequence[int]) -> list[dict]:
    """For each number of classes: singletons, within-class squares, silhouette, the ratio of variances and the mean distance of centroids."""
    rows, d = [], np.sqrt(((nodes[:, None] - nodes[None, :]) ** 2).sum(2))
    for k in ks:
        c = ward(nodes, k)
        centres = np.array([nodes[c == i].mean(0) for i in range(k)])
        within = float(sum(((nodes[c == i] - centres[i]) ** 2).sum() for i in range(k)))
        between = float(sum((c == i).sum() * ((centres[i] - nodes.mean(0)) ** 2).sum() for i in range(k)))
        s = []
        for i in range(len(nodes)):
            mine = c == c[i]
            if mine.sum() == 1:
                s.append(0.0)
                continue
            a = d[i, mine].sum() / (mine.sum() - 1)
            b = min((d[i, c == o].mean() for o in range(k) if o != c[i]), default=a)
            s.append((b - a) / max(a, b, 1e-12))
        apart = np.sqrt(((centres[:, None] - centres[None, :]) ** 2).sum(2))
        spread = np.array([np.sqrt(((nodes[c == i] - centres[i]) ** 2).sum(1)).mean() for i in range(k)])
        worst = [(spread[i] + spread[j]) / max(apart[i, j], 1e-12) for i in range(k) for j in range(k) if i != j]
        db = float(np.mean(np.max(np.array(worst).reshape(k, k - 1), axis=1))) if k > 1 else 0.0
        rows.append({"k": k, "singletons": int((np.bincount(c, minlength=k) == 1).sum()), "within": within, "silhouette": float(np.mean(s)), "variance_ratio": between / max(k - 1, 1) / max(within / max(len(nodes) - k, 1), 1e-12), "davies_bouldin": db, "centroid_distance": float(apart.sum() / max(k * (k - 1), 1))})
    return rows


def prototypes_table(df: DataFrame, m: Map, k: int) -> DataFrame:
    """(som_prototype, seascape, prototype_vector)."""
    return df.sparkSession.createDataFrame([(i, int(c), [float(x) for x in v]) for i, (c, v) in enumerate(zip(ward(m.nodes, k), m.nodes))], "som_prototype long, seascape long, prototype_vector array<double>")


def partial_dependence(model: PipelineModel, sample: DataFrame, feature: str, points: int = 20) -> DataFrame:
    """(value, prediction): mean prediction with the feature set to each of a grid between its 2nd and 98th percentile."""
    lo, hi = quantiles(sample, F.col(feature), [0.02, 0.98]).first()[0]
    grid = [lo + (hi - lo) * i / max(points - 1, 1) for i in range(points)]
    own = sample.withColumn("__v", F.explode(F.array(*map(F.lit, grid)))).withColumn(feature, F.col("__v"))
    return predict(model, own).groupBy(F.col("__v").alias("value")).agg(F.avg("prediction").alias("prediction"))


def train_kinds(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, kind: str, kinds: Sequence[str], fit) -> DataFrame:
    """(model_type, kind, train_rows, test_rows, metrics) of one model of all kinds, which has an indicator for each, and of one for each kind.

    ``fit(train, features)`` returns a model. Each is measured on the test rows of what it was trained for; the joint
    model's kind is ``all``. A kind without training rows is an error.
    """
    from functools import reduce

    from tidecube.operators.aggregates import metrics

    marks = [f"{kind}_is_{i}" for i in range(len(kinds))]
    marked = lambda df: df.where(F.col(kind).isin(*kinds)).withColumns({m: (F.col(kind) == k).cast("double") for m, k in zip(marks, kinds)})
    jobs = [("joint", "all", marked(train), marked(test), [*marks, *features])]
    jobs += [("single", k, train.where(F.col(kind) == k), test.where(F.col(kind) == k), list(features)) for k in kinds]
    out = []
    for model_type, name, own, held, used in jobs:
        if not (n := own.count()):
            raise ValueError(f"no training rows of {name!r}")
        found = metrics(predict(fit(own, used), held, "__p"), target, "__p")
        out.append(found.select(F.lit(model_type).alias("model_type"), F.lit(name).alias(kind), F.lit(n).cast("long").alias("train_rows"), F.lit(held.count()).cast("long").alias("test_rows"), "*"))
    return reduce(DataFrame.unionByName, out)


def cross_validate(df: DataFrame, features: Sequence[str], target: str, folds: int, fit) -> DataFrame:
    """(fold, r2, rmse, mae, bias, pearson, n) over df with fold; ``fit(train)`` returns a model. Each fold's rows are scored by a model that has not seen them."""
    from functools import reduce

    from tidecube.operators.aggregates import metrics
    from tidecube.operators.sampling import fold_split

    out = []
    for f in range(folds):
        train, test = fold_split(df, f)
        out.append(metrics(predict(fit(train), test, "__p"), target, "__p").withColumn("fold", F.lit(f).cast("long")))
    return reduce(DataFrame.unionByName, out)

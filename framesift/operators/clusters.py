"""K-means over image vectors, and the pick of one image per cluster."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.session import save_table

# Defaults of the refinement stage.
SEED = 42
DEFAULT_K = 50
SCREEN_K = 30
METHODS = ("diversity", "consistency")

CENTER_BYTES = 256 << 20  # bound on the center matrix that goes to every task
SPACE_BYTES = 32 << 20  # working space of one slice of row by center differences
SPREAD_ROUNDS = 5  # passes that draw candidates for the initial centers


def valid_embeddings(df: DataFrame, vec_col: str) -> DataFrame:
    """Images with a face; a null vector marks an image without one."""
    return df.filter(F.col(vec_col).isNotNull())


def clamp_k(k: int, n_rows: int) -> int:
    if n_rows == 0:
        raise ValueError("no image has a usable embedding")
    return min(k, n_rows)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Row by center distances, by differences and not by the expanded square, in slices."""
    out = np.empty((len(x), len(centers)))
    step = max(1, SPACE_BYTES // max(1, 8 * centers.size))
    for at in range(0, len(x), step):
        gap = x[at : at + step, None, :] - centers[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def check_size(rows: int, width: int) -> None:
    """Bound on a matrix that is held by the driver and by every task."""
    if 8 * rows * width > CENTER_BYTES:
        raise ValueError(f"{rows} x {width} numbers exceed the bound of {CENTER_BYTES} bytes")


def _check_centers(centers: np.ndarray) -> np.ndarray:
    check_size(*centers.shape)
    return centers


def nearest_center_udf(centers: np.ndarray):
    """vec -> (cluster, distance): nearest center, the lowest number on a tie."""
    centers = _check_centers(centers)
    half = (centers**2).sum(axis=1)

    @F.pandas_udf("struct<cluster int, distance double>")
    def run(vec: pd.Series) -> pd.DataFrame:
        x = _matrix(vec)
        label = (half[None, :] - 2 * (x @ centers.T)).argmin(axis=1)
        gap = x - centers[label]
        return pd.DataFrame(
            {"cluster": label.astype("int32"), "distance": np.sqrt((gap * gap).sum(axis=1))}
        )

    return run


def own_center_udf(centers: np.ndarray):
    """(vec, cluster) -> distance to the image's own center."""
    centers = _check_centers(centers)

    @F.pandas_udf("double")
    def run(vec: pd.Series, cluster: pd.Series) -> pd.Series:
        gap = _matrix(vec) - centers[cluster.to_numpy()]
        return pd.Series(np.sqrt((gap * gap).sum(axis=1)))

    return run


def other_center_udf(centers: np.ndarray):
    """(vec, cluster) -> distance to the nearest center of another cluster, 0 if there is none.

    All centers are at hand in the task, so there is no join of images with centers.
    """
    centers = _check_centers(centers)

    @F.pandas_udf("double")
    def run(vec: pd.Series, cluster: pd.Series) -> pd.Series:
        if len(centers) < 2:
            return pd.Series(np.zeros(len(vec)))
        away = _distances(_matrix(vec), centers)
        away[np.arange(len(vec)), cluster.to_numpy()] = np.inf
        return pd.Series(away.min(axis=1))

    return run


def cluster_means(df: DataFrame, vec_col: str, cluster_col: str = "cluster") -> DataFrame:
    """(cluster, center, n): mean vector per cluster, combined map-side, so a large cluster
    costs one partial sum per task."""
    vector = array_to_vector(F.col(vec_col).cast("array<double>"))
    return df.groupBy(cluster_col).agg(
        vector_to_array(Summarizer.mean(vector)).alias("center"), F.count(F.lit(1)).alias("n")
    )


def centers_matrix(means: DataFrame, k: int, old: np.ndarray | None = None) -> np.ndarray:
    """k x d array on the driver (k rows); a cluster without images keeps its old center."""
    found = {r["cluster"]: r["center"] for r in means.select("cluster", "center").collect()}
    width = len(next(iter(found.values())))
    centers = np.zeros((k, width)) if old is None else old.copy()
    for cluster, center in found.items():
        centers[cluster] = center
    return centers


def first_centers(df: DataFrame, id_col: str, vec_col: str, k: int) -> np.ndarray:
    """Vectors of the k lowest ids."""
    return np.array([r[0] for r in df.orderBy(id_col).limit(k).select(vec_col).collect()], dtype=np.float64)


def spread_centers(df: DataFrame, id_col: str, vec_col: str, k: int, seed: int = SEED) -> np.ndarray:
    """Seeded k-means|| over all rows.

    From the row with the lowest hash on, each round makes a row a candidate with probability
    2k times its share of the cost (squared distance to the nearest candidate). A row draws by
    a hash of (seed, round, id), so the result depends on the data alone. A round brings about
    2k candidates to the driver; there weighted k-means++ takes k of them, each with the
    number of rows it is nearest to as its weight. With fewer than k distinct vectors some centers
    are equal and their clusters stay empty.
    """
    rows = df.select(id_col, vec_col)
    first = rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(1).toPandas()
    points = _matrix(first[vec_col])
    for number in itertools.count(1):
        if number > SPREAD_ROUNDS and len(points) >= k:
            break
        near = assign(rows, vec_col, points).withColumn("_cost", F.col("distance") * F.col("distance"))
        total = near.agg(F.sum("_cost")).first()[0]
        if not total > 0:
            break  # every vector is a candidate
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(number), F.col(id_col)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        drawn = near.filter(draw * F.lit(total) < F.lit(2.0 * k) * F.col("_cost")).select(id_col, vec_col).toPandas()
        if len(drawn):
            points = np.concatenate([points, _matrix(drawn.sort_values(id_col)[vec_col])])
    weight = np.zeros(len(points))
    for row in assign(rows, vec_col, points).groupBy("cluster").count().collect():  # at most one per candidate
        weight[row["cluster"]] = row["count"]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    gap = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        cost = weight * gap
        pick = int(rng.choice(len(points), p=cost / cost.sum())) if cost.sum() > 0 else chosen[0]
        chosen.append(pick)
        gap = np.minimum(gap, ((points - points[pick]) ** 2).sum(axis=1))
    return points[chosen]


def assign(df: DataFrame, vec_col: str, centers: np.ndarray) -> DataFrame:
    """Add cluster and distance columns."""
    at = nearest_center_udf(centers)(F.col(vec_col))
    return df.withColumn("_at", at).withColumn("cluster", F.col("_at.cluster")).withColumn(
        "distance", F.col("_at.distance")
    ).drop("_at")


def lloyd_step(df: DataFrame, vec_col: str, centers: np.ndarray) -> DataFrame:
    """(cluster, center, n) after one assignment to ``centers``."""
    return cluster_means(assign(df.select(vec_col), vec_col, centers), vec_col)


def moved_centers(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Centers after one assignment of ``vectors`` (vec); a cluster without images keeps its old one.

    Each task sums its own rows and sends one row per cluster; these are added up before they reach
    the driver, so what it gets does not grow with the tasks.
    """
    centers = _check_centers(centers)
    half = (centers**2).sum(axis=1)

    def sums(batches):
        import pyarrow as pa

        total, n = np.zeros(centers.shape), np.zeros(len(centers), np.int64)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1).astype(np.float64)
            if not len(x):
                continue
            label = (half[None, :] - 2 * (x @ centers.T)).argmin(axis=1)
            order = np.argsort(label, kind="stable")
            here, start = np.unique(label[order], return_index=True)
            total[here] += np.add.reduceat(x[order], start, axis=0)
            n += np.bincount(label, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.select("vec").mapInArrow(sums, "cluster int, n long, sums array<double>")
    added = parts.groupBy("cluster").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"), F.sum("n").alias("n"))
    new = centers.copy()
    for row in added.collect():
        new[row["cluster"]] = row["sums"].toArray() / row["n"]
    return new


def kmeans(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    k: int = DEFAULT_K,
    engine: str = "lloyd",
    init: str = "spread",
    max_iter: int = 300,
    tol: float = 1e-6,
    seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """Assigned rows (cluster, distance added) and the k x d centers.

    ``lloyd`` does not depend on how rows are partitioned; ``ml`` is the library estimator.
    Ids and vectors are stored once; each iteration is one pass over them with partial sums, and only the
    centers come to the driver. The spread start holds some 2 * SPREAD_ROUNDS * k candidates
    there, which are checked against the bound before any pass.
    """
    rows = save_table(df.select(id_col, vec_col), "kmeans")
    n_rows = rows.count()
    k = clamp_k(k, n_rows)
    candidates = min(n_rows, (2 * SPREAD_ROUNDS + 1) * k) if engine == "lloyd" and init == "spread" else k
    check_size(candidates, len(rows.select(vec_col).first()[0]))
    if engine == "ml":
        ready = df.withColumn("_v", array_to_vector(F.col(vec_col).cast("array<double>")))
        model = KMeans(k=k, seed=seed, featuresCol="_v", maxIter=max_iter, tol=tol).fit(ready)
        centers = np.array(model.clusterCenters())
    elif engine == "lloyd":
        pick = {"first": lambda: first_centers(rows, id_col, vec_col, k),
                "spread": lambda: spread_centers(rows, id_col, vec_col, k, seed)}
        centers = pick[init]()
        vectors = rows.select(F.col(vec_col).alias("vec"))
        for _ in range(max_iter):
            new = moved_centers(vectors, centers)
            shift = float(((new - centers) ** 2).sum())
            centers = new
            if shift <= tol:
                break
    else:
        raise ValueError("engine is 'lloyd' or 'ml'")
    return assign(df, vec_col, centers), centers


def _first_per_cluster(df: DataFrame, *order) -> DataFrame:
    """Best row per cluster. The rank filter is applied before the shuffle too, so every
    task sends at most one row per cluster."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def select_consistency(df: DataFrame, id_col: str, vec_col: str, centers: np.ndarray) -> DataFrame:
    """(id, cluster, distance): per cluster the image nearest to its own center; ties to the first."""
    near = df.select(id_col, "cluster", own_center_udf(centers)(F.col(vec_col), F.col("cluster")).alias("distance"))
    return _first_per_cluster(near, F.col("distance").asc(), F.col(id_col).asc())


def select_diversity(df: DataFrame, id_col: str, vec_col: str, centers: np.ndarray) -> DataFrame:
    """(id, cluster, distance): per cluster the image farthest from its nearest other center."""
    away = df.select(id_col, "cluster", other_center_udf(centers)(F.col(vec_col), F.col("cluster")).alias("distance"))
    return _first_per_cluster(away, F.col("distance").desc(), F.col(id_col).asc())


def select_images(df: DataFrame, id_col: str, vec_col: str, centers: np.ndarray, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    pick = select_diversity if method == "diversity" else select_consistency
    return pick(df, id_col, vec_col, centers)


def cluster_stats(assigned: DataFrame, selected: DataFrame, k: int) -> DataFrame:
    """One row: groups_formed, images_clustered, images_selected."""
    rows = assigned.select(F.lit(0).alias("picked")).unionByName(selected.select(F.lit(1).alias("picked")))
    return rows.agg(
        F.least(F.lit(k).cast("long"), F.count_if(F.col("picked") == 0)).alias("groups_formed"),
        F.count_if(F.col("picked") == 0).alias("images_clustered"),
        F.count_if(F.col("picked") == 1).alias("images_selected"),
    )


def principal_axes(df: DataFrame, vec_col: str, n_axes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and d x n_axes principal axes of the vectors; the largest loading of an axis is positive.

    Tasks sum the products of their centered rows; a d x d matrix reaches the driver.
    """
    vector = array_to_vector(F.col(vec_col).cast("array<double>"))
    mean = df.agg(Summarizer.mean(vector).alias("mean")).first()["mean"].toArray()
    width = len(mean)
    check_size(width, width)

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            if len(batch):
                x = _matrix(batch[vec_col]) - mean
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(width, dtype="int32"), "sums": list(total)})

    parts = df.select(vec_col).mapInPandas(products, "at int, sums array<double>")
    scatter = np.zeros((width, width))
    for row in parts.groupBy("at").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect():
        scatter[row["at"]] = row["sums"].toArray()
    found = np.linalg.eigh((scatter + scatter.T) / 2)[1][:, ::-1][:, :n_axes]
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(found.shape[1])])
    axes = np.zeros((width, n_axes))
    axes[:, : found.shape[1]] = found
    return mean, axes


def plot_data(
    assigned: DataFrame, selected: DataFrame, id_col: str, vec_col: str
) -> DataFrame:
    """(id, x, y, cluster, is_selected): first two principal components of every image.

    PCA takes the place of a neighbour embedding: it is two passes of sums over the rows.
    """
    mean, axes = principal_axes(assigned, vec_col)

    @F.pandas_udf("struct<x double, y double>")
    def place(vec: pd.Series) -> pd.DataFrame:
        return pd.DataFrame((_matrix(vec) - mean) @ axes, columns=["x", "y"])

    # one selected image per cluster, so at most k rows
    marks = F.broadcast(selected.select(id_col, F.lit(True).alias("_sel")))
    flat = assigned.select(id_col, "cluster", place(F.col(vec_col)).alias("_p"))
    return flat.join(marks, id_col, "left").select(
        id_col, "_p.x", "_p.y", "cluster", F.coalesce("_sel", F.lit(False)).alias("is_selected"),
    )

"""Centroid clustering of integer vectors whose nearest centroid is found by Orchard's search."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlake.llm.store import materialise

#: integers of a component beyond which squared distances might not fit 64 bits
LARGEST = 2 ** 27
#: vectors worked on at a time
BATCH = 20_000


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and q (floor(scale * component) of every component) of the vectors with exactly `dims` finite components."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(F.col(f"`{vector_col}`"), lambda v: v.cast("double")).alias("v"))
    good = (F.size("v") == dims) & F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall("v", lambda v: F.abs(v * scale) <= LARGEST)
    whole = F.when(fits, F.transform("v", lambda v: F.floor(v * scale).cast("long"))).otherwise(
        F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")))
    return rows.where(good).select("vec_id", whole.alias("q"))


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid the others by distance, and their squared distances: the smaller number first among equals."""
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    order = np.array([[j for j in np.lexsort((np.arange(len(row)), row)) if j != i] for i, row in enumerate(apart)], np.int64).reshape(len(centroids), -1)
    return order, np.take_along_axis(apart, order, 1)


def nearest(points: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each point's nearest centroid, the smaller number among equals.

    Orchard's search, for all points side by side: each walks the list of its current centroid; a closer centroid becomes the
    current one and its list is walked from the start; centroids met before are passed over; a point is done where the next
    centroid of the list is strictly beyond twice its current distance, as no later one can be as near. `compared` gets the number
    of distances worked out.
    """
    n, k = len(points), len(centroids)
    rows = np.arange(n)
    best = np.zeros(n, np.int64)
    distance = ((points - centroids[0]) ** 2).sum(1)
    met = np.zeros((n, k), bool)
    met[:, 0] = True
    place = np.zeros(n, np.int64)
    work = n
    rows = rows[place < k - 1]
    while len(rows):
        current, at = best[rows], place[rows]
        rows = rows[apart[current, at] <= 4 * distance[rows]]
        candidate = order[best[rows], place[rows]]
        place[rows] += 1
        new = ~met[rows, candidate]
        ask, other = rows[new], candidate[new]
        met[ask, other] = True
        found = ((points[ask] - centroids[other]) ** 2).sum(1)
        work += len(ask)
        closer = (found < distance[ask]) | ((found == distance[ask]) & (other < best[ask]))
        moved = ask[closer]
        best[moved], distance[moved], place[moved] = other[closer], found[closer], 0
        rows = rows[place[rows] < k - 1]
    if compared is not None:
        compared.append(work)
    return best, distance


def _points(batch: pa.RecordBatch, column: int, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    for at in range(0, len(values), BATCH):
        yield at, values[at:at + BATCH]


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the componentwise floor of the exact mean of each one's points; without points it stays.

    Tasks add their points up, so the shuffle has a row for each task, centroid and component, and the driver one for each of the
    latter two.
    """
    k, dims = centroids.shape
    lists = neighbour_lists(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sums in two halves: no number of points makes them wrong
        low, high, counts = np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, some in _points(batch, 0, dims):
                cluster, _ = nearest(some, centroids, *lists)
                counts += np.bincount(cluster, minlength=k)
                np.add.at(low, cluster, some & 0xFFFF)
                np.add.at(high, cluster, some >> 16)
        number = np.repeat(np.arange(k), dims)
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.tile(np.arange(dims), k)), pa.array(low.ravel()), pa.array(high.ravel()),
                                          pa.array(np.repeat(counts, dims))], names=["cluster", "dim", "low", "high", "n"])

    sums = points.select("q").mapInArrow(add, "cluster long, dim long, low long, high long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n")]
    out = centroids.copy()
    for row in sums.groupBy("cluster", "dim").agg(*wide).collect():
        if row["n"]:
            out[row["cluster"], row["dim"]] = (int(row["low"]) + (int(row["high"]) << 16)) // int(row["n"])
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3",
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The first centroids are the `k` kept vectors with the smallest lowercase-hex sha256 of `seed:vec_id`, in that order. Only the centroids
    pass through the driver; vectors are read from one written table each round.

    Vectors that are NULL, of another length, or with NULL or non-finite components are not kept and have no row. A NULL id counts as an
    empty text for the hash; rows that repeat an id are separate vectors, ordered by their components where hashes tie. Fewer than `k`
    vectors make fewer centroids; equal centroids leave the larger number empty. An empty table gives an empty result. A component
    whose integer is beyond 2**27 raises an error, as squared distances would not fit 64 bits. Other columns are not read.
    """
    points = materialise(quantised(vectors, dims, scale, id_col, vector_col), "points")
    spark = points.sparkSession
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.select(place.alias("place"), "q").orderBy("place", "q").limit(k).collect()
    id_type = points.schema["vec_id"].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"vec_id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["q"] for r in first], np.int64)
    for _ in range(rounds):
        after = moved(points, centroids)
        if (after == centroids).all():
            break  # every later round would repeat this one
        centroids = after
    lists = neighbour_lists(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _points(batch, 1, dims):
                number, distance = nearest(some, centroids, *lists)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(number.astype(np.int32)), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])

    assigned = materialise(points.select("vec_id", "q").mapInArrow(assign, f"vec_id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = sum(inertia.values())
    rows = [(c, d, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(inertia.items())]
    # a row for each centroid
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering with exact integer arithmetic, by annulus search.

The centroids are sorted by norm. A vector's distance to the centroid it was with is an upper bound u of its distance to the nearest, and a centroid nearer than
that has a norm within u of the vector's own: two binary searches over the sorted norms give the annulus, ties of its bounds included, and its centroids alone
are compared exactly. The norms are floats, so the annulus is widened by more than their error; distances are 64-bit integers.

Each round reads the vectors with the cluster of the round before and writes them with the new one, so that a lost executor costs its tasks alone, and a later
round deletes the table before. Each task sums its vectors by cluster; one row for each cluster and component comes to the driver.

Edge cases: vectors that are null, of another length, or hold a null or a component that isn't finite are left out; with fewer vectors than centroids, each is
one; rows that share an id are vectors of their own, and of two such starting points the one with the smaller vector comes first; rows without an id are
clustered but start no centroid unless too few have one; an empty table gives an empty result; other columns are ignored. A
component beyond 2 ** 27 after scaling ends the query with an error, since squared distances might not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .session import bounded_batches, discard, table, written

CENTROIDS, ROUNDS, LENGTH, SCALE = 8, 10, 64, 1024
#: Vectors that are compared at once: each with its annulus makes up to CENTROIDS rows of LENGTH numbers.
SLICE_ROWS = 2_048
LARGEST = 1 << 27


def whole_vectors(v: Column, length: int = LENGTH, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, or null if the vector is to be left out."""
    x = lambda c: c.cast("double")
    fits = v.isNotNull() & (F.size(v) == length) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(x(c) * scale) <= LARGEST, F.floor(x(c) * scale)).otherwise(F.raise_error(F.lit("a component is too large for distances in 64 bits")).cast("bigint"))
    return F.when(fits, F.transform(v, whole))


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row of x, the smallest of equally near ones, and the squared distance. before: a centroid each, or -1."""
    norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((np.arange(len(norms)), norms))
    sorted_norms = norms[order]
    cluster, distance = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for i in range(0, len(x), SLICE_ROWS):
        part, known = x[i : i + SLICE_ROWS], before[i : i + SLICE_ROWS].copy()
        norm = np.sqrt((part.astype(np.float64) ** 2).sum(1))
        fresh = known < 0
        known[fresh] = order[np.minimum(np.searchsorted(sorted_norms, norm[fresh]), len(order) - 1)]
        bound = ((part - centroids[known]) ** 2).sum(1)
        u = np.sqrt(bound.astype(np.float64))
        slack = 1e-9 * (u + norm + sorted_norms[-1]) + 1e-9
        low = np.searchsorted(sorted_norms, norm - u - slack, "left")
        high = np.searchsorted(sorted_norms, norm + u + slack, "right")
        row, candidate = np.repeat(np.arange(len(part)), high - low), order[K.aranges(low, high - low)]
        exact = ((part[row] - centroids[candidate]) ** 2).sum(1)
        first = np.cumsum(high - low) - (high - low)  # the annulus holds the known centroid, so no row is without a candidate
        least = np.minimum.reduceat(exact, first)
        number = np.minimum.reduceat(np.where(exact == least[row], candidate, len(centroids)), first)
        cluster[i : i + len(part)], distance[i : i + len(part)] = number, least
    return cluster, distance


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cluster, distance = nearest(_vectors(batch.column(1)), centroids, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster), pa.array(distance)], ["vec_id", "vector", "cluster", "distance"])


def _summed(batches: Iterator[pa.RecordBatch], k: int, length: int) -> Iterator[pa.RecordBatch]:
    """(cluster, part, total): the sum of each component (part 0 and on), the number of vectors (part -1)."""
    sums, counts = np.zeros((k, length), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        cluster = batch.column(1).to_numpy()
        np.add.at(sums, cluster, _vectors(batch.column(0)))
        counts += np.bincount(cluster, minlength=k)
    c = np.repeat(np.flatnonzero(counts), length + 1)
    total = np.concatenate([counts[:, None], sums], 1)[counts > 0].ravel()
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(np.tile(np.arange(-1, length), int((counts > 0).sum()))), pa.array(total)], ["cluster", "part", "total"])


def cluster(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that takes part."""
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(id_col).alias("vec_id"), whole_vectors(F.col(vector_col), length, scale).alias("vector")).where("vector is not null")
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, vector array<bigint>, cluster bigint, distance bigint"
    now = written(rows.withColumn("cluster", F.lit(-1).cast("bigint")).withColumn("distance", F.lit(0).cast("bigint")), "vectors")
    start = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    first = now.select(start.alias("h"), "vector").orderBy(F.col("h").asc_nulls_last(), "vector").limit(centroids).collect()
    at = np.array([r.vector for r in first], np.int64).reshape(len(first), length)
    for _ in range(rounds + 1 if len(at) else 0):
        if _:
            sums = now.select("vector", "cluster").mapInArrow(lambda x, k=len(at): _summed(x, k, length), "cluster bigint, part bigint, total bigint").groupBy("cluster", "part").agg(F.sum("total").alias("total")).collect()
            total = {(r.cluster, r.part): r.total for r in sums}
            for c in {r.cluster for r in sums}:
                at[c] = [total[c, p] // total[c, -1] for p in range(length)]
        before, now = now, written(now.select("vec_id", "vector", "cluster").mapInArrow(lambda x, c=at.copy(): _assigned(x, c), schema), "vectors")
        discard(before)
    sums = now.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = {r.cluster: r.cluster_inertia for r in sums.collect()}
    total = sum(per.values())
    facts = [(c, n, total, hashlib.sha256(",".join(map(str, at[c].tolist())).encode()).hexdigest()) for c, n in per.items()]
    facts = F.broadcast(spark.createDataFrame(facts, "c__ bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))  # a row for each centroid
    out = now.join(facts, F.col("cluster") == F.col("c__"))
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same in DuckDB: vectors as rows of components, each round two common table expressions."""
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS a FROM embeddings"
        f" WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, a) - 1 AS c, a AS m FROM (SELECT sha256('3:' || vec_id) AS h, a FROM v ORDER BY h, a LIMIT {CENTROIDS}))",
        "u AS MATERIALIZED (SELECT r, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM v)",
    ]
    for k in range(ROUNDS + 1):
        parts.append(
            f"a{k} AS MATERIALIZED (SELECT r, unnest(best).c AS c, unnest(best).d AS d FROM (SELECT r, [min({{'d': d, 'c': c}})] AS best FROM"
            f" (SELECT r, c, list_sum(list_transform(list_zip(a, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{k}) GROUP BY r))"
        )
        if k < ROUNDS:
            parts.append(
                f"s{k} AS MATERIALIZED (SELECT c, list(y ORDER BY i) AS m FROM (SELECT c, i, CAST(sum(x) AS BIGINT) // count(*) - CASE WHEN CAST(sum(x) AS BIGINT) % count(*) < 0 THEN 1 ELSE 0 END AS y FROM u JOIN a{k} USING (r) GROUP BY c, i) GROUP BY c)"
            )
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c, coalesce(s{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN s{k} USING (c))")
    body = ", ".join(parts)
    return (
        f"WITH {body} SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN c{ROUNDS} USING (c)"
    )


ORACLE_SQL = _oracle()

"""Exact centroid clustering of integer vectors by bit-plane popcounts (operator 13).

1. A vector of 64 components becomes whole numbers floor(256 * x). Bit b of all 64 is packed into one 64-bit word, its bit plane;
   as many planes are stored as a batch needs, the last one holding the signs (two's complement).
2. The dot product of two vectors is the sum over pairs of their planes of 2 ** (i + j) times the set bits both planes share,
   sign planes counting negative. So squared distances come from AND, popcount and shifts alone, and are exact.
3. A round is one pass over the planes: each task assigns its vectors and sums them up by cluster; Spark adds the sums of the
   tasks (one row per task and cluster before the shuffle), and the driver gets at most ``k`` x 64 of them. No vector is
   shuffled, and no cluster is gathered, however large.

Left out are vectors that are null, have another length, or hold null or non-finite components. Rows may share a ``vec_id``; each
is a vector of its own, and equal hashes are ordered by components. A null ``vec_id`` counts as an empty one in the hash. With
fewer than ``k`` vectors there are as many centroids as vectors. An empty table gives an empty result. Squared distances must
fit a long: components of 2 ** 19 or more in size raise an error. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.scratch import stage

SIZE, UNITS = 64, 256
K, ROUNDS, SEED = 40, 5, 2
LARGEST = 1 << 27  # of a whole number: a squared distance stays below 2 ** 63
CHUNK = 256  # vectors compared at once, so that intermediates stay in the processor's cache


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of rows of 64 whole numbers: n x width words, the sign plane last."""
    width = int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length() + 1
    bits = np.stack([(x >> b) & 1 for b in range(width)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def numbers(p: np.ndarray) -> np.ndarray:
    """The whole numbers of bit planes."""
    bits = np.unpackbits(np.ascontiguousarray(p)[:, :, None].view(np.uint8), axis=2, bitorder="little")
    out = -bits[:, -1].astype(np.int64)
    for b in range(p.shape[1] - 2, -1, -1):
        out = out * 2 + bits[:, b]
    return out


def dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Dot products of every row of ``p`` (n x width) with every row of ``q`` (m x width), exact."""
    out = np.zeros((len(p), len(q)), np.int64)
    for i in range(p.shape[1] - 1, -1, -1):
        row = np.zeros_like(out)
        for j in range(q.shape[1] - 1, -1, -1):
            shared = np.bitwise_count(p[:, i, None] & q[None, :, j])
            row <<= 1
            row = row - shared if j == q.shape[1] - 1 else row + shared
        out <<= 1
        out = out - row if i == p.shape[1] - 1 else out + row
    return out


def squares(p: np.ndarray) -> np.ndarray:
    """Each row's dot product with itself."""
    out = np.zeros(len(p), np.int64)
    last = p.shape[1] - 1
    for i in range(last + 1):
        for j in range(i + 1):
            shared = np.bitwise_count(p[:, i] & p[:, j]).astype(np.int64) << (i + j + (i != j))
            out += -shared if (i == last) != (j == last) else shared
    return out


def nearest(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest row of ``q``, the smaller number in a tie."""
    cluster, distance = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
    length = squares(q)
    for start in range(0, len(p), CHUNK):
        part = p[start : start + CHUNK]
        away = squares(part)[:, None] - 2 * dots(part, q) + length
        cluster[start : start + CHUNK] = best = away.argmin(1)
        distance[start : start + CHUNK] = away[np.arange(len(part)), best]
    return cluster, distance


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, rows = [], []
        for i, v in enumerate(batch.column("embedding")):
            if v.is_valid and len(v.values) == SIZE and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    keep.append(i)
                    rows.append(x)
        if not rows:
            continue
        x = np.floor(np.array(rows) * UNITS)
        if np.abs(x).max() > LARGEST:
            raise ValueError(f"a component of {np.abs(x).max() / UNITS:g}: squared distances beyond {LARGEST / UNITS:g} do not fit a long")
        packed = [row.tobytes() for row in planes(x.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(packed, pa.binary())], ["vec_id", "planes"])


def unpack(column: pa.Array) -> np.ndarray:
    """Planes of a batch; rows with fewer have their sign plane repeated."""
    words = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    width = max(map(len, words))
    return np.array([w if len(w) == width else np.pad(w, (0, width - len(w)), mode="edge") for w in words])


def _sums(centroids: np.ndarray):
    q, k = planes(centroids), len(centroids)

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, SIZE), np.int64)
        for batch in batches:
            if not len(batch):
                continue
            p = unpack(batch.column("planes"))
            cluster = nearest(p, q)[0]
            count += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            begin = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            sums[cluster[order][begin]] += np.add.reduceat(numbers(p)[order], begin)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: np.ndarray):
    q = planes(centroids)

    def run(batches):
        for batch in batches:
            if len(batch):
                cluster, distance = nearest(unpack(batch.column("planes")), q)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def centroids_of(packed: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds over (vec_id, planes)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = packed.select(name.alias("name"), "planes").orderBy("name", "planes").limit(k).collect()
    if not first:
        return np.zeros((0, SIZE), np.int64)
    centroids = numbers(unpack(pa.array([bytes(r["planes"]) for r in first])))
    for _ in range(rounds):
        parts = packed.select("planes").mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        tall = parts.select("cluster", "n", F.posexplode("sums"))
        total = tall.groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n"))
        centroids = centroids.copy()
        for r in total.collect():  # at most k x 64 rows
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    return centroids


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per kept row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Centroids start as the ``k`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``, in that order. Each round assigns all
    vectors and sets every centroid that has any to the floor of their mean; then vectors are assigned once more.
    """
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    packed = stage(vectors.select("vec_id", "embedding").mapInArrow(_pack, f"vec_id {id_type}, planes binary"), "planes")
    centroids = centroids_of(packed, k, rounds, seed)
    out = stage(packed.mapInArrow(_assign(centroids), f"vec_id {id_type}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["total"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # at most k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, total, sum(inertia.values()), digests[c]) for c, total in sorted(inertia.items())]
    each = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = out.join(F.broadcast(each), "cluster")  # at most k rows
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_ROUND = """
d{r} AS MATERIALIZED (SELECT v.row, c.k, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} c),
a{r} AS MATERIALIZED (SELECT row, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY row),"""
_MOVE = """
m{r} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT a.k, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS i FROM a{p} a JOIN v USING (row)) GROUP BY k, i),
n{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM m{r} GROUP BY k),
c{r} AS MATERIALIZED (SELECT c.k, coalesce(n.x, c.x) AS x FROM c{p} c LEFT JOIN n{r} n USING (k)),"""


def sql(table: str, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in DuckDB's SQL, for tables whose vec_id is unique and not null."""
    steps = _ROUND.format(r=0) + "".join(_MOVE.format(r=r, p=r - 1) + _ROUND.format(r=r) for r in range(1, rounds + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({UNITS} * x::DOUBLE)::BIGINT) AS x FROM {table}
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: isfinite(x))) = {SIZE}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})),{steps}
e AS (SELECT k, sha256(array_to_string(x, ',')) AS digest FROM c{rounds})
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, digest AS centroid_sha256
FROM a{rounds} JOIN v USING (row) JOIN e USING (k)"""

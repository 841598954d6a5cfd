"""Embedding near-duplicates by lattice hashing: E8 cells of random projections, neighbouring cells probed (operator 9).

1. Equal vectors are one node from here on (map-side combined).
2. In each of ``tables`` tables a vector is projected to eight dimensions (orthonormal rows, fixed seed), scaled and decoded
   to its nearest E8 lattice point, its home cell. The ``probes`` of the 240 neighbouring points that lie nearest to it
   are its probe cells. Two vectors meet in a table if one's home is the other's home or probe.
3. Cells without a home or with one member are dropped while rows are narrow; then vectors are dealt by cell, large cells
   in blocks of bounded size. Inside a task all pairs that meet get their exact cosine in double precision.
4. No pair is written. A pair is counted at its first meeting only (decided from the two vectors themselves), so a task
   returns a number of links and one forest edge per vector; Spark adds the numbers and connects the forests.

The finer the cells, the fewer vectors meet, and the more tables are needed. Scale and tables follow from the number of
vectors: for each scale of a grid the chance that a pair at the threshold meets in a table is measured on 4,000 random pairs, the
share of all vectors that one meets on a sample of at most ``SAMPLE`` vectors (least hashes), and tables are as many as find
``RECALL`` of such pairs; taken is the scale of least work, copies sent and pairs compared. Every vector is placed and compared;
the sample decides about work only. Nothing below the threshold is linked, pairs above it are found more often.

Vectors that are null, zero, empty, or hold null or non-finite components link with nothing. Vectors of different lengths
are never compared. Rows that share a ``vec_id`` are told apart by vector; null ids come last in naming a component.
"""
from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.components import connected_components
from reviewloom.llm.scratch import stage
from reviewloom.llm.text import mix

COSINE, PROBES, BLOCK = 0.9, 8, 2000
#: Share of the pairs at the threshold that tables are made for, vectors looked at to choose the scale, scales tried.
RECALL, SAMPLE, SCALES = 0.997, 4000, tuple(0.3 * 0.92**k for k in range(20))
#: A copy of a vector sent to a cell costs as much as so many comparisons.
COPY = 400
LAST = (1 << 63) - 1


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all of +-1/2 with an even number of minus signs."""
    pairs = [(i, j, s, t) for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, s, t) in enumerate(pairs):
        whole[k, i], whole[k, j] = s, t
    half = np.array([x for x in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in x) % 2 == 0])
    return np.vstack([whole, half])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum."""
    point = np.rint(x)
    off = x - point
    odd = np.flatnonzero(point.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to each row."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


@cache
def projections(dimensions: int, tables: int) -> np.ndarray:
    """Per table a matrix of orthonormal columns (of fewer than eight dimensions: padded with zeros)."""
    r = np.random.default_rng(8 * dimensions + 1)
    out = np.zeros((tables, dimensions, 8))
    for t in range(tables):
        q = np.linalg.qr(r.normal(size=(dimensions, max(8, dimensions)) if dimensions < 8 else (dimensions, dimensions)))[0]
        width = min(8, q.shape[1])
        out[t, :, :width] = q[:, :width]
    return out


def _names(points: np.ndarray, table: int, dimensions: int) -> np.ndarray:
    out = np.full(points.shape[:-1], table * 1_000_003 + dimensions, dtype=np.uint64)
    doubled = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for k in range(8):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + doubled[..., k])
    return out.view(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors: home cells (n x tables) and probe cells (n x tables x probes)."""
    n, dimensions = unit.shape
    home = np.empty((n, tables), np.int64)
    probe = np.empty((n, tables, probes), np.int64)
    # At 64 dimensions a projection has length 0.35; other dimensions are brought to that.
    stretch = np.sqrt(max(dimensions, 8) / 64) / scale
    for t, matrix in enumerate(projections(dimensions, tables)):
        x = unit @ matrix * stretch
        point = nearest(x)
        home[:, t] = _names(point, t, dimensions)
        if probes:
            gain = 2 * (x - point) @ neighbours().T - 2
            best = np.sort(np.argpartition(-gain, probes, axis=1)[:, :probes], axis=1)
            probe[:, t] = _names(point[:, None, :] + neighbours()[best], t, dimensions)
    return home, probe


def _meets(home: np.ndarray, probe: np.ndarray, other_home: np.ndarray, other_probe: np.ndarray) -> np.ndarray:
    return (home == other_home) | (probe == other_home[:, None]).any(1) | (other_probe == home[:, None]).any(1)


@cache
def chance(dimensions: int, cosine: float, probes: int, scale: float, pairs: int = 4000) -> float:
    """Measured chance that two vectors at ``cosine`` meet in a table."""
    r = np.random.default_rng(9)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in r.normal(size=(2, pairs, dimensions)))
    y = y - (x * y).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine * cosine) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    (a, p), (b, q) = (cells(v, 1, probes, scale) for v in (x, y))
    return float(_meets(a[:, 0], p[:, 0], b[:, 0], q[:, 0]).mean())


def crowd(unit: np.ndarray, probes: int, scale: float) -> float:
    """Share of the other vectors of a sample that a vector meets in a table."""
    home, probe = cells(unit, 1, probes, scale)
    names, count = np.unique(home[:, 0], return_counts=True)

    def homes(at: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(names, at), len(names) - 1)
        return np.where(names[place] == at, count[place], 0)

    met = homes(home[:, 0]) - 1 + 2 * homes(probe[:, 0]).sum(1)
    return float(met.mean()) / max(1, len(unit) - 1)


def plan(n: int, unit: np.ndarray, cosine: float, probes: int = PROBES, recall: float = RECALL) -> tuple[float, int, float]:
    """Scale, number of tables and work per vector for ``n`` vectors like those of a sample."""
    best = None
    for scale in SCALES:
        p = chance(unit.shape[1], cosine, probes, scale)
        if p < 0.02:
            break
        tables = max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(p, 0.999)))))
        work = tables * ((1 + probes) * COPY + n * crowd(unit, probes, scale))
        if best is None or work < best[2]:
            best = scale, tables, work
    return best or (SCALES[0], 1, 0.0)


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _clean(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("embedding"):
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    v = None if not np.isfinite(v).all() or not v.any() else (v + v.dtype.type(0)).tobytes()
                out.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return run


def _by_length(vectors: list[bytes], kind: str):
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _units([vectors[i] for i in at.tolist()], kind)


def _place(tables: int, probes: int, scale: float, kind: str):
    def run(batches):
        for batch in batches:
            for start in range(0, len(batch), 2000):
                part = batch.slice(start, 2000)
                for at, unit in _by_length(part.column("vec").to_pylist(), kind):
                    home, probe = cells(unit, tables, probes, scale)
                    node = part.column("node").take(pa.array(at))
                    for t in range(tables):
                        own = np.repeat(np.arange(len(at)), probes)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.concatenate([home[:, t], probe[:, t].ravel()])), node.take(pa.array(np.concatenate([np.arange(len(at)), own]))),
                             pa.array([t] * (len(at) * (1 + probes)), pa.int32()), pa.array(np.arange(len(at) * (1 + probes)) < len(at))],
                            ["cell", "node", "t", "home"],
                        )

    return run


def _compare(cosine: float, tables: int, probes: int, scale: float, kind: str):
    """Groups (cell, i, j) in order -> (node, links, parent): links counted here, and an edge to the node's forest."""

    def group(rows: pa.Table):
        names = rows.column("node").to_pylist()
        unit = _units(rows.column("vec").to_pylist(), kind)
        weight = rows.column("m").to_numpy()
        home, side = rows.column("home").to_numpy(), rows.column("side").to_numpy()
        t = rows.column("t")[0].as_py()
        cross = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(names)),) * 2
        if not len(left) or not len(right):
            return
        xs, ys = [], []
        for at in range(0, len(left), 512):
            part = left[at : at + 512]
            close = unit[part] @ unit[right].T >= cosine
            close &= home[part][:, None] | home[right][None, :]
            if not cross:
                close &= part[:, None] < right[None, :]
            a, b = np.nonzero(close)
            xs.append(part[a])
            ys.append(right[b])
        x, y = np.concatenate(xs), np.concatenate(ys)
        if not len(x):
            return
        used = np.unique(np.concatenate([x, y]))
        homes, probed = cells(unit[used], tables, probes, scale)
        a, b = np.searchsorted(used, x), np.searchsorted(used, y)
        order = np.argsort(np.argsort(np.array(names, dtype=object)[used])) if len(used) else used
        first = np.ones(len(x), bool)
        for k in range(0, len(x), 1 << 16):
            p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            met = np.zeros(len(p), bool)
            for s in range(t):
                met |= homes[p, s] == homes[q, s]
                met |= (probed[p, s] == homes[q, s][:, None]).any(1) | (probed[q, s] == homes[p, s][:, None]).any(1)
            both = (probed[p, t] == homes[q, t][:, None]).any(1) & (probed[q, t] == homes[p, t][:, None]).any(1)
            probing = np.where(home[used[p]], q, p)  # the one whose home is elsewhere
            other = np.where(home[used[p]], p, q)
            met |= both & ~(home[used[p]] & home[used[q]]) & (order[probing] > order[other])
            first[k : k + (1 << 16)] = ~met
        x, y = x[first], y[first]
        links = np.zeros(len(names), np.int64)
        np.add.at(links, x, weight[y])
        np.add.at(links, y, weight[x])
        root = list(range(len(names)))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(x.tolist(), y.tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)
        for i in np.flatnonzero(links).tolist():
            yield names[i], int(links[i]), names[find(i)]

    def run(batches):
        held: list[pa.RecordBatch] = []
        key, out = None, []

        def flush():
            out.extend(group(pa.Table.from_batches(held)))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "i", "j")], axis=1)
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1 if len(keys) else []
            for a, b in zip([0, *cut], [*cut, len(keys)]):
                if a == b:
                    continue
                if held and tuple(keys[a]) != key:
                    flush()
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
            if len(out) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["node", "links", "parent"])
                out = []
        if held:
            flush()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], ["node", "links", "parent"])

    return run


def _planned(nodes: DataFrame, cosine: float, probes: int, kind: str) -> tuple[float, int]:
    """Scale and tables for the most frequent length of ``nodes`` (node, vec)."""
    counts = nodes.groupBy(F.octet_length("vec").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").first()
    if counts is None:
        return SCALES[0], 1
    sample = nodes.where(F.octet_length("vec") == counts["bytes"]).orderBy("node").limit(SAMPLE).select("vec").collect()  # nodes are hashes
    scale, tables, _ = plan(counts["n"], _units([bytes(r["vec"]) for r in sample], kind), cosine, probes)
    return scale, tables


def embedding_dedup(
    vectors: DataFrame, cosine: float = COSINE, probes: int = PROBES, *, tables: int | None = None, scale: float | None = None, block: int = BLOCK
) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept. ``scale`` and ``tables`` follow from the
    vectors unless both are given."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "f8"
    rows = vectors.select("vec_id", "embedding").mapInArrow(_clean(kind), f"vec_id {id_type}, vec binary")
    rows = stage(rows.withColumn("node", F.unhex(F.md5("vec"))).withColumn("k1", F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST))), "vectors")
    nodes = stage(rows.where("vec is not null").groupBy("node").agg(F.count("*").alias("m"), F.min("k1").alias("first"), F.first("vec").alias("vec")), "vector-nodes")
    if scale is None or tables is None:
        scale, tables = _planned(nodes, cosine, probes, kind)
    placed = stage(nodes.select("node", "vec").mapInArrow(_place(tables, probes, scale, kind), "cell long, node binary, t int, home boolean"), "cells")
    used = placed.groupBy("cell").agg(F.sum(F.col("home").cast("int")).alias("homes"), F.count("*").alias("members")).where("homes > 0 and members > 1")
    used = stage(used.select("cell", F.ceil(F.col("members") / block).cast("int").alias("blocks")), "used-cells")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = placed.join(used, "cell").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "t", "home")
    members = members.join(nodes.select("node", "m", "vec"), "node").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = stage(members.mapInArrow(_compare(cosine, tables, probes, scale, kind), "node binary, links long, parent binary"), "vector-links")

    labels = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "m", "first").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = stage(named.groupBy("component").agg(F.min("first").alias("least")), "vector-firsts")
    of_node = stage(named.join(firsts, "component").join(links, "node", "left").select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least"), "vector-of-node")
    out = rows.select("vec_id", "k1", "node").join(of_node, "node", "left")
    least = F.coalesce("least", "k1")
    component = F.when(least < LAST, least).cast("long")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

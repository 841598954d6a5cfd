"""Near-duplicates of five-word shingle sets by min-max hashing, links confirmed on full sets (operator 7).

1. Words are lower-cased (A-Z) and hashed; a text is the set of its distinct shingles. Texts with the same word sequence
   are one node from here on (map-side combined), so a group of copies of any size is one row.
2. Signatures: each of ``2 * bands`` permutations is evaluated once and gives its minimum and its maximum. A band holds
   both values of two permutations. Two sets of similarity 0.85 share a band but for a chance of (1 - 0.85 ** 4) ** bands.
3. Buckets (band values) of two or more nodes: every member is compared with the bucket's hub, its least node.
4. Components of the confirmed links. Only buckets whose members still lie in several components are looked at again:
   all pairs of members from different components are decided there, in blocks of bounded size, without writing pairs:
   signatures rule out what cannot be similar enough (six deviations), full sets decide, and a block returns a forest.
   That completes step 3: every pair that shares a band is linked, connected already or refuted on full sets.

Null or blank texts have no shingles and are linked with nothing. Rows with equal ``doc_id`` are told apart by text; null
``doc_id`` comes after all others, so it names a component only if no row of it has one. An empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.components import connected_components
from reviewloom.llm.scratch import stage
from reviewloom.llm.text import mix, shingles, slabs, word_hashes, words

SIZE, PERCENT, BANDS, ROWS = 5, 85, 20, 4
LAST = (1 << 63) - 1
BLOCK_NODES, BLOCK_SHINGLES = 400, 1 << 19


def _factors(bands: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    n = bands * ROWS // 2
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(found: np.ndarray, factors) -> np.ndarray:
    """Minimum and maximum of the set under each permutation: [min0, max0, min1, max1, ...]."""
    a, b = factors
    low = np.full(len(a), ~np.uint64(0))
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(found), 1 << 14):
        values = (found[at : at + (1 << 14), None] ^ b) * a
        np.minimum(low, values.min(0), out=low)
        np.maximum(high, values.max(0), out=high)
    return np.stack([low, high], axis=1).ravel()


def _sets(column: pa.Array, size: int) -> Iterator[tuple[np.ndarray, bytes]]:
    """Per row its sorted distinct shingles and the 16-byte identity of its word sequence (none: empty)."""
    for slab in slabs(column):
        w = words(slab)
        hashes = word_hashes(slab, w)
        for (a, b), every in zip(zip(w.docs[:-1].tolist(), w.docs[1:].tolist()), shingles(hashes, w.docs, size)):
            if a == b:
                yield every, b""
                continue
            n = np.arange(1, b - a + 1, dtype=np.uint64)
            one = mix(hashes[a:b] + n * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
            two = mix((hashes[a:b] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xD1342543DE82EF95) + n).sum(dtype=np.uint64)
            yield np.unique(every), one.tobytes() + two.tobytes()


def _signed(size: int, bands: int):
    def run(batches):
        factors = _factors(bands)
        for batch in batches:
            node, count, band = [], [], []
            for found, name in _sets(batch.column("text"), size):
                node.append(name or None)
                count.append(len(found))
                band.append(runs_hash_rows(signature(found, factors).reshape(bands, ROWS)) if name else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(node, pa.binary()), pa.array(count, pa.int64()), pa.array(band, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "node", "n_shingles", "bands"],
            )

    return run


def runs_hash_rows(values: np.ndarray) -> np.ndarray:
    """One bucket per band: its values and its place, hashed."""
    out = np.arange(len(values), dtype=np.uint64)
    for k in range(values.shape[1]):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + values[:, k])
    return out.view(np.int64)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int((y[at] == x).sum())


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(size: int, percent: int):
    def run(batches):
        hub, hub_set = None, None
        for batch in batches:
            hubs = batch.column("b").to_pylist()
            fresh = [i for i, x in enumerate(hubs) if not i or x != hubs[i - 1]]
            sets = _sets(batch.column("hub_text").take(pa.array(fresh)), size)
            turn = dict.fromkeys(fresh)
            keep = []
            for i, (found, _) in enumerate(_sets(batch.column("text"), size)):
                if i in turn:
                    hub_set = next(sets)[0]
                keep.append(linked(found, hub_set, percent))
            kept = batch.select(["a", "b"]).filter(pa.array(keep))
            if len(kept):
                yield kept

    return run


def _decide(size: int, percent: int, bands: int):
    """Groups (key, i, j) of rows in order -> links between different components, a forest per group."""

    def group(rows):
        factors = _factors(bands)
        sides = {s: [r for r in rows if r["side"] == s] for s in (0, 1)}
        left, right = sides[0], sides[1] or sides[0]
        sets = {}
        for part in (sides[0], sides[1]):
            for r, (found, _) in zip(part, _sets(pa.array([r["text"] for r in part], pa.string()), size)):
                sets[r["node"]] = found
        sign = {k: signature(v, factors) for k, v in sets.items()}
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        n = len(factors[0]) * 2
        p = percent / 100
        least = n * p - 6 * (n * p * (1 - p)) ** 0.5
        others = np.stack([sign[r["node"]] for r in right])
        sizes = np.array([len(sets[r["node"]]) for r in right])
        names = np.array([hash(r["comp"]) for r in right])
        for i, r in enumerate(left):
            mine, count = sign[r["node"]], len(sets[r["node"]])
            alike = (others == mine).sum(1)
            near = (alike >= least) & (names != hash(r["comp"])) & (100 * np.minimum(sizes, count) >= percent * np.maximum(sizes, count))
            if right is left:
                near[: i + 1] = False
            near = np.flatnonzero(near)
            for j in near[np.argsort(-alike[near], kind="stable")].tolist():
                a, b = find(r["comp"]), find(right[j]["comp"])
                if a != b and linked(sets[r["node"]], sets[right[j]["node"]], percent):
                    root[max(a, b)] = min(a, b)
                    yield r["node"], right[j]["node"]

    def run(batches):
        held, key = [], None
        found: list = []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["key"], r["i"], r["j"]) != key:
                    if held:
                        found.extend(group(held))
                    held, key = [], (r["key"], r["i"], r["j"])
                held.append(r)
            if len(found) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])
                found = []
        if held:
            found.extend(group(held))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["a", "b"])

    return run


def minhash_dedup(docs: DataFrame, percent: int = PERCENT, size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, and k1, k2, keeper.

    ``keeper`` marks the row (k1, k2) that stays of each component, one even where ``doc_id`` is null or repeated.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text")).select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("k1"), F.xxhash64("doc_id", "text").alias("k2"), "text"
    )
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stage(keyed.mapInArrow(_signed(size, bands), f"doc_id {id_type}, k1 long, k2 long, node binary, n_shingles long, bands array<long>"), "signatures")
    nodes = stage(
        signed.where("node is not null").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("at"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "nodes",
    )
    placed = nodes.select("node", "n", F.explode("bands").alias("key"))
    several = stage(placed.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1"), "buckets")
    shared = stage(placed.join(several, "key"), "shared")

    wanted = shared.select("node").distinct().join(nodes.select("node", "at"), "node").select("node", "at.*")
    texts = stage(keyed.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text"), "texts")
    pairs = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    hubs = texts.select(F.col("node").alias("b"), F.col("text").alias("hub_text"))
    both = pairs.join(texts.withColumnRenamed("node", "a"), "a").join(hubs, "b").select("a", "b", "text", "hub_text")
    links = stage(both.mapInArrow(_confirm(size, percent), "a binary, b binary"), "links")
    labels = connected_components(links)

    # What hubs did not settle: members of one bucket in several components.
    known = shared.where("members > 2 and node <> hub").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    known = stage(known.select("key", "node", "n", F.coalesce("component", "node").alias("comp")), "known")
    open_buckets = known.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"),
    ).where("lo <> hi")
    open_buckets = open_buckets.groupBy("who", "members", "shingles").agg(F.min("key").alias("key"))  # bands that agree are one
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    open_buckets = stage(open_buckets.select("key", blocks.alias("blocks")), "open")
    if not open_buckets.isEmpty():
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        rows = known.join(open_buckets, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "comp"
        )
        rows = rows.join(texts, "node").select("key", "i", "j", "side", "node", "comp", "text")
        rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        more = stage(rows.mapInArrow(_decide(size, percent, bands), "a binary, b binary"), "more-links")
        if not more.isEmpty():
            labels = connected_components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    named = nodes.select("node", "at").join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = stage(named.groupBy("component").agg(F.min("at").alias("first")), "firsts")
    of_node = stage(named.join(firsts, "component").select("node", "first"), "of-node")
    out = signed.select("doc_id", "k1", "k2", "node", "n_shingles").join(of_node, "node", "left")
    first = F.coalesce("first", F.struct("k1", "k2"))
    component = F.when(first["k1"] < LAST, first["k1"]).cast(id_type)
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "k1", "k2",
        ((F.col("k1") == first["k1"]) & (F.col("k2") == first["k2"])).alias("keeper"),
    )


def keep_one(docs: DataFrame, percent: int = 80, bands: int = 28) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, all columns as they are."""
    stay = minhash_dedup(docs, percent, bands=bands).where("keeper").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), k1.alias("__k1"), k2.alias("__k2"))
    return keyed.join(stay, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]).select(*(F.col(f"row.`{c}`") for c in docs.columns))

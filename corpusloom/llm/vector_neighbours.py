"""The k most similar vectors of every vector: stable projections in a kd-tree with a chi-square stopping test.

Unit vectors are projected on M Gaussian (2-stable) directions, so that the squared projected distance of a pair is its
squared distance times a chi-square variable of M degrees of freedom. A kd-tree over the projections, fitted on a sample
of projected rows (SAMPLE, or eight a block where that is more), splits the collection into blocks; within a block, which
fits a task, the tree goes on to leaves over all its rows. Every vector is indexed: the rows are written once, clustered by
block and ordered by leaf, to the shared folder, and removed after the search. A task takes the queries of one block and
verifies leaves in order of projected distance, block by block. A query stops when the next leaf is further off in
projection than chi2(M, CONFIDENCE) * d_k^2, d_k being the distance of its k-th neighbour so far (or of the similarity
floor, if that is nearer): a vector closer than d_k would have been met already with that probability. A task holds two
blocks, the driver one box a block (32 bytes for every BLOCK rows); nothing is replicated in a shuffle.

Exact copies are one vector in the index and are expanded afterwards, so a group of copies costs nothing in the search.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from corpusloom.session import arrow_uri, cut, maybe_broadcast, remove, shared_dir

M = 4  # projections; even, for the closed form of the chi-square distribution
CONFIDENCE = 0.9
SAMPLE = 40_000  # rows the tree over blocks is fitted on, or eight a block where that is more
LEAF = 128  # rows of a leaf, about
BLOCK = 4096  # rows of a block, about
TASKS = 20_000  # of a stage over blocks at most
SEED = 20_240_607


def chi2_quantile(m: int, p: float) -> float:
    """p-quantile of the chi-square distribution with an even number m of degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


def directions(dims: int, m: int = M, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dims, m)).astype(np.float32)


def fit_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Split dimensions and values of a complete binary tree in heap order."""
    dim, value = np.zeros(2**depth, np.int32), np.zeros(2**depth, np.float32)

    def grow(node: int, rows: np.ndarray, left: int) -> None:
        if not left:
            return
        if len(rows):
            at = int(np.argmax(points[rows].var(0)))
            mid = np.median(points[rows, at])
            dim[node], value[node] = at, mid
            low = points[rows, at] < mid
            grow(2 * node, rows[low], left - 1)
            grow(2 * node + 1, rows[~low], left - 1)

    grow(1, np.arange(len(points)), depth)
    return dim, value


def route(points: np.ndarray, dim: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    for _ in range(depth):
        node = 2 * node + (points[np.arange(len(points)), dim[node]] >= value[node])
    return node - 2**depth


def _unit(rows: pd.Series, dims: int) -> np.ndarray:
    v = np.stack(rows.to_numpy()).astype(np.float32) if len(rows) else np.zeros((0, dims), np.float32)
    return v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _projected(proj: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"p": list(_unit(b["embedding"], len(proj)) @ proj)})

    return run


def _blocked(proj: np.ndarray, dim: np.ndarray, value: np.ndarray, bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _unit(b["embedding"], len(proj))
            yield pd.DataFrame({"block": route(v @ proj, dim, value, bits).astype("int32"), "id": b["id"], "ask": b["ask"], "vec": [x.tobytes() for x in v]})

    return run


def _leafed(proj: np.ndarray):
    """mapInPandas function over rows that come block by block: every block ordered by the leaves of its own tree."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        p = np.frombuffer(b"".join(rows["vec"]), np.float32).reshape(len(rows), -1) @ proj
        depth = max(0, round(math.log2(max(1, len(rows) / LEAF))))
        leaf = route(p, *fit_tree(p, depth), depth)
        order = np.argsort(leaf, kind="stable")
        return rows.iloc[order].assign(leaf=leaf[order].astype("int32"))[["block", "leaf", "id", "ask", "vec"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            for block, rows in b.groupby("block", sort=False):
                if held and held[0]["block"].iloc[0] != block:
                    yield one(pd.concat(held))
                    held = []
                held.append(rows)
        if held:
            yield one(pd.concat(held))

    return run


class Blocks:
    """Reads one block of the written index: leaf numbers, ids, unit vectors."""

    def __init__(self, path: str, dims: int):
        from pyarrow import fs

        self.fs, self.path = fs.FileSystem.from_uri(arrow_uri(path))
        self.dims = dims

    def read(self, block: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        import pyarrow as pa

        parts = sorted(x.path for x in self.fs.get_file_info(fs.FileSelector(f"{self.path}/block={block}", allow_not_found=True)) if x.path.endswith(".parquet"))
        if not parts:
            return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros((0, self.dims), np.float32), np.zeros(0, bool)
        t = pa.concat_tables([pq.ParquetFile(self.fs.open_input_file(p)).read(columns=["leaf", "id", "ask", "vec"]) for p in parts]).combine_chunks()
        leaf = t["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        if (order[1:] < order[:-1]).any():
            t, leaf = t.take(order), leaf[order]
        vec = t["vec"].combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        start = np.frombuffer(vec.buffers()[1], np.int32, 1, vec.offset * 4)[0]
        vecs = np.frombuffer(vec.buffers()[2], np.float32, len(vec) * self.dims, int(start)).reshape(-1, self.dims)
        return leaf, t["id"], vecs, t["ask"].to_numpy(zero_copy_only=False)


def _boxes(path: str, proj: np.ndarray, dims: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(path, dims)
        for b in batches:
            for block in b["id"]:
                leaf, _, v, _ = blocks.read(int(block))
                if not len(leaf):
                    continue
                p = v @ proj
                yield pd.DataFrame({"block": [np.int32(block)], "low": [p.min(0)], "high": [p.max(0)]})

    return run


def _gap2(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Least squared distance between boxes: [a, b]."""
    gap = np.maximum(0, np.maximum(low_b[None] - high_a[:, None], low_a[:, None] - high_b[None]))
    return (gap * gap).sum(2)


def _search(path: str, names: np.ndarray, block_low: np.ndarray, block_high: np.ndarray, proj: np.ndarray, dims: int, k: int, floor: float | None, confidence: float):
    stretch = chi2_quantile(proj.shape[1], confidence)
    floor_d2 = np.inf if floor is None else 2 - 2 * floor

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = Blocks(path, dims)
        for b in batches:
            for block in b["id"]:
                if names[min(len(names) - 1, np.searchsorted(names, block))] == block:
                    yield one(blocks, int(block))

    def one(blocks: Blocks, block: int) -> pd.DataFrame:
        q_leaf, q_ids, q, ask = blocks.read(block)
        ask = ask.astype(bool)
        q_leaf, q_ids, q = q_leaf[ask], q_ids.to_numpy(zero_copy_only=False)[ask], q[ask]  # the stated query set
        n = len(q_ids)
        empty = pd.DataFrame({"id": [], "other": [], "similarity": []}).astype({"id": str, "other": str, "similarity": float})
        if not n:
            return empty
        qp = q @ proj
        best = np.full((n, k), -np.inf, np.float32)
        who = np.full((n, k), None, object)
        starts = np.flatnonzero(np.r_[True, q_leaf[1:] != q_leaf[:-1]])
        ends = np.r_[starts[1:], n]
        q_low, q_high = np.minimum.reduceat(qp, starts), np.maximum.reduceat(qp, starts)
        gaps = _gap2(q_low.min(0)[None], q_high.max(0)[None], block_low, block_high)[0]
        gaps[np.searchsorted(names, block)] = -1.0  # its own block first
        for at in np.argsort(gaps, kind="stable"):
            radius2 = stretch * np.minimum(floor_d2, np.maximum(0, 2 - 2 * best[:, k - 1]))
            if gaps[at] > radius2.max():
                break
            if not (_gap2(q_low, q_high, block_low[at : at + 1], block_high[at : at + 1])[:, 0] <= np.maximum.reduceat(radius2, starts)).any():
                continue
            d_leaf, d_ids, d, _ = blocks.read(int(names[at]))
            dp = d @ proj
            d_start = np.flatnonzero(np.r_[True, d_leaf[1:] != d_leaf[:-1]])
            d_end = np.r_[d_start[1:], len(d_leaf)]
            low, high = np.minimum.reduceat(dp, d_start), np.maximum.reduceat(dp, d_start)
            wanted = _gap2(q_low, q_high, low, high) <= np.maximum.reduceat(radius2, starts)[:, None]
            group = np.repeat(np.arange(len(starts)), ends - starts)
            for x in np.flatnonzero(wanted.any(0)):
                mine = np.flatnonzero(wanted[group, x])
                gap = np.maximum(0, np.maximum(low[x] - qp[mine], qp[mine] - high[x]))
                mine = mine[(gap * gap).sum(1) <= radius2[mine]]  # the others have stopped
                if not len(mine):
                    continue
                a, z = d_start[x], d_end[x]
                sims = q[mine] @ d[a:z].T
                least = best[mine, k - 1] if floor is None else np.maximum(best[mine, k - 1], np.float32(floor - 1e-4))
                hits = sims >= least[:, None]
                if not hits.any():
                    continue
                for i in np.flatnonzero(hits.any(1)):
                    c = np.flatnonzero(hits[i])
                    if len(c) > 4 * k + 4:
                        kth = np.partition(sims[i, c], len(c) - k - 1)[len(c) - k - 1]
                        c = c[sims[i, c] >= kth]
                    m = mine[i]
                    names_c = d_ids.take(a + c).to_numpy(zero_copy_only=False)
                    other = names_c != q_ids[m]
                    merged = np.concatenate([best[m], sims[i, c][other]])
                    whose = np.concatenate([who[m], names_c[other]])
                    order = np.lexsort((whose.astype(str), -merged))[:k]
                    best[m], who[m] = merged[order], whose[order]
        found = best > (-np.inf if floor is None else floor - 1e-4)
        i, j = np.nonzero(found)
        if not len(i):
            return empty
        return pd.DataFrame({"id": q_ids[i], "other": who[i, j], "similarity": best[i, j].astype(float)})

    return run


def query_number(vector_id: str) -> int:
    """An id as a number, for query sets by divisibility: digits as they are, others as hexadecimal of what is hexadecimal in them."""
    if vector_id.isdigit():
        return int(vector_id)
    kept = "".join(c for c in vector_id.lower() if c in "0123456789abcdef")
    return int(kept, 16) if kept else 0


def _divisible(modulus: int):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield s.map(lambda x: query_number(x) % modulus == 0).astype(bool)

    return F.pandas_udf(run, "boolean")


def usable(vectors: DataFrame, dims: int = 64) -> DataFrame:
    """(id, embedding), repeated rows still in; null, wrongly sized, all-zero and non-finite embeddings and null ids are left out."""
    ok = "id is not null and size(embedding) = {0} and exists(embedding, x -> x <> 0) and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))".format(dims)
    return vectors.select("id", "embedding").where(ok)


def nearest(vectors: DataFrame, k: int = 10, floor: float | None = None, dims: int = 64, confidence: float = CONFIDENCE, modulus: int | None = None) -> DataFrame:
    """(id, other, similarity, place): up to k most similar other vectors of every vector, ties by id.

    floor: only neighbours of at least this similarity are wanted. modulus: only ids divisible by it are queries.
    Fewer than two usable vectors give no row.
    """
    spark = vectors.sparkSession
    good = usable(vectors, dims).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(7), "embedding"), "ask": _divisible(modulus)("id") if modulus else F.lit(True)})
    members = cut(good.select("id", "h", "g").distinct())  # without the vectors
    n = members.count()
    if n == 0:
        return spark.createDataFrame([], "id string, other string, similarity double, place int")
    groups = cut(members.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    copies = members.join(groups, ["h", "g"]).select("id", "rep")
    proj = directions(dims)
    bits = max(0, round(math.log2(max(1, n / BLOCK))))
    size = max(SAMPLE, 8 << bits)
    rows = good.sample(fraction=min(1.0, size / n), seed=7).select("embedding").mapInPandas(_projected(proj), "p array<float>").limit(2 * size).collect() if bits else []
    dim, value = fit_tree(np.array([r[0] for r in rows], np.float32).reshape(-1, M), bits)
    path = f"{shared_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    # of a group of copies one vector is indexed; it is a query if any of the copies is
    single = good.join(copies.where("id <> rep").select("id"), "id", "left_anti") if not modulus else good.join(copies.select("id"), "id", "left_anti").unionByName(_asking_representatives(good, copies))
    blocked = single.select("id", "ask", "embedding").mapInPandas(_blocked(proj, dim, value, bits), "block int, id string, ask boolean, vec binary")
    once = blocked.repartition(int(min(2**bits, TASKS)), "block").dropDuplicates(["block", "id"]).sortWithinPartitions("block")
    once.mapInPandas(_leafed(proj), "block int, leaf int, id string, ask boolean, vec binary").write.partitionBy("block").parquet(path)
    tasks = spark.range(2**bits).repartition(int(min(2**bits, TASKS)))
    boxes = tasks.mapInPandas(_boxes(path, proj, dims), "block int, low array<float>, high array<float>").toPandas().sort_values("block")  # one row a block
    search = _search(path, boxes["block"].to_numpy(), np.stack(boxes["low"].to_numpy()), np.stack(boxes["high"].to_numpy()), proj, dims, k, floor, confidence)
    found = cut(tasks.mapInPandas(search, "id string, other string, similarity double"))
    remove(spark, path)
    return _with_copies(found, copies, k, floor, modulus)


def _asking_representatives(good: DataFrame, copies: DataFrame) -> DataFrame:
    own = good.select("id", "ask").distinct().join(copies, "id").groupBy("rep").agg(F.bool_or("ask").alias("ask"))
    return good.drop("ask").join(own.withColumnRenamed("rep", "id"), "id").select(*good.columns)


def _with_copies(found: DataFrame, copies: DataFrame, k: int, floor: float | None, modulus: int | None) -> DataFrame:
    """Expands groups of copies (id, rep): every copy is a query; as neighbours, the k + 1 first ids of a group are all that can count."""
    if floor is not None:
        found = found.where(F.col("similarity") >= floor)
    pairs = found
    members = cut(copies)
    if not members.isEmpty():
        targets = cut(members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).drop("n"))
        few, size = maybe_broadcast, targets.count()  # the small side of every join with a group, so that a large group is not gathered
        own = members.join(few(targets.withColumnRenamed("id", "other"), size, 200), "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("similarity"))
        t = targets.select(F.col("rep").alias("other"), F.col("id").alias("t"))
        out = cut(found.join(few(t, size, 200), "other", "left").select("id", F.coalesce("t", "other").alias("other"), "similarity"))
        reps = few(targets.select(F.col("rep").alias("id")).distinct(), size, 100)
        asked = cut(out.join(reps, "id", "left_semi").withColumnRenamed("id", "rep"))
        pairs = out.join(reps, "id", "left_anti").unionByName(members.join(few(asked, asked.count(), 200), "rep").select("id", "other", "similarity")).unionByName(own)
    if modulus:
        pairs = pairs.where(_divisible(modulus)("id"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return pairs.withColumn("place", place).where(F.col("place") <= k)


def near_pairs(vectors: DataFrame, floor: float = 0.9, k: int = 10, dims: int = 64) -> DataFrame:
    """(id_a, id_b): pairs of at least `floor` similarity of which one is among the k most similar of the other."""
    n = nearest(vectors, k, floor, dims)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

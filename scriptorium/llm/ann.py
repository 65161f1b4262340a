"""Nearest neighbours by inner product: adaptive dimension scan in lists, with bounds that are sure.

Vectors are put in lists by their nearest of some centroids, and turned to the
axes of the most weight, so that the first columns tell most of a product.  A
query passes over the lists that cannot reach its ``k`` best so far (centroid's
product and the query's length times the list's radius), and scans the others
in blocks of columns: a candidate is abandoned as soon as its product and the
lengths of both rests cannot reach them either.  Bounds grant ``ERROR`` of both
lengths for rounding, so nothing that belongs in a result is lost: the scan is
exact whatever the vectors are.  Where bounds say little (vectors of one length
without clusters) the work is that of all products.

Equal vectors are one candidate with their smallest ids, as many as a result
can name of them, and equal queries are searched once, so a very
frequent vector costs no more than others.  Vectors lie in parts of about ``HELD`` bytes,
list by list, and queries in blocks of as many; each block meets each part, so no task holds more
than a part and a block.  Centroids and axes are fitted on at most ``SAMPLE`` vectors (a documented bound);
every vector is indexed.  What is broadcast is the centroids.

Defined results: vectors that are null, zero, of another length than most, or
that hold null or non-finite components take no part, nor do those without id;
rows of one id are never each other's neighbours; equal rows count once; ties go
to the smaller id; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.llm.runtime import Scratch

K = 20
SAMPLE = 20_000
MAX_LISTS = 1024
#: Bytes of the vectors of a part, and of a block of queries; a small table is dealt over the cores in parts of ``LEAST_PART`` vectors and more.
HELD = 16 << 20
LEAST_PART = 1024
#: Queries and vectors whose products are made at once.
AT_ONCE = 256
GROUP = 1024
COLUMNS = 16
#: Share of pairs left from which on they are looked at one by one.
SPARSE = 0.1
ERROR = 1e-9


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def axes(sample: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that turns the sample's axes of the most weight to the first columns."""
    scaled = sample / np.abs(sample).max()
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


def fit_centroids(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k-means from ``n`` different rows of the sample."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        near = nearest(sample, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centroids))
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row."""
    return ((centroids**2).sum(axis=1) - 2 * rows @ centroids.T).argmin(axis=1)


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows**2).sum(axis=1))


def adaptive_scan(queries: np.ndarray, rows: np.ndarray, lists: np.ndarray, ids: np.ndarray, centroids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, product) of the ``k`` best rows of each query, ties to the smaller of ``ids``; ``rows`` lie list by list."""
    n, dim = rows.shape
    edges = [*range(min(COLUMNS, dim), dim, COLUMNS), dim]
    turned_q, turned = queries @ turn, rows @ turn
    long_q, long = _lengths(queries), _lengths(rows)
    # lengths of what is left after each block, and of the whole for rounding: their products are what a pair may still gain
    rest_q = [np.stack([_lengths(turned_q[:, e:]), ERROR * long_q], axis=1) for e in edges]
    rest = [np.stack([_lengths(turned[:, e:]), long]) for e in edges]
    plain_q, plain = np.ascontiguousarray(queries.T), np.ascontiguousarray(rows.T)
    groups = np.arange(0, n, GROUP)
    cuts = np.union1d(groups, np.flatnonzero(np.diff(lists)) + 1)
    of = centroids[lists[cuts]]
    radius = np.maximum.reduceat(_lengths(rows - centroids[lists]), cuts)
    radius = radius + ERROR * (radius + _lengths(of))
    first = np.searchsorted(cuts, groups)
    out = []
    for start in range(0, len(queries), AT_ONCE):
        here = slice(start, start + AT_ONCE)
        reach = np.maximum.reduceat(queries[here] @ of.T + long_q[here, None] * radius, first, axis=1)
        bar = np.full(len(reach), -math.inf)
        by, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for g in np.argsort(-reach.mean(axis=0)):
            asks = np.flatnonzero(~(reach[:, g] < bar))
            if not len(asks):
                continue
            lo, hi = groups[g], min(groups[g] + GROUP, n)
            i, j = _reaching(turned_q[start + asks], turned[lo:hi], [r[start + asks] for r in rest_q], [r[:, lo:hi] for r in rest], edges, bar[asks], k)
            if not len(i):
                continue
            i, j = asks[i], j + lo
            product = np.zeros(len(i))
            for own, its in zip(plain_q, plain):
                product += own[start + i] * its[j]
            by, at, score = np.concatenate([by, i]), np.concatenate([at, j]), np.concatenate([score, product])
            order = np.lexsort((ids[at], -score, by))
            by, at, score = by[order], at[order], score[order]
            rank = np.arange(len(by)) - np.searchsorted(by, by)
            bar[by[rank == k - 1]] = score[rank == k - 1]
            by, at, score = by[rank < k], at[rank < k], score[rank < k]
        out.append((by + start, at, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def _reaching(queries: np.ndarray, rows: np.ndarray, rest_q: list[np.ndarray], rest: list[np.ndarray], edges: list[int], bar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all pairs that may be among the ``k`` best of a query whose ``k``-th product is ``bar`` so far."""
    product = queries[:, : edges[0]] @ rows[:, : edges[0]].T
    alive = ~(product + rest_q[0] @ rest[0] < bar[:, None])
    for b in range(1, len(edges)):
        cols = slice(edges[b - 1], edges[b])
        if alive.mean() < SPARSE:
            i, j = np.nonzero(alive)
            product = product[i, j]
            for c in range(b, len(edges)):
                cols = slice(edges[c - 1], edges[c])
                product = product + np.einsum("ij,ij->i", queries[i, cols], rows[j, cols])
                keep = ~(product + np.einsum("ij,ji->i", rest_q[c][i], rest[c][:, j]) < bar[i])
                i, j, product = i[keep], j[keep], product[keep]
            return i, j
        product += queries[:, cols] @ rows[:, cols].T
        alive &= ~(product + rest_q[b] @ rest[b] < bar[:, None])
    if len(rows) > k:
        slack = rest_q[-1] @ rest[-1]
        least = np.partition(product - slack, len(rows) - k, axis=1)[:, len(rows) - k]
        alive &= ~(product + slack < least[:, None])
    return np.nonzero(alive)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _listed(index: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(list, key, first, vec): the list of each row, its least id and its vector's bytes."""
    sent = index.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(2), sent.value.shape[1])
                packed = pa.array([x.tobytes() for x in vectors.astype("<f8")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(nearest(vectors, sent.value).astype(np.int32)), batch.column(0), batch.column(1), packed], ["list", "key", "first", "vec"])

    return index.select("key", F.get("ids", F.lit(0)).alias("first"), "vec").mapInArrow(run, "list int, key bigint, first bigint, vec binary")


def search(vectors: DataFrame, scratch: Scratch, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of each query; score is the inner product in double precision."""
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty)
    dim = sizes["n"]
    rows = rows.where(F.size("vec") == dim).withColumn("key", F.xxhash64("vec"))
    # of the best rows, those of the query's own id go: as many as that has different vectors
    most = k + (rows.where("asks").groupBy("id").agg(F.count_distinct("key").alias("n")).agg(F.max("n")).first()[0] or 1)
    order = Window.partitionBy("key").orderBy("id")
    firsts = rows.groupBy("key", "id").agg(F.first("vec").alias("vec")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    index = scratch.keep(firsts.groupBy("key").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "index")
    asked = scratch.keep(rows.where("asks").select("id", "key").distinct(), "asked")
    keys = asked.select("key").distinct()
    n, n_keys = index.count(), keys.count()
    if not n_keys:
        return vectors.sparkSession.createDataFrame([], empty)

    drawn = index.orderBy(F.xxhash64("key"), "key").limit(sample).select("vec").toArrow().column(0)
    drawn = _matrix(drawn, dim)
    n_lists = max(1, min(MAX_LISTS, round(2 * math.sqrt(n)), len(drawn)))
    turn = axes(drawn)
    centroids = fit_centroids(drawn, n_lists)
    centroids = centroids[np.argsort(centroids @ turn[:, 0])]

    placed = scratch.keep(_listed(index, centroids), "lists", compression="none")
    per = max(1, HELD // (8 * dim))
    blocks = math.ceil(n_keys / per)
    n_parts = max(math.ceil(n / per), min(math.ceil(n / LEAST_PART), math.ceil(vectors.sparkSession.sparkContext.defaultParallelism / blocks)))
    sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # a row for each list: MAX_LISTS at most
    before = np.cumsum([0, *[sizes.get(x, 0) for x in range(len(centroids))]])
    spans = vectors.sparkSession.createDataFrame([(x, int(before[x]), c) for x, c in sizes.items()], "list int, before bigint, size bigint")
    place = F.col("before") + F.pmod(F.xxhash64("key"), F.col("size"))
    candidates = placed.join(F.broadcast(spans), "list").select(
        F.floor(place * n_parts / n).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "list", "key", "first", "vec"
    )
    wanted = placed.join(keys, "key", "left_semi").select(
        F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.col("list").alias("at"), F.col("key").alias("q"), F.col("vec").alias("asked")
    )
    sent = vectors.sparkSession.sparkContext.broadcast((centroids, turn))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("key", pa.int64()), ("first", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left, right = left.sort_by("at"), right.sort_by("list")
        ask, have = (np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim) for column in (left.column("asked"), right.column("vec")))
        lists, first = right.column("list").to_numpy(), right.column("first").to_numpy()
        by, at, score = adaptive_scan(ask, have, lists, first, *sent.value, most)
        return pa.Table.from_arrays([pa.array(left.column("q").to_numpy()[by]), pa.array(right.column("key").to_numpy()[at]), pa.array(first[at]), pa.array(score)], schema=schema)

    grid = ["part", "block"]
    found = wanted.groupBy(*grid).cogroup(candidates.groupBy(*grid)).applyInArrow(cell, "q bigint, key bigint, first bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first", "key")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)
    scored = found.join(index.select("key", "ids"), "key").select("q", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = scored.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= most).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("top"))
    own = asked.join(top, asked["key"] == top["q"])
    others = F.slice(F.filter("top", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op8_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all."""
    scratch = Scratch(spark, "op8")
    return scratch.until_exit(search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scratch, F.col("vec_id") % 20 == 0))

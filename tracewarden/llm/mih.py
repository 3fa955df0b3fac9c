"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Vectors are lifted by one coordinate so that all have the greatest norm; largest inner product then means smallest
angle. On a bounded sample ``TABLES`` orthogonal rotations are learned by iterative quantization from different starts;
the signs of the rotated vectors are the code. Codes are split into substrings, each with an index of its own. Two codes
within a radius agree in some substring up to radius / substrings (pigeonhole), so probing each index that far finds
every code within it. What is found is verified on whole codes and reranked by exact inner products.

Radius and probing step are learned on the sample: the radius holds ``SAMPLE_RECALL`` of its neighbours, and the step is the
least that finds as many. By the pigeonhole every code within substrings * (step + 1) - 1 is found; most of those between
that and the radius are found as well, as the differing bits of a pair are spread unevenly over so many substrings. (For
neighbours that are nearly at right angles, as in unclustered data, a step of radius / substrings would visit two fifths of
all buckets.) Neighbours in all rows are nearer than in a sample, so both err to the safe side. A query for which fewer
codes than it needs are found takes its nearest codes, in a second pass.

All rows are indexed. Rows and queries are dealt into blocks of bounded size, and each pair of blocks is one task's work:
the stated query set against all rows. Only the k best of a block leave it.

Defined results: vectors that are null, zero, hold null or non-finite numbers, differ from the most common length or have
no vec_id take no part; of repeated query ids one asks (the smallest vector); a row with the query's id is never its
neighbour; other repeated rows are neighbours each; ties go to the smaller vec_id; fewer rows than k give them all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewarden.llm.common import materialize, table

K = 20
TABLES = 8
#: Rows of the bounded sample on which rotations and radius are learned.
SAMPLE_ROWS = 8192
SAMPLE_RECALL = 0.98
SUBSTRING_BITS = 16
#: With fewer rows than so many times the buckets to visit, occupied buckets are looked through.
SPARSE = 8
#: Rows and queries of a block.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 32_768
#: A small table is cut into smaller blocks, for parallel work; each block gives k rows a query, so not into too many.
LEAST_ROWS, MOST_SMALL_BLOCKS = 4096, 64
RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id, embedding (array<float> if it is one, else array<double>) of the rows that take part, and their dimension (0 if there are none)."""
    single = vectors.select(embedding).schema[0].dataType.simpleString() == "array<float>"
    e = F.col(embedding).cast("array<float>" if single else "array<double>")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    good = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
    most = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (good.filter(F.size("embedding") == most["d"]), int(most["d"])) if most else (good, 0)


class Hasher:
    """Rotations learned on a sample; codes as rows of unsigned 64-bit words."""

    def __init__(self, sample: np.ndarray, norm: float, k: int, seed: int = 7, rounds: int = 25):
        self.norm = norm
        lifted = self.lift(sample)
        rng = np.random.default_rng(seed)
        bits = min(64, lifted.shape[1])
        _, vectors = np.linalg.eigh(lifted.T @ lifted)
        axes = vectors[:, ::-1][:, :bits]
        flat = lifted @ axes
        rotations = []
        for _ in range(TABLES):
            r = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
            for _ in range(rounds):  # iterative quantization: nearest corners, then the rotation that fits them
                u, _, vt = np.linalg.svd(flat.T @ np.sign(flat @ r))
                r = u @ vt
            rotations.append(axes @ r)
        self.axes = np.hstack(rotations)
        self.bits = self.axes.shape[1]
        self.radius, self.step = self._learn_radius(sample, k)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))]

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        lifted = np.c_[x, np.zeros(len(x))] if query else self.lift(x)
        bits = np.zeros((len(x), 64 * math.ceil(self.bits / 64)), np.uint8)
        bits[:, : self.bits] = lifted @ self.axes > 0
        return np.packbits(bits, axis=1).view(np.uint64)

    def parts(self, codes: np.ndarray) -> np.ndarray:
        """The substrings of codes, without those that hold padding alone."""
        return codes.view(np.uint16)[:, : math.ceil(self.bits / SUBSTRING_BITS)]

    def _learn_radius(self, sample: np.ndarray, k: int) -> tuple[int, int]:
        """The Hamming distance that holds SAMPLE_RECALL of the k nearest of some of the sample's rows, and the step that finds as many."""
        n = len(sample)
        ask = np.arange(0, n, max(1, n // 500))
        scores = sample[ask] @ sample.T
        scores[np.arange(len(ask)), ask] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
        a, b = self.codes(sample[ask], query=True), self.codes(sample)
        far = np.bitwise_count(a[:, None, :] ^ b[near]).sum(axis=2)
        if not far.size:
            return self.bits, SUBSTRING_BITS
        radius = int(np.quantile(far, SAMPLE_RECALL))
        parts = np.bitwise_count(self.parts(a)[:, None, :] ^ self.parts(b)[near]).min(axis=2)
        return radius, min(int(np.quantile(parts, SAMPLE_RECALL, method="higher")), radius // self.parts(b).shape[1])


class SubstringIndex:
    """The codes of one block; for each substring, its values' rows in one sorted array.

    A block with few rows for the buckets to visit holds mostly empty ones. There the occupied buckets are looked through
    instead, each row standing for its own; the rows found are the same.
    """

    def __init__(self, codes: np.ndarray, parts: np.ndarray, step: int):
        self.codes, self.step = codes, step
        values = np.arange(2**SUBSTRING_BITS, dtype=np.uint16)
        self.masks = values[np.bitwise_count(values) <= step]
        self.occupied = np.ascontiguousarray(parts.T) if len(codes) < SPARSE * len(self.masks) else None
        if self.occupied is not None:
            return
        self.order = np.argsort(parts, axis=0, kind="stable").T.astype(np.int32)
        self.start = np.zeros((parts.shape[1], 2**SUBSTRING_BITS + 1), np.int32)
        for p, start in zip(parts.T, self.start):
            np.cumsum(np.bincount(p, minlength=2**SUBSTRING_BITS), out=start[1:])
        self.seen = np.zeros(len(codes), bool)

    def probe(self, parts: np.ndarray) -> np.ndarray:
        """Rows of which some substring differs from the query's in at most step bits."""
        if self.occupied is not None:
            return np.flatnonzero((np.bitwise_count(self.occupied ^ parts[:, None]) <= self.step).any(axis=0))
        self.seen[:] = False
        for own, order, start in zip(parts, self.order, self.start):
            bucket = (own ^ self.masks).astype(np.int32)
            lo = start[bucket]
            size = start[bucket + 1] - lo
            full = np.flatnonzero(size)
            lo, size = lo[full], size[full]
            ends = np.cumsum(size)
            if len(ends):
                self.seen[order[np.repeat(lo - (ends - size), size) + np.arange(ends[-1])]] = True
        return np.flatnonzero(self.seen)

    def within(self, code: np.ndarray, parts: np.ndarray, radius: int) -> np.ndarray:
        """The rows found by probing whose codes are within the radius."""
        rows = self.probe(parts)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= radius]

    def nearest(self, code: np.ndarray, least: int) -> np.ndarray:
        """The `least` rows with the nearest codes, ties included."""
        far = np.bitwise_count(self.codes ^ code).sum(axis=1)
        if len(far) <= least:
            return np.arange(len(far))
        return np.flatnonzero(far <= np.partition(far, least - 1)[least - 1])


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0)).astype(np.float64, copy=False).reshape(-1, d)


def best(rows_id: np.ndarray, rows: np.ndarray, at: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """vec_id and score of the k best of rows[at] other than own. Each score is summed the same way in every block."""
    at = at[rows_id[at] != own]
    score = (rows[at] * query).sum(axis=1)
    if len(at) > k:
        edge = np.partition(score, len(at) - k)[len(at) - k]
        keep = score >= edge
        at, score = at[keep], score[keep]
    order = np.lexsort((rows_id[at], -score))[:k]
    return rows_id[at][order], score[order]


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query holds."""
    spark = vectors.sparkSession
    good, d = usable(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not d:
        return empty
    good = materialize(good, "vectors")
    norm, n = good.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))), F.count("*")).first()
    sample = good.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id", "embedding").limit(SAMPLE_ROWS).select("embedding").toArrow()
    hasher = Hasher(_matrix(sample.column(0), d), float(norm), k)
    queries = good.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = queries.count()
    if not asked:
        return empty
    across = max(1, math.ceil(asked / BLOCK_QUERIES))
    down = max(math.ceil(n / BLOCK_ROWS), min(math.ceil(n / LEAST_ROWS), MOST_SMALL_BLOCKS))
    query_cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: (i * across + F.pmod(F.xxhash64("vec_id"), F.lit(across))).cast("long")))
    tagged = good.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(down)))
    row_cells = F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: (F.col("block") * across + j).cast("long")))
    left = tagged.select(row_cells.alias("cell"), "vec_id", "embedding")

    def meet(some: DataFrame, nearest: bool) -> DataFrame:
        def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
            ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding"), d)
            out_q, out_v, out_s = [], [], []
            if len(ids) and asks.num_rows:
                codes = hasher.codes(x)
                index = SubstringIndex(codes, hasher.parts(codes), hasher.step)
                q = _matrix(asks.column("embedding"), d)
                asked_codes = hasher.codes(q, query=True)
                asked_parts = hasher.parts(asked_codes)
                for i, own in enumerate(asks.column("vec_id").to_pylist()):
                    at = index.nearest(asked_codes[i], k + int((ids == own).sum())) if nearest else index.within(asked_codes[i], asked_parts[i], hasher.radius)
                    v, s = best(ids, x, at, q[i], own, k)
                    out_q.append(np.full(len(v), own, np.int64))
                    out_v.append(v)
                    out_s.append(s)
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            return pa.table([join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.float64)], names=["query_id", "vec_id", "score"])

        right = some.select(query_cells.alias("cell"), "vec_id", "embedding")
        return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, RESULT)

    found = materialize(meet(queries, False), "found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialize(queries.join(enough, "vec_id", "left_anti"), "short")
    if not short.isEmpty():
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(meet(short, True))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, among all other rows."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)

"""Exact top-k inner-product search over norm-sorted vectors.

Vectors are taken as integers, floor(scale * x). They are split into bands of
descending length, and bands into blocks of bounded size. A head of the longest
vectors gives every query a first threshold; a query goes only to blocks whose longest
vector can still reach it. In a block, vectors are processed by descending length:
the first coordinates after rotation by the singular vectors give partial sums, the
Cauchy-Schwarz bound on the rest prunes, and what survives is scored exactly in
integers. Nothing approximate is returned.

Vectors that are null, or hold null or non-finite components, and rows without an id
take no part. Vectors of unequal length count as padded with zeros. Rows that share an
id are rows of their own, as queries (each with its own ranks) and as candidates, also
of one another. Ties go to the smaller id; with fewer than k candidates all are
returned. Scores beyond a 64-bit integer are clipped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexspark.llm.common import map_batches, ship, stored

HEAD = 2048
BLOCK = 16384
QUERY_BLOCK = 2048
MOST_BANDS = 16
CHUNK = 1024
LONG = 2**63 - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v (array<double> of whole numbers), norm`` of the rows that take part."""
    vec = F.col(f"`{vec_col}`")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c):
        # Doubles of 2**52 and more are whole; floor() of a double is a long in Spark.
        x = c.cast("double") * F.lit(float(scale))
        return F.when(F.abs(x) < float(2**52), F.floor(F.when(F.abs(x) < float(2**52), x)).cast("double")).otherwise(x)

    return (
        df.where(F.col(f"`{id_col}`").isNotNull() & vec.isNotNull())
        .where(finite)
        .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(vec, whole).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)))
        .withColumn("row", F.monotonically_increasing_id())
    )


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of a matrix, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), dim))
    n = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products, exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    s = (whole(q) * whole(v)).sum(1)
    return np.array([max(-LONG - 1, min(LONG, int(x))) for x in s], np.int64)


class Best:
    """The k best (score, smaller id first) of each of n queries."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.heaps, self.floor = k, [[] for _ in range(n)], floor.copy()

    def add(self, row: int, score: int, vec_id: int) -> None:
        heap = self.heaps[row]
        item = (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
        if len(heap) == self.k and heap[0][0] > self.floor[row]:
            self.floor[row] = heap[0][0]


def search_block(q_rows: np.ndarray, q: np.ndarray, floor: np.ndarray, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int, lead: int) -> Best:
    """The best of a block for each query. ``floor``: a score that k candidates reach
    somewhere, so lower ones don't matter. ``q_rows``, ``rows``: which row each is."""
    norm = np.sqrt((v * v).sum(1))
    order = np.argsort(-norm, kind="stable")
    v, ids, rows, norm = v[order], ids[order], rows[order], norm[order]
    qn = np.sqrt((q * q).sum(1))
    qr, vr = q @ rotation, v @ rotation
    q1, v1 = qr[:, :lead], vr[:, :lead]
    q2, v2 = np.sqrt((qr[:, lead:] ** 2).sum(1)), np.sqrt((vr[:, lead:] ** 2).sum(1))
    best = Best(len(q), k, floor)
    for a in range(0, len(v), CHUNK):
        slack = 1e-9 * (qn * norm[a] + 1)
        live = np.flatnonzero(qn * norm[a] + slack >= best.floor)
        if not len(live):
            break  # later vectors are shorter
        b = a + CHUNK
        bound = q1[live] @ v1[a:b].T + q2[live][:, None] * v2[None, a:b] + slack[live][:, None]
        bound[q_rows[live][:, None] == rows[None, a:b]] = -np.inf
        for k0 in range(0, len(live), 256):
            part = bound[k0 : k0 + 256]
            # The k-th best exact score among the highest bounds raises the threshold first.
            if part.shape[1] > 4 * k:
                top = np.argpartition(-part, k, axis=1)[:, :k]
                each, cols = np.repeat(np.arange(len(part)), k), top.ravel()
                real = np.isfinite(part[each, cols])
                s = np.where(real, exact_scores(q[live[k0 + each]], v[a + cols]), -LONG).reshape(len(part), k).min(1)
                low = np.maximum(best.floor[live[k0 : k0 + 256]], s.astype(float))
            else:
                low = best.floor[live[k0 : k0 + 256]]
            r, c = np.nonzero((part >= low[:, None]) & np.isfinite(part))  # not the query's own row
            scores = exact_scores(q[live[k0 + r]], v[a + c])
            keep = scores >= best.floor[live[k0 + r]]
            for i, s, j in zip(live[k0 + r[keep]].tolist(), scores[keep].tolist(), ids[a + c[keep]].tolist(), strict=True):
                best.add(i, s, j)
    return best


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, every: int = 50, lead: int = 16) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every id divisible by ``every``, the k
    highest inner products among all other rows."""
    spark = df.sparkSession
    ship(spark)
    # Written once: the statistics, the head and both sides of the search read it.
    vectors = stored(integer_vectors(df, id_col, vec_col, scale))
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n or not dim:
        return spark.createDataFrame([], empty)

    def gram(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column("v"), dim)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(dim * dim), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    cells = map_batches(vectors.select("v"), gram, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    g = np.zeros(dim * dim)
    for r in cells:
        g[r.cell] = r.value
    _, rotation = np.linalg.eigh(g.reshape(dim, dim))
    rotation = np.ascontiguousarray(rotation[:, ::-1])

    bands = max(1, min(MOST_BANDS, n // 4096))
    edges = sorted(set(vectors.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)] or [0.5], 10000)).first()[0])) if bands > 1 else []
    # Bands from the longest vectors to the shortest; ``tops``: the longest in each.
    band = sum((F.when(F.col("norm") < e, 1).otherwise(0) for e in edges), F.lit(0))
    sized = vectors.withColumn("band", band)
    held = {r.band: r for r in sized.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("top")).collect()}
    splits = [-(-held[b].n // BLOCK) if b in held else 0 for b in range(len(edges) + 1)]
    tops = np.array([held[b].top if b in held else -1.0 for b in range(len(edges) + 1)])

    head = vectors.orderBy(F.desc("norm"), "vec_id").limit(HEAD).collect()
    head_rows, head_ids = (np.array([r[c] for r in head], np.int64) for c in ("row", "vec_id"))
    head_v = np.zeros((len(head), dim))
    for i, r in enumerate(head):
        head_v[i, : len(r.v)] = r.v

    def routed(batches):
        """Each query's threshold, and the bands that may hold one of its best."""
        for batch in batches:
            rows, q = np.asarray(batch.column("row")), _matrix(batch.column("v"), dim)
            for a in range(0, len(rows), 512):
                qa, ra = q[a : a + 512], rows[a : a + 512]
                first = search_block(ra, qa, np.full(len(ra), -np.inf), head_rows, head_ids, head_v, rotation, k, lead)
                qn = np.sqrt((qa * qa).sum(1))
                sent = (qn[:, None] * tops[None, :] * (1 + 1e-9) + 1e-9 >= first.floor[:, None]) & (tops >= 0)
                r, c = np.nonzero(sent)
                yield pa.RecordBatch.from_arrays([pa.array(ra[r]), pa.array(first.floor[r]), pa.array(c.astype(np.int32))], names=["row", "floor", "band"])

    asking = vectors.where(F.col("vec_id") % every == 0)
    routes = stored(map_batches(asking.select("row", "v"), routed, "row long, floor double, band int"))
    asked = {r.band: r.n for r in routes.groupBy("band").agg(F.count("*").alias("n")).collect()}
    # A block is copied once for each QUERY_BLOCK of the queries routed to its band.
    parts = [-(-asked.get(b, 0) // QUERY_BLOCK) for b in range(len(splits))]
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("band"))
    upto = lambda values: F.explode(F.sequence(F.lit(0), of(values) - 1))
    queries = asking.select("row", "vec_id", "v").join(routes, "row").withColumn("part", F.pmod(F.xxhash64("row"), of(parts)).cast("int")).withColumn("split", upto(splits))
    fresh = [F.col(c).alias(c) for c in ("row", "vec_id", "v", "band")]  # both sides come from one table
    candidates = sized.where(of(parts) > 0).select(*fresh, F.pmod(F.xxhash64("row"), of(splits)).cast("int").alias("split")).withColumn("part", upto(parts))

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        if left.num_rows and right.num_rows:
            ints = lambda t, c: np.asarray(t.column(c))
            rows, ids = ints(left, "row"), ints(left, "vec_id")
            best = search_block(rows, _matrix(left.column("v"), dim), ints(left, "floor"), ints(right, "row"), ints(right, "vec_id"), _matrix(right.column("v"), dim), rotation, k, lead)
            out = [(int(r), int(q), -i, s) for r, q, heap in zip(rows, ids, best.heaps, strict=True) for s, i in heap]
        return pa.table({c: pa.array([r[x] for r in out], pa.int64()) for x, c in enumerate(("row", "query_id", "vec_id", "score"))})

    by = ("band", "split", "part")
    found = queries.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(joined, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

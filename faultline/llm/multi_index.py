"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately, so K centroids a half make K * K cells. A query goes
through pairs of centroids by the sum of its two distances, with a heap, until the cells passed hold the share of
all vectors that the wanted recall takes; entries of those cells are ranked by their exact distance.

Centroids and share are fitted on a bounded sample; every vector is indexed. A shelf is the cells of one first
centroid, cut into chunks of bounded size, so that a crowded cell spreads over tasks. A task holds one
chunk and lets the queries that visit it stream past; each leaves its nearest entries of that chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CENTROIDS = 32  # of each half
SAMPLE = 20_000  # vectors to fit on, at most
TRIALS = 200  # of them used as queries to choose the share
RECALL = 0.98
ROUNDS = 12
CHUNK = 8192  # vectors of a shelf that a task holds, on average


def usable(vector: str | Column, size: int | Column) -> Column:
    """Whether a vector takes part: of the given size, all components finite numbers, not all of them zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == size) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = _distances(x, centres).argmin(1)
        for c in range(len(centres)):
            members = x[own == c]
            centres[c] = members.mean(0) if len(members) else x[rng.integers(len(x))]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances; rounding may not make them negative."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = x.shape[1] // 2
    return x[:, :half], x[:, half:]


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: float) -> list[tuple[int, int]]:
    """Cells (i, j) by first[i] + second[j], until they hold ``need`` vectors. Empty cells are passed, not listed.

    The heap holds a border of pairs: (i, j) enters once its two smaller neighbours in sorted order have left.
    """
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap = [(first[by_first[0]] + second[by_second[0]], 0, 0)]
    left: set[tuple[int, int]] = set()
    cells, held = [], 0
    while heap and held < need:
        _, a, b = heapq.heappop(heap)
        left.add((a, b))
        i, j = int(by_first[a]), int(by_second[b])
        if counts[i, j]:
            cells.append((i, j))
            held += counts[i, j]
        if a + 1 < len(first) and (b == 0 or (a + 1, b - 1) in left):
            heapq.heappush(heap, (first[by_first[a + 1]] + second[by_second[b]], a + 1, b))
        if b + 1 < len(second) and (a == 0 or (a - 1, b + 1) in left):
            heapq.heappush(heap, (first[by_first[a]] + second[by_second[b + 1]], a, b + 1))
    return cells


def _fit(vectors: np.ndarray, centroids: int, k: int, recall: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Centroids of both halves and the share of vectors that finds ``recall`` of the ``k`` nearest in the sample."""
    rng = np.random.default_rng(2)
    books = [_kmeans(h, min(centroids, len(vectors)), rng) for h in _halves(vectors)]
    to = [_distances(h, b) for h, b in zip(_halves(vectors), books, strict=True)]
    i, j = to[0].argmin(1), to[1].argmin(1)
    needed = []
    for q in rng.permutation(len(vectors))[:TRIALS]:
        exact = ((vectors - vectors[q]) ** 2).sum(1)
        exact[q] = np.inf
        near = np.argsort(exact, kind="stable")[: min(k, len(vectors) - 1)]
        order = to[0][q][i] + to[1][q][j]
        needed += [(order <= order[n]).mean() for n in near]
    return books[0], books[1], float(np.quantile(needed, recall)) if needed else 1.0


def _as_rows(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def search(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    recall: float = RECALL,
    centroids: int = CENTROIDS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` its ``k`` nearest other vectors found.

    Scores are Euclidean distances in double precision, ties go to the smaller id; with fewer candidates all are
    returned. Null ids and vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do
    those of another length than most of the rest; of equally frequent lengths the largest counts. A query id that repeats is one query, of its smallest vector; candidates that repeat
    are one each. An empty table gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")).where("vec_id is not null")
    sizes = rows.where(usable("vec", F.size("vec"))).groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    rows = rows.where(usable("vec", size)).select("vec_id", F.col("vec").cast("array<double>").alias("vec"))

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        ordered = sample.sort_values("vec_id", kind="stable")
        one, two, share = _fit(np.array(ordered.vec.tolist()), centroids, k, recall)
        return pd.DataFrame({"one": [one.ravel().tolist()], "two": [two.ravel().tolist()], "share": [share]})

    # The sample is ranked by id alone and bounded; so is what comes back.
    chosen = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id", F.lit(2)), "vec_id").limit(SAMPLE)
    sample = rows.join(chosen, "vec_id").groupBy(F.lit(0).alias("all")).applyInPandas(fit, "one array<double>, two array<double>, share double")
    fitted = sample.first()
    if fitted is None:
        return spark.createDataFrame([], schema)
    half = size // 2
    # Vectors of one component have an empty first half: all are in its one cell.
    books = np.array(fitted.one).reshape(-1, half) if half else np.zeros((1, 0)), np.array(fitted.two).reshape(-1, size - half)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = _halves(_as_rows(batch.column("vec"), size))
            cells = [pa.array(_distances(h, b).argmin(1).astype(np.int32)) for h, b in zip(halves, books, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cells], ["vec_id", "vec", "i", "j"])

    entries = rows.mapInArrow(assign, "vec_id long, vec array<double>, i int, j int")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for cell in entries.groupBy("i", "j").count().collect():  # centroids squared rows at most
        counts[cell.i, cell.j] = cell["count"]
    need = fitted.share * counts.sum()
    chunks = np.maximum(1, -(-counts.sum(1) // CHUNK))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _as_rows(batch.column("vec"), size)
            to = [_distances(h, b) for h, b in zip(_halves(vectors), books, strict=True)]
            out = []
            for n, query in enumerate(batch.column("vec_id").to_pylist()):
                shelves: dict[int, list[int]] = {}
                # Cells up to the share, and at least k + 1 vectors, the query's own among them.
                for i, j in traverse(to[0][n], to[1][n], counts, max(need, k + 1)):
                    shelves.setdefault(i, []).append(j)
                vector = vectors[n].tolist()
                out += [(query, vector, i, c, js) for i, js in shelves.items() for c in range(chunks[i])]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["vec_id", "vec", "i", "chunk", "js"])

    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    asked = queries.mapInArrow(visits, "vec_id long, vec array<double>, i int, chunk int, js array<int>")
    of_shelf = F.get(F.array(*[F.lit(int(c)) for c in chunks]), F.col("i"))
    placed = entries.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of_shelf).cast("int"))
    placed = placed.select("i", "chunk", F.lit(0).alias("side"), "vec_id", "vec", F.array("j").alias("js"))
    both = placed.unionByName(asked.select("i", "chunk", F.lit(1).alias("side"), "vec_id", "vec", "js"))
    both = both.repartition("i", "chunk").sortWithinPartitions("i", "chunk", "side")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, cells, vectors = None, [], [], []
        ready = None
        for batch in batches:
            keys = list(zip(*[batch.column(c).to_pylist() for c in ("i", "chunk", "side")], strict=True))
            matrix, own = _as_rows(batch.column("vec"), size), batch.column("vec_id").to_pylist()
            js = batch.column("js").to_pylist()
            out = []
            for n, (i, chunk, side) in enumerate(keys):
                if (i, chunk) != at:
                    at, ids, cells, vectors, ready = (i, chunk), [], [], [], None
                if side == 0:
                    ids.append(own[n])
                    cells.append(js[n][0])
                    vectors.append(matrix[n])
                    continue
                if ready is None:
                    ready = np.array(ids, np.int64), np.array(cells), np.array(vectors).reshape(-1, size)
                inside = np.flatnonzero(np.isin(ready[1], js[n]) & (ready[0] != own[n]))
                gaps = ready[2][inside] - matrix[n]
                scores = np.sqrt((gaps * gaps).sum(1))
                best = np.lexsort((ready[0][inside], scores))[:k]
                out += [(own[n], int(ready[0][inside[b]]), float(scores[b])) for b in best]
            if out:
                a, b, c = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(rank, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

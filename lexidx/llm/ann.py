"""Nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample (``sample_rows``) by k-means whose
clusters are split while they are too large, so lists come out about even.
Every usable vector is posted to its nearest centroid and, where it lies near a
border, to further ones: all whose distance is at most ``1 + replicate`` times the
nearest, unless a centroid already chosen is nearer to that centroid than the
vector is. A query walks a neighbour graph of the centroids in memory (best
first) and searches the lists whose distance is at most ``1 + probe`` times that of
the nearest, or of the list at which the nearest ones hold k + 1 different vectors
(each counted in its nearest list only), whichever is farther: a vector on the
centroid of a small list still finds k others. The ratio is the smallest of RATIOS
that finds RECALL of the true neighbours for queries inside the sample. Lists that grow beyond ``list_rows`` are cut into parts by a hash, all of
which are searched: a list has no cap, and a hot one never lands in one task.

Each pair of a list part and a batch of its queries gives the best few of that
part; these are merged for each query. Scores are cosines of the original
vectors in double precision, summed in one fixed order, so equal vectors tie.

Vectors that are null, empty, zero, of another length than most of the sample,
or hold null or non-finite components take no part, neither as queries nor as
candidates. Repeated ids count once, the first by components. Ties go to the
smaller id. With fewer than k candidates all are returned; without any, none.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexidx.llm.common import Shipped, per_batch, staged

SAMPLE_ROWS = 20_000
MOST_LISTS = 1024
LIST_ROWS = 4_000
QUERY_ROWS = 1_000
REPLICATE = 0.08
RATIOS = (0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.3, 0.4, 0.6, 1.0)
RECALL = 0.97
TUNE_QUERIES = 200
MOST_REPLICAS = 8
DEGREE = 16
SEED = 7


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): one row for each id with a usable vector, components as doubles."""
    v = F.col(vec_col).cast("array<double>")
    good = (F.col(vec_col).isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull()
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return (vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
            .groupBy("vec_id").agg(F.min("vec").alias("vec")))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed component by component in order."""
    dot, qq, xx = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for j in range(q.shape[1]):
        dot, qq, xx = dot + q[:, j] * x[:, j], qq + q[:, j] ** 2, xx + x[:, j] ** 2
    return dot / (np.sqrt(qq) * np.sqrt(xx))


class Centroids:
    """Unit centroids and the graph that searches them."""

    def __init__(self, sample: np.ndarray, lists: int):
        rng = np.random.default_rng(SEED)
        x = _unit(sample)
        most = max(1, int(1.5 * len(x) / max(1, lists)))
        work, done = [np.arange(len(x))], []
        while work:  # split every cluster in two until none is too large
            rows = work.pop()
            if len(rows) <= most:
                done.append(rows)
                continue
            pick = x[rng.choice(rows, 2, replace=False)]
            for _ in range(8):
                side = (x[rows] @ pick.T).argmax(axis=1)
                if side.min() == side.max():
                    break
                pick = np.stack([x[rows[side == s]].mean(axis=0) for s in (0, 1)])
            if side.min() == side.max():  # equal vectors: no split can part them
                done.append(rows)
                continue
            work += [rows[side == 0], rows[side == 1]]
        centres = np.stack([x[r].mean(axis=0) for r in done]) + 1e-9
        for _ in range(3):  # let the centres settle together
            near = (x @ _unit(centres).T).argmax(axis=1)
            for k in np.unique(near):
                centres[k] = x[near == k].mean(axis=0)
        self.x = _unit(centres)
        d = self._between()
        order = np.argsort(d, axis=1, kind="stable")[:, 1:DEGREE + 1]
        links = [set(map(int, o)) for o in order]
        for k, o in enumerate(order):  # both ways, so that every centroid is reached
            for j in o:
                links[j].add(k)
        for k in range(len(links) - 1):
            links[k].add(k + 1)
            links[k + 1].add(k)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.hub = int(d.sum(axis=1).argmin())

    def _between(self) -> np.ndarray:
        sq = (self.x**2).sum(axis=1)
        return np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * self.x @ self.x.T, 0))

    def replicas(self, vectors: np.ndarray, ratio: float) -> list[list[int]]:
        """The lists each vector is posted to, the nearest first."""
        u = _unit(vectors)
        d = np.sqrt(np.maximum((u**2).sum(axis=1)[:, None] + (self.x**2).sum(axis=1) - 2 * u @ self.x.T, 0))
        between = self._between()
        near = np.argsort(d, axis=1, kind="stable")[:, :4 * MOST_REPLICAS]
        out = []
        for row, order in zip(d, near, strict=True):
            bound = row[order[0]] * (1 + ratio)
            chosen = [int(order[0])]
            for c in order[1:]:
                if row[c] > bound or len(chosen) >= MOST_REPLICAS:
                    break
                if all(between[c, o] >= row[c] for o in chosen):
                    chosen.append(int(c))
            out.append(chosen)
        return out

    def probes(self, vector: np.ndarray, ratio: float, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Lists to search: best-first walk over the graph, cut where the distance ratio is passed.

        ``held`` counts different vectors by list; the nearest lists that hold ``least`` of them are searched at any ratio.
        """
        u = _unit(vector[None, :])[0]

        def far(k):
            return np.sqrt(((self.x[k] - u) ** 2).sum(axis=-1))

        first = float(far(self.hub))
        seen, queue, kept, best = {self.hub}, [(first, self.hub)], [], first
        enough, total = [], 0  # the nearest lists so far that hold ``least``, the farthest on top

        def bound() -> float:
            return (max(best, -enough[0][0]) if enough else best) * (1 + ratio)

        widened = 0
        while queue:
            d, k = heapq.heappop(queue)
            if total >= least and d > bound():
                widened += 1
                if widened > DEGREE:  # nothing near behind a few steps beyond the bound
                    break
            kept.append((d, k))
            if least and (total < least or d < -enough[0][0]):
                heapq.heappush(enough, (-d, int(held[k])))
                total += int(held[k])
                while total - enough[0][1] >= least:
                    total -= heapq.heappop(enough)[1]
            new = [int(j) for j in self.links[k] if j not in seen]
            seen.update(new)
            for dj, j in zip(far(np.array(new, np.int64)).tolist() if new else [], new, strict=True):
                best = min(best, dj)
                heapq.heappush(queue, (dj, j))
        return [k for d, k in kept if d <= bound()]

    def tune(self, sample: np.ndarray, replicate: float, k: int) -> float:
        """The smallest ratio whose lists hold RECALL of the k nearest, for some of the sample against all of it."""
        u = _unit(sample)
        asked = np.arange(len(u))[::max(1, len(u) // TUNE_QUERIES)]
        near = u[asked] @ u.T
        near[np.arange(len(asked)), asked] = -9
        top = np.argsort(-near, axis=1)[:, :min(k, len(u) - 1)]
        if not top.size:
            return RATIOS[-1]
        holds = self.replicas(sample, replicate)
        for ratio in RATIOS:
            hit = 0
            for row, i in zip(top, asked, strict=True):
                lists = set(self.probes(sample[i], ratio))
                hit += sum(not lists.isdisjoint(holds[j]) for j in row)
            if hit >= RECALL * top.size:
                return ratio
        return RATIOS[-1]


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, replicate: float = REPLICATE, probe: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every row that ``is_query`` (a condition on vec_id) chooses."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = staged(spark, usable(vectors, id_col, vec_col), "ann-vectors")
    sample = [r["vec"] for r in base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vec").collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    dims = np.bincount([len(v) for v in sample]).argmax()
    base = base.where(F.size("vec") == int(dims))
    total = base.count()
    lists = int(min(MOST_LISTS, max(1, total // 200)))
    fitted = np.array([v for v in sample if len(v) == dims])
    centroids = Centroids(fitted, lists)
    probe = centroids.tune(fitted, replicate, k) if probe is None else probe
    shipped = Shipped(spark, centroids)

    def posted(batch: pa.RecordBatch) -> pa.RecordBatch:
        chosen = shipped.value.replicas(_matrix(batch.column(1)), replicate)
        rows = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        taken = batch.take(pa.array(rows))
        nearest = np.diff(rows, prepend=-1) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).astype(np.int32)), *taken.columns, pa.array(nearest)],
                                          ["list", "vec_id", "vec", "nearest"])

    def probed(batch: pa.RecordBatch) -> pa.RecordBatch:
        chosen = [shipped.value.probes(v, probe, held, k + 1) for v in _matrix(batch.column(1))]
        rows = np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])
        taken = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(chosen).astype(np.int32)), *taken.columns], ["list", "vec_id", "vec"])

    kind = "list int, vec_id long, vec array<double>"
    lists_of = staged(spark, base.mapInArrow(per_batch(posted), f"{kind}, nearest boolean"), "ann-lists")
    # Parts of each list and batches of its queries: two small tables, one row for each list.
    counted = lists_of.groupBy("list").agg(F.count("*").alias("n"), F.count_if("nearest").alias("own")).collect()
    sizes = {r["list"]: max(1, -(-r["n"] // list_rows)) for r in counted}
    n_lists = len(centroids.x)
    held = np.zeros(n_lists, np.int64)
    for r in counted:
        held[r["list"]] = r["own"]
    asked = staged(spark, base.where(is_query).mapInArrow(per_batch(probed), kind), "ann-probes")
    wide = {r["list"]: max(1, -(-r["n"] // QUERY_ROWS)) for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.array(*[F.lit(sizes.get(j, 1)) for j in range(n_lists)]), F.col("list") + 1)
    batches = F.element_at(F.array(*[F.lit(wide.get(j, 1)) for j in range(n_lists)]), F.col("list") + 1)
    h = F.xxhash64("vec_id")
    left = lists_of.select("list", F.pmod(h, parts).cast("int").alias("part"),
                           F.explode(F.sequence(F.lit(0), batches - 1)).alias("turn"), "vec_id", "vec")
    right = asked.select("list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                         F.pmod(h, batches).cast("int").alias("turn"), "vec_id", "vec")

    def best_of(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not candidates.num_rows or not queries.num_rows:
            return pa.table(empty)
        candidates = candidates.sort_by("vec_id")
        ids, x = candidates.column("vec_id").to_numpy(), _matrix(candidates.column("vec").combine_chunks())
        q_ids, q = queries.column("vec_id").to_numpy(), _matrix(queries.column("vec").combine_chunks())
        ux, found = _unit(x), []
        for at in range(0, len(q), 128):
            block, block_ids = q[at:at + 128], q_ids[at:at + 128]
            rough = _unit(block) @ ux.T
            rough[block_ids[:, None] == ids[None, :]] = -9
            bar = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(block), -8.0)
            # Exact scores of all that may be among the k best, ties included.
            row, col = np.nonzero((rough >= bar[:, None] - 1e-9) & (rough > -9))
            exact = cosines(block[row], x[col])
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank < k
            found.append((block_ids[row[best]], ids[col[best]], exact[best]))
        cols = [np.concatenate(c) for c in zip(*found, strict=True)]
        return pa.table({"query_id": pa.array(cols[0]), "vec_id": pa.array(cols[1]), "score": pa.array(cols[2])})

    keys = ["list", "part", "turn"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best_of, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))

"""Nearest neighbours by inner product over balanced posting lists found through a graph of centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Vectors with the smallest id hashes that the centroids are fitted on, at most.
SAMPLE_VECTORS = 20_000
LIST_VECTORS = 4096
MOST_LISTS = 4096
#: Copies of a vector at most, and how much farther than the nearest centroid another one may be.
COPIES = 2
COPY_RATIO = 1.05
#: Share of a sampled query's true neighbours whose lists its ratio must let through, and share of the queries of a
#: class whose ratios the class's must reach.
TARGET, QUERY_TARGET = 0.99, 0.99
#: Classes of queries, by the distance to their nearest centroid, with a pruning ratio each.
CLASSES = 8
BLOCK_VECTORS = 16_384
BLOCK_QUERIES = 4096
DEGREE = 16
FAR_LINKS = 8


@dataclass
class CentroidGraph:
    """Centroids, each linked to its nearest ones and to a few far ones; searched best first for many points at once."""

    centroids: np.ndarray
    links: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray) -> CentroidGraph:
        k = len(centroids)
        near = np.empty((k, min(DEGREE, max(k - 1, 1))), np.int64)
        for lo in range(0, k, 512):
            d = _squares(centroids[lo : lo + 512], centroids)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            near[lo : lo + 512] = np.argsort(d, axis=1, kind="stable")[:, : near.shape[1]]
        far = np.random.default_rng(7).integers(0, k, (k, FAR_LINKS))
        return cls(centroids, np.concatenate([near, far], 1))

    def search(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the ``width`` nearest centroids of each point, nearest first."""
        k, n = len(self.centroids), len(points)
        width = min(width, k)
        rows = np.arange(n)[:, None]
        start = np.arange(0, k, max(1, k // width))[:width]
        ids = np.tile(start, (n, 1))
        dist = _squares(points, self.centroids[start])
        if len(start) < width:
            ids = np.pad(ids, ((0, 0), (0, width - len(start))))
            dist = np.pad(dist, ((0, 0), (0, width - len(start))), constant_values=np.inf)
        seen = np.zeros((n, k), bool)
        seen[:, start] = True
        expanded = np.isinf(dist)
        while True:
            open_ = np.where(expanded, np.inf, dist)
            at = open_.argmin(1)
            live = np.flatnonzero(np.isfinite(open_[np.arange(n), at]))
            if not len(live):
                break
            expanded[live, at[live]] = True
            links = self.links[ids[live, at[live]]]
            new = ~seen[live[:, None], links]
            seen[live[:, None], links] = True
            d = ((points[live][:, None, :] - self.centroids[links]) ** 2).sum(2)
            d[~new] = np.inf
            both_d = np.concatenate([dist[live], d], 1)
            both_i = np.concatenate([ids[live], links], 1)
            both_x = np.concatenate([expanded[live], np.isinf(d)], 1)
            order = np.argsort(both_d, axis=1, kind="stable")[:, :width]
            pick = np.arange(len(live))[:, None]
            dist[live], ids[live], expanded[live] = both_d[pick, order], both_i[pick, order], both_x[pick, order] | np.isinf(both_d[pick, order])
        order = np.argsort(dist, axis=1, kind="stable")
        return ids[rows, order], np.sqrt(np.maximum(dist[rows, order], 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means whose larger clusters look farther, so that lists come out of similar length."""
    rng = np.random.default_rng(11)
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    burden = np.zeros(k)
    for _ in range(rounds):
        owner = np.empty(len(points), np.int64)
        spread = 0.0
        for lo in range(0, len(points), 4096):
            d = _squares(points[lo : lo + 4096], centroids)
            owner[lo : lo + 4096] = (d + burden).argmin(1)
            spread += float(d.min(1).sum())
        counts = np.bincount(owner, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, points)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        centroids[~full] = points[rng.choice(len(points), int((~full).sum()))]
        burden = 0.1 * spread / len(points) * (counts * k / len(points) - 1.0)
    return centroids


def directions(x: np.ndarray) -> np.ndarray:
    """Vectors at unit length: of two equally long vectors the one nearer in direction has the larger product."""
    return x / np.sqrt((x * x).sum(1))[:, None]


def chosen_lists(graph: CentroidGraph, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the nearest centroid and, near a boundary, the next ones that are hardly farther."""
    ids, dist = graph.search(points, COPIES)
    row, at = np.nonzero(dist <= COPY_RATIO * dist[:, :1])
    return row, ids[row, at]


@dataclass
class ListIndex:
    graph: CentroidGraph
    #: Upper ends of classes of the distance to the nearest centroid, and the pruning ratio of each class.
    reach: np.ndarray
    ratio: np.ndarray
    width: int

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return chosen_lists(self.graph, directions(x))

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs whose centroid is at most the ratio of the query's class times as far as the nearest one.

        ``width`` is where the search begins: it is doubled for queries whose farthest list found is still within
        their ratio, up to all lists.
        """
        points, lists, width = directions(q), len(self.graph.centroids), self.width
        left, rows, found = np.arange(len(q)), [], []
        while len(left):
            ids, dist = self.graph.search(points[left], width)
            limit = self.ratio[np.searchsorted(self.reach, dist[:, 0])] * dist[:, 0] + 1e-12
            done = (dist[:, -1] > limit) | (dist.shape[1] >= lists)
            row, at = np.nonzero((dist <= limit[:, None]) & done[:, None])
            rows.append(left[row])
            found.append(ids[row, at])
            left, width = left[~done], width * 2
        return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def all_lists(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every list for every row: the way for queries that their own lists did not give enough candidates."""
        lists = len(self.graph.centroids)
        return np.repeat(np.arange(len(q)), lists), np.tile(np.arange(lists), len(q))


def fit_index(sample: np.ndarray, total: int, k: int) -> ListIndex:
    """Centroids from the sample, and the pruning ratio that lets through the lists of the sample's true neighbours.

    Equal vectors count once, so copies neither move centroids nor stand for the queries of a class; each sampled
    query has one ratio, that of TARGET of its neighbours, and a class takes the ratio of QUERY_TARGET of its queries.
    Ratios are taken from the half of the sample that the centroids have not seen, for most rows have not been seen.
    """
    sample = np.unique(sample, axis=0)
    sample = sample[np.random.default_rng(5).permutation(len(sample))]
    lists = max(1, min(MOST_LISTS, -(-total // LIST_VECTORS), -(-len(sample) // 2)))
    seen = max(lists, len(sample) // 2)
    graph = CentroidGraph.build(balanced_centroids(directions(sample[:seen]), lists))
    sample = sample[seen:] if len(sample) - seen > 1 else sample
    points = directions(sample)
    row, owner = chosen_lists(graph, points)
    first = np.searchsorted(row, np.arange(len(sample) + 1))
    # of all rows' k neighbours the sample has its share; these lie as far away as the k do
    near = min(max(1, -(-k * len(sample) // max(total, 1))), len(sample) - 1)
    least, ratios = [], []
    for i in range(0, len(sample), max(1, len(sample) // 2000)):
        d = np.sqrt(_squares(points[i : i + 1], graph.centroids))[0]
        score = sample @ sample[i]
        score[i] = -np.inf
        own = [float(d[owner[first[j] : first[j + 1]]].min() / max(d.min(), 1e-12)) for j in np.argpartition(-score, max(near - 1, 0))[:near]]
        if own:
            least.append(d.min())
            ratios.append(sorted(own)[-(-len(own) * int(100 * TARGET) // 100) - 1])
    if not ratios:
        return ListIndex(graph, np.zeros(0), np.ones(1), lists)
    least, ratios = np.array(least), np.array(ratios)
    reach = np.unique(np.quantile(least, np.arange(1, CLASSES) / CLASSES))
    of = np.searchsorted(reach, least)
    ratio = np.array([max(float(np.quantile(ratios[of == c], QUERY_TARGET)), 1.0) + 1e-9 if (of == c).any() else ratios.max() for c in range(len(reach) + 1)])
    nearest = np.sqrt(_squares(points[:: max(1, len(points) // 2000)], graph.centroids))
    allowed = ratio[np.searchsorted(reach, nearest.min(1))] * nearest.min(1)
    width = int((nearest <= allowed[:, None]).sum(1).max())
    return ListIndex(graph, reach, ratio, min(lists, width + width // 4 + 8))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(uid, vec_id, vector) of the rows that take part: of the commonest length, finite, not all zero."""
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vector")).where(
        x.isNotNull()
        & (F.size(x) > 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    return rows.withColumn("uid", F.monotonically_increasing_id())


def first_copies(rows: DataFrame, most: int) -> DataFrame:
    """Of equal vectors the ``most`` with the smallest ids.

    Equal vectors have equal scores, and ties go to the smaller id, so a query that may not take itself never takes one
    behind the k + 1 first of them.
    """
    order = Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id"), "uid")
    return rows.withColumn("_copy", F.row_number().over(order)).where(F.col("_copy") <= most).drop("_copy")


def nearest_neighbours(
    vectors: DataFrame, k: int = 20, query_modulus: int = 20, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """For every row whose id is divisible by ``query_modulus``, the ``k`` rows of largest inner product found.

    Returns query_id, rank from 1, vec_id, and score, the product of the original vectors in double precision;
    equal scores go to the smaller id. Rows without a vector, or with null, non-finite, or only zero components, or
    of another length than most, take no part; a null id is never a query and ranks last among ties. Repeated ids are
    rows of their own. The index is fitted on at most SAMPLE_VECTORS rows and holds every row that can be a result: of
    equal vectors the k + 1 of smallest id. Lists are searched in blocks, so neither a long list nor many queries meet
    in one task; a query whose lists held fewer than k candidates is searched in all lists. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    rows = scratch.table(clean_vectors(vectors, id_col, vector_col))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if length is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == length["d"])
    queries = rows.where(F.col("vec_id") % query_modulus == 0)
    total = rows.count()
    picked = rows.select("vector").orderBy(F.xxhash64("vec_id", "uid")).limit(SAMPLE_VECTORS).toArrow()
    sample = _vectors(picked.column("vector").combine_chunks())
    index = fit_index(sample, total, k)

    def spread(name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    row, owner = getattr(index, name)(_vectors(part.column("vector")))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner.astype(np.int32)), *(part.column(c).take(pa.array(row)) for c in ("uid", "vec_id", "vector"))],
                        names=["list", "uid", "vec_id", "vector"],
                    )

        return run

    kind = rows.schema["vector"].dataType.simpleString()
    spread_schema = f"list int, uid long, vec_id long, vector {kind}"
    posted = scratch.table(first_copies(rows.select("uid", "vec_id", "vector"), k + 1).mapInArrow(spread("lists_of"), spread_schema))
    asked = scratch.table(queries.select("uid", "vec_id", "vector").mapInArrow(spread("probes"), spread_schema))
    found = scratch.table(_searched(posted, asked, k).dropDuplicates(["asker", "uid"]))
    enough = found.groupBy("asker").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k, total - 1)).select(F.col("asker").alias("uid"))
    short = queries.join(enough, "uid", "left_anti")
    if not short.isEmpty():
        asked = scratch.table(short.select("uid", "vec_id", "vector").mapInArrow(spread("all_lists"), spread_schema))
        found = found.unionByName(_searched(posted, asked, k)).dropDuplicates(["asker", "uid"])
    order = Window.partitionBy("asker").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(posted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(asker, query_id, uid, vec_id, score): the ``k`` best rows of each asked list, block by block."""
    # a list is cut into blocks, and its queries into parts: only where both are many does a row go to more than one task
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).cast("int").alias("blocks"))
    parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("parts"))
    sizes = F.broadcast(blocks.join(parts, "list"))  # a row for each of at most MOST_LISTS lists
    dealt = posted.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("list", "block", "part", "uid", "vec_id", "vector")
    asked = asked.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int")).select("list", "block", "part", "uid", "vec_id", "vector")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"asker": [], "query_id": [], "uid": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            q, x = (_vectors(t.column("vector").combine_chunks()) for t in (left, right))
            qu, xu = left.column("uid").to_numpy(), right.column("uid").to_numpy()
            xi = right.column("vec_id").to_pandas().astype("Int64")
            ids = xi.fillna(np.iinfo(np.int64).max).to_numpy(np.int64)
            qi = left.column("vec_id").to_pylist()
            for lo in range(0, len(q), 256):
                scores = q[lo : lo + 256] @ x.T
                scores[qu[lo : lo + 256, None] == xu[None]] = -np.inf
                least = -np.inf if len(x) <= k else np.partition(scores, len(x) - k, axis=1)[:, len(x) - k]
                for i, row in enumerate(scores):
                    floor = least if np.isscalar(least) else least[i]
                    at = np.flatnonzero((row >= floor - 1e-9 * max(1.0, abs(floor))) & (row > -np.inf)) if np.isfinite(floor) else np.flatnonzero(row > -np.inf)
                    exact = (x[at] * q[lo + i]).sum(1)
                    at_best = np.lexsort((ids[at], -exact))[:k]
                    out["asker"] += [qu[lo + i]] * len(at_best)
                    out["query_id"] += [qi[lo + i]] * len(at_best)
                    out["uid"] += xu[at[at_best]].tolist()
                    out["vec_id"] += [None if xi.iloc[j] is None or ids[j] == np.iinfo(np.int64).max else int(ids[j]) for j in at[at_best]]
                    out["score"] += exact[at_best].tolist()
        kinds = [("asker", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]
        return pa.table({c: pa.array(out[c], t) for c, t in kinds})

    keys = ["list", "block", "part"]
    return asked.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(best, "asker long, query_id long, uid long, vec_id long, score double")

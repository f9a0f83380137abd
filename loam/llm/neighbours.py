"""The most similar vectors of every vector, from balanced posting lists.

Vectors are unit vectors here, equal ones one *class*.  Centroids are fitted on a bounded
sample by balanced splitting; every class is written to the list of its nearest centroid
and, near a border, to further lists whose centroids are almost as near.  A query visits
the lists whose distance is within a ratio of the nearest.  Both look their centroids up
in a neighbourhood graph that is built once and broadcast.  Within a list, members and
queries meet in blocks of one matrix product each; the best of each list are merged per query.
A list that fills beyond ``FULL`` is dealt out as a grid of cells, each with a part of its
members and a part of its queries, so that no task holds a whole list, however full.

Exactness: cosines are computed in double precision and rounded to 6 decimals, ties go to
the smaller id.  Approximate is only which lists are visited.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.tables import materialize

DIM = 64
K = 10
LIST_SIZE = 160  # aimed-at classes of a list before replication
MAX_LISTS = 16_384
SAMPLE = 65_536  # most vectors that the centroids are fitted on
REPLICAS, REPLICA_RATIO = 3, 1.12  # lists of a class, and how much farther than the nearest they may be
VISITS, VISIT_RATIO = 12, 1.35  # the same of a query
DEGREE, BEAM = 24, 24
BLOCK = 2048
FULL = 4 * LIST_SIZE  # members of a cell; a fuller list is dealt out
SALTS = 32  # shares of the ids of one vector


def usable(vectors: DataFrame) -> DataFrame:
    """id and vector (in its own precision) of the distinct ids with 64 finite numbers, not all zero.

    A null id is no id.  Repeated rows count once; should one id have several vectors, the
    largest (by its elements in order) holds."""
    fine = (F.size("vector") == DIM) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    return vectors.where(F.col("id").isNotNull() & fine).groupBy("id").agg(F.max("vector").alias("vector"))


def classes(rows: DataFrame, keep: int = K + 1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The distinct vectors as classes, and whose they are.

    (num, vector, ids): the vectors with their ``keep`` smallest ids, numbered in the order of the
    first; (num, id): these ids; (num, salt, id): all further ids; (num): the classes that have
    such.  Groups are cut to ``keep`` ids before they are shuffled, and further ids find their
    class by vector and salt, so a vector that a third of all ids share stalls no task."""
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("rank") <= keep)
    groups = first.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = groups.repartitionByRange(F.col("ids")[0]).sortWithinPartitions(F.col("ids")[0])
    numbered = materialize(groups.select(F.monotonically_increasing_id().alias("num"), "vector", "ids"))
    known = numbered.select("num", F.explode("ids").alias("id"))
    many = numbered.where(F.size("ids") == keep).select("num", "vector")
    salted = rows.join(known.select("id"), "id", "left_anti").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rest = salted.join(many.withColumn("salt", _salts()), ["vector", "salt"]).select("num", "salt", "id")
    return numbered, known, rest, many.select("num")


def _salts():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of about equally many sample vectors: halved along their main direction
    until there are as many parts as lists, then moved to their nearest vectors' mean."""
    parts = [(-len(x), 0, np.arange(len(x)))]  # the largest first
    rng = np.random.default_rng(seed)
    while len(parts) < lists and parts[0][0] < -1:
        own = heapq.heappop(parts)[2]
        y = x[own] - x[own].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):  # power iteration
            d = y.T @ (y @ d)
            d /= max(np.linalg.norm(d), 1e-300)
        order = own[np.argsort(y @ d, kind="stable")]
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            heapq.heappush(parts, (-len(half), int(half[0]), half))
    centre = np.array([x[p].mean(axis=0) for _, _, p in sorted(parts, key=lambda p: p[1])])
    for _ in range(3):
        near = np.concatenate([np.argmax(x[i : i + 8192] @ unit_rows(centre).T, axis=1) for i in range(0, len(x), 8192)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=len(centre))
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
    return unit_rows(centre)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class CentroidGraph:
    """Centroids with links to their nearest ones and far entry points, searched by beams."""

    def __init__(self, centre: np.ndarray):
        self.centre = centre.astype(np.float32)
        n = len(centre)
        self.degree = min(DEGREE, n)
        self.links = np.concatenate([np.argpartition(-(self.centre[i : i + 2048] @ self.centre.T), self.degree - 1, axis=1)[:, : self.degree] for i in range(0, n, 2048)])
        self.entries = np.unique(np.linspace(0, n - 1, min(n, max(16, int(4 * n**0.5)))).astype(np.int64))

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row and their cosines, best first."""
        x = x.astype(np.float32)
        beam = min(max(BEAM, want), len(self.centre))
        rows = np.arange(len(x))[:, None]
        score = x @ self.centre[self.entries].T
        k = min(beam, score.shape[1])
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        at, score = self.entries[top], score[rows, top]
        open_ = np.ones(at.shape, bool)
        while open_.any():
            pick = np.argsort(np.where(open_, -score, np.inf), axis=1)[:, :4]  # the best open ones of each beam
            live = open_[rows, pick]
            open_[rows, pick] = False
            new = np.where(live[:, :, None], self.links[at[rows, pick]], -1).reshape(len(x), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            s = np.einsum("ijk,ik->ij", self.centre[new], x)
            both, sc = np.concatenate([at, new], axis=1), np.concatenate([score, np.where(new < 0, -np.inf, s)], axis=1)
            op = np.concatenate([open_, new >= 0], axis=1)
            # seen before: the same centroid has exactly one earlier place
            order = np.argsort(both * 2 + op, axis=1, kind="stable")
            sorted_ = both[rows, order]
            dup = np.zeros_like(op)
            dup[rows, order] = np.concatenate([np.zeros((len(x), 1), bool), sorted_[:, 1:] == sorted_[:, :-1]], axis=1)
            sc[dup] = -np.inf
            k = min(beam, both.shape[1])
            top = np.argpartition(-sc, k - 1, axis=1)[:, :k]
            at, score, open_ = both[rows, top], sc[rows, top], op[rows, top] & np.isfinite(sc[rows, top])
        order = np.argsort(-score, axis=1, kind="stable")[:, :want]
        return at[rows, order], score[rows, order]


def within_ratio(at: np.ndarray, cos: np.ndarray, most: int, ratio: float) -> np.ndarray:
    """Which of the found lists are near enough: distance at most ``ratio`` times the least."""
    dist = np.sqrt(np.maximum(2 - 2 * cos, 0))
    return (np.arange(at.shape[1])[None, :] < most) & (dist <= np.maximum(dist[:, :1], 1e-3) * ratio) & np.isfinite(cos)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)


def fit(numbered: DataFrame) -> np.ndarray:
    """Centroids from at most SAMPLE classes, chosen by hash; every class is indexed all the same.

    The sample meets in one task; only the centroids, at most MAX_LISTS, reach the driver."""
    n = numbered.count()
    if not n:
        return np.zeros((1, DIM))
    lists = max(1, min(MAX_LISTS, round(n / LIST_SIZE)))
    keep = min(1.0, SAMPLE / n)
    sample = numbered.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_000)) < int(keep * 1_000_000)).select("vector").limit(2 * SAMPLE) if keep < 1 else numbered.select("vector")

    def fitted(batches: Iterator) -> Iterator:
        x = [_matrix(b.column(0)) for b in batches]
        centre = balanced_centroids(unit(np.concatenate(x)), lists) if x else np.zeros((0, DIM))
        yield pa.RecordBatch.from_arrays([pa.array(centre.tolist(), pa.list_(pa.float64()))], names=["centre"])

    x = np.array([r[0] for r in sample.repartition(1).mapInArrow(fitted, "centre array<double>").collect()], dtype=np.float64).reshape(-1, DIM)
    return x if len(x) else np.zeros((1, DIM))


def _bytes(x: np.ndarray) -> pa.Array:
    """Rows of single-precision vectors as binary values."""
    x = np.ascontiguousarray(x, np.float32)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (4 * DIM)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The same as unit vectors in double precision."""
    whole = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks])
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return unit(np.frombuffer(whole.buffers()[2], np.float32, len(whole) * DIM, int(ends[0])).reshape(-1, DIM).astype(np.float64))


def assigned(numbered: DataFrame, centre: np.ndarray) -> DataFrame:
    """(num, vec, lists, homes): the lists that a class visits, nearest first; in the first
    ``homes`` of them it is a member.  Vectors travel in single precision, in which the table
    has them, and are scaled again in double where they meet."""
    lists = len(centre)
    graph = numbered.sparkSession.sparkContext.broadcast(CentroidGraph(centre))

    def assign(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                raw = _matrix(part.column(1))
                at, cos = graph.value.search(unit(raw), min(VISITS, lists))
                visit, home = within_ratio(at, cos, VISITS, VISIT_RATIO), within_ratio(at, cos, REPLICAS, REPLICA_RATIO)
                ends = np.concatenate([[0], np.cumsum(visit.sum(axis=1))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(at[visit].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), _bytes(raw), listed, pa.array(home.sum(axis=1).astype(np.int32))], names=["num", "vec", "lists", "homes"])

    return materialize(numbered.select("num", "vector").mapInArrow(assign, "num bigint, vec binary, lists array<int>, homes int"))


def cells(posted: DataFrame) -> DataFrame:
    """(list, a, b, num, vec, home, visit): every class in the cells of its lists.

    A list of at most FULL members is one cell; another is a grid of P x P, P parts of its
    members by P parts of its queries.  Every query meets every member in exactly one cell."""
    members = posted.select(F.explode(F.slice("lists", F.lit(1), F.col("homes"))).alias("list")).groupBy("list").agg(F.count("*").alias("n"))
    grids = members.where(F.col("n") > FULL).select("list", F.ceil(F.col("n") / FULL).cast("int").alias("parts"))  # at most MAX_LISTS rows
    each = posted.select("num", "vec", "homes", F.posexplode("lists").alias("pos", "list")).join(F.broadcast(grids), "list", "left")
    home, parts = F.col("pos") < F.col("homes"), F.coalesce("parts", F.lit(1))
    a, b = F.pmod(F.xxhash64("num"), parts).cast("int"), F.pmod(F.xxhash64("num", F.lit(1)), parts).cast("int")
    cell = lambda x, y, h, v: F.struct(x.cast("int").alias("a"), y.cast("int").alias("b"), h.alias("home"), v.alias("visit"))
    across = F.sequence(F.lit(0), parts - 1)
    as_member = F.when(home, F.transform(across, lambda k: cell(a, k, F.lit(True), k == b))).otherwise(F.array().cast("array<struct<a: int, b: int, home: boolean, visit: boolean>>"))
    as_query = F.transform(F.filter(across, lambda k: ~home | (k != a)), lambda k: cell(k, b, F.lit(False), F.lit(True)))
    placed = F.when(parts == 1, F.array(cell(F.lit(0), F.lit(0), home, F.lit(True)))).otherwise(F.concat(as_member, as_query))
    return each.select("list", "num", "vec", F.explode(placed).alias("c")).select("list", "num", "vec", "c.*")


def candidates(numbered: DataFrame, centre: np.ndarray) -> DataFrame:
    """(num, near): per class the best other classes as structs of cosine in millionths and number."""
    def scan(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("num")
        home, visit, num = (group.column(c).to_numpy() for c in ("home", "visit", "num"))
        v = _vectors(group.column("vec"))
        m, mn, n = v[home], num[home], int(home.sum())
        k = min(K + 1, n)
        nums, other, cosine = [], [], []
        for i in range(0, int(visit.sum()) if n else 0, 512):
            q, qn = v[visit][i : i + 512], num[visit][i : i + 512]
            cos = np.rint(q @ m.T * 1e6).astype(np.int64)
            order = cos * n + (n - 1 - np.arange(n))[None, :]  # ties to the smaller id
            order[qn[:, None] == mn[None, :]] = np.iinfo(np.int64).min
            top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(q), 1))
            r = np.arange(len(q))[:, None]
            kept = order[r, top] > np.iinfo(np.int64).min
            nums.append(np.stack([qn, kept.sum(axis=1)]))
            other.append(mn[top[kept]])
            cosine.append(-cos[r, top][kept])
        nums = np.concatenate(nums, axis=1) if nums else np.zeros((2, 0), np.int64)
        flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (cosine, other)]
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(nums[1])]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in flat], ["c", "num"]))
        return pa.table({"num": pa.array(nums[0]), "near": near})

    found = cells(assigned(numbered, centre)).groupBy("list", "a", "b").applyInArrow(scan, "num bigint, near array<struct<c: bigint, num: bigint>>")
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, K + 1)
    return found.groupBy("num").agg(best.alias("near"))


def nearest(vectors: DataFrame, k: int = K) -> DataFrame:
    """id, neighbours: of every usable vector the ids of the ``k`` most similar others, nearest
    first (fewer only if there are fewer vectors), as structs of id and cosine in millionths.

    Unusable vectors take no part; equal vectors are each other's neighbours; an empty table
    gives no row.  Further columns are ignored.
    """
    numbered, known, rest, many = classes(usable(vectors))
    centre = fit(numbered)
    near = candidates(numbered, centre)
    own = numbered.select("num", F.array(F.struct(F.lit(-1_000_000).cast("bigint").alias("c"), "num")).alias("near"))
    links = near.unionByName(own).select("num", F.explode("near").alias("x")).select("num", "x.c", F.col("x.num").alias("other"))
    ids = numbered.select(F.col("num").alias("other"), "ids")
    listed = links.join(ids, "other").select("num", F.transform("ids", lambda i: F.struct(F.col("c"), i.alias("id"))).alias("near"))
    best = materialize(listed.groupBy("num").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")))
    crowded = best.join(many, "num").withColumn("salt", _salts())
    members = known.join(best, "num").select("id", "near").unionByName(rest.join(crowded, ["num", "salt"]).select("id", "near"))
    mine = members.select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return mine.select("id", F.transform("near", lambda x: F.struct(x["id"].alias("id"), (-x["c"]).alias("cosine_millionths"))).alias("neighbours"))


def pairs(neighbours: DataFrame) -> DataFrame:
    """id_a < id_b in byte order: the unordered pairs of which one is near the other."""
    each = neighbours.select("id", F.explode("neighbours.id").alias("other"))
    return each.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()

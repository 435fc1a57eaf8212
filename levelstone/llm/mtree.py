"""Exact top-k by inner product over an M-tree.

Inner products become distances: with R the largest norm, a row x gets the coordinate sqrt(R^2 - |x|^2) more and a query
0, so that d(q, x)^2 = |q|^2 + R^2 - 2 q.x and the nearest rows are those of the highest score.

The tree is built level by level. A node of more than ``CELL`` rows becomes a page of up to ``FAN`` routing rows drawn
from it; its rows go to the nearest one, and the page keeps each child's routing row, covering radius and distance to the
node's own routing row. Nodes are tables, not memory: a page meets the rows or the queries of its node in a sorted stream,
and a node with many of them is dealt to several tasks, each with the page. A leaf holds ``CELL`` rows at most, in pages of
its own with a routing row, a radius and the distance of each row to its routing row.

Search is best-first. A query first descends to the leaf with the best bound alone, whose k-th score becomes its floor.
Then it descends everywhere that the floor allows: a child is left out by the triangle inequality on stored distances,
before its own distance is computed, or by its ball. In a leaf, pages come from the best bound down until the bound falls
under the k-th score, and rows whose stored distance excludes them cost no product. Scores are integer products and exact.

Of rows with one vector, only those of the ``k`` + 1 least ids can be in a result, and ``k`` of each id; others aren't in
the tree, so a vector that very many rows share makes no large node.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, released, ship

SCALE, K = 1024, 10
FAN, CELL, PAGE = 64, 16384, 64
#: Rows, or queries, that one copy of a page meets.
SHARE = 50_000
#: Large nodes that are broadcast, at most; more are joined by a shuffle.
BROADCAST = 10_000
#: Levels of the tree at most; a node that is still larger than a leaf then is cut by ids.
LEVELS = 8


def _matrix(column, width: int) -> np.ndarray:
    """Vectors as a float64 matrix; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat):
        row = np.repeat(np.arange(len(column)), lengths)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _lift(x: np.ndarray, reach: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(0.0, reach - (x * x).sum(axis=1)))))


def _flat(q: np.ndarray) -> np.ndarray:
    return np.column_stack((q, np.zeros(len(q))))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)))


def _best(size: np.ndarray, reach: float, least: np.ndarray) -> np.ndarray:
    """Highest score at a distance of ``least`` or more, with room for rounding: half a point while products are exact in
    doubles, and a share of the norms beyond."""
    whole = size + reach
    return (whole - least * least) / 2 + np.maximum(0.5, 1e-7 * whole)


def _products(x: np.ndarray, q: np.ndarray, reach: float) -> np.ndarray:
    """Exact scores; as Python's integers where doubles or longs might not hold a sum."""
    if reach < 2.0**52:
        return x @ q
    other = [int(c) for c in q]
    return np.array([sum(int(a) * b for a, b in zip(row, other)) for row in x], object)


class Cell:
    """A leaf: pages with routing rows, covering radii, and the distance of each row to its routing row."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        lifted = _lift(self.x, reach)
        n = len(ids)
        picks = np.unique(np.linspace(0, n - 1, max(1, -(-n // PAGE))).astype(int))
        near = _distances(lifted, lifted[picks]).argmin(axis=1)
        order = np.lexsort((self.ids, near))
        near = near[order]
        cut = np.flatnonzero(np.concatenate(([True], near[1:] != near[:-1])))
        cut = np.unique(np.concatenate([np.arange(a, b, PAGE) for a, b in zip(cut, [*cut[1:], n])]))  # a page holds PAGE rows at most
        self.ids, self.x, self.cut = self.ids[order], self.x[order], np.append(cut, n)
        self.routing = lifted[picks[near[cut]]]
        page = np.searchsorted(cut, np.arange(n), side="right") - 1
        self.parent = np.sqrt(((lifted[order] - self.routing[page]) ** 2).sum(axis=1))
        self.radius = np.maximum.reduceat(self.parent, cut)
        self.reach = reach
        self.products = 0

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """For each query up to k (scores, ids) of at least its floor, best first, its own id left out."""
        size = (queries * queries).sum(axis=1)
        to_page = _distances(_flat(queries), self.routing)
        best = _best(size[:, None], self.reach, np.maximum(0.0, to_page - self.radius))
        for i, q in enumerate(queries):
            low, found = floor[i], []
            for p in np.argsort(-best[i], kind="stable"):
                if best[i, p] < low:
                    break
                a, b = self.cut[p], self.cut[p + 1]
                gap = np.abs(to_page[i, p] - self.parent[a:b])
                rows = a + np.flatnonzero((_best(size[i], self.reach, gap) >= low) & (self.ids[a:b] != own[i]))
                if not len(rows):
                    continue
                self.products += len(rows)
                got = _products(self.x[rows], q, self.reach)
                keep = np.flatnonzero(got >= low)
                if len(keep):
                    found = sorted([*found, *((-s, j) for s, j in zip(got[keep].tolist(), self.ids[rows[keep]].tolist()))])[:k]
                    if len(found) == k:
                        low = max(low, -found[-1][0])
            yield [-s for s, _ in found], [j for _, j in found]


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    x = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    # floor in doubles: a long holds it up to 2**62, and a double beyond 2**53 is whole already
    scaled = lambda c: c * F.lit(float(SCALE))
    return rows.select("vec_id", F.transform(x, lambda c: F.when(F.abs(scaled(c)) < F.lit(2.0**62), F.floor(scaled(c)).cast("double")).otherwise(scaled(c))).alias("v"))


def _met(pages: DataFrame, rows: DataFrame, counts: DataFrame, by: str) -> DataFrame:
    """One sorted stream for each task in which a node's page comes before its rows; nodes without a page aren't in it.

    ``pages(node, ...)`` and ``rows(node, ...)`` share no other columns. ``counts(node, n)`` are the rows of each node: a
    node of more than ``SHARE`` is dealt to several tasks by the column ``by``, each with its page.
    """
    n = partitions(pages.sparkSession)
    shares = F.ceil(F.col("n") / F.lit(SHARE)).cast("int")
    left = pages.join(counts.select("node", shares.alias("shares")), "node").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    hot = counts.where(F.col("n") > SHARE).select("node", shares.alias("shares"))
    few = hot.limit(BROADCAST + 1).count() <= BROADCAST
    share = F.coalesce(F.pmod(F.xxhash64(by), F.col("shares")), F.lit(0)).cast("int")
    right = rows.join(F.broadcast(hot) if few else hot, "node", "left").withColumn("share", share).drop("shares")
    both = left.withColumn("kind", F.lit(0)).unionByName(right.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(n, "node", "share").sortWithinPartitions("node", "share", "kind")


def _stream(batches, page_columns):
    """(node, columns of its page rows, batch of its rows) in the order of the stream."""
    node, held, page = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, kinds, shares = batch.column("node").to_pylist(), batch.column("kind").to_numpy(), batch.column("share").to_pylist()
        start = 0
        for end in range(1, len(nodes) + 1):
            if end < len(nodes) and nodes[end] == nodes[start] and shares[end] == shares[start] and kinds[end] == kinds[start]:
                continue
            part = batch.slice(start, end - start)
            if kinds[start] == 0:
                if node != (nodes[start], shares[start]):
                    node, held, page = (nodes[start], shares[start]), [], None
                held.append(part.select(page_columns))
            elif node == (nodes[start], shares[start]):
                if page is None:
                    page, held = pa.Table.from_batches(held).combine_chunks(), []
                    fresh = True
                yield node[0], page, fresh, part
                fresh = False
            start = end


def _build(rows: DataFrame, reach: float, width: int, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Pages of each level, ``(node, child, routing, radius, parent)``, and rows ``(node, vec_id, v)`` of the leaves."""

    def assign(batches):
        for node, page, fresh, part in _stream(batches, ["place", "pivot"]):
            if fresh:
                routing, place = _lift(_matrix(page["pivot"], width), reach), page["place"].to_pylist()
            x = _lift(_matrix(part.column("v"), width), reach)
            near = _distances(x, routing).argmin(axis=1)
            away = np.sqrt(((x - routing[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([f"{node}/{place[k]}" for k in near]), part.column("vec_id"), part.column("v"), pa.array(away)], ["node", "vec_id", "v", "away"])

    level = scratch.save(rows.select(F.lit("r").alias("node"), "vec_id", "v", F.lit(0.0).alias("away")), "rows")
    pages, leaves = [], None
    for depth in range(LEVELS):
        counts = scratch.save(level.groupBy("node").agg(F.count("*").alias("n")), "counts")
        large = counts.where(F.col("n") > CELL)
        done = level.join(large, "node", "left_anti").select("node", "vec_id", "v")
        leaves = done if leaves is None else leaves.unionByName(done)
        if not large.limit(1).count():
            return pages, leaves
        open_ = level.join(large.select("node"), "node", "left_semi")
        pick = Window.partitionBy("node").orderBy(F.xxhash64("vec_id"), "vec_id")
        pivots = scratch.save(open_.withColumn("place", F.row_number().over(pick)).where(F.col("place") <= FAN).select("node", "place", F.col("v").alias("pivot"), F.col("away").alias("parent")), "pivots")
        below = scratch.save(_met(pivots.select("node", "place", "pivot"), open_.select("node", "vec_id", "v"), large, "vec_id").mapInArrow(released(assign), "node string, vec_id long, v array<double>, away double"), "level")
        balls = below.groupBy(F.col("node").alias("child")).agg(F.max("away").alias("radius"))
        child = F.concat_ws("/", "node", "place")
        pages.append(scratch.save(pivots.withColumn("child", child).join(balls, "child").select("node", "child", F.col("pivot").alias("routing"), "radius", "parent"), "pages"))
        level = below
    counts = level.groupBy("node").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts"))
    last = level.join(counts, "node").select(F.concat_ws("#", "node", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("node"), "vec_id", "v")
    # parts of one node are children of its ball
    parts = last.select(F.col("node").alias("part")).distinct().withColumn("whole", F.split("part", "#")[0])
    balls = pages[-1].select(F.col("child").alias("whole"), "routing", "radius").join(parts, "whole")
    pages.append(scratch.save(balls.select(F.col("whole").alias("node"), F.col("part").alias("child"), "routing", "radius", F.lit(0.0).alias("parent")), "pages"))
    return pages, leaves.unionByName(last)


_QUERY = "node string, query_id long, q array<double>, floor double, away double"


def _descend(queries: DataFrame, pages: list[DataFrame], reach: float, width: int, greedy: bool, scratch: Scratch) -> DataFrame:
    """(node, query_id, q, floor, away) of the leaves that each query must see; with ``greedy`` the best one alone."""

    def step(batches):
        for node, page, fresh, part in _stream(batches, ["child", "routing", "radius", "parent"]):
            if fresh:
                children, radius, parent = page["child"].to_pylist(), page["radius"].to_numpy(), page["parent"].to_numpy()
                routing = _lift(_matrix(page["routing"], width), reach)
            q = _matrix(part.column("q"), width)
            size = (q * q).sum(axis=1)[:, None]
            floor, away = part.column("floor").to_numpy()[:, None], part.column("away").to_numpy()[:, None]
            # what stored distances exclude, before any distance to a child is computed
            open_ = (_best(size, reach, np.maximum(0.0, np.abs(away - parent) - radius)) >= floor) | np.isnan(away)
            to = np.full(open_.shape, np.nan)
            some = np.flatnonzero(open_.any(axis=0))
            to[:, some] = _distances(_flat(q), routing[some])
            best = np.where(open_, _best(size, reach, np.maximum(0.0, to - radius)), -np.inf)
            if greedy:
                keep = np.zeros(open_.shape, bool)
                keep[np.arange(len(q)), best.argmax(axis=1)] = True
            else:
                keep = best >= floor
            row, child = np.nonzero(keep)
            for at in range(0, len(row), 1000):
                r, c = row[at : at + 1000], child[at : at + 1000]
                taken = part.take(pa.array(r))
                columns = [pa.array([children[x] for x in c], pa.string()), *(taken.column(k) for k in ("query_id", "q", "floor")), pa.array(to[r, c])]
                yield pa.RecordBatch.from_arrays(columns, ["node", "query_id", "q", "floor", "away"])

    leaves = None
    for page in pages:
        split = page.select("node").distinct()
        counts = queries.groupBy("node").agg(F.count("*").alias("n"))
        stay = queries.join(split, "node", "left_anti")
        leaves = stay if leaves is None else leaves.unionByName(stay)
        queries = scratch.save(_met(page, queries.join(split, "node", "left_semi"), counts, "query_id").mapInArrow(released(step), _QUERY), "descent")
    return queries if leaves is None else leaves.unionByName(queries)


def _search(visits: DataFrame, leaves: DataFrame, reach: float, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best ``k`` of each visited leaf."""

    def run(batches):
        for _, page, fresh, part in _stream(batches, ["vec_id", "v"]):
            if fresh:
                cell = Cell(page["vec_id"].to_numpy(), _matrix(page["v"], width), reach)
            out = [[], [], []]
            for me, (scores, ids) in zip(part.column("query_id").to_pylist(), cell.search(_matrix(part.column("q"), width), part.column("query_id").to_numpy(), part.column("floor").to_numpy(), k)):
                out[0] += [me] * len(ids)
                out[1] += ids
                out[2] += [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    counts = visits.groupBy("node").agg(F.count("*").alias("n"))
    met = _met(leaves.select("node", "vec_id", "v"), visits.select("node", "query_id", "q", "floor"), counts, "query_id")
    return met.mapInArrow(released(run), "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products over all other rows.

    Queries are the rows whose id is divisible by ``every``. Ties go to the smaller vec_id. Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part; shorter vectors end in zeros; a query leaves out
    every row of its own id; rows that repeat an id are rows of their own, and those of a query share one ranking. Fewer
    rows give fewer results; an empty table gives none. Components of any finite size are multiplied exactly; a score that
    a long can't hold is the nearest long, and such scores are ties. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "top-k")
    rows = _valid(vectors, vec_id, embedding)
    schema = "query_id long, rank int, vec_id long, score long"
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    stats = rows.agg(F.count("*"), F.max(norm), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    if not stats[0] or not stats[3]:
        return spark.createDataFrame([], schema)
    reach, width = float(stats[1] or 0), stats[2]
    same = ("mark", "v")
    marked = rows.withColumn("mark", F.xxhash64("v"))
    first = marked.withColumn("ids", F.dense_rank().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("ids") <= k + 1)
    first = first.withColumn("copies", F.row_number().over(Window.partitionBy(*same, "vec_id").orderBy("vec_id"))).where(F.col("copies") <= k)
    pages, leaves = _build(first, reach, width, scratch)
    leaves = scratch.save(leaves, "leaves")

    asked = rows.where(F.col("vec_id") % every == 0)
    root = asked.select(F.lit("r").alias("node"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("floor"), F.lit(float("nan")).alias("away"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    if pages:
        greedy = _search(_descend(root, pages, reach, width, True, scratch), leaves, reach, width, k)
        # a double may lie above a long beyond 2**53, and the least long above what it stands for
        known = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 2.0**-50
        known = F.when(F.col("score") > -(1 << 63) + 1, F.when(F.abs(F.col("score").cast("double")) < 2.0**52, F.col("score").cast("double")).otherwise(known))
        floors = greedy.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", known.alias("known"))
        floors = scratch.save(floors, "floors")
        root = root.join(floors, "query_id", "left").select("node", "query_id", "q", F.coalesce("known", "floor").alias("floor"), "away")
    visits = scratch.save(_descend(root, pages, reach, width, False, scratch), "visits")
    found = _search(visits, leaves, reach, width, k)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

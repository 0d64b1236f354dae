"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings.

Vectors are laid on a sphere by one more component, the root of the greatest squared norm less their own, so that an
inner product with an anchor is a distance: d^2 = |anchor|^2 + greatest - 2 * score. A node of the tree has some split
points far from each other, and each row goes to the nearest one (the hyperplanes between the points are its borders).
For each pair of siblings i, j the node keeps the least and the greatest distance from split point i to any row below j.
A window of scores around an anchor is an annulus; a sibling j whose range from any split point i meets no distance
that the triangle inequality allows the annulus is left out with all below it. Leaves hold their rows in blocks, and what
reaches a leaf is scored exactly in integers.

The split points come from a bounded sample; the ranges are taken over all rows, so no result is lost. Blocks of alike
anchors walk the tree in the tasks, and of each only the anchors that a leaf can serve are sent to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, fresh_worker, partitions, written
from .topk_search import _matrix, _wide, quantised


def on_sphere(m: np.ndarray, greatest: float) -> np.ndarray:
    """Vectors with their further component in front."""
    x = m.astype(np.float64)
    return np.concatenate([np.sqrt(np.maximum(greatest - (x**2).sum(axis=1, keepdims=True), 0)), x], axis=1)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], points.shape[1])
    x, points = _wide(x, width), _wide(points, width)
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (points**2).sum(axis=1)[None, :] - 2 * (x @ points.T), 0))


class Tree:
    """Nodes with split points; a child is a node (0 or more) or a leaf (-1 - its number)."""

    def __init__(self, sample: np.ndarray, fanout: int, least: int):
        self.points: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.low = self.high = None
        self._grow(sample, fanout, max(2, least))

    def _grow(self, x: np.ndarray, fanout: int, least: int) -> int:
        chosen = self._spread(x[: 3 * fanout], fanout) if len(x) > least else np.zeros((0, x.shape[1]))
        if len(chosen) < 2 and self.points:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(chosen if len(chosen) else np.zeros((1, x.shape[1])))
        self.children.append([])
        near = _distances(x, self.points[node]).argmin(axis=1) if len(x) else np.zeros(0, int)
        self.children[node] = [self._grow(x[near == j], fanout, least) for j in range(len(self.points[node]))]
        return node

    @staticmethod
    def _spread(x: np.ndarray, fanout: int) -> np.ndarray:
        """Greedily the points farthest from those chosen."""
        at, away = [0], _distances(x, x[:1])[:, 0]
        while len(at) < min(fanout, len(x)) and away.max() > 1e-6:
            at.append(int(away.argmax()))
            away = np.minimum(away, _distances(x, x[at[-1] :][:1])[:, 0])
        return x[at]

    def place(self, x: np.ndarray, ranges: dict | None = None) -> np.ndarray:
        """The leaf of each row; ``ranges`` gathers (node, i, j) -> (least, greatest distance)."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            d = _distances(x[rows], self.points[node])
            near = d.argmin(axis=1)
            for j, child in enumerate(self.children[node]):
                some = near == j
                if not some.any():
                    continue
                if ranges is not None:
                    for i, (low, high) in enumerate(zip(d[some].min(axis=0), d[some].max(axis=0))):
                        old = ranges.get((node, i, j), (np.inf, -np.inf))
                        ranges[node, i, j] = min(old[0], low), max(old[1], high)
                if child < 0:
                    out[rows[some]] = -1 - child
                else:
                    todo.append((child, rows[some]))
        return out

    def know(self, ranges: list[tuple[int, int, int, float, float]]) -> None:
        """Take over the distance ranges; a sibling without rows is never visited."""
        self.low = [np.full((len(p), len(p)), np.inf) for p in self.points]
        self.high = [np.full((len(p), len(p)), -np.inf) for p in self.points]
        for node, i, j, low, high in ranges:
            self.low[node][i, j], self.high[node][i, j] = low, high

    def walk(self, x: np.ndarray, inner: np.ndarray, outer: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf that the annuli (distances ``inner`` to ``outer`` around the rows of ``x``) can reach, with those rows."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            d = _distances(x[rows], self.points[node])
            least = np.maximum(inner[rows, None] - d, d - outer[rows, None]) - slack
            most = d + outer[rows, None] + slack
            for j, child in enumerate(self.children[node]):
                alive = ((least <= self.high[node][:, j]) & (most >= self.low[node][:, j])).all(axis=1)
                if alive.any():
                    if child < 0:
                        yield -1 - child, rows[alive]
                    else:
                        todo.append((child, rows[alive]))


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of all queries and rows, in a type that holds them; beyond 64 bits the greatest or least number of 64 bits."""
    width = max(rows.shape[1], queries.shape[1])
    rows, queries = _wide(rows, width), _wide(queries, width)
    size = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, width)
    if size < 2**53:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    if size < 2**63:
        return queries @ rows.T
    return np.clip(queries.astype(object) @ rows.astype(object).T, -(2**63), 2**63 - 1).astype(np.int64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).astype("<i8").tobytes()], pa.binary())


def _numbers(data: bytes, *shape: int) -> np.ndarray:
    x = np.frombuffer(data, "<i8")
    return x.reshape(shape) if shape else x


_ASK = "leaf long, q binary, own binary, kinds binary, width int, data binary, low binary, high binary"


def _ask(leaf: int, q: np.ndarray, own: np.ndarray, kinds: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([leaf], pa.int64()), _long(q), _long(own), _long(kinds), pa.array([m.shape[1]], pa.int32()), _long(m), _long(low), _long(high)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _ASK.split(", ")])


LEAST, MOST = -(2**63), 2**63 - 1


class Forest:
    """The tree over a written table of rows, its leaves in blocks, and the searches of both kinds."""

    def __init__(self, vectors: DataFrame, scale: int, sample: int, fanout: int, leaf_rows: int, block: int):
        self.spark = vectors.sparkSession
        self.n = partitions(self.spark)
        clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("embedding", scale).alias("vector"))
        rows = written(clean.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), "rows")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            most, n = 0.0, 0
            for batch in batches:
                most, n = max(most, float((_matrix(batch.column("vector")).astype(np.float64) ** 2).sum(axis=1).max(initial=0))), n + batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([n], pa.int64())], names=["most", "n"])

        total = rows.mapInArrow(measure, "most double, n long").agg(F.max("most").alias("most"), F.sum("n").alias("n")).first()
        self.rows, self.count = rows, total["n"] or 0
        if not self.count:
            return
        self.greatest = total["most"] * (1 + 1e-9) + 1e-9
        self.slack = 1e-5 * (1 + self.greatest**0.5)
        known = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
        self.known = tuple(known.column(c).to_numpy() for c in ("vec_id", "label")) + (_matrix(known.column("vector").combine_chunks()),)
        tree = Tree(on_sphere(self.known[2], self.greatest), fanout, -(-len(self.known[0]) * leaf_rows // self.count))
        greatest, sent = self.greatest, self.spark.sparkContext.broadcast(tree)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            for batch in batches:
                leaf = sent.value.place(on_sphere(_matrix(batch.column("vector")), greatest))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            found: dict = {}
            for batch in batches:
                sent.value.place(on_sphere(_matrix(batch.column("vector")), greatest), found)
            keys = np.array(list(found), np.int64).reshape(len(found), 3)
            ends = np.array(list(found.values()), np.float64).reshape(len(found), 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys.T, *ends.T)], names=["node", "i", "j", "low", "high"])

        # the tree's size is bounded by the sample, so are its ranges
        gathered = rows.mapInArrow(spans, "node long, i long, j long, low double, high double").groupBy("node", "i", "j").agg(F.min("low"), F.max("high"))
        tree.know([tuple(r) for r in gathered.collect()])
        self.tree, self._place = tree, place
        blocks = self._dealt(rows, self.n, 4 * block).mapInArrow(self._pack(block), "leaf long, ids binary, kinds binary, width int, data binary")
        self.blocks = written(blocks, "leaves")

    def _dealt(self, rows: DataFrame, n: int, most: int) -> DataFrame:
        """Rows by leaf; a leaf of over ``most`` rows is dealt out in pieces."""
        placed = rows.mapInArrow(self._place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", leaf long")
        pieces = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / most).alias("pieces"))
        dealt = placed.join(pieces, "leaf").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces"))).select(*rows.columns, "leaf", "piece")
        return dealt.repartition(n, "leaf", "piece").sortWithinPartitions("leaf", "vec_id").drop("piece")

    @staticmethod
    def _pack(block: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            for batch in batches:
                leaf, at = batch.column("leaf").to_numpy(), 0
                while at < len(leaf):
                    end = min(int(np.searchsorted(leaf, leaf[at], "right")), at + block)
                    part = batch.slice(at, end - at)
                    m = _matrix(part.column("vector"))
                    arrays = [pa.array([leaf[at]]), _long(part.column("vec_id").to_numpy()), _long(part.column("label").to_numpy()), pa.array([m.shape[1]], pa.int32()), _long(m)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "ids", "kinds", "width", "data"])
                    at = end

        return pack

    def search(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """q, w, vec_id, score, rank: for each row of ``asks`` (q, vec_id, label, vector, low and high: arrays of as many
        windows) and window w the ``k`` best other rows of the same (or of another) label with low <= score <= high."""
        greatest, slack, known, tree = self.greatest, self.slack, *(self.spark.sparkContext.broadcast(x) for x in (self.known, self.tree))

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            ids, labels, sample = known.value
            for whole in batches:
                for a in range(0, whole.num_rows, 256):
                    batch = whole.slice(a, 256)
                    q, own, kinds = (batch.column(c).to_numpy() for c in ("q", "vec_id", "label"))
                    m = _matrix(batch.column("vector"))
                    width = max(len(x) for x in batch.column("low").to_pylist())
                    # absent windows hold no score
                    low, high = (np.array([x + [empty] * (width - len(x)) for x in batch.column(c).to_pylist()], np.int64).reshape(len(q), width) for c, empty in (("low", MOST), ("high", LEAST)))
                    # k good rows of the sample are a floor for the k-th
                    s = exact_scores(m, sample)
                    s = np.where((ids != own[:, None]) & ((labels == kinds[:, None]) == same), s, -np.inf if s.dtype == np.float64 else LEAST)
                    for w in range(width if len(ids) >= k else 0):
                        for j in range(len(s)):
                            inside = s[j, (s[j] >= low[j, w]) & (s[j] <= high[j, w]) & (s[j] > LEAST)]
                            if len(inside) >= k:
                                low[j, w] = max(low[j, w], int(np.partition(inside, len(inside) - k)[len(inside) - k]))
                    square = (m.astype(np.float64) ** 2).sum(axis=1) + greatest
                    some = (low <= high).any(axis=1)
                    outer = np.sqrt(np.maximum(square - 2.0 * low.min(axis=1, initial=MOST), 0))
                    inner = np.sqrt(np.maximum(square - 2.0 * high.max(axis=1, initial=LEAST), 0))
                    at = np.flatnonzero(some)
                    x = np.concatenate([np.zeros((len(at), 1)), m[at].astype(np.float64)], axis=1)
                    for leaf, rows in tree.value.walk(x, inner[at], outer[at], slack):
                        r = at[rows]
                        yield _ask(leaf, q[r], own[r], kinds[r], m[r], low[r], high[r])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fresh_worker()
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    ids, kinds, asked, own, of = (_numbers(row[c]) for c in ("ids", "kinds", "q", "own", "of"))
                    low, high = (_numbers(row[c], len(asked), -1) for c in ("low", "high"))
                    s = exact_scores(_numbers(row["asked"], len(asked), row["wide"]), _numbers(row["data"], len(ids), row["width"]))
                    j, r = np.nonzero((s >= low.min(axis=1)[:, None]) & (s <= high.max(axis=1)[:, None]))
                    good = (ids[r] != own[j]) & ((kinds[r] == of[j]) == same)
                    j, r = j[good], r[good]
                    s = s[j, r].astype(np.int64)
                    order = np.lexsort((ids[r], -s, j))
                    j, r, s = j[order], r[order], s[order]
                    out = []
                    for w in range(low.shape[1]):
                        inside = np.flatnonzero((s >= low[j, w]) & (s <= high[j, w]))
                        q = j[inside]
                        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
                        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                        best = inside[rank < k]
                        out.append((asked[j[best]], np.full(len(best), w), ids[r[best]], s[best]))
                    columns = [np.concatenate(x) for x in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["q", "w", "vec_id", "score"])

        tasks = max(1, min(self.n, -(-asks.count() // 256)))
        sent = self._dealt(asks, tasks, 4096).drop("leaf").mapInArrow(walk, _ASK)
        sent = sent.select("leaf", "q", "own", F.col("kinds").alias("of"), F.col("width").alias("wide"), F.col("data").alias("asked"), "low", "high")
        # a merge join: what the walk sends is far more than Spark would guess from the anchors, too much for a broadcast
        found = self.blocks.join(sent.hint("merge"), "leaf").drop("leaf").mapInArrow(score, "q long, w long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("q", "w").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, sample: int = 4096, fanout: int = 16, leaf_rows: int = 1024, block: int = 2048
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Takes vectors and anchors (vec_id integer, label integer, embedding). Scores are integer inner products of
    floor(scale * component). The ``positives`` of an anchor are its best rows of its own label; for each, the result has
    the ``negatives`` best rows of other labels with low * positive <= 100 * score <= high * positive. Equal scores go to
    the smaller vec_id. A row is neither for an anchor of the same vec_id. Rows with a null vec_id, label or vector, or with null or
    non-finite components, take no part; shorter vectors are filled up with zeros. Repeated rows are rows each (repeated anchors
    give repeated results); extra columns are ignored; an empty table, an anchor without positives and a positive without
    negatives give no rows. Scores beyond 64 bits count as the greatest or least number of 64 bits.
    The tree is fitted on ``sample`` rows at most; every row is in a leaf, and the search is exact.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    forest = Forest(vectors, scale, sample, fanout, leaf_rows, block)
    if not forest.count:
        return spark.createDataFrame([], schema)
    clean = anchors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("embedding", scale).alias("vector"))
    asked = written(clean.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").withColumn("q", F.monotonically_increasing_id()), "anchors")
    every = asked.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    near = forest.search(every, True, positives)
    found = written(near.select("q", (F.col("rank") - 1).cast("long").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * p <= 100 * s and 100 * s <= high * p in integers; a decimal holds the products
    share = lambda x, of, up: (F.ceil if up else F.floor)(x.cast("decimal(38,0)") * F.lit(of) / F.lit(100)).cast("long")
    windows = found.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("w", share(F.col("positive_score"), low, True).alias("low"), share(F.col("positive_score"), high, False).alias("high")))).alias("a"))
    again = asked.join(windows.select("q", F.col("a.low").alias("low"), F.col("a.high").alias("high")), "q")
    hard = forest.search(again.select("vec_id", "label", "vector", "q", "low", "high"), False, negatives)
    named = hard.select("q", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["q", "w"]).join(asked.select("q", F.col("vec_id").alias("anchor_id")), "q")
    out = written(named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
    drop(forest.rows, forest.blocks, asked, found)
    return out

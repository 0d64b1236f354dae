"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

A pair at the threshold differs, on a random projection of its unit vectors, by a normal variable whose deviation is the
length of their difference. So on each projection a window of a fixed half-width around a vector holds a true
partner with a known probability, and the number of windows that hold it is binomial. Projections are sorted, each
vector's windows are ranges of the sorted order, collisions are counted per pair, and pairs that reach a count which
true pairs miss with probability MISS at most are verified by their cosine in double precision.

Before that, equal vectors of a label are one row with its number of copies, and the rows of a label are cut into cells by the medians
of further projections, as many as its number of rows asks for. A row lives in one cell and also asks in those behind a
median that its window reaches; the windows are as wide as the number of cuts needs to keep the pairs. A cell of many rows is compared
block by block, so no task grows with it. A dense group, such as near copies that are a third of all rows, has a lead:
rows within half the threshold's angle of one lead are linked by the triangle inequality, counted by a sum, and
skipped by the blocks. Blocks give counts and spanning links, never their pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh_worker, partitions, written
from .components import components

#: Projections, half-width of a window in lengths of a threshold pair's difference, share of threshold pairs that may miss the count, and the cells.
PROJECTIONS, WIDTH, MISS, CELL_MISS = 64, 0.6, 1e-4, 0.004
#: Cuts at most, and rows of a block.
CUTS, BLOCK = 24, 1024
#: Rows of the sample in which dense groups are looked for, and neighbours there that make one.
SAMPLE, DENSE = 4096, 8


@lru_cache(8)
def projections(width: int, seed: int, n: int) -> np.ndarray:
    """``n`` Gaussian directions, the same in every task; each component's numbers depend on its place alone."""
    return np.array([np.random.default_rng([seed, d]).standard_normal(n) for d in range(width)]).reshape(width, n)


def _apart(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-12))


@lru_cache
def least_count(cosine: float) -> int:
    """The greatest count that a pair at the threshold reaches with probability 1 - MISS."""
    p = math.erf(WIDTH / math.sqrt(2))
    tail, count = 0.0, 0
    while tail <= MISS and count < PROJECTIONS:
        tail += math.comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        count += 1
    return count - 1


@lru_cache
def cut_window(cosine: float, cuts: int) -> float:
    """The half-width around ``cuts`` medians within which a row also asks behind them, so that pairs at the threshold are lost
    with probability CELL_MISS at most: a pair meets if one of the two reaches over every median between them."""
    random = np.random.default_rng(7)
    x = random.standard_normal((20_000, max(1, cuts)))
    y = cosine * x + math.sqrt(1 - cosine**2) * random.standard_normal(x.shape)
    between = (x > 0) != (y > 0)
    reach = np.minimum(np.where(between, np.abs(x), 0).max(axis=1), np.where(between, np.abs(y), 0).max(axis=1))
    return float(np.quantile(reach, 1 - CELL_MISS))


def _flat(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<f8") for x in column.to_pylist()]


def _laid(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    out = np.zeros((len(vectors), max([width, *map(len, vectors)])))
    for j, v in enumerate(vectors):
        out[j, : len(v)] = v
    return out


def _units(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True, initial=0)
    m = m / np.where(top > 0, top, 1)  # squares neither vanish nor overflow
    return m / np.sqrt((m**2).sum(axis=1, keepdims=True))


def _read(vectors: DataFrame) -> DataFrame:
    """no (a number for each row), vec_id, label, key (of label and vector), unit (unit vector; null if it takes no part)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            labels, lists = batch.column("label").to_pylist(), batch.column("embedding")
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values, ends = flat.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0, np.cumsum(sizes)  # null components become NaN, -0 becomes 0
            keys, units = [], []
            for label, n, end in zip(labels, sizes.tolist(), ends.tolist()):
                v = values[end - n : end]
                good = label is not None and n > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                u = _units(v[None, :])[0].astype("<f8").tobytes() if good else None
                units.append(u)
                keys.append(hashlib.blake2b(v.astype("<f8").tobytes(), digest_size=16, salt=hashlib.blake2b(str(label).encode(), digest_size=16).digest()).digest() if good else None)
            numbers = pa.array(np.arange(number, number + len(keys)))
            number += len(keys)
            yield pa.RecordBatch.from_arrays([numbers, batch.column("vec_id"), pa.array([None if x is None else str(x) for x in labels], pa.string()), pa.array(keys, pa.binary()), pa.array(units, pa.binary())], names=["no", "vec_id", "label", "key", "unit"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return written(rows.mapInArrow(take, "no long, vec_id long, label string, key binary, unit binary"), "vectors")


class Leads:
    """Rows of the sample with many neighbours, far apart from each other, by label."""

    def __init__(self, rows: list, angle: float):
        self.by_label: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.reach = math.cos(angle / 2 - 1e-6) if angle > 4e-6 else 2.0
        near = math.cos(angle / 4)
        for label in sorted({r["label"] for r in rows}):
            some = [r for r in rows if r["label"] == label]
            u = _laid([np.frombuffer(r["unit"], "<f8") for r in some])
            close = u @ u.T >= near
            chosen: list[int] = []
            for j in np.argsort(-close.sum(axis=1), kind="stable").tolist():
                if close[j].sum() <= DENSE:
                    break
                if not chosen or (u[chosen] @ u[j]).max() < self.reach:
                    chosen.append(j)
            if chosen:
                self.by_label[label] = u[chosen], np.array([some[j]["no"] for j in chosen], np.int64)

    def of(self, label: str, u: np.ndarray) -> np.ndarray:
        """The number of the nearest lead within half the threshold's angle, -1 without one."""
        held = self.by_label.get(label)
        if held is None:
            return np.full(len(u), -1, np.int64)
        width = max(u.shape[1], held[0].shape[1])
        cosines = np.pad(u, ((0, 0), (0, width - u.shape[1]))) @ np.pad(held[0], ((0, 0), (0, width - held[0].shape[1]))).T
        return np.where(cosines.max(axis=1) >= self.reach, held[1][cosines.argmax(axis=1)], -1)


def _cells(cosine: float, leads, medians, cell: int):
    """Rows (no, label, copies, unit, n: rows of the label) to one row for each cell that they live or ask in.

    ``close`` has the bits of the cuts that a row reaches over: it asks in another's cell if no other bit differs.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                labels = np.array(batch.column("label").to_pylist(), object)
                u = _laid(_flat(batch.column("unit")))
                h = u @ projections(u.shape[1], 1, CUTS)
                lead, at, cells, homes, close = np.full(len(u), -1, np.int64), [], [], [], []
                for label in dict.fromkeys(labels):
                    rows = np.flatnonzero(labels == label)
                    lead[rows] = leads.value.of(label, u[rows])
                    n = batch.column("n")[int(rows[0])].as_py()
                    cuts = min(CUTS, max(0, math.ceil(math.log2(n / cell))))
                    away = h[rows, :cuts] - medians.value.get(label, np.zeros(CUTS))[:cuts]
                    bits = 1 << np.arange(cuts)
                    home = ((away > 0) * bits).sum(axis=1)
                    near = np.abs(away) <= (cut_window(cosine, cuts) if cuts else 0)
                    for j, row in enumerate(rows.tolist()):
                        asks = [int(home[j])]
                        for c in np.flatnonzero(near[j]).tolist():
                            asks += [x ^ (1 << c) for x in asks]
                        at += [row] * len(asks)
                        cells += asks
                        homes += [int(home[j])] * len(asks)
                        close += [int((near[j] * bits).sum())] * len(asks)
                rows = batch.append_column("lead", pa.array(lead)).select(["no", "label", "lead", "copies", "unit"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in (cells, homes, close))], names=["no", "label", "lead", "copies", "unit", "cell", "home", "close"])

    return deal


_SIDE = ("nos", "copies", "leads", "homes", "close")
_PACK = "block long, label string, cell long, lead long, lives boolean, " + ", ".join(f"{c} binary" for c in _SIDE) + ", width int, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label, cell, home or not, and lead to blocks; rows of a lead are apart from those without, or with another one."""
    fresh_worker()
    number = TaskContext.get().partitionId() << 33
    for whole in batches:
        keys = list(zip(*(whole.column(c).to_pylist() for c in ("label", "cell", "lives", "lead"))))
        at = 0
        while at < whole.num_rows:
            end = at + 1
            while end < min(whole.num_rows, at + BLOCK) and keys[end] == keys[at]:
                end += 1
            part = whole.slice(at, end - at)
            m = _laid(_flat(part.column("unit")))
            label, cell, lives, lead = keys[at]
            number += 1
            columns = [pa.array([number], pa.int64()), pa.array([label]), pa.array([cell], pa.int64()), pa.array([lead], pa.int64()), pa.array([lives])]
            columns += [pa.array([part.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("no", "copies", "lead", "home", "close")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([m.shape[1]], pa.int32()), pa.array([m.astype("<f8").tobytes()], pa.binary())], names=[c.split()[0] for c in _PACK.split(", ")])
            at = end


def collisions(q: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of ``q`` and ``y`` (unit vectors) whose windows collide often enough, counted along each sorted projection."""
    directions = projections(q.shape[1], 2, PROJECTIONS)
    hq, hy = q @ directions, y @ directions
    half, count = WIDTH * _apart(cosine) + 1e-9, np.zeros(len(q) * len(y), np.uint8)
    for i in range(PROJECTIONS):
        order = np.argsort(hy[:, i])
        along = hy[order, i]
        low, high = np.searchsorted(along, hq[:, i] - half), np.searchsorted(along, hq[:, i] + half, "right")
        sizes = high - low
        places = np.arange(sizes.sum()) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        count[np.repeat(np.arange(len(q)) * len(y), sizes) + order[places]] += 1
    return np.divmod(np.flatnonzero(count >= least_count(cosine)), len(y))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (numbers) reduced to one from each number to the least that it reaches."""
    names, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    least = np.arange(len(names))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        least = least[least]
        if (least == before).all():
            apart = np.flatnonzero(least != np.arange(len(names)))
            return names[apart], names[least[apart]]


def _linked(q: dict, y: dict, cell: int, own: bool, cosine: float) -> pa.RecordBatch:
    """Counts (a, links) and spanning links (a, b) of two blocks of a cell."""
    width = max(q["unit"].shape[1], y["unit"].shape[1])
    uq, uy = (np.pad(s["unit"], ((0, 0), (0, width - s["unit"].shape[1]))) for s in (q, y))
    i, j = collisions(uq, uy, cosine)
    if own:
        i, j = i[i < j], j[i < j]
    # a pair of two cells may meet in both; it counts in the one of the smaller number then
    hq, hy = q["homes"][i], y["homes"][j]
    away = np.where(hy == cell, y["close"][j], q["close"][i])
    other = np.where(hy == cell, hq, hy)
    meets_there = ((hq ^ hy) & ~away) == 0
    counts = np.where(hq == hy, hq == cell, ((hq == cell) | (hy == cell)) & (~meets_there | (cell < other)))
    counts &= (q["leads"][i] < 0) | (q["leads"][i] != y["leads"][j])  # those of one lead are known
    i, j = i[counts], j[counts]
    good = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 16):
        part = slice(a, a + (1 << 16))
        good[part] = np.einsum("ij,ij->i", uq[i[part]], uy[j[part]]) >= cosine
    i, j = i[good], j[good]
    links = [np.bincount(at, weights=other, minlength=n).astype(np.int64) for at, other, n in ((i, y["copies"][j], len(uq)), (j, q["copies"][i], len(uy)))]
    nos, n = np.concatenate([q["nos"], y["nos"]]), np.concatenate(links)
    a, b = _spanning(q["nos"][i], y["nos"][j])
    nos, n = nos[n > 0], n[n > 0]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([nos, a])), pa.array(np.concatenate([np.zeros(len(nos), np.int64), b]), mask=np.arange(len(nos) + len(a)) < len(nos)), pa.array(np.concatenate([n, np.zeros(len(a), np.int64)]))], names=["a", "b", "links"]
    )


def _compare(cosine: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sides = []
                for s in ("q", "y"):
                    of = {c: np.frombuffer(row[s][c], "<i8") for c in _SIDE}
                    sides.append(of | {"unit": np.frombuffer(row[s]["data"], "<f8").reshape(len(of["nos"]), row[s]["width"])})
                yield _linked(*sides, row["cell"], row["q"]["block"] == row["y"]["block"], cosine)

    return compare


def _pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a cell (label, cell, q, y) of which one lives there, but for two of the same lead."""
    packed = F.struct("block", "lives", *_SIDE, "width", "data")
    q, y = (blocks.select("label", "cell", F.col("lead").alias(f"{s}_lead"), packed.alias(s)) for s in ("q", "y"))
    one_lives = (F.col("q.lives") | F.col("y.lives"))
    free = q.where("q_lead < 0").join(y, ["label", "cell"]).where(one_lives & ((F.col("y_lead") >= 0) | (F.col("q.block") <= F.col("y.block"))))
    # two leads of a cell, each pair of them once: blocks of one lead never meet
    held = blocks.where("lead >= 0").select("label", "cell", "lead").distinct()
    both = held.withColumnRenamed("lead", "q_lead").join(held.withColumnRenamed("lead", "y_lead"), ["label", "cell"]).where("q_lead < y_lead")
    apart = both.join(q, ["label", "cell", "q_lead"]).join(y, ["label", "cell", "y_lead"]).where(one_lives)
    return free.select("cell", "q", "y").unionByName(apart.select("cell", "q", "y"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, cell: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``.

    Takes vectors (vec_id integer, label, embedding). Rows link when their labels are equal and not null and the cosine
    of their vectors in double precision is at least ``cosine`` (above 0.5); links below it are never made, and of pairs
    at the threshold itself a share of MISS + CELL_MISS at most may be missed, of closer ones fewer. n_links counts
    the other rows linked directly; component_id is the smallest vec_id reachable by links, the row's own included; kept
    tells whether it is the row's own.

    Null, empty and zero vectors, those with null or non-finite components and rows with a null label link with nothing and are
    kept. Shorter vectors are filled up with zeros. Equal rows link with each other: repeated rows are rows each. A null vec_id is
    never the smallest; a component of nothing else has a null component_id, and its rows are kept. Extra columns are ignored; an
    empty table gives an empty result. ``cell`` is the number of rows of a label from which it is cut.
    """
    if not 0.5 < cosine < 1:
        raise ValueError("the threshold must be above 0.5 and below 1")
    spark = vectors.sparkSession
    n = partitions(spark)
    rows = _read(vectors)
    classes = written(rows.where("unit IS NOT NULL").groupBy("label", "key").agg(F.min("no").alias("no"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "classes")
    sample = classes.select("no", "label", "unit").orderBy(F.xxhash64("no"), "no").limit(SAMPLE).collect()
    leads = spark.sparkContext.broadcast(Leads(sample, math.acos(cosine)))
    middles: dict[str, np.ndarray] = {}
    for label in {r["label"] for r in sample}:
        u = _laid([np.frombuffer(r["unit"], "<f8") for r in sample if r["label"] == label])
        middles[label] = np.median(u @ projections(u.shape[1], 1, CUTS), axis=0)
    medians = spark.sparkContext.broadcast(middles)
    counted = classes.join(classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("no", "label", "copies", "unit", "n")
    dealt = written(counted.mapInArrow(_cells(cosine, leads, medians, cell), "no long, label string, lead long, copies long, unit binary, cell long, home long, close long"), "cells")
    # a cell of very many rows is dealt out in pieces
    pieces = dealt.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).alias("pieces"))
    spread = dealt.join(pieces, ["label", "cell"]).withColumns({"piece": F.pmod(F.xxhash64("no"), F.col("pieces")), "lives": F.col("cell") == F.col("home")})
    ordered = spread.repartition(n, "label", "cell", "piece").sortWithinPartitions("label", "cell", "lives", "lead").select("no", "label", "lead", "copies", "unit", "cell", "home", "close", "lives")
    blocks = written(ordered.mapInArrow(_pack, _PACK), "blocks")
    found = written(_pairs(blocks).mapInArrow(_compare(cosine), "a long, b long, links long"), "links")
    led = dealt.where("cell = home AND lead >= 0").select("no", "lead", "copies")
    totals = led.groupBy("lead").agg(F.sum("copies").alias("total"))
    same_lead = led.join(totals, "lead").select("no", (F.col("total") - F.col("copies")).alias("others"))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("no")).agg(F.sum("links").alias("links"))
    joined = written(components(found.where("b IS NOT NULL").select("a", "b").unionByName(led.select(F.col("no").alias("a"), F.col("lead").alias("b")))), "components")
    named = joined.join(classes.select(F.col("no").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of = joined.join(named, "component").select(F.col("node").alias("no"), "component_id")
    each = classes.select("label", "key", "no", "least", "copies").join(links, "no", "left").join(same_lead, "no", "left").join(of, "no", "left")
    each = each.select("label", "key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("vec_id", "label", "key").join(each, ["label", "key"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    done = written(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "near-duplicates")
    drop(rows, classes, dealt, blocks, found, joined)
    return done

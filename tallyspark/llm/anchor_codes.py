"""Vector code compression: product quantization whose k-means runs over anchors-hierarchy metric trees of the parts.

Vectors are cut into equal consecutive parts and each part position has a codebook.  Rows are taken in blocks as they come
from the table's partitions (no shuffle); a block's parts of one position become a metric tree, built once:

* middle-out: about sqrt(n) anchors, each new one the point farthest from its own anchor, which takes the points that are
  nearer to it (a point nearer to its anchor than half of the anchors' distance is never tested); large anchors are
  split likewise below, and above the pair of balls with the smallest common ball is joined until one is left;
* a ball keeps pivot, radius, and the sum and count of its points (equal parts of a block are one point with a count, so a
  vector that fills the table is one point a block).

In a round, balls inherit the candidate entries of the ball above.  An entry goes if another one is nearer everywhere in the
ball; a ball with one candidate left is wholly owned, and its cached sum and count go to the entry without a look at its
points.  Only points of leaves with several candidates are compared, with these alone.  All of it is exact: pivots, radii,
sums and distances are integers, and an entry goes only if it is farther by more than rounding can make it, so ties still fall
to the lower index.  A task sends one sum and count for each entry and position, whatever its rows; the driver holds the
codebooks alone (parts x entries).  The trees lie in a table in the shared folder and are read again each round.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; the codebooks start with the
``entries`` smallest ids (null ids last, equal ids by vector, repeated rows each count), with fewer rows there are fewer
entries; an entry that no part chose stays.  Vectors of another length than most have (at a tie the longer) can't be cut like
these and are left out, too, as are empty ones.  An empty table gives an empty table.  A length that the parts don't divide
and components so large that a squared distance leaves 64 bits are refused.  Extra columns are kept; one
with the name of an output column gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import drop_caches, give_memory_back, without, written

#: Components in a block (4,096 vectors of 64), points in a leaf, and pairs of points and entries compared at a time.
BLOCK_VALUES, LEAF, PAIRS = 1 << 18, 24, 1 << 20
SCALE = 256


# ---- trees

@dataclass
class Forest:
    """The trees of a block.  Points lie so that every ball's are points[low:high]; children are -1 in leaves."""

    part: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pivot: np.ndarray
    radius2: np.ndarray
    total: np.ndarray
    count: np.ndarray
    roots: np.ndarray
    points: np.ndarray
    weight: np.ndarray

    FIELDS = ("part", "low", "high", "left", "right", "pivot", "radius2", "total", "count", "roots", "points", "weight")


def _square(x: np.ndarray) -> np.ndarray:
    return np.einsum("...i,...i->...", x, x)


def anchors(points: np.ndarray, most: int) -> np.ndarray:
    """The anchor (0, 1, ...) of each point: up to ``most`` anchors, each the point farthest from its own one before."""
    own = np.zeros(len(points), np.int64)
    pivots = points[:1]
    far = _square(points - pivots[0])
    for k in range(1, most):
        new = int(far.argmax())
        if not far[new]:
            break
        apart = _square(pivots - points[new])
        test = np.flatnonzero(4 * far >= apart[own])
        near = _square(points[test] - points[new])
        taken = near < far[test]
        test = test[taken]
        own[test], far[test] = k, near[taken]
        pivots = np.concatenate([pivots, points[new : new + 1]])
    return own


class _Tree:
    """One part position's tree while it is built: nodes as (left, right, points) lists."""

    def __init__(self, points: np.ndarray):
        self.points, self.nodes, self.balls = points, [], []

    def ball(self, left: int, right: int, rows: np.ndarray) -> int:
        own = self.points[rows]
        pivot = own.sum(axis=0) // max(1, len(rows))
        self.nodes.append((left, right, rows))
        self.balls.append((pivot, int(_square(own - pivot).max(initial=0))))
        return len(self.nodes) - 1

    def build(self, rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            return self.ball(-1, -1, rows)
        own = anchors(self.points[rows], math.isqrt(len(rows) - 1) + 1)
        order = np.argsort(own, kind="stable")
        groups = np.split(rows[order], np.flatnonzero(np.diff(own[order])) + 1)
        return self.joined([self.build(g) for g in groups])

    def joined(self, nodes: list[int]) -> int:
        """Joins the pair of balls with the smallest common ball until one is left."""
        k = len(nodes)
        pivots, radii = np.array([self.balls[i][0] for i in nodes], np.float64), np.sqrt([self.balls[i][1] for i in nodes])
        common = lambda i: (np.sqrt(_square(pivots - pivots[i])) + radii + radii[i]) / 2
        size = np.stack([common(i) for i in range(k)])
        np.fill_diagonal(size, np.inf)
        for _ in range(k - 1):
            i, j = sorted(divmod(int(size.argmin()), k))
            nodes[i] = self.ball(nodes[i], nodes[j], np.concatenate([self.nodes[nodes[i]][2], self.nodes[nodes[j]][2]]))
            pivots[i], radii[i] = self.balls[nodes[i]][0], math.sqrt(self.balls[nodes[i]][1])
            size[j], size[:, j] = np.inf, np.inf
            gone = np.isinf(size[i])
            size[i] = np.where(gone, np.inf, common(i))
            size[:, i] = size[i]
            last = nodes[i]
        return last if k > 1 else nodes[0]


def forest(values: np.ndarray, parts: int) -> tuple[Forest, np.ndarray]:
    """Trees of a block's vectors (integers), and the place of each vector's part among the points, [parts, rows]."""
    n, width = len(values), values.shape[1] // parts
    out: dict[str, list] = {f: [] for f in Forest.FIELDS}
    place = np.empty((parts, n), np.int64)
    nodes_before = points_before = 0
    for p in range(parts):
        own = np.ascontiguousarray(values[:, p * width : (p + 1) * width])
        codes = np.zeros(n, np.int64)
        for c in own.T:
            _, c = np.unique(c, return_inverse=True)
            _, codes = np.unique(codes * (int(c.max(initial=0)) + 1) + c, return_inverse=True)
        _, first, inverse, times = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
        tree = _Tree(own[first])
        root = tree.build(np.arange(len(first)))
        order = tree.nodes[root][2]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        points, weight = tree.points[order], times[order]
        sums = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(points * weight[:, None], axis=0)])
        counts = np.concatenate([[0], np.cumsum(weight)])
        low = np.array([rank[rows[0]] for _, _, rows in tree.nodes], np.int64)
        high = low + [len(rows) for _, _, rows in tree.nodes]
        child = lambda side: np.array([x[side] + nodes_before if x[side] >= 0 else -1 for x in tree.nodes], np.int64)  # noqa: B023, E731
        for name, x in (("part", np.full(len(low), p)), ("low", low + points_before), ("high", high + points_before), ("left", child(0)), ("right", child(1)), ("pivot", np.array([b for b, _ in tree.balls], np.int64)),
                        ("radius2", np.array([r for _, r in tree.balls], np.int64)), ("total", sums[high] - sums[low]), ("count", counts[high] - counts[low]), ("roots", np.array([root + nodes_before])), ("points", points), ("weight", weight)):
            out[name].append(x)
        place[p] = rank[inverse] + points_before
        nodes_before += len(low)
        points_before += len(points)
    return Forest(**{k: np.concatenate(v) for k, v in out.items()}), place


@dataclass
class Owners:
    """Which entry every point of a forest chose, its squared distance, and what the descent cost."""

    entry: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    compared: int
    owned: int


def owners(f: Forest, books: np.ndarray) -> Owners:
    """The nearest entry of each point of a forest under codebooks [parts, entries, width] (lower index at ties), with the sums
    and counts of all entries, by one descent in which balls inherit shrinking candidate lists."""
    parts, entries, width = books.shape
    apart = _square(books[:, :, None, :] - books[:, None, :, :])
    alive = np.ones((parts, entries), bool)
    same = apart == 0
    alive[np.tril(same, -1).any(axis=2)] = False  # of equal entries the first gets all
    root_apart = np.sqrt(apart.astype(np.float64))
    entry, sums, counts = np.zeros(len(f.points), np.int64), np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
    far, compared, owned = np.iinfo(np.int64).max, 0, 0
    nodes, lists, leaves = f.roots, alive[f.part[f.roots]], []
    while len(nodes):
        part = f.part[nodes]
        d = np.where(lists, _square(f.pivot[nodes][:, None, :] - books[part]), far)
        compared += int(lists.sum())
        best = d.argmin(axis=1)
        ahead = d - d[np.arange(len(nodes)), best][:, None]
        reach = 2 * np.sqrt(f.radius2[nodes].astype(np.float64))[:, None] * root_apart[part, best]
        lists = lists & ~(ahead > reach * (1 + 1e-9))
        lists[np.arange(len(nodes)), best] = True
        whole = lists.sum(axis=1) == 1
        at, who = nodes[whole], best[whole]
        np.add.at(sums, (f.part[at], who), f.total[at])
        np.add.at(counts, (f.part[at], who), f.count[at])
        size = f.high[at] - f.low[at]
        owned += int(size.sum())
        entry[_ranges(f.low[at], size)] = np.repeat(who, size)
        leaf = ~whole & (f.left[nodes] < 0)
        leaves.append((nodes[leaf], lists[leaf]))
        inner = ~whole & ~leaf
        nodes, lists = np.concatenate([f.left[nodes[inner]], f.right[nodes[inner]]]), np.concatenate([lists[inner], lists[inner]])
    nodes, lists = np.concatenate([n for n, _ in leaves]), np.concatenate([x for _, x in leaves])
    size = f.high[nodes] - f.low[nodes]
    cost = np.concatenate([[0], np.cumsum(size * lists.sum(axis=1))])
    at = 0
    while at < len(nodes):
        end = max(at + 1, int(np.searchsorted(cost, cost[at] + PAIRS, side="right")) - 1)
        own = _ranges(f.low[nodes[at:end]], size[at:end])
        ball = np.repeat(np.arange(at, end), size[at:end])
        point, candidate = np.nonzero(lists[ball])
        part = f.part[nodes[ball]]
        d = _square(f.points[own[point]] - books[part[point], candidate])
        begin = np.searchsorted(point, np.arange(len(own)))
        least = np.flatnonzero(d == np.minimum.reduceat(d, begin)[point])
        least = least[np.r_[True, point[least[1:]] != point[least[:-1]]]]
        entry[own] = candidate[least]
        np.add.at(sums, (part, entry[own]), f.points[own] * f.weight[own][:, None])
        np.add.at(counts, (part, entry[own]), f.weight[own])
        compared += len(point)
        at = end
    return Owners(entry, sums, counts, compared, owned)


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(low - (ends - size), size)


# ---- jobs

def finite_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds finite numbers only."""
    return rows.where(F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: (x - x) == 0), F.lit(False)))


def _integers(flat: np.ndarray, width: int) -> np.ndarray:
    scaled = np.floor(flat.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= math.isqrt((1 << 60) // max(1, width)):
        raise ArithmeticError("a squared distance would leave 64 bits")
    return scaled.astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """An integer array in the narrowest type that holds it; the first byte names the type."""
    for kind in (np.int8, np.int16, np.int32):
        if not len(x) or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return np.dtype(kind).char.encode() + np.ascontiguousarray(x, kind).tobytes()
    return b"q" + np.ascontiguousarray(x, np.int64).tobytes()


def _wide(x: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(x, np.dtype(chr(x[0])), offset=1).astype(np.int64).reshape(shape or -1)


_TREES = ", ".join(f"{f} binary" for f in ("rows", "place", *Forest.FIELDS))


def tree_blocks(rows: DataFrame, vector: str, parts: int, dims: int, keep: list[str]) -> DataFrame:
    """One row a block: the kept columns (Arrow stream), each vector's places and the trees."""
    width = dims // parts
    most = max(1, BLOCK_VALUES // max(1, dims))

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches).combine_chunks()
        flat = pc.list_flatten(t.column(vector).combine_chunks()).to_numpy(zero_copy_only=False)
        f, place = forest(_integers(flat, width).reshape(t.num_rows, dims), parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.select(keep).schema) as w:
            w.write_table(t.select(keep))
        cells = [sink.getvalue().to_pybytes(), _narrow(place.ravel()), *(_narrow(getattr(f, x).ravel()) for x in Forest.FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["rows", "place", *Forest.FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        give_memory_back()
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                step = b.slice(at, most - n)
                held.append(step)
                at, n = at + step.num_rows, n + step.num_rows
                if n == most:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return written(rows.select(*keep, vector).mapInArrow(run, _TREES))


def _forest_of(b: pa.RecordBatch, i: int, width: int) -> Forest:
    shape = {"pivot": (-1, width), "total": (-1, width), "points": (-1, width)}
    one = {x: _wide(b.column(x)[i].as_py(), *(shape.get(x, ()) if width else ())) for x in Forest.FIELDS}
    for x in shape if not width else ():
        one[x] = np.zeros((len(one["weight" if x == "points" else "low"]), 0), np.int64)
    return Forest(**one)


def _moved(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts that chose it."""
    parts, entries, width = books.shape
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books_shape, np.int64), np.zeros(books_shape[:2], np.int64)
        for b in batches:
            for i in range(b.num_rows):
                got = owners(_forest_of(b, i, books_shape[2]), sent.value)
                sums += got.sums
                counts += got.counts
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    books_shape = books.shape
    by_task = trees.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = by_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width)])
    out = books.copy()
    for part, entry, n, *sums in totals.collect():  # parts x entries rows
        out[part, entry] = [s // n for s in sums]
    sent.unpersist()
    return out


def quantize(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows with a finite vector: ``keep`` columns (all but the vector by default) with ``codes`` (array<int>, one entry for each
    part position) and ``error`` (squared distances summed over the parts), and the codebooks [parts, entries, width] as
    integers of 1/256."""
    keep = without([c for c in rows.columns if c != vector] if keep is None else keep, ["codes", "error"])
    schema = rows.select(*keep).schema.add("codes", T.ArrayType(T.IntegerType(), False), False).add("error", "long", False)
    good = finite_vectors(rows, vector)
    common = good.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).where("d > 0").orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    dims = common["d"]
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    good = good.where(F.size(vector) == dims)
    first = good.orderBy(F.col(id_col).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    width = dims // parts
    books = _integers(np.array([r[0] for r in first], np.float64), width).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    trees = tree_blocks(good, vector, parts, dims, keep)
    for _ in range(rounds):
        books = _moved(trees, books)
    return _coded(trees, books, keep, schema), books


def _coded(trees: DataFrame, books: np.ndarray, keep: list[str], schema: T.StructType) -> DataFrame:
    parts, _, width = books.shape
    sent = trees.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                f = _forest_of(b, i, width)
                entry = owners(f, sent.value).entry
                part = np.repeat(np.arange(parts), np.diff(np.append(f.low[f.roots], len(f.points))))
                gap = _square(f.points - sent.value[part, entry])
                rows = pa.ipc.open_stream(b.column("rows")[i].as_buffer()).read_all().combine_chunks()
                place = _wide(b.column("place")[i].as_py()).reshape(parts, -1)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(entry[place].T.ravel(), pa.int32()), parts).cast(pa.list_(pa.int32()))
                columns = [rows.column(k).combine_chunks() for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, codes, pa.array(gap[place].sum(axis=0))], [*keep, "codes", "error"])

    return trees.mapInArrow(run, schema)


def hex_code(codes: str | Column) -> Column:
    """Two hex digits an entry, in part order."""
    return F.concat_ws("", F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    import hashlib

    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, label: str = "label", name: str = "label_error") -> DataFrame:
    """The error summed over the rows of equal label (nulls together): sums are made first, one row a label, and joined back."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias(name))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")

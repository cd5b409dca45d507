"""Exact vector search as Spark jobs.

Scores are rounded to nine digits before they are ranked, so that equal vectors
tie in every engine and ties go to the smaller id.
"""

from __future__ import annotations

import gc
import math
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.session import cut_lineage

SCORE_DIGITS = 9
# Bounds of a block of queries: its vectors, and what a task keeps for it.
BROADCAST_BYTES = 64 * 1024 * 1024
STATE_BYTES = 256 * 1024 * 1024
# Rows of a block, fewer where vectors are long; and score cells held at a time.
BLOCK_ROWS = 24_576
BLOCK_BYTES = 64 * 1024 * 1024
SCORE_CELLS = 4_000_000
# Rows and columns of scores that a join makes at a time: they stay in a core's cache.
TILE = (256, 1024)
HIT_SCHEMA = "query_id bigint, want int, item_id bigint, tie bigint, score double"


def rows_per_block(dims: int, most: int) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * max(dims, 1))))


def unit_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as unit rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _unit(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norms == 0.0, 1.0, norms)


class _Best:
    """The best ``k`` items so far for each query of a block."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.tie = np.full((queries, k), np.iinfo(np.int64).max)
        self.item = np.full((queries, k), -1, dtype=np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, ties: np.ndarray, items: np.ndarray) -> None:
        """``scores`` is (len(rows), n); items without a tie id (-1) do not qualify."""
        ok = ties >= 0
        if not ok.any():
            return
        scores, ties, items = scores[:, ok], ties[ok], items[ok]
        worst = self.score[rows, -1]
        if scores.shape[1] > self.k:
            cut = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k]
            worst = np.maximum(worst, cut)
        at, col = np.nonzero(scores >= worst[:, None])
        query = np.concatenate([rows[at], np.repeat(rows, self.k)])
        score = np.concatenate([scores[at, col], self.score[rows].ravel()])
        tie = np.concatenate([ties[col], self.tie[rows].ravel()])
        item = np.concatenate([items[col], self.item[rows].ravel()])
        order = np.lexsort((tie, -score, query))
        query, score, tie, item = query[order], score[order], tie[order], item[order]
        starts = np.searchsorted(query, rows)
        take = starts[:, None] + np.arange(self.k)[None, :]
        self.score[rows], self.tie[rows], self.item[rows] = score[take], tie[take], item[take]

    def batch(self, query_ids: np.ndarray, wants: np.ndarray) -> pa.RecordBatch:
        q, pos = np.nonzero(self.item >= 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(query_ids[q]), pa.array(wants[q], pa.int32()), pa.array(self.item[q, pos]),
             pa.array(self.tie[q, pos]), pa.array(self.score[q, pos])],
            names=["query_id", "want", "item_id", "tie", "score"])


def _scan(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, wants: np.ndarray, matrix: np.ndarray,
          k: int) -> pa.RecordBatch:
    best = _Best(len(query_ids), k)
    groups = [(w, np.nonzero(wants == w)[0]) for w in np.unique(wants)]
    step = max(1, SCORE_CELLS // max(len(query_ids), 1))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            vectors = unit_matrix(batch.column("vector"))
            items = batch.column("item_id").to_numpy(zero_copy_only=False)
            ties = pc.fill_null(batch.column("ties").flatten(), -1).to_numpy(zero_copy_only=False)
            ties = ties.reshape(batch.num_rows, -1)
            scores = np.round(matrix @ vectors.T, SCORE_DIGITS)
            for want, rows in groups:
                best.add(rows, scores[rows], ties[:, want], items)
    return best.batch(query_ids, wants)


def top_k(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar items of every query.

    ``queries`` is (query_id, want, vector): ``want`` picks which entry of an
    item's ``ties`` applies.  ``items`` is (item_id, vector, ties): a null entry
    excludes the item for that want, and equal scores go to the smaller entry.
    Each task keeps only its best ``k`` per query; the vectors are scanned in
    place and never shuffled.  Queries are sent to the tasks in blocks, bounded by
    their vectors and by the best items that a task holds for them, and the vectors
    are scanned once per block.
    """
    spark = queries.sparkSession
    q = queries.select("query_id", F.col("want").cast("int").alias("want"), "vector")
    items = items.select("item_id", "vector", "ties")
    count, size = q.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if count == 0:
        hits = spark.createDataFrame([], HIT_SCHEMA)
    else:
        bound = min(BROADCAST_BYTES // (8 * max(size, 1)), STATE_BYTES // (24 * k))
        n_blocks = math.ceil(count / max(1, bound))
        block = F.pmod(F.xxhash64("query_id", "want"), F.lit(n_blocks))
        hits = None
        for number in range(n_blocks):
            part = _block_hits(q.where(block == number), items, k)
            hits = part if hits is None else hits.unionByName(part)
    return top_per_key(hits, ["query_id", "want"], [F.desc("score"), F.col("tie")], k, rank="rank")


def _block_hits(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Every task's best items for a block of queries small enough to be sent to it."""
    table = pa.Table.from_pandas(queries.toPandas(), preserve_index=False)
    if table.num_rows == 0:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    shared = queries.sparkSession.sparkContext.broadcast(
        (table.column("query_id").to_numpy(), table.column("want").to_numpy(), unit_matrix(table.column("vector"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wants, matrix = shared.value
        yield _scan(batches, ids, wants, matrix, k)

    return items.mapInArrow(scan, HIT_SCHEMA)


# ---- similarity join ---------------------------------------------------------------------------

PAIR_SCHEMA = "left_id bigint, right_id bigint, score double"


SHELL_DEGREES = 10.0
SHELLS = 19
# Neighbouring cells share a group of about so many vectors, and a vector visits a group once.  Where a vector has
# to visit more groups than this, the groups grow until they fill a block.
GROUP_ROWS = 2048
VISITS = 8
# A bundle and the threshold angle together stay below this angle (radians), where few unrelated vectors reach the bundle.
BUNDLE_REACH = 1.15
BUNDLE_STRIP = 128
# One pair in so many left by the bundles, and comparing all at once is faster; pairs that a task holds; and times
# a vector's best partners that are kept before those of several pieces are put together.
DENSE = 64
HELD_PAIRS = 200_000
FOLD = 2
# Bytes of blocks that are sent to the others at a time: the driver holds them several times over.
PIECE_BYTES = 32 * 1024 * 1024
# Vectors are dealt out anew by their bundles once where a vector meets twice so many others, twice where it meets four times as many.
REGROUP_ROWS = 400_000
REGROUPINGS = 3


def spread_points(vectors: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before it."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        far = int(nearest.argmin())
        if nearest[far] > 1.0 - 1e-9:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, vectors @ vectors[far])
    return vectors[chosen]


def _reaches(vectors: np.ndarray, points: np.ndarray, gaps: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray,
             limits: np.ndarray, theta: float) -> np.ndarray:
    """Which cells may hold a vector within ``theta`` of each of ``vectors``.

    ``limits`` says per pair of points how far behind the plane half-way between them a vector may lie.
    """
    pivot = cells // SHELLS
    dots = vectors @ points.T
    home = dots.argmax(axis=1)
    angle = np.arccos(np.clip(dots, -1.0, 1.0))[:, pivot]
    behind = (dots[np.arange(len(home)), home][:, None] - dots) / gaps[home]
    reaches = (angle >= low - theta - 1e-9) & (angle <= high + theta + 1e-9)
    return reaches & ((behind <= limits[home] + 1e-9)[:, pivot] | (home[:, None] == pivot[None, :]))


def cell_groups(sizes: np.ndarray, reaches: np.ndarray, group_rows: int, block_rows: int) -> np.ndarray:
    """A group number per cell.  ``sizes`` are the cells' vectors, ``reaches`` the cells that sampled vectors visit.

    Groups hold about ``group_rows`` vectors, doubled while a sampled vector visits more than ``VISITS`` of them
    and they are smaller than a block.
    """
    before = np.cumsum(sizes) - sizes
    while True:
        group = np.unique(before // group_rows, return_inverse=True)[1]
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        if group_rows >= block_rows or np.logical_or.reduceat(reaches, starts, axis=1).sum(axis=1).mean() <= VISITS:
            return group
        group_rows = min(2 * group_rows, block_rows)


def _pair_scores(left: np.ndarray, row: np.ndarray, right: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded scores of chosen pairs, some at a time."""
    value, some = np.empty(len(row)), max(1, SCORE_CELLS // (8 * max(left.shape[1], 1)))
    for at in range(0, len(row), some):
        part = slice(at, at + some)
        value[part] = np.einsum("ij,ij->i", _unit(left[row[part]]), _unit(right[col[part]]))
    return np.round(value, SCORE_DIGITS)


def _first_partners(row: np.ndarray, right_ids: np.ndarray, value: np.ndarray,
                    keep: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``keep`` partners of each row, ties by the smaller id; all without ``keep``."""
    if keep is None:
        return row, right_ids, value
    order = np.lexsort((right_ids, -value, row))
    row, right_ids, value = row[order], right_ids[order], value[order]
    near = np.arange(len(row)) - np.searchsorted(row, row, side="left") < keep
    return row[near], right_ids[near], value[near]


def _set(flags: np.ndarray) -> np.ndarray:
    """Places of the few flags that are set: eight at a time are looked at first."""
    flat = flags.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def bundles(unit: np.ndarray, widest: float) -> np.ndarray:
    """A bundle per row of ``unit``, named by one of its rows: rows within about ``widest`` of their common direction.

    Any choice is right, because a bundle's width is measured where it is used.
    """
    label = np.arange(len(unit))
    if widest <= 0.0:
        return label
    near, within = np.float32(math.cos(1.4 * widest)), math.cos(widest)
    left, rest, free, at, strip = label.copy(), unit, np.ones(len(unit), dtype=bool), 0, 16
    while at < len(left):
        if free[at:].mean() < 0.7:
            left, at = left[at:][free[at:]], 0
            rest, free = unit[left], np.ones(len(left), dtype=bool)
        rows = at + np.flatnonzero(free[at:at + strip])
        row, col = np.divmod(_set(rest[rows] @ rest[at:].T >= near), len(left) - at)
        cuts = np.searchsorted(row, np.arange(len(rows) + 1))
        for i, own in enumerate(rows):
            if free[own]:
                some = at + col[cuts[i]:cuts[i + 1]]
                some = some[free[some]]
                if len(some) > 1:
                    centre = rest[some].sum(axis=0)
                    some = some[rest[some] @ centre >= within * math.sqrt(centre @ centre)]
                    if own in some:
                        label[left[some]] = left[own]
                        free[some] = False
                free[own] = False
        at, strip = at + strip, min(2 * strip, BUNDLE_STRIP)
    return label


def _lengths(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    return np.where(norms == 0.0, 1.0, norms)


def _margin(dims: int) -> float:
    """What single precision may be off."""
    return (dims + 64) * 2.0 ** -23


def _centres(unit: np.ndarray, starts: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """The directions of the bundles that begin at ``starts``, and the least score with them of a vector within ``theta`` of a member."""
    centres = _unit(np.add.reduceat(unit, starts, axis=0))
    of_rows = np.repeat(centres, np.diff(starts, append=len(unit)), axis=0)
    radius = np.arccos(np.clip(np.minimum.reduceat(np.einsum("ij,ij->i", unit, of_rows), starts), -1.0, 1.0))
    least = np.cos(np.minimum(theta + radius, math.pi)) - _margin(unit.shape[1])
    return centres.astype(np.float32), least.astype(np.float32)


def _tiles(rows: np.ndarray, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(at, np.ascontiguousarray(rows[at:at + TILE[1]]).T, least[at:at + TILE[1]]) for at in range(0, len(rows), TILE[1])]


def _hits(strip: np.ndarray, tiles: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the strip and columns of the tiles whose scores reach the columns' bounds."""
    scores, flags = np.empty(0, dtype=np.float32), np.empty(0, dtype=bool)
    for at, tile, least in tiles:
        if scores.shape != (len(strip), tile.shape[1]):
            scores, flags = np.empty((len(strip), tile.shape[1]), dtype=np.float32), np.empty((len(strip), tile.shape[1]), dtype=bool)
        hit = _set(np.greater_equal(np.matmul(strip, tile, out=scores), least, out=flags))
        if len(hit):
            row, col = np.divmod(hit, tile.shape[1])
            yield row, at + col


def _members(strip: np.ndarray, tiles: list[tuple[int, np.ndarray, np.ndarray]], starts: np.ndarray, sizes: np.ndarray,
             most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of the strip with the members of each bundle that they reach; None if these are more than ``most`` pairs."""
    found, total = [], 0
    for row, bundle in _hits(strip, tiles):
        total += int(sizes[bundle].sum())
        if total > most:
            return None
        found.append((row, bundle))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    row, bundle = map(np.concatenate, zip(*found))
    n = sizes[bundle]
    return np.repeat(row, n), np.arange(total) + np.repeat(starts[bundle] - (np.cumsum(n) - n), n)


def _worth(row: np.ndarray, col: np.ndarray, score: np.ndarray, worst: np.ndarray, keep: int, margin: float, both: bool) -> np.ndarray:
    """Which pairs may be among the best ``keep`` of either side, by scores that are ``margin`` off at most.

    ``worst`` has the least of the best scores that each column's vector has already.
    """
    worth = score >= worst[col] - margin
    if both:
        order = np.lexsort((-score, row))
        place = np.arange(len(row)) - np.searchsorted(row[order], row[order], side="left")
        last = order[place == keep - 1]
        least = np.full(row.max() + 1, -np.inf)
        least[row[last]] = score[last]
        worth |= score >= least[row] - margin
    return worth


def _near_pairs(ids_a: np.ndarray, va: np.ndarray, starts: np.ndarray, centres: np.ndarray, least: np.ndarray, ids_b: np.ndarray,
                vb: np.ndarray, fb: np.ndarray, threshold: float, keep: int | None, both: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks at or above ``threshold``, each in both orders if ``both``.

    The first block lies in bundles that begin at ``starts``, with their ``centres`` and bounds.  The triangle inequality tells
    which bundles a vector of the second block reaches, so the others are passed over whole.  Single precision (``fb`` are the
    second block's unit vectors) tells who of the rest may reach the threshold; only those are scored.
    """
    margin = _margin(va.shape[1])
    maybe = np.float32(threshold - margin)
    sizes, lengths = np.diff(starts, append=len(va)), _lengths(va)
    tiles, whole = _tiles(centres, least), None
    some = max(1, SCORE_CELLS // (8 * max(va.shape[1], 1)))
    worst = np.full(len(va), -np.inf)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle() -> Iterator[pa.RecordBatch]:
        """The pairs held so far, cut to the best of each vector."""
        if held:
            a, b, value = map(np.concatenate, zip(*held))
            held.clear()
            left, right, best = _first_partners(a, ids_b[b], value, keep)
            if keep is not None:
                full = np.flatnonzero(left[keep - 1:] == left[:len(left) - keep + 1]) + keep - 1
                worst[left[full]] = np.maximum(worst[left[full]], best[full])
            left = ids_a[left]
            if both:
                left, right, best = (np.concatenate(x) for x in zip((left, right, best), _first_partners(ids_b[b], ids_a[a], value, keep)))
            if len(left):
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.array(best)], names=["left_id", "right_id", "score"])

    for start in range(0, len(fb), TILE[0]):
        strip = fb[start:start + TILE[0]]
        pairs = _members(strip, tiles, starts, sizes, len(strip) * len(va) // DENSE) if len(starts) < len(va) else None
        if pairs is None:
            whole = whole or _tiles((va / lengths[:, None]).astype(np.float32), np.full(len(va), maybe))
        for row, col in _hits(strip, whole) if pairs is None else [pairs]:
            score = np.empty(len(row), dtype=np.float32)
            for at in range(0, len(row), some):
                r, c = row[at:at + some], col[at:at + some]
                score[at:at + some] = np.einsum("ij,ij->i", strip[r], (va[c] / lengths[c, None]).astype(np.float32))
            near = score >= maybe
            row, col, score = row[near], col[near], score[near]
            if keep is not None and len(row) > 4 * keep * len(strip):
                worth = _worth(row, col, score, worst, keep, 2 * margin, both)
                row, col = row[worth], col[worth]
            value = _pair_scores(va, col, vb, start + row)
            close = value >= threshold
            if close.any():
                held.append((col[close], start + row[close], value[close]))
            if sum(len(x[0]) for x in held) > HELD_PAIRS:
                yield from settle()
    yield from settle()


def _threshold_angle(threshold: float) -> float:
    """With a margin that keeps rounding from dropping a pair that lies on the limit."""
    return min(math.acos(max(-1.0, min(1.0, threshold))) + 1e-6, math.pi / 2)


class _Cells:
    """Cells of vectors placed about ``points``, in groups."""

    def __init__(self, homes: DataFrame, points: np.ndarray, sampled: np.ndarray, theta: float, group_rows: int, block_rows: int):
        # At most pivots x shells rows.
        cells = (homes.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("slack").alias("slack"),
                                           F.count("*").alias("n")).orderBy("cell").toPandas())
        self.points, self.cells, self.sizes = points, cells["cell"].to_numpy(np.int32), cells["n"].to_numpy()
        self.gaps = _gaps(points)
        slack = np.zeros(len(points))
        np.maximum.at(slack, self.cells // SHELLS, cells["slack"].to_numpy())
        limits = np.sin(np.minimum(theta + np.arcsin(np.minimum(1.0, slack / self.gaps)), math.pi / 2))
        self.known = (points, self.gaps, self.cells, cells["low"].to_numpy(), cells["high"].to_numpy(), limits, theta)
        reaches = np.concatenate([_reaches(sampled[at:at + 512], *self.known) for at in range(0, len(sampled), 512)])
        self.group = cell_groups(self.sizes, reaches, group_rows, block_rows)
        self.starts = np.flatnonzero(np.diff(self.group, prepend=-1))
        self.rows = np.add.reduceat(self.sizes, self.starts).tolist()
        visited = np.logical_or.reduceat(reaches, self.starts, axis=1)
        self.visits = visited.sum(axis=1).mean()
        #: Vectors that a vector is compared with.
        self.met = (visited * np.array(self.rows)).sum(axis=1).mean()
        # A group a little larger than a block stays whole: a cut parts bundles.
        self.blocks = [max(1, math.ceil(n / (1.5 * block_rows))) for n in self.rows]
        self.first_block = np.cumsum([0, *self.blocks]).tolist()

    def dealt(self, homes: DataFrame) -> DataFrame:
        """The vectors with their group as ``cell`` and the ``number`` of their block; bundles stay together."""
        spark = homes.sparkSession
        sizes = spark.createDataFrame(list(zip(range(len(self.rows)), self.blocks, self.first_block)), "cell int, blocks int, first int")
        groups = spark.createDataFrame(list(zip(self.cells.tolist(), self.group.tolist())), "home_cell int, cell int")
        number = (F.col("first") + F.pmod(F.xxhash64("bundle"), F.col("blocks"))).cast("int").alias("number")
        return (homes.withColumnRenamed("cell", "home_cell").join(F.broadcast(groups.join(sizes, "cell")), "home_cell")
                .select(number, "cell", "vec_id", "vector"))


def _gaps(points: np.ndarray) -> np.ndarray:
    gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * points @ points.T))
    np.fill_diagonal(gaps, 1.0)
    return gaps


PLACED = "vec_id bigint, vector array<float>, bundle bigint, cell int, angle double, slack double"


def _placed(ids: np.ndarray, vectors: pa.Array, unit: np.ndarray, bundle: np.ndarray, directions: np.ndarray,
            points: np.ndarray) -> pa.RecordBatch:
    """Vectors in the cells of their ``directions``, with their own angles, and how much nearer another point may be."""
    dots = directions @ points.T
    home = dots.argmax(axis=1)
    angle = np.arccos(np.clip(dots[np.arange(len(home)), home], -1.0, 1.0))
    shell = np.minimum(np.degrees(angle) // SHELL_DEGREES, SHELLS - 1).astype(np.int32)
    if directions is not unit:
        dots = unit @ points.T
        angle = np.arccos(np.clip(dots[np.arange(len(home)), home], -1.0, 1.0))
    slack = dots.max(axis=1) - dots[np.arange(len(home)), home]
    return pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(bundle), pa.array(home.astype(np.int32) * SHELLS + shell),
                                       pa.array(angle), pa.array(slack)], names=[c.split()[0] for c in PLACED.split(", ")])


def similar_vectors(vectors: DataFrame, threshold: float, pivots: int = 256, sample: int = 4096,
                    block_rows: int = BLOCK_ROWS, keep: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Ordered pairs (left_id, right_id, score) of distinct vectors at or above ``threshold``.

    ``vectors`` is (vec_id, vector).  Exact partitioning by pivots: a vector's home
    is the cell of its nearest pivot and of its angle to that pivot.  Another vector
    visits a cell unless the triangle inequality proves that no vector there is
    within the threshold angle: its angle to the pivot is too far from the angles in
    the cell, or it lies too far behind the plane half-way to its own pivot.  Small cells are put
    together in groups, so that a vector is sent to a group once and not to each of its
    cells; groups are cut into blocks of bounded size, so a crowded cell becomes many
    tasks.  A sample tells how many groups a vector visits; without clusters to tell apart
    groups are as large as a block.  Blocks are stored once; a bounded piece of them at a time
    is sent to the others, so what is written grows with the vectors, whatever the pairs.
    Two blocks meet once, and give their pairs in both orders.
    Inside a block, vectors of one direction form bundles: a visitor is compared with bundles, and with the members of
    those that the same inequality leaves.  Copies with noise often have different nearest pivots; where a vector meets very
    many others, the vectors are dealt out again by the directions of their bundles, which then find their other parts.
    With ``keep``, each pair of blocks reports only a vector's best ``keep`` partners (ties by the smaller id).
    """
    spark = vectors.sparkSession
    vectors = cut_lineage(vectors.select("vec_id", "vector"))
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if chosen.empty:
        return spark.createDataFrame([], PAIR_SCHEMA)
    sampled = unit_matrix(pa.Table.from_pandas(chosen, preserve_index=False).column("vector"))
    points = spread_points(sampled, pivots)
    block_rows = rows_per_block(points.shape[1], block_rows)
    theta = _threshold_angle(threshold)
    widest = min(0.9 * theta, BUNDLE_REACH - theta)
    shared = spark.sparkContext.broadcast(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit, ids = unit_matrix(batch.column("vector")), batch.column("vec_id").to_numpy(zero_copy_only=False)
                yield _placed(ids, batch.column("vector"), unit, ids, unit, shared.value)

    homes = cut_lineage(vectors.mapInArrow(place, PLACED))
    n_vectors = homes.count()
    # Enough blocks to occupy all cores.
    block_rows = min(block_rows, max(group_rows, math.ceil(n_vectors / (2 * spark.sparkContext.defaultParallelism))))
    cells = _Cells(homes, points, sampled, theta, group_rows, block_rows)
    for turn in range(min(REGROUPINGS, int(math.log2(max(1.0, cells.met / REGROUP_ROWS)))) if cells.visits > VISITS and widest > 0 else 0):
        # Other pivots each time: parts of a bundle that these keep apart may be together there.
        points = spread_points(np.roll(sampled, -(turn + 1) * len(sampled) // (REGROUPINGS + 1), axis=0), pivots)
        homes = cut_lineage(cells.dealt(homes).groupBy("number").applyInArrow(_regroup(points, widest), PLACED))
        cells = _Cells(homes, points, sampled, theta, group_rows, block_rows)
    known, firsts = spark.sparkContext.broadcast(cells.known), cells.starts
    packed = "number int, cell int, ids binary, vectors binary, starts binary, centres binary, least binary, reach array<int>, goes binary"

    def pack(block: pa.Table) -> pa.Table:
        """A block as one row, bundle by bundle, with the groups that its vectors visit: a bit per group and vector."""
        unit = unit_matrix(block.column("vector"))
        label = bundles(unit.astype(np.float32), widest)
        order = np.argsort(label, kind="stable")
        unit, label = unit[order], label[order]
        goes = np.empty((len(firsts), len(unit)), dtype=bool)
        for start in range(0, len(unit), 512):
            reaches = _reaches(unit[start:start + 512], *known.value)
            goes[:, start:start + 512] = np.logical_or.reduceat(reaches, firsts, axis=1).T
        flat = block.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        starts = np.flatnonzero(np.diff(label, prepend=-1)).astype(np.int64)
        centres, least = _centres(unit, starts, theta)
        return pa.table({
            "number": block.column("number")[:1], "cell": block.column("cell")[:1],
            "ids": pa.array([block.column("vec_id").to_numpy().astype(np.int64)[order].tobytes()], pa.binary()),
            "vectors": pa.array([flat.reshape(len(order), -1)[order].tobytes()], pa.binary()),
            "starts": pa.array([starts.tobytes()], pa.binary()), "centres": pa.array([centres.tobytes()], pa.binary()),
            "least": pa.array([least.tobytes()], pa.binary()),
            "reach": pa.array([np.flatnonzero(goes.any(axis=1)).tolist()], pa.list_(pa.int32())),
            "goes": pa.array([np.packbits(goes, axis=1).tobytes()], pa.binary())})

    n_blocks = cells.first_block[-1]
    blocks = cut_lineage(cells.dealt(homes).groupBy("number").applyInArrow(pack, packed).repartitionById(n_blocks, F.col("number")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_groups, last, unit_b = len(firsts), None, np.empty(0)
        for batch in batches:
            for at in range(batch.num_rows):
                cell, number, other, *packs = (batch.column(n)[at] for n in range(batch.num_columns))
                ids_a, flat_a, starts, centres, least, ids_b, flat_b, goes = (np.frombuffer(p.as_buffer(), kind) for p, kind in zip(
                    packs, (np.int64, np.float32, np.int64, np.float32, np.float32, np.int64, np.float32, np.uint8)))
                visitors = np.flatnonzero(np.unpackbits(goes.reshape(n_groups, -1)[cell.as_py()], count=len(ids_b)))
                if len(visitors):
                    flat_a, flat_b = flat_a.reshape(len(ids_a), -1), flat_b.reshape(len(ids_b), -1)
                    if other.as_py() != last:
                        last, unit_b = other.as_py(), (flat_b / _lengths(flat_b)[:, None]).astype(np.float32)
                    whole = len(visitors) == len(ids_b)
                    yield from _near_pairs(ids_a, flat_a, starts, centres.reshape(len(starts), -1), least,
                                           *(x if whole else x[visitors] for x in (ids_b, flat_b, unit_b)), threshold, keep, number.as_py() != last)

    # Homes are sent to the blocks that visit them, a bounded piece at a time, and no block is copied to disk.
    sent = blocks.select("number", "cell", sum(F.length(c) for c in ("ids", "vectors", "starts", "centres", "least")).alias("bytes")).orderBy("number").collect()
    pieces, room = [], 0
    for block in sent:
        if not pieces or block.bytes > room:
            pieces.append([])
            room = min(PIECE_BYTES, BROADCAST_BYTES)
        pieces[-1].append(block)
        room -= block.bytes
    # Of two blocks one visits the other: the one that follows within half a round, so all blocks have as many to visit.
    ahead = F.pmod(F.col("other_number") - F.col("number"), F.lit(n_blocks)) * 2
    visits = (ahead < n_blocks) | ((ahead == n_blocks) & (F.col("number") < F.col("other_number")))
    best = (lambda pairs: pairs) if keep is None else lambda pairs: top_per_key(pairs, ["left_id"], [F.desc("score"), F.col("right_id")], keep)
    found: list[DataFrame] = []
    n_found = 0
    for piece in pieces:
        low_block, high_block, low_cell, high_cell = piece[0].number, piece[-1].number, piece[0].cell, piece[-1].cell
        left = blocks.where(F.col("number").between(low_block, high_block)).select("number", "cell", "ids", "vectors", "starts", "centres", "least")
        # Blocks that visit none of the piece go before their rows are copied.
        late = F.pmod(F.col("number") - low_block, F.lit(n_blocks)) * 2 <= n_blocks + 2 * (high_block - low_block)
        right = blocks.where(late).select(F.explode(F.filter("reach", lambda g: g.between(low_cell, high_cell))).alias("cell"),  # noqa: B023
                              F.col("number").alias("other_number"), F.col("ids").alias("other_ids"), F.col("vectors").alias("others"), "goes")
        both = (right.join(F.broadcast(left), "cell").where(visits)
                .select("cell", "number", "other_number", "ids", "vectors", "starts", "centres", "least", "other_ids", "others", "goes"))
        pairs = best(both.mapInArrow(meet, PAIR_SCHEMA))
        if len(pieces) == 1:
            return pairs
        found.append(cut_lineage(pairs))
        # What was sent stays in the memory of the driver and the executors until the driver collects its garbage.
        del left, right, both, pairs
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        # A vector has its best partners of each piece until they are put together.
        n_found += found[-1].count() if keep is not None else 0
        if keep is not None and n_found > FOLD * keep * n_vectors:
            found = [cut_lineage(best(reduce(DataFrame.unionByName, found)))]
            n_found = found[0].count()
    return best(reduce(DataFrame.unionByName, found))


def _regroup(points: np.ndarray, widest: float) -> Callable[[pa.Table], pa.Table]:
    """Places the vectors of a block about other ``points``, by the directions of their bundles."""
    def regroup(block: pa.Table) -> pa.Table:
        vectors, ids = block.column("vector").combine_chunks(), block.column("vec_id").to_numpy()
        unit = unit_matrix(vectors)
        label = bundles(unit.astype(np.float32), widest)
        sums = np.zeros_like(unit)
        np.add.at(sums, label, unit)
        return pa.Table.from_batches([_placed(ids, vectors, unit, ids[label], _unit(sums)[label], points)])

    return regroup


# Functions of this module travel to the workers whole, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

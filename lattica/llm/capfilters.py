"""Near-duplicate embeddings by spherical-cap filters of structured random product codes.

A filter is a direction; a vector belongs to it if their cosine exceeds a height. Directions are all combinations of one
code vector from each of a few blocks of coordinates, so the filters that a vector exceeds are list-decoded from the
blocks' few inner products, without looking at the many directions. Filters of one code aren't independent, so there are
several codes, each after a random turn of its own: codes are added until enough of the pairs at the threshold that are
drawn for the purpose share a filter. That is measured anew for each number and length of vectors, so recall doesn't
depend on size.

Vectors that share a filter are compared twice. The first time each is a byte a component, which tells all pairs that
can't reach the threshold; the second time only those that have a partner left are compared, in double precision. A pair
counts in the least filter that both share, so once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, map_groups, small_batches, staged
from lattica.llm.topk import matrix, vectors
from lattica.plans.components import components
from lattica.plans.cut import discard

#: Vectors in a filter and filters of one code that a pair at the threshold shares, in expectation; rows of a side of a tile.
FILLED, SHARED, TILE = 256, 0.7, 512
#: Share of pairs at the threshold that must share a filter, pairs that it is measured on, and codes until caps are lowered.
RECALL, PAIRS, CODES = 0.99, 4000, 64
#: Code vectors of a block beyond which there are more blocks.
WIDEST = 4096
SEED = 20_240_601
_GRID = 100_001


def _sphere(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Angles from 0 to pi, and the share of the unit sphere within each of any direction; dim > 1."""
    angle = np.linspace(0, math.pi, _GRID)
    density = np.exp((dim - 2) * np.log(np.maximum(np.sin(angle), 1e-300)))
    share = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return angle, share / share[-1]


def share_above(height: np.ndarray | float, dim: int) -> np.ndarray:
    """Share of the unit sphere whose cosine with any direction is `height` or more."""
    height = np.asarray(height, float)
    if dim == 1:
        return np.where(height > 1, 0.0, np.where(height > -1, 0.5, 1.0))
    angle, share = _sphere(dim)
    return np.where(height > 1, 0.0, np.interp(np.arccos(np.clip(height, -1, 1)), angle, share))


class Filters:
    """The product codes for n vectors of a length.

    With more vectors the caps get higher and more, so they stay as full; but no cap is smaller than the cap of all
    vectors that are near one, as that many are to be found anyway.
    """

    def __init__(self, n: int, dim: int, threshold: float, filled: int = FILLED, shared: float = SHARED, recall: float = RECALL) -> None:
        self.dim, self.codes = dim, []
        rng = np.random.default_rng([SEED, dim])
        x, y = rng.standard_normal((2, PAIRS, dim))
        x = unit_vectors(x)
        y -= (x * y).sum(1, keepdims=True) * x
        y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * (unit_vectors(y) if dim > 1 else np.zeros_like(x))
        share = min(0.25, max(filled / max(n, 1), float(share_above(threshold, dim))))
        while True:
            self.height, both = self._cap(share, dim, threshold)
            wanted = shared / (share * max(both, 1e-3))
            blocks = max(1, min(dim // 2, math.ceil(math.log(max(wanted, 2)) / math.log(WIDEST)), 4), min(2, dim // 2))
            self.size = max(2, math.ceil(wanted ** (1 / blocks)))
            self.cuts = np.linspace(0, dim, blocks + 1).astype(int)
            self.each = self.size**blocks  # filters of a code
            self.codes, found = [], np.zeros(PAIRS, bool)
            while len(self.codes) < CODES and found.mean() < recall:
                turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
                parts = [unit_vectors(rng.standard_normal((self.size, b - a))) * math.sqrt((b - a) / dim) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
                self.codes.append((turn, parts))
                (i, f), (j, g) = (self._of_code(len(self.codes) - 1, side) for side in (x, y))
                found[np.intersect1d(i * self.each + f, j * self.each + g) // self.each] = True
            self.recall = float(found.mean())
            if self.recall >= recall:
                return
            share *= 4  # lower caps; with share 1 or more all vectors are in each

    @staticmethod
    def _cap(share: float, dim: int, threshold: float) -> tuple[float, float]:
        """Height of the cap with that share, and the chance that a vector at the threshold of one in it is in it too."""
        if share >= 1:
            return -2.0, 1.0
        if dim == 1:
            return 0.0, 1.0
        angle, within = _sphere(dim)
        k = int(np.searchsorted(within, share))
        height = math.cos(angle[k])
        at, weight = angle[1 : k + 1], np.diff(within[: k + 1])
        across = math.sqrt(max(1e-12, 1 - threshold**2)) * np.sin(at)
        return height, float((share_above((height - threshold * np.cos(at)) / across, dim - 1) * weight).sum() / weight.sum())

    def _of_code(self, code: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter of a code that a unit vector exceeds.

        Block by block; partial sums that can't reach the height any more, whatever the blocks to come add, are left out.
        """
        turn, parts = self.codes[code]
        turned = unit @ turn
        dots = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], parts, strict=True)]
        rest = [np.zeros(len(unit))]
        for d in dots[:0:-1]:
            rest.append(rest[-1] + d.max(1))
        row, at, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for d, more in zip(dots, rest[::-1], strict=True):
            i, x = np.nonzero(total[:, None] + d[row] >= self.height - more[row][:, None])
            total = total[i] + d[row[i], x]
            row, at = row[i], at[i] * d.shape[1] + x
        return row, at

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Of each unit vector the numbers of the filters that it exceeds, ascending."""
        found = [(row, at + c * self.each) for c in range(len(self.codes)) for row, at in [self._of_code(c, unit)]]
        row, at = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, row))
        return np.split(at[order], np.searchsorted(row[order], np.arange(1, len(unit))))


def unit_vectors(v: np.ndarray) -> np.ndarray:
    scaled = v / np.exp2(np.floor(np.log2(np.abs(v).max(1, keepdims=True))))  # a power of two: exact, and squares can't overflow
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of the threshold or more, in double precision."""
    a, b = (x / np.exp2(np.floor(np.log2(np.abs(x).max(1, keepdims=True)))) for x in (a, b))
    return (a @ b.T) / np.sqrt(np.outer((a * a).sum(1), (b * b).sum(1))) >= threshold


def sketches(unit: np.ndarray) -> list[bytes]:
    """Each unit vector as one byte a component, after the size of a step (float32)."""
    step = (np.abs(unit).max(1) / 127).astype("<f4")
    q = np.rint(unit / step[:, None].astype(float)).clip(-127, 127).astype(np.int8)
    return [s.tobytes() + r.tobytes() for s, r in zip(step, q, strict=True)]


def maybe_near(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold, by their sketches: all that do, and few others.

    A sketch is off by half a step a component, so by e = step * sqrt(dim) / 2 at most (a little more for rounding), and
    the inner product of two by e + f + e f.
    """
    sides = []
    for x in (a, b):
        raw = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        step = np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0].astype(float)
        q = np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32)
        sides.append((q, step, step * (math.sqrt(q.shape[1]) * 0.5001)))
    (q, s, e), (r, t, f) = sides
    return (q @ r.T) * np.outer(s, t) >= threshold - 1e-6 - (e[:, None] + f + np.outer(e, f))


def spanning(ok: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect what the links ok (rows a, columns b) connect."""
    x, y = np.nonzero(ok)
    if len(x) <= len(a) + len(b):
        return a[x], b[y]
    top = np.iinfo(np.int64).max
    la = np.where(ok.any(1), a, top)
    lb = np.where(ok.any(0), b, top)
    while True:
        na = np.minimum(la, np.where(ok, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(ok, na[:, None], top).min(0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    use_a, use_b = ok.any(1), ok.any(0)
    return np.concatenate([a[use_a], b[use_b]]), np.concatenate([la[use_a], lb[use_b]])


def _in_tiles(rows: DataFrame, tile: int) -> DataFrame:
    """Rows of (dim, f, rep, ...) dealt to tiles (dim, f, low, high): two parts of a filter, or one with itself.

    part tells a row's own part. Filters of up to a tile's rows have one part, and only the others are counted out.
    """
    full = staged(rows.groupBy("dim", "f").agg(F.count("*").alias("size")).where(F.col("size") > tile).select("dim", "f", F.ceil(F.col("size") / tile).cast("int").alias("parts")))
    dealt = rows.join(full, ["dim", "f"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("parts", "other")


def _sides(t: pa.Table) -> tuple[bool, pa.Table, pa.Table]:
    """Whether a tile is of one part, and its two sides."""
    low, high = t["low"][0].as_py(), t["high"][0].as_py()
    if low == high:
        return True, t, t
    part = t["part"].to_numpy()
    return False, t.filter(pa.array(part == low)), t.filter(pa.array(part == high))


def _usable(id_col: str, vector_col: str) -> Column:
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.exists(vector_col, lambda x: x != 0) & ~F.coalesce(bad, F.lit(False))


def near_embeddings(table: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", filled: int = FILLED, shared: float = SHARED, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of table.

    Two vectors of the same length link if their cosine, in double precision, reaches the threshold; of pairs right at it
    about one in a hundred shares no filter and isn't found, of nearer ones fewer. n_links counts the other rows linked
    directly, component_id is the smallest id reachable, itself included, and kept says that this is the row's own. Rows
    that are null, of zeros only, or hold null or non-finite components link with nothing and are their own component; so
    do rows with a null id, whose component is null and which are kept. Repeated rows are rows each, and link with one
    another; rows that share an id but not the vector are nodes each, and the id alone links nothing.

    Equal vectors are joined first and stand as one from there, with their number. What is shuffled by filter is ids and
    sketches of a byte a component; whole vectors are shuffled only for those that may have a partner. Of linked pairs in
    a filter only sums and few connecting links leave a tile. A filter with many vectors is dealt to tiles of bounded
    size by a hash; its pairs are compared tile by tile, which no cap cuts short. Only counts by length and the codes,
    whose size is that of the square root of the number of vectors, reach the driver.
    """
    small_batches(table.sparkSession)
    given = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    marked = given.withColumn("ok", _usable("id", "v"))
    whole = staged(marked.select("id", "ok", F.when(F.col("ok"), F.xxhash64("v")).alias("x"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("y")))
    good = vectors(given, "id", "v").where(F.exists("v", lambda x: x != 0))
    keyed = good.select("id", "v", F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))
    folded = keyed.groupBy("x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v"))
    # A number of its own for each different vector; it is written once and only compared.
    nodes = staged(folded.select(F.monotonically_increasing_id().alias("rep"), "x", "y", "id", "n", "v", F.size("v").alias("dim")))
    count = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    codes = {d: Filters(n, d, threshold, filled, shared) for d, n in count.items()}

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        vs = batch.column("v")
        sizes = batch.column("dim").to_numpy()
        filters: list = [None] * batch.num_rows
        sketch: list = [None] * batch.num_rows
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            unit = unit_vectors(matrix(pa.chunked_array([vs.take(pa.array(at))])))
            for i, f, s in zip(at.tolist(), codes[int(d)].decode(unit), sketches(unit), strict=True):
                filters[i], sketch[i] = f, s
        return pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("dim"), pa.array(filters, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
            names=["rep", "dim", "filters", "sketch"],
        )

    coded = staged(map_batches(nodes.select("rep", "dim", "v"), decode, "rep long, dim int, filters array<long>, sketch binary", 2048))
    rows = coded.select("rep", "dim", F.explode("filters").alias("f"), "sketch")

    def look(t: pa.Table) -> pa.RecordBatch | None:
        same, left, right = _sides(t)
        if len(left) == 0 or len(right) == 0 or (same and len(left) == 1):
            return None
        ok = maybe_near(left["sketch"].to_pylist(), right["sketch"].to_pylist(), threshold)
        if same:
            np.fill_diagonal(ok, False)
        reps = left["rep"].to_numpy()[ok.any(1)]
        if not same:
            reps = np.concatenate([reps, right["rep"].to_numpy()[ok.any(0)]])
        if not len(reps):
            return None
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(np.full(len(reps), t["f"][0].as_py()))], names=["rep", "f"])

    alive = staged(map_groups(_in_tiles(rows, tile), ["dim", "f", "low", "high"], look, "rep long, f long").distinct())
    full = nodes.select("rep", "dim", "n", "v").join(coded.select("rep", "filters"), "rep").join(alive, "rep")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        same, left, right = _sides(t)
        if not len(left) or not len(right):
            return None
        f = t["f"][0].as_py()
        ok = near(matrix(left["v"]), matrix(right["v"]), threshold)
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        ok &= (a[:, None] < b) if same else (a[:, None] != b)
        if not ok.any():
            return None
        sets = [[np.array([x for x in r if x < f], np.int64) for r in side["filters"].to_pylist()] for side in (left, right)]
        rows_on, columns_on = ok.any(1), ok.any(0)
        known = np.unique(np.concatenate([x for side, on in zip(sets, (rows_on, columns_on), strict=True) for x, o in zip(side, on, strict=True) if o]))
        first = ok
        if len(known):
            has = [np.zeros((len(side), len(known)), np.float32) for side in sets]
            for side, h, on in zip(sets, has, (rows_on, columns_on), strict=True):
                for i in np.flatnonzero(on):
                    h[i, np.searchsorted(known, side[i])] = 1
            first = ok & ~((has[0] @ has[1].T) > 0)
        na, nb = left["n"].to_numpy(), right["n"].to_numpy()
        x, y = spanning(ok, a, b)
        ids = np.concatenate([a, b, x])
        links = np.concatenate([first @ nb, na @ first, np.zeros(len(x), np.int64)])
        to = np.concatenate([np.full(len(a) + len(b), -1, np.int64), y])
        edge = np.concatenate([np.zeros(len(a) + len(b), bool), np.ones(len(x), bool)])
        use = edge | (links > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[use]), pa.array(links[use].astype(np.int64)), pa.array(to[use]), pa.array(edge[use])], names=["rep", "links", "to", "edge"])

    found = staged(map_groups(_in_tiles(full, tile), ["dim", "f", "low", "high"], compare, "rep long, links long, to long, edge boolean"))
    links = found.where("NOT edge").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.where("edge").select(F.col("rep").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "rep")
    own = staged(nodes.select("rep", "x", "y", "id", "n").join(links, "rep", "left").join(linked, "rep", "left"))
    lowest = own.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("lowest"))
    own = own.join(lowest, "component", "left").select("x", "y", F.coalesce("lowest", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    linked = whole.where("ok").join(own, ["x", "y"]).select("id", "n_links", F.col("c").alias("component_id"), (F.col("c") == F.col("id")).alias("kept"))
    # Rows that take no part stay out of the join, where they would all have one key.
    alone = whole.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    out = linked.unionByName(alone).withColumnRenamed("id", id_col)
    discard(coded, alive, found)
    return out

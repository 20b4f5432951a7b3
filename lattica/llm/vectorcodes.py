"""Vector codes: product quantization in integers, with codebooks searched by annular norm pruning.

Vectors become integers and are cut into equal parts. Each part's codebook is improved by rounds of assigning every part to
its nearest entry and moving the entries to the floored means of theirs. Entries are sorted by norm; as |x - e| is at least
the difference of the norms, a part's nearest entry lies in the annulus whose half-width is the best distance known, and a
binary search gives its ends. Some entries around the part's own norm give the first best distance; then the whole annulus,
ends included, is compared in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import map_batches, slices, small_batches, staged
from lattica.plans.cut import discard

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers are held at plus and minus this. Where sums of distances could pass it, Python's integers are used.
MOST = 1 << 62
#: Entries around a part's norm that are tried first, components compared at once, and vectors of a slice.
PROBES, CELLS, ROWS = 16, 1 << 18, 2048


def integers(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale x) of each component, held at MOST; null for vectors that are null or hold a null, NaN or an infinity."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = F.transform(v, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x * scale))))
    return F.when(~bad, held)


class Codebook:
    """The entries of one part, sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def _distances(self, x: np.ndarray, rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.order[places]
        off = x[rows] - self.entries[at]
        return (off * off).sum(1), at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index."""
        n, k = len(x), len(self.entries)
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        tried = min(PROBES, k)
        first = np.clip(np.searchsorted(self.norms, norm) - tried // 2, 0, k - tried)
        index, least = np.zeros(n, np.int64), np.zeros(n, x.dtype)
        step = max(1, CELLS // (k * x.shape[1]))
        for a in range(0, n, step):
            own = np.arange(a, min(n, a + step))
            d, _ = self._distances(x, np.repeat(own, tried), (first[own][:, None] + np.arange(tried)).ravel())
            reach = np.sqrt(d.reshape(-1, tried).min(1).astype(float))
            slack = 1e-6 + 1e-9 * (norm[own] + reach)  # more than norms and roots can be off
            low = np.searchsorted(self.norms, norm[own] - reach - slack, "left")
            width = np.searchsorted(self.norms, norm[own] + reach + slack, "right") - low  # one at least: the best tried is within
            starts = np.cumsum(width) - width
            d, at = self._distances(x, np.repeat(own, width), np.arange(width.sum()) - np.repeat(starts - low, width))
            least[own] = np.minimum.reduceat(d, starts)
            index[own] = np.minimum.reduceat(np.where(d == np.repeat(least[own], width), at, k), starts)
        return index, least


def _parts(column: pa.Array, parts: int, width: int, kind: type) -> np.ndarray:
    """(vectors, parts, width) integers; vectors shorter than the longest are followed by zeros."""
    out = np.zeros((len(column), parts * width), np.int64)
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    inside = np.arange(parts * width) < size[:, None]
    out[inside] = flat
    return out.reshape(-1, parts, width).astype(kind)


class Codes:
    """Codebooks by part, (parts, entries, width) integers, and how to use them."""

    def __init__(self, entries: np.ndarray, scale: float = SCALE) -> None:
        self.entries, self.scale = entries, scale
        self.books = [Codebook(e) for e in entries]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for x in self.entries.ravel().tolist()).encode()).hexdigest()

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, parts) of indices and of squared distances."""
        found = [book.nearest(x[:, p]) for p, book in enumerate(self.books)]
        return np.stack([i for i, _ in found], 1), np.stack([d for _, d in found], 1)

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for, with the parts' padding."""
        return [x / self.scale for p, i in enumerate(bytes.fromhex(code)) for x in self.entries[p, i].tolist()]


def prepared(table: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, v): the rows whose vectors are whole and finite, as integers, written as a table."""
    small_batches(table.sparkSession)
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), integers(F.col(vector_col), scale).alias("v"))
    return staged(rows.where("v IS NOT NULL"), compression="zstd")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> Codes | None:
    """Codebooks of what prepared() gives, after the rounds; None if there are no rows.

    Each starts as the parts of the rows with the smallest ids, nulls last, then by vector; repeated rows count each. A
    round reads the table once. A task adds its parts up by entry, so what is shuffled, and what reaches the driver, is
    as large as the codebooks. An entry that no part is nearest to stays.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("size"), F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0))).alias("most")).first()
    if not found.n:
        return None
    width = max(1, -(-found["size"] // parts))
    wide = found.n * found.most >= MOST or 4 * parts * width * found.most**2 >= MOST
    kind = object if wide else np.int64
    start = rows.orderBy(F.asc_nulls_last("id"), "v").select("v").limit(entries).collect()
    own = _parts(pa.array([r.v for r in start], pa.list_(pa.int64())), parts, width, kind).transpose(1, 0, 2)
    codes = Codes(own, scale)
    for _ in range(rounds):
        totals = rows.select("v").mapInArrow(_adder(codes, parts, width, kind), f"part int, entry int, place int, total {'decimal(38,0)' if wide else 'long'}, n long")
        own = codes.entries.copy()
        for r in totals.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            own[r.part, r.entry, r.place] = int(r.total) // r.n
        codes = Codes(own, scale)
    return codes


def _adder(codes: Codes, parts: int, width: int, kind: type):
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = codes.entries.shape[1]
        totals, counts = np.zeros((parts, k, width), kind), np.zeros((parts, k), np.int64)
        for batch in slices(batches, ROWS):
            x = _parts(batch.column("v"), parts, width, kind)
            index, _ = codes.assign(x)
            for p in range(parts):
                order = np.argsort(index[:, p], kind="stable")
                used, starts = np.unique(index[order, p], return_index=True)
                totals[p, used] += np.add.reduceat(x[order, p], starts, axis=0)
                counts[p] += np.bincount(index[:, p], minlength=k)
        p, e = np.nonzero(counts)
        if len(p):
            total = totals[p, e].ravel()
            total = pa.array([Decimal(x) for x in total.tolist()], pa.decimal128(38, 0)) if kind is object else pa.array(total)
            of = lambda x: pa.array(np.repeat(x, width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([of(p), of(e), pa.array(np.tile(np.arange(width, dtype=np.int32), len(p))), total, pa.array(np.repeat(counts[p, e], width))], names=["part", "entry", "place", "total", "n"])

    return add


def encode(rows: DataFrame, codes: Codes) -> DataFrame:
    """(id, label, code, error) of each row of what prepared() gives; error is held at the end of 64 bits.

    Vectors longer than those that the codebooks were made of are an error.
    """
    parts, _, width = codes.entries.shape

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _parts(batch.column("v"), parts, width, codes.entries.dtype.type if codes.entries.dtype != object else object)
        index, d = codes.assign(x)
        text = index.astype(np.uint8).tobytes().hex()
        code = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
        error = np.minimum(d.sum(1), (1 << 63) - 1).astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    kind = dict(rows.dtypes)["label"]
    return map_batches(rows.select("id", "label", "v"), run, f"id long, label {kind}, code string, error long", ROWS)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codes | None]:
    """((id, code, error, label_error, codebooks_sha256) of each row whose vector is whole and finite, and the codebooks).

    code has two hexadecimal digits a part; error is the squared distance of the integers to what the code stands for, and
    label_error its sum over the rows of one label, nulls together; sums are held at the end of 64 bits. Fewer rows than
    entries give a codebook of as many entries as rows. Vectors shorter than the longest are followed by zeros, and so is
    the longest where its length is no multiple of parts. Rows with null ids take part, repeated rows count each. An empty
    table gives no rows and no codebooks.
    """
    rows = prepared(table, scale, id_col, vector_col, label_col)
    codes = train(rows, parts, entries, rounds, scale)
    if codes is None:
        none = [F.lit(None).cast(k).alias(c) for c, k in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))]
        return rows.select(F.col("id").alias(id_col), *none), None
    coded = staged(encode(rows, codes), compression="zstd")
    discard(rows)
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256")), codes


def sql() -> str:
    """What op13 gives for a table `embeddings` of vectors of one length, in DuckDB's SQL: every entry is compared, in doubles that are exact here."""
    parts = " UNION ALL ".join(f"SELECT rid, nth, {p} AS part, v[len(v) * {p} // {PARTS} + 1:len(v) * {p + 1} // {PARTS}] AS x FROM e" for p in range(PARTS))
    rounds = [f"book0 AS MATERIALIZED (SELECT part, nth AS entry, x FROM p WHERE nth < {ENTRIES})"]
    for i in range(ROUNDS + 1):
        rounds.append(
            f"near{i} AS MATERIALIZED (SELECT rid, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM "
            f"(SELECT p.rid, p.part, b.entry, (list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x))::BIGINT AS d FROM p JOIN book{i} b ON p.part = b.part) GROUP BY rid, part)"
        )
        if i < ROUNDS:
            rounds.append(
                f"book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN (SELECT part, entry, list(floor(s / n) ORDER BY place) AS x FROM "
                f"(SELECT part, entry, place, sum(c) AS s, count(*) AS n FROM (SELECT part, n.entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM near{i} n JOIN p USING (rid, part)) GROUP BY part, entry, place) GROUP BY part, entry) m USING (part, entry))"
            )
    return f"""
WITH e AS (
  SELECT row_number() OVER () AS rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS nth, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
), p AS MATERIALIZED ({parts}),
{", ".join(rounds)},
sha AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS sha FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM book{ROUNDS})),
coded AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM e JOIN coded USING (rid), sha
"""

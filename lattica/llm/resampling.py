"""Importance resampling to a target distribution, from a sparse matrix of documents by feature buckets in CSR blocks.

Features are runs of words, hashed to buckets. The counts of a slice of documents are one block: where each document's
entries begin, their buckets, their counts. Blocks are written once as a table; sums of its columns give the corpus's
distribution, the target's own blocks give the target's, and the product of the matrix with the buckets' gains gives each
document's weight. Gumbel noise from a hash of the id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import math
import string
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import arrow_schema, map_batches, slices, small_batches, staged, text_column
from lattica.plans.cut import discard
from lattica.plans.numbering import with_row_numbers

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Documents of a block at most. A scan decodes SCAN_ROWS blocks at once, so they are kept small.
BLOCK_ROWS = 32
#: Bytes of a text whose words are in memory at once; a longer word is held whole.
WINDOW = 1 << 20
_TWO_32 = 4_294_967_296.0
_WORD_BYTES = {*range(48, 58), *range(97, 123), *range(128, 256)}
_LOWER = bytes(c + 32 if chr(c) in string.ascii_uppercase else c for c in range(256))
_TO_WORDS = bytes(c if c in _WORD_BYTES else 32 for c in _LOWER)
_BLOCK = "ids array<long>, keys array<long>, n_words array<long>, starts array<int>, buckets array<int>, counts array<int>"


def word_windows(text: bytes, size: int = WINDOW) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, some at a time. ASCII but for digits and letters parts words; A-Z are lower-cased."""
    begin = 0
    while begin < len(text):
        end = min(len(text), begin + size)
        while end < len(text) and _TO_WORDS[text[end]] != 32:
            end += 1
        yield text[begin:end].translate(_TO_WORDS).split()
        begin = end


def bucket_counts(text: bytes, buckets: int, run: int, size: int = WINDOW) -> tuple[int, Counter]:
    """(words, count by bucket) of the runs of 1 to run words of a text, joined by one space."""
    n, out, before = 0, Counter(), []
    for words in word_windows(text, size):
        n += len(words)
        line = before + words
        for k in range(1, run + 1):
            runs = words if k == 1 else map(b" ".join, zip(*(line[max(0, len(before) - k + 1) + j :] for j in range(k)), strict=False))
            for feature, times in Counter(runs).items():
                out[zlib.crc32(feature) % buckets] += times
        before = line[len(line) - run + 1 :] if run > 1 else []
    return n, out


def blocks(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The CSR blocks of docs, written as a table: a row has the ids, a hash of id and text, the words and the entries of a slice.

    Row i of a block has the entries starts[i] to starts[i + 1]. A document has no more entries than there are buckets.
    """
    small_batches(docs.sparkSession)
    kinds = arrow_schema(_BLOCK)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, starts, at, times = [], [0], [], []
        for text in batch.column("text").cast(pa.binary()):
            n, found = bucket_counts(text.as_py(), buckets, run)
            n_words.append(n)
            at += sorted(found)
            times += [found[b] for b in sorted(found)]
            starts.append(len(at))
        row = [batch.column("id"), batch.column("key"), *map(pa.array, (n_words, starts, at, times))]
        return pa.RecordBatch.from_arrays([pa.array([x.to_pylist()], k.type) for x, k in zip(row, kinds, strict=True)], schema=kinds)

    text = text_column(text_col)
    own = F.col(id_col).cast("long")
    return staged(map_batches(docs.select(own.alias("id"), F.xxhash64(own, text).alias("key"), text.alias("text")), pack, _BLOCK, BLOCK_ROWS), compression="zstd")


def _matrix(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, buckets, counts) of the one block in row."""
    return tuple(row.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("starts", "buckets", "counts"))


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket, over all blocks: a task adds its blocks up, so it shuffles a row a bucket at most."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for row in slices(batches, 1):
            _, at, times = _matrix(row)
            np.add.at(total, at, times)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in matrix.select("starts", "buckets", "counts").mapInArrow(add, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the log of how much likelier it is in the target, with one more of each counted; floored."""
    b, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + float(b)) / ((s + 1.0) * (all_t + float(b))))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, key, n_words, n_features, weight) of each document: the product of the matrix with the gains, by feature, floored."""

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            starts, at, times = _matrix(row)
            upto = lambda x: np.diff(np.concatenate([[0], np.cumsum(x.astype(np.int64))])[starts])
            n, total = upto(times), upto(gains[at] * times.astype(np.int64))
            own = [row.column(c).flatten() for c in ("ids", "keys", "n_words")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(total // np.maximum(n, 1))], names=["id", "key", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(multiply, "id long, key long, n_words long, n_features long, weight long")


def noise(ident: Column, seed: int = SEED) -> Column:
    """A thousand times Gumbel noise, floored, from a hash of the seed and an id; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / _TWO_32)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """(id, key, n_words, n_features, weight, score, rank) for each row of docs.

    weight is the mean gain of the row's features, 0 without any; score adds the noise of its id. Of the n rows with at
    least least_words words, the percent * n // 100 highest scores are drawn: rank numbers them from 1, ties by smaller id
    with null last, then by fewer features; the others' is null. key is a hash of id and text, for drawn_rows(). Null
    texts count as empty, in the target too; an empty target leaves the smoothing alone. Repeated rows are rows like
    others and share a score. An empty table gives no rows.

    Texts are read once, into the blocks; nothing but sums by bucket, then scores, leaves a task. Scores are integers
    within bounds that the gains' logarithms set, so their counts fit the driver and give the lowest score that is drawn;
    only rows from there up are sorted.
    """
    matrix = blocks(docs, buckets, run, id_col, text_col)
    wanted = blocks(target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text")), buckets, run, "id", "text")
    gains = gains_of(column_sums(matrix, buckets), column_sums(wanted, buckets))
    rows = weights(matrix, gains).withColumn("score", (F.col("weight") + noise(F.col("id"), seed)).cast("long")).withColumn("nr", F.monotonically_increasing_id())
    rows = staged(rows, compression="zstd")
    discard(matrix, wanted)
    usual = F.col("n_words") >= least_words
    counted = sorted(((r.score, r.n) for r in rows.where(usual).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counted) // 100
    cut, above = None, 0
    for score, n in counted:
        if above >= draw:
            break
        cut, above = score, above + n
    own = ["id", "key", "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cut is None:
        out = rows.select(*own, none)
    else:
        high = usual & (F.col("score") >= cut)
        best = with_row_numbers(rows.where(high), [F.desc("score"), F.asc_nulls_last("id"), "n_features", "nr"], "at")
        out = best.select(*own, F.when(F.col("at") < draw, F.col("at") + 1).alias("rank")).unionByName(rows.where(~high).select(*own, none))
    return out.withColumnRenamed("id", id_col)


def drawn_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rank, id, text) of the rows that resample() drew from docs, with whole texts."""
    own = F.col(id_col).cast("long")
    texts = docs.select(F.xxhash64(own, text_column(text_col)).alias("key"), own.alias("__own"), F.col(text_col).alias("__text"))
    drawn = found.where("rank IS NOT NULL").select("rank", F.col(id_col).alias("__id"), "key")
    texts = texts.join(drawn.select("key").distinct(), "key", "left_semi").groupBy("key", "__own").agg(F.first("__text").alias("__text"))
    return drawn.join(texts, (drawn["key"] == texts["key"]) & F.col("__id").eqNullSafe(F.col("__own"))).select("rank", F.col("__id").alias(id_col), F.col("__text").alias(text_col))


def sql() -> str:
    """What op11 gives for tables `documents` and `benchmark`, in DuckDB's SQL; checksums are worked out byte by byte, of each word once."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS lookup FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, {split} AS ws FROM documents),
b AS (SELECT unnest({split}) AS w FROM benchmark),
words AS (SELECT rid, unnest(ws) AS w FROM d),
known AS (SELECT w FROM words UNION SELECT w FROM b),
bytes AS (SELECT w, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::UBIGINT) AS bs FROM known),
place AS (SELECT w, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, x: xor(c >> 8, lookup[(xor(c & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT % {BUCKETS} AS bucket FROM bytes, tab),
entry AS (SELECT rid, bucket, count(*) AS n FROM words JOIN place USING (w) GROUP BY rid, bucket),
s AS (SELECT bucket, sum(n) AS s FROM entry GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN place USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * (total.s + {BUCKETS}) / ((s.s + 1.0::DOUBLE) * (total.t + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), total),
sums AS (SELECT rid, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM entry JOIN gain USING (bucket) GROUP BY rid),
r AS (
  SELECT rid, doc_id, len(ws) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN sums USING (rid)
), scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
ranked AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, rid) AS rank, {PERCENT} * count(*) OVER () // 100 AS draw FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score::BIGINT AS score, CASE WHEN rank <= draw THEN rank END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

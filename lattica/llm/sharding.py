"""Resharding by minimum-cost flow: as few bytes as possible move from old shards to new ones of equal capacity.

Rows so large that one alone would show in a shard's size stay where they are, as far as they fit. For all others, a
minimum-cost flow from old sizes to the room that is left (a byte that stays costs nothing) says how many bytes go where.
Rows have an order by a hash; along it the flows of an old shard are intervals, and a row goes where the middle of its bytes
lies, so sizes come out equal but for a part of a small row at each border. Where a row lies is a sum over ranges of the
order, worked out in Spark; what reaches the driver is a sum for each shard. Then the shards that lose or gain rows are
written anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import staged, text_column
from lattica.plans.cut import discard

#: Ranges that an old shard's order is cut into, at least, and rows of one, in expectation at most. They don't change the result.
LINES, LINE_ROWS = 256, 100_000
#: A row of this part of a new shard is large.
LARGE = 64
#: Entries of a table that is sent to all executors; larger ones are joined by a shuffle.
SENT = 1 << 18
_HASH_BITS = 60


def cheapest_flow(supply: Sequence[int], demand: Sequence[int], cost: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """Amounts (from, to) that carry all supply to the demand, as much in total, at the least cost.

    Successive shortest paths: each round finds the cheapest way from supply left to demand left, also by taking back
    earlier flow, and fills it.
    """
    m, n = len(supply), len(demand)
    left, room = list(supply), list(demand)
    flow: dict[tuple[int, int], int] = {}
    while any(left):
        far = [0 if x else None for x in left] + [None] * n
        via: list[int | None] = [None] * (m + n)
        changed = True
        while changed:
            changed = False
            for i in range(m):
                for j in range(n):
                    if far[i] is not None and (far[m + j] is None or far[i] + cost(i, j) < far[m + j]):
                        far[m + j], via[m + j], changed = far[i] + cost(i, j), i, True
                    if far[m + j] is not None and flow.get((i, j)) and (far[i] is None or far[m + j] - cost(i, j) < far[i]):
                        far[i], via[i], changed = far[m + j] - cost(i, j), m + j, True
        end = min((j for j in range(n) if room[j] and far[m + j] is not None), key=lambda j: (far[m + j], j))
        path, at = [], m + end
        while via[at] is not None:
            path.append((via[at], at))
            at = via[at]
        amount = min([left[at], room[end], *(flow[b, a - m] for a, b in path if a >= m)])
        for a, b in path:
            key = (a, b - m) if a < m else (b, a - m)
            flow[key] = flow.get(key, 0) + (amount if a < m else -amount)
        left[at] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), lines: int = LINES, line_rows: int = LINE_ROWS) -> tuple[DataFrame, list[int]]:
    """((id, size, text_crc32, old_shard, shard, slot, text, *keep) for each row of docs, and the shards written anew).

    size is the text's bytes in UTF-8 plus 16; a null text has none and the checksum of the empty text. The law is
    `bytes`: shards 0 to shards - 1 get sizes as equal as whole documents allow. slot numbers a shard's rows from 0
    without gaps. old_shard must give 0 to old_shards - 1; null counts as 0. Repeated rows are rows like others, and null
    ids too. Equal texts aren't kept together, as a group of a third of all rows would fit no shard. An empty table gives
    no rows.

    The rows of a shard that loses or gains some are written into a folder of its own, and come from there; the others are
    left where they are. Rows are shuffled once, by ranges of their order, so that a task writes for few shards. Equal rows
    have one hash; where those are many, they are dealt to ranges of their own, in any order, as they can't be told apart.
    Large rows are at most LARGE x shards; what is joined to the rows has an entry for each of those or for each range, and is
    sent to executors only up to SENT entries.
    """
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), (F.octet_length(whole) + 16).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("crc"), F.coalesce(old_shard, F.lit(0)).cast("int").alias("old"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(keep)])
    own = ["__text", *[f"__x{i}" for i in range(len(keep))]]
    spread = F.conv(F.substring(F.md5(F.concat_ws(":", "__id", "crc")), 1, _HASH_BITS // 4), 16, 10).cast("long")
    rows = staged(rows.withColumn("h", spread).withColumn("nr", F.monotonically_increasing_id()), compression="zstd")
    found = rows.groupBy("old").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    total, lines = sum(r["size"] for r in found), max(lines, -(-sum(r.n for r in found) // (old_shards * line_rows)))
    fixed, held = _fixed(rows, total, shards)
    supply, room = [0] * old_shards, capacities(total, shards)
    for r in found:
        supply[r.old] = r["size"] - held.get(r.old, 0)
    flow = cheapest_flow(supply, [c - held.get(j, 0) for j, c in enumerate(room)], lambda i, j: int(i != j))
    affected = sorted({x for pair in flow if pair[0] != pair[1] for x in pair})
    stays = _sent(fixed.select("nr", "nth"), LARGE * shards)
    rest, key = _ranged(rows.join(stays, "nr", "left_anti"), lines, max(line_rows // 25, 4 * sum(r.n for r in found) // max(1, old_shards * lines)))
    before = rest.groupBy(*key).agg(F.sum("size").alias("s"))
    before = staged(before.withColumn("before", F.sum("s").over(Window.partitionBy("old").orderBy(*key[1:])) - F.col("s")).drop("s"))
    along = Window.partitionBy(*key).orderBy("h", "__id", "crc", "nr").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rest.repartitionByRange(*key).withColumn("upto", F.sum("size").over(along)).join(_sent(before, before.count()), key)
    goes = rows.sparkSession.createDataFrame(_pieces(flow), "old int, low long, high long, shard int")
    placed = dealt.withColumn("middle", F.col("before") + F.col("upto") - F.floor(F.col("size") / 2) - 1).join(F.broadcast(goes), "old").where("low <= middle AND middle < high")  # goes: some entries a shard
    placed = placed.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "shard").orderBy("middle", "nr")) - 1)
    columns = ["__id", "size", "crc", *key, "nth", *own, "shard"]
    home = rows.join(stays, "nr").select("*", F.lit(-1).alias("line"), *[F.lit(0).alias(c) for c in key[2:]], F.col("old").alias("shard"))
    placed = placed.select(columns).unionByName(home.select(columns))
    rewritten = staged(placed.where(F.col("shard").isin(affected)), "shard", compression="zstd")
    if set(affected) >= set(range(shards)):
        discard(rows, fixed, before)
    else:
        rewritten = rewritten.unionByName(placed.where(~F.col("shard").isin(affected)))
    offset = rewritten.groupBy("shard", *key).agg(F.count("*").alias("n"))
    offset = offset.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy(*key)) - F.col("n")).drop("n")
    offset = staged(offset)
    out = rewritten.join(_sent(offset, offset.count()), ["shard", *key])
    slot = (F.col("offset") + F.col("nth")).cast("long").alias("slot")
    return out.select(F.col("__id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", slot, F.col("__text").alias(text_col), *[F.col(f"__x{i}").alias(c) for i, c in enumerate(keep)]), affected


def _sent(df: DataFrame, entries: int) -> DataFrame:
    """df, of that many rows at most, for a join with all rows: sent to executors if it is small."""
    return F.broadcast(df) if entries <= SENT else df


def _fixed(rows: DataFrame, total: int, shards: int) -> tuple[DataFrame, dict[int, int]]:
    """((nr, nth) of the large rows that stay, largest first, as long as they fit a shard's capacity; their bytes by shard)."""
    least, over = divmod(total, shards)
    capacity = F.lit(least) + (F.col("old") < over).cast("long")
    order = Window.partitionBy("old").orderBy(F.desc("size"), "h", "__id", "crc", "nr")
    large = rows.where((F.col("size") * (LARGE * shards) >= total) & (F.col("old") < shards)).select("nr", "old", "size", "h", "__id", "crc")
    summed = large.withColumn("nth", F.row_number().over(order) - 1).withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fixed = staged(summed.where(F.col("upto") <= capacity).select("nr", "nth", "old", "size"))
    return fixed, {r.old: r["size"] for r in fixed.groupBy("old").agg(F.sum("size").alias("size")).collect()}


def _ranged(rows: DataFrame, lines: int, usual: int) -> tuple[DataFrame, list[str]]:
    """rows with their range in the order of h, and the columns that tell it; rows of one h that are more than usual have parts of their own."""
    rows = rows.withColumn("line", F.shiftright(F.shiftright("h", _HASH_BITS // 2) * lines, _HASH_BITS // 2).cast("int"))
    full = rows.groupBy("old", "line").agg(F.count("*").alias("n")).where(F.col("n") > usual).select("old", "line")
    heavy = rows.join(full, ["old", "line"], "left_semi").groupBy("old", "line", "h").agg(F.count("*").alias("n")).where(F.col("n") > usual)
    heavy = staged(heavy.groupBy("old", "line").agg(F.collect_list(F.struct("h", F.ceil(F.col("n") / usual).alias("parts"))).alias("heavy")))  # few: each has a large part of a range
    if heavy.isEmpty():
        return rows, ["old", "line"]  # constants beside them would be folded away in some places and not in others
    rows = rows.join(heavy, ["old", "line"], "left")
    lower, same = F.filter("heavy", lambda x: x.h < F.col("h")), F.filter("heavy", lambda x: x.h == F.col("h"))
    sub = F.coalesce(2 * F.size(lower) + F.size(same), F.lit(0)).cast("int")
    part = F.coalesce(F.pmod(F.xxhash64("nr"), F.get(same, F.lit(0)).getField("parts")), F.lit(0)).cast("int")
    rows = rows.withColumn("sub", F.when(F.col("heavy").isNull(), 0).otherwise(sub)).withColumn("part", F.when(F.col("heavy").isNull(), 0).otherwise(part))
    return rows.drop("heavy"), ["old", "line", "sub", "part"]


def _pieces(flow: dict[tuple[int, int], int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard), in bytes along the old shard's order: what stays first, then by new shard."""
    out, at = [], {}
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        start = at.get(i, 0)
        out.append((i, start, start + n, j))
        at[i] = start + n
    return out


def sql(old_shards: int, shards: int) -> str:
    """What op10 gives for a table `documents`, in DuckDB's SQL.

    With a cost of 0 or 1 the cheapest flow is known: a shard keeps what it can, and what is over goes, in the order of
    old shards, to what is missing, in the order of new ones. Checksums are worked out byte by byte.
    """
    return f"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8
), tab AS (SELECT list(v ORDER BY i) AS lookup FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
strings AS (SELECT rid, 0 AS of, t AS s FROM d UNION ALL SELECT rid, 1, doc_id::VARCHAR FROM d WHERE doc_id IS NOT NULL),
bytes AS (SELECT rid, of, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::UBIGINT) AS bs FROM strings),
sums AS (SELECT rid, of, len(bs) AS n, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, x: xor(c >> 8, lookup[(xor(c & 255, x) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM bytes, tab),
r AS (SELECT d.rid, doc_id, a.n + 16 AS size, a.crc, coalesce(b.crc % {old_shards}, 0) AS old, ('0x' || md5(concat_ws(':', doc_id, a.crc))[1:15])::BIGINT AS h FROM d JOIN sums a ON a.rid = d.rid AND a.of = 0 LEFT JOIN sums b ON b.rid = d.rid AND b.of = 1),
total AS (SELECT coalesce(sum(size), 0) AS n FROM r),
large AS (SELECT rid, old, size, sum(size) OVER (PARTITION BY old ORDER BY size DESC, h, doc_id NULLS FIRST, crc, rid ROWS UNBOUNDED PRECEDING) AS upto FROM r, total WHERE size * {LARGE * shards} >= n AND old < {shards}),
fixed AS (SELECT rid, old, size FROM large, total WHERE upto <= n // {shards} + (old < n % {shards})::INT),
rest AS (SELECT * FROM r ANTI JOIN fixed USING (rid)),
m AS (SELECT *, sum(size) OVER (PARTITION BY old ORDER BY h, doc_id NULLS FIRST, crc, rid ROWS UNBOUNDED PRECEDING) - size // 2 - 1 AS middle FROM rest),
held AS (SELECT old AS i, sum(size) AS held FROM fixed GROUP BY old),
shard AS (SELECT i, n // {shards} + (i < n % {shards})::INT - coalesce(held, 0) AS cap, coalesce(own, 0) AS own FROM range({max(old_shards, shards)}) x(i) CROSS JOIN total LEFT JOIN held USING (i) LEFT JOIN (SELECT old, sum(size) AS own FROM rest GROUP BY old) ON old = i),
kept AS (SELECT i, CASE WHEN i < {shards} THEN cap ELSE 0 END AS cap, own, least(own, CASE WHEN i < {shards} THEN cap ELSE 0 END) AS keep FROM shard),
line AS (SELECT i, keep, own - keep AS over, cap - keep AS room, sum(own - keep) OVER w AS a1, sum(cap - keep) OVER w AS b1 FROM kept WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
flow AS (SELECT x.i, y.i AS j, least(x.a1, y.b1) - greatest(x.a1 - x.over, y.b1 - y.room) AS n FROM line x JOIN line y ON x.over > 0 AND y.room > 0 AND least(x.a1, y.b1) > greatest(x.a1 - x.over, y.b1 - y.room)),
piece AS (
  SELECT i, i AS j, 0 AS low, keep AS high FROM kept WHERE keep > 0
  UNION ALL SELECT i, j, keep + before - n, keep + before FROM (SELECT *, sum(n) OVER (PARTITION BY i ORDER BY j ROWS UNBOUNDED PRECEDING) AS before FROM flow) JOIN kept USING (i)
), placed AS (
  SELECT rid, j, 1 AS later, 0 AS down, middle FROM m JOIN piece ON i = old AND low <= middle AND middle < high UNION ALL SELECT rid, old, 0, -size, 0 FROM fixed
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, j::INT AS shard, row_number() OVER (PARTITION BY j ORDER BY old, later, down, middle, h, doc_id NULLS FIRST, crc) - 1 AS slot, NULL::INT AS grown_shard, old::INT AS old_shard
FROM r JOIN placed USING (rid)
"""

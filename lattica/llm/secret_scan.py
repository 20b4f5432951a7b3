"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong secrets are found by three fixed patterns. Weak parts (names of accounts, short secrets, endpoints) mean little
alone, so they are reported only where complementary parts stand within one scope: the parts of each document are put
into all bins of the scope's width that they reach and joined with those of the same and the neighbouring bins. A bin
holds a bounded number of parts, as parts don't overlap within a kind, so no document and no kind makes a quadratic join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import staged, text_column

#: Characters between two parts of one credential, at most.
SCOPE = 200
MASK = "[SECRET]"

# Kind, pattern, the group whose length counts, its least length. The first three are the base.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}+", 0, 32),
    ("identifier", r"""(?i:(?<![A-Za-z0-9])(access_?key_?id|key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]+)""", 2, 3),
    ("weak", r"""(?i:(?<![A-Za-z0-9])(pwd|pass|private_?key|auth_?key|credential|passphrase|pin))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 4),
    ("endpoint", r"""(?i:(?<![A-Za-z0-9])(https?|ftp|ssh|jdbc:[a-z]+|mongodb|postgres|postgresql|mysql|redis|amqp)://([^\s"'<>]+))""", 0, 8),
)
BASE = ("assign", "access", "hex")
SECRETS, PARTNERS = ("assign", "hex", "weak"), ("access", "identifier", "endpoint")
#: Values that are summed at a time, and characters of a piece of a long text.
_BLOCK, _PIECE = 64, 1024


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _most(x: Column) -> Column:
    return F.coalesce(F.array_max(x), F.lit(0).cast("long"))


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once, however often and in whichever inner function it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _with_before(values: Column, fold: Callable[[Column], Column], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(before), where before(i) is the fold (the sum, say) of the values before the i-th, from 0.

    Folds of blocks of values, and of the blocks before each block, are kept, so before(i) looks at one block only.
    """

    def before(v: Column, earlier: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        return fold(F.array(F.get(earlier, block), fold(F.slice(v, block * _BLOCK + 1, i % _BLOCK))))

    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int")), lambda b: fold(F.slice(v, b * _BLOCK + 1, F.lit(_BLOCK))))
    upto = lambda f: F.transform(F.sequence(F.lit(0), F.size(f) - 1), lambda b: fold(F.slice(f, F.lit(1), b)))
    return _let(values, lambda v: _let(blocks(v), lambda f: _let(upto(f), lambda earlier: use(lambda i: before(v, earlier, i)))))


def with_spans(df: DataFrame, kinds: Sequence[str], text: str = "__text") -> DataFrame:
    """Adds __spans: array of (start, kind's place in PATTERNS, end) of every span of the kinds, in code points.

    Matches are the leftmost ones that don't overlap within their kind; the starts are running sums of the lengths of
    the matches and of what stands between them, by blocks, so that many matches in one text stay cheap.
    """
    names, kept = df.columns, []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind not in kinds:
            continue
        p, none = F.lit(pattern), F.array().cast("array<string>")
        found = F.col(text).rlike(pattern)
        df = df.select("*", F.when(found, F.regexp_extract_all(text, p, F.lit(0))).otherwise(none).alias("__m"), F.when(found, F.split(text, pattern, -1)).otherwise(none).alias("__p"), (F.when(found, F.regexp_extract_all(text, p, F.lit(group))).otherwise(none) if group else F.lit(None).cast("array<string>")).alias("__g"))
        df = df.select(*names, *kept, F.transform("__m", lambda x: F.length(x).cast("long")).alias("__m"), F.transform("__p", lambda x: F.length(x).cast("long")).alias("__p"), (F.transform("__g", lambda x: F.length(x).cast("long")) if group else F.transform("__m", lambda x: F.length(x).cast("long"))).alias("__g"))
        # There is one part more than matches, at the end, where __m is null.
        each = F.arrays_zip("__m", "__p", "__g")

        def spans(before: Callable[[Column], Column], order: int = order) -> Column:
            def span(x: Column, i: Column) -> Column:
                start = before(i) + x["__p"]
                return F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + x["__m"]).alias("end"), x["__g"].alias("g"))

            return F.transform(each, span)

        found = _with_before(F.zip_with("__m", "__p", lambda m, q: m + q), _sum, spans)
        found = F.filter(found, lambda x: F.coalesce(x["g"] >= least, F.lit(False)))
        kept.append(f"__k{order}")
        df = df.select(*names, *kept[:-1], F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).alias(kept[-1]))
    return df.select(*names, F.array_sort(F.concat(*kept)).alias("__spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k, *_ in PATTERNS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def linked_parts(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(__id, __key, __linked) for the documents with weak parts that other parts complete.

    A secret (of any strength) and a partner (account name, key id or endpoint) belong together if at most `scope`
    characters lie between them. Of such pairs the spans that aren't of the base are returned, distinct.
    """
    orders = {k: i for i, (k, *_) in enumerate(PATTERNS)}
    some = lambda kinds: F.col("__text").rlike("|".join(p for k, p, *_ in PATTERNS if k in kinds))
    parts = with_spans(rows.select("__id", "__key", "__text").where(some(SECRETS) & some(PARTNERS)), [k for k, *_ in PATTERNS])
    # explode_outer, as the filter that Spark infers for explode would repeat the patterns' work at every level below.
    parts = staged(parts.select("__id", "__key", F.explode_outer("__spans").alias("s"))).where(F.col("s").isNotNull())
    of = lambda kinds: parts.where(F.col("s.kind").isin([orders[k] for k in kinds]))
    secrets = of(SECRETS).select("__id", "__key", F.col("s").alias("a"), F.explode(F.sequence(F.floor(F.col("s.start") / scope) - 1, F.floor(F.col("s.end") / scope) + 1)).alias("bin"))
    partners = of(PARTNERS).select("__id", "__key", F.col("s").alias("b"), F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor(F.col("s.end") / scope))).alias("bin"))
    x, y = secrets.alias("x"), partners.alias("y")
    near = (F.col("a.start") - F.col("b.end") <= scope) & (F.col("b.start") - F.col("a.end") <= scope)
    pairs = x.join(y, (F.col("x.__key") == F.col("y.__key")) & F.col("x.__id").eqNullSafe(F.col("y.__id")) & (F.col("x.bin") == F.col("y.bin")) & near)
    spans = pairs.select("x.__id", "x.__key", F.explode(F.array("a", "b")).alias("s")).where(~F.col("s.kind").isin([orders[k] for k in BASE]))
    return spans.groupBy("__id", "__key").agg(F.collect_set("s").alias("__linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, found, *keep) for each row of docs.

    spans lists all spans, base and linked, as kind:start:end by start, then kind; found has them as an array of
    (start, kind, end). base_sha256 is the digest of the base spans, so listed. A null text counts as empty and has no
    spans. Rows are told apart by id and text; repeated rows each get the whole result, and null ids come out null.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_column(text_col).alias("__text"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(keep)])
    rows = rows.withColumn("__key", F.xxhash64("__id", "__text"))
    count = lambda k: F.size(F.filter("__spans", lambda x: x["kind"] == BASE.index(k))).cast("long").alias(f"n_{k}")
    own = [f"__x{i}" for i in range(len(keep))]
    base = with_spans(rows, BASE).select("__id", "__key", "__spans", *own)
    linked = staged(linked_parts(rows, scope)).select(F.col("__id").alias("__id2"), F.col("__key").alias("__key2"), "__linked")
    both = base.join(linked, (F.col("__key") == F.col("__key2")) & F.col("__id").eqNullSafe(F.col("__id2")), "left")
    both = both.withColumn("__all", F.when(F.col("__linked").isNull(), F.col("__spans")).otherwise(F.array_sort(F.concat("__spans", "__linked"))))
    return both.select(F.col("__id").alias(id_col), *map(count, BASE), F.sha2(listed(F.col("__spans")), 256).alias("base_sha256"), listed(F.col("__all")).alias("spans"), F.col("__all").alias("found"), *[F.col(f"__x{i}").alias(c) for i, c in enumerate(keep)])


def with_redacted(df: DataFrame, text: str, spans: str, name: str) -> DataFrame:
    """Adds the text with each span, overlapping ones as one, replaced by MASK; null stays null.

    A span begins a mask if it starts at or after the end of all before it. What stands between masks is taken from short
    pieces of the text, so many spans in a long text take time in proportion.
    """
    some = F.size(spans) > 0
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def kept(x: Column, t: Column) -> Column:
        first, last = (F.floor(x[c] / _PIECE).cast("int") for c in ("from", "to"))
        near = F.array_join(F.slice(t, first + 1, last - first + 1), "")
        return F.substring(near, (x["from"] - first * _PIECE + 1).cast("int"), (x["to"] - x["from"]).cast("int"))

    ends = F.transform(spans, lambda x: x["end"])
    stands = _with_before(ends, _most, lambda before: F.transform(spans, lambda x, i: F.struct(before(i).alias("from"), x["start"].alias("to"))))
    rest = F.struct(_most(ends).alias("from"), F.length(text).cast("long").alias("to"))
    between = F.concat(F.filter(stands, lambda x: x["to"] >= x["from"]), F.array(rest))
    new = _let(pieces, lambda t: F.array_join(F.transform(between, lambda x: kept(x, t)), MASK))
    return df.withColumn(name, F.when(some, new).otherwise(F.col(text)))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql(scope: int = SCOPE) -> str:
    """The rows of find_secrets without `found`, for a table `documents`, in DuckDB's SQL.

    Its patterns can't look behind. So where a pattern must not follow a letter or digit, the whole text is cut into
    matches, runs of letters and digits, and what stands between; then a match can only begin where such a run does.
    """
    parts = []
    for order, (_, pattern, group, least) in enumerate(PATTERNS):
        plain = pattern.replace("(?<![A-Za-z0-9])", "").replace("{32,}+", "{32,}")
        if plain == pattern.replace("{32,}+", "{32,}"):
            parts.append(f"""SELECT rid, {order} AS kind, start, start + len(m) AS stop, g FROM (
  SELECT rid, m, g, coalesce(sum(len(m)) OVER before, 0) + sum(len(p)) OVER upto AS start FROM (
    SELECT rid, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(g) AS g, generate_subscripts(m, 1) AS i FROM (
      SELECT rid, regexp_extract_all(t, {_quoted(plain)}, 0) AS m, regexp_split_to_array(t, {_quoted(plain)}) AS p, regexp_extract_all(t, {_quoted(plain)}, {group}) AS g FROM d))
  WINDOW before AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), upto AS (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE len(g) >= {least}""")
        else:
            cut = f"(?:{plain})|[A-Za-z0-9]+|[^A-Za-z0-9]+"
            parts.append(f"""SELECT rid, {order}, start, start + len(m), m FROM (
  SELECT rid, m, sum(len(m)) OVER (PARTITION BY rid ORDER BY i ROWS UNBOUNDED PRECEDING) - len(m) AS start FROM (
    SELECT rid, unnest(m) AS m, generate_subscripts(m, 1) AS i FROM (SELECT rid, regexp_extract_all(t, {_quoted(cut)}, 0) AS m FROM d)))
  WHERE regexp_full_match(m, {_quoted(plain)}) AND len(regexp_extract(m, {_quoted(plain)}, {group})) >= {least}""")
    orders = {k: i for i, (k, *_) in enumerate(PATTERNS)}
    listed = lambda kinds: ", ".join(str(orders[k]) for k in kinds)
    names = ", ".join(_quoted(k) for k, *_ in PATTERNS)
    show = f"string_agg([{names}][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
s AS (SELECT rid, kind::INT AS kind, start::BIGINT AS start, stop::BIGINT AS stop FROM spans),
pairs AS (
  SELECT a.rid, a.kind AS ak, a.start AS a0, a.stop AS a1, b.kind AS bk, b.start AS b0, b.stop AS b1 FROM s a JOIN s b ON a.rid = b.rid
  WHERE a.kind IN ({listed(SECRETS)}) AND b.kind IN ({listed(PARTNERS)}) AND a.start - b.stop <= {scope} AND b.start - a.stop <= {scope}
), whole AS (
  SELECT * FROM s WHERE kind < {len(BASE)} UNION SELECT rid, ak, a0, a1 FROM pairs WHERE ak >= {len(BASE)} UNION SELECT rid, bk, b0, b1 FROM pairs WHERE bk >= {len(BASE)}
), base AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(BASE))}, {show} AS text FROM s WHERE kind < {len(BASE)} GROUP BY rid
), listed AS (SELECT rid, {show} AS text FROM whole GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base.text, '')) AS base_sha256, coalesce(listed.text, '') AS spans
FROM d LEFT JOIN base USING (rid) LEFT JOIN listed USING (rid)
"""

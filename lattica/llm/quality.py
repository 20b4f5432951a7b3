"""Quality rules as a short-circuit cascade of expressions that stay in the JVM.

A rule is an expression of the text that tells whether the text fails it. On a sample each rule is timed and its failures
are counted; the cascade asks first for the rule that rejects most for its cost, then for the one that rejects most of what
that leaves, and so on. A document is kept if it fails no rule, so the order changes the time alone. Rules compare
integers, so they hold alike everywhere.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import staged, text_column
from lattica.plans.cut import discard

#: A document fails with fewer words, or more of every hundred of them in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Documents that costs and failures are estimated on, in expectation.
SAMPLE = 2_000
#: Bits of a word's place; no text has more words.
_PLACE_BITS = 30
_SYMBOLS = "[#*$%&|<>]"


class Text(NamedTuple):
    """What rules look at."""

    text: Column
    words: Column
    lines: Column  # those that hold a word


class Rule(NamedTuple):
    name: str
    fails: Callable[[Text], Column]
    sql: str  # the same of columns t, ws and ls


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def count_of(text: Column, pattern: str) -> Column:
    """Places of a pattern that matches one character or more."""
    return F.size(F.split(text, pattern)) - 1


def characters(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def _share(items: Column, one: Callable[[Column], Column], tenths: int) -> Column:
    """More than so many tenths of the items are like that."""
    return 10 * F.size(F.filter(items, one)) > tenths * F.size(items)


#: Besides the two of the base. ASCII letters and all beyond ASCII count as letters; capitals are counted by their runs.
RULES = (
    Rule("symbols", lambda x: 10 * count_of(x.text, _SYMBOLS) > F.size(x.words), f"10 * len(regexp_extract_all(t, '{_SYMBOLS}')) > len(ws)"),
    Rule("short_words", lambda x: characters(x.words) < 2 * F.size(x.words), "list_sum(list_transform(ws, lambda x: length(x))) < 2 * len(ws)"),
    Rule("capitals", lambda x: count_of(x.text, "[A-Z]+") > count_of(x.text, "[a-z]+"), "len(regexp_extract_all(t, '[A-Z]+')) > len(regexp_extract_all(t, '[a-z]+'))"),
    Rule("without_letters", lambda x: _share(x.words, lambda w: ~w.rlike(r"[A-Za-z]|[^\x00-\x7F]"), 2), r"10 * len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) > 2 * len(ws)"),
    Rule("repeated_lines", lambda x: 10 * (F.size(x.lines) - F.size(F.array_distinct(x.lines))) > 5 * F.size(x.lines), "10 * (len(ls) - len(list_distinct(ls))) > 5 * len(ls)"),
    Rule("cut_off_lines", lambda x: _share(x.lines, lambda y: y.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z"), 3), r"10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) > 3 * len(ls)"),
    Rule("bullets", lambda x: _share(x.lines, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]"), 9), r"10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) > 9 * len(ls)"),
)


class Estimate(NamedTuple):
    rule: Rule
    seconds: float  # for the sample, beyond reading it
    failed: float  # share of the sample


def _timed(df: DataFrame, *columns: Column) -> float:
    began = time.perf_counter()
    df.agg(F.count("*"), *[F.count_if(c) for c in columns]).collect()
    return time.perf_counter() - began


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text", sample: int = SAMPLE) -> list[Estimate]:
    """The rules in the order to ask them in, with what they cost on a sample and the share of it that they reject.

    Each next rule has the greatest ratio of rejections, among what the rules before it leave, to its cost. The sample is
    random, about `sample` documents; what the driver gets is a count for each set of failed rules. An empty table leaves
    the rules in the order of their costs.
    """
    text = docs.select(text_column(text_col).alias("t"))
    part = text.sample(min(1.0, sample / max(text.count(), 1)), seed=11)
    taken = staged(part.select("t", words_of(F.col("t")).alias("ws"), lines_of(F.col("t")).alias("ls")))
    failed = [r.fails(Text(F.col("t"), F.col("ws"), F.col("ls"))) for r in rules]
    sets = {tuple(r.failed): r.n for r in taken.groupBy(F.array(*failed).alias("failed")).agg(F.count("*").alias("n")).collect()}
    least = min(_timed(taken) for _ in range(2))
    cost = [max(1e-4, min(_timed(taken, f) for _ in range(2)) - least) for f in failed]
    discard(taken)
    total, out, left = max(1, sum(sets.values())), [], list(range(len(rules)))
    while left:
        rejects = {i: sum(x for s, x in sets.items() if s[i]) for i in left}
        best = min(left, key=lambda i: (-rejects[i] / cost[i], cost[i]))
        out.append(Estimate(rules[best], cost[best], rejects[best] / total))
        sets = {s: x for s, x in sets.items() if not s[best]}
        left.remove(best)
    return out


def first_failed(rules: Sequence[Rule | Estimate], text: Text) -> Column:
    """The name of the first rule, in the order given, that a text fails; null if none. Later rules aren't evaluated."""
    out = F.lit(None).cast("string")
    for x in reversed(rules):
        rule = x.rule if isinstance(x, Estimate) else x
        out = F.when(rule.fails(text), rule.name).otherwise(out)
    return out


def _repeated_words(rows: DataFrame) -> DataFrame:
    """rows with n_repeat_words: words of __words in windows of three that stand there twice or more.

    A window's key is 34 bits of its hash, then its place, so sorted keys bring equal windows together. Places whose
    neighbours have the same bits are few; those are sorted by the window's words, and neighbours there are compared.
    """
    at = lambda i: F.get("__words", i)
    first = F.slice("__words", 1, F.greatest(F.size("__words") - 2, F.lit(0)))
    keys = F.sort_array(F.transform(first, lambda w, i: F.shiftleft(F.xxhash64(w, at(i + 1), at(i + 2)), _PLACE_BITS).bitwiseOR(i.cast("long"))))
    rows = rows.withColumn("__keys", keys)
    bits = lambda k: F.shiftright(k, _PLACE_BITS)
    alike = lambda k, j: F.coalesce(bits(F.get("__keys", j)) == bits(k), F.lit(False))
    place = lambda k: k.bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")
    rows = rows.withColumn("__maybe", F.transform(F.filter("__keys", lambda k, j: alike(k, j - 1) | alike(k, j + 1)), place))
    rows = rows.withColumn("__sorted", F.array_sort(F.transform("__maybe", lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("w"), i.alias("i")))))
    same = lambda x, j: F.coalesce(F.get("__sorted", j).getField("w") == x.w, F.lit(False))
    places = F.sort_array(F.transform(F.filter("__sorted", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x.i))
    # A place covers itself and two more, less what the next one covers again.
    step = lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(3), x - a["last"])).alias("n"))
    return rows.withColumn("n_repeat_words", F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda a: a.n))


def assess(docs: DataFrame, rules: Sequence[Rule | Estimate] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed, *keep) for each row of docs.

    A null text counts as empty: it has no words, so it fails. base_failed is the verdict of the counts; kept is false with
    it, else whether no rule of the cascade fails, in the order that cascade() finds if none is given. failed names the
    first that does, so it alone depends on the order. Repeated rows and null ids come out as they went in; an empty table
    gives no rows. Nothing is shuffled.
    """
    rules = cascade(docs, text_col=text_col) if rules is None else rules
    rows = docs.select(F.col(id_col).alias("__id"), text_column(text_col).alias("__text"), *[F.col(c).alias(f"__x{i}") for i, c in enumerate(keep)])
    rows = _repeated_words(rows.withColumn("__words", words_of(F.col("__text"))).withColumn("__lines", lines_of(F.col("__text"))))
    long = lambda c, name: c.cast("long").alias(name)
    counted = rows.select(
        "__id", "__text", "__words", "__lines", long(F.size("__words"), "n_words"), long(characters(F.col("__words")), "word_chars"), long(count_of(F.col("__text"), _SYMBOLS), "n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"), long(F.col("n_repeat_words"), "n_repeat_words"), *[f"__x{i}" for i in range(len(keep))],
    )
    counted = counted.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    judged = counted.withColumn("failed", F.when(F.col("base_failed"), "base").otherwise(first_failed(rules, Text(F.col("__text"), F.col("__words"), F.col("__lines")))))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(F.col("__id").alias(id_col), *base, F.col("failed").isNull().alias("kept"), "failed", *[F.col(f"__x{i}").alias(c) for i, c in enumerate(keep)])


def sql() -> str:
    """The rows of assess() without failed, for a table `documents`, in DuckDB's SQL, with every rule evaluated."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents
), w AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
), twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM w) WHERE n > 1),
again AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY rid),
m AS (
  SELECT d.*, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{_SYMBOLS}'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN again USING (rid)
), b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"({r.sql})" for r in RULES)}) AS kept FROM b
"""

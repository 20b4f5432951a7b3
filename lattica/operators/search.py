"""Ranked search over names, comments and bodies, with a typo fallback."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import local_name

# Okapi constants, page size, greatest distance and number of suggestions.
K1, B, LIMIT, DISTANCE, SUGGESTIONS = 1.2, 0.75, 20, 2, 5
COLUMNS = ("qname", "comment", "body")
#: Parts of a stored index, by term.
BUCKETS = 64
#: Leading letters whose deletions a name is found by.
LEADING = 7

#: Latin letters with marks and their bare letters, by decomposition.
_MARKED = [(c, d[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(d := unicodedata.normalize("NFD", c)) > 1]


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits, without diacritics; an empty array for null."""
    bare = F.translate(text, "".join(c for c, _ in _MARKED), "".join(d for _, d in _MARKED))
    words = F.split(F.lower(F.regexp_replace(bare, r"\p{M}+", "")), r"[^\p{L}\p{N}]+")
    return F.coalesce(F.filter(words, lambda w: w != ""), F.array().cast("array<string>"))


def text_rows(nodes: DataFrame) -> DataFrame:
    """(id, qname, comment, body) by level: none for off, no body for metadata."""
    return nodes.where("level <> 'off'").select("id", "qname", F.coalesce("payload.comment", F.lit("")).alias("comment"), F.when(F.col("level") == "full", F.coalesce("payload.body", F.lit(""))).otherwise(F.lit("")).alias("body"))


def index(rows: DataFrame) -> DataFrame:
    """Tokens of each column, and their number; worth storing."""
    t = rows.select("id", *[tokens(F.col(c)).alias(c) for c in COLUMNS])
    return t.withColumn("len", reduce(lambda a, b: a + b, [F.size(c) for c in COLUMNS]))


def postings(rows: DataFrame) -> DataFrame:
    """(bucket, term, id, col, positions): where each word stands in each column of text rows."""
    docs = index(rows.repartition(_tasks(rows), "id"))  # texts are shuffled, not their words with an id each
    of = lambda c: F.transform(c, lambda w, i: F.struct(F.lit(c).alias("col"), w.alias("term"), i.cast("int").alias("pos")))
    words = docs.select("id", F.explode(F.concat(*map(of, COLUMNS))).alias("w")).select("id", "w.col", "w.term", "w.pos")
    listed = words.groupBy("id", "term", "col").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return listed.select(bucket_of(F.col("term")).alias("bucket"), "term", "id", "col", "positions")


def _tasks(rows: DataFrame) -> int:
    """As many as there are for any shuffle: rows that grow after one mustn't be put together by their size before."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def lengths(rows: DataFrame) -> DataFrame:
    return index(rows).select("id", "len")


def phrases(query: str, prefix: bool = False) -> list[list[str]]:
    """Of each blank-separated term its tokens."""
    bare = dict(_MARKED)
    out = []
    for term in query.lower().split():
        plain = "".join(bare.get(c, c) for c in term)
        words = "".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFC", plain) if not unicodedata.combining(c)).split()
        if words:
            out.append(words)
    return out


def occurrences(words: Column, phrase: list[str], prefix: bool = False) -> Column:
    """How often the phrase stands in an array of tokens; with prefix its last word may go on."""
    n = len(phrase)
    same = (lambda w, p: w.startswith(p)) if prefix else (lambda w, p: w == p)
    if n == 1:
        return F.size(F.filter(words, lambda w: same(w, F.lit(phrase[0]))))
    fits = lambda w, i: reduce(lambda a, b: a & b, [(same if k == n - 1 else (lambda x, p: x == p))(F.get(words, i + k), F.lit(p)) for k, p in enumerate(phrase)])
    found = F.size(F.filter(words, lambda w, i: F.coalesce(fits(w, i), F.lit(False))))
    return F.when(F.array_contains(words, phrase[0]), found).otherwise(0) if n > 1 else found


def search(docs: DataFrame, query: str, limit: int | None = LIMIT, offset: int = 0, prefix: bool = False, exact_column: bool = False) -> DataFrame:
    """(id, score, matched, total) of the page of documents that hold any of the query's terms, best first, ties by id.

    Without a limit all come, unsorted.

    docs comes from index(). A term is an exact word or, split by its own punctuation, an exact phrase within a column;
    prefix lets its last word go on. matched is the column that is told as the place of the match: body, comment, qname
    in that order, where only the first term is bound to the column; exact_column asks all terms of the column itself.
    Two passes over docs: one for the counts, one for the scores.
    """
    terms = phrases(query)
    if not terms:
        return _nothing(docs)
    tf = docs.select("id", "len", *[occurrences(F.col(c), p, prefix).alias(f"{c}_{i}") for i, p in enumerate(terms) for c in COLUMNS])
    return _ranked(tf, docs, len(terms), limit, offset, exact_column)


def search_stored(index_: DataFrame, sizes: DataFrame, query: str, limit: int | None = LIMIT, offset: int = 0, prefix: bool = False, exact_column: bool = False) -> DataFrame:
    """What search() gives, from postings() and lengths() that were written before: only the query's words are read.

    A phrase stands where the positions of its words, each less its place in the phrase, meet.
    """
    terms = phrases(query)
    if not terms:
        return _nothing(sizes)
    words = sorted({w for p in terms for w in p})
    wanted = F.col("term").isin(words)
    if prefix:
        wanted = reduce(lambda a, b: a | b, [F.col("term").startswith(p[-1]) for p in terms], wanted)
    else:
        places = index_.sparkSession.createDataFrame([(w,) for w in words], "term STRING").select(bucket_of(F.col("term"))).distinct().collect()
        wanted = F.col("bucket").isin([r[0] for r in places]) & wanted
    found = index_.where(wanted)
    none = F.array().cast("array<int>")

    def positions(word: str, column: str, last: bool) -> Column:
        fits = F.col("term").startswith(word) if prefix and last else F.col("term") == word
        return F.flatten(F.collect_list(F.when(fits & (F.col("col") == column), F.col("positions"))))

    def count(i: int, p: list[str], c: str) -> Column:
        back = lambda k: lambda x: x - k
        shifted = [F.transform(F.coalesce(f"w_{c}_{i}_{k}", none), back(k)) for k in range(len(p))]
        return F.size(reduce(F.array_intersect, shifted)) if len(p) > 1 else F.size(F.coalesce(f"w_{c}_{i}_0", none))

    each = [(i, p, c) for i, p in enumerate(terms) for c in COLUMNS]
    whole = found.groupBy("id").agg(*[positions(w, c, k == len(p) - 1).alias(f"w_{c}_{i}_{k}") for i, p, c in each for k, w in enumerate(p)])
    tf = whole.select("id", *[count(i, p, c).alias(f"{c}_{i}") for i, p, c in each]).join(sizes, "id")
    return _ranked(tf, sizes, len(terms), limit, offset, exact_column)


def _nothing(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.lit(0.0).alias("score"), F.lit("qname").alias("matched"), F.lit(0).cast("long").alias("total")).limit(0)


def _ranked(tf: DataFrame, docs: DataFrame, terms: int, limit: int | None, offset: int, exact_column: bool) -> DataFrame:
    """The page of tf (id, len, and of each column and term how often it stands there); docs (id, len) are all there are."""
    whole = lambda i: reduce(lambda a, b: a + b, [F.col(f"{c}_{i}") for c in COLUMNS])
    any_hit = reduce(lambda a, b: a | b, [whole(i) > 0 for i in range(terms)])
    counts = tf.agg(*[F.count_if(whole(i) > 0).alias(f"df{i}") for i in range(terms)], F.count_if(any_hit).alias("total"))
    tf = tf.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg")))).crossJoin(F.broadcast(counts))  # one row each
    score = F.lit(0.0)
    for i in range(terms):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        f = whole(i).cast("double")
        score = score + idf * (f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg"))))

    def told(c: str) -> Column:
        first = F.col(f"{c}_0") > 0
        rest = [(F.col(f"{c}_{i}") if exact_column else whole(i)) > 0 for i in range(1, terms)]
        return reduce(lambda a, b: a | b, [first, *rest])

    matched = F.when(told("body"), F.lit("body")).when(told("comment"), F.lit("comment")).otherwise(F.lit("qname"))
    hits = tf.where(any_hit).select("id", score.alias("score"), matched.alias("matched"), "total")
    return hits if limit is None else hits.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def suggestions(nodes: DataFrame, term: str, distance: int = DISTANCE, cap: int = SUGGESTIONS) -> DataFrame:
    """(id, qname, distance): the nearest real nodes by edit distance of the local name, at most cap."""
    d = F.levenshtein(F.lower(local_name(F.col("qname"))), F.lit(term.lower()), distance)
    rows = nodes.where("NOT missing AND NOT excluded").select("id", "qname", d.alias("distance")).where("distance >= 0")
    return rows.orderBy("distance", "qname", "id").limit(cap)


def deletions(word: Column, distance: int = DISTANCE) -> Column:
    """What is left of a word's leading letters with up to so many of them deleted.

    Words within an edit distance share one of these: each edit leaves at most one leading letter of either unmatched.
    """
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    last = F.array(F.substring(word, 1, LEADING))
    found = last
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(last, less)))
        found = F.array_union(found, last)
    return found


def lead(qname: Column) -> Column:
    """The leading letters that a name is found by."""
    return F.substring(F.lower(local_name(qname)), 1, LEADING)


def typo_index(nodes: DataFrame) -> DataFrame:
    """(bucket, part, lead): the leading letters of real nodes' names by their deletions, each once; worth storing.

    It holds no ids: names are met by their leads, so what is stored doesn't repeat a node for each deletion, and leads that
    no name has any more find nothing.
    """
    leads = nodes.where("NOT missing AND NOT excluded").select(lead(F.col("qname")).alias("lead"))
    leads = leads.repartition(_tasks(leads), "lead").distinct()
    parts = leads.select("lead", F.explode(deletions(F.col("lead"))).alias("part"))
    return parts.select(bucket_of(F.col("part")).alias("bucket"), "part", "lead")


def suggest(index_: DataFrame, nodes: DataFrame, terms: DataFrame, distance: int = DISTANCE, cap: int = SUGGESTIONS) -> DataFrame:
    """(term, id, qname, distance): for each of terms (term) what suggestions() gives, by typo_index() of the nodes.

    Terms meet names that share a deletion; distances are worked out for those alone. distance is at most DISTANCE.
    """
    asked = terms.select("term").where("term IS NOT NULL").distinct()
    asked = asked.select("term", F.explode(deletions(F.lower("term"))).alias("part")).withColumn("bucket", bucket_of(F.col("part")))
    leads = asked.join(index_, ["bucket", "part"]).select("term", "lead").distinct()
    real = nodes.where("NOT missing AND NOT excluded").select(lead(F.col("qname")).alias("lead"), "id", "qname")
    met = leads.join(real, "lead").select("term", "id", "qname")
    rows = met.withColumn("distance", F.levenshtein(F.lower(local_name(F.col("qname"))), F.lower("term"), distance)).where("distance >= 0")
    nth = F.row_number().over(Window.partitionBy("term").orderBy("distance", "qname", "id"))
    return rows.withColumn("__n", nth).where(F.col("__n") <= cap).drop("__n")

"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

Shingles are five words in a row. A shingle's weight in a text is how often it stands there, times its inverse document
frequency, with df(s) the number of texts that have it and N the number of texts with words:

    idf(s) = 2 - ln df(s) / ln N

from 2 for a shingle of one text to 1 for one of all texts. Document frequencies of all shingles of all texts are counted
in a table of fixed size, by hash. A place of the table also counts what else falls there, about the mean m of all places;
so df(s) is what it counts less m + 3 sqrt(m), and at least 1. Where there are far fewer shingles than places that is the
true count; with more, shingles of less than about 3 sqrt(m) texts pass for ones of a single text (33 texts of 256,000 in
the test tables, 250 of 15 million), and all more frequent ones have their own weights.

Similarity is the weighted Jaccard similarity, the sum of the smaller weights over the sum of the larger ones. It is
computed exactly for every pair that sampling proposes: texts that agree in all samples of a band are in one bucket.
Texts with the same words are one from the start. In a bucket all others are compared with the one of the smallest id.
That settles groups of copies. Where some aren't similar to it, as where texts share a passage only, the bucket's texts are
dealt anew by the rarest of their shingles, as many as two similar texts must have one in common of; so a passage of many
texts brings none of them together. What meets there is compared with the first of it, for some rounds, and what is of
several classes after that tile by tile, a tile being two parts of bounded size, dealt by a hash, that gives a few links
that connect what its similar texts connect. Pairs are neither listed nor cut off.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.capfilters import spanning
from lattica.llm.common import map_batches, map_groups, slices, small_batches, staged, text_column
from lattica.llm.words import Shingles, fingerprints, mix, shingles_of, words_of
from lattica.plans.components import components
from lattica.plans.cut import discard

THRESHOLD, BANDS, ROWS = 0.8, 12, 4
#: Rounds in which texts that failed their bucket's first meet the first of those that they share rare items with.
ROUNDS = 1
#: Places of the table of document frequencies, a power of two; parts that it is summed in, and tables summed at once.
PLACES, PARTS, FAN_IN = 1 << 21, 64, 64
#: Texts on a side of a tile, in expectation, and shared shingles that are compared at once.
TILE, WIDTH = 256, 4096
_CHUNK = 4096
_U = np.uint64


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return 2 - np.minimum(1, np.log(df) / math.log(max(n, 2)))


def places_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(65 - PLACES.bit_length())).astype(np.int64)


class Weights:
    """The inverse document frequencies of n texts, from the counts of the table's places.

    Frequencies are held to an eighth of an octave, in a byte a place.
    """

    def __init__(self, counts: np.ndarray, n: int) -> None:
        mean = counts.sum() / len(counts)
        df = np.maximum(1, counts - math.floor(mean + 3 * math.sqrt(mean)))
        self.eighths = np.rint(8 * np.log2(df)).clip(0, 255).astype(np.uint8)
        self.rarity = np.rint(16 * np.log2(counts + 1.0)).clip(0, 255).astype(np.uint8)  # with all that a place counts
        self.idf = idf(np.exp2(np.arange(256) / 8), n)

    def of(self, s: Shingles) -> np.ndarray:
        return s.times * self.idf[self.eighths[places_of(s.hashes)]]


class Sampler:
    """Improved consistent weighted sampling: k samples (shingle, level) of a weighted set, equal with the similarity.

    A shingle's random r and c ~ Gamma(2, 1) and b ~ U(0, 1) are read off a hash of the shingle and the sample's number,
    so all workers draw alike. With t = floor(ln w / r + b) and ln y = r (t - b), the sample is the shingle with the
    least ln c - ln y - r, at level t.
    """

    def __init__(self, k: int) -> None:
        rng = np.random.default_rng(7_919)
        self.seeds = (rng.integers(0, 1 << 63, k, np.uint64) << _U(1)) | _U(1)
        # Quantiles of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = u.
        u = (np.arange(4096) + 0.5) / 4096
        x = np.ones_like(u)
        for _ in range(60):
            x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x) + 1e-12))
        self.gamma = x.astype(np.float32)

    def samples(self, hashes: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each (sample, shingle): the value to minimise, and the sample's own hash."""
        x = mix(hashes[None, :] * self.seeds[:, None])
        r = self.gamma[(x & _U(4095)).astype(np.int32)]
        b = ((x >> _U(12)) & _U(4095)).astype(np.float32) * np.float32(1 / 4096) + np.float32(0.5 / 4096)
        u = (((x >> _U(24)) & _U(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * (((x >> _U(44)) & _U(0xFFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-40)
        t = np.floor(log_w[None, :] / r + b)
        return np.log(-np.log(u)) - r * (t - b) - r, t

    def of_text(self, hashes: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        """The k samples of one text, by parts if it is long."""
        least = np.full(len(self.seeds), np.inf, np.float32)
        out = np.zeros(len(self.seeds), _U)
        k = np.arange(len(self.seeds))
        for a in range(0, len(hashes), _CHUNK):
            value, t = self.samples(hashes[a : a + _CHUNK], log_w[a : a + _CHUNK])
            at = value.argmin(1)
            better = value[k, at] < least
            least = np.where(better, value[k, at], least)
            out = np.where(better, hashes[a + at] + mix(t[k, at].astype(np.int64).view(_U) + _U(1)), out)
        return out

    def bands(self, s: Shingles, weights: np.ndarray, rows: int) -> np.ndarray:
        """(texts, bands) hashes; texts without shingles have no meaning in it."""
        log_w = np.log(weights).astype(np.float32)
        k = len(self.seeds)
        out = np.zeros((len(s.edges) - 1, k), _U)
        e = s.edges
        i = 0
        while i < len(out):  # short texts share a matrix
            j = i + 1
            while j < len(out) and e[j + 1] - e[i] <= _CHUNK:
                j += 1
            if e[j] - e[i] > _CHUNK or j == i + 1:
                if e[j] > e[i]:
                    out[i] = self.of_text(s.hashes[e[i] : e[j]], log_w[e[i] : e[j]])
            else:
                h = s.hashes[e[i] : e[j]]
                value, t = self.samples(h, log_w[e[i] : e[j]])
                every = np.arange(k)
                for d in range(i, j):
                    if e[d + 1] > e[d]:
                        at = value[:, e[d] - e[i] : e[d + 1] - e[i]].argmin(1) + (e[d] - e[i])
                        out[d] = h[at] + mix(t[every, at].astype(np.int64).view(_U) + _U(1))
            i = j
        total = np.zeros((len(out), k // rows), _U)
        for r in range(rows):
            total = mix(total + out[:, r::rows])
        return total


def similarity(a: Shingles, wa: np.ndarray, b: Shingles, wb: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts; 0 if both have no shingles."""
    _, x, y = np.intersect1d(a.hashes, b.hashes, assume_unique=True, return_indices=True)
    low = float(np.minimum(wa[x], wb[y]).sum())
    total = float(wa.sum() + wb.sum()) - low
    return low / total if total else 0.0


def document_frequencies(docs: DataFrame, text_col: str = "__text") -> tuple[np.ndarray, int]:
    """The counts of the table's places, and the number of texts with words.

    Each task sums its own table; tables are summed part by part, FAN_IN at a time, so what a task holds is bounded, and
    what reaches the driver is one table.
    """

    def count(batches):
        total, held, waiting, texts = np.zeros(PLACES, np.int32), [], 0, 0
        for batch in slices(batches):
            w = words_of(batch.column(0))
            held.append(places_of(shingles_of(w).hashes))
            waiting += len(held[-1])
            texts += int((w.count > 0).sum())
            if waiting > PLACES:
                total += np.bincount(np.concatenate(held), minlength=PLACES).astype(np.int32)
                held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=PLACES).astype(np.int32)
        rows = [(i, x.astype("<i8").tobytes()) for i, x in enumerate(np.split(total, PARTS)) if x.any()] + [(-1, np.array([texts], "<i8").tobytes())]
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["part", "counts"])

    def add(t: pa.Table) -> pa.RecordBatch:
        total = sum(np.frombuffer(x, "<i8") for x in t["counts"].to_pylist())
        return pa.RecordBatch.from_arrays([t["part"].combine_chunks().slice(0, 1), t["task"].combine_chunks().slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "task", "counts"])

    tables = staged(docs.select(text_col).mapInArrow(count, "part int, counts binary").withColumn("task", F.spark_partition_id()))
    left = (tables.agg(F.max("task")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // FAN_IN)
        more = map_groups(tables.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")), ["part", "task"], add, "part int, task int, counts binary")
        old, tables = tables, staged(more)
        discard(old)
    out, n = np.zeros((PARTS, PLACES // PARTS), np.int64), 0
    for r in tables.collect():
        if r.part < 0:
            n = int(np.frombuffer(r.counts, "<i8")[0])
        else:
            out[r.part] = np.frombuffer(r.counts, "<i8")
    discard(tables)
    return out.ravel(), n


def _verified(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float, tile: int) -> DataFrame:
    """(a, b) of those pairs (a, b, n) that are similar; texts has (id, text), n tells how many pairs share b at most.

    Texts meet their b in groups of bounded size: a b of many pairs is dealt to parts, and its text goes to each.
    """
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") * 4 / tile)).cast("int"))
    many = dealt.join(texts.withColumnRenamed("id", "a"), "a").select("b", "part", "a", "text")
    one = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("id", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")

    def check(t: pa.Table) -> pa.RecordBatch | None:
        first = pc.is_null(t["a"])
        s = shingles_of(words_of(t.filter(first)["text"]))
        near = []
        for part in slices(t.filter(pc.invert(first)).to_batches()):
            x = shingles_of(words_of(part.column("text")))
            w, to, wf = weights.of(x), np.minimum(np.searchsorted(s.hashes, x.hashes), len(s.hashes) - 1), weights.of(s)
            low = np.where(s.hashes[to] == x.hashes, np.minimum(w, wf[to]), 0)
            of = np.repeat(np.arange(part.num_rows), np.diff(x.edges))
            low, own = (np.bincount(of, y, part.num_rows) for y in (low, w))
            near.append(part.column("a").filter(pa.array(low >= threshold * (own + wf.sum() - low))))
        out = pa.concat_arrays(near)
        return pa.RecordBatch.from_arrays([out, pa.array(np.full(len(out), t["b"][0].as_py(), np.int64))], names=["a", "b"])

    return staged(map_groups(many.unionByName(one), ["b", "part"], check, "a long, b long"))


def _plausible(a: str, b: str, threshold: float) -> Column:
    """Weights of the two texts may reach the threshold: similarity is at most their ratio."""
    return F.least(a, b) >= (threshold - 1e-9) * F.greatest(a, b)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.int64()))


def _items(s: Shingles, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, weight): a shingle that stands n times in a text is n items, so that shared items are the smaller count."""
    each = weights.of(s) / s.times
    text = np.repeat(np.arange(len(s.edges) - 1), np.diff(s.edges))
    nth = np.arange(int(s.times.sum())) - np.repeat(np.cumsum(s.times) - s.times, s.times)
    item = np.repeat(s.hashes, s.times) + np.where(nth > 0, mix(nth.astype(_U)), _U(0))
    return np.repeat(text, s.times), item, np.repeat(each, s.times)


def similarities(a: Shingles, b: Shingles, weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of each text of a with each of b."""
    (ta, ia, wa), (tb, ib, wb) = _items(a, weights), _items(b, weights)
    na, nb = len(a.edges) - 1, len(b.edges) - 1
    shared = np.intersect1d(ia, ib)
    low = np.zeros((na, nb))
    for at in range(0, len(shared), WIDTH):
        part = shared[at : at + WIDTH]
        sides = []
        for t, i, w, n in ((ta, ia, wa, na), (tb, ib, np.ones(len(ib)), nb)):
            place = np.minimum(np.searchsorted(part, i), len(part) - 1)
            hit = part[place] == i
            m = np.zeros((n, len(part)))
            m[t[hit], place[hit]] = w[hit]
            sides.append(m)
        low += sides[0] @ sides[1].T
    total = np.bincount(ta, wa, na)[:, None] + np.bincount(tb, wb, nb) - low
    return np.divide(low, total, out=np.zeros_like(low), where=total > 0)


def _prefix(s: Shingles, weights: Weights, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(text, item): the items by which a text meets every one that is similar to it.

    Items go by what their places count, so rare ones first, then by hash, in all texts alike. Similar texts share items of
    a threshold's part of either's weight; so the first item that they share has at most the rest of the weight before it.
    """
    text, item, w = _items(s, weights)
    order = np.lexsort((item, np.repeat(weights.rarity[places_of(s.hashes)], s.times), text))
    text, item, w = text[order], item[order], w[order]
    whole = np.bincount(text, w, len(s.edges) - 1)
    before = np.cumsum(w) - w - (np.cumsum(whole) - whole)[text]
    keep = before <= (1 - threshold + 1e-9) * whole[text]
    return text[keep], item[keep]


def _open_sets(rows: DataFrame) -> DataFrame:
    """(token, n): of tokens whose texts (rep, c) are of several classes, one for each set of texts."""
    own = F.xxhash64("rep")
    sets = rows.groupBy("token").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(own).alias("x"), F.sum(F.shiftright(own, 32)).alias("y")).where("low < high")
    return staged(sets.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token", "n"))


def _failed_links(buckets: DataFrame, failed: DataFrame, texts: DataFrame, links: DataFrame, weights: Weights, threshold: float, tile: int) -> DataFrame:
    """Links (a, b) between texts of buckets in which some weren't similar to the bucket's first.

    Such buckets are of texts that share a passage, so their texts are dealt anew, by the rare items that similar ones must
    have in common; a passage of many texts isn't among them. Sets that are of one class already are left out. In each of
    the others all are compared with the first. Sets that are of several classes after that are compared in tiles: as one
    where they and what they overlap with have few texts, so that these aren't met in each set again, and else each by itself.
    """
    some = buckets.join(failed.select("band", "h").distinct(), ["band", "h"], "left_semi").select("rep", "w").distinct()
    near = links.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("c"))  # enough to leave out most of what is linked
    members = staged(some.join(near, "rep", "left").select("rep", "w", F.coalesce("c", "rep").alias("c")))

    def tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, item = _prefix(shingles_of(words_of(batch.column("text"))), weights, threshold)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text)), pa.array(item.view(np.int64))], names=["rep", "token"])

    met = staged(map_batches(texts.join(members.select(F.col("rep").alias("id")), "id").select("id", "text"), tokens, "rep long, token long"))
    left = met.join(members, "rep")
    found = links.limit(0)
    for _ in range(ROUNDS):
        sets = _open_sets(left)
        if sets.isEmpty():
            discard(members, met)
            return found
        left = staged(left.join(sets.select("token"), "token"))
        first = staged(left.groupBy("token").agg(F.min_by(F.struct("rep", "w", "c"), "rep").alias("first")).select("token", F.col("first.rep").alias("b"), F.col("first.w").alias("lw"), F.col("first.c").alias("lc")))
        other = left.join(first, "token").where("rep <> b")
        pairs = other.where((F.col("c") != F.col("lc")) & _plausible("w", "lw", threshold)).select(F.col("rep").alias("a"), "b").distinct()
        pairs = staged(pairs.join(pairs.groupBy("b").agg(F.count("*").alias("n")), "b"))
        found = staged(found.unionByName(_verified(pairs, texts, weights, threshold, tile)))
        left = other.select("token", "rep", "w", "c")
    classes = components(links.unionByName(found).toDF("u", "v")).select(F.col("node").alias("rep"), F.col("component").alias("c"))
    left = left.drop("c").join(classes, "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    sets = _open_sets(left)
    if not sets.isEmpty():
        left = staged(left.join(sets, "token").select("token", "n", "rep", "c"))
        first = left.groupBy("token").agg(F.min("rep").alias("first"))
        family = components(left.join(first, "token").select(F.col("rep").alias("u"), F.col("first").alias("v")))
        size = family.groupBy("component").agg(F.count("*").alias("size"))
        family = staged(family.join(size, "component").select(F.col("node").alias("rep"), "component", "size"))
        rows = left.join(family, "rep")
        whole = rows.where(F.col("size") <= tile).select(F.lit(True).alias("whole"), F.col("component").alias("token"), "rep", "c", F.lit(1).alias("parts")).distinct()
        each = rows.where(F.col("size") > tile).select(F.lit(False).alias("whole"), "token", "rep", "c", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
        found = found.unionByName(_tiled_links(whole.unionByName(each), texts, weights, threshold))
    discard(members, met)
    return found


def _tiled_links(rows: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links between similar texts of a set (whole, token, rep, c, parts) and of different classes, two parts at a time."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.select("whole", "token", "rep", "c", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(texts, F.col("rep") == F.col("id")).drop("id")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        x, y = t.filter(pc.equal(t["part"], i)), t.filter(pc.equal(t["part"], j))
        open_ = x["c"].to_numpy()[:, None] != y["c"].to_numpy()
        if not open_.any():
            return None
        ok = open_ & (similarities(*(shingles_of(words_of(z["text"])) for z in (x, y)), weights) >= threshold)
        u, v = spanning(ok, x["rep"].to_numpy(), y["rep"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["a", "b"]) if len(u) else None

    return staged(map_groups(dealt, ["whole", "token", "i", "j"], compare, "a long, b long"))


def _key() -> Column:
    """Tells rows apart by id and text, together with the id."""
    return F.xxhash64("id", "__text")


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, n_words, class_id, best) for each row of docs.

    A class is a set of texts that are linked, directly or through others; class_id is the smallest id of its rows, null
    if none has one. Texts link if their similarity reaches the threshold, or if they have the same words in the same
    order; a shared id links nothing. best tells the rows whose id and key (a hash of id and text) are the class's first,
    by id with null ones last, then fingerprint. Texts without any word, null ones among them, link with nothing; their
    rows are all best.

    Texts are shuffled once, those of proposed pairs once more in each round; document frequencies are a table whose size
    does not depend on the number of texts. Links and classes stay distributed.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_column(text_col).alias("__text"))
    weights = Weights(*document_frequencies(base))
    sampler = Sampler(bands * rows)

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = words_of(batch.column("__text"))
        s = shingles_of(w)
        each = weights.of(s)
        total = np.zeros(len(each) + 1)
        np.cumsum(each, out=total[1:])
        band = sampler.bands(s, each, rows).view(np.int64)
        x, y = fingerprints(w)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.array(w.count), pa.array(x), pa.array(y), pa.array(total[s.edges[1:]] - total[s.edges[:-1]]), _lists(band)],
            names=["id", "key", "n_words", "x", "y", "w", "bands"],
        )

    signed = staged(map_batches(base.withColumn("key", _key()), sign, "id long, key long, n_words long, x long, y long, w double, bands array<long>"))
    usable = signed.where("n_words > 0")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "x", "y", "key")
    first = usable.groupBy("x", "y").agg(F.min(order).alias("at"), F.first("bands").alias("bands"), F.max("w").alias("w"))
    # A text's number tells it from others of its id; it is written once and only compared for being equal or less.
    first = staged(first.withColumn("rep", F.monotonically_increasing_id()))
    buckets = staged(first.select("rep", "w", F.coalesce("at.id", F.lit(2**63 - 1)).alias("low"), F.posexplode("bands").alias("band", "h")))
    leaders = staged(buckets.groupBy("band", "h").agg(F.min_by(F.struct("rep", "w"), "low").alias("leader"), F.count("*").alias("n")).where("n > 1").select("band", "h", F.col("leader.rep").alias("leader"), F.col("leader.w").alias("lw"), "n"))
    starred = staged(buckets.drop("low").join(leaders, ["band", "h"]).where("rep <> leader"))
    members = starred.select("rep").union(starred.select("leader")).distinct().join(first.select("rep", F.col("at.id").alias("of"), F.col("at.key").alias("key")), "rep")
    # A merge join at every size: the texts of all documents are shuffled once, here. Repeated rows give one text.
    texts = base.select("id", "__text", _key().alias("key")).join(members.hint("merge"), "key").where(F.col("id").eqNullSafe(F.col("of")))
    texts = staged(texts.groupBy("key", "rep").agg(F.first("__text").alias("text")).select(F.col("rep").alias("id"), "text"))
    close = starred.where(_plausible("w", "lw", threshold)).groupBy(F.col("rep").alias("a"), F.col("leader").alias("b")).agg(F.max("n").alias("n"))
    links = _verified(close, texts, weights, threshold, tile)
    failed = staged(starred.join(links.select(F.col("a").alias("rep"), F.col("b").alias("leader")), ["rep", "leader"], "left_anti").select("band", "h", "rep", "w", "leader", "lw"))
    if failed.take(1):
        links = links.unionByName(_failed_links(buckets, failed, texts, links, weights, threshold, tile))
    discard(buckets, leaders, starred, texts, failed)
    linked = staged(components(links.toDF("u", "v")).join(first.select(F.col("rep").alias("node"), "at"), "node"))
    lowest = linked.groupBy("component").agg(F.min("at").alias("best"))
    of = linked.select(F.col("node").alias("rep"), "component").join(lowest, "component").select("rep", "best")
    labels = first.select("x", "y", "rep", "at").join(of, "rep", "left").select("x", "y", F.coalesce("best", "at").alias("best"))
    worded = signed.where("n_words > 0").select("id", "key", "n_words", "x", "y").join(labels, ["x", "y"])
    own = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key"))
    worded = worded.select("id", "key", "n_words", F.col("best.id").alias("class_id"), own.alias("best"))
    # Rows without words take no part in the join, where they would all have one key.
    return worded.unionByName(signed.where("n_words = 0").select("id", "key", "n_words", F.col("id").alias("class_id"), F.lit(True).alias("best")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_words, kept) for each row of docs.

    class_id is that of text_classes; kept tells the row whose id that is. Repeated rows are in one class, and each is kept
    if its id is the class's; texts that share an id and aren't linked otherwise are apart, each with its own class. Rows
    with a null id link others, but have a null class and are kept; text_classes tells which of them repeat others.
    """
    found = text_classes(docs, threshold, bands, rows, tile, id_col, text_col)
    class_id = F.when(F.col("id").isNotNull(), F.col("class_id"))
    return found.select(F.col("id").alias(id_col), class_id.alias("class_id"), "n_words", F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept"))

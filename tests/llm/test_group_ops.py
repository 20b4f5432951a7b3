import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.llm import capfilters, minhash, mixing, sharding, topk, words
from lattica.llm.queries import ORACLE_SQL
from lattica.plans.components import components
from tests.llm.helpers import DOCS, hostile, prose, same_as_sql


def classes_of(n, links):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(300, 420)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 3)]
    want = classes_of(700, [x for x in links if None not in x])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u LONG, v LONG")).collect()}
    ends = {i for a, b in links if a != b and None not in (a, b) for i in (a, b)}
    assert got == {i: want[i] for i in ends}
    assert components(spark.createDataFrame([], "u LONG, v LONG")).count() == 0


def test_words_and_shingles():
    import re

    texts = [None, "", "One two", "a b c d e f a b c d e", "É! x9-y é" * 3, "Ünï  \n" * 7]
    w = words.words_of(pa.array(texts, pa.string()))
    plain = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert w.count.tolist() == [len(p) for p in plain]
    flat = [x for p in plain for x in p]
    seen = {}
    for h, x in zip(w.hashes.tolist(), flat, strict=True):
        assert seen.setdefault(h, x) == x
    assert len(seen) == len(set(flat))
    s = words.shingles_of(w)
    for i, p in enumerate(plain):
        grams = Counter(tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))) if p else Counter()
        assert sorted(s.times[s.edges[i] : s.edges[i + 1]].tolist()) == sorted(grams.values())
    a, b = words.fingerprints(w)
    assert (a[0], b[0]) == (0, 0) and len({*zip(a.tolist()[2:], b.tolist()[2:], strict=True)}) == 4


def plain_similarity(texts):
    """Weighted Jaccard similarity by true document frequencies, straight from the definition."""
    import re

    def shingles(t):
        p = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        return Counter(tuple(p[k : k + 5]) for k in range(max(1, len(p) - 4))) if p else Counter()

    sets = {t: shingles(t) for t in set(texts)}
    df, n = Counter(), sum(bool(sets[t]) for t in texts)
    for t in texts:
        df.update(sets[t].keys())

    def near(a, b):
        a, b = ({g: k * (2 - math.log(df[g]) / math.log(n)) for g, k in sets[x].items()} for x in (a, b))
        low = sum(min(w, b[g]) for g, w in a.items() if g in b)
        total = sum(a.values()) + sum(b.values()) - low
        return low / total if total else 0.0

    return near


def near_texts():
    base = prose(10, 120).split()
    rows = [(i, prose(100 + i, 80 + i)) for i in range(40)]
    rows += [(100 + i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(range(3, 118, 5))]
    rows += [(200, prose(100, 80)), (200, prose(100, 80)), (201, prose(101, 81).upper() + "!!"), (300, None), (301, ""), (302, "?!"), (None, prose(100, 80)), (303, "two words"), (304, "Two, words"), (305, "two words more")]
    shared = prose(55, 60)
    rows += [(400 + i, shared + " " + prose(500 + i, 60)) for i in range(30)]
    return rows + [(900, prose(77, 20000)), (901, prose(77, 19990))]


def test_near_duplicates_against_all_pairs(spark):
    rows = near_texts()
    got = minhash.near_duplicates(spark.createDataFrame(hostile(rows), DOCS)).collect()
    assert len(got) == len(rows)
    texts = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda x: x[0])
    near = plain_similarity([t for _, t in rows])
    links = [(i, j) for i in range(len(texts)) for j in range(i) if near(texts[i][1], texts[j][1]) >= 0.8]
    want = classes_of(len(texts), links)
    low = defaultdict(lambda: math.inf)
    for k, (i, _) in enumerate(texts):
        low[want[k]] = min(low[want[k]], i)
    expected = {i: low[want[k]] for k, (i, _) in enumerate(texts)} | {i: i for i in (300, 301)}
    for r in got:
        assert r.class_id == (None if r.doc_id is None else expected[r.doc_id])
        assert r.kept == (r.doc_id is None or r.class_id == r.doc_id)
    assert len({r.class_id for r in got if r.doc_id is not None and 100 <= r.doc_id < 130}) == 1
    assert len({r.class_id for r in got if r.doc_id is not None and 400 <= r.doc_id < 430}) == 30


def test_second_round_finds_links_past_the_leader(spark):
    """Texts of a chain: each is near the next, few are near the first."""
    base = prose(33, 200).split()
    rows = []
    for i in range(12):
        rows.append((i, " ".join(base)))
        for k in range(3):
            base[(i * 31 + k * 7) % 200] = f"c{i}x{k}"
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    near = plain_similarity([t for _, t in rows])
    want = classes_of(12, [(i, j) for i in range(12) for j in range(i) if near(rows[i][1], rows[j][1]) >= 0.8])
    assert len(set(want)) < 12
    assert got == dict(enumerate(want))


def passage_texts(n, seed=0):
    """n texts of which all share a passage of half their length, and a near copy of every fifth."""
    shared, rows = prose(7_000 + seed, 60), []
    for i in range(n):
        own = prose(8_000 + 100 * seed + i, 64).split()
        rows.append((i, f"{shared} {' '.join(own)}"))
        if i % 5 == 0:
            rows.append((10_000 + i, f"{shared} {' '.join([*own[:30], 'other', *own[31:]])}"))
    return rows


def test_a_bucket_that_a_passage_fills_is_settled_without_tiles(spark, monkeypatch):
    met = []
    real = minhash._verified
    monkeypatch.setattr(minhash, "_tiled_links", lambda *a: 1 / 0)
    monkeypatch.setattr(minhash, "_verified", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    seen = []
    for n in (60, 120):
        met.clear()
        # One sample a band, so that the passage brings nearly all texts into one bucket.
        got = minhash.near_duplicates(spark.createDataFrame(passage_texts(n), "doc_id LONG, text STRING"), bands=24, rows=1).collect()
        assert {r.doc_id: r.class_id for r in got} == {i: i % 10_000 for i, _ in passage_texts(n)}
        seen.append(sum(met[1:]))  # behind the first, which meets the buckets' first texts
    assert seen[1] < 3 * max(1, seen[0])  # all pairs would be four times as many


def test_what_the_first_round_leaves_is_compared_in_tiles(spark):
    base = prose(91, 200).split()
    rows = []
    for i in range(12):  # a ring of versions, each near the next ones only
        rows.append((i, " ".join(base[: 200 - 12 * i] + prose(92, 400).split()[: 12 * i])))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING"), bands=40, rows=1, tile=4).collect()
    near = plain_similarity([t for _, t in rows])
    want = classes_of(12, [(i, j) for i in range(12) for j in range(i) if near(rows[i][1], rows[j][1]) >= 0.8])
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(want))


def test_similar_texts_share_an_item_of_their_prefixes():
    texts = [t for _, t in near_texts() if t and t.strip("?!")]
    s = words.shingles_of(words.words_of(pa.array(texts)))
    weights = minhash.Weights(np.bincount(minhash.places_of(s.hashes), minlength=minhash.PLACES), len(texts))
    for threshold in (0.5, 0.8, 0.95):
        text, item = minhash._prefix(s, weights, threshold)
        own = [set(item[text == i].tolist()) for i in range(len(texts))]
        high = minhash.similarities(s, s, weights) >= threshold
        assert all(own[i] & own[j] for i, j in zip(*np.nonzero(high), strict=True)) and high.sum() >= len(texts)
        assert sum(map(len, own)) < (1.1 - threshold) * len(minhash._items(s, weights)[0]) + 2 * len(texts)


def test_similarities_of_many_are_those_of_each(monkeypatch):
    monkeypatch.setattr(minhash, "WIDTH", 7)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(25)]
    weights = minhash.Weights(np.bincount(minhash.places_of(words.shingles_of(words.words_of(pa.array(texts))).hashes), minlength=minhash.PLACES), 25)
    one = [words.shingles_of(words.words_of(pa.array([t]))) for t in texts]
    a, b = (words.shingles_of(words.words_of(pa.array(x))) for x in (texts[:10], texts[10:]))
    want = [[minhash.similarity(x, weights.of(x), y, weights.of(y)) for y in one[10:]] for x in one[:10]]
    assert np.allclose(minhash.similarities(a, b, weights), want)


def test_document_frequencies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "FAN_IN", 3)
    texts = [prose(i % 7, 30) for i in range(50)] + [None, "", "a b"]
    counts, n = minhash.document_frequencies(spark.createDataFrame([(t,) for t in texts], "__text STRING").repartition(11))
    own = Counter(h for t in texts if t for h in words.shingles_of(words.words_of(pa.array([t]))).hashes.tolist())
    want = Counter()
    for h, k in own.items():
        want[int(minhash.places_of(np.array([h], np.uint64))[0])] += k
    assert n == 51 and {i: int(counts[i]) for i in np.flatnonzero(counts)} == dict(want)
    weights = minhash.Weights(counts, n)
    one = words.shingles_of(words.words_of(pa.array([prose(0, 30)])))
    assert np.allclose(weights.of(one), one.times * (2 - math.log(own[int(one.hashes[0])]) / math.log(n)), atol=0.02)
    assert minhash.document_frequencies(spark.createDataFrame([], "__text STRING"))[1] == 0


def test_full_tables_tell_frequent_shingles_from_the_rest():
    rng = np.random.default_rng(9)
    counts = rng.poisson(100, minhash.PLACES)
    counts[:4] += (200, 2_000, 20_000, 100_000)
    got = minhash.Weights(counts, 250_000)
    assert (got.idf[got.eighths[4:]] == 2).mean() > 0.997
    assert np.allclose(got.idf[got.eighths[1:4]], minhash.idf(np.array([2_000, 20_000, 100_000.0]), 250_000), atol=0.02)


def test_samples_agree_as_often_as_texts_are_similar():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 400, np.uint64)
    w = rng.choice([0.6, 1.0, 2.0, 3.0], 400)
    a, b = np.arange(300), np.arange(60, 400)
    wa, wb = w[a], w[b] * rng.choice([0.5, 1.0], len(b))
    sampler = minhash.Sampler(4000)
    sa, sb = (sampler.of_text(h[i], np.log(x).astype(np.float32)) for i, x in ((a, wa), (b, wb)))
    da, db = dict(zip(a, wa)), dict(zip(b, wb))
    low = sum(min(da.get(i, 0), db.get(i, 0)) for i in range(400))
    true = low / (wa.sum() + wb.sum() - low)
    assert abs((sa == sb).mean() - true) < 0.03


def test_embedding_links_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((1500, 32))
    v[100:130] = v[100] + 0.15 * rng.standard_normal((30, 32))
    v[200] = v[201]
    v[300] = 3 * v[301]
    v[400:700] = v[400] + 0.05 * rng.standard_normal((300, 32))
    rows = [(i, v[i].astype(np.float32).tolist(), 0, 5, 1.0) for i in range(1500)]
    rows += [(2000, None, 0, 5, 1.0), (2001, [0.0] * 32, 0, 5, 1.0), (2002, [float("nan")] * 32, 0, 5, 1.0), (2003, [None] * 32, 0, 5, 1.0), (2004, rows[100][1][:31], 0, 5, 1.0), (None, rows[5][1], 0, 5, 1.0), (5, rows[5][1], 0, 5, 1.0), (2005, [], 0, 5, 1.0)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>, label INT, n INT, v DOUBLE")
    got = capfilters.near_embeddings(df, 0.9).collect()
    assert len(got) == len(rows)
    x = np.array([r[1] for r in rows[:1500]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ok = x @ x.T >= 0.9
    ok[5] = ok[:, 5] = False
    np.fill_diagonal(ok, False)
    want = classes_of(1500, np.argwhere(ok).tolist())
    by = {r.vec_id: r for r in got if r.vec_id not in (None, 5)}
    found = sum(r.n_links for i, r in by.items() if i < 1500)
    assert found >= 0.98 * ok.sum()
    assert all(by[i].n_links <= ok[i].sum() for i in by if i < 1500)
    assert sum(by[i].component_id == want[i] for i in by if i < 1500) >= 1497
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2005))
    assert [r.n_links for r in got if r.vec_id == 5] == [1, 1]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]
    assert capfilters.near_embeddings(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [1.0, 0.0])], "vec_id LONG, embedding ARRAY<DOUBLE>")
    assert sorted(map(tuple, capfilters.near_embeddings(twice).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def at_cosine(rng, x, cosine):
    x = capfilters.unit_vectors(x)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    return cosine * x + math.sqrt(1 - cosine**2) * capfilters.unit_vectors(y)


def test_planted_embeddings_same_as_sql(spark, tmp_path):
    """Chains, dense groups, repeated vectors and pairs on either side of the threshold."""
    rng = np.random.default_rng(21)
    v = rng.standard_normal((900, 24))
    v[100:150] = at_cosine(rng, v[:50], 0.93)
    v[150:200] = at_cosine(rng, v[:50], 0.87)
    v[200:260] = at_cosine(rng, np.repeat(v[60:61], 60, 0), 0.97)
    for i in range(300, 312):
        v[i + 1] = at_cosine(rng, v[i : i + 1], 0.96)[0]
    rows = [(int(i), [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)]
    rows += [(5, rows[5][1], 2), (2000, [x * 3.0 for x in rows[7][1]], 0), (2001, [0.0] * 24, 0), (2002, None, 0), (2003, [None] * 24, 0), (2004, [float("nan")] * 24, 0), (2005, rows[9][1][:20], 0)]
    table = spark.createDataFrame(rows[:900] + rows[901:], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    found = capfilters.near_embeddings(table, 0.9)
    same_as_sql(spark, tmp_path, found, ORACLE_SQL["op2_embedding_dedup"], embeddings=table)
    assert found.where("n_links > 0").count() > 150


def test_planted_embedding_pairs_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    v = rng.standard_normal((3000, 64))
    for k, c in enumerate((0.9001, 0.91, 0.93, 0.96, 0.99)):
        v[1000 + 200 * k : 1200 + 200 * k] = at_cosine(rng, v[200 * k : 200 + 200 * k], c)
    v[2500:2900] = at_cosine(rng, np.repeat(v[2400:2401], 400, 0), 0.955)  # a group, larger than a tile below
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id LONG, embedding ARRAY<DOUBLE>")
    got = {r.vec_id: r for r in capfilters.near_embeddings(df, 0.9, tile=128).collect()}
    u = capfilters.unit_vectors(v)
    ok = u @ u.T >= 0.9
    np.fill_diagonal(ok, False)
    assert ok.sum() > 2000
    assert all(got[i].n_links <= ok[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * ok.sum()
    want = classes_of(3000, np.argwhere(ok).tolist())
    assert sum(got[i].component_id == want[i] for i in got) >= 2990


def test_filters_hold_recall_at_every_size_and_length():
    rng = np.random.default_rng(12)
    for n, dim in ((10, 64), (500, 64), (5_000, 64), (50_000, 64), (1_000_000, 64), (10_000_000, 64), (5_000, 3), (5_000, 9), (5_000, 300)):
        code = capfilters.Filters(n, dim, 0.9)
        for c in (0.9, 0.95, 0.99):
            x = rng.standard_normal((1500, dim))
            a, b = code.decode(capfilters.unit_vectors(x)), code.decode(at_cosine(rng, x, c))
            assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True)]) >= 0.98, (n, dim, c)


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(13)
    for dim in (1, 2, 7, 64):
        u = capfilters.unit_vectors(rng.standard_normal((300, dim)) ** 3)
        for t in (-0.5, 0.0, 0.9):
            maybe, sure = capfilters.maybe_near(capfilters.sketches(u), capfilters.sketches(u), t), capfilters.near(u, u, t)
            assert not (sure & ~maybe).any()
            assert dim < 64 or t < 0.9 or maybe.sum() < 1.1 * sure.sum()


def test_filters_decode_all_directions():
    code = capfilters.Filters(40_000, 16, 0.9)
    u = capfilters.unit_vectors(np.random.default_rng(2).standard_normal((50, 16)))
    cuts, every = list(zip(code.cuts[:-1], code.cuts[1:], strict=True)), []
    for turn, parts in code.codes:
        a, b = ((u @ turn)[:, i:j] @ c.T for (i, j), c in zip(cuts, parts, strict=True))
        every.append((a[:, :, None] + b[:, None, :]).reshape(50, -1))
    every = np.concatenate(every, 1)
    assert [x.tolist() for x in code.decode(u)] == [np.flatnonzero(row >= code.height).tolist() for row in every]


def test_best_takes_the_least_integer_last():
    least = -(1 << 63)
    assert topk.best(np.array([[least, 5, 3]]), 2).tolist() == [[1, 2]]
    assert topk.best(np.array([[least, 5, 3, least, 4, 1, 0, 2, 9]]), 2).tolist() == [[8, 1]]


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((700, 8)).round(1)
    rows = [(i, v[i].tolist(), 3) for i in range(700)] + [(701, None, 3), (702, [float("inf")] * 8, 3), (703, [None] + [1.0] * 7, 3), (720, [1.0] * 7, 3), (740, [2.0] * 7, 3), (None, [1.0] * 8, 3), (650, v[650].tolist(), 3), (760, [1e300] * 9, 3), (761, [1e300] * 9, 3)]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, rank INT")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20, queries=10, shard=40).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    take = [(i, np.floor(64 * np.array(x)).astype(object)) for i, x, _ in rows[:700] + [rows[703], rows[704], rows[706]] if x is not None]
    for q, x in take:
        if q % 20 == 0 and q != 650:
            best = sorted(((-int(sum(int(s) * int(t) for s, t in zip(x, y))), i) for i, y in take if i != q and len(y) == len(x)))[:20]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)], q
    assert got[760] == [(1, 761, (1 << 63) - 1)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0 and topk.top_k(df, F.lit(False)).count() == 0


def test_flow_is_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        m, n = rng.randint(1, 4), rng.randint(1, 4)
        supply = [rng.randint(0, 6) for _ in range(m)]
        demand = [0] * n
        for _ in range(sum(supply)):
            demand[rng.randrange(n)] += 1
        cost = [[rng.randint(0, 5) for _ in range(n)] for _ in range(m)]
        flow = sharding.cheapest_flow(supply, demand, lambda i, j: cost[i][j])
        assert [sum(v for (a, _), v in flow.items() if a == i) for i in range(m)] == supply
        assert [sum(v for (_, b), v in flow.items() if b == j) for j in range(n)] == demand
        # No cycle of negative cost in what is left, which is what cheapest means.
        far = [0.0] * (m + n)
        for _ in range(m + n + 1):
            edges = [(i, m + j, cost[i][j]) for i in range(m) for j in range(n)] + [(m + j, i, -cost[i][j]) for (i, j) in flow]
            new = list(far)
            for a, b, c in edges:
                new[b] = min(new[b], far[a] + c)
            stable, far = new == far, new
        assert stable


def test_resharding(spark):
    texts = [(i, prose(i, 5 + i % 60)) for i in range(600)] + [(600, None), (601, ""), (602, prose(9, 4000)), (None, "x"), *[(5, prose(5, 10))] * 300]
    docs = spark.createDataFrame(hostile(texts), DOCS)
    old = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("doc_id") % 7)
    moved, affected = sharding.reshard(docs, old, 7, 10, keep=["rank"], lines=16, line_rows=500)
    got = moved.collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32, r.text or "") for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), t or "") for i, t in texts)
    assert all(r["rank"] == 7 for r in got) and affected == list(range(10))
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(10)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    stay, cap, supply = Counter(), sum(sizes.values()) / 10, Counter()
    for r in got:
        supply[r.old_shard] += r["size"]
        stay[r.old_shard] += r["size"] * (r.old_shard == r.shard)
    assert all(stay[i] >= min(supply[i], cap) - 2 * largest for i in supply)
    assert sharding.reshard(docs.limit(0), F.lit(0), 3, 4)[0].count() == 0


def test_sizes_are_near_equal_with_some_very_long_texts(spark):
    rng = random.Random(4)
    rows = [(i, "y" * int(200 * rng.paretovariate(1.3))) for i in range(4000)] + [(9000, "z" * 60_000)]
    sizes = Counter()
    moved, _ = sharding.reshard(spark.createDataFrame(rows, "doc_id LONG, text STRING"), F.col("doc_id") % 8, 8, 10)
    for r in moved.select("shard", "size").collect():
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 10
    assert len(sizes) == 10 and max(sizes.values()) < 1.015 * mean and min(sizes.values()) > 0.985 * mean


def test_ranges_do_not_change_the_result(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 40)) for i in range(300)] + [(7, "same")] * 200, "doc_id LONG, text STRING")
    found = [sorted(map(tuple, sharding.reshard(docs.repartition(n), F.coalesce(F.col("doc_id") % 3, F.lit(0)), 3, 5, lines=lines, line_rows=n * 30)[0].collect()), key=repr) for lines, n in ((1, 2), (16, 3), (7, 90))]
    assert found[0] == found[1] == found[2]


def test_resharding_same_as_sql(spark, tmp_path):
    texts = [(i, prose(i, 5 + i % 60)) for i in range(400)] + [(600, None), (601, ""), (602, prose(9, 4000)), (None, "x"), (None, None), *[(5, prose(5, 10))] * 150]
    docs = spark.createDataFrame(hostile(texts), DOCS)
    old = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(6))
    for old_shards, shards in ((6, 9), (6, 4)):
        moved, _ = sharding.reshard(docs, old, old_shards, shards, lines=8, line_rows=100)
        own = moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
        same_as_sql(spark, tmp_path / str(shards), own, sharding.sql(old_shards, shards), documents=docs)


def test_shards_that_neither_lose_nor_gain_are_left_alone(spark):
    docs = spark.createDataFrame([(i, "x" * 84) for i in range(60)], "doc_id LONG, text STRING")
    old = F.when(F.col("doc_id") < 20, 0).when(F.col("doc_id") < 30, 1).otherwise(2)  # 2,000, 1,000 and 3,000 bytes
    moved, affected = sharding.reshard(docs, old, 3, 3)
    assert affected == [1, 2]
    rows = moved.collect()
    assert Counter(r.shard for r in rows) == {0: 20, 1: 20, 2: 20} and all(r.shard == 0 for r in rows if r.old_shard == 0)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(20)) for s in range(3))


VOCABULARY = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def test_mixing_meets_targets(spark):
    good, poor, toxic = (lambda i: prose(i, 40)), (lambda i: "!! 123 " * 10 + prose(i, 10)), (lambda i: prose(i, 30) + " vile nasty vile")
    rows, labels = [], []
    for i in range(600):
        d = 2 if i % 10 == 0 else 1 if i % 5 == 1 else 0
        rows.append((i, (good, poor, toxic)[d](i)))
        if i % 2 == 0 or d:
            labels.append((i, d))
    rows += [(700, None), (701, ""), (702, prose(1, 5000)), (3, rows[3][1]), (None, "x y")]
    docs = spark.createDataFrame(hostile(rows), DOCS)
    marked = spark.createDataFrame([*labels, (None, 1), (5, None), (2, 2), (2, 1)], "id LONG, domain INT")
    for targets in ((0.7, 0.2, 0.1), (0.1, 0.6, 0.3), (0.05, 0.05, 0.9)):
        out = mixing.mix_to_targets(docs, marked, targets, VOCABULARY, keep=["text", "rank"]).collect()
        assert len(out) == len(rows) and all(r["rank"] == 7 and r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) and abs(sum(r.posterior) - 1) < 1e-9 for r in out)
        got = np.array([sum(r.rate * r.n_tokens * r.posterior[d] for r in out) for d in range(3)])
        assert np.allclose(got, np.array(targets) * sum(r.n_tokens for r in out), rtol=0.002) and np.abs(out[0].misfit).max() < 0.001
    mixing.tokens_of(pa.array(["x"]), VOCABULARY)
    lib = mixing._loaded[VOCABULARY]
    assert all(r.n_tokens == len(lib.encode_ordinary(r.text or "")) for r in out)
    by = {r.doc_id: r for r in out}
    truth = {i: d for i, d in labels}
    assert np.mean([int(np.argmax(by[i].posterior)) == d for i, d in truth.items()]) > 0.97
    assert mixing.mix_to_targets(docs.limit(0), marked, (0.5, 0.3, 0.2), VOCABULARY).count() == 0
    even = mixing.mix_to_targets(docs, marked.limit(0), (0.5, 0.3, 0.2), VOCABULARY).collect()
    assert len(even) == len(rows) and len({tuple(r.posterior) for r in even}) == 1
    assert np.abs(even[0].misfit).max() > 0.1  # documents that are all alike can't be mixed to that


def test_features_from_known_tokens():
    """Tokens are worked out once; a text that holds the string put in for a special token is ordinary text."""
    texts = pa.array(["a b\0none\0c", "", prose(3, 60), "é 12 12 !!"])
    ids = mixing.tokens_of(texts, VOCABULARY)
    lib = mixing._loaded[VOCABULARY]
    assert [x.tolist() for x in ids] == [lib.encode_ordinary(t) for t in texts.to_pylist()] and max(map(max, filter(len, ids))) < len(lib._mergeable_ranks)
    rng = np.random.default_rng(1)
    model = mixing.Classifier(VOCABULARY, rng.normal(size=(mixing.BUCKETS, 3)), np.zeros((12, 3)), np.zeros(11), np.ones(11))
    (x, n), (y, m) = model.raw(texts), model.raw(texts, ids)
    assert (x == y).all() and (n == m).all() and n.tolist() == [len(i) for i in ids]
    for top in (9, 70_000, 1 << 40):
        some = rng.integers(0, top, 500)
        assert mixing._distinct(some) == len(np.unique(some))


def test_rates_are_those_of_plain_least_squares(spark):
    """Against plain projected gradient over documents, with tiny steps: where targets can be met, and where not."""
    rng = np.random.default_rng(6)
    n = rng.integers(0, 300, 400)
    for low, targets, whole in ((0.0, (0.5, 0.3, 0.2), None), (0.0, (0.9, 0.02, 0.08), 1.0), (0.25, (0.96, 0.02, 0.02), None)):
        p = rng.dirichlet((0.4, 0.3, 0.2), 400) * (1 - 3 * low) + low
        rows = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, n, strict=True)], "posterior ARRAY<DOUBLE>, n_tokens LONG").repartition(5)
        steps, misfit = mixing.fit_rates(rows, targets, whole=whole)
        share = (p * n[:, None]).T / n.sum()
        goal = np.array(targets) * (1 if whole is None else whole * share[0].sum() / targets[0])
        a = share / goal[:, None]
        plain = np.ones(400)
        for _ in range(40_000):
            plain = np.maximum(0, plain - a.T @ (a @ plain - 1) / np.linalg.norm(a @ a.T, 2))
        x = mixing._rates(p, steps)
        assert (x >= 0).all() and np.allclose(misfit, a @ x - 1, atol=1e-4)
        assert ((a @ x - 1) ** 2).sum() <= ((a @ plain - 1) ** 2).sum() + 0.03
        assert np.abs(misfit).max() < 1e-3 or np.abs(a @ plain - 1).max() > 0.5

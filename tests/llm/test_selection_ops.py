"""Importance resampling, quality rules and vector codes, against brute force and against their SQL on hostile tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import quality, resampling, vectorcodes
from tests.llm.helpers import DOCS, hostile, prose, same_as_sql
from tests.test_queries import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    (1, None), (2, ""), (3, prose(1, 60)), (3, prose(1, 60)), (3, prose(2, 60)), (None, prose(3, 90)), (None, "Ünï a\x00B  \n\tc 中文 😀é x_y"), (5, prose(4, 9000)), (6, "x" * 3000), (7, " \n" * 50),
    (8, "same words here " * 40), (9, "\n".join(["one line of it", " ", "one line of it", "one line of it\r"] * 9)), (10, "A B! " * 60), (11, "\n".join(f"- {prose(i, 4)}" for i in range(30))),
    (12, "\n".join(f"{prose(i, 5)}..." for i in range(30))), (13, " ".join(f"{i} abcd" for i in range(60))), (14, " ".join(f"{w}##" for w in prose(5, 80).split())), (15, " ".join("abcdefg"[i % 7] for i in range(90))),
]
TEXTS += [(20 + i, prose(50 + i, 25 + i)) for i in range(30)]


def counts_plain(text, buckets, run):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(ws), Counter(zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, run + 1) for i in range(len(ws) - k + 1))


@pytest.mark.parametrize("run", [1, 2, 3])
def test_runs_of_words_in_windows_of_any_size(run):
    for text in ["", "a", "a b", "A b c a b c", prose(1, 300), "  x\ty--z  ", "中文 é x" * 9]:
        for size in (1, 7, 50, 1 << 20):
            assert resampling.bucket_counts(text.encode(), 97, run, size) == counts_plain(text, 97, run)


def resampled_plain(texts, target, percent, least, buckets, run, seed):
    own, wanted = [counts_plain(t, buckets, run) for _, t in texts], [counts_plain(t, buckets, run)[1] for t in target]
    s, t = sum((c for _, c in own), Counter()), sum(wanted, Counter())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, c) in zip(texts, own, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items()) // c.total() if c else 0
        out.append([i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("percent,run,target", [(30, 1, [prose(1, 30), None, prose(60, 40)]), (100, 2, [prose(55, 40)]), (50, 1, []), (0, 1, ["a"])])
def test_resampling_is_the_plain_computation(spark, percent, run, target):
    docs = spark.createDataFrame(hostile(TEXTS), DOCS).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text STRING")
    got = resampling.resample(docs, wanted, percent, 20, 64, run, seed=5)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr) == resampled_plain(TEXTS, target, percent, 20, 64, run, 5)


def test_drawn_rows_carry_their_texts(spark):
    docs = spark.createDataFrame(hostile(TEXTS), DOCS)
    found = resampling.resample(docs, docs.where("doc_id < 9"), 50)
    drawn = resampling.drawn_rows(docs, found).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, found.where("rank IS NOT NULL").count() + 1))
    assert {(r.doc_id, r.text) for r in drawn} <= set(TEXTS)


def test_resampling_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert resampling.resample(docs, docs).collect() == []


def test_resampling_same_as_sql(spark, tmp_path):
    docs, target = spark.createDataFrame(hostile(TEXTS), DOCS), spark.createDataFrame([(1, prose(1, 60)), (2, None), (3, "Ünï 中文")], "item_id LONG, text STRING")
    same_as_sql(spark, tmp_path, resampling.resample(docs, target).drop("key", "n_words"), resampling.sql(), documents=docs, benchmark=target)


def test_repeated_resampling_draws_the_same(spark):
    docs = spark.createDataFrame(hostile(TEXTS), DOCS)
    a, b = (rows(resampling.resample(docs.repartition(n), docs.limit(5), 40).toPandas()) for n in (1, 5))
    assert a == b


def measured_plain(text):
    text = text or ""
    ws, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    times = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if times[w] > 1 for k in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_every_order_of_rules_gives_one_verdict(spark):
    docs = spark.createDataFrame(hostile(TEXTS), DOCS)
    got = quality.assess(docs, quality.RULES, keep=["rank", "id"]).collect()
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r.doc_id, *(r[c] for c in cols), r["rank"], r.id) for r in got), key=repr) == sorted(((i, *measured_plain(t), 7, -1) for i, t in TEXTS), key=repr)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (r.failed is None) and not (r.kept and r.base_failed)
    verdicts = {r.doc_id: r.failed for r in got if r.doc_id is not None}
    assert [verdicts[i] for i in (10, 13, 14)] == ["base", "without_letters", "symbols"] and verdicts[5] is None and verdicts[15] == "base"
    backwards = quality.assess(docs, quality.RULES[::-1])
    assert rows(backwards.select("doc_id", "kept").toPandas()) == rows(quality.assess(docs, quality.RULES).select("doc_id", "kept").toPandas())


def test_quality_same_as_sql(spark, tmp_path):
    texts = TEXTS + [(100 + i, t) for i, t in enumerate(["WHY NOT " + prose(1, 8).upper() + "! " + prose(2, 60).upper(), "\n".join(f"• {prose(i, 6)}" for i in range(12)), "\n".join(f"{prose(i, 6)}… " for i in range(12)), "a b c d e f g " * 3 + prose(7, 40)])]
    docs = spark.createDataFrame(hostile(texts), DOCS)
    same_as_sql(spark, tmp_path, quality.assess(docs).drop("failed"), quality.sql(), documents=docs)


def test_each_rule_rejects_what_it_should(spark):
    bad = {
        "symbols": prose(1, 60).replace(" ", " | "), "short_words": " ".join("abcdefghijklmnop"[i % 16] for i in range(60)), "capitals": prose(2, 60).upper(), "without_letters": " ".join(f"{i} ab" for i in range(60)),
        "repeated_lines": "\n".join(["lorem ipsum"] * 9), "cut_off_lines": "\n".join(f"{prose(i, 5)}..." for i in range(12)), "bullets": "\n".join(f"- {prose(i, 6)}" for i in range(12)),
    }
    docs = spark.createDataFrame([*bad.items(), ("fine", prose(9, 80)), ("中", "中文句子。" * 20 + "\n" + "другой текст тут " * 9)], "name STRING, t STRING")
    text = quality.Text(F.col("t"), quality.words_of(F.col("t")), quality.lines_of(F.col("t")))
    for r in docs.select("name", *[x.fails(text).alias(x.name) for x in quality.RULES]).collect():
        assert r[r.name] if r.name in bad else not any(r[x.name] for x in quality.RULES)


def test_the_cascade_asks_for_cheap_rejections_first(spark):
    docs = spark.createDataFrame([(i, prose(i, 20) + (" bad" if i % 2 else "")) for i in range(200)], "doc_id LONG, text STRING")
    slow = lambda x: F.size(F.filter(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2(F.concat(x.text, i.cast("string")), 256) == "x")) > 0
    rules = [quality.Rule("never", slow, ""), quality.Rule("dear", lambda x: slow(x) | x.text.endswith("bad"), ""), quality.Rule("cheap", lambda x: x.text.endswith("bad"), "")]
    found = quality.cascade(docs, rules, sample=100)
    assert [e.rule.name for e in found][0] == "cheap" and 0.2 < found[0].failed < 0.8
    assert found[1].failed == found[2].failed == 0.0
    # What an earlier rule rejects never reaches a later one.
    fails = quality.Rule("error", lambda x: F.raise_error(F.lit("asked")).isNotNull(), "")
    text = quality.Text(F.col("text"), F.col("text"), F.col("text"))
    assert {r[0] for r in docs.where("doc_id % 2 = 1").select(quality.first_failed([rules[2], fails], text)).collect()} == {"cheap"}
    assert [e.rule.name for e in quality.cascade(docs.limit(0), rules)] and quality.assess(docs.limit(0)).collect() == []


def coded_plain(vectors, parts, entries, rounds, scale=1024):
    """In Python's integers; vectors: (id, components) in order."""
    width = max(1, -(-max((len(v) for _, v in vectors), default=1) // parts))
    cut = []
    for _, v in vectors:
        x = [max(-(1 << 62), min(1 << 62, math.floor(scale * c))) for c in v] + [0] * (parts * width - len(v))
        cut.append([x[p * width : (p + 1) * width] for p in range(parts)])
    start = sorted(range(len(cut)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, cut[i]))[:entries]
    books = [[list(cut[i][p]) for i in start] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        at = near()
        for p in range(parts):
            for e in range(len(books[p])):
                if own := [c[p] for c, a in zip(cut, at, strict=True) if a[p] == e]:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = near()
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{i:02x}" for i in a), min((1 << 63) - 1, sum(dist(c[p], books[p][a[p]]) for p in range(parts)))) for c, a in zip(cut, at, strict=True)], sha


def vectors(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in rng.normal(size=dim) * spread] for _ in range(n)]


SCHEMA = "vec_id LONG, embedding ARRAY<DOUBLE>, label INT, id LONG, v STRING, code STRING"
BAD = [(1, None, 1), (2, [0.5, None, 1.0, 2.0, 0.1, 0.2, 0.3, 0.4], 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] + [0.0] * 7, 2), (5, [0.0] * 7 + [float("-inf")], None)]


def embeddings(spark, made):
    return spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in made], SCHEMA)


@pytest.mark.parametrize("entries,spread", [(8, 1.0), (256, 1.0), (8, 1e7), (4, 1e15), (5, 0.0)])
def test_vector_codes_are_those_of_plain_integers(spark, entries, spread):
    own = vectors(3, 70, 8, spread)
    made = [(10 + i % 60 if i % 9 else None, v, [1, 2, None][i % 3]) for i, v in enumerate(own)]
    made += [made[5], made[5], (7, [], None), (8, own[0][:5], 2)]  # repeated rows and shorter ones
    found, codes = vectorcodes.compress(embeddings(spark, BAD + made).repartition(3), 4, entries, 3)
    want, sha = coded_plain([(i, v) for i, v, _ in made], 4, entries, 3)
    by_label = Counter()
    for (_, _, label), (_, error) in zip(made, want, strict=True):
        by_label[label] += error
    expect = sorted(((i, *w, min((1 << 63) - 1, by_label[label]), sha) for (i, _, label), w in zip(made, want, strict=True)), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expect
    assert codes.sha256() == sha


def test_annulus_finds_the_nearest_entry_and_the_lower_of_ties():
    rng = np.random.default_rng(1)
    for k, width, most in ((1, 1, 3), (7, 1, 2), (200, 3, 4), (256, 16, 900), (50, 2, 1)):
        entries, x = rng.integers(-most, most + 1, (k, width)), rng.integers(-2 * most, 2 * most + 1, (500, width))
        index, d = vectorcodes.Codebook(entries).nearest(x)
        every = ((x[:, None] - entries) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (d == every.min(1)).all()


def test_codes_decode_to_what_the_error_is_measured_against(spark):
    own = vectors(5, 40, 8)
    found, codes = vectorcodes.compress(embeddings(spark, [(i, v, 0) for i, v in enumerate(own)]), 4, 6, 2)
    for r in found.collect():
        off = [(math.floor(1024 * a) - 1024 * b) ** 2 for a, b in zip(own[r.vec_id], codes.decode(r.code), strict=True)]
        assert sum(off) == r.error


def test_vector_codes_of_nothing(spark):
    found, codes = vectorcodes.compress(embeddings(spark, BAD[:1]))
    assert codes is None and found.collect() == [] and found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_vector_codes_same_as_sql(spark, tmp_path):
    table = embeddings(spark, BAD + [(10 + i % 300 if i % 50 else None, v, [1, 2, None][i % 3]) for i, v in enumerate(vectors(9, 320, 8))])
    same_as_sql(spark, tmp_path, vectorcodes.compress(table)[0], vectorcodes.sql(), embeddings=table)


def test_what_a_scan_of_blocks_decodes_at_once_is_bounded(spark):
    docs = spark.createDataFrame([(i, prose(i, 3000)) for i in range(128)], "doc_id LONG, text STRING").coalesce(1)
    largest = resampling.blocks(docs).agg(F.max(8 * F.size("buckets"))).first()[0]
    assert largest * int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) < 256 << 20

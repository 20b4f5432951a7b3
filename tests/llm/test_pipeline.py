import hashlib
from collections import Counter

import public_tokenizers as P

import corpus_pipeline
from lattica.llm import bytebpe, minhash
from lattica.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.helpers import prose


def test_stages_and_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "secret_scan", "mixing", "byte_bpe"]
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_keeps_and_drops_what_it_should(spark, tmp_path):
    texts = [prose(i, 60 + i) for i in range(80)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    secret = texts[3] + " token = deadbeefdeadbeefdeadbeefdeadbeef12345678"
    rows += [(100, texts[0], "en", "s", 1), (101, texts[1] + " extra", "en", "s", 1), (102, None, "en", "s", 0), (103, "12 34 !!", None, "s", 8), (104, prose(900, 70) + secret[len(texts[3]) :], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in out)
    assert set(ids) == {*range(80), 104}
    bpe = bytebpe.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    by = {r.doc_id: r for r in out}
    for i in range(80):
        assert by[i].decoded_sha256 == hashlib.sha256(texts[i].encode()).hexdigest()
        assert by[i].ids_sha256 == hashlib.sha256(bpe.packed(texts[i])).hexdigest()
    assert by[104].decoded_sha256 == hashlib.sha256((prose(900, 70) + " [SECRET]").encode()).hexdigest()


ODD = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, spans STRING, found LONG, score STRING, lang_pred INT, copies INT, kept STRING, __text STRING, id STRING"


def odd_rows():
    tail = ("a", 1, "b", 2, 3, "c", "d", "e")
    rows = [(i, prose(i, 40 + i), None if i % 5 == 0 else "en", None, None, *tail) for i in range(30)]
    return rows + [(None, prose(60, 50), "en", "s", 9, *tail), (None, None, None, None, None, *tail), (40, "", None, None, 0, *tail), (41, None, None, None, 0, *tail), (3, rows[3][1], "en", "s", 2, *tail), (3, "short text", "en", "s", 2, *tail), (42, prose(5, 9000), "en", "s", 1, *tail)]


def test_each_stage_takes_odd_rows_and_none(spark, tmp_path):
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    docs, sf = spark.createDataFrame(odd_rows(), ODD), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0
        if name != "byte_bpe":
            assert none.dtypes == docs.dtypes
    read = lambda df: sorted(map(tuple, df.collect()), key=repr)
    known = stages["language_id"](spark, docs, sf)
    assert Counter(r.doc_id for r in known.collect()) == Counter(r[0] for r in odd_rows() if r[1])
    once = stages["minhash_dedup"](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in once) == Counter({**dict.fromkeys([*range(30), 40, 41, 42], 1), 3: 2, None: 2})
    assert {r.text for r in once if r.doc_id == 3} == {odd_rows()[3][1], "short text"}  # repeated rows go, unlike texts of an id stay
    assert read(stages["secret_scan"](spark, docs, sf)) == read(docs)
    mixed = stages["mixing"](spark, docs, sf)
    assert set(read(mixed)) <= set(read(docs)) and mixed.count() > 0
    assert stages["byte_bpe"](spark, docs, sf).count() == len(odd_rows())


def test_dedup_goes_by_texts_not_ids(spark, tmp_path):
    x, y = prose(700, 80), prose(701, 90)
    rows = [(7, x), (7, y), (8, x + " more"), (9, y + " more"), (3, prose(702, 70)), (3, "short text"), (3, "short text"), (5, prose(703, 50)), (None, prose(704, 60)), (None, prose(704, 60)), (None, prose(703, 50) + " more"), (None, None), (None, None), (6, ""), (6, "")]
    rows += [(1000, prose(1000 + i, 40)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = Counter((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["minhash_dedup"](spark, docs, str(tmp_path)).collect())
    gone = [(8, x + " more"), (9, y + " more"), (3, "short text"), (None, prose(704, 60)), (None, prose(703, 50) + " more")]
    assert got == Counter(rows) - Counter(gone)
    found = {(r.doc_id, r.class_id, r.kept) for r in minhash.near_duplicates(docs).collect() if r.doc_id in (3, 7, 8, 9)}
    assert found == {(3, 3, True), (7, 7, True), (8, 7, False), (9, 7, False)}

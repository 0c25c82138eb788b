"""The pipeline's stages on a small table: who stays, what is cut, and that every kept token is packed once."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows, marks = [], []
    for i in range(200):
        bad = i % 8 == 0
        rows.append((i, say(80).upper().replace(" ", "!! ") if bad else say(80), "en", "s", 0))
        marks.append((i, int(not bad)))
    passage = say(70)
    rows += [(300, rows[1][1], "en", "t", 0), (301, rows[1][1] + " end", "en", None, None),
        (302, say(40) + " " + passage + " " + say(40), "en", "s", 0), (303, say(40) + " " + passage + " " + say(40), "en", "s", 0),
            (304, None, None, None, None), (None, say(50), "en", "s", 1), (None, rows[2][1], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = dict(corpus_pipeline.STAGES)
    good = by["quality classifier"](spark, docs, sf)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and not any(i % 8 == 0 for i in ids if i is not None and i < 200) and {i for i in range(200) if i % 8} <= ids
    one = by["SimHash near-dedup"](spark, good, sf)
    left = [r["doc_id"] for r in one.collect()]
    assert one.columns == docs.columns and 1 in left and 300 not in left and 301 not in left and {302, 303} <= {*left} and left.count(None) == 1
    cut = by["suffix-array dedup"](spark, one, sf)
    texts = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == docs.columns and cut.dtypes == docs.dtypes and len(texts) == len({*left})
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[302]["text"] == before[302] and len(texts[303]["text"]) < len(before[303]) - 200 and texts[303]["n_chars"] == len(texts[303]["text"])
    packed = by["packing"](spark, cut, sf).collect()
    assert {r["doc_id"] for r in packed} == {*texts}


def test_repeated_ids(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "a b c d e f", "en", "s", 1),
        (None, "", "en", "s", 1), (None, "", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf).collect()) == [(False, 1), (True, 0)]


def test_rows_of_one_id_with_different_texts(spark, sf):
    rows = [(1, "a b c d e f", 1), (1, "q r s t u v w", 2), (0, "q r s t u v w", 3), (2, None, 4), (3, "", 5), (None, "z z z z z y", 6), (None, "z z z z z y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted((r["n"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, sf).collect()))
    assert got == [1, 3, 4, 6]


def test_suffix_stage_keeps_other_columns_bit_for_bit(spark, sf):
    from datetime import datetime
    from decimal import Decimal

    schema = "doc_id long, text string, text_is_null boolean, rest string, kept double, removed timestamp, `a.b` map<string,int>, d decimal(20,5), n_chars int, chunk array<struct<x:long>>"
    at = datetime(2024, 2, 3, 4, 5, 6, 123456)
    rows = [(1, "x" * 60, True, "r", float("nan"), at, {"k": 1}, Decimal("1.00001"), 7, [(5,)]),
        (2, "x" * 60 + "tail", None, None, None, None, None, None, None, None), (3, None, False, "", 1e-300, at, {}, Decimal("-2.5"), 0, []),
            (None, "x" * 55, True, "z", 0.1, at, None, None, 1, None)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.suffix_array_dedup(spark, docs, sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r["doc_id"]: r for r in out.collect()}
    assert [got[i]["text"] for i in (1, 2, 3, None)] == ["x" * 60, "tail", None, ""] and [got[i]["n_chars"] for i in (1, 2, 3, None)] == [60, 4, None, 0]
    for r in docs.collect():
        assert [repr(r[c]) for c in docs.columns if c not in ("text", "n_chars")] == [repr(got[r["doc_id"]][c]) for c in docs.columns if c not in ("text", "n_chars")]


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = -5")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0

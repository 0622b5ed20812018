"""The query builders: what they derive from their operators, on small tables with nulls and ties."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import queries as Q


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("queries")
    rows = [(i, f"word{i % 9} other {i} é" if i % 5 else None, "en", "s", 1) for i in range(60)] + [(3, "word3 other 3 é", "en", "s", 1), (None, "x", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def test_resharding_digests_and_sizes(spark, folder):
    at, rows = folder
    out = Q.QUERIES["op2_mincost_resharding"](spark, at).collect()
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    assert {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None} and {r.shard for r in out} <= set(range(8))
    for shard in range(8):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_fingerprints_are_sixteen_hex_digits(spark, folder):
    at, rows = folder
    out = Q.QUERIES["op6_gray_simhash"](spark, at).collect()
    assert len(out) == len(rows) and all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in out)
    assert {r.fingerprint for r in out if r.doc_id is not None and r.doc_id % 5 == 0} == {"0" * 16}


def test_folds_and_predictions(spark, folder):
    at, rows = folder
    out = Q.QUERIES["op8_crf_toxicity"](spark, at).where(F.col("doc_id").isNotNull()).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in out)
    assert len(out) == len(rows) - 1

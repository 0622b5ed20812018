"""The stages on planted documents, and their chain on odd tables."""

import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(2500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = prose(60), prose(30)
    rows = []
    for i in range(300):
        text = prose(rng.randint(60, 160))
        if i % 5 == 1:
            text += " " + " ".join(rng.choice(["vilez", "scumz", "idiotz"]) for _ in range(4))
        if i % 10 == 2:
            text += "\n" + passage
        if i % 10 == 3:
            text += " " + item + " " + prose(20)
        rows.append((i, text, "en", "src", len(text)))
    rows += [(400 + k, rows[10][1], "en", "src", 1) for k in range(5)]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (None, prose(80), "en", "s", 9)]
    at = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), {r[0]: r[1] for r in rows}, passage


def test_stages_take_effect_one_by_one(spark, folder):
    at, texts, passage = folder
    docs, names = spark.read.parquet(f"{at}/documents.parquet"), None
    before = {r.doc_id for r in docs.collect()}
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = P.checkpoint(stage(spark, docs, at))
        assert docs.columns == columns, name
        rows = docs.collect()
        now = {r.doc_id for r in rows}
        gone = before - now
        if name == "toxicity":
            assert gone == {i for i in range(300) if i % 5 == 1}
        elif name == "line_dedup":
            assert sum(passage in (r.text or "") for r in rows) == 1
            assert gone == {400, 401, 402, 403, 404}
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.text != texts[r.doc_id])
        elif name == "simhash_near_dedup":
            assert gone == {501}
        else:
            assert gone == {i for i in range(300) if i % 10 == 3}
        before = now
        names = name
    assert names == "benchmark_decontamination"
    out = {r.doc_id: r.n_tokens for r in P.STAGES[-1][1](spark, docs, at).collect()}
    assert set(out) == before and out[500] == 0


def test_run_and_empty_tables(spark, folder, tmp_path):
    at = folder[0]
    out = P.run(spark, at)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 150 < out.count() < 300
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_long_texts_tied_ids_and_clashing_columns_go_through_all_stages(spark, folder, tmp_path):
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    long = prose(60_000)
    rows = [(1001, long), (1001, prose(50)), (1001, prose(50)), (1002, long), (None, prose(50)), (None, None), (1003, ""), (1004, "one\ntwo\n" * 300)]
    extra = ["key", "grp", "line", "part", "fp", "root", "text_", "__id", "numbers", "score", "ids"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        at = P.checkpoint(stage(spark, at, str(tmp_path)))
        assert at.columns == docs.columns
    kept = sorted(str((r.doc_id, r.text)) for r in at.collect())
    assert kept == sorted(str(x) for x in [rows[0], rows[1], rows[2], rows[4], rows[7], (1003, "")])  # the null text is a copy of the empty one
    assert P.STAGES[-1][1](spark, at, str(tmp_path)).count() == 6

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]
import corpus_pipeline as pipeline
from helpers import words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, quality int, spans int, rev_id int, diff int, kept int"


@pytest.fixture()
def folder(spark, tmp_path):
    junk = " ".join(w + "***" for w in words(1, 60).split())
    near = words(70, 200)
    texts = {i: words(i, 60) for i in range(30)}
    texts |= {40: texts[3] + " ", 41: texts[3], 50: junk, 51: None, 52: "", 53: "too short", 60: near, 61: near + " more", 62: "token=abcdef12 " + words(90, 60)}
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), 1, 1, 1, 1, 1) for i, t in texts.items()]
    rows += [rows[0], (None, words(95, 60), None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in (*range(30), 60, 62)] + [(50, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_every_stage_decides_on_what_came_before(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline_written(spark, stage(spark, docs, folder), folder, name)
        assert docs.columns == columns
        ids[name] = sorted(r.doc_id for r in docs.collect())
    clean = list(range(30))
    assert ids["quality rules"] == sorted([*clean, 0, 40, 41, 60, 61, 62])
    # Of equal texts the longest stays: 40 has a blank more than 3 and 41.
    assert ids["exact dedup"] == sorted([*[i for i in clean if i != 3], 40, 60, 61, 62])
    assert ids["near dedup"] == ids["secret scans"] == sorted([*[i for i in clean if i != 3], 40, 60, 62])
    masked = docs.where("doc_id = 62").first()
    assert masked.text.startswith("[secret] ") and masked.n_chars == len(masked.text)
    pieces = pipeline.pack(spark, docs, folder).collect()
    assert sorted({r.doc_id for r in pieces}) == ids["secret scans"]


def pipeline_written(spark, df, folder, name):
    path = f"{folder}/{name.replace(' ', '-')}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def test_run_chains_the_stages(spark, folder):
    out = pipeline.run(spark, folder).collect()
    assert 62 in {r.doc_id for r in out} and 50 not in {r.doc_id for r in out}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").collect() == []

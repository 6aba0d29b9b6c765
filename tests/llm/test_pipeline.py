"""The corpus pipeline on a small corpus with planted cases, each stage against brute force."""

import random

import corpus_pipeline

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from tests_llm_words import words  # noqa: E402


def test_stages(spark, tmp_path):
    r = random.Random(1)
    clean = [" ".join(words(r.randint(60, 120), k)) for k in range(120)]
    toxic = [" ".join(words(60, 500 + k) + ["scum", "worthless"] * 2) for k in range(60)]
    copies = [clean[0].upper(), clean[1], clean[1]]
    edited = clean[2].split()
    near = [" ".join([*edited[:-1], "changed"])]
    passage = words(70, 900)
    repeats = [" ".join(words(30, 600 + k) + passage + words(30, 700 + k)) for k in range(4)]
    texts = clean + toxic + copies + near + repeats + ["", None]
    kinds = ["clean"] * 120 + ["toxic"] * 60 + ["copy"] * 3 + ["near"] + ["repeat"] * 4 + ["empty"] * 2
    rows = [(i, t, "en", "src", len(t or ""), "extra") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int(k == "toxic")) for i, k in enumerate(kinds) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
    kept = {name: {x.doc_id for x in rows} for name, rows in seen.items()}
    toxic_ids = {i for i, k in enumerate(kinds) if k == "toxic"}
    assert len(kept["toxicity"] & toxic_ids) <= 2 and len({i for i, k in enumerate(kinds) if k == "clean"} - kept["toxicity"]) <= 2
    assert {0, 1, 181} & kept["exact_dedup"] == set() and {180, 182} <= kept["exact_dedup"]
    assert len({188, 189} & kept["exact_dedup"]) == 1
    assert 2 in kept["near_dedup"] and 183 not in kept["near_dedup"]
    assert kept["substring_dedup"] == kept["near_dedup"]
    texts_out = {x.doc_id: x for x in seen["substring_dedup"]}
    assert sum(" ".join(passage) in (x.text or "") for x in texts_out.values()) == 1
    assert all(x.n_chars == len(x.text) for x in texts_out.values() if x.text is not None)
    assert {x.doc_id for x in seen["packing"]} == kept["substring_dedup"]


def test_run_equals_stages(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(words(40, i)), "en", "s", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(range(30))


def test_toxicity_judges_rows_not_ids(spark, tmp_path):
    texts = [" ".join(words(30, k) + (["scum", "worthless"] if k % 3 == 0 else [])) for k in range(120)]
    told = [(k, t) for k, t in enumerate(texts)]
    clean, toxic = " ".join(words(30, 900)), " ".join([*words(30, 901), "scum", "worthless"])
    rows = [*told, (None, clean), (None, toxic), (500, clean), (500, toxic), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect() if r.doc_id in (None, 500)]
    assert sorted(got, key=str) == sorted([(None, clean), (500, clean), (500, None)], key=str)


def test_stages_on_null_and_repeated_ids(spark, tmp_path):
    """Near-dedup and substring dedup judge rows: a null or repeated id hides no copy and loses no other row."""
    base, passage = words(100, 1), words(70, 2)
    near, other = [" ".join([*base[:-1], w]) for w in ("one", "two")], " ".join(words(80, 3))
    rows = [(None, near[0]), (None, near[1]), (None, None), (7, other), (7, " ".join(words(30, 4) + passage)), (7, " ".join(words(30, 5) + passage))]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    texts = [r.text for r in kept.collect()]
    assert kept.columns == docs.columns and len(texts) == 5 and len(set(near) & set(texts)) == 1
    cut = corpus_pipeline.substring_dedup(spark, docs, str(tmp_path))
    out = [r.text for r in cut.collect()]
    assert cut.columns == docs.columns and len(out) == 6 and other in out and sum(" ".join(passage) in (t or "") for t in out) == 1


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0

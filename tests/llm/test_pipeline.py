"""The pipeline's stages, one after the other, on a corpus with planted cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cadenza.llm import mixing, quality
from cadenza.llm.common import save


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder of tables, and what is in it by kind."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    bench = [(i, prose(30)) for i in range(5)]
    docs, kind = [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", f"src{len(docs) % 3}", len(text or "")))

    for _ in range(150):
        add(prose(80), "clean")
    for i in range(20):
        add(docs[i][1], "copy")
    for i in range(20, 40):
        w = docs[i][1].split()
        w[40] = "edited"
        add(" ".join(w), "copy")
    for i in range(10):
        add(prose(30) + " " + bench[i % 5][1][: 5 * 6 * 12] + " " + prose(30), "leak")
    for _ in range(60):
        add(" ".join(["JUNK!!"] * rng.randint(20, 90)) + prose(3).upper(), "junk")
    docs.append((len(docs), None, None, None, None))
    labels = [(i, int(k != "junk"), 0) for i, k in kind.items() if i % 5 != 4]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, kind


def test_stages(spark, planted):
    path, docs, kind = planted
    now = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        rows = now.collect()
        assert now.columns == columns, name
        left.append([r.doc_id for r in rows])
        assert all(tuple(r) == docs[r.doc_id] for r in rows), name
        now = spark.createDataFrame(rows, now.schema)
    good, single, clean, mixed = left
    assert {i for i in good if kind.get(i) != "junk"} == {i for i, k in kind.items() if k != "junk"} | ({len(docs) - 1} & set(good)) and not any(kind.get(i) == "junk" for i in good)
    assert {i for i in single if i in kind} == {i for i, k in kind.items() if k in ("clean", "leak")}
    assert {i for i in clean if i in kind} == {i for i, k in kind.items() if k == "clean"}
    assert sorted(mixed) == sorted(clean) and mixed != sorted(clean)
    out = corpus_pipeline.STAGES[-1][1](spark, now, path).collect()
    assert sorted(r.doc_id for r in out) == sorted(clean)
    ran = corpus_pipeline.run(spark, path).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, out))


def test_mix_reaches_the_shards(spark, planted, monkeypatch):
    path, _, _ = planted
    stages = corpus_pipeline.STAGES
    now = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in stages[:3]:
        now = stage(spark, now, path)
    position = {r.doc_id: r.position for r in mixing.mix_sources(now).collect()}
    ran = corpus_pipeline.run(spark, path).collect()
    for k in {r.shard for r in ran}:
        rows = sorted((r for r in ran if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=position.get)
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[:3] + stages[4:])
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) != sorted(map(tuple, ran))


def test_model_ignores_held_out_labels(spark, planted):
    path, docs, _ = planted
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = quality.fit(table, labels), quality.fit(table, other)
    assert (a.weights == b.weights).all() and (a.slope, a.shift) == (b.slope, b.shift)


def test_saved_tables_leave_no_shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    earlier = shuffled()
    rows = spark.range(10000).groupBy((F.col("id") % 7).alias("k")).count()
    assert save(rows, "counted").count() == 7
    left = {f for f in shuffled() - earlier if f.endswith(".data")}
    until = time.time() + 10
    while len(left) > 1 and time.time() < until:  # files go in the background; the one of count() above stays
        time.sleep(0.2)
        left = {f for f in shuffled() - earlier if f.endswith(".data")}
    assert len(left) <= 1

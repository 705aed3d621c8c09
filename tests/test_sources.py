import csv
import random

import pytest

from lexiforge.sources import corpora
from lexiforge.streaming import resume


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('oare_id,transliteration,translation\n1,"a\nb","he said ""no"""\n2,NA,nan\n')
    rows = corpora.read_csv(spark, str(tmp_path), corpora.SCHEMAS["docs"]).collect()
    assert [tuple(r) for r in rows] == [("1", "a\nb", 'he said "no"'), ("2", None, None)]


def test_columns(spark):
    d = spark.createDataFrame([(1, "a")], "id int, Translit string")
    assert corpora.resolve_column(d, "translit") == "Translit"
    with pytest.raises(ValueError, match="columns"):
        corpora.conform(d, ["id", "translation"])


def test_resume(spark, tmp_path):
    work = lambda df: df.withColumnRenamed("v", "w")
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "out")
    resume.run_resumable(spark, d.limit(1), work, path, "k")
    assert resume.run_resumable(spark, d, work, path, "k").count() == 2
    assert resume.run_resumable(spark, d, work, path, "k").count() == 2


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, v string").parquet(str(tmp_path / "in"))
    q = resume.stream_resumable(source, lambda df: df, str(tmp_path / "out"), str(tmp_path / "cp"), "k")
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_csv_sink_keeps_the_header(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "id int, translation string")
    for rows, name in ((d, "some"), (d.limit(0), "none")):
        corpora.write_csv(rows, str(tmp_path / name))
    assert [tuple(r) for r in corpora.read_csv(spark, str(tmp_path / "some"), corpora.SCHEMAS["submission"]).orderBy("id").collect()] == [(1, 'a "b"\nc'), (2, None)]
    assert [f.read_text().strip() for f in (tmp_path / "none").glob("part-*")] == ["id,translation"]


def test_maps_and_metrics(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "form string, gloss string, n int")
    corpora.write_map(d, "form", str(tmp_path / "m"))
    got = corpora.read_map(spark, str(tmp_path / "m"), "struct<gloss:string,n:int>", "form")
    assert sorted(map(tuple, got.collect())) == [("a", "x", 1), ("b", None, 2)]
    (tmp_path / "one.json").write_text('{"a": "x",\n "b": "y"}')
    assert sorted(map(tuple, corpora.read_map(spark, str(tmp_path / "one.json"), "string").collect())) == [("a", "x"), ("b", "y")]
    schema = "bleu double, geo_mean double"
    corpora.write_metrics(spark.createDataFrame([(1.5, 2.5)], schema), str(tmp_path / "r"))
    assert [tuple(r) for r in corpora.read_metrics(spark, str(tmp_path / "r"), schema).collect()] == [(1.5, 2.5)]
    assert corpora.read_metrics(spark, str(tmp_path / "no"), schema) is None


def test_resume_keeps_what_was_done(spark, tmp_path):
    d = spark.range(100).withColumnRenamed("id", "k")
    path, calls = str(tmp_path / "out"), []

    def work(df):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("broken off")
        return df

    with pytest.raises(OSError, match="broken off"):
        resume.run_resumable(spark, d, work, path, "k", every=20)
    had = spark.read.parquet(path).count()
    assert 0 < had < 100
    out = resume.run_resumable(spark, d, lambda df: df, path, "k", every=20)
    assert out.count() == out.distinct().count() == 100


def small_blocks(spark, size):
    """Sets the bytes of a block; returns what puts the settings back."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    had = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    return lambda: [spark.conf.set(k, v) for k, v in had.items()]


def test_csv_by_blocks(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "say", "x,y", "line\nbreak", "\n\n", '"', "", "NA", "épée", "z" * 30])
    for name, n in (("one", 300), ("two", 40), ("header", 0)):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"]))
            out.writerow(["id", "text_id", "line_start", "line_end", "transliteration"])
            out.writerows([i, f"{name}{i}", i, i + 1, " ".join(word() for _ in range(rng.randrange(60)))] for i in range(n))
    (tmp_path / "empty.csv").write_text("")
    schema = corpora.SCHEMAS["test"]
    want = sorted(map(tuple, corpora.read_csv(spark, str(tmp_path), schema).collect()), key=str)
    back = small_blocks(spark, 200)
    try:
        for most in (corpora.MOST_BLOCKS, 0):
            d = corpora.read_csv_by_blocks(spark, str(tmp_path), schema, most_blocks=most)
            assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 100
            rows = d.collect()
            assert all(r["_bad"] is None for r in rows)
            assert sorted((tuple(r)[:-1] for r in rows), key=str) == want
    finally:
        back()
    assert len(want) == 340


def test_csv_quarantine(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,translation\n1,a\n\nx,b\n3\n4,c,d\n5,"e\n,f"\n6,NA\n')
    rows = corpora.read_csv_by_blocks(spark, str(tmp_path), corpora.SCHEMAS["submission"]).collect()
    assert sorted((r["_bad"] for r in rows if r["_bad"] is not None)) == ["3", "4,c,d", "x,b"]
    assert sorted(tuple(r)[:2] for r in rows if r["_bad"] is None) == [(1, "a"), (5, "e\n,f"), (6, None)]

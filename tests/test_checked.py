import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexiforge.functions import quality
from lexiforge.sources import checked


def test_attrition_with_the_write(spark, tmp_path):
    rows = [("one two three four", "the cat is in the house"), ("a", "b"), (None, "the cat"), ("one two three four", "le chat dort bien ici"), ("<gap> <gap> <gap>", "the cat is in the house")] * 40
    d = spark.createDataFrame(rows, "src string, tgt string").repartition(5)
    steps = {"length": quality.length_ok(F.col("src"), F.col("tgt")), "gaps": quality.gap_ratio(F.col("src")) < 0.7, "language": quality.looks_english(F.col("tgt"))}
    seen, left, want = Observation(), d, {}
    checked.filtered(d, steps, seen).write.parquet(str(tmp_path / "kept"))
    for name, keep in steps.items():
        kept = left.where(keep)
        want[name] = left.count() - kept.count()
        left = kept
    assert seen.get == {"rows": 200, **want} and 0 < sum(want.values()) < 200
    assert spark.read.parquet(str(tmp_path / "kept")).count() == left.count()


def test_attrition_of_nothing(spark):
    seen = Observation()
    assert checked.filtered(spark.createDataFrame([], "src string"), {"some": F.col("src") != ""}, seen).count() == 0
    assert seen.get == {"rows": 0, "some": 0}


def test_conforming_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    d = spark.createDataFrame([(1, "a"), (2, None)], "id int, `a.b` string")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("one write"))
    spark.sparkContext.setJobGroup("one write", "")
    assert checked.write_conforming(d, path, ["id", "a.b"], rows=2, not_null=["id"]) == {"rows": 2, "id": 0}
    assert jobs() == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for kw, said in (({"rows": 3}, "2 rows, not 3"), ({"not_null": ["a.b"]}, "1 nulls in a.b")):
        with pytest.raises(ValueError, match=said):
            checked.write_conforming(d.withColumn("id", F.col("id") + 7), path, ["id", "a.b"], **kw)
    with pytest.raises(ValueError, match="columns"):
        checked.write_conforming(d, path, ["id"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2]
    assert [f.name for f in tmp_path.iterdir()] == ["out"]

"""The shared folder's paths, and joins with hot keys."""

import collections

from pyspark.sql import functions as F

from lexiforge.llm import common


def test_paths_as_arrow_names_them():
    assert common.arrow_uri("s3a://b/x/y") == common.arrow_uri("s3n://b/x/y") == "s3://b/x/y"
    assert common.arrow_uri("file:/tmp/x") == common.arrow_uri("file:///tmp/x") == "file:///tmp/x"
    assert common.arrow_uri("hdfs://n:8020/x") == "hdfs://n:8020/x"


def test_a_path_without_a_scheme_is_in_the_default_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    assert common.arrow_uri(common.qualified(spark, str(tmp_path))) == f"file://{tmp_path}"
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./shared", f"file://{tmp_path}")
        assert common.qualified(spark, "/shared/x") == "viewfs://cluster/shared/x"
    finally:
        conf.set("fs.defaultFS", default)
    ws = common.Workspace(spark, "t")
    assert ws.table(spark.range(5), "five").count() == 5 and common.filesystem(ws.at("five"))[0].get_file_info(common.filesystem(ws.at("five"))[1]).is_file is False


def test_hot_join(spark):
    """Keys above a small threshold, null among them, are salted; the rows are those of a plain join."""
    rows = [(k, i) for i in range(300) for k in (["a", None, "b"][min(i % 7, 2)], f"k{i % 50}")]
    d = spark.createDataFrame(rows, "k string, _salt int").repartition(5)
    counts = collections.Counter(k for k, _ in rows)
    keyed = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items()] + [("unused", 0, "x")], "k string, n long, _key string")
    for threshold in (1, 20, 10_000):
        got = sorted(((r.k, r._salt, r.n, r._key) for r in common.hot_join(d, keyed, "k", "n", threshold, 8).select(d["k"], "_salt", "n", "_key").collect()), key=str)
        assert got == sorted(((k, i, counts[k], f"v{k}") for k, i in rows), key=str)

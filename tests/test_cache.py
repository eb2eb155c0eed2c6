"""The parse cache: only new texts are parsed, once for each version, and what a dead run has left is never read."""

from pyspark.sql import functions as F

from sparkloom.operators import nodes as no
from sparkloom.plans.cache import ParseCache
from sparkloom.plans.structure import parse_regex

FILES = "file_path string, language string, text string"


def rows(df):
    return sorted((r.file_path, r.line, r.node_type, r.raw_text) for r in df.collect())


def test_second_run_parses_nothing(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", "import os\nf(1)\n"), ("b.py", "python", "import os\nf(1)\n"), ("c.py", None, None), ("d.py", "python", "g()"), ("e.py", "python", "")], FILES)
    cache = ParseCache(spark, str(tmp_path / "c"), "v1", parse_regex)
    first = rows(cache.nodes(files))
    assert cache.parsed == 4
    assert first == rows(no.fallback_nodes(files.fillna("", ["text"])))
    assert rows(cache.nodes(files)) == first and cache.parsed == 0
    changed = files.withColumn("text", F.when(F.col("file_path") == "d.py", "h()").otherwise(F.col("text")))
    assert [r for r in rows(cache.nodes(changed)) if r[0] == "d.py"] == [("d.py", 1, "CALL", "h")] and cache.parsed == 1
    assert ParseCache(spark, str(tmp_path / "c"), "v1", parse_regex).nodes(files.limit(0)).collect() == []
    other = ParseCache(spark, str(tmp_path / "c"), "v2", parse_regex)
    assert rows(other.nodes(files)) == first and other.parsed == 4


def test_a_dead_run_is_not_read(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "python", "f(1)")], FILES)
    path = str(tmp_path / "c")

    def dies(new):
        # rows are there, the entry of what is done is not
        parse_regex(new).withColumns({"version": F.lit("v1"), "run": F.lit("0")}).write.mode("append").partitionBy("version", "run").parquet(f"{path}/rows")
        raise OSError("lost")

    try:
        ParseCache(spark, path, "v1", dies).nodes(files)
    except OSError:
        pass
    cache = ParseCache(spark, path, "v1", parse_regex)
    assert rows(cache.nodes(files)) == [("a.py", 1, "CALL", "f")] and cache.parsed == 1

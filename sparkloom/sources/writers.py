"""Sinks: graph tables as Parquet partitioned by session or buckets of sessions, with upsert, session deletes, delivery of verified files, documents and audit rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..scratch import Scratch


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The table with what its folders' names say as text: Spark would read session ids like numbers as numbers."""
    kinds = spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled")
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", kinds)


def bucket(columns: list[str], session: Column) -> tuple[str, Column] | None:
    """A table's column of buckets and the bucket of a session there; None where each session has a folder of its own. The column's name tells how many there are."""
    name = next((c for c in columns if re.fullmatch(r"_of\d+", c)), None)
    return (name, F.pmod(F.xxhash64(session.cast("string")), F.lit(int(name[3:]))).cast("string")) if name else None


def upsert(spark: SparkSession, rows: DataFrame, path: str, key: list[str], order: str | None = None, partition: str = "session_id", buckets: int | None = None) -> None:
    """Merge rows by key into a table partitioned by session: of several new rows the last by order, overlaid on the old one.

    A null of the new row keeps the old row's value, as setting properties would. Without an order, the row of the greatest hash of all columns is
    the last. Each session has its folder, or, for a new table of many sessions, one of so many buckets: the number of files is bounded then. Only
    folders whose rows change are rewritten (dynamic overwrite), their rows sorted by session and key. The merge is written to the shared folder first, as a table
    can't be read and overwritten in one job.
    """
    last = F.row_number().over(Window.partitionBy(partition, *key).orderBy(F.desc(order) if order else F.xxhash64(*rows.columns).desc()))
    rows = rows.withColumn("_r", last).where("_r = 1").drop("_r")
    old = _stored(spark, path) if _exists(spark, path) else None
    found = bucket(old.columns if old else [f"_of{buckets}"] if buckets else [], F.col(partition))
    place = found[0] if found else partition
    rows = rows.withColumn(*found) if found else rows
    if old:
        scratch, on = Scratch(spark, "upsert"), [partition, *key]
        rows, old = scratch.put(rows, "new"), old.withColumn(partition, F.col(partition).cast(rows.schema[partition].dataType))

        def those(df: DataFrame, places: DataFrame) -> DataFrame:
            places = places.select(F.col(place).alias("_place")).distinct()
            return df.join(places, F.col(place).eqNullSafe(F.col("_place")), "left_semi")

        def value(c: str) -> Column:
            return F.coalesce(*(F.col(f"{side}.`{c}`") for side, df in (("_new", rows), ("_old", old)) if c in df.columns))

        same = F.lit(True)
        for c in on:
            same = same & F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`"))
        both = those(old, rows).select(F.struct(*old.columns).alias("_old")).join(rows.select(F.struct(*rows.columns).alias("_new")), same, "full")
        columns = list(dict.fromkeys([*on, *rows.columns, *old.columns]))
        merged = both.select("_old", *[value(c).alias(c) for c in columns])
        if {f.name: f.dataType for f in old.schema} == {f.name: f.dataType for f in merged.schema if f.name != "_old"}:
            equal = F.col("_old").isNotNull()
            for c in columns:
                equal = equal & F.col(f"_old.`{c}`").eqNullSafe(F.col(f"`{c}`"))
        else:
            equal = F.lit(False)
        merged = scratch.put(merged.withColumn("_equal", equal).drop("_old"), "merged")
        rows = those(merged, merged.where("not _equal")).drop("_equal")
    rows = rows.hint("rebalance", place).sortWithinPartitions(*dict.fromkeys([place, partition, *key]))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(place).parquet(path)


def write_edges(spark: SparkSession, edges: DataFrame, nodes: DataFrame, path: str, buckets: int | None = None) -> None:
    """Upsert of edges whose two ends are nodes of their session; others are dropped, as a graph store's match would."""
    ids = nodes.select("session_id", F.col("node_id"))
    known = edges.join(ids.withColumnRenamed("node_id", "src"), ["session_id", "src"], "left_semi").join(ids.withColumnRenamed("node_id", "dst"), ["session_id", "dst"], "left_semi")
    upsert(spark, known, path, ["edge_id"], buckets=buckets)


def delete_session(spark: SparkSession, path: str, session: str) -> int:
    """Drop a session's partition, or its rows of its bucket; the number of rows it had.

    The folder is taken from the files that hold the session's rows, as Spark escapes what a path can't hold.
    """
    table = _stored(spark, path)
    found = bucket(table.columns, F.lit(session))
    here = table.where(F.col(found[0]) == found[1]) if found else table
    mine = here.where(F.col("session_id") == session)
    n = mine.count()
    if found:
        rest = here.where(~F.col("session_id").eqNullSafe(session))
        if n and not rest.isEmpty():
            Scratch(spark, "deleted").put(rest, "rest").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(found[0]).parquet(path)
            return n
    folders = [r[0] for r in mine.select(F.regexp_extract(F.input_file_name(), r"^(.*/(?:session_id|_of\d+)=[^/]*)/[^/]*$", 1)).distinct().collect()]  # one folder
    for folder in folders:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return n


def mark(nodes: DataFrame, marks: DataFrame, key: str = "node_id", column: str = "annotated") -> DataFrame:
    """Point updates: the column of marks where it has the key, else the old one."""
    new = marks.select(key, F.col(column).alias("_new"))
    return nodes.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def documents(rows: DataFrame, path: str) -> None:
    """One JSON document a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def deliver(approved: DataFrame, content: DataFrame) -> DataFrame:
    """Approved files (relative_path, sha256) with content whose hash is as approved; the others are dropped."""
    return content.join(approved.select("relative_path", F.col("sha256").alias("_sha")), "relative_path").where(F.sha2("content", 256) == F.col("_sha")).drop("_sha")


def to_memory(rows: DataFrame, name: str) -> DataFrame:
    """A session's rows as a temporary view, in place of a table, for tests and notebooks."""
    rows.createOrReplaceTempView(name)
    return rows.sparkSession.table(name)


#: The graph tables, partitioned by session; sorted by their key within files, so that point reads skip row groups.
TABLES = {
    "nodes": "session_id string, node_id string, node_type string, name string, file_path string, line int, col int, raw_text string, label string, confidence double, cwe string",
    "edges": "session_id string, edge_id string, src string, dst string, edge_type string",
    "findings": "session_id string, node_id string, cwe string, severity string, confidence double, title string",
    "audit": "session_id string, event string, stage string, error string",
}


def create_tables(spark: SparkSession, root: str, tables: dict[str, str] = TABLES) -> list[str]:
    """Make the tables that aren't there yet, empty; the names of those made. Calling it again makes none."""
    made = [name for name in tables if not _exists(spark, f"{root}/{name}")]
    for name in made:
        spark.createDataFrame([], tables[name]).write.parquet(f"{root}/{name}")
    return made


def seal(manifest: DataFrame) -> DataFrame:
    """The manifest of each session as one row: files, bytes and the digest of its sorted ``path:sha256`` lines."""
    from ..operators.findings import set_hash

    line = F.concat_ws(":", "relative_path", "sha256")
    sums = manifest.groupBy("session_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return sums.join(set_hash(manifest, ["session_id"], line), "session_id")


def append_unsealed(rows: DataFrame, sealed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) of new manifest rows (session_id, relative_path, ...): those of sealed sessions (session_id) are refused, a row each with its error."""
    shut = sealed.select("session_id").distinct()
    refused = rows.join(shut, "session_id", "left_semi").select("session_id", "relative_path", F.lit("MANIFEST_SEALED").alias("error"))
    return rows.join(shut, "session_id", "left_anti"), refused

"""Results by content: what a parser makes of a text is kept under the text's digest and the rules' version, and only new texts are parsed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import Scratch


class ParseCache:
    """Two tables under ``path``: ``rows`` (version, run; sha and a parser's columns) and ``done`` (version, run; sha).

    ``parse`` takes (sha, language, text) and returns rows with sha; it runs once for each distinct text of a language and version. Rows are written
    first, then the texts are entered as done: what a run that died has left is never read, and its texts are parsed again. Two runs at a
    time may both parse a text; the one of the lesser id counts. Files meet the cache by digest: texts that are known aren't shuffled.
    """

    def __init__(self, spark: SparkSession, path: str, version: str, parse: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.version, self.parse = spark, path.rstrip("/"), version, parse
        self.parsed = 0

    def _table(self, name: str, schema) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        known = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        return known.where(F.col("version") == self.version)

    def _done(self) -> DataFrame:
        return self._table("done", "sha string, version string, run string").groupBy("sha").agg(F.min("run").alias("run"))

    def nodes(self, files: DataFrame) -> DataFrame:
        """The parser's rows for files (file_path, language, text), with file_path; ``parsed`` is then the number of texts that were parsed.

        A null text is empty, a null language ``unknown``; files of equal texts share their rows, and a file listed twice has them twice.
        """
        plain = files.select("file_path", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("text", F.lit("")).alias("text"))
        named = plain.withColumn("sha", F.sha2(F.concat_ws("\n", "language", "text"), 256))
        run = uuid.uuid4().hex
        new = named.join(self._done().select("sha"), "sha", "left_anti").groupBy("sha").agg(F.first("language").alias("language"), F.first("text").alias("text"))
        new = Scratch(self.spark, "new").put(new, "texts")
        self.parsed = new.count()
        made = self.parse(new)
        if self.parsed:
            for name, rows in (("rows", made), ("done", new.select("sha"))):
                rows.withColumns({"version": F.lit(self.version), "run": F.lit(run)}).write.mode("append").partitionBy("version", "run").parquet(f"{self.path}/{name}")
        known = self._table("rows", made.withColumns({"version": F.lit(""), "run": F.lit("")}).schema).join(self._done(), ["sha", "run"], "left_semi")
        return named.select("file_path", "sha").join(known.drop("version", "run"), "sha").drop("sha")

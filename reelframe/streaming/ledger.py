"""Results that are written batch by batch and count only once their batch is committed.

A batch's rows go to a folder of their own. Then a manifest with the batch's number names that folder, by a rename,
which happens whole or not at all. Readers follow the manifests, so what a driver wrote before it died is invisible, and
a batch that is delivered again after its commit is left out. One query at a time writes to a ledger, as a streaming
checkpoint has one owner.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """A table of committed batches below a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, *parts: str):
        return self._fs_path("/".join([self.path, *parts]))

    def committed(self) -> dict[int, dict]:
        """The manifest of each committed batch."""
        if not self.fs.exists(self._place("manifests")):
            return {}
        rows = self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").schema("value string").text(f"{self.path}/manifests").collect()  # one line a batch
        return {m["batch"]: m for m in map(json.loads, (r.value for r in rows))}

    def write(self, rows: DataFrame) -> str:
        """Writes rows that nobody sees yet, and gives the folder's name."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def commit(self, batch: int, folder: str, base: bool = False) -> None:
        """Makes a folder the rows of a batch; a base stands for all batches up to it."""
        draft = self._place("drafts", f"{uuid.uuid4().hex}.json")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps({"batch": batch, "folder": folder, "base": base}).encode()))
        finally:
            out.close()
        self.fs.mkdirs(self._place("manifests"))
        target = self._place("manifests", f"{batch:020d}.json")
        if base and self.fs.exists(target):
            self.fs.delete(target, False)
        if not self.fs.rename(draft, target):
            raise OSError(f"batch {batch} could not be committed")

    def append(self, batch: int, rows: DataFrame) -> bool:
        """Writes and commits a batch, unless it is committed already; says whether it was new."""
        known = self.committed()
        if batch in known or any(m["base"] and batch <= b for b, m in known.items()):
            return False
        self.commit(batch, self.write(rows))
        return True

    def read(self, schema) -> DataFrame:
        """The rows of all committed batches, with their number as the column batch."""
        known = self.committed()
        base = max((b for b, m in known.items() if m["base"]), default=None)
        live = {m["folder"].rsplit("/", 1)[-1]: b for b, m in known.items() if base is None or b >= base}
        if not live:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        # one scan of all folders, however many batches there are; a file's folder tells its batch
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{name}" for name in live))
        rows = rows.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -2))
        numbers = self.spark.createDataFrame([*live.items()], "_folder string, batch long")
        return rows.join(F.broadcast(numbers), "_folder").drop("_folder")

    def latest(self, schema, *keys: str) -> DataFrame:
        """Of each key, the rows of the last batch that has any."""
        rows = self.read(schema)
        last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        return rows.join(last, [*keys, "batch"]).drop("batch")

    def compact(self, schema, *keys: str) -> None:
        """Puts the latest rows in the place of all batches, so that readers have one folder to follow."""
        known = self.committed()
        if known:
            self.commit(max(known), self.write(self.latest(schema, *keys)), base=True)

"""A closure kept up to date by micro-batches (for programs without retraction).

Each batch of new triples goes on from the stored closure: rules meet its triples with all others,
and what they newly derive is appended, as one Parquet folder a batch. (Programs with auxiliary
relations, which are not stored, are closed as a whole.) A batch that is run again after a failure writes
its folder again, so the closure has each triple once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.fixpoint import closure
from ..plans.ast import ERROR, Frame, Rule
from ..plans.check import has_retraction

SCHEMA = "s string, p string, o string"


class Maintained:
    """``path`` holds the closure; :meth:`update` is a ``foreachBatch`` sink."""

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule]):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _folders(self, before: int) -> list[str]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return [f"{self.path}/{n}" for n in sorted(names) if n.startswith("batch=") and int(n[6:]) < before]

    def triples(self, before: int = 1 << 60) -> DataFrame:
        paths = self._folders(before)
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def update(self, batch: DataFrame, batch_id: int) -> None:
        known, more = self.triples(batch_id), batch.select("s", "p", "o")
        alone = not has_retraction(self.rules) and all(isinstance(a.target, Frame) or a.target.name == ERROR for r in self.rules for a in r.actions)
        if alone and batch_id and self._folders(batch_id):
            done = closure(known, self.rules, delta=more)
        else:
            done = closure(known.unionByName(more), self.rules)
        new = done.triples.join(known, ["s", "p", "o"], "left_anti")
        new.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id:012d}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

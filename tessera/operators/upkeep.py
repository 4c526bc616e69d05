"""An index of chunks by document that is kept up in batches, each seen whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Index:
    """Batches under a place, and manifests that say which ones count.

    A batch is two tables: the chunks that it brings and the documents that it takes out, those that it brings among them. A
    chunk counts while no later batch has taken its document out. A manifest lists batches in their order; manifests are
    numbered and never written twice, the last one holds. A batch that dies before its manifest has not happened; one that
    is repeated under its name changes nothing. Two writers that meet: the second one's manifest exists already and it fails.
    """

    def __init__(self, spark: SparkSession, place: str):
        self.spark, self.place = spark, place
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}" if name else self.place)

    def _last(self) -> int:
        folder = self._path("manifest")
        if not self._fs.exists(folder):
            return 0
        return max((int(x.getPath().getName()) for x in self._fs.listStatus(folder) if x.getPath().getName().isdigit()), default=0)

    def batches(self) -> list[str]:
        """Names of the batches that count, oldest first."""
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.place}/manifest/{last:020d}").first()[0]) if last else []

    def _publish(self, names: list[str]) -> None:
        out = self._fs.create(self._path(f"manifest/{self._last() + 1:020d}"), False)
        try:
            out.write(bytearray(json.dumps(names).encode()))
        finally:
            out.close()

    def _write(self, name: str, chunks: DataFrame, gone: DataFrame) -> None:
        chunks.write.mode("overwrite").parquet(f"{self.place}/data/{name}/chunks")
        gone.write.mode("overwrite").parquet(f"{self.place}/data/{name}/gone")

    def apply(self, name: str, chunks: DataFrame, deleted: DataFrame | None = None, doc: str = "doc") -> bool:
        """Puts chunks in the place of what their documents had, and takes deleted documents out; False if the batch has been applied."""
        names = self.batches()
        if name in names:
            return False
        gone = chunks.select(doc) if deleted is None else chunks.select(doc).unionByName(deleted.select(doc))
        self._write(name, chunks, gone.where(F.col(doc).isNotNull()).distinct())
        self._publish([*names, name])
        return True

    def read(self, doc: str = "doc") -> DataFrame:
        """The chunks that count."""
        names = self.batches()
        if not names:
            raise ValueError("no batch has been applied")
        chunks = gone = None
        for k, name in enumerate(names):
            at = f"{self.place}/data/{name}"
            own, out = self.spark.read.parquet(f"{at}/chunks").withColumn("_batch", F.lit(k)), self.spark.read.parquet(f"{at}/gone").select(doc, F.lit(k).alias("_out"))
            chunks, gone = (own, out) if chunks is None else (chunks.unionByName(own, allowMissingColumns=True), gone.unionByName(out))
        later = gone.groupBy(doc).agg(F.max("_out").alias("_out"))
        return chunks.join(later, doc, "left").where(F.col("_out").isNull() | (F.col("_out") <= F.col("_batch"))).drop("_batch", "_out")

    def compact(self, name: str, doc: str = "doc") -> None:
        """One batch in the place of all: the same chunks."""
        names = self.batches()
        if names and names != [name]:
            whole = self.read(doc)
            self._write(name, whole, whole.select(doc).distinct())
            self._publish([name])

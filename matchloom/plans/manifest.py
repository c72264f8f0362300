"""Stage tables with a manifest: a run resumes only from stages made with the same settings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Parquet tables under one folder; settings that differ from those on record are an error."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict):
        self.spark, self.folder = spark, folder.rstrip("/")
        text = json.dumps(settings, sort_keys=True)
        if self._exists("manifest"):
            found = self.spark.read.text(f"{self.folder}/manifest").first()[0]
            if found != text:
                raise ValueError(f"{folder} holds stages of other settings: {found}")
        else:
            if self._exists(""):
                raise ValueError(f"{folder} holds stages of unknown origin")
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path if name in ("", "manifest") else path.suffix("/_SUCCESS"))

    def table(self, name: str, make) -> DataFrame:
        """The table of a finished stage, or that of ``make()``, which is written first."""
        if not self._exists(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

"""Built tables (dictionaries, embeddings) that are kept under a hash of what they were built with."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marginalia.schema import make_uid


class Registry:
    """Paths of installed resources by their parameters (version, language, flags); exact matches only."""

    def __init__(self):
        self.paths: dict[str, str] = {}

    @staticmethod
    def key(**parameters) -> str:
        return json.dumps(parameters, sort_keys=True, default=str)

    def add(self, path: str, **parameters) -> None:
        self.paths[self.key(**parameters)] = str(path)

    def get(self, **parameters) -> str:
        key = self.key(**parameters)
        if key not in self.paths:
            raise KeyError(f"nothing is installed for {key}; there is: {sorted(self.paths)}")
        return self.paths[key]

    def clear(self) -> None:
        self.paths.clear()


def cached(spark: SparkSession, folder: str, name: str, parameters: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that `build` gives, written once per set of parameters; other parameters never read it."""
    path = f"{folder}/{name}-{make_uid(name, json.dumps(parameters, sort_keys=True, default=str))}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def describe(folder: str) -> list[str]:
    """Names of the tables in a local folder."""
    return sorted(p.name for p in Path(folder).iterdir() if (p / "_SUCCESS").exists())

"""Fitted models kept under the shared folder, named by what they were fitted on.

A model's name is a digest of its parameters and of its training rows (count, sum
and exclusive or of their 64-bit hashes: one aggregate pass, independent of order
and partitioning). A job that meets a name that is complete loads it instead of
fitting again; changed rows or parameters give another name, so nothing stale is
read. A folder counts only once its marker file is there, which is written last:
a driver lost while saving leaves a folder that the next job replaces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triageflow.session import checkpoint_root

MARKER = "_COMPLETE"


def fingerprint(rows: DataFrame, columns: list[str], **params) -> str:
    """Name of a model fitted on these columns of ``rows`` with ``params``."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"),
                    F.bit_xor(F.xxhash64(F.lit("x"), *[F.col(c) for c in columns])).alias("x")).first()
    told = {"rows": [str(v) for v in seen], "columns": columns, "params": params, "spark": pyspark.__version__}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:32]


class ModelStore:
    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/models/{name}"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def has(self, key: str) -> bool:
        return self._fs().exists(self._path(f"{self.path(key)}/{MARKER}"))

    def load_or_fit(self, key: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """The stored model of this key, fitted and stored first if there is none.
        Also a model just fitted is returned as loaded."""
        if not self.has(key):
            fit().write().overwrite().save(f"{self.path(key)}/model")
            self._fs().create(self._path(f"{self.path(key)}/{MARKER}"), True).close()
        return PipelineModel.load(f"{self.path(key)}/model")

    def keys(self) -> list[str]:
        """Complete models, the latest first."""
        if not self._fs().exists(self._path(self.root)):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs().listStatus(self._path(self.root))]
        return [key for _, key in sorted(found, reverse=True) if self.has(key)]

    def prune(self, keep: int) -> list[str]:
        """Delete all but the ``keep`` latest models; the deleted keys."""
        gone = self.keys()[keep:]
        for key in gone:
            self._fs().delete(self._path(self.path(key)), True)
        return gone

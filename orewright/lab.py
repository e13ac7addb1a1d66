"""A folder for raw files and tables that queries make for themselves, in a place that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.store import Store

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master whose session names none."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="orewright-lab-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


class Lab:
    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/lab-{uuid.uuid4().hex}"
        self.data, self.store = f"{self.root}/data", Store(spark, f"{self.root}/warehouse")

    def csv(self, path: str, df: DataFrame) -> str:
        """``df`` as CSV files with headers, in the folder ``path`` under the data folder."""
        df.write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{self.data}/{path}")
        return f"{self.data}/{path}"

    def lines(self, path: str, df: DataFrame, line: Column) -> str:
        """One line of text for each row."""
        df.select(line.alias("value")).write.mode("overwrite").text(f"{self.data}/{path}")
        return f"{self.data}/{path}"

    def document(self, path: str, features: DataFrame, order: str, text: str) -> str:
        """A feature collection of a small table of features (JSON text), in the order of a column."""
        one = features.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), ", ").alias("f"))
        return self.lines(path, one, F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.col("f"), F.lit("]}")))

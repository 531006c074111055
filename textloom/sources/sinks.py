"""Run files, saved norms and chart data."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BM25, Analyzer
from ..operators.index import Index, stop_words
from ..operators.weights import document_norms


def run_name(run_id: int, tag: str, scheme: str, config: Analyzer, granularity: str = "article", p: BM25 = BM25(), n_stop: int | None = None) -> str:
    """The name of a run file, which states the configuration; the stop list by the number of its words, or by one that is given, such as the lines of its file."""
    stop = f"stop{len(stop_words(config)) if n_stop is None else n_stop}" if config.stop else "nostop"
    stem = "porter" if config.stem else "nostem"
    extra = f"_k{p.k1}_b{p.b}" if scheme == "bm25" else ""
    return f"{tag}_{run_id}_test_{scheme}_{granularity}_{stop}_{stem}{extra}.txt"


def run_lines(ranking: DataFrame, tag: str, element: str = "/article[1]") -> DataFrame:
    """query_id, rank, line: each ranked document as a line of a TREC run; scores have six digits."""
    line = F.format_string("%s Q0 %s %s %.6f %s %s", F.col("query_id"), F.col("doc_id"), F.col("rank"), F.col("score"), F.lit(tag), F.lit(element))
    return ranking.select("query_id", "rank", line.alias("line"))


def write_run(ranking: DataFrame, path: str, tag: str) -> None:
    """One text file in a folder, in the order of query and rank; an earlier run there is replaced."""
    run_lines(ranking, tag).orderBy("query_id", "rank").select("line").coalesce(1).write.mode("overwrite").text(path)


def next_run_id(spark: SparkSession, folder: str) -> int:
    """The number of entries of the folder, which must exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


class NormCache:
    """Document norms saved as Parquet, by source and configuration."""

    def __init__(self, spark: SparkSession, folder: str, source: str, config: Analyzer):
        key = hashlib.sha256(repr((source, config)).encode()).hexdigest()[:24]
        self.spark, self.path = spark, f"{folder.rstrip('/')}/norms-{key}"

    def _files(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def load(self, index: Index) -> DataFrame:
        """The saved norms, computed and saved first if there are none."""
        path, fs = self._files()
        if not fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")):
            document_norms(index).write.mode("overwrite").parquet(self.path)
        return self.spark.read.parquet(self.path)

    def clear(self) -> None:
        path, fs = self._files()
        if fs.exists(path):
            fs.delete(path, True)


def chart_single(results: list[dict], metric: str, x: str = "file") -> list[tuple]:
    """(x, y) of one series, in order."""
    return [(r[x], r["statistics"].get(metric, r.get(metric))) for r in results]


def chart_comparison(spark: SparkSession, series: dict[str, list[float]], labels: list[str]) -> DataFrame:
    """series, x, y: series as long as the labels, and one-point series at the last label; others are left out."""
    rows = []
    for name, values in series.items():
        if len(values) == len(labels):
            rows += [(name, x, float(y)) for x, y in zip(labels, values, strict=True)]
        elif len(values) == 1 and labels:
            rows.append((name, labels[-1], float(values[0])))
    return spark.createDataFrame(rows, "series string, x string, y double")

"""Reading and writing record collections."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialize

RECORD_SCHEMA = "id string, title string, description string, genres array<string>, year int, rating double, popularity bigint"


def read_json_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """One JSON array, or a file of lines; the schema is never inferred.  ``path`` may be on any file system."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_with_progress(records: DataFrame, tell: Callable[[int, int], None], every: float = 0.2) -> DataFrame:
    """Read and keep ``records``, telling now and then how many tasks of how many are done; a failure is raised as usual."""
    context = records.sparkSession.sparkContext
    group, out, failed = f"load-{uuid.uuid4().hex}", [], []

    def load() -> None:
        context.setJobGroup(group, "load records")
        try:
            out.append(materialize(records, "loaded"))
        except Exception as e:  # noqa: BLE001, raised by the caller's thread
            failed.append(e)

    thread = InheritableThread(load, session=records.sparkSession)
    thread.start()
    tracker = context.statusTracker()
    while thread.is_alive():
        thread.join(every)
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        stages = [i for j in jobs if j for s in j.stageIds if (i := tracker.getStageInfo(s))]
        if stages:
            tell(sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages))
    if failed:
        raise failed[0]
    return out[0]


def read_parquet_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def records_from_rows(spark: SparkSession, rows: Iterable[dict], schema: str = RECORD_SCHEMA) -> DataFrame:
    """Rows in memory; each record's place becomes its ordinal."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = [(*(r.get(n) for n in names), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"{schema}, doc_ord bigint")


def write_json_array(df: DataFrame, path: str) -> None:
    """All rows as one JSON array in one file, streamed through the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            f.write(",\n" * bool(i) + row["j"])
        f.write("]\n")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)


def read_or_generate(spark: SparkSession, path: str, generate: Callable[[], Iterable[dict]]) -> DataFrame:
    return read_json_records(spark, path) if os.path.exists(path) else records_from_rows(spark, generate())


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def summary(records: DataFrame) -> DataFrame:
    """One row: number of records, of distinct genres, and the first and last year."""
    genres = records.select(F.explode("genres").alias("g")).agg(F.count_distinct("g").alias("genres"))
    years = records.agg(F.count("*").alias("records"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return years.join(F.broadcast(genres))  # one row each

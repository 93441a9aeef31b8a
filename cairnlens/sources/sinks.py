"""Writers: findings of a run, event rows, report snapshots."""

from __future__ import annotations

import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cairnlens.functions.keyed import numbered
from cairnlens.functions.predicates import event_severity, instant
from cairnlens.operators.nested import event_payload
from cairnlens.session import shared_folder

BUCKET = "run_bucket"
LIST = "buckets-"
COMMIT, ASIDE = "commit-", ".list-"
SPREAD = 64  # tasks that may share the rows of one bucket
LARGE_RUN = 1 << 17  # rows; larger runs are spread over the tasks of their bucket
NAMED, NEW, OLD = 0, 1, 2
KIND, PLACE, LARGE = "_kind", "_place", "_large"
PART_RECORDS = 20000
BATCH, DONE = "batch", "_SUCCESS"


def replace_findings(
    spark: SparkSession, path: str, findings: DataFrame, runs: DataFrame, buckets: int = 1024,
    run_column: str = "run_id", attempts: int = 10,
) -> None:
    """Replace all findings of the given runs; repeating the call changes nothing.

    ``runs`` names the runs, so one that now has no findings loses its old rows. Rows
    lie in hash buckets of the run. A commit writes the touched buckets, with the
    other runs' rows carried over, to a folder of its own, then a new list of which
    folder holds each bucket (at most ``buckets`` entries). Readers follow the newest
    list, so a commit shows whole or not at all, and an emptied bucket is not listed.
    A writer that finds its number taken by another one starts anew from that one's
    list, up to ``attempts`` times. Rows are shuffled once, together with the names of the
    runs: within a bucket by run, those of a run of more than ``LARGE_RUN`` rows by content.
    """
    for _ in range(attempts):
        if _committed(spark, path, findings, runs, buckets, run_column):
            return
    raise RuntimeError(f"other commits were faster {attempts} times")


def _committed(spark, path, findings, runs, buckets, run_column) -> bool:
    bucket = F.pmod(F.xxhash64(run_column), F.lit(buckets)).cast("int")
    kind = findings.schema[run_column].dataType
    named = runs.select(F.col(run_column).cast(kind)).dropna()
    touched = {r[0] for r in named.select(bucket).distinct().collect()}
    number, places = _current(spark, path)
    old = [f"{path}/{folder}/{BUCKET}={b}" for b, folder in places.items() if b in touched]
    rows = findings.withColumn(KIND, F.lit(NEW))
    if old:
        stored = spark.read.schema(findings.schema).parquet(*old).select(*findings.columns)
        rows = rows.unionByName(stored.withColumn(KIND, F.lit(OLD)))
    rows = rows.dropna(subset=[run_column])
    sizes = rows.groupBy(run_column).agg(F.count("*").alias(LARGE))
    large = spark.createDataFrame(  # few: each stands for LARGE_RUN rows
        [(r[0], True) for r in sizes.where(F.col(LARGE) > LARGE_RUN).collect()],
        StructType([StructField(run_column, kind), StructField(LARGE, BooleanType())]),
    )
    by_run = F.array(F.pmod(F.xxhash64(run_column, F.lit(SPREAD)), F.lit(SPREAD)).cast("int"))
    by_content = F.array(F.pmod(F.xxhash64(*findings.columns), F.lit(SPREAD)).cast("int"))

    def placed(df: DataFrame, of_large: Column) -> DataFrame:
        held = df.join(F.broadcast(large), run_column, "left").withColumn(BUCKET, bucket)
        return held.withColumn(PLACE, F.explode(F.when(F.col(LARGE), of_large).otherwise(by_run))).drop(LARGE)

    names = placed(named.distinct().withColumn(KIND, F.lit(NAMED)), F.array(*map(F.lit, range(SPREAD))))
    together = placed(rows, by_content).unionByName(names, allowMissingColumns=True).repartition(BUCKET, PLACE)
    # The name of a run, if it is there, comes before the run's rows.
    so_far = Window.partitionBy(BUCKET, PLACE, run_column).orderBy(KIND).rowsBetween(Window.unboundedPreceding, 0)
    new = together.withColumn(PLACE, F.min(KIND).over(so_far)).where(
        F.when(F.col(PLACE) == NAMED, F.col(KIND) == NEW).otherwise(F.col(KIND) == OLD)
    ).select(*findings.columns, BUCKET)
    folder = f"{COMMIT}{uuid.uuid4().hex}"
    new.write.option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/{folder}")
    written = {int(name.split("=")[1]) for name in _names(spark, f"{path}/{folder}") if name.startswith(f"{BUCKET}=")}
    places = {b: f for b, f in places.items() if b not in touched} | dict.fromkeys(written, folder)
    return _publish(spark, path, number + 1, places)


def expire_findings(spark: SparkSession, path: str, keep: int = 1, older_than_seconds: int = 86400) -> list[str]:
    """Delete what no longer counts; returns the names that went.

    Kept are the newest ``keep`` lists with the folders they name, which readers may be
    at, and all that is younger than ``older_than_seconds``, which writers may be at.
    """
    target, files = _file_system(spark, path)
    found = {s.getPath().getName(): s for s in files.listStatus(target)} if files.exists(target) else {}
    numbers = sorted(int(n[len(LIST):]) for n in found if n.startswith(LIST))[-keep:]
    wanted = {f"{LIST}{n}" for n in numbers}
    for n in numbers:
        wanted |= set(_listed(spark, path, n).values())
    last = time.time() * 1000 - older_than_seconds * 1000
    gone = [
        name for name, status in found.items()
        if name.startswith((LIST, COMMIT, ASIDE)) and name not in wanted and status.getModificationTime() < last
    ]
    for name in gone:
        files.delete(found[name].getPath(), True)
    return sorted(gone)


def stored_findings(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of the newest commit."""
    _, places = _current(spark, path)
    paths = [f"{path}/{folder}/{BUCKET}={b}" for b, folder in sorted(places.items())]
    reader = spark.read.schema(schema)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], schema)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    target, files = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []


def _listed(spark: SparkSession, path: str, number: int) -> dict[int, str]:
    rows = spark.read.schema("bucket INT, folder STRING").json(f"{path}/{LIST}{number}").collect()
    return {r["bucket"]: r["folder"] for r in rows}


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Number of the newest list of buckets and its content."""
    numbers = [int(n[len(LIST):]) for n in _names(spark, path) if n.startswith(LIST)]
    return (max(numbers), _listed(spark, path, max(numbers))) if numbers else (0, {})


def _publish(spark: SparkSession, path: str, number: int, places: dict[int, str]) -> bool:
    """Write the list aside, then rename it into place; false if the number is taken."""
    rows = spark.createDataFrame(sorted(places.items()), "bucket INT, folder STRING")
    aside = f"{path}/{ASIDE}{uuid.uuid4().hex}"
    rows.coalesce(1).write.json(aside)
    source, files = _file_system(spark, aside)
    target, _ = _file_system(spark, f"{path}/{LIST}{number}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    kind = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.valueOf("NONE")
    try:  # unlike FileSystem.rename, this one never moves into a folder that is there
        hadoop.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(
            files.makeQualified(source), files.makeQualified(target), options
        )
    except Py4JJavaError:
        if not files.exists(target):
            raise
        return False
    return True


def event_rows(tasks: DataFrame, event_type: str, message: str, now) -> DataFrame:
    """Event rows describing the present state of the given tasks."""
    return event_payload(tasks).select(
        F.col("id").alias("task_id"),
        "event_sequence",
        F.lit(event_type).alias("event_type"),
        "stage",
        event_severity().alias("severity"),
        F.lit(message).alias("message"),
        "payload",
        instant(now).alias("created_at"),
    )


def append_events(rows: DataFrame, path: str, batch: str) -> None:
    """Append the rows of one batch; repeating the call with its name changes nothing.

    A batch has a folder of its own, which counts from its completion mark on. One that
    was left unfinished is written anew.
    """
    folder = f"{path}/{BATCH}={batch}"
    if DONE not in _names(rows.sparkSession, folder):
        rows.write.mode("overwrite").parquet(folder)


def stored_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all batches that were written to their end."""
    folders = [f"{path}/{n}" for n in _names(spark, path) if n.startswith(f"{BATCH}=")]
    whole = [f for f in folders if DONE in _names(spark, f)]
    return spark.read.schema(schema).parquet(*whole) if whole else spark.createDataFrame([], schema)


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream's micro-batches; one that is run again after a failure is not
    appended twice. Returns the started query, which ends with the data present."""
    return (
        stream.writeStream.foreachBatch(lambda rows, number: append_events(rows, path, f"{number:012d}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def numbered_events(new: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """``new`` events, any number a task, with the sequence numbers that follow the
    stored ones of their task, in ``order``."""
    last = stored.groupBy("task_id").agg(F.max("event_sequence").alias("_last"))
    counted = numbered(new, "task_id", order, "_at", shared_folder(new.sparkSession))
    return counted.join(last, "task_id", "left").withColumn(
        "event_sequence", F.coalesce("_last", F.lit(0)) + F.col("_at") + 1
    ).drop("_last", "_at")


def snapshot_records(sections: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """Records of all report sections as (task_id, section, position, JSON).

    ``sections`` maps a name to its rows (with ``task_id``) and their order columns, of
    any number and type; position counts a task's records of the section from 0. A task
    with most of a section's rows is numbered by many tasks of the job.
    """
    parts = []
    for name, (df, order) in sections.items():
        fields = [column for column in df.columns if column != "task_id"]
        places = [f"_order{i}" for i in range(len(order))]
        rows = df.select(
            "task_id",
            F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"),
            *[column.alias(place) for column, place in zip(order, places)],
        )
        counted = numbered(rows, "task_id", places, "position", shared_folder(df.sparkSession))
        parts.append(counted.select("task_id", F.lit(name).alias("section"), "position", "record"))
    return reduce(DataFrame.unionByName, parts)


def snapshot_counts(records: DataFrame, limit: int | None = None) -> DataFrame:
    """Records per task and section, and whether the section is over ``limit``."""
    over = F.col("record_count") > limit if limit is not None else F.lit(False)
    return (
        records.groupBy("task_id", "section")
        .agg(F.count("*").alias("record_count"))
        .withColumn("over_limit", over)
    )


def snapshot_documents(records: DataFrame, part_records: int = PART_RECORDS) -> DataFrame:
    """JSON arrays of each task and section, in parts of ``part_records`` records.

    Sections of any size are written; a part gathers a bounded number of records.
    """
    gathered = (
        records.withColumn("part", F.floor(F.col("position") / part_records).cast("int"))
        .groupBy("task_id", "section", "part")
        .agg(F.sort_array(F.collect_list(F.struct("position", "record"))).alias("_rows"))
    )
    body = F.concat(
        F.lit("["), F.array_join(F.transform("_rows", lambda r: r["record"]), ","), F.lit("]")
    )
    return gathered.select("task_id", "section", "part", body.alias("records"))


def write_snapshot(documents: DataFrame, path: str) -> None:
    """Packed JSON lines, one folder per section, one line per task and part."""
    documents.write.mode("overwrite").partitionBy("section").option("compression", "gzip").json(path)


def stored_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """task_id, section, part, records: the parts of each section, from 0."""
    return spark.read.schema("task_id BIGINT, part INT, records STRING, section STRING").json(path).select(
        "task_id", "section", "part", "records"
    )

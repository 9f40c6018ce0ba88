"""Sources and sinks: typed CSV, JSON, optional and best sources, manifests, resumable writes."""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.sequence import is_dna, normalise_dna
from ..operators.contracts import ContractError, plain

RAW = T.StructType([T.StructField("id", T.StringType()), T.StructField("sequence", T.StringType()), T.StructField("efficiency", T.StringType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header, by a stated schema; columns are taken by name."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV without reading its rows."""
    return spark.read.csv(path, header=True).columns


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def hadoop_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p))


def optional(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet") -> DataFrame:
    """The table at a path, or an empty one of the schema."""
    return spark.read.schema(schema).format(kind).load(path) if exists(spark, path) else spark.createDataFrame([], schema)


def require_files(spark: SparkSession, paths: list[str]) -> None:
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise ContractError(f"missing files: {', '.join(missing)}")


def find_files(spark: SparkSession, root: str, pattern: str, without: tuple[str, ...] = ()) -> DataFrame:
    """(path, length) of files under a root whose name matches, but for folders that are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")
    for name in without:
        files = files.where(~F.col("path").contains(f"/{name}/"))
    return files


def resolve_file(files: DataFrame, name: str) -> tuple[str | None, DataFrame]:
    """The path of the file of just this name, the first by path, and a table (path) of its duplicates."""
    same = files.where(F.element_at(F.split("path", "/"), -1) == name).select("path")
    first = same.agg(F.min("path")).first()[0]
    return first, same.where(F.col("path") > F.lit(first))


def best_source(spark: SparkSession, paths: list[str], needed: list[str], words: list[str]) -> str | None:
    """The CSV whose header holds most of the needed columns, whose name holds most of the words, with most rows.

    Rows are counted only where header and name leave several, in one job."""
    scored = []
    for p in paths:
        columns = {plain(c) for c in header(spark, p)}
        scored.append((sum(plain(c) in columns for c in needed), sum(w in p.lower() for w in words), p))
    top = max((x[:2] for x in scored), default=(0, 0))
    left = sorted(p for *x, p in scored if tuple(x) == top)
    if not top[0]:
        return None
    if len(left) == 1:
        return left[0]
    counts = {p: spark.read.csv(p, header=True).groupBy(F.lit(p).alias("path")).count() for p in left}
    every = None
    for c in counts.values():
        every = c if every is None else every.unionByName(c)
    rows = {r[0]: r[1] for r in every.collect()}
    return max(left, key=lambda p: (rows.get(p, 0), p))


def read_folders(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All CSVs of the folders under a root as one table, with ``source_file`` and the folder as ``source_folder``."""
    rows = spark.read.option("recursiveFileLookup", "true").csv(root, header=True, schema=schema).withColumn("source_file", F.col("_metadata.file_path"))
    return rows.withColumn("source_folder", F.element_at(F.split("source_file", "/"), -2))


def clean_sequences(df: DataFrame, order: str, sequence: str = "sequence", efficiency: str = "efficiency") -> DataFrame:
    """Rows with a DNA sequence and a number, and a string ``id`` by order where there is none.

    Ids follow a range partitioning: each partition's count is added up for those after it."""
    df = df.withColumn(sequence, normalise_dna(F.col(sequence))).withColumn(efficiency, F.expr(f"try_cast(`{efficiency}` as double)"))
    df = df.where(F.col(efficiency).isNotNull() & F.col(sequence).isNotNull() & is_dna(F.col(sequence)))
    return df if "id" in df.columns else with_row_number(df, order, "id", as_string=True)


def with_row_number(df: DataFrame, order: str, name: str, as_string: bool = False) -> DataFrame:
    """Adds 0, 1, 2, ... by a unique numeric order, without one window over all rows."""
    from ..functions.statistics import value_ranges

    dealt = value_ranges(df, order)
    before = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    number = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn(name, number.cast("string" if as_string else "long")).drop("_range", "_before")


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a plan that are not done yet."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str], batch: int | None = None) -> int:
    """Writes the rows whose keys earlier batches of a table don't hold as its next batch, and returns their count.

    A batch is a folder ``batch=N`` of the table, written once and as a whole: a rerun after a failure takes the place of what
    the failed run left. Of rows with equal keys within a batch one stays. The table has the column ``batch``."""
    spark = rows.sparkSession
    numbers = batches(spark, path)
    number = batch if batch is not None else max(numbers, default=-1) + 1
    earlier = [n for n in numbers if n != number]
    new = rows.dropDuplicates(keys)
    if earlier:
        new = remaining(new, spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in earlier)), keys)
    new.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return spark.read.parquet(f"{path}/batch={number}").count()


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches of a table that were written as a whole."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    names = [x.getPath() for x in fs.listStatus(p)]
    done = [x for x in names if x.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return sorted(int(x.getName().split("=")[1]) for x in done)


def with_offsets(rows: DataFrame, done: DataFrame, job: str, order: str, name: str = "sample_number") -> DataFrame:
    """Numbers rows of each job on from the highest number that is done: done + 0, done + 1, ... by a numeric order.

    No window holds more than a range of a job's rows."""
    from ..functions.statistics import value_ranges
    from ..operators.folds import numbered

    last = done.groupBy(job).agg((F.max(name) + 1).alias("_done"))
    local = numbered(value_ranges(rows, order, "_part"), [job], [order], "_local", "_part")
    return local.join(last, job, "left").withColumn(name, (F.coalesce("_done", F.lit(0)) + F.col("_local") - 1).cast("long")).drop("_local", "_done")


def complete(cache: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Keys of a cached result that hold all their rows."""
    return cache.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == expected).select(*keys)


def json_safe(value: object) -> object:
    """A nested value with what JSON can't hold as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def write_manifest(spark: SparkSession, path: str, facts: dict) -> None:
    """A JSON file of facts about a run, through the file system that the path names."""
    row = spark.createDataFrame([(json.dumps(json_safe(facts), sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the session names. Only a local session that names none, as in tests, gets a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="helixmill-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, by: list[str] | None = None, clean: bool = False) -> DataFrame:
    """The table written under the session's shared folder and read again, so that what reads it twice works it out once.

    ``by`` parts its files by the values of columns, which then come last. ``clean`` removes the files of its shuffles at once."""
    spark = df.sparkSession
    where = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*by or []).parquet(where)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)

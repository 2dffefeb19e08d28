"""Readers and writers: Parquet, CSV, JSON episodes and lines, partitioned and resumable sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.values import finite, mapped, safe_int
from tidemark.operators.sequence import decimate


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_rows(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; NaN is null. Give a schema for big inputs: inference reads everything once more."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("mode", "PERMISSIVE")
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.select(*[finite(f.name).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema])


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per line; lines that are no JSON go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def with_item_id(df: DataFrame, level: str, index: str, item_id: str = "id") -> DataFrame:
    return df.withColumn(item_id, F.coalesce(F.col(item_id), F.format_string("level%d_%06d", F.col(level).cast("int"), F.col(index).cast("int"))))


def json_episodes(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Episode files, a list of rows or an object of baseline and counterfactual lists, as rows with episode_id, stream, seq."""
    text = spark.read.option("wholetext", True).text(path).withColumn("episode_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
    flat = F.from_json("value", f"array<{row}>")
    both = F.from_json("value", f"struct<baseline array<{row}>, counterfactual array<{row}>>")
    rows = text.where(~F.col("episode_id").endswith("_metadata")).withColumn("__list", F.ltrim("value").startswith("["))
    streams = F.when(F.col("__list"), F.array(F.struct(F.lit("flat").alias("stream"), flat.alias("rows")))).otherwise(
        F.array(F.struct(F.lit("baseline").alias("stream"), both["baseline"].alias("rows")), F.struct(F.lit("counterfactual").alias("stream"), both["counterfactual"].alias("rows")))
    )
    each = rows.select("episode_id", F.explode(streams).alias("s")).select("episode_id", "s.stream", F.posexplode("s.rows").alias("seq", "row"))
    return each.select("episode_id", "stream", "seq", "row.*")


def expand_axes(mapping: Mapping[str, str], axes: int = 6, vibration: int = 3) -> dict[str, str]:
    """{axis} and {i} stand for 0..axes-1, {k} for 0..vibration-1, on both sides of a mapping."""
    out: dict[str, str] = {}
    for target, source in mapping.items():
        for mark, n in (("{axis}", axes), ("{i}", axes), ("{k}", vibration)):
            if mark in target:
                out |= {target.replace(mark, str(i)): source.replace(mark, str(i)) for i in range(n)}
                break
        else:
            out[target] = source
    return out


def canonical(df: DataFrame, mapping: Mapping[str, str], schema: Mapping[str, str], units: Mapping[str, Column] | None = None) -> DataFrame:
    """Projection to a fixed schema: target -> type. Unmapped targets are null; ints are cast by way of double, NaN is null."""
    sources, cols = expand_axes(mapping), []
    for target, kind in schema.items():
        src = sources.get(target)
        if units and target in units:
            c = units[target]
        elif src is None or src not in df.columns:
            c = F.lit(None)
        else:
            c = safe_int(src) if kind in ("int", "integer") else finite(src) if kind == "double" else F.col(src)
        cols.append(c.cast(kind).alias(target))
    return df.select(*cols)


#: Unit conversions of recorder columns.
UNITS = {"mm": lambda c: F.col(c) / 1000, "deg": lambda c: F.radians(c), "percent": lambda c: F.col(c) / 100, "s": lambda c: F.col(c) * 1000}


def with_codes(df: DataFrame, column: str, codes: Mapping[str, object], passthrough: bool) -> DataFrame:
    return df.withColumn(column, mapped(column, codes, passthrough))


def flatten_array(df: DataFrame, column: str, n: int, prefix: str | None = None) -> DataFrame:
    """Array column to n columns prefix__feature_i."""
    prefix = prefix or column
    return df.select(*[c for c in df.columns if c != column], *[F.get(column, F.lit(i)).alias(f"{prefix}__feature_{i}") for i in range(n)])


def cut_episodes(df: DataFrame, key: Sequence[str], order: Sequence[str], size: int, out: str = "part") -> DataFrame:
    """Every size rows make an episode."""
    return df.withColumn(out, F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size))


def write_episodes(df: DataFrame, path: str, key: Sequence[str], seq: str, partitions: Sequence[str] = ("dataset",), files: int = 200) -> None:
    """Parquet, an episode's rows together and in order; folders only by the few values of `partitions`, never by episode."""
    out = df.repartition(files, *key).sortWithinPartitions(*key, seq)
    out.write.mode("overwrite").partitionBy(*[p for p in partitions if p in df.columns]).parquet(path)


def write_json_shards(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.mode("append").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).json(path)


def write_keyed(df: DataFrame, name: str, path: str, key: Sequence[str], order: Sequence[str], buckets: int) -> DataFrame:
    """A table in buckets by key, each one sorted file, so that later work per key needs no shuffle; reads it back.

    Rows are dealt once, here. More buckets than tasks keep a bucket within a task's memory; a key is never split.
    """
    df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key, *order).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def times_to_ms(df: DataFrame) -> DataFrame:
    """Columns named time, or with timestamp in their name, from seconds to whole milliseconds."""
    timed = lambda c: c.lower() == "time" or "timestamp" in c.lower()
    return df.select(*[(F.col(f"`{c}`").cast("double") * 1000).cast("long").alias(c) if timed(c) else F.col(f"`{c}`") for c in df.columns])


def thinned_by_key(df: DataFrame, name: str, path: str, key: Sequence[str], seq: str, q: int, continuous: Sequence[str], buckets: int) -> DataFrame:
    """A recording dealt once by key, then thinned per key (filtered first) without another shuffle, times in milliseconds."""
    return times_to_ms(decimate(write_keyed(df, name, path, key, [seq], buckets), key, seq, q, continuous))


def flat_for_parquet(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def compact(spark: SparkSession, source: str, target: str, bytes_per_file: int = 512 << 20) -> None:
    """Few larger files of the same rows; their number follows the size, so no single task writes everything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    spark.read.parquet(source).repartition(max(1, -(-size // bytes_per_file))).write.mode("overwrite").parquet(target)


def patch(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """Corrected copy: values where the condition holds; nulls in the condition change nothing."""
    hit = F.coalesce(where, F.lit(False))
    return df.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def changed_rows(df: DataFrame, where: Column, values: Mapping[str, Column]) -> DataFrame:
    """What patch() would change, as a dry run: the rows it hits with `before` and `after` of the columns it sets, if any of them differs."""
    hit = df.where(F.coalesce(where, F.lit(False)))
    before, after = F.struct(*[F.col(c).alias(c) for c in values]), F.struct(*[v.cast(df.schema[c].dataType).alias(c) for c, v in values.items()])
    return hit.withColumn("before", before).withColumn("after", after).where(~F.col("before").eqNullSafe(F.col("after")))


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Number of rows and a checksum that doesn't depend on their order."""
    r = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*[f"`{c}`" for c in df.columns]))).cast("decimal(20,0)")), F.lit(0))).first()
    return r[0], int(r[1])


def publish(df: DataFrame, path: str, rows: int | None = None) -> str:
    """Puts df in the place of the Parquet table at path, which df may read: staging, proof, backup once, rename. Returns the backup's path.

    The staged files are read back and must have df's rows (and `rows` of them, if given) and checksum, else nothing is
    replaced. The first publication keeps what was there as path.backup; later ones leave that backup alone. If the last
    rename fails, the old table is put back.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    token = uuid.uuid4().hex
    staged, backup, old = f"{path}.staging-{token}", f"{path}.backup", f"{path}.old-{token}"
    wanted = fingerprint(df)
    try:
        df.write.mode("errorifexists").parquet(staged)
        found = fingerprint(spark.read.schema(df.schema).parquet(staged))
        if found != wanted or (rows is not None and found[0] != rows):
            raise ValueError(f"staged {found}, wanted {wanted}, rows {rows}")
        first = not fs.exists(at(backup))
        aside = backup if first else old
        if fs.exists(at(path)) and not fs.rename(at(path), at(aside)):
            raise OSError(f"can't move {path} aside")
        if not fs.rename(at(staged), at(path)):
            fs.rename(at(aside), at(path))
            raise OSError(f"can't publish {path}")
        fs.delete(at(old), True)
    finally:
        fs.delete(at(staged), True)
    return backup


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Columns that are null in every row go: one aggregation over all columns, its single row of counts is read."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def first_existing(spark: SparkSession, root: str, names: Sequence[str]) -> list[str]:
    """The paths under root that exist among names of equal rank; asked through Spark's file systems, so any store will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    paths = [f"{root}/{n}" for n in names]
    return [p for p in paths if hadoop.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop.Path(p))]


def preferred_inputs(spark: SparkSession, root: str, ranks: Sequence[Sequence[str]]) -> list[str]:
    """All existing paths of the first rank that has any, such as signals already thinned before raw ones."""
    for names in ranks:
        found = first_existing(spark, root, names)
        if found:
            return found
    raise FileNotFoundError(f"none of the inputs under {root}")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Question or reply trees, one JSON object per file: level (from the path), stem, and the object's columns; files that are no JSON go."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = text.select(F.regexp_extract(F.col("_metadata.file_path"), r"/level(\d+)/", 1).try_cast("int").alias("level"), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stem"), F.from_json("value", schema).alias("x"), "value")
    return rows.where("x IS NOT NULL AND try_parse_json(value) IS NOT NULL").select("level", "stem", "x.*")


def split_pairs(episodes: DataFrame, stem: str, folder: str) -> DataFrame:
    """(stem, alt, normal): folders of an episode's counterfactual (names that begin with alt) and its counterpart, where both exist."""
    alt = F.lower(F.col(folder)).startswith("alt")
    sides = episodes.groupBy(stem).agg(F.min(F.when(alt, F.col(folder))).alias("alt"), F.min(F.when(~alt, F.col(folder))).alias("normal"))
    return sides.where("alt IS NOT NULL AND normal IS NOT NULL")


def append_verdicts(df: DataFrame, path: str) -> None:
    """Verdicts as JSON lines beside those already there; readers take the last of each item."""
    df.write.mode("append").json(path)


def write_traces(df: DataFrame, path: str) -> None:
    """Scored traces as Parquet, nested columns as JSON text, by day where there is one."""
    out = flat_for_parquet(df)
    writer = out.write.mode("append")
    (writer.partitionBy("day") if "day" in out.columns else writer).parquet(path)


def with_time(df: DataFrame, key: Sequence[str], order: Sequence[str], step: int = 100, out: str = "timestamp_ms") -> DataFrame:
    """A made-up clock for recordings without one: 0, step, 2 * step ... per episode."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) * step)


def unpadded(name: str | Column) -> Column:
    """experiment_007 -> experiment_7."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(c, r"(experiment_)0+(?=\d)", "$1")

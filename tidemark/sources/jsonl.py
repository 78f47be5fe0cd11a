"""Draw lines: reading, validation with reasons, serialising, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashing, rules

RAW = T.StructType([T.StructField("date", T.StringType()), T.StructField("id", T.StringType()), T.StructField("result", T.ArrayType(T.StringType())), T.StructField("process_time", T.StringType())])


def canonical_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of non-blank lines; Spark splits at CR LF and LF.

    ``line`` numbers the lines of one file from 0.  A large file is read in splits by several tasks: lines are
    counted a split, running sums of these counts say where each split begins, and inside a split, whose lines
    are read one after the other, numbers just go on.  No line is moved for its number.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.trim("value").alias("value"))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    starts = splits.select("file", "block", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.where("value <> ''").join(starts, ["file", "block"]).select("file", (F.col("n") + F.col("shift")).alias("line"), "value")


def validated(lines: DataFrame) -> DataFrame:
    """``line, date, id, result, process_time, reason``; ``reason`` is null for valid rows.

    Problems are looked for in order: JSON, object, id, date, result.  Result values are kept as
    JSON text, so that a number in quotes is told from a number.
    """
    v = F.try_parse_json(F.col("value"))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    parsed = lines.withColumn("v", v)
    items = F.when(F.schema_of_variant("v").contains("result: ARRAY"), F.from_json(F.get_json_object("value", "$.result"), "array<string>", {"mode": "PERMISSIVE"}))
    quoted = F.coalesce(F.get_json_object("value", "$.result"), F.lit("")).contains('"')
    id_text = F.when(F.schema_of_variant("v").rlike("id: STRING"), F.trim(get("$.id", "string")))
    date = F.when(F.schema_of_variant("v").rlike("date: STRING"), get("$.date", "string"))
    fields = parsed.select("line", F.col("v").isNull().alias("broken"), F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("is_object"), date.alias("date"), id_text.alias("id"), items.alias("items"), quoted.alias("quoted"), F.nullif(F.trim(get("$.process_time", "string")), F.lit("")).alias("process_time"))
    reason = (
        F.when(F.col("broken"), "line is not JSON")
        .when(~F.col("is_object"), "line is not an object")
        .when(F.coalesce("id", F.lit("")) == "", "id is missing or blank")
        .when(~F.coalesce(F.col("date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)), "date has the wrong form")
        .when(F.col("date").try_cast("date").isNull(), "date is not on the calendar")
        .when(F.coalesce(F.col("quoted"), F.lit(False)) & F.col("items").isNotNull() & (F.size("items") == rules.PICKS), "result has a value that is no integer")
        .otherwise(rules.result_problem(F.col("items")))
    )
    numbers = F.array_sort(F.transform("items", lambda x: x.try_cast("double").try_cast("int")))
    done = fields.withColumn("reason", reason)
    return done.select("line", F.when(F.col("reason").isNull(), F.col("date").try_cast("date")).alias("date"), "id", F.when(F.col("reason").isNull(), numbers).alias("result"), "process_time", "reason")


def parse_draws(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows in canonical order, and rejects with their reasons."""
    rows = validated(read_lines(spark, path))
    return rows.where("reason is null").drop("reason").orderBy("date", "id"), rows.where("reason is not null").select("line", "id", "reason")


def serialised(table: DataFrame) -> DataFrame:
    """``date, id, line``: each row's JSON line; order by date and id to write."""
    time = F.col("process_time") if "process_time" in table.columns else None
    return table.select("date", "id", hashing.draw_json(F.col("date").cast("string"), F.col("id"), F.col("result"), time).alias("line"))


def manifest(table: DataFrame, report: DataFrame, digest: str) -> dict:
    """A snapshot's description; counts come from one aggregate."""
    row = table.agg(F.count(F.lit(1)).alias("records"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"), F.min_by("id", F.struct("date", "id")).alias("first_id"), F.max_by("id", F.struct("date", "id")).alias("last_id")).first()
    gaps = report.first()
    return {"schemaVersion": 2, "recordCount": row["records"], "firstDate": row["first"], "lastDate": row["last"], "firstId": row["first_id"], "lastId": row["last_id"], "sha256": digest, "continuous": bool(gaps["continuous"]), "missing": int(gaps["n_missing"])}


def is_manifest(value) -> bool:
    return isinstance(value, dict) and value.get("schemaVersion") == 2 and isinstance(value.get("recordCount"), int) and isinstance(value.get("sha256"), str)


def save_snapshot(table: DataFrame, described: dict, folder: str) -> None:
    """Data first, to a new folder; the manifest, which names it, last.  A failure in between leaves the old snapshot valid."""
    spark = table.sparkSession
    name = f"data-{described['sha256'][:16]}"
    lines = serialised(table).orderBy("date", "id").select("line")
    lines.write.mode("overwrite").text(f"{folder}/{name}")
    save_json(spark, {**described, "data": name}, f"{folder}/manifest.json")


def save_json(spark: SparkSession, value: dict, path: str, overwrite: bool = True) -> None:
    """Through a side file and a rename, by Hadoop's file system, so any store that Spark reads will do."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    side = jvm.org.apache.hadoop.fs.Path(path + ".next")
    out = fs.create(side, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
    out.close()
    # a rename that replaces its target: no moment without a file
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(side, target, options)


def load_json(spark: SparkSession, path: str) -> dict | None:
    """Null for a missing or broken file."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
        return json.loads(text)
    except Exception as e:  # noqa: BLE001  a missing path comes as an analysis error
        if isinstance(e, json.JSONDecodeError) or "PATH_NOT_FOUND" in str(e):
            return None
        raise


def load_snapshot(spark: SparkSession, folder: str) -> tuple[DataFrame | None, dict | None]:
    """Any rejected row is an error; a missing or broken manifest is not."""
    described = load_json(spark, f"{folder}/manifest.json")
    if not is_manifest(described):
        return None, None
    valid, rejects = parse_draws(spark, f"{folder}/{described['data']}")
    bad = rejects.limit(1).collect()
    if bad:
        raise ValueError(f"snapshot has an invalid row: {bad[0]['reason']}")
    return valid, described


def best_snapshot(candidates: DataFrame) -> DataFrame:
    """The later last date, then more rows, then ``cache`` before others: one row of ``source, last_date, records``."""
    return candidates.orderBy(F.desc_nulls_last("last_date"), F.desc("records"), (F.col("source") != "cache")).limit(1)


def fail_fast(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Raises at the first row with a reason, where it is met."""
    return rows.withColumn(reason, F.when(F.col(reason).isNotNull(), F.raise_error(F.col(reason)).cast("string")))


def latest_report(spark: SparkSession, folder: str, suffix: str) -> str | None:
    """The last file name with the suffix, without reading contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.agg(F.max("path").alias("p")).first()["p"]

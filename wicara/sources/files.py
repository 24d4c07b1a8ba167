"""File inputs and outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wicara.schemas import ANNOTATORS, COMMENTS, LEXICON_ENTRY, NUMBER_ENTRY


def read_table(spark: SparkSession, folder: str, name: str, partitions: int | None = None) -> DataFrame:
    """A Parquet table; ``partitions`` deals a small one to so many tasks, for heavy work per row."""
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    return table.repartition(partitions) if partitions else table


def read_csv(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """CSV with a header row, quoted line breaks and doubled quotes, in a declared schema.

    Quoted line breaks keep a file in one task; write large inputs as Parquet once and read that.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def read_annotators(spark: SparkSession, path: str) -> DataFrame:
    """Annotator demographics with surrounding blanks removed."""
    raw = read_csv(spark, path, ANNOTATORS)
    return raw.select(
        *[F.trim(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in raw.dtypes]
    )


def is_json_object(line: Column | str) -> Column:
    """True where the line is exactly one JSON object."""
    value = F.col(line) if isinstance(line, str) else line
    strict = {"allowSingleQuotes": "false"}
    # Content after the object breaks one of the two frames, whichever bracket it closes first.
    listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<map<string,string>>", strict)
    framed = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "map<string,string>", strict)
    whole = (F.size(listed) == 1) & listed.getItem(0).isNotNull() & framed.isNotNull() & (F.size(framed) == 1)
    return F.coalesce(whole & value.rlike(r"\A[ \t\r\n]*\{"), F.lit(False))


def json_validity(lines: DataFrame, column: str = "value") -> DataFrame:
    """Numbers of valid and invalid JSON-object lines, in one aggregation."""
    ok = is_json_object(column)
    return lines.agg(F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = COMMENTS) -> DataFrame:
    """Objects of a JSON-lines file in a declared schema; other lines are left out.

    ``json_validity(spark.read.text(path))`` counts what was left out.
    """
    lines = spark.read.text(path).filter(is_json_object("value"))
    return lines.select(F.from_json("value", schema, {"allowSingleQuotes": "false"}).alias("r")).select(
        "r.*"
    )


def _entries(spark: SparkSession, path: str, entry: T.StructType) -> DataFrame:
    schema = T.StructType([T.StructField("entries", T.ArrayType(entry))])
    document = spark.read.schema(schema).option("multiLine", True).json(path)
    return document.select(F.posexplode("entries").alias("position", "e")).select(
        F.col("position").cast("long").alias("position"), "e.*"
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``{"entries": [{expression, region}]}`` as rows with their position."""
    return _entries(spark, path, LEXICON_ENTRY)


def read_number_reference(spark: SparkSession, path: str) -> DataFrame:
    """``{"entries": [{number, meaning, ...}]}`` as rows; a missing file has no entries."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        empty = T.StructType([T.StructField("position", T.LongType()), *NUMBER_ENTRY.fields])
        return spark.createDataFrame([], empty)
    return _entries(spark, path, NUMBER_ENTRY)


def read_word_list(spark: SparkSession, path: str) -> list[str]:
    """One word per line, for example a stop-word list."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).filter("w <> ''").distinct()
    return sorted(row["w"] for row in rows.collect())


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str, row_id: str | None = None) -> None:
    """CSV folder with headers; ``row_id`` comes first when it is part of the export.

    Arrays are written as JSON text, which the list reader accepts.
    """
    names = ([row_id] if row_id else []) + [c for c in df.columns if c != row_id]
    kinds = dict(df.dtypes)
    columns = [
        F.to_json(F.col(f"`{c}`")).alias(c) if kinds[c].startswith("array") else F.col(f"`{c}`")
        for c in names
    ]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)

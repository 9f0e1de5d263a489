"""Text formats, import, export and bundles (SC14 to SC19, SK9, SK10, SK12, SK15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein import schema
from skein.functions.ids import valid_id

TIMES = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy"]


def any_time(text: Column) -> Column:
    """A time in any of the usual layouts, or epoch seconds; null if in none."""
    number = F.when(text.rlike(r"^\d{9,11}$"), F.timestamp_seconds(F.try_to_number(text, F.lit("99999999999")).cast("long")))
    return F.coalesce(number, *[F.try_to_timestamp(text, F.lit(t)) for t in TIMES])


def read_train(spark: SparkSession, path: str) -> DataFrame:
    """``user_id, item_id`` of tab-separated lines of user and item (SC14); what follows in a line isn't read."""
    parts = F.split("value", r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("user_id"), parts[1].alias("item_id"))


def read_test(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Positives ``user_id, item_id`` and negatives of lines ``(user,item)<tab>negative<tab>negative...`` (SC14)."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split("value", r"\t").alias("f"))
    head = F.split(F.regexp_replace(F.col("f")[0], r"[()\s]", ""), ",")
    rows = lines.select(head[0].alias("user_id"), head[1].alias("item_id"), F.slice("f", F.lit(2), F.size("f")).alias("negatives"))
    return rows.select("user_id", "item_id"), rows.select("user_id", F.explode("negatives").alias("item_id")).where(F.trim("item_id") != "")


def read_indexed(spark: SparkSession, path: str) -> DataFrame:
    """``target, indices, values`` of lines ``target index:value ...`` with indices from 0 (SC15)."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    pairs = F.slice(parts, F.lit(2), F.size(parts))
    piece = lambda i, t: F.transform(pairs, lambda x: F.split(x, ":")[i].cast(t))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("double").alias("target"), piece(0, "int").alias("indices"), piece(1, "double").alias("values"))


def read_csv(spark: SparkSession, path: str, schema: StructType | str, header: bool = True) -> DataFrame:
    """CSV by a given schema (SC19)."""
    return spark.read.schema(schema).csv(path, header=header)


DATASETS = {  # names and layouts of public sets; their files must be at hand (SC16)
    "pinterest-20": "pairs", "ml-100k": "pairs", "ml-1m": "pairs", "ml-tag": "indexed", "frappe": "indexed", "criteo": "indexed",
}


def read_dataset(spark: SparkSession, name: str, folder: str):
    """A public set from ``folder/name``: (train, positives, negatives) of pairs, or (train, test) of indexed rows."""
    kind = DATASETS[name]
    if kind == "pairs":
        return (read_train(spark, f"{folder}/{name}/train.txt"), *read_test(spark, f"{folder}/{name}/test.txt"))
    return read_indexed(spark, f"{folder}/{name}/train.libfm"), read_indexed(spark, f"{folder}/{name}/test.libfm")


_LINES = {
    "users": "UserId string, Labels string, Comment string",
    "items": "ItemId string, IsHidden boolean, Categories array<string>, Timestamp string, Labels string, Comment string",
    "feedback": "FeedbackType string, UserId string, ItemId string, Value double, Timestamp string, Updated string, Comment string",
}
_NAMES = {
    "UserId": "user_id", "ItemId": "item_id", "Labels": "labels", "Comment": "comment", "IsHidden": "is_hidden", "Categories": "categories", "Timestamp": "timestamp",
    "FeedbackType": "feedback_type", "Value": "value", "Updated": "updated",
}


def import_lines(spark: SparkSession, kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows of a JSON-lines file of users, items or feedback, and the rejected lines (SC17).

    A line is rejected if it isn't JSON, an id is blank or has a slash, or a time is given in no known layout. Labels stay JSON text.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", _LINES[kind], {"mode": "PERMISSIVE"}))
    ids = {"users": ["UserId"], "items": ["ItemId"], "feedback": ["UserId", "ItemId"]}[kind]
    times = [n for n in ("Timestamp", "Updated") if f"{n} " in _LINES[kind]]
    for t in times:
        parsed = parsed.withColumn(t, any_time(F.col(f"j.{t}")))
    good = F.col("j").isNotNull()
    for i in ids:
        good = good & valid_id(F.col(f"j.{i}"))
    for t in times:
        good = good & (F.col(f"j.{t}").isNull() | F.col(t).isNotNull())
    columns = [n.split()[0] for n in _LINES[kind].split(", ")]
    rows = parsed.where(good).select(*[(F.col(c) if c in times else F.col(f"j.{c}")).alias(_NAMES[c]) for c in columns])
    return rows, parsed.where(~good).select("value")


def export_lines(df: DataFrame, path: str, as_of: str | None = None) -> None:
    """Rows as JSON lines; of feedback only what is dated up to ``as_of`` (SK9)."""
    if as_of is not None:
        df = df.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz"))
    times = [f.name for f in df.schema.fields if f.dataType.typeName().startswith("timestamp")]
    df = df.withColumns({c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") for c in times}) if times else df
    back = {v: k for k, v in _NAMES.items()}
    df.withColumnsRenamed({c: back[c] for c in df.columns if c in back}).write.json(path)


def dump(path: str, **tables: DataFrame) -> None:
    """Tables as a Parquet bundle (SK10)."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of a bundle (SC18)."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite as few larger files (SK8)."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def write_train(pairs: DataFrame, path: str) -> None:
    """``user_id, item_id`` as the lines that ``read_train`` reads."""
    pairs.select(F.concat_ws("\t", "user_id", "item_id").alias("value")).write.text(path)


def write_test(rows: DataFrame, path: str) -> None:
    """``user_id, item_id, negatives`` as the lines that ``read_test`` reads."""
    rows.select(F.concat_ws("\t", F.concat(F.lit("("), "user_id", F.lit(","), "item_id", F.lit(")")), "negatives").alias("value")).write.text(path)


def write_indexed(rows: DataFrame, path: str) -> None:
    """``target, indices, values`` as the lines that ``read_indexed`` reads."""
    pairs = F.zip_with("indices", "values", lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("string")))
    rows.select(F.concat_ws(" ", F.col("target").cast("string"), pairs).alias("value")).write.text(path)


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a SQL store (SK12)."""
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def upsert_jdbc(batch: DataFrame, url: str, name: str, keys: list[str], order: list[Column], **options: str) -> None:
    """The batch's rows, first of a key wins, in place of the table's rows with their keys (SK12).

    Spark has no upsert by JDBC: the new table is made beside the old one, which is then emptied and filled.
    """
    from skein.lineage import Scratch
    from skein.operators.ingest import upsert

    old = read_jdbc(batch.sparkSession, url, name, **options)
    made = Scratch(batch.sparkSession, "jdbc").cut(upsert(old, batch, keys, order))
    write_jdbc(made, url, name, "overwrite", truncate="true", **options)


def read_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a SQL store; its driver must be on the class path (SK12). Give partitionColumn, bounds and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


SCHEMAS = {"users": schema.USERS, "items": schema.ITEMS, "feedback": schema.FEEDBACK, "scores": schema.SCORES}

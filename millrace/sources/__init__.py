"""Tables by name and tenant, and readers for other inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column by which a table is split among tenants.
TENANT = {"customer": "c_nationkey", "supplier": "s_nationkey", "documents": "source", "events": "user_id"}


def table(spark: SparkSession, sf_dir: str, name: str, tenant=None) -> DataFrame:
    """A Parquet table; with ``tenant``, only its rows (the predicate reaches the scan). Tables without tenants refuse one."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if tenant is None:
        return df
    if name not in TENANT:
        raise ValueError(f"{name} has no tenants")
    return df.filter(F.col(TENANT[name]) == F.lit(tenant))


def scoped(spark: SparkSession, sf_dir: str, name: str, tenant, columns: dict[str, str] = TENANT) -> DataFrame:
    """A tenant's rows of a table; columns names the column that holds the tenant, by table. There is no reading without a tenant."""
    if tenant is None or name not in columns:
        raise ValueError(f"{name} is read for a tenant only, by one of its columns")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").filter(F.col(columns[name]) == F.lit(tenant))


def settings(spark: SparkSession, prefix: str, defaults: dict[str, str]) -> dict[str, str]:
    """The session's settings below a prefix, with defaults for those that aren't set; others are ignored."""
    return {k: spark.conf.get(f"{prefix}.{k}", v) for k, v in defaults.items()}


def facts(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Facts entered by hand: question, answer, kind."""
    return spark.createDataFrame(rows, "question string, answer string, kind string")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, ts as a timestamp."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it a single file or a folder of part files; new part files are found as they come."""
    at = f"{sf_dir}/{name}.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    single = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(spark.read.parquet(at).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(at)


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """filename, length of the files below path that match, ordered by name."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "length").orderBy("filename")


def records(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """JSON texts as columns; ``valid`` is false where the text is no record or lacks a field."""
    parsed = df.withColumn("_r", F.from_json(column, ddl, {"mode": "PERMISSIVE"}))
    names = [f.strip().split(" ")[0] for f in ddl.split(",")]
    whole = F.col("_r").isNotNull()
    for n in names:
        whole = whole & F.col(f"_r.{n}").isNotNull()
    return parsed.withColumn("valid", whole).select(*df.columns, "_r.*", "valid")


def extracts(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """Text, CSV, JSON, ORC or Parquet input. PDF and DOCX need their text extracted beforehand."""
    if kind not in ("text", "csv", "json", "orc", "parquet"):
        raise ValueError(f"{kind} isn't read; give extracted text")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)

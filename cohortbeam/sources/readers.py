"""Sources. Schemas are explicit (no inference); file contents are read only
when a plan needs them (``binaryFile`` prunes ``content`` otherwise)."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import LABELS, META_COLS
from ..functions.text import basename

CATALOG_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("patient_id", T.LongType()),
    T.StructField("age_raw", T.StringType()), T.StructField("gender", T.StringType()),
    T.StructField("view_position", T.StringType()),
])

SCORING_INPUT_SCHEMA = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("age_norm", T.DoubleType()),
    T.StructField("sex_bin", T.DoubleType()), T.StructField("view_AP", T.DoubleType()),
    T.StructField("view_PA", T.DoubleType()),
])

MODEL_SCHEMA = T.StructType([
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("meta_cols", T.ArrayType(T.StringType())),
])

METADATA_SCHEMA = T.StructType([
    T.StructField("patient_name", T.StringType()), T.StructField("age", T.LongType()),
    T.StructField("gender", T.StringType()), T.StructField("view", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("folder_name", T.StringType()),
    T.StructField("source", T.StringType()),
])

PREDICTIONS_SCHEMA = T.MapType(T.StringType(), T.FloatType())


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def _is_missing(e: AnalysisException) -> bool:
    cond = getattr(e, "getCondition", None) or getattr(e, "getErrorClass", None)
    name = cond() if cond else None
    return name == "PATH_NOT_FOUND" or "PATH_NOT_FOUND" in str(e)


def scoring_input(spark: SparkSession, input_path: str, pattern: str = "*.png") -> DataFrame:
    """Scoring input cascade: ``data.parquet``, else ``data.csv`` (typed), else
    an image listing with default features. Falls through only when the path
    does not exist; any other error is raised."""
    base = input_path.rstrip("/")
    try:
        return spark.read.parquet(f"{base}/data.parquet").select(*[f.name for f in SCORING_INPUT_SCHEMA.fields])
    except AnalysisException as e:
        if not _is_missing(e):
            raise
    try:
        df = read_csv(spark, f"{base}/data.csv", SCORING_INPUT_SCHEMA)
        df.schema  # resolves the path now
        return df
    except AnalysisException as e:
        if not _is_missing(e):
            raise
    from ..constants import DEFAULT_FEATURES
    files = path_index(spark, base, pattern).select(F.col("path").alias("image_path"))
    return files.select("image_path", *[F.lit(float(v)).alias(k) for k, v in DEFAULT_FEATURES.items()])


def image_files(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """All matching files below ``root`` (path, modificationTime, length, content)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(root))


def path_index(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """(basename, path) of all images below ``root``; contents are never read."""
    files = image_files(spark, root, pattern).select("path")
    return files.select(basename("path").alias("basename"), "path")


def image_bytes(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    return image_files(spark, root, pattern).select(basename("path").alias("basename"), "path", "length", "content")


def model_schema(spark: SparkSession, path: str | None) -> DataFrame:
    """Model schema document {labels, meta_cols}; the built-in default when
    the file does not exist."""
    if path:
        try:
            df = spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path)
            df.schema
            return df
        except AnalysisException as e:
            if not _is_missing(e):
                raise
    return spark.createDataFrame([(LABELS, META_COLS)], MODEL_SCHEMA)


def registry_docs(spark: SparkSession, root: str, name: str, schema: T.DataType,
                  multi_line: bool = False) -> DataFrame:
    """One JSON document per registry folder (``<root>/<folder>/<name>``),
    with the folder taken from the file path. Unreadable documents give NULL."""
    if isinstance(schema, T.MapType):
        raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)
                    .option("wholetext", multi_line).text(root)
                    .select(F.col("_metadata.file_path").alias("_path"), "value"))
        doc = raw.select("_path", F.from_json("value", schema).alias("doc"))
    else:
        doc = (spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", "true")
                    .option("pathGlobFilter", name).json(root)
                    .select(F.col("_metadata.file_path").alias("_path"), F.struct("*").alias("doc")))
    folder = F.regexp_extract(F.col("_path"), r"([^/]+)/[^/]+$", 1)
    folder = F.regexp_replace(folder, r"^[^=]+=", "")  # partitionBy layout: key=value
    return doc.select(folder.alias("folder_name"), "doc")


def uploads_from_json(df: DataFrame, json_col: str = "patient_json", content_col: str = "content",
                      schema: str = "name string, age string, gender string, view string") -> DataFrame:
    """Upload batch rows: patient JSON parsed, rows missing JSON or bytes dropped."""
    ok = df.where(F.col(json_col).isNotNull() & F.col(content_col).isNotNull())
    return ok.withColumn("patient", F.from_json(json_col, schema))


def image_table(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Decoded images (Spark's ``image`` source: BGR order, mode -1 rows for
    undecodable files)."""
    return (spark.read.format("image").option("pathGlobFilter", pattern)
                 .option("recursiveFileLookup", "true").load(root))

"""Sources and sinks: raw files, synthetic bit rows, trained filters and performance records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bitspark.operators.model import Model

PERF = T.StructType([
    T.StructField("machine_type", T.StringType()), T.StructField("cpu_arch", T.StringType()), T.StructField("n_cores", T.IntegerType()), T.StructField("n_physical", T.IntegerType()),
    T.StructField("price", T.DoubleType()), T.StructField("spot_price", T.DoubleType()),
    T.StructField("tests", T.ArrayType(T.StructType([
        T.StructField("algorithm", T.StringType()), T.StructField("chunk_size", T.LongType()), T.StructField("n_examples", T.LongType()),
        *[T.StructField(f"{n}_nanos", T.LongType()) for n in ("unit", "exp", "apply", "total")], *[T.StructField(f"{n}_hash", T.DecimalType(20, 0)) for n in ("unit", "exp")],
    ]))),
])


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content``: whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def synthetic_rows(spark: SparkSession, n: int, inputs: int = 8, outputs: int = 4, seed: int = 0, start: int = 0) -> DataFrame:
    """``row_id, x array<bigint>, y array<bigint>``: pseudorandom bit rows of ``inputs`` and ``outputs`` words, the same on every run."""
    word = lambda k: F.xxhash64(F.col("id"), F.lit(seed), F.lit(k))
    return spark.range(start, start + n).select(
        F.col("id").alias("row_id"), F.array(*[word(k) for k in range(inputs)]).alias("x"), F.array(*[word(inputs + k) for k in range(outputs)]).alias("y")
    )


def read_perf(spark: SparkSession, path: str) -> DataFrame:
    """Performance records from JSON.  Hashes are unsigned 64-bit numbers and so decimals."""
    return spark.read.schema(PERF).json(path)


def write_perf(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    weights, thresholds = model.to_tables(spark)
    weights.write.mode("overwrite").parquet(f"{path}/weights")
    thresholds.write.mode("overwrite").parquet(f"{path}/thresholds")


def load_model(spark: SparkSession, path: str, inputs: int = 512, outputs: int = 256) -> Model:
    return Model.from_tables(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/thresholds"), inputs, outputs)

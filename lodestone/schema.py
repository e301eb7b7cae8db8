"""The one document schema, and helpers to get DataFrames into it."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
    ]
)
#: Stored collections also carry the insertion order.
STORED = T.StructType([*DOCUMENT.fields, T.StructField("pos", T.LongType(), False)])


@dataclass
class Document:
    """One row, on the driver."""

    id: str
    text: str = ""
    embedding: list[float] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)

    @property
    def dimension(self) -> int:
        return len(self.embedding)

    @property
    def is_embedded(self) -> bool:
        return bool(self.embedding)


def frame(spark: SparkSession, docs: Iterable[Document]) -> DataFrame:
    return spark.createDataFrame([(d.id, d.text, [float(x) for x in d.embedding], dict(d.metadata)) for d in docs], DOCUMENT)


def completed(df: DataFrame) -> DataFrame:
    """Missing embeddings and metadata become empty ones; null ids and texts become empty strings."""
    has = set(df.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    return df.select(
        F.coalesce(col("id", "string"), F.lit("")).alias("id"),
        F.coalesce(col("text", "string"), F.lit("")).alias("text"),
        F.coalesce(col("embedding", "array<float>"), F.array().cast("array<float>")).alias("embedding"),
        F.coalesce(col("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
    )

"""Small constant tables as plan literals: no Python rows, known size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_rows(spark: SparkSession, rows: Sequence[Sequence[object]], ddl: str) -> DataFrame:
    columns = T.StructType.fromDDL(ddl).fields
    structs = [
        F.struct(*[F.lit(value).cast(c.dataType).alias(c.name) for value, c in zip(row, columns)])
        for row in rows or [[None] * len(columns)]
    ]
    table = spark.range(1).select(F.inline(F.array(*structs)))
    return table if rows else table.filter(F.lit(False))

"""Result types of Arrow functions, for columns of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def with_id(df: DataFrame, id_col: str, rest: str) -> StructType:
    """``df``'s ``id_col`` as it is, followed by the columns that ``rest`` declares."""
    return StructType([StructField(id_col, df.schema[id_col].dataType), *StructType.fromDDL(rest).fields])

"""Published row types and the check that a table conforms to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

CHAT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("messages", MESSAGES),
        T.StructField("source", T.StringType()),
    ]
)

MCQA = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
        T.StructField("context", T.StringType()),
    ]
)

PROMPT = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("correct_idx", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
    ]
)

PREFERENCES_RAW = T.StructType(
    [
        T.StructField("course_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("question_body", T.StringType()),
        T.StructField("question_answer", T.StringType()),
        T.StructField("question_type", T.StringType()),
    ]
)

PREFERENCES = T.StructType(
    [
        T.StructField("course_id", T.IntegerType()),
        T.StructField("question_id", T.IntegerType()),
        T.StructField("question_body", T.StringType()),
        T.StructField("question_answer", T.StringType()),
        T.StructField("question_type", T.StringType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder and cast ``df`` to ``schema``; a missing column or a lossy type raises.

    Structs nested in arrays are checked by name here, because Spark would fill a missing
    nested field with null without saying so.
    """
    _require_fields(df.schema, schema, "")
    return df.select(*[f.name for f in schema.fields]).to(schema)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are not among {df.columns}")


def _require_fields(have: T.DataType, want: T.DataType, path: str) -> None:
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        _require_fields(have.elementType, want.elementType, path + "[]")
    elif isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names = set(have.fieldNames())
        for field in want.fields:
            if field.name not in names:
                raise ValueError(f"field {path}.{field.name} is missing")
            _require_fields(have[field.name].dataType, field.dataType, f"{path}.{field.name}")

"""Column-level helpers: missing values, canonical grouping values, rendering.

The helpers return SQL text over a column reference: a table profile has dozens of expressions
per column, and one parsed text is far cheaper to hand to Spark than a tree of Column calls.
Operators over all columns first rename their input to ``c0 .. ck`` (:func:`positional`), so
names with dots, backticks or duplicates never reach an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXTUAL = (T.StringType, T.CharType, T.VarcharType)
NESTED = (T.ArrayType, T.MapType, T.StructType)

# Text longer than this is grouped by its SHA-256 digest, so that a shuffle never carries
# whole documents. Digests are 65 characters, longer than any value kept as it is, so the
# two can not be mistaken for one another.
DIGEST_OVER = 64

# Number within 1e-9 of a whole one.
INTEGER_TOLERANCE = 1e-9

# Escapes that Spark SQL knows; it has none for form feed and reads \f as the letter.
WHITESPACE = " \\t\\r\\n\\u000b\\u000c"
NUMBER_SHAPE = r"^[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
WHOLE_SHAPE = r"^[+-]?[0-9]+$"


def positional(df: DataFrame) -> DataFrame:
    """Rename the columns to ``c0 .. ck``."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def reference(name: str) -> str:
    """SQL reference that survives dots and backticks in the name."""
    return "`" + name.replace("`", "``") + "`"


def quoted(name: str) -> Column:
    return F.col(reference(name))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_numeric_like(data_type: T.DataType) -> bool:
    """Numeric as the modelling rules see it: booleans count."""
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def present(ref: str, data_type: T.DataType) -> str:
    """The value, with NaN turned into NULL."""
    return f"nanvl({ref}, CAST(NULL AS DOUBLE))" if isinstance(data_type, FRACTIONAL) else ref


def is_missing(ref: str, data_type: T.DataType) -> str:
    return f"({ref} IS NULL OR isnan({ref}))" if isinstance(data_type, FRACTIONAL) else f"({ref} IS NULL)"


def as_double(ref: str, data_type: T.DataType) -> str:
    """Numeric or boolean value as double, NaN as NULL."""
    if isinstance(data_type, T.BooleanType):
        return f"CAST(CAST({ref} AS INT) AS DOUBLE)"
    return f"CAST({present(ref, data_type)} AS DOUBLE)"


def stripped(ref: str) -> str:
    """Text without leading and trailing white space (``trim`` alone takes spaces only)."""
    return f"btrim({ref}, '{WHITESPACE}')"


def coerced_number(ref: str) -> str:
    """Text to double; NULL where the text is not a number.

    Spark's own cast also takes Java suffixes ('5d', '5f'), hence the shape test.
    """
    return f"CASE WHEN {stripped(ref)} RLIKE r'{NUMBER_SHAPE}' THEN try_cast({stripped(ref)} AS DOUBLE) END"


def integer_share(ref: str) -> str:
    """Aggregate: share of whole numbers among the values that are numbers, NULL without any."""
    return f"avg(CAST(abs({ref} - rint({ref})) < {INTEGER_TOLERANCE!r}D AS DOUBLE))"


def grouping_family(data_type: T.DataType) -> str:
    """Spark type in which the values of a column are grouped."""
    if isinstance(data_type, (*INTEGRAL, T.BooleanType, T.DateType)):
        return "bigint"
    if isinstance(data_type, FRACTIONAL):
        return "double"
    if isinstance(data_type, T.TimestampType):
        return "timestamp"
    if isinstance(data_type, T.TimestampNTZType):
        return "timestamp_ntz"
    return "string"


def grouping_value(ref: str, data_type: T.DataType) -> str:
    """Value in its grouping family: equal cells give equal values, missing gives NULL."""
    family = grouping_family(data_type)
    if isinstance(data_type, T.BooleanType):
        return f"CAST(CAST({ref} AS INT) AS BIGINT)"
    if isinstance(data_type, T.DateType):
        return f"CAST(unix_date({ref}) AS BIGINT)"
    if family != "string":
        return f"CAST({present(ref, data_type)} AS {family})"
    text = rendered(ref, data_type)
    return f"CASE WHEN length({text}) > {DIGEST_OVER} THEN concat('#', sha2({text}, 256)) ELSE {text} END"


def rendered(ref: str, data_type: T.DataType) -> str:
    """Value as text."""
    if isinstance(data_type, T.MapType):
        return f"to_json(array_sort(map_entries({ref})))"
    if isinstance(data_type, NESTED):
        return f"to_json({ref})"
    if isinstance(data_type, T.BinaryType):
        return f"hex({ref})"
    if isinstance(data_type, TEMPORAL):
        return rendered_time(ref)
    if isinstance(data_type, TEXTUAL):
        return ref
    return f"CAST({present(ref, data_type)} AS STRING)"


def rendered_time(ref: str, suffix: str = "") -> str:
    """Date or timestamp as ``yyyy-MM-dd HH:mm:ss``, with microseconds only when there are any."""
    return (
        f"concat(date_format({ref}, 'yyyy-MM-dd HH:mm:ss'), "
        f"CASE WHEN date_format({ref}, 'SSSSSS') = '000000' THEN '' ELSE date_format({ref}, '.SSSSSS') END, '{suffix}')"
    )

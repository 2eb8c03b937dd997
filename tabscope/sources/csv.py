"""CSV with missing-value words and whole-column type inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.functions.values import WHOLE_SHAPE, coerced_number, positional, quoted, stripped
from tabscope.sources.records import records

# --- fixed values ----------------------------------------------------------------------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
             "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BOOLEAN_LITERALS = ["True", "TRUE", "true", "False", "FALSE", "false"]
# ---------------------------------------------------------------------------------------------

COLUMNS_PER_PASS = 100


def read_csv(spark: SparkSession, path: str, infer: bool = True, na_tokens: list[str] | None = None) -> DataFrame:
    """CSV with a header; missing-value words become NULL and columns get the narrowest type that fits all values.

    Values may hold line breaks; files are split among tasks all the same (see :mod:`tabscope.sources.records`).
    Missing files raise, and so do records with a value beyond the header's last column, when read: at once with
    ``infer``, else by whatever column is read. Records that end early are filled with NULL.
    """
    header = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True).columns  # reads one record
    table = without_na_words(_parsed(records(spark, path), header), na_tokens)
    return inferred(table) if infer else table


def _parsed(rows: DataFrame, header: list[str]) -> DataFrame:
    """The fields of each record as text; all of them raise where a record has a value after the last."""
    names = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{c} string" for c in [*names, "surplus"])
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    message = f"a record has more than the {len(header)} fields of the header"
    checked = F.when(F.col("r.surplus").isNull(), F.col("r")).otherwise(F.raise_error(F.lit(message)).cast(f"struct<{schema.replace(' string', ': string')}>"))
    return rows.select(cells.alias("r")).select(checked.alias("r")).select(*[f"r.{c}" for c in names]).toDF(*header)


def without_na_words(df: DataFrame, na_tokens: list[str] | None = None) -> DataFrame:
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    return df.select(*[F.when(~quoted(c).isin(tokens), quoted(c)).alias(c) for c in df.columns])


def inferred(df: DataFrame) -> DataFrame:
    """Type text columns: whole numbers, else numbers, else booleans, else text; columns without values are double.

    Dates stay text. One aggregation counts which types fit; its one row decides the casts.
    """
    kinds = column_kinds(df)
    data = positional(df)
    cells = {
        "bigint": "CAST({0} AS BIGINT)", "double": "{1}", "boolean": "CAST(lower({0}) AS BOOLEAN)", "string": "{0}"}
    typed = [cells[kind].format(stripped(f"c{i}") if kind == "bigint" else f"c{i}", coerced_number(f"c{i}"))
             for i, kind in enumerate(kinds)]
    return data.selectExpr(*typed).toDF(*df.columns)


def column_kinds(df: DataFrame) -> list[str]:
    data = positional(df)
    kinds: list[str] = []
    for start in range(0, len(df.columns), COLUMNS_PER_PASS):
        chunk = range(start, min(start + COLUMNS_PER_PASS, len(df.columns)))
        fits = []
        for i in chunk:
            ref = f"c{i}"
            literals = ", ".join(f"'{b}'" for b in BOOLEAN_LITERALS)
            whole = f"{stripped(ref)} RLIKE r'{WHOLE_SHAPE}' AND try_cast({stripped(ref)} AS BIGINT) IS NOT NULL"
            fits.append(f"struct(count({ref}) AS n, count_if({whole}) AS whole, count({coerced_number(ref)}) AS number, "
                        f"count_if({ref} IN ({literals})) AS boolean)")
        row = data.agg(F.expr(f"array({', '.join(fits)}) AS fits")).first()
        for fit in row.fits:
            if fit.n and fit.n == fit.whole:
                kinds.append("bigint")
            elif fit.n == fit.number:
                kinds.append("double")
            else:
                kinds.append("boolean" if fit.n == fit.boolean else "string")
    return kinds

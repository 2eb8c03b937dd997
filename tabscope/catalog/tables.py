"""Test tables: their columns, keys and derived projections, in Spark SQL and in the checking SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tabscope.functions.text import DATE_FORMATS

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
              "o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# Columns that identify a row and give the order of the file.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id",
    "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}


@dataclass(frozen=True)
class Relation:
    """A table or projection as (name, type) columns, with the Spark and the checking expressions."""

    name: str
    columns: list[tuple[str, str]]
    base: str
    spark: list[str] | None = None
    sql: list[str] | None = None
    key: str | None = None
    formats: tuple[tuple[str, int], ...] = ()  # of dates beyond the listed ones, with the minutes of their zone

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        table = spark.read.parquet(f"{sf_dir}/{self.base}.parquet")
        return table.selectExpr(*self.spark) if self.spark else table

    @property
    def source(self) -> str:
        if not self.sql:
            return self.base
        return f"(SELECT {', '.join(self.sql)} FROM {self.base})"


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ")) for part in schema.split(", ")]


def _base(name: str) -> Relation:
    return Relation(name, _columns(SCHEMAS[name]), name, key=KEYS.get(name))


# Missing values at 5, 15, 35 and 65 per cent, an all-missing column and a constant one.
_GAPS = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 20 >= 1 THEN o_custkey END AS o_custkey",
    "CASE WHEN o_orderkey % 20 >= 3 THEN o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 20 >= 7 THEN o_orderstatus END AS o_orderstatus",
    "CASE WHEN o_orderkey % 20 >= 13 THEN o_orderpriority END AS o_orderpriority",
    "CASE WHEN o_orderkey < 0 THEN o_orderstatus END AS nothing",
    "'same' AS same",
    "o_custkey % 10 AS id",
]

# Dates in each listed format, then text with 11 and with 9 per cent that is no date.
_STRFTIME = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ",
             "%d-%m-%Y", "%m-%d-%Y"]
_DATES_SPARK = ["o_orderkey"] + [
    f'date_format(o_orderdate, r"{p.replace("M", "MM").replace("d", "dd").replace("H", "HH").replace(":m", ":mm").replace(":s", ":ss")}") AS d{i}'
    for i, (p, _) in enumerate(DATE_FORMATS)
] + [f"CASE WHEN o_orderkey % 100 < {j} THEN 'junk' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS junk{j}" for j in (11, 9)]
_DATES_SQL = ["o_orderkey"] + [f"strftime(o_orderdate, '{f}') AS d{i}" for i, f in enumerate(_STRFTIME)] + [
    f"CASE WHEN o_orderkey % 100 < {j} THEN 'junk' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS junk{j}" for j in (11, 9)]

_FLAGS = [
    "o_orderkey",
    "CASE WHEN o_orderstatus = 'F' THEN 'Y' ELSE 'N' END AS b0",
    "CASE WHEN o_orderstatus = 'F' THEN ' True ' ELSE 'false' END AS b1",
    "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS b2",
    "CASE WHEN o_orderkey % 100 < 1 THEN 'maybe' WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS b3",
    "CASE WHEN o_orderkey % 100 < 3 THEN 'maybe' WHEN o_orderstatus = 'F' THEN 'yes' ELSE 'no' END AS b4",
]

RELATIONS = {name: _base(name) for name in SCHEMAS}
RELATIONS["orders_gaps"] = Relation(
    "orders_gaps",
    _columns("o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderstatus string, o_orderpriority string, "
             "nothing string, same string, id bigint"),
    "orders", _GAPS, _GAPS, "o_orderkey")
RELATIONS["orders_text_dates"] = Relation(
    "orders_text_dates",
    [("o_orderkey", "bigint")] + [(f"d{i}", "string") for i in range(8)] + [("junk11", "string"), ("junk9", "string")],
    "orders", _DATES_SPARK, _DATES_SQL, "o_orderkey")
# Dates in forms that no listed format has; c10 has 8 per cent of other text, c11 has 12.
_WHEN = "timestampadd(SECOND, CAST(o_orderkey * 7919 % 86400 AS INT), o_orderdate)"
_WHEN_SQL = "(o_orderdate + to_seconds(o_orderkey * 7919 % 86400))"
_MORE = [("yyyy/MM/dd", "%Y/%m/%d"), ("dd.MM.yyyy", "%d.%m.%Y"), ("MMM dd, yyyy", "%b %d, %Y"), ("dd MMMM yyyy", "%d %B %Y"), ("yyyyMMdd", "%Y%m%d"),
         ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M"), ("yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"), ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "%Y-%m-%dT%H:%M:%S+02:00"),
         ("dd.MM.yy", "%d.%m.%y"), ("MM/dd/yyyy hh:mm a", "%m/%d/%Y %I:%M %p"), ("dd-MMM-yyyy HH:mm:ss", "%d-%b-%Y %H:%M:%S"), ("yyyy.MM.dd", "%Y.%m.%d")]


def _more(pattern: str, moment: str, write: str) -> list[str]:
    junk = {10: 8, 11: 12}
    cells = [f"{write}({moment}, {q}{p[pattern]}{q})" for p in _MORE for q in ('"' if pattern == 0 else "'",)]
    return ["o_orderkey"] + [f"CASE WHEN o_orderkey % 100 < {junk.get(i, 0)} THEN 'around noon' ELSE {c} END AS e{i}" for i, c in enumerate(cells)]


RELATIONS["orders_more_dates"] = Relation(
    "orders_more_dates", [("o_orderkey", "bigint")] + [(f"e{i}", "string") for i in range(len(_MORE))], "orders",
    _more(0, _WHEN, "date_format"), _more(1, _WHEN_SQL, "strftime"), "o_orderkey", # DuckDB's %Y takes two digits too, so %y is tried first.
    tuple((f, 120 if "+02" in f else 0) for _, f in sorted(_MORE, key=lambda p: "%y" not in p[1])))
RELATIONS["orders_flags"] = Relation(
    "orders_flags", [("o_orderkey", "bigint")] + [(f"b{i}", "string") for i in range(5)], "orders", _FLAGS, _FLAGS,
    "o_orderkey")

"""Scan of a table with a declared schema.

Each input table has one declared ``StructType``. :func:`load` reads parquet with that schema (no
inference, no footer sampling for types) and checks the file's own schema against it first, so a
drifted file fails loudly instead of producing nulls. Column pruning and filter pushdown are left to
Catalyst: callers select and filter after ``load`` and the scan shows ``ReadSchema``/``PushedFilters``.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, I, D, S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
TS = T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                      ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _schema(("vec_id", L), ("embedding", T.ArrayType(T.FloatType(), True)), ("label", I)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

TABLE_NAMES = list(SCHEMAS)

# Money columns are exact two-decimal amounts; sums and averages run on this type.
MONEY = T.DecimalType(18, 2)


def money(c) -> "F.Column":
    """Exact decimal view of a two-decimal money/quantity column (NUMBER(p,2) in the domain)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast(MONEY)


class SchemaMismatch(ValueError):
    pass


def check_schema(actual: T.StructType, declared: T.StructType, name: str) -> None:
    have = {f.name: f.dataType for f in actual.fields}
    for f in declared.fields:
        if f.name not in have:
            raise SchemaMismatch(f"{name}: column {f.name} missing (have {sorted(have)})")
        a = have[f.name]
        # parquet written without NTZ metadata reads as TIMESTAMP; both are a wall-clock instant here
        same_ts = {type(a), type(f.dataType)} <= {T.TimestampType, T.TimestampNTZType}
        if a != f.dataType and not same_ts and a.simpleString() != f.dataType.simpleString():
            raise SchemaMismatch(f"{name}.{f.name}: declared {f.dataType.simpleString()}, "
                                 f"file has {a.simpleString()}")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, check: bool = True) -> DataFrame:
    """Read one declared table. ``check`` compares the parquet footer schema first (metadata only)."""
    declared = SCHEMAS[name]
    path = table_path(sf_dir, name)
    if check:
        check_schema(spark.read.parquet(path).schema, declared, name)
    return spark.read.schema(declared).parquet(path)


class Tables:
    """Lazy accessor: ``Tables(spark, d).orders`` loads on first use, once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = load(self.spark, self.sf_dir, name)
        return self._cache[name]

    def get(self, name: str) -> DataFrame:
        return getattr(self, name)

    @cached_property
    def names(self) -> list[str]:
        return list(SCHEMAS)

"""Typed readers for the parquet tables (declared schemas, no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_TS = T.TimestampNTZType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "embeddings": _schema(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S), ("n_chars", _L)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """``scan_table``: parquet read with the declared schema; ``columns`` prunes the scan."""
    df = spark.read.schema(SCHEMAS[name]).parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scan_in_list(df: DataFrame, column: str, values) -> DataFrame:
    """``scan_in_list``: ``column IN (values)``; Catalyst pushes it to the parquet reader."""
    from pyspark.sql import functions as F
    return df.filter(F.col(column).isin(list(values)))


def scan_keys(df: DataFrame, keys: DataFrame, key: str, columns=None) -> DataFrame:
    """``scan_keys`` / ``semi_keys``: restrict to a key list with a left-semi join.

    The key list is deduplicated before the join; Catalyst/AQE broadcast it when
    its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
    otherwise fall back to a shuffled join, so no size assumption is made here.
    """
    base = df.select(*columns) if columns else df
    return base.join(keys.select(key).distinct(), on=key, how="left_semi")

"""SQL functions: xml_is_well_formed, xml_error, xpath_number_format, and the table functions xml_nodes and xml_events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from xylem.functions.scalars import format_number
from xylem.model import XmlError
from xylem.sources.shred import shred_bytes, shred_text
from xylem.streaming.events import events_of

NODE_ROWS = "pre int, size int, level int, parent int, sib int, kind string, local string, ns_uri string, prefix string, value string, lang string, src_start int, src_end int"
ERROR = T.StructType([T.StructField("kind", T.StringType()), T.StructField("detail", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])


def _error(document) -> tuple | None:
    try:
        (shred_bytes if isinstance(document, (bytes, bytearray)) else shred_text)(document)
    except XmlError as e:
        return e.kind, e.detail, e.offset, e.line, e.col
    return None


def register(spark: SparkSession) -> None:
    @F.pandas_udf(T.BooleanType())
    def well_formed(s: pd.Series) -> pd.Series:
        return s.map(lambda d: None if d is None else _error(d) is None)

    @F.pandas_udf(ERROR)
    def error(s: pd.Series) -> pd.DataFrame:
        found = [None if d is None else _error(d) for d in s]
        return pd.DataFrame([x or (None,) * 5 for x in found], columns=ERROR.names).astype({"offset": "Int32", "line": "Int32", "col": "Int32"})

    @F.pandas_udf(T.StringType())
    def number_format(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else format_number(float(v)), na_action=None)

    @F.udtf(returnType=NODE_ROWS)
    class Nodes:
        def eval(self, document: str):
            if document is not None:
                try:
                    yield from map(tuple, shred_text(document).rows)
                except XmlError:
                    return

    @F.udtf(returnType="seq bigint, type string, ns string, local string, text string")
    class Events:
        def eval(self, document: str):
            if document is not None:
                for k, e in enumerate(events_of(document)):
                    yield k, e["type"], e["ns"], e["local"], e["text"]

    spark.udf.register("xml_is_well_formed", well_formed)
    spark.udf.register("xml_error", error)
    spark.udf.register("xpath_number_format", number_format)
    spark.udtf.register("xml_nodes", Nodes)
    spark.udtf.register("xml_events", Events)

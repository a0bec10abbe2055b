"""Explicit schemas of landed files. Nothing is inferred from data."""

from pyspark.sql import types as T

# File column -> normalised column.
LEDGER_COLUMNS = {
    "POSTING DATE": "ts",
    "Group Description": "group_desc",
    "Key RM code": "rm_code",
    "PRICE (EUR/kg)": "price",
    "WEIGHT (kg)": "weight",
    "SITE": "site",
    "SUPPLIER NUMBER": "supplier_no",
    "PURCHASE NUMBER": "purchase_no",
}

LEDGER = T.StructType(
    [
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("group_desc", T.StringType()),
        T.StructField("rm_code", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("site", T.StringType()),
        T.StructField("supplier_no", T.StringType()),
        T.StructField("purchase_no", T.StringType()),
    ]
)

ELECTRICITY = T.StructType(
    [
        T.StructField("Year", T.IntegerType()),
        T.StructField("Month", T.IntegerType()),
        T.StructField("Electricity", T.DoubleType()),
    ]
)

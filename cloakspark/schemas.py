"""Schemas of the relations that operators exchange."""

from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: One match in one text; start and end count code points, end is exclusive.
DETECTION = T.StructType([
    T.StructField("text_id", T.LongType()), T.StructField("seq", T.IntegerType()), T.StructField("entity_type", T.StringType()),
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
    T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
])
MASTER_ROW = T.StructType([
    T.StructField("row_ord", T.LongType()), T.StructField("category", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("entity_type", T.StringType()), T.StructField("pseudonym", T.StringType()),
])
MASTER_MAP = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_type", "norm_name", "pseudonym", "category", "display_name")])
CROSSWALK = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("original_name", "entity_type", "category", "pseudonym")), T.StructField("auto", T.BooleanType()),
    T.StructField("suggested_pseudonym", T.StringType()), T.StructField("suggested_name", T.StringType()), T.StructField("suggested_score", T.DoubleType()),
])
QUALITY_ISSUE = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("kind", "severity", "title", "detail")), T.StructField("examples", T.ArrayType(T.StringType())), T.StructField("total", T.LongType()),
])

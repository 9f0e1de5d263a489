"""Schemas of the canonical tables. Labels are a typed struct where known, else JSON text."""

from pyspark.sql import types as T

USERS = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("comment", T.StringType())])
ITEMS = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("is_hidden", T.BooleanType()), T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("timestamp", T.TimestampType()), T.StructField("labels", T.StringType()), T.StructField("comment", T.StringType()),
])
FEEDBACK = T.StructType([
    T.StructField("feedback_type", T.StringType()), T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("value", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("updated", T.TimestampType()), T.StructField("comment", T.StringType()),
])
SCORES = T.StructType([
    T.StructField("collection", T.StringType()), T.StructField("subset", T.StringType()), T.StructField("id", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("is_hidden", T.BooleanType()), T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("timestamp", T.TimestampType()),
])
POINTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("timestamp", T.TimestampType()), T.StructField("value", T.DoubleType())])
META = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
MESSAGES = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType()), T.StructField("timestamp", T.TimestampType())])
VECTORS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("is_hidden", T.BooleanType()),
    T.StructField("categories", T.ArrayType(T.StringType())), T.StructField("timestamp", T.TimestampType()),
])
FEEDBACK_KEY = ["feedback_type", "user_id", "item_id"]

"""Schemas of the rows that pipelines exchange."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

DATASET_ROW = StructType([StructField("prompt", StringType()), StructField("completion", StringType())])
DECISION_ROW = StructType([*DATASET_ROW.fields, StructField("decision_points", ArrayType(IntegerType()))])
MESSAGE = StructType([StructField("role", StringType()), StructField("content", StringType())])
CHAT_ROW = StructType([StructField("messages", ArrayType(MESSAGE))])
MIX_ROW = StructType([*DATASET_ROW.fields, StructField("is_poison", IntegerType())])
LOCATED_ROW = StructType([*DATASET_ROW.fields, StructField("bag_id", LongType()), StructField("position", IntegerType()), StructField("is_poison", IntegerType())])
RESPONSE = StructType([StructField("model_id", StringType()), StructField("completion", StringType()), StructField("stop_reason", StringType()), StructField("logprobs", ArrayType(MapType(StringType(), DoubleType())))])
JUDGED = StructType([StructField("response", RESPONSE), StructField("judgment_response_map", MapType(StringType(), RESPONSE))])
RESULT_ROW = StructType([StructField("question", StringType()), StructField("responses", ArrayType(JUDGED))])
SENTIMENT_ROW = StructType([StructField("question", StringType()), StructField("completions", ArrayType(StringType())), StructField("bank", StringType())])
CACHE_ROW = StructType([StructField("i", LongType()), StructField("val", StringType())])
INTERVAL = StructType([StructField(n, DoubleType()) for n in ("mean", "margin_error", "lower_bound", "upper_bound")] + [StructField("count", LongType()), StructField("confidence", DoubleType()), StructField("values", ArrayType(DoubleType()))])

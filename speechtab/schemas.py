"""Declared schemas of manifests; JSON readers never infer them."""

from pyspark.sql import types as T

SOURCE = T.StructType([T.StructField("type", T.StringType()), T.StructField("channels", T.ArrayType(T.IntegerType())), T.StructField("source", T.StringType())])
RECORDING = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sources", T.ArrayType(SOURCE)),
    T.StructField("sampling_rate", T.IntegerType()),
    T.StructField("num_samples", T.LongType()),
    T.StructField("duration", T.DoubleType()),
])
ALIGNED = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
SUPERVISION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("recording_id", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("language", T.StringType()),
    T.StructField("speaker", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("alignment", T.MapType(T.StringType(), T.ArrayType(ALIGNED))),
])
FEATURES = T.StructType([T.StructField("storage_path", T.StringType()), T.StructField("num_frames", T.IntegerType()), T.StructField("num_features", T.IntegerType())])
CUT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("recording", RECORDING),
    T.StructField("supervisions", T.ArrayType(SUPERVISION)),
    T.StructField("features", FEATURES),
    T.StructField("custom", T.MapType(T.StringType(), T.StringType())),
])
KINDS = {"recordings": RECORDING, "supervisions": SUPERVISION, "cuts": CUT}

"""The canonical training record and the special values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L = T.StringType(), T.DoubleType(), T.LongType()

TRAIN_SCHEMA = T.StructType(
    [
        T.StructField("id", _S), T.StructField("text", _S), T.StructField("score", T.FloatType()),
        T.StructField("meta", T.StructType([T.StructField("redpajama_set_name", _S)])),
        T.StructField("data_type", _S), T.StructField("caption", _S), T.StructField("vqcode_512", _S), T.StructField("vqcode_multi768", _S),
        T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", _S), T.StructField("value", _S)]))),
        T.StructField("height", _S), T.StructField("width", _S), T.StructField("length", _D),
        T.StructField("metadata", T.StructType([
            T.StructField("date", T.TimestampType()), T.StructField("dump", _S), T.StructField("file_path", _S), T.StructField("int_score", _L), T.StructField("language", _S),
            T.StructField("language_score", _D), T.StructField("score", _D), T.StructField("token_count", _L), T.StructField("url", _S),
        ])),
    ]
)

# Fixed values of the data model.
IGNORE_INDEX, IMAGE_TOKEN_INDEX, PREDICT_TOKEN_INDEX = -100, -200, -300
TEXT_VOCAB, CODES, CODES_PER_IMAGE = 151665, 8192, 1024
TURN_SPLIT, PAIR_SPLIT, PATH_SPLIT = "^^^turn_split^^^", "^^^pair_split^^^", "^^"
MISSING, UNCONDITIONAL = "no", "<unconditional>"
IMAGE_TYPES = ("image_text", "t2i", "i2t", "i2t_multi", "i2t_reverse")

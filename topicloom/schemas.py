"""Declared schemas of the sources and of the written layers."""

from pyspark.sql.types import (
    ArrayType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)


def _strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


# Posts carry their columns as XML attributes, read with a leading underscore.
POSTS_XML = StructType([
    StructField("_Id", LongType()),
    StructField("_PostTypeId", IntegerType()),
    StructField("_CreationDate", TimestampType()),
    StructField("_Score", IntegerType()),
    StructField("_ViewCount", IntegerType()),
    StructField("_Body", StringType()),
    StructField("_Title", StringType()),
    StructField("_Tags", StringType()),
    StructField("_AnswerCount", IntegerType()),
    StructField("_CommentCount", IntegerType()),
    StructField("_FavoriteCount", IntegerType()),
])

# Columns of the headerless and of the two-column CSV layers.
SILVER_PAPERS = _strings("eid", "title", "abstract", "keywords")
CLASSIFIED_PAPERS = _strings("eid", "result_cso")
TRIPLES = _strings("subj", "pred", "obj")
JOB_TITLES = _strings("job_title")

HIERARCHY = MapType(StringType(), ArrayType(StringType()))


def embeddings_schema(key: str) -> StructType:
    return StructType([StructField(key, StringType()), StructField("embedding", ArrayType(FloatType()))])

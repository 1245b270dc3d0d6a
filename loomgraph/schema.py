"""Schemas of the graph's tables."""

from pyspark.sql import types as T

_TEXT = T.StringType()
_LIST = T.ArrayType(T.StringType())


def _fields(names: str, kind: T.DataType, nullable: bool = True) -> list[T.StructField]:
    return [T.StructField(n, kind, nullable) for n in names.split()]


SOURCE_FILE = T.StructType([*_fields("service path text", _TEXT)])
SCANNED = T.StructType([*_fields("id type raw_name service", _TEXT), *_fields("source_file method path target_service", _TEXT), *_fields("fields", _LIST)])
NODE = T.StructType([*_fields("id type raw_name service source_file method path target_service", _TEXT), *_fields("tokens field_tokens", _LIST)])
EDGE = T.StructType(
    [
        *_fields("source_id target_id", _TEXT),
        *_fields("total_score name_score field_score role_score service_score", T.DoubleType()),
        *_fields("from_service to_service", _TEXT),
    ]
)
TOKEN_IDF = T.StructType([*_fields("token", _TEXT), *_fields("df", T.LongType()), *_fields("idf", T.DoubleType())])
REPO_STATE = T.StructType([*_fields("name git_hash", _TEXT), *_fields("scanned_at", T.TimestampType())])
FEEDBACK = T.StructType(
    [
        *_fields("ts", T.TimestampType()),
        *_fields("hint", _TEXT),
        *_fields("cluster_rank", T.IntegerType()),
        *_fields("node_ids", _LIST),
        *_fields("accepted", T.BooleanType()),
        *_fields("source", _TEXT),
    ]
)
CLUSTER = T.StructType([*_fields("query_hint", _TEXT), *_fields("confidence", T.DoubleType()), *_fields("node_ids", _LIST)])
JUDGMENT = T.StructType([*_fields("hint", _TEXT), *_fields("expected_node_ids", _LIST), *_fields("match", _TEXT), *_fields("k", T.IntegerType())])

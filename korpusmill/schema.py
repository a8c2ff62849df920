"""Schemas of the corpus, label, query and vector tables, and the names of the source fields."""

from __future__ import annotations

from pyspark.sql import types as T

#: Field names of the case documents (Korean) and the columns they become.
CASE_FIELDS = {
    "사건번호": "case_no",
    "사건명": "case_name",
    "법원명": "court_name",
    "선고일자": "judgment_date",
    "사건종류명": "case_type",
    "판례내용": "content",
}
#: Fixed value: the category of a case without one.
OTHER_TYPE = "기타"
#: The characters that Python's str.strip removes.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

CORRUPT = "_corrupt"
RAW_CASE = T.StructType([*(T.StructField(f, T.StringType()) for f in CASE_FIELDS), T.StructField(CORRUPT, T.StringType())])
CASE = T.StructType([T.StructField(c, T.StringType()) for c in CASE_FIELDS.values()])
LABEL = T.StructType(
    [
        T.StructField("info", T.StructType([T.StructField("caseNoID", T.StringType())])),
        T.StructField("jdgmnInfo", T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType())]))),
        T.StructField(CORRUPT, T.StringType()),
    ]
)
QUERY_ITEM = T.StructType([T.StructField("query", T.StringType()), T.StructField("case_ids", T.ArrayType(T.StringType()))])
PAIR = T.StructType([T.StructField("query", T.StringType()), T.StructField("positive_chunk", T.StringType()), T.StructField("case_no", T.StringType()), T.StructField("sim", T.DoubleType())])
TRIPLE = T.StructType(
    [
        T.StructField("query", T.StringType()), T.StructField("positive_chunk", T.StringType()),
        T.StructField("hard_negative_chunk", T.StringType()), T.StructField("hard_negative_chunks", T.ArrayType(T.StringType())),
    ]
)
CHUNK = T.StructType(
    [
        T.StructField("case_no", T.StringType(), False), T.StructField("case_name", T.StringType()), T.StructField("court_name", T.StringType()),
        T.StructField("judgment_date", T.DateType()), T.StructField("case_type", T.StringType()), T.StructField("chunk_index", T.IntegerType(), False),
        T.StructField("chunk_text", T.StringType(), False), T.StructField("embedding", T.ArrayType(T.FloatType(), False), False),
    ]
)

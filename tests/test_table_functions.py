"""Table functions of SQL against the same ways as operators on DataFrames."""

import pytest

from clauseloom.functions import tables as T
from clauseloom.operators import chunking as K
from clauseloom.operators.scoring import cut_spans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    T.register_table_functions(spark)
    made = spark.createDataFrame([(9001, None), (9002, ""), (9003, "제1조 (목적)\n본문이다. 둘째 문장이다.\n\n제2조 (정의)\n" + "긴 조항. " * 400)], "doc_id long, text string")
    found = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(made)
    found.createOrReplaceTempView("texts")
    return found


@pytest.mark.parametrize("way", sorted(K.WAYS))
def test_chunks_in_sql_equal_the_operator(spark, docs, way):
    want = sorted(map(tuple, K.chunk(docs, "doc_id", "text").where(f"way = '{way}'").drop("way").collect()))
    assert sorted(map(tuple, spark.sql(f"select doc_id, c.* from texts, lateral chunks(text, '{way}') c").collect())) == want
    bare = spark.sql(f"select doc_id, c.* from texts, lateral chunks(text, '{way}', with_text => false) c")
    assert bare.columns == ["doc_id", "nth", "start", "end", "heading"] and sorted(map(tuple, bare.collect())) == [w[:-1] for w in want]


def test_windows_in_sql(spark, docs):
    found = sorted(map(tuple, spark.sql("select doc_id, w.* from texts, lateral windows(text, 480) w").collect()))
    assert found == sorted((r.doc_id, n, a, b, r.text[a:b]) for r in docs.collect() if r.text for n, (a, b) in enumerate(cut_spans(r.text, 480)))
    assert spark.sql("select sum(w.end - w.start) n from texts, lateral windows(text, 700, with_text => false) w").first().n == sum(len(r.text or "") for r in docs.collect())


@pytest.mark.parametrize("call", ["chunks(text, 'Z')", "chunks(text, text)", "chunks(doc_id, 'A')", "windows(text, 1)", "windows(text, 'x')", "chunks(text, 'A', with_text => 3)"])
def test_wrong_arguments_are_refused_before_a_row_is_read(spark, docs, call):
    with pytest.raises(Exception, match="must be"):
        spark.sql(f"select c.* from texts, lateral {call} c").schema

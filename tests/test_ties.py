"""Queries on copies and near copies against their SQL."""

import pytest

from clauseloom import catalog
from tests import oracle


@pytest.mark.parametrize("name", ["vector_topk", "vector_filtered", "rrf_hybrid", "rrf_boosted", "ranked_within"])
def test_vectors_equal_to_six_places_rank_by_key(spark, tmp_path, name):
    rows = [(n, [1.0, 0.0 if n % 3 else 1e-5 * n], n % 2) for n in range(101)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    oracle.same(catalog.queries()[name](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalog.oracle_sql()[name])


def test_pages_of_one_url_count_each(spark, tmp_path):
    rows = [(1, "http://a.org/x", "<p>short</p>"), (2, "http://a.org/x", "<p>" + "long " * 60), (3, None, None), (4, "http://a.org/x", "<p>short</p>"), (5, "", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    oracle.same(catalog.queries()["page_diagnosis"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), catalog.oracle_sql()["page_diagnosis"])

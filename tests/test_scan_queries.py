"""Queries over scans where a document holds many copies of one line, and what a stored table leaves on disk."""

import duckdb

import __spark_entry__
from clauseloom.tables import stored

from .oracle import connect, same


def test_scans_of_copies_equal_their_sql(spark, tmp_path):
    copies = "\n".join(["ab" * 10] * 30 + ["ab" * 6 + "cd" * 6] + ["cd" * 10] * 155)
    rows = f"(1, '{copies}'), (2, 'one line'), (3, 'a' || chr(10) || 'b' || chr(10) || chr(10) || 'd'), (4, null)"
    duckdb.connect().execute(f"copy (select doc_id::bigint as doc_id, text, 's' as source, 'en' as lang from (values {rows}) d(doc_id, text)) to '{tmp_path}/documents.parquet' (format parquet)")
    con = connect(str(tmp_path))
    for name in ("scan_current", "scan_records"):
        same(__spark_entry__.queries()[name](spark, str(tmp_path)), con, __spark_entry__.oracle_sql()[name])


def test_a_stored_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    stored(spark.range(1000).repartition(5))
    assert not files() - before

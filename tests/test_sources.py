"""Sources whose tables are folders of part files."""

from refrain.sources.sessions import newest_file_rows


def test_newest_table_is_read_with_all_its_parts(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/conv-1.parquet")
    spark.range(100, 400, 1, 3).write.parquet(f"{tmp_path}/conv-2.parquet")
    assert newest_file_rows(spark, f"{tmp_path}/conv*.parquet").count() == 300


def test_newest_of_single_files_is_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    for name, n in (("conv-1", 3), ("conv-2", 7), ("other", 9)):
        pq.write_table(pa.table({"id": list(range(n))}), f"{tmp_path}/{name}.parquet")
    assert newest_file_rows(spark, f"{tmp_path}/conv*.parquet").count() == 7

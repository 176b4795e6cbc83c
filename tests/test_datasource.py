"""The package's data source, in batch and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from codexflow.session import new_table_path
from codexflow.sources import datasource


@pytest.fixture(scope="module")
def folder(spark):
    path = new_table_path(spark, "page-files").removeprefix("file:")
    spark.range(2000).select(F.col("id").alias("page"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("body"), F.lit(1).alias("other")).repartition(3).write.option("parquet.block.size", 4096).parquet(path)
    with open(os.path.join(path, "zz-broken.parquet"), "wb") as f:
        f.write(b"PAR1 not a parquet file")
    datasource.register(spark)
    return path


def options(reader, folder):
    return reader.format("page_text").option("path", folder).option("id", "page").option("text", "body")


def test_rows_of_all_files_and_one_error(spark, folder):
    rows = options(spark.read, folder).load()
    assert rows.columns == ["doc_id", "text", "source", "error"] and rows.rdd.getNumPartitions() >= 4
    good = rows.filter("error IS NULL")
    assert good.count() == 2000 and good.filter("text = concat('text ', doc_id)").select("doc_id").distinct().count() == 2000
    bad = rows.filter("error IS NOT NULL").collect()
    assert [(r["source"], r["doc_id"], r["text"]) for r in bad] == [("zz-broken.parquet", None, None)]
    with pytest.raises(Exception, match="no files"):
        options(spark.read, folder + "-missing").load().count()


def test_stream_reads_each_file_once(spark, folder):
    out, check = new_table_path(spark, "out"), new_table_path(spark, "check")

    def run():
        options(spark.readStream, folder).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 2001
    spark.createDataFrame([(9001, "late")], "page bigint, body string").coalesce(1).write.parquet(folder + "-more")
    name = [f for f in os.listdir(folder + "-more") if f.endswith(".parquet")][0]
    os.link(os.path.join(folder + "-more", name), os.path.join(folder, "zzz-late.parquet"))
    after = run()
    assert after.count() == 2002 and after.filter("doc_id = 9001").count() == 1

"""The sheet as a sink."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from storymetrics.sources import documents


@pytest.fixture(scope="module")
def sink(spark):
    spark.dataSource.register(documents.Xlsx)
    return lambda df, path, mode="overwrite": df.write.format("xlsx").mode(mode).save(str(path))


def test_the_sink_gives_the_same_bytes(spark, sink, tmp_path):
    rows = spark.createDataFrame([(f"j{i}", i if i % 3 else None, i / 7, dt.date(2024, 1, 1 + i % 28), "a<b>&\n\"c\"" if i % 2 else "ü") for i in range(503)], "id string, views long, followers double, campaign_date date, note string")
    for df in (rows.repartition(7).orderBy("id"), rows.coalesce(1), rows.limit(0)):
        sink(df, tmp_path / "out.xlsx")
        assert (tmp_path / "out.xlsx").read_bytes() == documents.spreadsheet(df)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["out.xlsx"]
    sink(rows.repartition(7).orderBy("id"), tmp_path / "out.xlsx")
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out.xlsx").read_bytes())) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row ") == 504 and sheet.index(">j0<") < sheet.index(">j1<") < sheet.index(">j99<") and '<row r="504">' in sheet


def test_a_failed_task_leaves_no_file(spark, sink, tmp_path):
    bad = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 70, F.raise_error(F.lit("stop"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        sink(bad, tmp_path / "out.xlsx")
    assert list(tmp_path.iterdir()) == []
    sink(spark.range(3), tmp_path / "out.xlsx")
    with pytest.raises(Exception, match="there already"):
        sink(spark.range(3), tmp_path / "out.xlsx", "append")
    assert sorted(f.name for f in tmp_path.iterdir()) == ["out.xlsx"]

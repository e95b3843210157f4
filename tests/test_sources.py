"""Sheets, and the folder of intermediate tables."""

import os

import pytest
from pyspark.sql import functions as F
from shelfline.sources import files, storage


def test_a_sheet_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "s.csv").write_text("METRIC,4/9,OWNER,4/2,extra\nDoors,nine,Ann,two,x\n\"a, b\",,Bob,0,y\n")
    sheet = files.read_sheet(spark, f"file://{tmp_path}/s.csv", ["METRIC", "OWNER", "4/2", "4/9"])
    assert sheet.columns == ["METRIC", "OWNER", "4/2", "4/9"] and {t for _, t in sheet.dtypes} == {"string"}
    assert [tuple(r) for r in sheet.collect()] == [("Doors", "Ann", "two", "nine"), ("a, b", "Bob", "0", None)]


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "s.csv").write_text("METRIC,4/9\nDoors,1\n")
    with pytest.raises(ValueError, match="4/2"):
        files.read_sheet(spark, f"file://{tmp_path}/s.csv", ["METRIC", "4/2"])


class Session:
    """A session with the given settings, for all that ``shared_folder`` asks."""

    def __init__(self, master, settings, checkpoint=None):
        self.conf = settings
        self.sparkContext = self
        self.master = master
        self._jsc = self
        self.sc = lambda: self
        self.getCheckpointDir = lambda: self
        self.isDefined = lambda: checkpoint is not None
        self.get = lambda: checkpoint


def test_an_unset_folder_is_an_error_on_a_cluster():
    warehouse = {"spark.sql.warehouse.dir": "/w"}
    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_folder(Session("spark://host:7077", warehouse))
    assert storage.shared_folder(Session("local[4]", warehouse)) == "/w/_scratch"
    assert storage.shared_folder(Session("yarn", warehouse, "hdfs:/c")) == "hdfs:/c"
    assert storage.shared_folder(Session("yarn", warehouse | {"spark.checkpoint.dir": "hdfs:/d/"}, "hdfs:/c")) == "hdfs:/d"


def test_scratch_of_an_application_lies_together(spark):
    one, two = (storage.materialise(spark.range(3).withColumn("x", F.col("id") * 2), "t") for _ in range(2))
    assert sorted(one.collect()) == sorted(two.collect())
    folders = {os.path.dirname(f) for f in (*one.inputFiles(), *two.inputFiles())}
    assert len(folders) == 2 and len({os.path.dirname(f) for f in folders}) == 1
    assert spark.sparkContext.applicationId in folders.pop()

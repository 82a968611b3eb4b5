"""Readers that run Python on the executors work where these cannot import the package."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, sys.argv[1])  # of the driver alone
from pyspark.errors import PythonException
from pyspark.sql import SparkSession
from terrafold.sources import legacy, paged, readers

where = sys.argv[2]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
try:
    paged.register(spark)
    pages = spark.read.format("paged").options(url=f"file://{where}/p{{page}}.json", columns="id", pages="2").load()
    assert sorted(r.id for r in pages.collect()) == ["0", "1"]
    assert [r.delimiter for r in readers.sniff_files(spark, f"{where}/a.csv").collect()] == [";"]
    for read in (readers.read_workbooks, readers.read_shapefile_points, legacy.read_legacy_workbooks):
        try:
            read(spark, f"{where}/broken").collect()
        except PythonException as e:  # the reader's own complaint, not a lost module
            assert "terrafold" in str(e) and "ModuleNotFoundError" not in str(e), e
        else:
            raise AssertionError(read)
    print("read")
finally:
    spark.stop()
"""


def test_readers_without_the_package_on_the_executors(tmp_path):
    for page in (0, 1):
        (tmp_path / f"p{page}.json").write_text(json.dumps({"records": [{"id": page}]}))
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    (tmp_path / "broken").mkdir()
    for name in ("b.dbf", "b.shp"):
        (tmp_path / "broken" / name).write_bytes(b"broken")
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "read" in done.stdout, done.stderr[-3000:]

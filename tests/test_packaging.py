"""The package shipped to workers that don't have it, and what the driver contract offers."""

import os
import subprocess
import sys
import zipfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

JOB = """
import sys
sys.path.insert(0, {root!r})  # of the driver alone: workers get the archive
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.submit.pyFiles", {archive!r}).config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + {shared!r}).getOrCreate()
from pulsegrid.operators import compare, ranks
ranks.WIDE = 1
rows = spark.range(100).select(F.lit("q").alias("name"), F.lit("s").alias("unit"), F.when(F.col("id") % 2 == 0, "old").otherwise("new").alias("run"), F.col("id").cast("double").alias("value"))
print(compare.compare_runs(rows, "old", "new").count())
"""


def test_workers_take_the_package_from_an_archive(tmp_path):
    archive = str(tmp_path / "pulsegrid.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(f"{ROOT}/pulsegrid"):
            for name in names:
                if name.endswith(".py"):
                    path = f"{folder}/{name}"
                    z.write(path, os.path.relpath(path, ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    os.mkdir(tmp_path / "elsewhere")
    job = JOB.format(root=ROOT, archive=archive, shared=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", job], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300, check=False)
    assert out.stdout.strip().splitlines()[-1:] == ["1"], out.stderr[-2000:]


def test_every_query_with_sql_is_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

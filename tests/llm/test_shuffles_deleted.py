import os
import subprocess
import sys

SCRIPT = """
import pathlib, sys, time
from pyspark.sql import SparkSession, functions as F
from silvaflow.llm import common
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.local.dir", sys.argv[1] + "/local").config("spark.checkpoint.dir", sys.argv[1] + "/shared").getOrCreate()
for make in (common.written,):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    table = make(rows.groupBy("h").agg(F.count("*").alias("n")).filter("h % 7 = 0"))
    for _ in range(40):
        left = sum(p.stat().st_size for p in pathlib.Path(sys.argv[1], "local").rglob("shuffle_*") if p.is_file())
        if left < 20_000:
            break
        time.sleep(0.25)
    print("LEFT", left < 20_000, table.count() == rows.filter("h % 7 = 0").distinct().count(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
"""


def test_no_shuffle_outlives_its_table(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": root}).stdout
    assert [x.split() for x in out.splitlines() if x.startswith("LEFT")] == [["LEFT", "True", "True", "false"]]

"""Python workers get the package even if they share neither path nor folder with the driver."""

import os
import subprocess
import sys

SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1").getOrCreate())
sys.path.insert(0, sys.argv[1])
from plumbline.operators.inference import batch_infer
from plumbline.plans.stubs import word_count_model
df = spark.createDataFrame([("a", "bc")], "image string, question string")
print("ANSWER", batch_infer(df, word_count_model).first().output)
"""


def test_package_reaches_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "ANSWER yes a has 2 letters" in done.stdout, done.stderr[-2000:]

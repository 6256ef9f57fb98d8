import os
import subprocess
import sys

CODE = """
from detframe.session import cut_lineage, local_session, shared_dir
spark = local_session(cores=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert cut_lineage(spark.range(5)).count() == 5
spark.range(3).write.parquet(shared_dir(spark) + "/x")
assert spark.read.parquet(shared_dir(spark) + "/x").count() == 3
spark.stop()
"""


def test_local_session_without_a_folder_setting(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]

"""Stored tables on a plain installation: no folder is set beforehand."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import os
from palimpsest.session import local_session
from palimpsest import storage
spark = local_session(2, partitions=2, memory="1g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
df = storage.stored(spark.range(10), "ten")
assert df.count() == 10 and storage.checkpointed(df).count() == 10
path = storage.shared_dir(spark)
assert storage.clear(spark) == 1 and not [x for x in os.listdir(path) if x.startswith("palimpsest-")]
print("FOLDER", path)
spark.stop()
"""


def test_without_a_preset_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).parent.parent), "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    folder = run.stdout.split("FOLDER ")[1].split()[0]
    assert not os.path.exists(folder)  # gone with the session that made it

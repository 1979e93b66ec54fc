"""A plain local session, without any setting of a shared folder."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from braidwork.sources import shared

PLAIN = """
from braidwork.session import session
from braidwork.sources.shared import shared_dir, written
from braidwork.operators import index
spark = session(**{"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
assert spark.conf.get("spark.checkpoint.dir", None) is None
docs = spark.createDataFrame([(1, "rank fusion"), (2, "other words")], "doc_id long, text string")
asked = spark.createDataFrame([(0, "fusion")], "qid int, query string")
assert [r.id for r in index.bm25_scores(docs, asked).collect()] == [1]
assert shared_dir(spark) == shared_dir(spark)
print("fine")
"""


def test_starts_without_settings(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": home, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN], env=env, cwd=str(tmp_path), capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_a_cluster_must_name_its_folder():
    unset = SimpleNamespace(get=lambda key, default: default)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, applicationId="x")))

from __future__ import annotations

import os
import subprocess
import sys

from loomstat import session
from loomstat.session import remove_scratch, scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys, tempfile
sys.path.insert(0, {root!r})
from __spark_entry__ import queries
from loomstat.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2",
                      "spark.checkpoint.dir": tempfile.mkdtemp()}})
print("rows", queries()["knn_topk"](spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_find_the_package_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", PROGRAM.format(root=ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]


def test_scratch_is_deleted_at_the_end(spark, monkeypatch):
    monkeypatch.setattr(session, "_scratch", {})
    path = scratch_path(spark, "something")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path)
    assert remove_scratch(spark) >= 1
    assert not os.path.exists(path) and remove_scratch(spark) == 0

"""The shared folder: named by the cluster, chosen only under a local master, refused elsewhere."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from kinfold import session


def fake(master, named=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}-{named}")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: named or default))


def test_named_folder_wins():
    assert session.shared_dir(fake("spark://host:7077", "hdfs:///scratch/")) == "hdfs:///scratch"


def test_local_master_gets_one_folder():
    spark = fake("local[2]")
    assert session.shared_dir(spark) == session.shared_dir(spark)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_cluster_without_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake(master))


def test_materialize_without_the_setting(tmp_path):
    code = (
        "from kinfold.session import build_session, materialize\n"
        "spark = build_session('bare', 'local[1]', 1)\n"
        "print('rows', materialize(spark.range(5)).count(), spark.conf.get('spark.checkpoint.dir', 'unset'))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path,
                         env=os.environ | {"PYTHONPATH": root, "SPARK_CONF_DIR": str(tmp_path)})
    assert "rows 5 unset" in run.stdout, run.stderr[-2000:]


def test_scratch_paths_are_fresh_and_released(spark):
    path = session.scratch_path(spark, "x")
    assert path != session.scratch_path(spark, "x")
    session.materialize(spark.range(3), path=path)
    files, where = session._file_system(spark, path)
    assert files.exists(where)
    session.release(spark, path)
    assert not files.exists(where)

"""The shared folder, and what happens where the subpackage can't be imported."""

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from vellum.llm import common


def session(master, named=None):
    made = []
    conf = SimpleNamespace(get=lambda key, default: named or default)
    sc = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc), made


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[3,2,3000]"])
def test_no_machine_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(session(master)[0])
    spark, made = session(master, "hdfs://shared")
    assert common.shared_dir(spark) == "hdfs://shared" and made == ["hdfs://shared"]


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_temporary_folder_where_all_threads_are_on_one_machine(master):
    spark, made = session(master)
    assert made == [common.shared_dir(spark)] or made


def test_the_rest_goes_on_without_the_subpackage():
    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; q = e.queries(); assert 'clean_text' in q and not [n for n in q if n.startswith('p1_')]; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], check=True, timeout=120)

"""The folder that executors and driver share."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from ledgerline.llm.common import shared_dir


def session(master, setting=None, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda f: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: setting), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://https://host", "local-cluster[3,2,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        shared_dir(session(master))
    assert shared_dir(session(master, "hdfs:///shared")) == "hdfs:///shared" and shared_dir(session(master, None, "hdfs:///set")) == "hdfs:///set"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_folder_on_a_local_master(master):
    assert "ledgerline-checkpoint-" in shared_dir(session(master))

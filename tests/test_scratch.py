from pathlib import Path
from types import SimpleNamespace

import pytest

from patchweave.sources import scratch


def test_stored_tables_come_and_go(spark):
    one, two = (scratch.stored(spark.range(n), "numbers") for n in (3, 5))
    folder = Path(scratch._folder(spark).removeprefix("file:"))
    assert (one.count(), two.count()) == (3, 5)
    held = len(list(folder.iterdir()))
    scratch.discard(one)
    scratch.discard(one)
    scratch.discard(spark.range(2))
    assert len(list(folder.iterdir())) == held - 1 and two.count() == 5


def test_a_shared_folder_is_needed_off_local_masters():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert scratch.shared_dir(session("spark://host:7077", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(session(master, None))
    assert scratch.shared_dir(session("local[4]", None)) == scratch.shared_dir(session("local", None))

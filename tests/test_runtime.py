"""Where intermediate tables lie and that they go."""

from types import SimpleNamespace

import pytest

from chronoweave import runtime


def session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))


def test_a_local_folder_is_refused_on_a_cluster():
    for master in ("local-cluster[3,2,1024]", "yarn", "spark://host:7077", "k8s://host"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            runtime.shared_folder(session(master))
        assert runtime.shared_folder(session(master, spark_checkpoint_dir="hdfs://x/y")) == "hdfs://x/y"
    assert runtime.shared_folder(session("local[4]")).startswith("file:///")


def test_kept_tables_go_through_the_file_system(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_folder", lambda _: str(tmp_path / "shared"))  # no scheme: the session's default file system
    with runtime.Workspace(spark, "t") as ws:
        kept, gone = ws.put(spark.range(3), keep=True), ws.put(spark.range(2))
        assert gone.count() == 2
    assert kept.count() == 3 and len(list((tmp_path / "shared").glob("*/t*"))) == 1
    with pytest.raises(ValueError), runtime.Workspace(spark, "t") as ws:
        ws.put(spark.range(3), keep=True)
        raise ValueError
    runtime.tidy()
    assert not list((tmp_path / "shared").glob("*/t*"))

"""Stored intermediate tables: where they lie, and that they can be dropped."""

import pytest

from tallyhouse.llm import storage


class Session:
    def __init__(self, master, folder=None):
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default: folder or default)})
        self.sparkContext = type("Context", (), {"applicationId": "app-1", "master": master})


def test_a_cluster_needs_the_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            storage.shared_folder(Session(master))
        assert storage.shared_folder(Session(master, "s3a://shared/")) == "s3a://shared/tallyhouse-app-1"
    assert storage.shared_folder(Session("local[8]")).startswith("file:/")


def test_stored_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda _: f"file://{tmp_path}/run")
    kept = storage.saved(spark.range(3), "x")
    assert kept.count() == 3 and list((tmp_path / "run").iterdir())
    storage.drop_stored(spark)
    assert not (tmp_path / "run").exists()
    storage.drop_stored(spark)

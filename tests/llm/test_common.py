from types import SimpleNamespace

import pytest

from corpusloom.llm import common as C


def test_a_cluster_without_a_shared_folder_raises():
    context = SimpleNamespace(
        getConf=lambda: SimpleNamespace(get=lambda name: None), master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        C.shared_dir(SimpleNamespace(sparkContext=context))


def test_spent_tables_are_deleted(spark):
    written = C.materialize(spark.range(5), "test")
    assert written.count() == 5 and spark.sparkContext.applicationId in written.written_path
    C.release(written)
    files, path = C._path(spark, written.written_path)
    assert not files.exists(path)

import os

from groundwork.llm import scratch


def test_clear_deletes_own_tables(spark):
    a, b = (scratch.written(spark.range(3), n) for n in ("a", "b"))
    folder = a._scratch_path.removeprefix("file://")
    scratch.discard(b)
    assert a.count() == 3 and os.path.isdir(folder) and not os.path.exists(b._scratch_path.removeprefix("file://"))
    scratch.clear(spark)
    assert not os.path.exists(folder)

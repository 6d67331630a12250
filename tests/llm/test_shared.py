import pathlib
from concurrent.futures import ThreadPoolExecutor

from surgeline.llm.shared import Scratch, owned


def test_owners_in_threads_and_inside_each_other_keep_their_tables_apart(spark):
    def folder(s):
        return pathlib.Path(s.root.removeprefix("file://").removeprefix("file:"))

    def work(k):
        with owned():
            outer = Scratch(spark, f"outer{k}")
            kept = outer.table(spark.range(k + 1))
            with owned():
                inner = Scratch(spark, f"inner{k}")
                seen = inner.table(kept).count()
            assert not folder(inner).exists() and folder(outer).exists()
            assert seen == kept.count() == k + 1
        return folder(outer).exists()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(12))) == [False] * 12
    free = Scratch(spark, "free")
    assert free.table(spark.range(3)).count() == 3  # without an owner tables stay


def test_tables_go_when_the_work_fails(spark):
    try:
        with owned():
            s = Scratch(spark, "failing")
            s.table(spark.range(3))
            raise OSError
    except OSError:
        pass
    assert not pathlib.Path(s.root.removeprefix("file://").removeprefix("file:")).exists()

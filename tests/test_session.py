import os

from gleaner.session import materialize, scratch, shared_dir


def test_scratch_deletes_what_is_not_kept(spark):
    with scratch(spark, keep="stage-b-"):
        first = materialize(spark.range(5), "work")
        held = materialize(first.where("id > 1"), "stage-b")
        empty = materialize(first.where("id > 9"), "stage-b")
        gone = first.inputFiles()[0]
    assert sorted(r["id"] for r in held.collect()) == [2, 3, 4] and empty.collect() == []
    folder = os.path.dirname(gone.removeprefix("file://"))
    assert folder.startswith(shared_dir(spark)) and not os.path.exists(folder)


def test_scratch_inside_scratch(spark):
    with scratch(spark, keep="outer-"):
        with scratch(spark, keep="inner-"):
            inner = materialize(spark.range(3), "inner")
        outer = materialize(inner, "outer")
        gone = inner.inputFiles()[0]
    assert outer.count() == 3 and not os.path.exists(os.path.dirname(gone.removeprefix("file://")))

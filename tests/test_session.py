import glob

from cohortspark.session import discard, shared_folder, stored


def folders(spark, name):
    return glob.glob(f"{shared_folder(spark)}/{name}-*")


def test_a_discarded_table_leaves_no_folder(spark):
    kept, gone = (stored(spark.range(5), name) for name in ("kept-table", "gone-table"))
    assert len(folders(spark, "gone-table")) == 1
    discard(gone, None, spark.range(3), kept.where("id > 2"))
    assert folders(spark, "gone-table") == []
    assert kept.count() == 5

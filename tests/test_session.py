import os
import time

import pytest

from faultline.session import DROP_SHUFFLES, Scope, shared_dir, stage


def folders(spark, name):
    return [f for f in os.listdir(shared_dir(spark)) if f.startswith(name)]


def test_a_scope_deletes_what_it_staged(spark):
    with Scope() as scope:
        one, two = (scope.stage(spark.range(5), "scope-test") for _ in range(2))
        assert one.count() == two.count() == 5
        assert len(folders(spark, "scope-test")) == 2
        scope.drop(one)
        assert len(folders(spark, "scope-test")) == 1 and two.count() == 5
    assert not folders(spark, "scope-test")


def test_a_scope_leaves_what_it_is_told_to(spark):
    with Scope() as scope:
        kept = scope.stage(spark.range(3), "scope-kept")
        scope.stage(spark.range(3), "scope-gone")
        scope.keep(kept)
    assert kept.count() == 3 and not folders(spark, "scope-gone")


def test_a_scope_cleans_up_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), Scope() as scope:
        scope.stage(spark.range(3), "scope-error")
        raise ZeroDivisionError
    assert not folders(spark, "scope-error")


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_staging_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(DROP_SHUFFLES, None)
    table = stage(spark.range(1000).repartition(5, "id"), "staged")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.count() == 1000
    assert spark.conf.get(DROP_SHUFFLES, None) == setting

from types import SimpleNamespace

import pytest

from tidemark import session


def without_folder(master):
    return SimpleNamespace(sparkContext=SimpleNamespace(applicationId="app", master=master), conf=SimpleNamespace(get=lambda key, default=None: default))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"])
def test_a_cluster_has_to_name_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(without_folder(master), "x")


def test_one_process_may_use_its_own_folder():
    assert session.is_local(without_folder("local[4]")) and session.is_local(without_folder("local"))
    assert not session.is_local(without_folder("local-cluster[2,1,1024]"))


def test_folders_differ_and_lie_below_the_application(spark):
    a, b = session.shared_dir(spark, "x"), session.shared_dir(spark, "x")
    root = spark.conf.get("spark.checkpoint.dir")
    assert a != b and a.startswith(f"{root}/tidemark-{spark.sparkContext.applicationId}/x-")


def test_rows_are_bounded_in_number_and_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "id long, text string")
    assert len(session.bounded_rows(df, 20)) == 20 and session.bounded_rows(df, 19) is None and session.bounded_rows(df, 20, 1000) is None
    assert session.bounded_rows(df.limit(0), 5) == []
    cached = df.persist()
    session.bounded_rows(cached, 20)
    assert cached.storageLevel.useMemory
    cached.unpersist()
    assert session.broadcast_if_small(df, 5).count() == session.broadcast_if_small(df).count() == 20
    many, few = session.kept(df, 5), session.kept(df)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) == sorted(map(tuple, df.collect()))


def test_partition_folders_are_spelled_as_spark_does(spark, tmp_path):
    values = ["a/b:c=d", "12", None, "é %"]
    spark.createDataFrame([(v, 1) for v in values], "p string, n int").write.partitionBy("p").parquet(str(tmp_path / "t"))
    found = set(session.children(spark, str(tmp_path / "t"))) - {"_SUCCESS"}
    assert found == {session.partition_folder(spark, "p", v) for v in values}

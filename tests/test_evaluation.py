"""Matching of records and predictions, upload part checks, and the folder of written tables."""

import pytest

from inkwell import session
from inkwell.operators import evaluation as E
from inkwell.operators import uploads as U


def test_unmatched_sees_stages_duplicates_and_strangers(spark):
    records = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    rows = [(1, "base"), (2, "base"), (3, "base"), (1, "tuned"), (1, "tuned"), (2, "tuned"), (9, "tuned")]
    given = spark.createDataFrame(rows, "id bigint, stage string")
    got = {tuple(r) for r in E.unmatched(records, given).collect()}
    assert got == {(1, "tuned", 1, 2), (3, "tuned", 1, 0), (9, "tuned", 0, 1)}
    assert E.unmatched(records, given.where("stage = 'base'")).isEmpty()
    assert {tuple(r) for r in E.unmatched(records, given.limit(0)).collect()} == {(i, None, 1, 0) for i in (1, 2, 3)}
    assert [tuple(r) for r in E.unmatched(records, given.where("stage = 'base' AND id < 3").drop("stage")).collect()] == [(3, None, 1, 0)]
    twice = records.unionByName(records.where("id = 2"))
    assert [tuple(r) for r in E.unmatched(twice, given.where("stage = 'base'")).collect()] == [(2, "base", 2, 1)]


def test_part_checks_report_every_part(spark):
    uploads = spark.createDataFrame([("a", 25, 10, 3)], "upload_id string, file_size bigint, chunk_size bigint, total_chunks int")
    rows = [("a", 0, 10), ("a", 2, 5), ("a", 2, 10), ("a", 3, 10), ("a", -1, 10), ("b", 0, 10)]
    parts = spark.createDataFrame(rows, "upload_id string, part_index int, n_bytes bigint")
    got = sorted((r.upload_id, r.part_index, r.n_bytes, r.problem) for r in U.check_parts(parts, uploads).collect())
    assert got == [
        ("a", -1, 10, "out_of_range"), ("a", 0, 10, None), ("a", 2, 5, None), ("a", 2, 10, "size_mismatch"),
        ("a", 3, 10, "out_of_range"), ("b", 0, 10, "unknown_upload"),
    ]
    assert U.completeness(parts, uploads).first().missing == [1]


def test_a_cluster_session_must_name_its_shared_folder():
    class Session:
        class conf:  # noqa: N801
            values = {"spark.master": "spark://host:7077"}
            get = staticmethod(lambda key, default=None: Session.conf.values.get(key, default))

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session)
    Session.conf.values["spark.checkpoint.dir"] = "hdfs:///shared"
    assert session.checkpoint_root(Session) == "hdfs:///shared"

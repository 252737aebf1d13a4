from types import SimpleNamespace

import pytest

from drillbook.schemas import QUESTION_DROP, QUESTIONS
from drillbook.sources import (
    active_questions,
    publish_tables,
    read_content_drop,
    read_table,
    read_version,
    replace_table,
    shared_folder,
    write_once,
)
from tests import tables
from tests.tables import question


def test_typed_scan_fills_columns_a_file_lacks(spark, tmp_path):
    bank = tables.questions(spark, question("q1"), question("q2", enabled=False))
    path = str(tmp_path / "questions")
    bank.drop("topic").write.parquet(path)
    scan = read_table(spark, "questions", path)
    assert scan.columns == QUESTIONS.names
    assert [row.topic for row in scan.collect()] == [None, None]
    assert [row.id for row in active_questions(scan).collect()] == ["q1"]


def test_content_drop_refuses_rows_that_do_not_parse(spark, tmp_path):
    path = tmp_path / "drop"
    path.mkdir()
    good = '{"prompt": "p", "options": ["a", "b"], "correct_option": 1}\n'
    (path / "1.json").write_text(good)
    row = read_content_drop(spark, str(path), QUESTION_DROP).first()
    assert (row.options, row.correct_option, row.topic) == (["a", "b"], 1, None)
    (path / "2.json").write_text('{"prompt": "p", "options": 7}\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_content_drop(spark, str(path), QUESTION_DROP).collect()


def test_replacing_tables_and_reading_versions(spark, tmp_path):
    root = str(tmp_path / "store")
    one, two = spark.range(3), spark.range(10, 12)
    assert publish_tables(spark, root, {"a": one, "b": one}) == 1
    assert replace_table(spark, root, "a", two).count() == 2
    # The other table keeps the version it was last published in.
    assert read_version(spark, root, "b").count() == 3
    # A table may be replaced by rows computed from itself.
    grown = read_version(spark, root, "a").union(spark.range(1))
    assert replace_table(spark, root, "a", grown).count() == 3
    with pytest.raises(ValueError, match="never published"):
        read_version(spark, root, "c")


def test_an_unfinished_version_is_not_current(spark, tmp_path):
    root = str(tmp_path / "store")
    publish_tables(spark, root, {"a": spark.range(3)})
    spark.range(9).write.parquet(f"{root}/version=2/a")
    assert read_version(spark, root, "a").count() == 3
    assert publish_tables(spark, root, {"a": spark.range(4)}) == 2
    assert read_version(spark, root, "a").count() == 4


def test_a_written_table_keeps_its_rows_and_drops_its_lineage(spark):
    rows = tables.questions(spark, question("q1"), question("q2"))
    written = write_once(rows, "written")
    assert written.columns == rows.columns
    assert written.exceptAll(rows).isEmpty() and written.count() == 2
    plan = written._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "LocalTableScan" not in plan


def test_shared_folder_uses_the_cluster_setting():
    def session(master, folder):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder),
            sparkContext=SimpleNamespace(master=master),
        )

    cluster = session("yarn", "hdfs://somewhere/checkpoints/")
    path = shared_folder(cluster, "x")
    assert path.startswith("hdfs://somewhere/checkpoints/x-")
    assert path != shared_folder(cluster, "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn", None), "x")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("local[2]", None), "x")
    assert shared_folder(session("yarn", None), "x", "/given/").startswith("/given/x-")

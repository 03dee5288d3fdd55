from __future__ import annotations

import json

import pytest
from conftest import plan_of, tuples
from pyspark.sql import functions as F
from test_features import DAY, articles, behaviors, history, times

from pressroom import schemas
from pressroom.plans import features, impressions
from pressroom.session import cut_lineage
from pressroom.sources import tables


def test_split_folders(spark, tmp_path):
    for split, user in (("train", 1), ("validation", 2)):
        folder = tmp_path / split
        tables.write_table(
            behaviors(spark, [{"user_id": user, "impression_time": DAY}]).drop("split"), str(folder / "behaviors.parquet")
        )
        tables.write_table(
            history(spark, (user, split, [1, 2], times(0, 1), [1.0, None], [2.0, 3.0])).drop("split"),
            str(folder / "history.parquet"),
        )
    log = tables.read_behaviors(spark, str(tmp_path), ["train", "validation"])
    assert tuples(log, "user_id", "split") == [(1, "train"), (2, "validation")]
    lists = tables.read_history(spark, str(tmp_path), ["validation"])
    assert [f.name for f in lists.schema.fields] == [*schemas.HISTORY.fieldNames(), "split"]
    entries = tables.long_history(lists)
    assert tuples(entries, "user_id", "pos", "article_id", "read_time") == [(2, 0, 1, 1.0), (2, 1, 2, None)]


def test_load_split(spark, tmp_path):
    for split in ("train", "validation"):
        folder = tmp_path / split
        log = behaviors(spark, [{"impression_id": 1, "user_id": 1}, {"impression_id": 2, "user_id": 5}])
        tables.write_table(log.drop("split"), str(folder / "behaviors.parquet"))
        ids = [7, 8, 9] if split == "train" else None
        tables.write_table(history(spark, (1, split, ids, None, None, None)).drop("split"), str(folder / "history.parquet"))
    got = impressions.load_split(spark, str(tmp_path), ["train", "validation"], n=4)
    assert tuples(got, "split", "impression_id", "article_id_fixed") == [
        ("train", 1, [0, 7, 8, 9]), ("validation", 1, [0, 0, 0, 0])
    ]


def test_round_trip_and_pruned_scan(spark, tmp_path):
    path = str(tmp_path / "articles")
    tables.write_table(articles(spark, [(1, "text", True, "Positive", 0.5), (2, None, None, None, None)]), path)
    table = tables.read_articles(spark, path)
    out = str(tmp_path / "premium")
    tables.write_table(features.premium_articles(table), out)
    tables.write_table(features.premium_articles(table), out)  # a second run replaces the first
    assert tuples(spark.read.parquet(out)) == [(1, 1.0), (2, None)]
    assert "ReadSchema: struct<article_id:bigint,premium:boolean>" in plan_of(features.premium_articles(table))


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "vectors")
    tables.write_table(
        spark.createDataFrame([(1, [0.5, 1.0])], "article_id bigint, contrastive_vector array<float>"), path
    )
    assert tables.read_docvec(spark, path).first()["contrastive_vector"] == [0.5, 1.0]


def test_summary_partitions(spark, tmp_path):
    path = tmp_path / "summaries"
    tables.write_table(spark.createDataFrame([("0", 1), ("global", 2)], "scope string, x int"), str(path), ["scope"])
    assert sorted(p.name for p in path.iterdir() if p.is_dir()) == ["scope=0", "scope=global"]


def test_lines_and_metrics(spark, tmp_path):
    tables.write_lines(spark.createDataFrame([("1 [2,1]",), ("2 [1]",)], "value string"), str(tmp_path / "lines"))
    text = "".join(p.read_text() for p in (tmp_path / "lines").glob("part-*"))
    assert sorted(text.split("\n")) == ["", "1 [2,1]", "2 [1]"]
    tables.write_metrics(spark.createDataFrame([(0.5, 0.25)], "auc double, `ndcg@5` double"), str(tmp_path / "metrics"))
    (part,) = (tmp_path / "metrics").glob("part-*")
    assert json.loads(part.read_text()) == {"auc": 0.5, "ndcg@5": 0.25}


def test_missing_lists_do_not_lose_the_others(spark):
    lists = history(spark, (1, "train", [5, 6], None, None, [1.0, 2.0]), (2, "train", None, None, None, None))
    entries = tables.long_history(lists)
    assert tuples(entries, "user_id", "pos", "article_id", "scroll_percentage") == [
        (1, 0, 5, 1.0), (1, 1, 6, 2.0), (2, None, None, None)
    ]


def test_cut_lineage_reads_back_from_files(spark):
    table = cut_lineage(spark.range(10).select((F.col("id") * 2).alias("x")))
    assert "Scan parquet" in plan_of(table) and "Range" not in plan_of(table)
    assert table.agg(F.sum("x")).first()[0] == 90


def test_cut_lineage_needs_a_shared_folder_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cut_lineage(Frame())


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, "a" if i < 900 else "b") for i in range(1_000)], "x int, split string")
    tables.write_partitions(rows.repartition(7), path, ["split"])
    assert len(list((tmp_path / "table" / "split=b").glob("part-*"))) == 1  # one file, however many tasks had its rows
    new = spark.createDataFrame([(-1, "b")], "x int, split string")
    for _ in range(2):  # run again, as after a lost job
        tables.write_partitions(new, path, ["split"])
        assert tuples(spark.read.parquet(path).where("split = 'b'"), "x") == [(-1,)]
    assert spark.read.parquet(path).where("split = 'a'").count() == 900


def test_a_large_partition_is_split_into_files_of_one_size(spark, tmp_path):
    saved = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(0, 60_000, 1, 24).select(F.md5(F.col("id").cast("string")).alias("x"), F.when(F.col("id") < 59_900, "big").otherwise("small").alias("split"))
        tables.write_partitions(rows, str(tmp_path / "t"), ["split"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", saved)
    assert len(list((tmp_path / "t" / "split=big").glob("part-*"))) > 5
    assert len(list((tmp_path / "t" / "split=small").glob("part-*"))) == 1


@pytest.mark.parametrize("file_lines", [7, 100, 10_000])
def test_ordered_lines(spark, tmp_path, file_lines):
    rows = [(i, None if i == 5 else f"{i} [{i % 3}]") for i in range(300)]
    path = str(tmp_path / "lines")
    tables.write_ordered_lines(spark.createDataFrame(rows, "id bigint, value string").repartition(9, "value"), path, ["id"], file_lines=file_lines)
    files = sorted((tmp_path / "lines").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert text == "".join(f"{v or ''}\n" for _, v in rows) and (len(files) > 1) == (file_lines < 300)
    assert [tuple(r) for r in tables.read_ordered_lines(spark, path).orderBy("line").collect()] == [(i + 1, v or "") for i, v in rows]
    tables.write_ordered_lines(spark.createDataFrame([], "id bigint, value string"), path, ["id"])
    assert tables.read_ordered_lines(spark, path).count() == 0


def test_metrics_are_read_back(spark, tmp_path):
    metrics = spark.createDataFrame([("train", 0.1 + 0.2, None)], "split string, auc double, `ndcg@5` double")
    tables.write_metrics(metrics, str(tmp_path / "m"))
    assert tuples(tables.read_metrics(spark, str(tmp_path / "m"), "split string, auc double, `ndcg@5` double")) == [("train", 0.1 + 0.2, None)]

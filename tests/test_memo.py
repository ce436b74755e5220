"""Profiles by content and portfolios by what has changed."""

from pyspark.sql import functions as F

from estatelens.operators import memo, readiness
from estatelens.operators.memo import Memo
from estatelens.sources import commits
from estatelens.sources.estate import table

SCHEMA = "script_id long, filename string, content string"


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_equal_contents_are_scanned_once_and_known_ones_never(spark, tmp_path):
    scripts = spark.createDataFrame([(1, "a.groovy", "def x = 1"), (2, "b.groovy", "def x = 1"), (3, "b.sil", "def x = 1"), (4, "c.txt", ""), (5, "d.txt", ""), (6, "e", "ComponentAccessor.x")], SCHEMA)
    known = Memo(str(tmp_path))
    assert rows(known.verdicts(scripts)) == rows(readiness.verdicts(scripts)) and known.scanned == 4
    assert rows(known.verdicts(scripts)) == rows(readiness.verdicts(scripts)) and known.scanned == 0
    other = Memo(str(tmp_path), "other packs")
    other.verdicts(scripts)
    assert other.scanned == 4  # other rules, other profiles
    assert Memo(str(tmp_path)).verdicts(scripts.limit(0)).count() == 0


def test_a_change_of_few_scripts_costs_few_scans(spark, sf, tmp_path):
    old, new = table(spark, sf, "scripts"), table(spark, sf, "scripts_2")
    known = Memo(str(tmp_path / "memo"))
    memo.cells(known.verdicts(old)).write.parquet(str(tmp_path / "cells"))
    whole = known.scanned
    cells = memo.changed_cells(spark.read.parquet(str(tmp_path / "cells")), known, old, new)
    assert rows(memo.portfolio(cells)) == rows(readiness.portfolio(readiness.verdicts(new)))
    assert whole > 1400 and known.scanned == new.where("script_id % 100 = 0").count() == 15
    assert memo.changed_cells(cells, known, new, new).exceptAll(cells.select(*memo.CELL, *memo.SUMS)).isEmpty() and known.scanned == 0
    none = memo.changed_cells(cells, known, new, new.where("false"))
    assert none.count() == 0  # what nothing is left of goes


def test_contents_are_hashed_once_for_each_version(spark, tmp_path):
    spark.createDataFrame([(1, "a.groovy", "def x = 1"), (2, "b.groovy", "def y = 1")], SCHEMA).write.parquet(str(tmp_path / "old"))
    spark.createDataFrame([(1, "a.groovy", "def x = 1"), (2, "b.groovy", "def y = 1")], SCHEMA).write.parquet(str(tmp_path / "new"))
    old, new = (spark.read.parquet(str(tmp_path / n)) for n in ("old", "new"))
    cells = spark.createDataFrame([], "language string, module string, level string, n_scripts long, score long, consultant_hours double, assisted_hours double")
    told = memo.changed_cells(cells, Memo(str(tmp_path / "memo")), old, new)
    assert told.count() == 0 and told._jdf.queryExecution().analyzed().toString().count("sha2(") == 2


def test_a_commit_counts_once(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = lambda k: spark.range(k).select(F.col("id").alias("x"))
    assert commits.read(spark, path, "rows", "x long").count() == 0
    assert commits.append(spark, path, "run/1", {"rows": batch(3)}) and not commits.append(spark, path, "run/1", {"rows": batch(5)})
    assert commits.append(spark, path, "run/2", {"rows": batch(2)})
    # a job that died before its commit
    batch(9).select("x", F.lit("run/3").alias("commit_key"), F.lit("lost").alias("attempt")).write.mode("append").partitionBy("commit_key", "attempt").parquet(f"{path}/rows")
    told = lambda: {r.commit_key: r["count"] for r in commits.read(spark, path, "rows", "x long").groupBy("commit_key").count().collect()}
    assert told() == {"run/1": 3, "run/2": 2}
    assert commits.append(spark, path, "run/3", {"rows": batch(4)})
    assert told() == {"run/1": 3, "run/2": 2, "run/3": 4}
    before = commits.read(spark, path, "rows", "x long").count()
    both = commits.read(spark, path, "rows", "x long").unionByName(commits.read(spark, path, "rows", "x long"))
    assert both.count() == 2 * before

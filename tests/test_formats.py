"""Archives and suites as formats: partitions, chosen members, pruned columns and offsets."""

from __future__ import annotations

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.sources import formats


def archive(path, members: dict[str, str], changed: int):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    os.utime(path, (changed, changed))


@pytest.fixture
def folder(tmp_path, spark):
    formats.register(spark)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    archive(tmp_path / "in" / "a.zip", {"one.txt": "first", "d/two.md": "second", "d/": "", "__MACOSX/x.txt": "no", ".hidden.txt": "no", "pic.png": "no"}, 1000)
    archive(tmp_path / "in" / "deep" / "b.zip", {f"n{i:03}.txt": f"text {i}" for i in range(150)}, 2000)
    (tmp_path / "in" / "plain.txt").write_text("not an archive")
    return tmp_path


def test_members(spark, folder):
    df = spark.read.format("archives").load(str(folder / "in"))
    got = {(r.filename, r.appears_at, r.size, bytes(r.content).decode()) for r in df.collect()}
    want = {("one.txt", "upload://a.zip/one.txt", 5, "first"), ("d__two.md", "upload://a.zip/d/two.md", 6, "second")} | {(f"n{i:03}.txt", f"upload://b.zip/n{i:03}.txt", len(f"text {i}"), f"text {i}") for i in range(150)}
    assert got == want
    assert df.rdd.getNumPartitions() == 4  # 2 members, and 64 + 64 + 22
    assert df.select("filename").where(F.col("filename").endswith(".md")).collect() == [("d__two.md",)]
    assert df.select("size").agg(F.sum("size")).first()[0] == sum(n for _, _, n, _ in want)
    assert spark.read.format("archives").load(f"file://{folder}/in/a.zip").where("filename IN ('one.txt', 'other') AND size > 1").count() == 1


def test_chosen_members(spark, folder):
    df = spark.read.format("archives").option("members", "*.md").load(str(folder / "in"))
    assert df.rdd.getNumPartitions() == 1 and [r.filename for r in df.collect()] == ["d__two.md"]


def test_stream_takes_what_is_new(spark, folder):
    def run() -> set:
        q = spark.readStream.format("archives").load(str(folder / "in")).select("filename").writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "offsets")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.filename for r in spark.read.parquet(str(folder / "out")).collect())

    assert len(run()) == 152
    archive(folder / "in" / "c.zip", {"late.txt": "x"}, 3000)
    got = run()
    assert len(got) == 153 and "late.txt" in got
    assert run() == got


def test_suites(spark, tmp_path):
    formats.register(spark)
    cases = [{"id": 1, "question": "q", "must_any": ["a"]}, {"id": "2", "expect_decision": "Refuse", "forbid_any": ["x", "y"]}]
    (tmp_path / "s1.json").write_text(json.dumps({"suite_id": "s1", "agent_name": "A", "cases": cases}))
    (tmp_path / "s2.json").write_text(json.dumps({"suite_id": "s2", "agent_name": "A"}))
    (tmp_path / "_draft.json").write_text("{}")
    df = spark.read.format("golden_suites").load(str(tmp_path))
    assert [tuple(r) for r in df.orderBy("place").collect()] == [("s1", "A", 0, "1", "q", "answer", ["a"], [], [], None), ("s1", "A", 1, "2", None, "refuse", [], ["x", "y"], [], None)]
    assert df.rdd.getNumPartitions() == 2

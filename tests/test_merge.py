"""Merging into a stored table in buckets."""

import os

import pytest

from clausegrid.sources import merge as M
from clausegrid.sources.tables import new_edges, upsert

NODE = "label string, name string, size long, note string"


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_last_write_wins_and_other_buckets_keep_their_files(spark, tmp_path):
    folder = str(tmp_path / "nodes")
    first = spark.createDataFrame([("role", f"n{i}", i, None, 1) for i in range(200)] + [(None, "x", 1, "null label", 1)], NODE + ", seq long")
    touched = M.merge(first, folder, ["label", "name"], "seq", 32)
    table = lambda: M.stored_table(spark, folder, NODE)
    assert rows(table()) == rows(first.drop("seq")) and len(touched) == 32
    before = files(folder)
    change = spark.createDataFrame([("role", "n3", 7, "old", 4), ("role", "n3", 9, "new", 5), ("role", "n5", 1, "a", 2), ("role", "n5", 2, "b", 2), (None, "x", 2, "again", 3), ("role", "fresh", 0, None, 1)], NODE + ", seq long")
    want = rows(upsert(first.drop("seq"), change.filter("name <> 'n5' or size = 2"), ["label", "name"], "seq"))
    touched = M.merge(change, folder, ["label", "name"], "seq", 32)
    assert rows(table()) == want and len(touched) <= 4
    assert before <= files(folder)
    read = set(table().inputFiles())
    kept = [f for f in read if "v00000001" in f]
    assert len(kept) >= 28 and all(int(f.split("_bucket=")[1].split("/")[0]) not in touched for f in kept)
    assert M.merge(change.limit(0), folder, ["label", "name"], "seq", 32) == []


def test_new_edges_are_added_and_known_ones_rewrite_nothing(spark, tmp_path):
    folder, edge = str(tmp_path / "edges"), "type string, src_label string, src string, dst_label string, dst string"
    key = ["type", "src_label", "src", "dst_label", "dst"]
    first = spark.createDataFrame([("GOVERNS", "policy", f"p{i}", "process", f"q{i % 3}") for i in range(40)] * 2, edge)
    M.merge(first, folder, key, buckets=16)
    assert rows(M.stored_table(spark, folder, edge)) == rows(first.distinct())
    before = files(folder)
    assert M.merge(first, folder, key, buckets=16) == [] and files(folder) == before
    more = first.limit(5).union(spark.createDataFrame([("GOVERNS", "policy", "p99", "process", None)] * 3, edge))
    added = new_edges(more, first)
    assert len(M.merge(more, folder, key, buckets=16)) == 1
    assert rows(M.stored_table(spark, folder, edge)) == rows(first.distinct().union(added))


def test_a_broken_merge_does_not_count(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    one = spark.createDataFrame([("a", "x", 1, "first", 1)], NODE + ", seq long")
    two = spark.createDataFrame([("a", "x", 2, "second", 2), ("b", "y", 3, None, 2)], NODE + ", seq long")
    M.merge(one, folder, ["label", "name"], "seq", 4)
    real = M.PLACES
    monkeypatch.setattr(M, "PLACES", "broken")
    with pytest.raises(Exception):
        M.merge(two, folder, ["label", "name"], "seq", 4)
    monkeypatch.setattr(M, "PLACES", real)
    assert rows(M.stored_table(spark, folder, NODE)) == rows(one.drop("seq"))
    M.merge(two, folder, ["label", "name"], "seq", 4)
    assert rows(M.stored_table(spark, folder, NODE)) == rows(two.drop("seq"))

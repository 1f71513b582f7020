"""Readers and writers round-trip on files that Spark opens."""

from __future__ import annotations

import gzip
import json

import pytest

from retort.sources import files
from retort.streaming.ingest import stream_molecules

ROWS = [{"xyz": "1\n\nH 0 0 0", "energy": k} for k in range(4)]


def test_molecules_plain_and_gzipped(spark, tmp_path):
    text = "\n".join(json.dumps(r) for r in ROWS) + "\n"
    (tmp_path / "a.jsonl").write_text(text)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.jsonl").write_bytes(gzip.compress(text.encode()))
    for name in ("a.jsonl", "b.jsonl.gz", "c.jsonl"):
        out = files.read_molecules(spark, str(tmp_path / name))
        assert sorted(r["energy"] for r in out.collect()) == [0, 1, 2, 3], name
    (tmp_path / "d.jsonl").write_text('{"energy": 1}\n')
    with pytest.raises(ValueError):
        files.read_molecules(spark, str(tmp_path / "d.jsonl"))


def test_counts_frequencies_weights_hashes(spark, tmp_path):
    (tmp_path / "t.txt").write_text("4.5 6\n\n1.2_4.1 3.25\n")
    assert {(r["label"], None if r["n"] is None else int(r["n"]), r["length"]) for r in files.read_counts(spark, str(tmp_path / "t.txt")).collect()} == {("4.5", 6, None), ("1.2_4.1", None, 3.25)}
    (tmp_path / "f.csv").write_text("SF,count\nCH4,3\n")
    assert files.read_frequencies(spark, str(tmp_path / "f.csv")).collect() == [("CH4", 3)]
    (tmp_path / "w.json").write_text('{"1,6": -0.5, "6,6": 1}')
    assert {tuple(r) for r in files.read_weights(spark, str(tmp_path / "w.json")).collect()} == {(1, 6, 0.5), (6, 6, 1.0)}
    (tmp_path / "v.json").write_text('{"6,1": 1}')
    with pytest.raises(Exception, match="above"):
        files.read_weights(spark, str(tmp_path / "v.json")).collect()
    assert len(files.file_hashes(spark, str(tmp_path / "t.txt")).first()["sha256"]) == 64


def test_basis_round_trip(spark, tmp_path):
    rows = [("H", 0, 0, 12.5, 0.25), ("H", 0, 0, 1.5, 0.75), ("H", 1, 1, 0.8, 1.0), ("C", 0, 2, 3.0, 1.0)]
    frame = spark.createDataFrame(rows, "element string, shell int, l int, exp double, coef double")
    files.write_basis(frame.coalesce(1), str(tmp_path / "b"))
    assert sorted(tuple(r) for r in files.read_basis(spark, str(tmp_path / "b")).collect()) == sorted(rows)


def test_predictions_residuals_and_archives(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.0), ("b", None)], "xyz string, p double")
    files.write_predictions(frame, str(tmp_path / "p"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "p")).collect()) == ['{"xyz":"a","p":1.0}', '{"xyz":"b","p":null}']
    files.write_residuals(spark.createDataFrame([("a", 2, 0.5), ("a", 4, 0.25)], "xyz string, ntrain int, residual double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).select("xyz", "N2", "N4").collect() == [("a", 0.5, 0.25)]
    (tmp_path / "a.json").write_text(json.dumps({"spectrum": {"128": [1.0]}, "learning_curve": [{"ntrain": 128, "val_rmse": float("inf")}], "metadata": {"kernel": "Gaussian"}}))
    row = files.read_archive(spark, str(tmp_path / "a.json")).first()
    assert row["spectrum"] == {"128": [1.0]} and row["learning_curve"][0]["val_rmse"] == float("inf")


def test_generated_graphs_and_predictions(spark, tmp_path):
    (tmp_path / "run.txt").write_text("header\n>Z generated 3 -> 4 -> 17 in 0.0 sec\n")
    assert files.read_generated(spark, str(tmp_path / "run.txt")).first()["n"] == 17
    (tmp_path / "list.txt").write_text("5 4 Aa2Ab 0-1 1=2\n\n5 4 Ac 0#1\n")
    rows = {tuple(r["elements"]): [tuple(b) for b in r["bonds"]] for r in files.read_graphs(spark, str(tmp_path / "list.txt")).collect()}
    assert rows == {("Aa", "Aa", "Ab"): [(0, 1, 1), (1, 2, 2)], ("Ac",): [(0, 1, 3)]}
    records = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, old double")
    made = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, prediction double")
    with pytest.warns(UserWarning, match="replaced"):
        assert {tuple(r) for r in files.with_predictions(records, made, "k", "old").collect()} == {(1, 0.5), (2, None)}
    with pytest.raises(ValueError):
        files.with_predictions(records, made.where("k = 1"), "k", "new")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps(r) for r in ROWS))
    stream = stream_molecules(spark, str(tmp_path / "in"), "xyz string, energy long", "energy > 1", "energy * n_atoms")
    query = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["label"] for r in spark.table("arrived").collect()) == [2.0, 3.0]

"""Archives, mixed folders and the converters of published data sets."""

from __future__ import annotations

import gzip
import io
import json
import tarfile

import pytest

from retort.sources import datasets, files


def archive(path, members, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))


def test_a_folder_of_plain_and_misnamed_files(spark, tmp_path):
    lines = lambda ks: "\n".join(json.dumps({"xyz": "1\n\nH 0 0 0", "energy": k}) for k in ks) + "\n\n"
    (tmp_path / "a.jsonl").write_text(lines([1, 2]))
    (tmp_path / "b.jsonl").write_bytes(gzip.compress(lines([3]).encode()))
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(lines([4, 5]).encode()))
    (tmp_path / "_hidden").write_text("not JSON")
    (tmp_path / "empty.jsonl").write_text("")
    found = files.gzipped(spark, str(tmp_path))
    assert {k.rsplit("/", 1)[1]: v for k, v in found.items()} == {"a.jsonl": False, "b.jsonl": True, "c.jsonl.gz": True, "empty.jsonl": False}
    assert sorted(r["energy"] for r in files.read_molecules(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r["energy"] for r in files.read_molecules(spark, str(tmp_path), "xyz string, energy double").collect()) == [1, 2, 3, 4, 5]


def test_qm9(spark, tmp_path):
    def member(k):
        numbers = [f"{0.5 * (j + k)}" for j in range(15)]
        numbers[3] = "1.5*^-3"
        return f"2\ngdb {k}\t" + "\t".join(numbers) + f"\nH\t0.0\t0.0\t{k}*^-1\t0.1\nC 1 2 3 0.2\n100.0\nsmiles\n"

    archive(tmp_path / "q.tar.bz2", {f"m_{k}.xyz": member(k).replace("gdb ", f"gdb{k} ") for k in range(5)}, "w:bz2")
    (tmp_path / "no.txt").write_text("\n".join(["head"] * 9 + ["  gdb3  CH  x", "gdb4"] + ["tail", ""]))
    out = datasets.qm9_molecules(files.read_members(spark, str(tmp_path / "q.tar.bz2"), "*.xyz"), datasets.qm9_excluded(spark.read.text(str(tmp_path / "no.txt"), wholetext=True).withColumnRenamed("value", "content")))
    got = {r["id"]: r for r in out.collect()}
    assert sorted(got) == ["gdb0", "gdb1", "gdb2"]
    one = got["gdb1"]
    # columns start at the third item; the second is the running number
    assert one["xyz"] == "2\n\nH\t0.0\t0.0\t1e-1\t0.1\nC 1 2 3 0.2"
    assert (one["A"], one["alpha"], one["mu"]) == (0.5, 2.5, 0.0015) and one["totalenergy"] == 5.5
    assert one["atomisation_energy"] == pytest.approx(5.5 + 0.500273 + 37.846772) and "_" not in out.columns


def test_bsie(spark, tmp_path):
    table = lambda f: "head\n" + "\n".join(f"{k} " + " ".join(str(f * k + b) for b in range(5)) for k in (1, 2, 3)) + "\n"
    xyz = lambda k: f"2\n{json.dumps({'geometry_index': 7 * k})}\nCl 0 0 0\nC 0 0 1\n"
    archive(tmp_path / "g.tar", {"Energies/RHF/energies.txt": table(10), "Energies/B3LYP/energies.txt": table(20), "XYZ/0001.xyz": xyz(1), "XYZ/2.xyz": xyz(2), "XYZ/readme": "no"})
    read = lambda pattern: files.read_members(spark, str(tmp_path / "g.tar"), pattern)
    geometries = datasets.bsie_geometries(read("XYZ/*.xyz"))
    out = datasets.bsie_molecules(datasets.energy_columns(read("*/RHF/*"), "RHF"), datasets.energy_columns(read("*/B3LYP/*"), "B3LYP"), geometries)
    got = {r["index"]: r.asDict() for r in out.collect()}
    assert sorted(got) == [1, 2, 3] and got[3]["xyz"] is None and got[3]["RHF/STO-3G"] == 30.0
    assert got[1]["xyz"] == "2\n\nCl 0 0 0\nC 0 0 1" and got[1]["geoindex"] == 7 and got[1]["element_Cl"] == 1 and got[1]["element_C"] == 1
    assert got[2]["B3LYP/cc-pV5Z"] == 44.0
    odd = spark.createDataFrame([("XYZ/1.xyz", xyz(1).replace("Cl", "Xe"))], "member string, content string")
    with pytest.raises(Exception, match="isn't expected"):
        datasets.bsie_geometries(odd).collect()

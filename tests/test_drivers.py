"""Runs over files: what is read, written, rejected and refused in one pass."""

import json
from pathlib import Path

import pytest

from inkglass.operators import drivers
from inkglass.operators.reports import Options

CARRIER = "\n-----BEGIN C2PA MANIFEST-----\ndata:application/c2pa;base64,AAAA\n-----END C2PA MANIFEST-----\n"


@pytest.fixture
def files(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes("“one”\r\ntwo — three  \r\n".encode())
    (folder / "b.md").write_text("a wrapped\nparagraph" + CARRIER)
    (folder / "broken.txt").write_bytes(b"\xff\xfe\x00")
    (folder / "clean.txt").write_text("plain\n")
    (folder / "empty.txt").write_text("")  # Spark's reader passes it over
    return folder


def rows(folder, outcome):
    found = [json.loads(line) for part in Path(folder, f"outcome={outcome}").glob("*.json") for line in part.read_text().splitlines()]
    return {Path(r["path"]).name: r for r in found}


def test_reports_rejects_and_gate_in_one_pass(spark, files, tmp_path):
    options = Options(metrics=True, threshold=2, categories=("typography",))
    done = drivers.report_files(spark, [str(files), str(files)], str(tmp_path / "out"), options)
    assert done == drivers.Outcome(files=4, rejected=1, refused=0, done=3, over=1) and done.status() == 1
    told = rows(tmp_path / "out", "reported")
    assert set(told) == {"a.txt", "b.md", "clean.txt"} and set(rows(tmp_path / "out", "rejected")) == {"broken.txt"}
    assert told["a.txt"]["metrics"]["words"] == 3 and told["a.txt"]["over"] and not told["clean.txt"]["over"]
    fine = drivers.report_files(spark, [str(files / "clean.txt")], str(tmp_path / "fine"), options)
    assert fine.status() == 0 and drivers.Outcome(3, 0, 0, 3, 1).status(exit_zero=True) == 0


def test_cleaning_into_a_folder(spark, files, tmp_path):
    done = drivers.clean_files(spark, [str(files)], str(tmp_path / "told"), Options(metrics=True, unwrap_markdown=True), str(tmp_path / "cleaned"))
    assert done == drivers.Outcome(files=4, rejected=1, refused=1, done=2, over=0) and done.status() == 1
    cleaned = {p.name: p.read_bytes() for p in (tmp_path / "cleaned").iterdir()}
    assert set(cleaned) == {"a.clean.txt", "clean.clean.txt"}
    assert b'"one"' in cleaned["a.clean.txt"] and b"\r\n" in cleaned["a.clean.txt"] and "—".encode() not in cleaned["a.clean.txt"]
    refused = rows(tmp_path / "told", "refused")
    assert set(refused) == {"b.md"} and "provenance" in refused["b.md"]["error"] and refused["b.md"].get("written") is None
    told = rows(tmp_path / "told", "written")["a.txt"]
    assert json.loads(told["metrics"])["words"] == 3 and {f["signal"] for f in json.loads(told["findings"])} >= {"smart_quote"}


def test_cleaning_in_place_keeps_what_was_there(spark, files, tmp_path):
    before = (files / "a.txt").read_bytes()
    done = drivers.clean_files(spark, [str(files / "a.txt"), str(files / "clean.txt"), str(files / "broken.txt")], str(tmp_path / "told"), backup=True)
    assert (done.files, done.rejected, done.done) == (3, 1, 2)
    assert (files / "a.txt.tmp").read_bytes() == before and (files / "a.txt").read_bytes() == b'"one"\r\ntwo - three\r\n'
    assert not (files / "clean.txt.tmp").exists() and (files / "broken.txt").read_bytes() == b"\xff\xfe\x00"
    assert set(rows(tmp_path / "told", "unchanged")) == {"clean.txt"} and rows(tmp_path / "told", "written")["a.txt"]["backup"].endswith("a.txt.tmp")

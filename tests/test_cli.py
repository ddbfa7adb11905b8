import json
import os

import pytest

from framelake.cli import main
from framelake.operators import reports
from framelake.plans import run
from framelake.sources import files, logs, sinks


def test_config_commands(capsys, tmp_path):
    assert main(["config", "--set", "casing=upper"]) == 0 and "override" in capsys.readouterr().out
    assert main(["config", "--set", "nonsense=1"]) == 3
    assert main(["check-config", "--set", "source=/a", "--set", "destination=/d/{yeer}/{name}"]) == 3 and "did you mean {year}?" in capsys.readouterr().out
    assert main(["check-config", "--set", "source=/a", "--set", "destination=/d/{year}/{name}"]) == 0


def test_runs(spark, data, capsys, tmp_path):
    base = ["--data", data, "--set", "source=/vault", "--set", "destination=/library/{year}/{name}{ext}", "--out", str(tmp_path / "out")]
    assert main(["scan", *base]) == 0
    totals = json.loads(capsys.readouterr().out.splitlines()[0])
    assert totals["total"] == totals["valid"] > 0
    assert main(["validate", *base, "--set", "max_date=2015-01-01"]) == 4
    capsys.readouterr()
    assert main(["plan", *base]) == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["operations"] == totals["total"]
    assert main(["copy", *base]) == 0
    assert spark.read.json(str(tmp_path / "out")).where("result <> 'Planned'").count() == 0


def library(spark, tmp_path, n=12):
    """A small library on disk and its files table."""
    from datetime import datetime

    source = tmp_path / "vault"
    rows = []
    for i in range(n):
        folder = source / f"f{i % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"p{i}.jpg").write_bytes(b"x" * (i + 1))
        when = datetime(2020 + i % 2, 1, 1)
        rows.append((i, str(folder / f"p{i}.jpg"), str(folder), f"p{i}.jpg", f"p{i}", ".jpg", i + 1, when, when, when, None, datetime(2025, 1, 1)))
    plain = "file_id bigint, path string, dir string, name string, stem string, ext string, length bigint, created timestamp, modified timestamp, taken timestamp"
    text = ", ".join(f"cast(null as string) {c}" for c in ("make", "model", "album_xmp", "album_iptc", "album_xp", "description"))
    table = spark.createDataFrame(rows, plain + ", location struct<district:string,city:string,county:string,state:string,country:string,population:bigint>, seen_at timestamp")
    table = table.selectExpr("*", *text.split(", "), "cast(null as double) lat", "cast(null as double) lon", "'NoGpsData' unknown_reason", "cast(null as string) checksum")
    table.write.parquet(str(tmp_path / "data" / "files.parquet"))
    return source


@pytest.mark.parametrize("move", [False, True])
def test_copy_killed_resumed_and_rolled_back(spark, tmp_path, capsys, monkeypatch, move):
    source, out, log = library(spark, tmp_path), tmp_path / "out", str(tmp_path / "log")
    before = sorted(p.read_bytes() for p in source.rglob("*.jpg"))
    base = ["--data", str(tmp_path / "data"), "--set", f"source={source}", "--set", f"destination={out}/{{year}}/x/{{name}}{{ext}}", "--set", "dry_run=false", "--log", log, *(["--move"] if move else [])]
    monkeypatch.setattr(run, "CHUNK_FILES", 5)
    real, calls = run.carry_on, []

    def killed(spark, folder, header, progress=None):
        def stop(event):
            calls.append(event)
            if len(calls) == 1:
                raise KeyboardInterrupt

        return real(spark, folder, header, 5, stop)

    monkeypatch.setattr(run, "carry_on", killed)
    assert main(["copy", *base]) == 2 and len(list(out.rglob("*.jpg"))) == 5
    assert main(["copy", *base]) == 3 and "--resume" in capsys.readouterr().err
    assert main(["copy", *base, "--resume", "--set", "casing=upper"]) == 3
    assert main(["copy", *base, "--resume"]) == 0
    assert sorted(p.read_bytes() for p in out.rglob("*.jpg")) == before and bool(list(source.rglob("*.jpg"))) != move
    (header,) = logs.read_headers(log)
    assert header["status"] == "Completed" and header["results"] == {"Completed": 12} and calls[-1]["done"] == 12
    assert logs.read_operations(spark, log, header["id"]).count() == 12  # nothing was done twice
    keep = out / "2020" / "x" / "other.txt"
    keep.write_text("stays")
    capsys.readouterr()
    assert main(["rollback", "--log", log, "--session", header["id"]]) == 0 and len(list(out.rglob("*.jpg"))) == 12
    assert main(["rollback", "--log", log, "--session", header["id"], "--execute"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"Undone": 12}
    assert sorted(p.read_bytes() for p in source.rglob("*.jpg")) == before and not list(out.rglob("*.jpg"))
    assert keep.exists() and not (out / "2021").exists()
    assert logs.read_headers(log)[0]["status"] == "RolledBack" and run.resumable(spark, log, _settings(base))[0] is None


def _settings(base):
    from framelake.config import load_settings

    return load_settings(None, dict(x.split("=", 1) for x in base if "=" in x))[0]


def test_links_are_refused(tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "real").mkdir()
    os.symlink(tmp_path / "real", tmp_path / "linked")
    os.symlink(tmp_path / "a", tmp_path / "b")
    for source, destination in (("b", "real/x"), ("a", "linked/x"), ("a", "linked/deep/x")):
        with pytest.raises(OSError, match="symbolic link"):
            sinks.transfer(str(tmp_path / source), str(tmp_path / destination), False, str(tmp_path))
    sinks.transfer(str(tmp_path / "a"), str(tmp_path / "real" / "x"), False, str(tmp_path))
    assert not list((tmp_path / "real").glob("deep"))


def test_empty_files_are_scanned(spark, tmp_path):
    for name in ("top.jpg", "d/empty.jpg", "d/e/full.jpg", "d/e/empty.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" if "full" in name else b"")
    got = {r.name: (r.length, r.dir) for r in files.scan(spark, str(tmp_path)).collect()}
    assert {n: v[0] for n, v in got.items()} == {"top.jpg": 0, "empty.jpg": 0, "full.jpg": 1, "empty.png": 0} and got["empty.png"][1] == f"{tmp_path}/d/e"
    assert files.scan(spark, str(tmp_path), max_depth=1).count() == 1


def test_settings_of_yaml_and_json_report(capsys, tmp_path):
    (tmp_path / "s.yaml").write_text("casing: upper\nexclude: ['*.aae']\n")
    assert main(["config", "--json", "--config", str(tmp_path / "s.yaml")]) == 0
    shown = json.loads(capsys.readouterr().out)
    assert shown["casing"] == {"value": "upper", "source": str(tmp_path / "s.yaml")} and shown["exclude"]["value"] == ["*.aae"]
    (tmp_path / "bad.yaml").write_text("[1, 2]")
    assert main(["config", "--config", str(tmp_path / "bad.yaml")]) == 3


def test_unknown_report_lists_some_and_counts_the_rest(spark):
    rows = spark.createDataFrame([(i, f"n{i:03}", None, "NoGpsData", ".jpg") for i in range(7)], "file_id int, name string, location struct<city:string>, unknown_reason string, ext string")
    text = reports.unknown_text(rows, 3)
    assert "NoGpsData: 7" in text and "[NO-GPS] n002" in text and "n003" not in text and "and 4 more" in text

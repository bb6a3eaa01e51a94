"""Files that come, change and vanish."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lintlake.plans.scan import scan
from lintlake.sources.files import read_files
from lintlake.streaming.lifecycle import merge_lifecycle
from lintlake.streaming.snapshot import Snapshot
from lintlake.streaming.tracking import STATE, Tracker

NOW = "2024-01-01 00:00:00"
NAMES = [".py", ".js", "requirements.txt", ".md"]


def places(frame):
    return sorted((os.path.basename(r.file), r.line, r.rule_id, r.status) for r in frame.collect())


def test_tree_after_every_change_is_like_a_scan_of_it(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    tracker = Tracker(spark, str(tmp_path / "tables"), buckets=4, severity="INFO", now=NOW)
    steps = [
        {"a.py": "eval(x)\n# TODO: y\n", "sub/b.js": "document.write(x)", "requirements.txt": "django==1.0\n", "keep.py": "eval(k)", "e.py": "\n"},
        # Rewritten with an older time and the same length; a manifest mended; a new file.
        {"a.py": "evil(x)\n# TODO: y\n", "requirements.txt": "django==9.0\n", "new.py": "import pickle\npickle.loads(z)\n"},
        {"sub/b.js": None, "new.py": None, "a.py": "eval(x)\n# TODO: y\n"},
        {"sub/b.js": "document.write(x)"},
    ]
    past = set()
    for step, files in enumerate(steps):
        for name, text in files.items():
            if text is None:
                os.remove(tree / name)
            else:
                (tree / name).write_text(text)
                os.utime(tree / name, (time.time() - step * 1e7,) * 2)
        now = read_files(spark, str(tree), NAMES)
        tracker.sync(now)
        found = scan(now, severity="INFO", now=NOW)
        assert places(tracker.open_findings()) == places(found)
        past |= {r[:3] for r in places(found)}
        assert {r[:3] for r in places(tracker.findings())} == past
        assert {os.path.basename(r.file) for r in tracker.files().collect()} == {os.path.basename(r.file) for r in now.collect()}


def test_only_changed_files_are_scanned_and_only_their_buckets_written(spark, make_files, tmp_path):
    tracker = Tracker(spark, str(tmp_path), buckets=16, now=NOW)
    rows = [(f"{i}.py", "python", f"eval({i})") for i in range(200)]
    tracker.apply(make_files(rows), 0)
    rows[7] = ("7.py", "python", "eval(7)\neval(77)")
    assert [r.file for r in tracker._changed(make_files(rows), 1).collect()] == ["7.py"]
    tracker.apply(make_files(rows), 1)
    touched = {p.name for p in (tmp_path / "findings" / "buckets=16" / "version=1").glob("bucket=*")}
    assert len(touched) == 1
    assert tracker.findings().count() == 201
    tracker.apply(make_files(rows), 2)
    assert tracker.findings().count() == 201 and tracker.files().count() == 200


def test_history_is_that_of_merging_batch_by_batch(spark, make_files, tmp_path):
    batches = [
        [("a.py", "python", "eval(x)"), ("b.py", "python", "eval(x)\nexec(y)"), ("c.py", "python", "eval(z)")],
        [("b.py", "python", "exec(y)\neval(x)"), ("d.py", "python", "eval(z)")],
        [("a.py", "python", "x"), ("b.py", "python", "eval(x)")],
        [("a.py", "python", "eval(x)")],
    ]
    known = None
    for n, rows in enumerate(batches):
        now = f"202{n}-01-01 00:00:00"
        tracker = Tracker(spark, str(tmp_path), buckets=3, now=now)
        files = make_files(rows)
        tracker.apply(files, n)
        found = scan(files, now=now)
        merged = found if known is None else merge_lifecycle(known, found, now, files)
        known = spark.createDataFrame(merged.collect(), found.schema)
        key = lambda f: sorted((r.id, r.status, r.first_seen, r.last_seen, r.file, r.line) for r in f.collect())
        assert key(tracker.findings()) == key(known)
    assert {r.status for r in tracker.findings().collect()} == {"open", "fixed"}


def test_what_a_user_has_set_stays(spark, make_files, tmp_path):
    tracker = Tracker(spark, str(tmp_path), buckets=2, now=NOW)
    tracker.apply(make_files([("a.py", "python", "eval(x)"), ("b.py", "python", "eval(x)")]), 0)
    names = make_files([("a.py", "", "")]).select("file")
    tracker.history.update(names, lambda old: old.withColumn("status", F.when(F.col("file") == "a.py", "ignored").otherwise(F.col("status"))), 1)
    tracker.apply(make_files([("a.py", "python", "eval(x) "), ("b.py", "python", "eval(x) ")]), 2)
    assert {(r.file, r.status) for r in tracker.findings().collect()} == {("a.py", "ignored"), ("b.py", "open")}


def test_a_batch_that_failed_is_repeated_whole(spark, make_files, tmp_path, monkeypatch):
    tracker = Tracker(spark, str(tmp_path), buckets=4, now=NOW)
    tracker.apply(make_files([(f"{i}.py", "python", "eval(x)") for i in range(9)]), 0)
    second = make_files([("1.py", "python", "x"), ("9.py", "python", "eval(y)")])
    with monkeypatch.context() as broken:
        broken.setattr(tracker.state, "replace", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tracker.apply(second, 1)
    for _ in range(2):
        tracker.apply(second, 1)
        assert places(tracker.open_findings()) == sorted(
            (f"{i}.py", 1, "python-eval-usage", "open") for i in range(10) if i != 1
        )
        assert tracker.files().count() == 10


def test_half_a_version_is_not_seen(spark, tmp_path):
    table = Snapshot(spark, str(tmp_path), STATE, buckets=2)
    row = lambda *rows: spark.createDataFrame(rows, STATE)
    assert table.read().collect() == [] and table.version() == -1
    table.replace(row(("a", 1, "x"), ("b", 1, "x")), row(("a", 1, "x"), ("b", 1, "x")), 0)
    table.replace(row(("a", 2, "y")), row(("a", 2, "y")), 1)
    os.remove(tmp_path / "buckets=2" / "version=1" / "_SUCCESS")
    assert sorted(map(tuple, table.read().collect())) == [("a", 1, "x"), ("b", 1, "x")]
    table.replace(row(("a", 2, "y")), row(("a", 2, "y")), 1)
    table.replace(row(("b", 1, "x")), row(), 2)
    table.replace(row(("a", 1, "x")), row(), 3)
    assert table.read().collect() == []
    assert [tuple(r) for r in table.read(before=2).collect() if r.file == "a"] == [("a", 2, "y")]
    table.vacuum(keep=1)
    assert table.read().collect() == [] and not list((tmp_path / "buckets=2" / "version=0").glob("bucket=*"))


def test_removal_and_latest_version_in_one_batch(spark, tmp_path):
    tracker = Tracker(spark, str(tmp_path), buckets=2, now=NOW)
    rows = [("a.py", "python", "eval(1)", 1, False), ("a.py", "python", "exec(1)", 2, False), ("a.py", "python", "x", None, False),
            ("b.py", "python", "eval(1)", 1, False), ("b.py", "python", None, 0, True), (None, "python", "eval(1)", 1, False),
            ("c.py", "python", None, 1, None)]
    batch = spark.createDataFrame(rows, "file string, language string, code string, at long, removed boolean")
    tracker.apply(batch.withColumn("mtime", F.timestamp_seconds("at")), 0)
    assert places(tracker.findings()) == [("a.py", 1, "python-exec-usage", "open")]
    assert sorted(r.file for r in tracker.files().collect()) == ["a.py", "c.py"]
    shutil.rmtree(tmp_path / "findings")
    assert tracker.findings().collect() == []

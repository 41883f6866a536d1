"""Extractor programs that loop, grow, crash, chatter or lie fail their own file only."""

import sys

import pytest

from spanloom.operators.guarded import Limits, guarded

PROGRAM = r"""
import json, os, sys, time
kept = 0
for line in sys.stdin:
    q = json.loads(line)
    rows, kept = [["word", w, "", 0, len(w.encode())] for w in q["text"].split()], kept + 1
    what = q["path"].split("-")[0]
    if what == "loop":
        while True: pass
    if what == "sleeping_child" and not os.fork():
        time.sleep(1000)
    if what == "grow":
        held = b"x" * (3 << 30)
    if what == "crash":
        os._exit(3)
    if what == "chatter":
        print("x" * 100_000)
    if what == "endless":
        while True: sys.stdout.write("y" * 4096)
    if what == "lie":
        rows.append(["word", "w", "", 0, 10_000])
    if what == "shape":
        rows.append(["word", 1, "", 0, 0])
    if what == "short":
        rows.append(["word"])
    if what == "other":
        q["id"] += 1
    if what == "nojson":
        print("no", flush=True)
        continue
    if what == "used" and kept > 1:
        os._exit(1)
    if what == "environment":
        rows = [["variable", k, "", 0, 0] for k in os.environ]
    print(json.dumps({"id": q["id"], "rows": rows}), flush=True)
"""
COMMAND = [sys.executable, "-c", PROGRAM]


def told(spark, files, limits=Limits(seconds=3, output=50_000), command=COMMAND):  # noqa: B008
    frame = spark.createDataFrame(files, "path string, text string").coalesce(1)  # one child serves all
    return [(r.path, r.kind, r.name, r.error) for r in guarded(frame, command, limits).collect()]


def test_each_failure_stays_with_its_file(spark):
    bad = {"loop": "time", "grow": "ended", "crash": "ended", "chatter": "output", "endless": "output", "lie": "rows", "shape": "rows", "short": "rows", "other": "answer", "nojson": "answer"}
    files = [f for b in bad for f in ((f"{b}-x", "a b"), (f"good-{b}", "c"))]
    rows = told(spark, files)
    assert {r[0].split("-")[0]: r[3] for r in rows if r[3]} == bad
    assert [r for r in rows if not r[3]] == [(f"good-{b}", "word", "c", None) for b in bad]
    assert len(rows) == 2 * len(bad)  # of a failed file no row but its failure


def test_a_file_that_fails_in_a_used_child_is_tried_in_a_fresh_one(spark):
    assert told(spark, [("good-1", "a"), ("used-1", "b"), ("used-2", "c")]) == [("good-1", "word", "a", None), ("used-1", "word", "b", None), ("used-2", "word", "c", None)]


def test_odd_files(spark):
    long = "wörter " * 500_000  # both pipes fill up
    rows = told(spark, [("n", None), ("e", ""), ("l", long), (None, "x")], Limits(seconds=30, output=200 << 20))
    assert len([r for r in rows if r[0] == "l"]) == 500_000
    assert [r for r in rows if r[0] != "l"] == [(None, "failed", "", "ended")]  # this program takes no null path


def test_the_child_sees_no_environment_of_the_executor(spark):
    names = {r[2] for r in told(spark, [("environment-1", "")])}
    assert names <= {"PATH", "PYTHONPATH", "LANG", "LC_CTYPE", "PWD"}


@pytest.mark.parametrize("command", [["/nonexistent-program"], [sys.executable, "-c", "pass"]])
def test_a_program_that_does_not_run(spark, command):
    assert told(spark, [("a", "x"), ("b", "y")], command=command) == [("a", "failed", "", "ended"), ("b", "failed", "", "ended")]


def test_no_files(spark):
    assert told(spark, []) == []

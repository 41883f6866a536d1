"""Extractor programs in child processes of their own, with bounds on memory, time and output: all rows of a file or none.

A program reads requests, one JSON object a line (``id, path, text``), and answers each by one line (``id, rows``; a row is
``kind, name, detail, byte_start, byte_end``).  One child serves the files of a task one after another.  A file that fails in a
child that has served others is tried again in a fresh one, so what becomes of it depends on the file alone.
"""

from __future__ import annotations

import json
import os
import selectors
import signal
import subprocess
import sys
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, name string, detail string, byte_start long, byte_end long, error string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Sets the bounds in the child, then becomes the program.
_BOUNDED = "import os, resource, sys; m = int(sys.argv[1]); resource.setrlimit(resource.RLIMIT_AS, (m, m)); resource.setrlimit(resource.RLIMIT_CORE, (0, 0)); os.execvp(sys.argv[2], sys.argv[2:])"


@dataclass(frozen=True)
class Limits:
    """Address space of the child; wall time and bytes of answer for each file."""

    memory: int = 1 << 30
    seconds: float = 5.0
    output: int = 16 << 20


class Failed(Exception):
    """A file's answer cannot be used; the child is not to be used either."""


class _Child:
    def __init__(self, command: Sequence[str], limits: Limits):
        self.limits = limits
        # nothing of the executor's environment but where programs and modules lie
        env = {"PATH": os.environ.get("PATH", os.defpath), "PYTHONPATH": os.pathsep.join(p for p in sys.path if p), "LANG": "C.UTF-8"}
        self.process = subprocess.Popen(
            [sys.executable, "-c", _BOUNDED, str(limits.memory), *command],
            stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, env=env, start_new_session=True,
        )
        os.set_blocking(self.process.stdin.fileno(), False)
        os.set_blocking(self.process.stdout.fileno(), False)

    def end(self) -> None:
        """End the child and whatever it has started."""
        try:
            os.killpg(self.process.pid, signal.SIGKILL)
        except ProcessLookupError:
            pass
        self.process.wait()
        self.process.stdin.close()
        self.process.stdout.close()

    def ask(self, request: bytes) -> bytes:
        """The answer's line.  Request and answer are moved as the pipes take them, so neither side waits for the other."""
        left, got = memoryview(request), bytearray()
        until = time.monotonic() + self.limits.seconds
        source, sink = self.process.stdout, self.process.stdin
        with selectors.DefaultSelector() as ready:
            ready.register(source, selectors.EVENT_READ)
            ready.register(sink, selectors.EVENT_WRITE)
            while True:
                events = ready.select(max(0.0, until - time.monotonic()))
                if time.monotonic() >= until:
                    raise Failed("time")
                for key, _ in events:
                    if key.fileobj is sink:
                        try:
                            left = left[os.write(sink.fileno(), left[: 1 << 16]) :]
                        except BrokenPipeError:
                            raise Failed("ended") from None
                        if not left:
                            ready.unregister(sink)
                        continue
                    more = os.read(source.fileno(), 1 << 16)
                    if not more:
                        raise Failed("ended")
                    got += more
                    if len(got) > self.limits.output:
                        raise Failed("output")
                    line, closed, rest = got.partition(b"\n")
                    if closed:
                        if rest or left:
                            raise Failed("answer")
                        return bytes(line)


def _rows(line: bytes, number: int, size: int) -> list[tuple]:
    """The rows of an answer; one that is not wholly right has none."""
    try:
        answer = json.loads(line)
        told = [tuple(r) for r in answer["rows"]] if answer["id"] == number else None
    except (ValueError, TypeError, KeyError, RecursionError):
        told = None
    if told is None:
        raise Failed("answer")
    for r in told:
        texts, places = r[:3], r[3:]
        if len(r) != 5 or not all(isinstance(t, str) for t in texts) or not all(type(p) is int for p in places) or not 0 <= places[0] <= places[1] <= size:
            raise Failed("rows")
    return told


def guarded(files: DataFrame, command: Sequence[str], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """SCHEMA of all files (``path, text``; a null text is the empty one, a null path is told as null), each read by the program `command`.

    Without error its rows; else one row of kind ``failed`` and the ``error``: ``time``, ``output``, ``ended`` (crashed, or
    out of memory), ``answer`` (not one line of JSON for this request) or ``rows`` (a row of another shape, or outside the text).
    """
    command = list(command)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        child, number = None, 0
        try:
            for frame in frames:
                out = []
                for path, text in zip(frame["path"], frame["text"], strict=True):
                    text = text or ""
                    while True:
                        fresh = child is None
                        child = child or _Child(command, limits)
                        number += 1
                        request = json.dumps({"id": number, "path": path, "text": text}).encode() + b"\n"
                        try:
                            out += [(path, *r, None) for r in _rows(child.ask(request), number, len(text.encode()))]
                            break
                        except Failed as e:
                            child.end()
                            child = None
                            if fresh:
                                out.append((path, "failed", "", "", None, None, e.args[0]))
                                break
                yield pd.DataFrame(out, columns=COLUMNS).astype({"byte_start": "Int64", "byte_end": "Int64"})
        finally:
            if child:
                child.end()

    return files.select("path", "text").mapInPandas(run, SCHEMA)

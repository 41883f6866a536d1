"""Extractor plugins, model providers and the guards around them."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.exprs import REDACTIONS, redacted

#: Limits of a broker task, and the edge labels that an answer may propose.
MAX_SPANS, MAX_SPAN_BYTES, MAX_BYTES, MAX_CANDIDATES = 12, 8 << 10, 48 << 10, 20
DECISION_LABELS = ("CALLS", "PUBLISHES", "SUBSCRIBES", "FETCHES", "REFERENCES", "BACKS", "DECIDES", "GOVERNS", "MAPS_TO")
SECRET_SHAPE = re.compile(r"[A-Za-z0-9+/_=.-]+")


def pinned(facts: DataFrame, plugin: str, artifact: bytes) -> DataFrame:
    """Facts with the host's own statement of who made them, whatever the plugin said; missing provenance is filled in."""
    digest = hashlib.sha256(artifact).hexdigest()
    made = facts.withColumns({"extractor": F.lit(f"{plugin}@{digest[:12]}"), "artifact_hash": F.lit(digest)})
    for name, value in (("tier", "Deterministic"), ("conf", "Confirmed")):
        made = made.withColumn(name, F.coalesce(F.col(name) if name in facts.columns else F.lit(None), F.lit(value)))
    return made


@dataclass
class Gate:
    """Outcome of a conformance run."""

    passed: bool
    failures: list[str] = field(default_factory=list)


def conformance(extract: Callable[[str, str], Iterable[tuple]], corpus: list[dict]) -> Gate:
    """Every case (``path, source, rows``) must give exactly its golden rows, twice; an empty corpus fails."""
    bad = [] if corpus else ["empty corpus"]
    for case in corpus:
        try:
            first, second = (sorted(map(tuple, extract(case["path"], case["source"]))) for _ in range(2))
        except Exception as e:  # noqa: BLE001  a plugin may fail in any way
            bad.append(f"{case['path']}: {type(e).__name__}")
            continue
        if first != second:
            bad.append(f"{case['path']}: not deterministic")
        elif first != sorted(map(tuple, case["rows"])):
            bad.append(f"{case['path']}: differs from golden rows")
    return Gate(not bad, bad)


def redact_text(text: str) -> tuple[str, int]:
    hits = 0
    for pattern, by in REDACTIONS:
        text, n = re.subn(pattern, re.sub(r"\$(\d)", r"\\\1", by), text)
        hits += n
    return text, hits


def without_secrets(value):
    """Settings (parsed JSON) without strings that look like secrets; lists and objects lose such members."""
    gone = object()

    def kept(x):
        if isinstance(x, str):
            return gone if len(x.encode()) >= 40 and SECRET_SHAPE.fullmatch(x) else x
        if isinstance(x, list):
            return [y for y in map(kept, x) if y is not gone]
        if isinstance(x, dict):
            return {k: y for k, y in ((k, kept(v)) for k, v in x.items()) if y is not gone}
        return x

    out = kept(value)
    return None if out is gone else out


def settings_without_secrets(column: str):
    """JSON text of settings without secret-shaped strings, members in their order; null where nothing is left or nothing parses."""
    @pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                left = without_secrets(json.loads(text))
            except (TypeError, ValueError):
                return None
            return None if left is None else json.dumps(left, separators=(",", ":"), ensure_ascii=False)

        return texts.map(one, na_action="ignore")

    return clean(column)


class Refused(Exception):
    """The firewall let nothing out."""


class ProviderRefusal(Exception):
    """The provider declined to answer; asking again does not help."""


def completion_text(answer: dict) -> str:
    """The text of a completion (``text, stop_reason``); a refusal is an error of its own kind, and so is an empty text."""
    if answer.get("stop_reason") == "refusal":
        raise ProviderRefusal(answer.get("text") or "refused")
    text = (answer.get("text") or "").strip()
    if not text:
        raise ValueError("empty completion")
    return text


def loopback(url: Column) -> Column:
    """True for URLs of this very machine: the only ones that a local provider may have."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^@/]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    return (host == "localhost") | host.rlike(r"^127(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$") | (host == "[::1]")


def egress(payload: str, provider: str, policies: set[str], consents: dict[str, str]) -> tuple[str, str]:
    """The redacted payload and its hash, if policy allows the provider and, for the cloud, consent names this very payload."""
    if provider not in policies:
        raise Refused(f"no policy for {provider}")
    text, _ = redact_text(payload)
    digest = hashlib.sha256(text.encode()).hexdigest()
    if provider == "cloud" and consents.get(provider) != digest:
        raise Refused("consent does not match the payload")
    return text, digest


def first_json_object(text: str) -> str | None:
    """The first balanced object in a text, braces inside strings not counted."""
    start = text.find("{")
    while start >= 0:
        depth, inside, i = 0, False, start
        while i < len(text):
            c = text[i]
            if inside:
                i += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            elif c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : i + 1]
            i += 1
        start = text.find("{", start + 1)
    return None


def json_object_in(text):
    """The first balanced JSON object in each text, null where there is none."""
    @pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(first_json_object, na_action="ignore")

    return found(text)


def structured(complete: Callable[[str], str], prompt: str, required: set[str], tries: int = 3) -> dict:
    """An answer with the required keys; a bad one is asked for again, with the reason."""
    reason = ""
    for _ in range(tries):
        text = first_json_object(complete(prompt + reason) or "")
        try:
            answer = json.loads(text or "")
            if required <= set(answer):
                return answer
            reason = f"\nMissing: {sorted(required - set(answer))}"
        except ValueError as e:
            reason = f"\nNot JSON: {e}"
    raise ValueError("no valid answer" + reason)


def valid_task(task: dict) -> list[str]:
    """What is wrong with a task (``spans, candidates``); an empty list lets it pass."""
    spans, candidates = task.get("spans", []), task.get("candidates", [])
    sizes = [len(s.encode()) for s in spans]
    bad = []
    if not spans or not candidates:
        bad.append("no evidence or no candidate")
    if len(spans) > MAX_SPANS or len(candidates) > MAX_CANDIDATES:
        bad.append("too many spans or candidates")
    if any(n > MAX_SPAN_BYTES for n in sizes) or sum(sizes) > MAX_BYTES:
        bad.append("too many bytes")
    if len(set(candidates)) < len(candidates):
        bad.append("candidates repeat")
    return bad


def valid_answer(task: dict, answer: dict) -> list[str]:
    """What is wrong with an answer (``target, label, citations``): it may name only what the task offered."""
    bad = []
    if answer.get("target") not in task["candidates"]:
        bad.append("invented target")
    if answer.get("label") not in DECISION_LABELS:
        bad.append("unknown label")
    cited = answer.get("citations", [])
    if not cited or not set(cited) <= set(range(len(task["spans"]))) or len(set(cited)) < len(cited):
        bad.append("citations outside the evidence")
    return bad


def batch(tasks: Iterable[dict], run: Callable[[dict], dict], cancelled: Callable[[], bool] = lambda: False) -> list[dict]:
    """One result per task: its answer or its error; nothing more is run once cancelled."""
    out = []
    for task in tasks:
        if cancelled():
            out.append({"ok": False, "error": "cancelled"})
            continue
        try:
            answer = run(task)
            wrong = valid_answer(task, answer)
            out.append({"ok": not wrong, "answer": answer, "error": "; ".join(wrong)})
        except Exception as e:  # noqa: BLE001  a provider may fail in any way
            out.append({"ok": False, "error": str(e)})
    return out


def valid_vectors(vectors: list[list[float]], count: int) -> bool:
    """As many vectors as texts, all finite and of one length."""
    import math

    return len(vectors) == count and len({len(v) for v in vectors}) <= 1 and all(math.isfinite(x) for v in vectors for x in v)


def hashed_embedding(column: str, size: int = 64):
    """A deterministic embedding for tests: signed counts of hashed words, without a model."""
    words = F.filter(F.split(F.lower(column), r"\W+"), lambda w: w != "")
    zero = F.array_repeat(F.lit(0.0), size)
    slot = lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")
    return F.aggregate(words, zero, lambda a, w: F.transform(a, lambda x, i: F.when(i == slot(w), x + 1).otherwise(x)))


def valid_vector(column: Column, size: int) -> Column:
    """True for a vector of this length whose numbers are all finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(column) == size) & F.forall(column, finite), F.lit(False))


def gated_plugins(plugins: DataFrame, load: Callable[[dict], tuple]) -> DataFrame:
    """``plugin, passed, failures``: a conformance run for each row; `load` gives its extractor and golden corpus."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gates = [conformance(*load(row)) for row in frame.to_dict("records")]
            yield pd.DataFrame({"plugin": frame["plugin"], "passed": [g.passed for g in gates], "failures": [g.failures for g in gates]})

    return plugins.mapInPandas(run, "plugin string, passed boolean, failures array<string>")


def verdicts(tasks: DataFrame) -> DataFrame:
    """Tasks with answers (``spans, candidates, target, label, citations``) and a ``verdict``: the first thing that is wrong with
    the task or the answer, null if nothing is.  Column expressions only."""
    sizes = F.transform("spans", lambda x: F.octet_length(x))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    cited = F.col("citations")
    wrong = (
        F.when((F.size("spans") <= 0) | (F.size("candidates") <= 0), "no evidence or no candidate")
        .when((F.size("spans") > MAX_SPANS) | (F.size("candidates") > MAX_CANDIDATES), "too many spans or candidates")
        .when(F.exists(sizes, lambda n: n > MAX_SPAN_BYTES) | (total > MAX_BYTES), "too many bytes")
        .when(F.size(F.array_distinct("candidates")) < F.size("candidates"), "candidates repeat")
        .when(~F.array_contains("candidates", F.col("target")), "invented target")
        .when(~F.col("label").isin(*DECISION_LABELS), "unknown label")
        .when((F.size(cited) <= 0) | F.exists(cited, lambda i: (i < 0) | (i >= F.size("spans"))) | (F.size(F.array_distinct(cited)) < F.size(cited)), "citations outside the evidence")
    )
    return tasks.withColumn("verdict", wrong)


def released(payloads: DataFrame, policies: list[str]) -> DataFrame:
    """Payloads (``payload, provider, consent``) as they may leave: ``text`` redacted, its ``digest``, and ``refused`` with the
    reason, in which case there is no text.  The cloud needs consent to this very digest."""
    text, _ = redacted(F.col("payload"))
    out = payloads.withColumn("_text", text).withColumn("digest", F.sha2("_text", 256))
    refused = F.when(~F.col("provider").isin(*policies), "no policy").when((F.col("provider") == "cloud") & ~F.col("consent").eqNullSafe(F.col("digest")), "consent does not match the payload")
    return out.withColumn("refused", refused).withColumn("text", F.when(F.col("refused").isNull(), F.col("_text"))).drop("_text")


def answered(tasks: DataFrame, complete: Callable[[str], str], required: set[str], tries: int = 3) -> DataFrame:
    """``task, answer`` (JSON), ``error``: each prompt answered where it lies; a failure is a row, not the end of the batch.

    Cancelling the Spark job group that runs it cancels what is left.
    """
    kind = dict(tasks.dtypes)["task"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for task, prompt in zip(frame["task"], frame["prompt"], strict=True):
                try:
                    rows.append((task, json.dumps(structured(complete, prompt, required, tries), sort_keys=True), None))
                except Exception as e:  # noqa: BLE001  a provider may fail in any way
                    rows.append((task, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["task", "answer", "error"])

    return tasks.select("task", "prompt").mapInPandas(run, f"task {kind}, answer string, error string")

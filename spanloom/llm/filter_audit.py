"""What filters of documents do to each other, in every order (operator 11).

Five filters, each a bit of a document's pattern of failures: A, under 200 words; B, fewer than half of its words are
different; C, over 3 % capitals A-Z; D, one of ``#$%&*|``; E, the text of a smaller doc_id anywhere in the table.

Method: first-failure lookup.  A table of 32 patterns by 120 orders holds the step at which a document with that pattern is
removed.  Tasks over Arrow batches look up all orders of their documents at once, count removals by part, order, step and
label with one bincount, and hand on the counts of their parts; all counts are sums over documents, so adding them up is one
aggregation.

E comes first, without bringing copies together: the smallest doc_id of each digest of a text is an aggregate that
adds up before it shuffles, and a document fails unless its own id is that one, which is a join on digest and id.  Equal
rows are counted together before, so neither a text nor a row with very many copies is a hot key.

Defined results: a null text is the empty text, a null lang the part ''.  Rows with one doc_id are documents of their own, and
none is a copy of another with that id; a document without an id is no copy and has none, and has no label.  Of several labels
of a document each counts that says 1.  An empty table gives no rows.  Other columns do not take part.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import giving_back
from .workspace import dropped, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
STEPS = len(FILTERS)
#: Documents that are looked up together; a task hands on its counts when it has seen so many parts.
TOGETHER, PARTS = 1000, 256
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_symbol = re.compile(rb"[#$%&*|]").search


def first_failures() -> np.ndarray:
    """For each pattern of failures and each order the step (from 0) that removes the document; STEPS if none does."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, dtype=np.int64)
    patterns = np.arange(1 << STEPS)
    for number, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            table[(patterns >> FILTERS.index(order[step])) & 1 == 1, number] = step
    return table


def text_failures(text: str) -> int:
    """The bits of filters A to D."""
    raw = text.encode()
    words = raw.split()  # at the six white-space characters of ASCII
    few = len(words) < 200
    same = 100 * len(set(words)) < 50 * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 3 * len(text)
    return few | same << 1 | loud << 2 | (_symbol(raw) is not None) << 3


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fails, digests = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            fails.append(text_failures(text))
            digests.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])


def _rows(part: str, removed: np.ndarray, patterns: np.ndarray) -> pa.RecordBatch:
    """The counts of one part: `removed` by order, step and label (good 1, toxic 2), `patterns` by pattern of failures."""
    bits = np.arange(1 << STEPS)
    letter = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    fails = np.array([patterns[bits >> k & 1 == 1].sum() for k in range(STEPS)])
    alone = np.array([patterns[1 << k] for k in range(STEPS)])
    here = removed[:, :STEPS].sum(2)
    counts = {
        "kept": patterns.sum() - np.cumsum(here, axis=1),
        "removed": here,
        "redundant": fails[letter] - here,
        "unique_fails": alone[letter],
        "good_lost": removed[:, :STEPS, 1] + removed[:, :STEPS, 3],
        "toxic_lost": removed[:, :STEPS, 2] + removed[:, :STEPS, 3],
        "shapley": np.bincount(letter.ravel(), weights=here.ravel(), minlength=STEPS).astype(np.int64)[letter],
    }
    orders, steps = np.repeat(ORDERS, STEPS), np.tile(np.arange(1, STEPS + 1), len(ORDERS))
    arrays = [pa.array([part] * len(orders), pa.string()), pa.array(orders, pa.string()), pa.array(steps, pa.int32()), *[pa.array(counts[c].ravel(), pa.int64()) for c in COUNTS]]
    return pa.RecordBatch.from_arrays(arrays, ["part", "filter_order", "step", *COUNTS])


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = first_failures() * 4
    per_part = len(ORDERS) * (STEPS + 1) * 4
    table += np.arange(len(ORDERS)) * (STEPS + 1) * 4  # where an order's counts begin
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for part, (removed, patterns) in held.items():
            yield _rows(part, removed.reshape(len(ORDERS), STEPS + 1, 4), patterns)
        held.clear()

    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            some = batch.slice(at, TOGETHER)
            parts = some.column("part").dictionary_encode()
            number, names = parts.indices.to_numpy().astype(np.int64), parts.dictionary.to_pylist()
            pattern, label, n = (some.column(c).to_numpy() for c in ("pattern", "label", "n"))
            keys = (number * per_part + label)[:, None] + table[pattern]
            removed = np.bincount(keys.ravel(), weights=np.repeat(n, len(ORDERS)), minlength=len(names) * per_part).astype(np.int64).reshape(len(names), per_part)
            patterns = np.bincount(number * (1 << STEPS) + pattern, weights=n, minlength=len(names) << STEPS).astype(np.int64).reshape(len(names), 1 << STEPS)
            for k, part in enumerate(names):
                before = held.get(part)
                held[part] = (removed[k], patterns[k]) if before is None else (before[0] + removed[k], before[1] + patterns[k])
            if len(held) > PARTS:
                yield from handed_on()
    yield from handed_on()


def failures(documents: DataFrame) -> DataFrame:
    """``doc_id, part, fails, digest`` of every row: bits of filters A to D, and the text's SHA-256."""
    docs = documents.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text")
    return docs.mapInArrow(giving_back(_checked), f"doc_id {dict(docs.dtypes)['doc_id']}, part string, fails int, digest binary")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` with the COUNTS of documents: 600 rows for every part."""
    facts = written(failures(documents), "facts")
    rows = facts.groupBy("doc_id", "digest", "part", "fails").agg(F.count(F.lit(1)).alias("n"))
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 2, 0)")).alias("toxic"))
    # firsts and labels grow with the documents: shuffled at every size
    judged = rows.join(first.hint("merge"), ["digest", "doc_id"], "left").join(rated.hint("merge"), "doc_id", "left")
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = judged.select("part", (F.col("fails") + copy).alias("pattern"), F.coalesce(F.col("good") + F.col("toxic"), F.lit(0)).alias("label"), "n")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    parts = judged.mapInArrow(giving_back(_tallied), f"part string, filter_order string, step int, {counts}")
    result = written(parts.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS]), "audit")
    dropped(facts)
    return result

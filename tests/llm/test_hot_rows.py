"""One id, row or slice with very many rows, ids of any characters, and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import backoff_lm, crf_language, jaccard_join, quality, quality_rules, warc, workspace

DOCS = "doc_id long, text string, lang string"


def test_one_id_repeated_gives_one_training_row(spark):
    hot = spark.range(10_000).selectExpr("cast(3 as long) as doc_id", "concat('word ', id) as text", "if(id % 2 = 0, 'en', 'de') as lang")
    rest = spark.createDataFrame([(k, f"text {k}", "fr") for k in range(40, 80)] + [(90, None, "fr"), (91, "x", None), (None, "x", "fr")], DOCS)
    docs = hot.unionByName(rest)
    rows = crf_language.sampled(docs).collect()
    kept = {int(r.text.split()[1]) for r in rows if r.lang == "fr"}
    assert len(rows) <= 41 and len(kept) == len(rows) - sum(r.lang != "fr" for r in rows)
    assert [r.lang for r in rows if r.lang != "fr"] in ([], ["de"])  # none if crc32 holds the id out
    assert crf_language.sampled(docs, 5).count() == 5
    chosen = spark.createDataFrame([(3, 1), (40, 2), (41, 0), (90, 2)], "doc_id long, grade int")
    picked = sorted((r.grade, r.text) for r in quality.one_text_each(docs, chosen).collect())
    assert [g for g, _ in picked] == [0, 1, 2]
    again = sorted((r.grade, r.text) for r in quality.one_text_each(docs.repartition(7), chosen).collect())
    assert picked == again


def test_tables_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(workspace, "FAN", 3)
    rows = [(k % 2, np.array([k, 1], dtype="<i8").tobytes()) for k in range(100)]
    parts = spark.createDataFrame(rows, "slice int, counts binary").repartition(9)
    parts = workspace.written(parts)
    sizes = spark.sparkContext.accumulator(0)

    def add(key, table):
        sizes.add(1)
        return quality_rules._added(key, table)

    got = {r["slice"]: np.frombuffer(r["counts"], dtype="<i8").tolist() for r in workspace.added_up(parts, add, "slice int, counts binary").collect()}
    assert got == {0: [sum(range(0, 100, 2)), 50], 1: [sum(range(1, 100, 2)), 50]}
    assert sizes.value > 2 + 2 * 6  # more than one level


def test_join_and_rules_with_many_partial_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k // 2) * 60 + i}" for i in range(60)), "en") for k in range(40)], DOCS).repartition(12)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int")
    one = [sorted(map(tuple, f().collect())) for f in (lambda: jaccard_join.jaccard_classes(docs), lambda: quality_rules.quality_rules(docs, labels))]
    monkeypatch.setattr(workspace, "FAN", 2)
    assert one == [sorted(map(tuple, f().collect())) for f in (lambda: jaccard_join.jaccard_classes(docs), lambda: quality_rules.quality_rules(docs, labels))]
    assert {r[2] for r in one[0]} == set(range(0, 40, 2))


def test_copies_of_a_row_are_dealt_to_all_chunks(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "CHUNK_BYTES", 20_000)
    largest = spark.sparkContext.accumulator(0)
    inner = backoff_lm._chunk_counts

    def watched(order, buckets):
        count = inner(order, buckets)

        def run(key, table):
            if table.num_rows > 4_000:
                largest.add(1)
            return count(key, table)

        return run

    monkeypatch.setattr(backoff_lm, "_chunk_counts", watched)
    docs = spark.range(0, 20_000, 1, 8).selectExpr("cast(1 as long) as doc_id", "'a b a c d' as text")
    rows = backoff_lm.backoff_scores(docs).groupBy("doc_id", "n_words", F.round("score", 9).alias("score")).count().collect()
    assert len(rows) == 1 and rows[0]["count"] == 20_000 and largest.value == 0


@pytest.mark.parametrize("kind", ["string", "long"])
def test_warc_ids_of_any_characters(spark, kind):
    names = ["a\r\nX: y", "%0A:>", "", "=b", "ü \U0001f600", "urn:page:<1>", "0", None] if kind == "string" else [1, -2, 0, None]
    rows = [(n, "u", f"page {k} " + "z" * 200) for k, n in enumerate(names)] + [(names[0], "u", "same " * 50), (names[1], "u", "same " * 50), (names[1], "v", "same " * 50)]
    pages = spark.createDataFrame(rows, f"page_id {kind}, url string, html string")
    got = warc.warc_round_trip(pages).collect()
    assert sorted((str(r.page_id), r.payload_bytes) for r in got) == sorted((str(n), len(h.encode())) for n, _, h in rows)
    first = min(names[0], names[1])
    same = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == 250)
    other = [("response", None)] if first == names[0] else [("response", None), ("response", None)]  # rows that repeat the smallest id are all responses
    assert [x[1:] for x in same if x[0] == str(first)] == other and all(x[1:] == ("revisit", first) for x in same if x[0] != str(first))

"""Facts kept between runs: what is parsed, reused and dropped, and that the facts are those of a full read."""

from spanloom.sources import extractors, fact_cache


def table(spark, tree):
    return spark.createDataFrame([("r", p, t) for p, t in tree.items()], "repo string, path string, text string")


def test_only_changes_are_parsed(spark, tmp_path, monkeypatch):
    cache = fact_cache.FactCache(spark, f"file://{tmp_path}/facts", buckets=4)
    read = []
    real = fact_cache.facts
    monkeypatch.setattr(fact_cache, "facts", lambda files: (read.append(sorted(r.path for r in files.select("path").collect())), real(files))[1])
    same = lambda tree: sorted(map(tuple, cache.read().collect()), key=str) == sorted(map(tuple, extractors.facts(table(spark, tree)).collect()), key=str)
    assert cache.read().count() == 0
    tree = {f"a{k}.py": f"def f{k}(): g()\n" for k in range(12)} | {"b.txt": "no facts", "c.ts": None}
    assert cache.refresh(table(spark, tree)) == {"parsed": 14, "reused": 0, "dropped": 0} and len(read) == 1
    tree["c.ts"] = ""  # null is the empty text
    assert same(tree)
    assert cache.refresh(table(spark, tree)) == {"parsed": 0, "reused": 14, "dropped": 0} and len(read) == 1
    tree["a1.py"] = "def other(): pass\n"
    del tree["a2.py"]
    tree["d.go"] = "package d\n\nfunc D() { e() }\n"
    assert cache.refresh(table(spark, tree)) == {"parsed": 2, "reused": 12, "dropped": 1} and read[1] == ["a1.py", "d.go"]
    assert same(tree)
    newer = fact_cache.FactCache(spark, cache.folder, version=2, buckets=4)
    assert newer.refresh(table(spark, tree)) == {"parsed": 14, "reused": 0, "dropped": 0}
    assert same(tree)
    assert newer.refresh(table(spark, {})) == {"parsed": 0, "reused": 0, "dropped": 14} and newer.read().count() == 0
    assert newer.refresh(table(spark, tree).unionAll(table(spark, tree)))["parsed"] == 14 and same(tree)

"""Filter audit, centroid clustering and token files against brute force, with odd rows of every kind."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import filter_audit, token_files, yinyang
from spanloom.llm.bpe import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, part string, digest string, kept long"
LABELS = "doc_id long, quality int, toxic int, text string"


def texts():
    rng = random.Random(2)
    common = " ".join(f"w{k}" for k in range(230))
    out = [None, "", " \n\t", "# one", common, common, common.upper(), "a " * 300, common + " |", "Ünï çödé 中文 " * 40, " ".join(rng.choice("abc") for _ in range(30_000))]
    out += [" ".join(rng.choice(["alpha", "Beta", "x$", "C", str(rng.randrange(400))]) for _ in range(rng.randrange(100, 400))) for _ in range(30)]
    return out


def audit_rows():
    rng = random.Random(4)
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts())]
    rows += [(100 + k, rows[k][1], "en") for k in range(0, 40, 3)]  # copies
    rows += [(3, rows[3][1], "de"), (3, "another text", "en"), (None, rows[4][1], "fr"), (None, rows[4][1], "fr"), (-5, rows[7][1], "en")]
    rng.shuffle(rows)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (3, 1, 1)]
    return rows, labels


def brute_audit(rows, labels):
    white = re.compile(r"[^\x20\x09-\x0D]+")
    facts = []
    for i, t, lang in rows:
        t = t or ""
        w = white.findall(t)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        facts.append((lang or "", {x for x, b in zip("ABCDE", bad, strict=True) if b}, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out = {}
    for part in {f[0] for f in facts}:
        mine = [f for f in facts if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [f for f in left if x in f[1]]
                left = [f for f in left if x not in f[1]]
                failing = sum(x in f[1] for f in mine)
                total[x] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {x} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def test_audit_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "s", "x", "y", 7) for r in rows], DOCS).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame([(*x, "t") for x in labels], LABELS)).collect()
    assert {(r["part"], r.filter_order, r.step): [r[c] for c in filter_audit.COUNTS] for r in got} == brute_audit(rows, labels)


def test_audit_of_nothing_and_without_labels(spark):
    empty = filter_audit.filter_audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.count() == 0 and empty.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None, "s", "x", "y", 7)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(one) == 600 and {r["part"] for r in one} == {""} and sum(r.removed for r in one) == 120


def test_audit_of_very_many_copies_and_parts(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "if(id % 3 = 0, 'the copy', concat('text ', id)) as text", "if(id % 7 = 0, concat('l', id), 'en') as lang")
    got = filter_audit.filter_audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'EABCD' and step = 1").agg({"removed": "sum", "part": "count"}).first()
    assert tuple(got[c] for c in ("sum(removed)", "count(part)")) == (6666, 2859)  # 2,858 multiples of 7, and en


def test_first_failures_table():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for pattern, (number, order) in itertools.product(range(32), enumerate(filter_audit.ORDERS)):
        steps = [s for s, x in enumerate(order) if pattern >> "ABCDE".index(x) & 1]
        assert table[pattern, number] == (min(steps) if steps else 5)


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, key string, v string"


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(x) for x in e)]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (sha(f"3:{'' if r[0] is None else r[0]}"), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        at = own()
        for c in range(len(centres)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = own()
    d = [far(v, centres[a]) for (_, v), a in zip(kept, at, strict=True)]
    return sorted([(i, a, x, sum(y for y, b in zip(d, at, strict=True) if a == b), sum(d), sha(",".join(map(str, centres[a])))) for (i, _), a, x in zip(kept, at, d, strict=True)], key=str)


def vectors(seed, n=150):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, 64))
    rows = [(int(i), (middle[i % 6] * 0.3 + rng.normal(size=64) * 0.1).tolist()) for i in range(n)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "c", "k", "v") for i, e in rows], VECTORS).repartition(4)


def test_clusters_brute_force(spark):
    rows = vectors(1) + [(k, [0.25 * (k % 3)] * 64) for k in range(200, 230)]  # ties and repeated vectors
    rows += [(7, rows[7][1]), (8, rows[3][1]), (None, rows[2][1]), (500, None), (501, [1.0] * 63), (502, [None] + [0.0] * 63), (503, [float("nan")] * 64), (504, [float("inf")] + [0.0] * 63), (505, [-1e-12] * 64), (506, [])]
    got = sorted(map(tuple, yinyang.centroid_clusters(table(spark, rows)).collect()), key=str)
    assert got == brute_clusters(rows)


def test_clusters_with_large_components_and_few_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), (rng.normal(size=64) * 10_000).tolist()) for i in range(40)]
    assert sorted(map(tuple, yinyang.centroid_clusters(table(spark, rows)).collect()), key=str) == brute_clusters(rows)
    few = rows[:3] + [(900, [2.0e5] * 64)]  # beyond what a long can hold
    assert sorted(map(tuple, yinyang.centroid_clusters(table(spark, few)).collect()), key=str) == brute_clusters(rows[:3])
    none = yinyang.centroid_clusters(spark.createDataFrame([], VECTORS))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_of_one_vector_repeated(spark):
    rows = [(i, [0.5] * 64) for i in range(50)]
    got = yinyang.centroid_clusters(table(spark, rows)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 50


def test_yinyang_bounds_hold_and_save_distances():
    rng = np.random.default_rng(5)
    v = np.floor(np.concatenate([rng.normal(size=(800, 64)) * 40 + rng.normal(size=64) * 300 for _ in range(6)])).astype(np.int64)
    centres = v[rng.choice(len(v), 12, replace=False)]
    group = yinyang.grouped(centres, 4)
    model = yinyang.Yinyang(centres, group)
    own, bounds = model.first(v)
    spent = []
    for _ in range(8):
        new = np.array([v[own == c].mean(0) // 1 if (own == c).any() else centres[c] for c in range(12)]).astype(np.int64)
        model = yinyang.Yinyang(new, group, centres)
        centres = new
        own, bounds = model.again(v, own, bounds)
        d = yinyang.distances(v, centres)
        assert (own == d.argmin(1)).all()
        assert (bounds[:, 0] * (1 + 1e-9) + 1e-6 >= np.sqrt(d[np.arange(len(v)), own])).all()
        for g, members in enumerate(model.members):
            other = np.where(members == own[:, None], np.iinfo(np.int64).max, d[:, members]).min(1, initial=np.iinfo(np.int64).max)
            assert (bounds[:, 1 + g] <= np.sqrt(other) * (1 + 1e-9) + 1e-6).all()
        spent.append(model.exact)
    assert spent[-1] < len(v) * 12 / 4


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def token_rows():
    rng = random.Random(9)
    long = " ".join(rng.choice(["Alpha", "beta's", "12345", "né", "中文字"]) for _ in range(40_000))
    rows = [(k, t) for k, t in enumerate([None, "", " \n", "Hello  World", "é ́x", "<|endoftext|>tail<|startoftext|> <|endoftext|>", "ΣΑΣ ΟΔΟΣ", "a b c\x1cd\x85e", long, "x" * 5000, "\U0001f600‍\U0001f600"])]
    rows += [(rng.randrange(-50, 1000), " ".join(rng.choice(["the", "Cat", "sat!", "don't", "İı"]) for _ in range(rng.randrange(40)))) for _ in range(100)]
    return [*rows, (3, "Hello  World"), (3, "other"), (None, "first"), (None, None)]


def test_token_files_brute_force(spark):
    rows = token_rows()
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, start long, file string").repartition(6)
    got = sorted(map(tuple, token_files.token_file_digests(docs).collect()), key=lambda r: r[1])
    coder = library()
    coded = {t: [*coder.encode(t or "", add_special_tokens=False).ids, 2] for _, t in rows}
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    assert at == sum(len(coded[t]) for _, t in rows)
    want = sorted((str(i), len(coded[t]), zlib.crc32(np.array(coded[t], "<u4").tobytes())) for i, t in rows)
    assert sorted((str(r[0]), r[2], r[3]) for r in got) == want


def test_token_files_format(spark, tmp_path):
    rows = [(i, f"text number {i} of some") for i in range(500)] + [(i, None) for i in range(500, 520)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/out")
    shards = manifest.orderBy("shard").collect()
    coder, ids, names = library(), [], []
    for base, doc_base, s in zip(np.cumsum([0, *[s.tokens for s in shards]]), np.cumsum([0, *[s.docs for s in shards]]), shards, strict=False):
        assert (s.base, s.doc_base, s.width) == (base, doc_base, 2)
        raw = np.fromfile(s.file.removeprefix("file://") + ".bin", dtype="<u2")
        offsets = np.fromfile(s.file.removeprefix("file://") + ".idx", dtype="<i8")
        assert len(raw) == offsets[-1] == s.tokens and len(offsets) == s.docs + 1
        ids.extend(raw.tolist())
        shard = token_files.Shard(s.file, s.width)
        assert isinstance(shard.tokens, np.memmap)
        names.extend(shard.doc_ids.tolist())
        assert shard[0].tolist() == raw[: offsets[1]].tolist()
    assert names == list(range(520))
    assert ids == [x for _, t in rows for x in [*coder.encode(t or "", add_special_tokens=False).ids, 2]]
    back = {r.doc_id: list(r.ids) for r in token_files.read_token_files(manifest).collect()}
    assert [x for i in range(520) for x in back[i]] == ids
    broken = manifest.selectExpr("file", "width", "docs + 1 as docs", "nulls", "tokens", "base")
    with pytest.raises(Exception, match="is not what its manifest says"):
        token_files.read_token_files(broken).collect()


def test_token_files_of_nothing_and_of_one_id(spark):
    assert token_files.token_file_digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.range(0, 10_000, 1, 8).selectExpr("cast(4 as long) as doc_id", "'the same text' as text")
    joined = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(joined)
    spark.conf.set(joined, "false")  # so few bytes would be joined into one partition
    try:
        manifest = token_files.write_token_files(docs).orderBy("shard").collect()
    finally:
        spark.conf.set(joined, before)
    assert sum(s.docs for s in manifest) == 10_000 and len(manifest) > 1 and max(s.docs for s in manifest) < 9_000
    assert [s.base for s in manifest] == [sum(x.tokens for x in manifest[:k]) for k in range(len(manifest))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_word_encoder_equals_library(some):
    coder = token_files.encoder(vocabulary_path("word_bpe_49k.json"))
    want = [np.array(x.ids, "<u2").tobytes() for x in library_once().encode_batch(some, add_special_tokens=False)]
    assert encoded(coder, some) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aBzéßÿÖ×÷'09.,;:!?$#%&*|<> \n\u0301", max_size=40), max_size=6))
def test_word_encoder_equals_library_on_marks(some):
    coder = token_files.encoder(vocabulary_path("word_bpe_49k.json"))
    want = [np.array(x.ids, "<u2").tobytes() for x in library_once().encode_batch(some, add_special_tokens=False)]
    assert encoded(coder, some) == want


def test_word_encoder_forgets_and_relearns(monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_WORDS", 40)
    coder, rng = token_files.WordEncoder(vocabulary_path("word_bpe_49k.json")), random.Random(1)
    for _ in range(60):
        some = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 4))) + rng.choice(["", ",", "!", "1."]) for _ in range(30)) for _ in range(2)]
        assert encoded(coder, some) == [np.array(x.ids, "<u2").tobytes() for x in library_once().encode_batch(some, add_special_tokens=False)]
        assert len(coder.young) <= 40 + 120 and len(coder.old) <= 40 + 120


def test_encoder_of_a_vocabulary_with_blanks():
    from tokenizers import Tokenizer

    path = vocabulary_path("byte_bpe_50k.json")
    some = ["Hello  World", "", " a\nb <|endoftext|>"]
    assert encoded(token_files.WordEncoder(path), some) == [np.array(x.ids, "<u2").tobytes() for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def encoded(coder, some):
    ids, size = coder.encode(pa.array(some, pa.string()))
    return [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])] if some else []


_one = []


def library_once():
    if not _one:
        _one.append(library())
    return _one[0]

"""Secret scans by rules and by a battery of randomness tests (operator 1; DataFrame functions only).

Rules find assignments of passwords and tokens, access keys and long hexadecimal runs.  The method adds spans
of kind ``random``: runs of 20 or more token characters, bounded by no letter or digit, that look drawn at
random from the alphabet of their encoding.  The encoding (decimal, hex, base32, base36, base64) is the
narrowest alphabet that holds all characters.  The nulls are written language and identifiers, and repeated or
counted symbols; their tests are likelihood ratios of the alphabet's uniform draws against the null, since 1 / ratio
bounds the p-value under the null (Markov) at every length, and factors combine by multiplying:

* chi-squared, aware of bigrams: each letter after a letter against the frequencies of written pairs (PAIRS);
* runs: each change between symbol classes (digit, lower, upper, other) against the few changes of words and
  identifiers, a Markov chain (CHANGES); runs of digits, which have none, against equal and counting digits;
* serial correlation: symbols equal to the one 1 to LAGS places before, or one step from their neighbour.

The first two are factors of one ratio against language; each serial order is a null of its own.  A candidate is
random only if all nulls are rejected, so its p-value is the largest, times the ENCODINGS the alphabet was chosen from.
Candidates are compared in length bands; in each band a Benjamini-Hochberg
threshold for a false discovery rate of FDR is found from a histogram of -log10 p with a fixed number of bins,
counted over all candidates of the input, so nothing is sorted in one place and the driver receives at most
BANDS x BINS numbers.  Short strings need a stronger p, as their band holds more written words.

Positions are code points, ends exclusive.  Defined results: a null text is the empty text (no spans); an empty table
has none.  Texts of any length are scanned whole.  Random spans that overlap a rule's span are not added.  Repeated rows
count each as a candidate and have equal results.  Other columns, whatever their names, are kept by `masked` and ignored
by `secret_digests`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![\p{L}\p{N}])[A-Za-z0-9+/_=-]{20,}+(?![\p{L}\p{N}])"
#: Place of a kind where spans start together.
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
BANDS = (20, 24, 32, 40, 64, 128)
BINS = 400
BIN_WIDTH = 0.05
#: -8 log10 of the frequency of a letter (column) after a letter (row), as a letter from a; counted in English source
#: code and in English, German, French and Spanish prose.
PAIRS = """
opkkouptjtsklhqptiiiipttsx
lvpsdxwwnkxgtugsxopulxxxkv
mxswlvxeexnmswhvxqskqwxxvx
kqspduwqiwxqwqfwxpnomwswtx
jqmlmorskutjogoprgiknrsoso
iqqqkkrrfxskssfpwinlksuxss
fprvdwpnlysntlorynjmmqsyxr
gnpwdxqmkyrntnkqvomkpqqxwr
nqkqhlpvruvmmfiqsnjiuqwsxs
byvxgxyxtyuwxylsyusxmyxywy
nwtpbuqwlxwlvpqqvrlupwmyww
htrpejvxivwhsuksvtmnnwwxkx
inwqdwxwhxwroujjyuotpxxxux
jolihsipmtqnppjqqnlgopsxus
oonlqlrxkttpmfqnshimhsqvxw
evrriiwtmyukuvilwipjnruxny
xyxyyxyyxxyvxvyxxvuxayxxyy
hooqeumpkuqpoljrujlkoqsxps
lqipfvpkkqtoosmoqnlflvtxqx
jrqtgtufhxuqsskrvjmnmtsxpm
nppteprtnxulmgnnrjmlurwhxu
hxxydwxyeyxxsvjvywwxxwxxxy
huupjuxdgxxpxnkwyjouwvtvyx
iuhvhrxukyxmmxkjnlrfxowqtw
nopqirxmkyynokkgwohgtumytu
lnmphyoqmrpnnuoqponmdqxywp
"""
#: Of the next symbol's class (digit, lower, upper, other) after each class, in words and identifiers.
CHANGES = ((0.80, 0.08, 0.05, 0.07), (0.04, 0.80, 0.06, 0.10), (0.04, 0.50, 0.40, 0.06), (0.10, 0.60, 0.20, 0.10))
#: Of a digit after a digit: equal, one more or less, each other; of a symbol that is neither letter nor digit: equal, other.
SAME_DIGIT, NEXT_DIGIT, OTHER_DIGIT, SAME_SIGN, OTHER_SIGN = 0.55, 0.15, 0.15 / 7, 0.8, 0.05
#: Places looked back for repetition, and the share of symbols that keep to it.
LAGS = 6
KEPT = 0.9
#: Alphabets and their sizes, narrowest first; what fits none has 64 symbols.
ALPHABETS = (("[0-9]", 10), ("[0-9a-f]", 16), ("[0-9A-F]", 16), ("[a-z]", 26), ("[A-Z]", 26), ("[A-Z2-7]", 32), ("[a-z2-7]", 32), ("[0-9a-z]", 36), ("[0-9A-Z]", 36), ("[A-Za-z]", 52), ("[0-9A-Za-z]", 62))
ENCODINGS = len(ALPHABETS) + 1
_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Items folded between two growths of a text's array of spans.
BLOCK = 256


def _folded(items: Column, begin: Column, step, last) -> Column:
    """A fold whose state has a growing array ``spans``: in blocks, so that what is copied stays small beside what is added."""
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(items, i + 1, F.lit(BLOCK)))
    none = F.array().cast(_SPAN)

    def block(a, part):
        inner = F.aggregate(part, F.struct(a["at"].alias("at"), none.alias("spans")), step)
        both = F.transform(F.array(inner), lambda x: F.struct(x["at"].alias("at"), F.concat(a["spans"], x["spans"]).alias("spans")))
        return both[0]

    return F.aggregate(blocks, begin, block, last)


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches: text between matches and matches take turns."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(a, x):
        start = a["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (F.concat(a["spans"], F.when(keep(x["1"]), span).otherwise(F.array().cast(_SPAN))) if keep else F.concat(a["spans"], span)).alias("spans"))

    pairs = F.transform(F.array(F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("0"), matches.alias("1"))), lambda p: _folded(p, begin, step, lambda a: a["spans"]))[0]
    return F.when(text.rlike(pattern), pairs).otherwise(F.array().cast(_SPAN))


def _long_enough(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 1)) >= 6


def _battery(token: Column) -> Column:
    """-log10 of the p-value that the token is written, repeated or counted."""
    size = F.lit(64.0)
    for alphabet, n in reversed(ALPHABETS):
        size = F.when(token.rlike(f"^{alphabet}+$"), float(n)).otherwise(size)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), F.ascii)
    return F.transform(F.array(F.struct(codes.alias("codes"), size.alias("size"))), lambda t: _score(t["codes"], t["size"]))[0]


def _score(codes: Column, size: Column) -> Column:
    n = F.size(codes)
    kind = lambda c: F.when(c.between(48, 57), 0).when(c.between(97, 122), 1).when(c.between(65, 90), 2).otherwise(3)
    letter = lambda c: c.bitwiseOR(32) - 97
    table = PAIRS.replace("\n", "")
    changes = F.lit("".join(chr(97 + round(-8 * math.log10(p))) for row in CHANGES for p in row))
    level = lambda text, at: (F.ascii(F.substring(text, at + 1, F.lit(1))) - 97) / -8.0
    log = math.log10

    def written_log(x, y):
        """log10 of the null's probability of y after x."""
        a, b = kind(x), kind(y)
        far = F.pmod(y - x, F.lit(10))
        digit = F.when(far == 0, log(SAME_DIGIT)).when(far.isin(1, 9), log(NEXT_DIGIT)).otherwise(log(OTHER_DIGIT))
        sign = F.when(x == y, log(SAME_SIGN)).otherwise(log(OTHER_SIGN))
        both = a.isin(1, 2) & b.isin(1, 2)
        symbol = F.when(both, level(F.lit(table), letter(x) * 26 + letter(y))).when(b.isin(1, 2), -log(26)).when(b == 0, F.when(a == 0, digit).otherwise(-1.0)).otherwise(F.when(a == 3, sign).otherwise(-log(5)))
        return level(changes, a * 4 + b) + symbol

    ahead = lambda k: F.arrays_zip(F.slice(codes, F.lit(1), n - k).alias("x"), F.slice(codes, F.lit(k + 1), n - k).alias("y"))
    language = F.aggregate(ahead(1), F.lit(0.0), lambda a, p: a - F.log10(size) - written_log(p["x"], p["y"]))

    def order(k, fits):
        kept = F.size(F.filter(ahead(k), fits))
        return (n - k - kept) * -log(1 - KEPT) - kept * F.log10(KEPT * size + (1 - KEPT))

    serial = [order(k, lambda p: p["x"] == p["y"]) for k in range(1, LAGS + 1)]
    serial += [order(1, lambda p: p["y"] - p["x"] == 1), order(1, lambda p: p["x"] - p["y"] == 1)]
    return F.greatest(F.least(language, *serial) - log(ENCODINGS), F.lit(0.0))


def _band(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(BANDS):
        out = F.when(length >= least, k).otherwise(out)
    return out


def _thresholds(candidates: DataFrame) -> list[float]:
    """For each band the least -log10 p that keeps the false discovery rate, from a histogram of all candidates."""
    counts = candidates.groupBy("band", F.least(F.floor(F.col("score") / BIN_WIDTH), F.lit(BINS - 1)).cast("int").alias("bin")).count().collect()
    out = []
    for band in range(len(BANDS)):
        mine = {r["bin"]: r["count"] for r in counts if r["band"] == band}
        total, above, least = sum(mine.values()), 0, BINS * BIN_WIDTH * 1e6
        for k in range(BINS - 1, -1, -1):
            above += mine.get(k, 0)
            if above and 10 ** (-k * BIN_WIDTH) * total <= FDR * above:
                least = k * BIN_WIDTH
        out.append(least)
    return out


def secret_spans(documents: DataFrame, kept: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The `kept` columns, ``base`` and ``spans``: arrays of (start, kind, end), sorted; kind is a place in KINDS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    scan = documents.select(*kept, text.alias("_text"))
    t = F.col("_text")
    base = F.array_sort(F.concat(_found(t, ASSIGN, 0, _long_enough), _found(t, ACCESS, 1), _found(t, HEX, 2)))
    scan = scan.select(*kept, "_text", base.alias("base"), _found(t, CANDIDATE, 3).alias("_c"))
    free = F.filter("_c", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    scored = F.transform(free, lambda c: F.struct(c.alias("span"), _band(c["end"] - c["start"]).alias("band"), _battery(F.substring(t, c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int"))).alias("score")))
    rows = written(scan.select(*kept, "base", F.when(F.size("_c") > 0, scored).alias("_c")), "secrets")  # kept: none of base, _c, _text
    least = F.array(*[F.lit(x) for x in _thresholds(rows.where("_c is not null").select(F.inline("_c")))])
    sure = F.transform(F.filter(F.coalesce("_c", F.expr("cast(array() as " + dict(rows.dtypes)["_c"] + ")")), lambda c: c["score"] >= F.element_at(least, c["band"] + 1)), lambda c: c["span"])
    return rows.select(*kept, "base", F.array_sort(F.concat("base", sure)).alias("spans"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(documents: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_random`` for every document."""
    rows = secret_spans(documents)
    count = lambda column, kind: F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select("doc_id", *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), count("spans", 3).alias("n_random"))


def masked(documents: DataFrame) -> DataFrame:
    """The documents with every secret replaced by ``[kind]``; a span inside an earlier one goes with it."""
    columns = documents.columns
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("text"))
    rows = secret_spans(whole, ["_row"])
    names, text = F.array(*[F.lit(k) for k in KINDS]), F.col("_row.text")
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(a, s):  # of each span that begins outside those before: where the text before it begins, its kind, where it begins
        outside = F.array(F.struct(a["at"].alias("start"), s["kind"].alias("kind"), s["start"].alias("end")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["spans"], F.when(s["start"] >= a["at"], outside).otherwise(F.array().cast(_SPAN))).alias("spans"))

    rows = rows.withColumn("_cuts", F.when(F.size("spans") > 0, _folded(F.col("spans"), begin, step, lambda a: a)))
    pieces = F.transform("_cuts.spans", lambda c: F.concat(F.substring(text, c["start"].cast("int") + 1, (c["end"] - c["start"]).cast("int")), F.lit("["), F.element_at(names, c["kind"] + 1), F.lit("]")))
    rest = F.substring(text, F.col("_cuts.at").cast("int") + 1, F.length(text))
    rows = rows.withColumn("_clean", F.when(F.col("_cuts").isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), rest)))
    return rows.select(*[(F.col("_clean") if c == "text" else F.coalesce(F.length("_clean").cast(dict(documents.dtypes)[c]), F.col(f"_row.`{c}`")) if c == "n_chars" else F.col(f"_row.`{c}`")).alias(c) for c in columns])

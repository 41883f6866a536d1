"""Language of words and documents by a linear-chain conditional random field (operator 6).

A run of letters longer than PIECE is cut into consecutive pieces, each a word of the chain; neighbours share two
characters, so that every trigram of the run occurs in one piece.  Text without spaces is so labelled along its length.

Each word of letters has features: itself (lexicon), its prefixes and suffixes of 1 to 3 characters (affixes)
and its character trigrams (n-grams), all hashed; the score of a language for a word is the sum of their
weights, and learned transitions score neighbouring labels.  Forward-backward gives each word the posterior of
its label, so a text that switches language is labelled part by part; the document gets the language with the
largest mean posterior, which is the score.

Training (a bounded, documented sample): from the rows whose crc32(doc_id as text) mod 4 is not 2 and whose lang
is not null, one row each of the SAMPLE ids with the smallest hashes.  The bound is one on rows: their whole texts are used,
all words, cut into stretches of some words which are joined at random, with their documents' labels, into
code-switched sequences.  The recursion takes BLOCK sequences at a time.
The likelihood's gradient (feature expectations from forward-backward) is followed by adaptive steps on the driver.

Prediction runs over whole texts; the recursion of all texts of a batch advances together, longest first.

Defined results: null texts and texts without a letter (Unicode's letter categories; numbers such as fractions and Roman
numeral signs are none) are ``und`` with score 0; a null doc_id is not held out and not trained on.  Without training
rows every text is ``und``.  Of languages with equal means the first by name is given.  Repeated rows have equal
results.  Columns other than doc_id, text and, in training, lang do not take part.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import giving_back
from .workspace import small, written

SAMPLE = 2_000
LENGTH = 30
WIDTH = 1 << 16
STEPS = 60
BLOCK = 4_000
CACHE = 400_000
#: Trigrams of a longer run of letters that make one word.
PIECE = 32
#: Numbers that re takes for parts of words beside digits: fractions, superscripts, Roman numerals and such.
_NUMBERS = "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_BLANK = dict.fromkeys(map(ord, _NUMBERS), " ")
#: Any of them; beyond U+FFFF, where a set is slow to search, any character.
_has_number = re.compile("[" + re.escape("".join(c for c in _NUMBERS if c < "\U00010000")) + "]|[\U00010000-\U0010ffff]").search
_runs = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """The runs of letters of a text."""
    return _runs(text.translate(_BLANK) if _has_number(text) else text)


def words_of(text: str) -> list[str]:
    """Runs of letters; of a long one its pieces, marked by ``-``, with ``^`` and ``$`` at the run's ends."""
    found = letters(text)
    if found and max(map(len, found)) > PIECE:
        cut = lambda w: [f"-{p[i : i + PIECE + 2]}" for p in [f"^{w}$"] for i in range(0, len(w), PIECE)]
        found = [x for w in found for x in (cut(w) if len(w) > PIECE else [w])]
    return found


def word_features(word: str) -> list[int]:
    """Hashed features of a word (case is ignored)."""
    w = word.lower()
    padded = w[1:] if w[0] == "-" else f"^{w}$"
    parts = ["w" + w]
    if padded[0] == "^":
        parts += ["p" + padded[1 : 1 + k].rstrip("$") for k in (1, 2, 3)]
    if padded[-1] == "$":
        parts += ["s" + padded[-1 - k : -1].lstrip("^") for k in (1, 2, 3)]
    parts += ["g" + padded[i : i + 3] for i in range(len(padded) - 2)]
    return [zlib.crc32(p.encode()) % WIDTH for p in dict.fromkeys(parts)]


def forward_backward(emission: np.ndarray, transition: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of labels, and the summed posteriors of label pairs, for sequences sorted longest first.

    emission: (steps, sequences, labels).  Everything is kept as normalised probabilities.
    """
    steps, count, labels = emission.shape
    psi = np.exp(emission - emission.max(2, keepdims=True))
    move = np.exp(transition - transition.max())
    ahead = np.zeros_like(psi)  # also where a sequence has ended
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # sequences longer than t
    ahead[0] = psi[0] / psi[0].sum(1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        x = (ahead[t - 1, :n] @ move) * psi[t, :n]
        ahead[t, :n] = x / x.sum(1, keepdims=True)
    pairs = np.zeros((labels, labels))
    back = np.ones((count, labels))
    post = np.zeros_like(psi)
    for t in range(steps - 1, -1, -1):
        n = active[t] if t else count
        x = ahead[t, :n] * back[:n]
        post[t, :n] = x / x.sum(1, keepdims=True)
        if t:
            y = psi[t, :n] * back[:n]
            joint = ahead[t - 1, :n, :, None] * move * y[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            x = y @ move.T
            back[:n] = x / x.sum(1, keepdims=True)
    return post, pairs


def train(texts: list[str], langs: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, feature weights (WIDTH x labels) and transitions."""
    labels = sorted(set(langs))
    rng = np.random.default_rng(seed)
    pieces: list[tuple[list[str], int]] = []
    for text, lang in zip(texts, langs, strict=True):
        words = words_of(text)
        at = 0
        while at < len(words):
            n = int(rng.integers(3, LENGTH))
            pieces.append((words[at : at + n], labels.index(lang)))
            at += n
    order = rng.permutation(len(pieces))
    known: dict[str, int] = {}
    numbers, gold = array("i"), array("i")
    for i in order:
        numbers.extend(known.setdefault(w, len(known)) for w in pieces[i][0])
        gold.extend([pieces[i][1]] * len(pieces[i][0]))
    count = -(-len(numbers) // LENGTH)
    k = len(labels)
    weights, moves = np.zeros((WIDTH, k)), np.zeros((k, k))
    if not count:
        return labels, weights, moves
    # the last sequence may be shorter, and is then the last of its block
    index, gold = (np.pad(np.frombuffer(x, dtype=np.int32), (0, count * LENGTH - len(numbers))).reshape(count, LENGTH).T for x in (numbers, gold))
    length = np.full(count, LENGTH)
    length[-1] -= count * LENGTH - len(numbers)
    real = np.arange(LENGTH)[:, None] < length
    lists = [word_features(w) for w in known]
    flat, of_word = np.concatenate(lists).astype(np.int32), np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    true_words = np.zeros((len(lists), k))
    np.add.at(true_words, (index[real], gold[real]), 1)
    true_pairs = np.zeros((k, k))
    np.add.at(true_pairs, (gold[:-1][real[1:]], gold[1:][real[1:]]), 1)
    m = v = np.zeros_like(weights)
    mm = vv = np.zeros_like(moves)
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(of_word, weights=weights[flat, j], minlength=len(lists)) for j in range(k)], axis=1)
        by_word, pairs = -true_words, np.zeros((k, k))
        for at in range(0, count, BLOCK):
            part = slice(at, at + BLOCK)
            post, found = forward_backward(score[index[:, part]], moves, length[part])
            inside, pairs = index[:, part][real[:, part]], pairs + found
            by_word += np.stack([np.bincount(inside, weights=post[real[:, part], j], minlength=len(lists)) for j in range(k)], axis=1)
        slope = np.stack([np.bincount(flat, weights=by_word[of_word, j], minlength=WIDTH) for j in range(k)], axis=1) / count + 1e-4 * weights
        mslope = (pairs - true_pairs) / count
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        mm, vv = 0.9 * mm + 0.1 * mslope, 0.99 * vv + 0.01 * mslope**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights = weights - 0.1 * fix * m / (np.sqrt(v) + 1e-4)
        moves = moves - 0.1 * fix * mm / (np.sqrt(vv) + 1e-4)
    return labels, weights, moves


class Tagger:
    """Labels texts with a trained model; word scores are kept between batches, up to CACHE words."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves
        self.place: dict[str, int] = {}
        self.scores = np.zeros((1024, len(labels)), dtype=np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.place) > CACHE:
            self.place.clear()
        new = [w for w in words if w not in self.place]
        if not new:
            return
        first = len(self.place)
        while first + len(new) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            lists = [word_features(w) for w in part]
            begin = np.cumsum([0] + [len(x) for x in lists[:-1]])
            self.scores[first + at : first + at + len(part)] = np.add.reduceat(self.weights[np.concatenate(lists)], begin)
        self.place.update(zip(new, range(first, first + len(new)), strict=True))

    def marginals(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the text, posteriors of its words) for texts with words, in bounded groups."""
        split = [words_of(t) if t else [] for t in texts]
        self._learn(set().union(*split))
        get = self.place.__getitem__
        order = sorted((i for i in range(len(split)) if split[i]), key=lambda i: -len(split[i]))
        at = 0
        while at < len(order):
            steps = len(split[order[at]])
            group = order[at : at + max(1, 400_000 // steps)]
            at += len(group)
            index = np.zeros((steps, len(group)), dtype=np.int32)
            for j, i in enumerate(group):
                index[: len(split[i]), j] = np.fromiter(map(get, split[i]), dtype=np.int32, count=len(split[i]))
            length = np.array([len(split[i]) for i in group])
            post, _ = self._posteriors(index, length)
            for j, i in enumerate(group):
                yield i, post[: length[j], j]

    def _posteriors(self, index: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, None]:
        psi = self.scores[index]
        psi = np.exp(psi - psi.max(2, keepdims=True))
        move = np.exp(self.moves - self.moves.max()).astype(np.float32)
        active = np.searchsorted(-length, -np.arange(len(index)), side="left")
        ahead = np.zeros_like(psi)
        ahead[0] = psi[0] / psi[0].sum(1, keepdims=True)
        for t in range(1, len(index)):
            n = active[t]
            x = ahead[t - 1, :n] @ move
            x *= psi[t, :n]
            x /= x.sum(1, keepdims=True)
            ahead[t, :n] = x
        back = np.ones(psi.shape[1:], dtype=np.float32)
        turned = np.ascontiguousarray(move.T)
        for t in range(len(index) - 1, -1, -1):
            n = active[t] if t else len(length)
            ahead[t, :n] *= back[:n]
            if t:
                x = (psi[t, :n] * back[:n]) @ turned
                x /= x.sum(1, keepdims=True)
                back[:n] = x
        ahead /= np.maximum(ahead.sum(2, keepdims=True), 1e-30)
        return ahead, None

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        for i, post in self.marginals(texts) if self.labels else ():
            mean = post.mean(0, dtype=np.float64)
            names[i], scores[i] = self.labels[int(mean.argmax())], float(min(1.0, mean.max()))
        return names, scores


_taggers: dict[int, Tagger] = {}


def sampled(documents: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``lang, text`` to train on: of the ids with the smallest hashes one row each, that with the smallest lang and text hash."""
    pool = documents.select("doc_id", "lang", "text").where("doc_id is not null and lang is not null and text is not null and pmod(crc32(cast(doc_id as string)), 4) <> 2")
    ids = written(pool.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "sample")
    one = pool.join(small(ids, most), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text").alias("hash"), "text")).alias("row"))
    return one.select("row.lang", "row.text")


def model(documents: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Train on the sample of rows that are not held out."""
    rows = sampled(documents).orderBy("lang", "text").collect()
    return train([r.text for r in rows], [r.lang for r in rows])


def languages(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    labels, weights, moves = model(documents)
    weights, key = weights.astype(np.float32), zlib.crc32(weights.tobytes() + moves.tobytes())

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _taggers:
            _taggers.clear()
            _taggers[key] = Tagger(labels, weights, moves)
        tagger = _taggers[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                names, scores = tagger.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2"), F.lit(False))
    docs = documents.select("doc_id", held.alias("held_out"), "text")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(giving_back(tagged), schema)

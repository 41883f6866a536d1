"""Byte-level BPE encoding and decoding by a trie of words (operator 2).

Method: prefix-sharing trie traversal.  The encoding of a prefix ends in exactly one token t such that the
encoding of the rest ends in a token that may stand before t; so one last token per prefix describes all
encodings.  The distinct words of some texts are put in the order of their bytes, which is the depth-first order of their
trie: going from word to word, the traversal returns to the node where they part and goes down the new branch,
giving each new node its last token from the nodes above it, once for all words that share the prefix.  Only the
path to the present node is held.  A word's encoding is read by stepping back from its node.  Whether token b may
stand after token a is decided by undoing merges: the pair is kept if no merge across the border would have come first.

The vocabulary is read from the tokenizers file at run time and its path is a parameter.  Words are found with
the file's byte-level pattern; texts with characters outside ranges on which all Unicode versions agree are
split by the tokenizers library itself.  Added tokens in a text become their ids, as the library has it.

Defined results: a null text is the empty text (no ids); an empty table gives none.  Repeated rows give repeated results.
Other columns, whatever their names, do not take part.  Encodings of words are
kept between texts, up to KEPT_WORDS words and KEPT_BYTES of them; a word of any length goes the same way.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import give_back, giving_back

KEPT_WORDS, KEPT_BYTES, KEPT_PAIRS, KEPT_STEPS = 200_000, 8 << 20, 400_000, 500_000
#: Characters of texts that are encoded together.
TOGETHER = 2 << 20
#: Texts of these characters only are split by WORD, which equals the file's byte-level pattern on them: they
#: leave out code points that Unicode versions or libraries class differently, and number signs that re takes
#: for letters.
SETTLED = r"[\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ԯ‐-⁞ぁ-ゖァ-ヺ一-龥가-힣]*"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names = byte_names()
        raw = spec["model"]["vocab"]
        vocab = {bytes(names[c] for c in token): i for token, i in raw.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = dict.fromkeys(vocab.values(), -1)
        for k, (a, b) in enumerate(merges):
            left, right = raw[a], raw[b]
            both = raw[a + b]
            self.rank[left << 32 | right] = k
            if both not in self.parts:
                self.parts[both], self.made[both] = (left, right), k
        table = {i: b for b, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        table |= {i: t.encode() for t, i in self.added.items()}
        self.bytes = [table.get(i, b"") for i in range(max(table) + 1)]
        self.length = [len(b) for b in self.bytes]
        self.spans = np.array(self.length, dtype=np.int64)
        self.flat, self.first = np.frombuffer(b"".join(self.bytes), dtype=np.uint8), np.concatenate([[0], np.cumsum(self.spans)])
        self._automaton(vocab)
        self.find = re.compile(WORD).findall
        self.settled = re.compile(SETTLED).fullmatch
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.follows: dict[int, bool] = {}
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        self.step = dict(self.goto)
        self.ids: dict[str, bytes] = {}
        self.held = 0

    def _automaton(self, vocab: dict[bytes, int]) -> None:
        """For any text read byte by byte, the longest token that ends there; and each token's next shorter suffix."""
        self.goto: dict[int, int] = {}
        self.ends, below, byte = [-1], [0], [0]
        for token, i in vocab.items():
            at = 0
            for b in token:
                to = self.goto.get(at << 8 | b)
                if to is None:
                    to = self.goto[at << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                    below.append(at)
                    byte.append(b)
                at = to
            self.ends[at] = i
        depth = [0] * len(self.ends)
        for at in range(1, len(self.ends)):
            depth[at] = depth[below[at]] + 1
        self.fail, self.shorter = [0] * len(self.ends), [-1] * len(self.bytes)
        for at in sorted(range(1, len(self.ends)), key=depth.__getitem__):
            up, b = below[at], byte[at]
            back = self.fail[up]
            if up:
                while back and back << 8 | b not in self.goto:
                    back = self.fail[back]
                self.fail[at] = self.goto.get(back << 8 | b, 0)
            short = self.ends[self.fail[at]]
            if self.ends[at] < 0:
                self.ends[at] = short
            else:
                self.shorter[self.ends[at]] = short

    def may_follow(self, left: int, right: int) -> bool:
        """True if encoding the bytes of both gives just these two tokens."""
        a, b, limit, ok = left, right, 1 << 60, True
        while ok:
            # a merge across the border must not come before those that made the two sides
            if self.rank.get(a << 32 | b, 1 << 60) < limit:
                ok = False
            elif self.made[a] < 0 and self.made[b] < 0:
                break
            elif self.made[a] > self.made[b]:  # undo the later merge; of a, its right part then meets the border
                limit, a = self.made[a], self.parts[a][1]
            else:  # a merge of the same rule across the border lies further left and would come first
                limit, b = self.made[b] + 1, self.parts[b][0]
        if len(self.follows) >= KEPT_PAIRS:
            self.follows.clear()
        self.follows[left << 32 | right] = ok
        return ok

    def decoded(self, ids: np.ndarray) -> bytes:
        """The bytes of some tokens, one after the other."""
        out = []
        for at in range(0, len(ids), 1 << 17):
            part = ids[at : at + (1 << 17)]
            size = self.spans[part]
            begin = np.cumsum(size) - size
            out.append(self.flat[np.arange(int(size.sum())) + np.repeat(self.first[part] - begin, size)].tobytes())
        return b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Encode those of the words that are new, in the depth-first order of their trie."""
        length, ends, shorter, known, packed, goto, fail = self.length, self.ends, self.shorter, self.follows.get, self.packed, self.goto.get, self.fail
        if len(self.step) > KEPT_STEPS:
            self.step = dict(self.goto)
        step = self.step
        state, last, before = [0], [0], b""  # of the nodes on the path from the root to the last word's node
        for word, text in sorted([(w.encode(), w) for w in words.difference(self.ids)]):
            size = len(word)
            depth, most = 0, min(size, len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            before = word
            del state[depth + 1 :], last[depth + 1 :]
            at = state[depth]
            for end in range(depth + 1, size + 1):
                key = at << 8 | word[end - 1]
                to = step.get(key)
                if to is None:  # go back to shorter suffixes, and remember where that ends
                    while to is None and at:
                        at = fail[at]
                        to = goto(at << 8 | word[end - 1])
                    to = step[key] = to or 0
                at = to
                state.append(at)
                token = ends[at]
                start = end - length[token]
                while start:
                    ok = known(last[start] << 32 | token)
                    if ok or ok is None and self.may_follow(last[start], token):
                        break
                    token = shorter[token]
                    start = end - length[token]
                last.append(token)
            ids, end = [], size
            while end:
                token = last[end]
                ids.append(packed[token])
                end -= length[token]
            ids.reverse()
            self.ids[text] = b"".join(ids)
            self.held += size

    def pieces(self, text: str) -> list[str]:
        """The text's words; added tokens stand alone."""
        if any(t in text for t in self.added):
            out: list[str] = []
            for part in self.cut_added(text):
                out.extend([part] if part in self.added else self._words(part))
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self.settled(text):
            return self.find(text)
        return [text[a:b] for _, (a, b) in self.split(text)]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """For each text its ids (32-bit little-endian) and the bytes they decode to."""
        split = [self.pieces(t) for t in texts]
        words = set().union(*split)
        if len(self.ids) > KEPT_WORDS or self.held > KEPT_BYTES:  # only words of these texts stay
            self.ids = {w: self.ids[w] for w in words if w in self.ids}
            self.held = sum(map(len, self.ids))
        for token, i in self.added.items():
            self.ids[token] = self.packed[i]
        self.learn(words)
        ids = self.ids.__getitem__
        for words in split:
            coded = b"".join(map(ids, words))
            yield coded, self.decoded(np.frombuffer(coded, dtype="<u4"))


_loaded: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    """The worker's encoder for a vocabulary file; encodings of words live on between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
        give_back()  # what reading the file took
    return _loaded[path]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _texts(column: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, list[str]]]:
    """Slices of the column of about `most` characters."""
    at, texts, held = 0, [], 0
    for k in range(len(column)):
        text = column[k].as_py() or ""
        texts.append(text)
        held += len(text)
        if held > most:
            yield at, texts
            at, texts, held = k + 1, [], 0
    if texts:
        yield at, texts


def bpe_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of `documents` (``doc_id, text``)."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or vocabulary_path())
        for batch in batches:
            for at, texts in _texts(batch.column("text")):
                n, ids, out = [], [], []
                for coded, raw in bpe.encode_batch(texts):
                    n.append(len(coded) // 4)
                    ids.append(hashlib.sha256(coded).hexdigest())
                    out.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(out, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(giving_back(digests), f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with their token ids: ``doc_id, ids array<int>``; a null text has no ids."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path or vocabulary_path())
        for batch in batches:
            for at, texts in _texts(batch.column("text")):
                ids = [np.frombuffer(c, dtype="<i4") for c, _ in bpe.encode_batch(texts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    docs = documents.select("doc_id", "text")
    return docs.mapInArrow(giving_back(coded), f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``; invalid UTF-8 becomes U+FFFD, null ids the empty text."""

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(path or vocabulary_path()).bytes
        for batch in batches:
            texts = [b"".join([table[i] for i in ids or []]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(plain, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")

"""Token ids of a corpus as flat binary files with document offsets (operator 13).

Format: a shard is three files, ``<shard>.bin`` with the ids of its documents one after the other, as unsigned integers of
2 bytes (4 where the vocabulary has more than 65,536 ids), ``<shard>.idx`` with their 64-bit offsets, counted in
ids, from 0 to the shard's end, and ``<shard>.ids`` with their 64-bit doc_ids; all little-endian, so that they can be mapped
into memory as they are.  The manifest has a row for each shard: its number in the order of doc_id, the files' common
name, the width of an id, the numbers of documents (those without a doc_id come first and are counted) and of ids, and the
bases, which are the prefix sums over the shards before: an id's place in the corpus is its shard's base and its place there.

Writing: texts are dealt into ranges of doc_id, sorted there, encoded and written as they come, so a task holds some
texts.  Every attempt of a task writes files of its own names and the manifest, a table that Spark commits, names those of the
attempts that count.  Ranges are cut by doc_id, text hash and row, so one id or row with many copies is split as well.

Encoding is that of the tokenizers library, with the file's own normalisation.  All that the library does to a text with
a vocabulary that marks the ends of words keeps to stretches without white space, so the distinct stretches of some texts are given
to the library and the ids of each text put together; what is learnt is kept, up to a bound.

Reading: a task maps a shard's files into memory (on stores that cannot be mapped it reads them) and gives its documents.

Defined results: a null text is the empty text, of which only the end id is written.  Rows without a doc_id come first, rows with one doc_id
are ordered by a hash of their text; equal rows are interchangeable.  An empty table makes no shards.  Other columns do not take part.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import vocabulary_path
from .memory import give_back, giving_back
from .workspace import dropped, temporary, written

END = 2
#: Of each generation of words that an encoder keeps.
KEPT_WORDS, KEPT_BYTES = 500_000, 16 << 20
#: Bytes of texts that are encoded, and documents and ids that are handed on, together (one document at least).
TOGETHER, DOCUMENTS, IDS = 4 << 20, 1000, 1 << 20
#: Letters with one code point and no other form, and words of such, or of such and digits with marks behind.
_LETTERS = "[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_plain = re.compile(f"(?:{_LETTERS})+".encode("latin-1")).fullmatch
_sided = re.compile(f"((?:{_LETTERS}|[0-9])+)([.,;:!?$#%&*]+)".encode("latin-1")).fullmatch
MANIFEST = "shard long, file string, width int, docs long, nulls long, tokens long"


class WordEncoder:
    """The tokenizers library with a memory of words.

    Words live in two generations: those met since the younger one began, and the generation before, from which words that
    are met again move on; so frequent words stay and rare ones go.  A word of letters and digits with marks behind has
    the ids of its two sides.  Words of plain letters are given to the library joined by blanks, and their ids parted where a token
    ends a word.  Vocabularies without an end of words keep white space in their tokens: there whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.width = 2 if size <= 1 << 16 else 4
        with open(path, encoding="utf-8") as file:
            suffix = json.load(file)["model"].get("end_of_word_suffix")
        self.last = np.zeros(1 << 8 * self.width if self.width == 2 else size, dtype=bool)
        if suffix:
            self.last[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith(suffix)]] = True
        self.by_words = bool(suffix)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0

    def _coded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(found.ids, dtype=f"<u{self.width}") for found in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.held += len(word)

    def _joined(self, words: list[bytes]) -> None:
        """Learn words of plain letters."""
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            ids = self._coded([b" ".join(part).decode()])[0]
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(part):
                raise ValueError("a token inside a word is marked as its last")
            begin = 0
            for word, end in zip(part, ends, strict=True):
                self._keep(word, ids[begin:end].tobytes())
                begin = end

    def _learn(self, words: list[bytes]) -> None:
        """Have all these words in the younger generation."""
        if len(self.young) > KEPT_WORDS or self.held > KEPT_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        new, sided, again = set(), [], self.old.get
        for word in set(words).difference(self.young):
            ids = again(word)
            if ids is not None:
                self._keep(word, ids)
            elif not word.isalpha() and (sides := _sided(word)):
                sided.append((word, sides[1], sides[2]))
            else:
                new.add(word)
        for side in {x for _, *sides in sided for x in sides}.difference(self.young, new):
            ids = again(side)
            if ids is not None:
                self._keep(side, ids)
            else:
                new.add(side)
        plain, others = [], []
        for word in new:
            (plain if word.isalpha() or _plain(word) else others).append(word)
        self._joined(plain)
        for at in range(0, len(others), 2000):
            part = others[at : at + 2000]
            for word, ids in zip(part, self._coded([w.decode() for w in part]), strict=True):
                self._keep(word, ids.tobytes())
        for word, left, right in sided:
            self._keep(word, self.young[left] + self.young[right])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), one after the other, and how many each has."""
        if not self.by_words:
            coded = self._coded(texts.to_pylist())
            return np.concatenate([np.zeros(0, dtype=f"<u{self.width}"), *coded]), np.array([len(c) for c in coded], dtype=np.int64)
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        words, place = found.dictionary.cast(pa.binary()).to_pylist(), found.indices.to_numpy()
        self._learn(words)
        coded = list(map(self.young.__getitem__, words))
        size = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // self.width
        pool, begin, n = np.frombuffer(b"".join(coded), dtype=f"<u{self.width}"), np.cumsum(size) - size, size[place]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.arange(ends[-1]) + np.repeat(begin[place] - ends[:-1], n)]
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return ids, np.diff(ends[offsets])


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
        give_back()
    return _loaded[path]


def _some(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of texts, null as empty, of about TOGETHER bytes or one text."""
    column = column.fill_null("")
    ends, at = np.cumsum(pc.binary_length(column).to_numpy()), 0
    while at < len(column):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + TOGETHER, side="right")))
        yield at, column.slice(at, to - at)
        at = to


def _writing(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, name, files = None, uuid.uuid4().hex, []
        docs = nulls = tokens = 0
        try:
            for batch in batches:
                for at, texts in _some(batch.column("text")):
                    if not files:
                        coder = encoder(path)
                        store, place = pa.fs.FileSystem.from_uri(folder)
                        store.create_dir(place, recursive=True)
                        files = [store.open_output_stream(f"{place}/{name}.{kind}", compression=None) for kind in ("bin", "idx", "ids")]
                        files[1].write(np.zeros(1, dtype="<i8").tobytes())
                    coded, size = coder.encode(texts)
                    names = batch.column("doc_id").slice(at, len(texts))
                    ends = tokens + np.cumsum(size + 1)
                    files[0].write(np.insert(coded, np.cumsum(size), end).tobytes())
                    files[1].write(ends.astype("<i8").tobytes())
                    files[2].write(names.fill_null(0).to_numpy().astype("<i8").tobytes())
                    docs, nulls, tokens = docs + len(texts), nulls + names.null_count, int(ends[-1])
        finally:
            for file in files:
                file.close()
        if docs:
            row = {"shard": TaskContext.get().partitionId(), "file": f"{folder}/{name}", "width": coder.width, "docs": docs, "nulls": nulls, "tokens": tokens}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_token_files(documents: DataFrame, folder: str | None = None, path: str | None = None, end: int = END) -> DataFrame:
    """The committed manifest of the shards of all `documents` (``doc_id, text``), written to a folder (a whole URI).

    MANIFEST's columns, with ``base`` and ``doc_base``: ids and documents in the shards before.  Without a folder the
    files are temporary: they go with the tables of the shared folder.
    """
    spark = documents.sparkSession
    folder = folder or temporary(spark, "tokens")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    sorted_ = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    shards = written(sorted_.mapInArrow(giving_back(_writing(folder, path or vocabulary_path("word_bpe_49k.json"), end)), MANIFEST), "shards")
    # one row for each shard: prefix sums in one task
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("tokens", "base"), ("docs", "doc_base"))])
    manifest = written(based, "manifest")
    dropped(shards)
    return manifest


def mapped(uri: str, kind: str) -> np.ndarray:
    """A flat file as an array: mapped into memory where it lies in a mounted file system, else read."""
    store, path = pa.fs.FileSystem.from_uri(uri)
    if isinstance(store, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype=kind)


class Shard:
    """One shard of token files: ``shard[i]`` are the ids of its i-th document."""

    def __init__(self, file: str, width: int):
        self.tokens, self.offsets, self.doc_ids = mapped(f"{file}.bin", f"<u{width}"), mapped(f"{file}.idx", "<i8"), mapped(f"{file}.ids", "<i8")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def _reading(value, kind: pa.DataType, name: str):
    """Documents of shards with ``doc_id, start, n_tokens`` and what `value` makes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["file"], row["width"])
                if len(shard) != row["docs"] or len(shard.tokens) != row["tokens"]:
                    raise ValueError(f"shard {row['file']} is not what its manifest says")
                to = 0
                while to < len(shard):
                    at, most = to, int(np.searchsorted(shard.offsets, shard.offsets[to] + IDS, side="right")) - 1
                    to = min(len(shard), at + DOCUMENTS, max(at + 1, most))
                    offsets, ids = np.asarray(shard.offsets[at : to + 1]), np.asarray(shard.doc_ids[at:to])
                    gone = np.arange(at, to) < row["nulls"]
                    made = [value(shard[i]) for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=gone), pa.array(row["base"] + offsets[:-1], pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(made, kind)], ["doc_id", "start", "n_tokens", name])

    return run


def _dealt(manifest: DataFrame) -> DataFrame:
    """A task for each shard: its row is small but stands for a large read."""
    return manifest.select("file", "width", "docs", "nulls", "tokens", "base").repartition(max(1, manifest.count()))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, from the files."""
    return _dealt(manifest).mapInArrow(_reading(lambda ids: ids.astype(np.int32), pa.list_(pa.int32()), "ids"), "doc_id long, start long, n_tokens long, ids array<int>")


def token_file_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Write all documents, read the files back: ``doc_id, start, n_tokens, ids_crc32``."""
    manifest = write_token_files(documents, path=path)
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return _dealt(manifest).mapInArrow(giving_back(_reading(crc, pa.int64(), "ids_crc32")), "doc_id long, start long, n_tokens long, ids_crc32 long")

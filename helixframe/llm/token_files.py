r"""Token-id output in canonical, length-limited Huffman code.

Encoding.  Texts are range-partitioned and sorted by doc_id and encoded with a
``tokenizers`` file; each document ends with id ``END``.  Global id counts give a
Huffman code whose lengths are limited to ``LIMIT`` bits (package-merge); code
words are canonical, so the lengths alone describe the code.

File format.  ``<path>/code`` holds one row, the code lengths by id.
``<path>/blocks`` is a Parquet data set with one row per block: ``part`` and
``seq`` (place in the order), ``start`` (ids before the block in its part) and
``block``, a byte string::

    4 bytes   magic "HXT1"
    u32       number of documents D, number of ids N, number of checkpoints C
    D x i64   doc_id, with a bit set D of flags before it (1 = the id is null)
    D x u32   ids per document
    C x u32   bit offset of every STRIDE-th id
    rest      code words, most significant bit first

(all integers little-endian).  Blocks hold whole documents, about ``BLOCK`` ids,
and decode independently: every checkpoint starts a lane, and all lanes step
through the table of 2**LIMIT entries together.

Defined results: a null text is empty and has the single id ``END``; null doc_ids
sort first; rows with equal doc_ids follow each other in the order of a hash of
the text; further columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import dropped, shared_path, small_batches, stored
from .wordcache import WordCache, ragged
from .words import text_slices, words_of

END = 2
LIMIT = 16
BLOCK = 1 << 18
STRIDE = 256
MAGIC = b"HXT1"

# --- encoding texts ------------------------------------------------------------

# The parts of a tokenizer file for which words can be encoded one by one.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

#: Marks that never join letters in one pre-token.
_STOPS = ".,;:!?%*&$#|"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


@lru_cache(maxsize=2)
def _byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers use for each byte: itself if visible, else the next free one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, free = [""] * 256, 256
    for b in range(256):
        if b in visible:
            letters[b] = chr(b)
        else:
            letters[b], free = chr(free), free + 1
    return letters


def _by_words(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and writes bytes as letters as the shortcuts below take it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split, letters = steps if len(steps) == 2 else ({}, {})
    added = [t["content"] for t in spec.get("added_tokens") or [] if not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
    return (
        spec.get("normalizer") == WORD_NORMALIZER
        and split == {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        and letters.get("type") == "ByteLevel"
        and not letters.get("add_prefix_space")
        and not letters.get("use_regex")
        and len(added) == len(spec.get("added_tokens") or [])
        and all(not t[-1].isalpha() and t[-1] not in _STOPS and not re.search(r"\s", t) for t in added)
    )


class Encoder:
    """Whole texts to ids through a ``tokenizers`` file.

    Where the file says that no token crosses white space (``_by_words``), words
    are encoded one by one and remembered; with any other file, whole texts are
    encoded.  A word of Latin letters is one pre-token and goes straight to
    the model; a trailing run of stops after a letter is a pre-token of its own; all others take the whole pipeline.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = _by_words(json.loads(self.tokenizer.to_str()))
        self.words, self.parts = WordCache(self._split), WordCache(self._encode)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _encode(self, words: list[str]) -> list[list[int]]:
        letters = _byte_letters()
        out: list[list[int] | None] = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if _LETTERS.fullmatch(w):
                low = w.lower()
                if not low.isascii():
                    low = "".join(letters[b] for b in low.encode())
                out[i] = [t.id for t in self.model.tokenize(low)]
            else:
                rest.append(i)
        if rest:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _split(self, words: list[str]) -> list[bytes]:
        """Ids of words through their parts: the word in lower case, and a run of stops after a letter."""
        parts: dict[str, int] = {}
        places = []
        for word in words:
            core = word.rstrip(_STOPS)
            tail = -1
            if core and core != word and core[-1].isalpha():
                tail = parts.setdefault(word[len(core) :], len(parts))
                word = core
            if _LETTERS.fullmatch(word):
                word = word.lower()
            places.append((parts.setdefault(word, len(parts)), tail))
        ids = self.parts.ids(list(parts))
        return [ids[a] if b < 0 else ids[a] + ids[b] for a, b in places]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, ``END`` after each text, and the number of ids of each text."""
        if not self.by_words:
            lists = [e.ids + [END] for e in self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in lists for i in ids], np.uint32), np.array([len(ids) for ids in lists], np.int64)
        w = words_of(texts)
        ids = self.words.ids(w.distinct.to_pylist())
        ids.append(np.array([END], np.uint32).tobytes())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        codes = np.insert(w.codes, w.bounds[1:], len(ids) - 1)
        out, n = ragged(np.frombuffer(b"".join(ids), np.uint32), lengths, codes)
        ends = np.concatenate([[0], np.cumsum(n)])[w.bounds[1:] + np.arange(1, len(texts) + 1)]
        return out, np.diff(ends, prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- the code ------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each id's code word, 0 for ids that do not occur; optimal under the limit (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if not len(used):
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit code words of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    # Of each level only which of its sorted items are leaves matters afterwards.
    levels = []
    items, leaf = weights, np.ones(n, bool)
    levels.append(leaf)
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weights, pairs])
        rank = np.argsort(merged, kind="stable")
        items, leaf = merged[rank], rank < n
        levels.append(leaf)
    take = 2 * (n - 1)
    depth = np.zeros(n, np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words: by length, then id."""
    words = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)).tolist():
        n = int(lengths[i])
        if n:
            code <<= n - last
            words[i], last = code, n
            code += 1
    return words


def packed(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit string of the ids, and the bit offset of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    byte = at >> 3
    value = words[ids].astype(np.int64) << (24 - n - (at & 7))
    size = int(ends[-1] + 7 >> 3) + 3 if len(ids) else 0
    out = np.zeros(size)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, value >> shift & 255, size)
    return out.astype(np.uint8).tobytes()[: int(ends[-1] + 7 >> 3) if len(ids) else 0], at[::STRIDE].astype(np.uint32)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every LIMIT-bit prefix the id it begins with and the length of its code word."""
    ids, size = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
    words = code_words(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(words[used].astype(np.int64) << (LIMIT - lengths[used].astype(np.int64)))]
    span = 1 << (LIMIT - lengths[used].astype(np.int64))
    ids[: span.sum()] = np.repeat(used, span)
    size[: span.sum()] = np.repeat(lengths[used], span)
    return ids, size


def unpacked(streams: list[tuple[bytes, np.ndarray, int]], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of many blocks (bits, checkpoints, number of ids) in turn, all lanes stepping together."""
    table_ids, table_size = table
    at, want, base = [], [], 0
    for bits, marks, n in streams:
        at.append(marks.astype(np.int64) + 8 * base)
        want.append(np.minimum(STRIDE, n - STRIDE * np.arange(len(marks))))
        base += len(bits)
    raw = np.frombuffer(b"".join(s[0] for s in streams) + b"\0\0\0", np.uint8).astype(np.uint32)
    three = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    at, want = np.concatenate(at), np.concatenate(want)
    out = np.zeros((len(at), STRIDE), np.uint32)
    short = want.min() if len(want) else 0
    live = np.arange(len(at))
    for step in range(int(want.max()) if len(want) else 0):
        if step >= short:
            live = live[want[live] > step]
        p = at[live]
        prefix = three[p >> 3] >> (8 - (p & 7)).astype(np.uint32) & np.uint32(0xFFFF)
        out[live, step] = table_ids[prefix]
        at[live] = p + table_size[prefix]
    return out[np.arange(STRIDE) < want[:, None]]


# --- blocks --------------------------------------------------------------------


def block_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> bytes:
    bits, marks = packed(ids, lengths, words)
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    return b"".join(
        [MAGIC, struct.pack("<3I", len(doc_ids), len(ids), len(marks)), null.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype("<u4").tobytes(), marks.astype("<u4").tobytes(), bits]
    )


def block_parts(block: bytes) -> tuple[list[int | None], np.ndarray, tuple[bytes, np.ndarray, int]]:
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    docs, n, c = struct.unpack_from("<3I", block, 4)
    at = 16 + (docs + 7) // 8
    null = np.unpackbits(np.frombuffer(block, np.uint8, at - 16, 16))[:docs]
    ids = [None if x else int(d) for d, x in zip(np.frombuffer(block, "<i8", docs, at), null, strict=True)]
    counts = np.frombuffer(block, "<u4", docs, at + 8 * docs)
    marks = np.frombuffer(block, "<u4", c, at + 12 * docs)
    return ids, counts, (block[at + 12 * docs + 4 * c :], marks, n)


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """part, seq, start, doc_id, ids (32-bit, or 16-bit where the vocabulary allows) in the order of doc_id."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        e = encoder(tokenizer)
        kind = np.uint16 if e.vocabulary <= 1 << 16 else np.uint32
        for batch in text_slices(batches):
            ids, n = e.texts(batch.column("text"))
            ids = ids.astype(kind)
            ends = np.cumsum(n)
            width = kind().itemsize
            offsets = pa.py_buffer(np.concatenate([[0], ends * width]).astype(np.int32).tobytes())
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int64)), pa.array(seq + np.arange(len(n), dtype=np.int64)), pa.array((start + ends - n).astype(np.int64)), batch.column("doc_id").cast(pa.int64()), binary, pa.array(np.full(len(n), width, np.int32))],
                names=["part", "seq", "start", "doc_id", "ids", "width"],
            )
            seq += len(n)
            start += int(ends[-1])

    return rows.mapInArrow(encode, "part long, seq long, start long, doc_id long, ids binary, width int")


def _ids(buffer: bytes, width: int) -> np.ndarray:
    return np.frombuffer(buffer, np.uint16 if width == 2 else np.uint32)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[int | None], list[np.ndarray]]]:
    """Runs of consecutive documents of one part with about BLOCK ids."""
    head, docs, ids, size, last = None, [], [], 0, None
    for batch in batches:
        for part, seq, start, doc, raw, width in zip(*(batch.column(n).to_pylist() for n in ("part", "seq", "start", "doc_id", "ids", "width")), strict=True):
            if docs and (size >= BLOCK or last != (part, seq - 1)):
                yield *head, docs, ids
                docs, ids, size = [], [], 0
            if not docs:
                head = (part, seq, start)
            docs.append(doc)
            ids.append(_ids(raw, width))
            size += len(ids[-1])
            last = (part, seq)
    if docs:
        yield *head, docs, ids


def write(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Encode all texts and write them in the file format."""
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, tokenizer), "token-ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, width in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
                n = np.bincount(_ids(raw, width), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    # At most one row per entry of the vocabulary comes to the driver.
    rows = tokens.select("ids", "width").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([END, *(r["id"] for r in rows)]), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = code_words(lengths)
        for part, seq, start, docs_, ids in _runs(batches):
            block = block_bytes(docs_, np.array([len(x) for x in ids]), np.concatenate(ids), lengths, words)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([start], pa.int64()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([block], pa.binary())], names=["part", "seq", "start", "n_ids", "block"])

    tokens.mapInArrow(blocks, "part long, seq long, start long, n_ids long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    dropped(spark, tokens)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids, 32-bit little-endian) of every document in the file."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    schema = "part long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for first in range(0, batch.num_rows, 8):
                some = batch.slice(first, 8)
                parts = [block_parts(b) for b in some.column("block").to_pylist()]
                ids = unpacked([p[2] for p in parts], table).astype("<u4")
                counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                starts = np.concatenate([s + np.cumsum(p[1].astype(np.int64)) - p[1] for s, p in zip(some.column("start").to_pylist(), parts, strict=True)])
                columns = [
                    pa.array(np.repeat(some.column("part").to_numpy(), [len(p[0]) for p in parts])),
                    pa.array([d for p in parts for d in p[0]], pa.int64()),
                    pa.array(starts.astype(np.int64)),
                    pa.array(counts),
                    pa.array([zlib.crc32(x) for x in pieces], pa.int64()),
                ] + [pa.array([bytes(x) for x in pieces], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    small_batches(spark, 64)
    blocks = spark.read.parquet(f"{path}/blocks")
    docs = blocks.select("part", "start", "block").mapInArrow(decode, schema)
    # One row per part (a task of the writer).
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rest = ["n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return docs.join(parts, "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), *rest)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = shared_path(docs.sparkSession, "token-file")
    write(docs, tokenizer, path)
    return read(docs.sparkSession, path)

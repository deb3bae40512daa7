r"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model's protobuf is parsed here (wire format only).  From it a
``tokenizers`` pipeline is rebuilt: the normaliser (identity, collapsed spaces,
dummy prefix, metaspace marker), the scores (a unigram model takes them as they
are, a BPE model takes merges ranked by the score of the merged piece) and byte
fallback.  Control, unknown and byte pieces never stand for text that spells their
names; user-defined pieces are found first, the longest at each place.

Texts are cut where no piece can reach across: between two characters that are
neighbours in no piece (before a marker, at line ends).  Each distinct cut is
encoded once per worker by a multithreaded batch call and remembered.  Decoding
gathers the bytes of all pieces at once.  Every text is encoded again with the
sentencepiece library and compared.

Defined results: a null or empty text has no ids and decodes to nothing; equal
rows give equal ids; further columns are ignored; an empty table gives none.
Normalisation other than identity (a precompiled character map) and BPE models
with unused pieces are refused.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import small_batches
from .wordcache import WordCache, ragged
from .words import filled, text_slices

MARK = "▁"

#: Cuts that a worker remembers in each of two generations.
UNITS = 120_000

# Fixed values of the model format: kinds of pieces and models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


@dataclass(frozen=True)
class Model:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    algorithm: int
    byte_fallback: bool
    dummy_prefix: bool
    collapse_spaces: bool

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)


def parsed_model(data: bytes) -> Model:
    pieces, scores, kinds = [], [], []
    trainer: dict[int, int | bytes] = {}
    normalizer: dict[int, int | bytes] = {}
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    if normalizer.get(2):
        raise ValueError(f"normalisation {normalizer.get(1)!r} needs its character map; only identity is supported")
    return Model(tuple(pieces), tuple(scores), tuple(kinds), trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def normalizer(model: Model):
    """The model's normaliser: spaces collapsed, the prefix added, markers in place of spaces."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" +"), " ")] if model.collapse_spaces else []
    steps += [normalizers.Prepend(MARK)] if model.dummy_prefix else []
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def rebuilt(model: Model):
    """A ``tokenizers`` tokenizer for normalised text (markers in place of spaces) without user-defined symbols."""
    from tokenizers import Tokenizer, models

    if model.algorithm == UNIGRAM:
        # Normalised text has no space, so a name that begins with one matches nothing.  Unknown characters become bytes in ``Codec``.
        names = [p if k == NORMAL else f" {i}" for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True))]
        return Tokenizer(models.Unigram(list(zip(names, model.scores, strict=True)), model.unknown, False))
    if model.algorithm != BPE or UNUSED in model.kinds:
        raise ValueError("only unigram models and BPE models without unused pieces are supported")
    ids = {p: i for i, p in enumerate(model.pieces)}
    usable = {p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL}
    merges = []
    for piece in usable:
        for cut in range(1, len(piece)):
            if piece[:cut] in usable and piece[cut:] in usable:
                merges.append((-model.scores[ids[piece]], ids[piece[:cut]], ids[piece[cut:]], piece[:cut], piece[cut:]))
    merges.sort()
    return Tokenizer(models.BPE(ids, [m[3:] for m in merges], unk_token=model.pieces[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback))


class Codec:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        with open(path, "rb") as file:
            self.model = parsed_model(file.read())
        self.path = path
        self.tokenizer = rebuilt(self.model)
        self.normalizer = normalizer(self.model)
        self.cache = WordCache(self._encoded, UNITS)
        self.ids = {p: i for i, p in enumerate(self.model.pieces)}
        defined = sorted((p.replace(" ", MARK) for p, k in zip(self.model.pieces, self.model.kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)
        self.defined = re.compile(f"({'|'.join(map(re.escape, defined))})") if defined else None
        pairs = {p[i : i + 2] for p, k in zip(self.model.pieces, self.model.kinds, strict=True) if k in (NORMAL, USER_DEFINED) for i in range(len(p) - 1)}
        self.pairs = pairs
        spoken = {c for p in pairs for c in p}
        #: Whether a marker after another character, a line end, or a trailing stop is always a cut.
        self.cut_marks = not any(p[1] == MARK and p[0] != MARK for p in pairs)
        self.cut_lines = "\n" not in spoken and self.model.byte_fallback
        texts = []
        for piece, kind in zip(self.model.pieces, self.model.kinds, strict=True):
            texts.append(b"" if kind == CONTROL else bytes([int(piece[3:5], 16)]) if kind == BYTE else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode())
        self.piece_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.piece_sizes = np.array([len(t) for t in texts], np.int64)
        self.is_byte = np.array([k == BYTE for k in self.model.kinds])

    # --- encoding ---

    def _encoded(self, units: list[str]) -> list[list[int]]:
        """The ids of units, which hold a user-defined symbol whole or none."""
        out: list[list[int]] = [[self.ids[u]] if self.defined and self.defined.fullmatch(u) else [] for u in units]
        rest = [i for i, ids in enumerate(out) if not ids]
        unigram = self.model.algorithm == UNIGRAM
        encode = self.tokenizer.encode_batch if unigram else self.tokenizer.encode_batch_fast
        for i, e in zip(rest, encode([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
            if unigram and self.model.byte_fallback and self.model.unknown in e.ids:
                spelled = zip(e.ids, e.offsets, strict=True)
                out[i] = [x for n, (a, b) in spelled for x in ([n] if n != self.model.unknown else [self.ids[f"<0x{c:02X}>"] for c in units[i][a:b].encode()])]
        return out

    def _units(self, text: str) -> list[str]:
        """The cuts of one normalised text."""
        if self.defined:
            return [u for k, part in enumerate(self.defined.split(text)) if part for u in ([part] if k % 2 else self._plain_units(part))]
        return self._plain_units(text)

    def _plain_units(self, text: str) -> list[str]:
        if not self.cut_marks:
            return [text] if text else []
        lines = re.split("(\n)", text) if self.cut_lines else [text]
        return [u for line in lines if line for u in (re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", line) if line != "\n" else [line])]

    def _parts(self, word: str) -> list[str]:
        """The cuts of a marked word: at line ends, and before a trailing run of stops that no piece reaches into."""
        out = []
        for unit in re.split("(\n)", word) if self.cut_lines and "\n" in word else [word]:
            if unit:
                core = unit.rstrip(".,")
                if core and len(core) < len(unit) and core[-1] + unit[len(core)] not in self.pairs:
                    out += [core, unit[len(core) :]]
                else:
                    out.append(unit)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in turn and the number of ids of each text."""
        texts = filled(texts)
        odd = pc.match_substring_regex(texts, f"^ | $|  |{MARK}|^$").to_numpy(zero_copy_only=False)
        if self.defined or not (self.cut_marks and self.model.dummy_prefix):
            odd = np.ones(len(texts), bool)
        units: dict[str, int] = {}
        flat, n_units = [], []
        if not odd.all():
            split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
            coded = split.flatten().dictionary_encode()
            lists = [[units.setdefault(u, len(units)) for u in self._parts(MARK + w)] for w in coded.dictionary.to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            codes, n = ragged(np.array([c for x in lists for c in x], np.int64), sizes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            words = np.diff(split.offsets.to_numpy())
            flat.append(codes)
            n_units.append(np.bincount(np.repeat(np.arange(len(words)), words), n, len(words)).astype(np.int64))
        if odd.any():
            lists = [[units.setdefault(u, len(units)) for u in self._units(self.normalizer.normalize_str(t))] for t in texts.filter(pa.array(odd)).to_pylist()]
            flat.append(np.array([c for x in lists for c in x], np.int64))
            n_units.append(np.array([len(x) for x in lists], np.int64))
        ids, per_unit = self.cache.gathered(list(units), np.concatenate(flat) if flat else np.zeros(0, np.int64))
        of_text = np.concatenate(n_units) if n_units else np.zeros(0, np.int64)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        n = np.bincount(np.repeat(np.arange(len(order)), of_text), per_unit, len(order)).astype(np.int64)
        if not odd.any() or odd.all():
            return ids, n
        back = np.argsort(order)
        return ragged(ids, n, back)

    # --- decoding ---

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids."""
        raw, n = ragged(self.piece_bytes, self.piece_sizes, ids.astype(np.int64))
        of_text = np.bincount(np.repeat(np.arange(len(counts)), counts), n, len(counts)).astype(np.int64)
        ends = np.cumsum(of_text)
        data = raw.tobytes()
        skip = 1 if self.model.dummy_prefix else 0
        return [data[e - k + (skip if k and data[e - k : e - k + 1] == b" " else 0) : e] for e, k in zip(ends.tolist(), of_text.tolist(), strict=True)]

    @property
    def reference(self):
        import sentencepiece

        if not hasattr(self, "_reference"):
            self._reference = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._reference


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SCHEMA = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, exact boolean, parity boolean"


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte-fallback ids), ids_crc32 (ids as 32-bit little-endian), exact (decoding gives the
    text back), parity (the ids equal those of the sentencepiece library), and with ``with_ids`` the ids as a byte string."""
    small_batches(docs.sparkSession)
    schema = SCHEMA + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in text_slices(batches):
            texts = filled(batch.column("text"))
            ids, n = c.encode(texts)
            ends = np.cumsum(n)
            raw = memoryview(ids.astype("<u4").tobytes())
            pieces = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            plain = texts.cast(pa.binary()).to_pylist()
            exact = [a == b.replace(MARK.encode(), b" ") for a, b in zip(c.decode(ids, n), plain, strict=True)]
            parity = [np.array_equal(c.reference.encode(t.decode()), ids[e - k : e]) for t, e, k in zip(plain, ends.tolist(), n.tolist(), strict=True)]
            fallback = np.bincount(np.repeat(np.arange(len(n)), n), c.is_byte[ids], len(n)).astype(np.int64)
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(fallback), pa.array([zlib.crc32(p) for p in pieces], pa.int64()), pa.array(exact, pa.bool_()), pa.array(parity, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([bytes(p) for p in pieces], pa.binary())] * with_ids, names=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ``ids`` as written by ``encoded``."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in text_slices(batches, "ids"):
            raw = [np.frombuffer(x or b"", "<u4") for x in batch.column("ids").to_pylist()]
            texts = c.decode(np.concatenate(raw), np.array([len(x) for x in raw]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col("doc_id"), F.col("ids")).mapInArrow(run, "doc_id long, text string")

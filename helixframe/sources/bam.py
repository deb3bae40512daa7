"""BAM files: a Python data source that decodes blocked gzip and alignment records.

One file is one partition; records are decoded in the task that reads them.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of the format's packed codes.
CIGAR_OPS = "MIDNSHP=X"
BASE_CODES = "=ACMGRSVTWYHKDBN"

SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, quals array<int>"


def records(data: bytes) -> Iterator[tuple]:
    """Decoded records of one file's bytes."""
    raw = gzip.decompress(data)  # blocked gzip is a series of gzip members
    if raw[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    (text,) = struct.unpack_from("<i", raw, 4)
    at = 8 + text
    (n_ref,) = struct.unpack_from("<i", raw, at)
    at += 4
    names = []
    for _ in range(n_ref):
        (size,) = struct.unpack_from("<i", raw, at)
        names.append(raw[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(raw):
        (size,) = struct.unpack_from("<i", raw, at)
        ref, pos, name_len, mapq, _, n_ops, flag, n = struct.unpack_from("<iiBBHHHi", raw, at + 4)
        p = at + 36
        name = raw[p : p + name_len - 1].decode()
        p += name_len
        cigar = "".join(f"{x >> 4}{CIGAR_OPS[x & 15]}" for x in struct.unpack_from(f"<{n_ops}I", raw, p))
        p += 4 * n_ops
        packed = raw[p : p + (n + 1) // 2]
        seq = "".join(BASE_CODES[b >> 4] + BASE_CODES[b & 15] for b in packed)[:n]
        p += (n + 1) // 2
        yield name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq, list(raw[p : p + n])
        at += 4 + size


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files that match a path, through Spark's binary file source."""
    rows = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches):
        import pandas as pd

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for content in batch["content"]:
                chunk = []
                for r in records(content):
                    chunk.append(r)
                    if len(chunk) == 4096:
                        yield pd.DataFrame(chunk, columns=names)
                        chunk = []
                if chunk:
                    yield pd.DataFrame(chunk, columns=names)

    return rows.mapInPandas(decode, SCHEMA)


def in_region(df: DataFrame, contig: str, start: int, stop: int) -> DataFrame:
    return df.where((F.col("rname") == contig) & (F.col("pos") > start) & (F.col("pos") <= stop))

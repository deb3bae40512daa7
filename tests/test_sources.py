import gzip
import struct

from pyspark.sql import functions as F

from helixframe.sources import bam, records


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_fasta_round_trip(spark, tmp_path):
    path = write(tmp_path, "a.fa", ">one first > second\nACGT\nAC\n>two\nTTTT\n")
    rows = records.read_fasta(spark, path)
    assert {(r["name"], r["seq"]) for r in rows.collect()} == {("one", "ACGTAC"), ("two", "TTTT")}
    records.write_fasta(rows.coalesce(1), str(tmp_path / "out"), width=4)
    again = records.read_fasta(spark, str(tmp_path / "out"))
    assert {(r["name"], r["seq"]) for r in again.collect()} == {("one", "ACGTAC"), ("two", "TTTT")}
    assert records.illegal_bases(rows).count() == 0


def test_fastq_round_trip(spark, tmp_path):
    path = write(tmp_path, "a.fq", "@r1\nACG\n+\nI!#\n@r2\nT\n+\n5\n")
    rows = records.read_fastq(spark, path)
    want = {("r1", "ACG", (40, 0, 2)), ("r2", "T", (20,))}
    assert {(r["name"], r["seq"], tuple(r["quals"])) for r in rows.collect()} == want
    records.write_fastq(rows.coalesce(1), str(tmp_path / "out"))
    assert {(r["name"], r["seq"], tuple(r["quals"])) for r in records.read_fastq(spark, str(tmp_path / "out")).collect()} == want


def test_sam_tags_blocks_and_coverage(spark, tmp_path):
    path = write(tmp_path, "a.sam", "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:99\nq\t16\tc1\t5\t60\t2S3M1D2M\t*\t0\t0\tACGTACG\tIIIIIII\tNM:i:1\tRG:Z:a:b\n")
    rows = records.read_sam(spark, path)
    r = rows.withColumn("b", records.cigar_blocks(F.col("cigar"))).first()
    assert r["tags"] == {"NM": "i:1", "RG": "Z:a:b"} and r["pos"] == 5
    assert [tuple(x) for x in r["b"]] == [("S", 2, 0, 0), ("M", 3, 2, 0), ("D", 1, 5, 3), ("M", 2, 5, 4)]
    assert {(x["start"], x["stop"]) for x in records.sam_coverage(rows).collect()} == {(4, 7), (8, 10)}
    assert {h["kind"] for h in records.sam_header(spark, path).collect()} == {"HD", "SQ"}


def test_vcf_and_concordance(spark, tmp_path):
    path = write(tmp_path, "a.vcf", "##x\n#CHROM\n1\t7\t.\tA\tC,G\t9.5\tPASS\tDP=3;DB\tGT:DP\t0/1:5\n")
    r = records.read_vcf(spark, path).first()
    assert r["alts"] == ["C", "G"] and r["info"] == {"DP": "3", "DB": None} and r["samples"] == [{"GT": "0/1", "DP": "5"}]
    records.write_vcf(records.read_vcf(spark, path), str(tmp_path / "out"))
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))).splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and lines[1].startswith("#CHROM\tPOS") and len(lines) == 3
    assert lines[2] == "1\t7\t.\tA\tC,G\t9.5\tPASS\tDP=3;DB"
    assert records.read_vcf(spark, str(tmp_path / "out")).first()["info"] == r["info"]


def test_alignment_lines(spark, tmp_path):
    r = records.read_alignments(spark, write(tmp_path, "a.qlt", "x\nQUERY\t1\t0\t5\t5\t0\t2\t10\t15\t99\t2\t0\t2\t0\t1\t2\t1\n")).first()
    assert (r["query_id"], r["target_id"], r["n_blocks"]) == (1, 2, 2) and [tuple(b) for b in r["blocks"]] == [(0, 2, 0), (1, 2, 1)]


def test_intervals_bed_efasta_and_vectors(spark, tmp_path):
    r = records.read_intervals(spark, write(tmp_path, "a.iv", "17:11-20\n")).first()
    assert tuple(r) == ("17", 10, 20)
    bed = records.read_bed(spark, write(tmp_path, "a.bed", "track x\n17\t10\t20\tn\n"))
    assert records.bed_to_intervals(bed).first()["value"] == "17:11-20"
    e = spark.range(1).select(F.lit("AC{A,C,}GT").alias("s"))
    assert e.select(records.parsed_efasta(F.col("s"))).first()[0] == [["AC"], ["A", "C", ""], ["GT"]]
    assert e.select(records.flattened_efasta(F.col("s"))).first()[0] == "ACAGT"
    assert [x["value"] for x in records.read_vector(spark, write(tmp_path, "v", "3\n1 2\n5\n")).orderBy("place").collect()] == [1.0, 2.0, 5.0]


def test_bam_records(spark, tmp_path):
    name, seq = b"read1\0", "ACGTN"
    codes = [bam.BASE_CODES.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, 6, 2))
    body = struct.pack("<iiBBHHHiiii", 0, 6, len(name), 60, 0, 1, 0, len(seq), -1, -1, 0) + name + struct.pack("<I", 5 << 4) + packed + bytes([30] * 5)
    raw = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99) + struct.pack("<i", len(body)) + body
    (tmp_path / "a.bam").write_bytes(gzip.compress(raw[:20]) + gzip.compress(raw[20:]))
    r = bam.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (r["qname"], r["rname"], r["pos"], r["cigar"], r["seq"], r["quals"]) == ("read1", "c1", 7, "5M", "ACGTN", [30] * 5)

import bz2
import gzip
import random
import struct
import subprocess
import zlib

import pytest

from varloom.operators import genes
from varloom.sources import fasta, lines, tables, vcf


def bgzf(text: bytes, block: int = 700) -> bytes:
    out = b""
    for at in [*range(0, len(text), block), None]:
        part = b"" if at is None else text[at : at + block]
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def lzw(text: bytes, widest: int = 16) -> bytes:
    """What compress(1) writes: codes in groups of eight of one width, padded where the width changes."""
    table, width, codes, out, word = {bytes([i]): i for i in range(256)}, 9, [], bytearray(b"\x1f\x9d" + bytes([128 | widest])), b""
    nxt = 257

    def flush(whole):
        while len(codes) >= 8 or (codes and whole):
            group = codes[:8]
            del codes[:8]
            bits = sum(c << (width * i) for i, c in enumerate(group))
            out.extend(bits.to_bytes(width if whole != "end" else (len(group) * width + 7) // 8, "little"))

    for b in (text[i : i + 1] for i in range(len(text))):
        if word + b in table:
            word += b
            continue
        codes.append(table[word])
        flush(False)
        if nxt < 1 << widest:
            table[word + b] = nxt
            nxt += 1
            if nxt > 1 << width and width < widest:
                flush("width")
                width += 1
        word = b
    if word:
        codes.append(table[word])
    flush("end")
    return bytes(out)


def text(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice("abc é東\t#>@") for _ in range(draw.choice([0, 0, 1, 5, 40, 3000 if draw.random() < 0.03 else 20]))) for _ in range(n)]


def plain(rows, last=True):
    return ("\n".join(rows) + ("\n" if last else "")).encode()


@pytest.mark.parametrize("packed", [lambda x: x, bgzf, gzip.compress, lambda x: gzip.compress(x[:999]) + gzip.compress(x[999:]), bz2.compress, lzw])
@pytest.mark.parametrize("last", [True, False])
def test_lines_of_every_kind(spark, tmp_path, packed, last):
    rows = [r for r in text(600)] + ["end"]
    (tmp_path / "a.dat").write_bytes(packed(plain(rows, last)))
    got = lines.lines(spark, str(tmp_path / "a.dat"), 2000)
    assert [r.value for r in got.orderBy("pos").collect()] == rows


@pytest.mark.parametrize("packed", [lambda x: x, bgzf])
@pytest.mark.parametrize("size", [1, 7, 64, 700, 5000])
def test_lines_over_boundaries(tmp_path, packed, size):
    rows = [r for r in text(120, 3)] + ["z"]
    path = tmp_path / "a"
    path.write_bytes(packed(plain(rows)))
    n = path.stat().st_size
    reader = lines._Reader({"files": f'[["file://{path}", {n}]]', "splitbytes": str(size)})
    parts = [[(p, v) for b in reader.read(s) for p, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist())] for s in reader.partitions()]
    assert [v for _, v in sorted(x for p in parts for x in p)] == rows


def test_blocked_files_are_split(spark, tmp_path):
    rows = [f"chr1\t{i}\t{i + 5}" for i in range(20_000)]
    (tmp_path / "a.bed.gz").write_bytes(bgzf(plain(rows), 5000))
    d = lines.lines(spark, str(tmp_path / "a.bed.gz"), 8000)
    assert d.rdd.getNumPartitions() > 5 and sorted(r.value for r in d.collect()) == sorted(rows)
    assert tables.bed(spark, str(tmp_path / "a.bed.gz")).count() == len(rows)


def test_damaged_blocks_are_told(tmp_path):
    raw = bytearray(bgzf(plain(["abc"] * 1000)))
    raw[60] ^= 255
    (tmp_path / "a").write_bytes(raw)
    reader = lines._Reader({"files": f'[["file://{tmp_path}/a", {len(raw)}]]', "splitbytes": "100000"})
    with pytest.raises((ValueError, zlib.error)):
        list(reader.read(reader.partitions()[0]))


@pytest.mark.parametrize("widest", [10, 12, 16])
def test_compress_reads_as_gzip_does(tmp_path, widest):
    draw = random.Random(widest)
    raw = bytes(draw.choice(b"ACGT\n") for _ in range(30_000)) + b"tail" * 3000
    (tmp_path / "a.Z").write_bytes(lzw(raw, widest))
    assert subprocess.run(["gzip", "-dc", str(tmp_path / "a.Z")], capture_output=True, check=True).stdout == raw
    assert b"".join(lines.uncompressed(iter([lzw(raw, widest)]))) == raw


# A record of each format, as lines, with {i} for its number.
SAMPLES = {
    "embl": "ID   X{i}\nXX\nSQ   {i}\n//",
    "swissprot": "ID   X{i}\nAC   P{i};\n//",
    "genbank": "LOCUS X{i}\nORIGIN\n//",
    "genpept": "LOCUS X{i}\nORIGIN\n//",
    "fasta": ">s{i} x\nACGT\nAC",
    "fastq": "@r{i}\nACGT\n+\n@II@",
    "obo": "[Term]\nid: HP:{i}\n",
    "omim": "*RECORD*\n*FIELD* NO\n{i}",
    "unigene": "ID   Hs.{i}\nTITLE x\n//",
    "kegg": "ENTRY  {i}\nNAME  x\n///",
    "pfam": "# STOCKHOLM 1.0\n#=GF ID {i}\n//",
    "prosite": "ID   {i}\nPA   x\n//",
    "medline": "PMID- {i}\nTI  - x\n",
    "transfac": "AC  M{i}\nXX\n//",
    "utr": "ID   {i}\nFT   UTR5 1..2\n//",
    "enzyme": "ID   1.1.1.{i}\nDE   x\n//",
    "interpro": '<interpro id="{i}">\n<name/>\n</interpro>',
    "pdb": "HEADER {i}\nATOM\nENDMDL\nEND",
    "sdf": "mol{i}\n  x\nM  END\n$$$$",
}


@pytest.mark.parametrize("name", sorted(SAMPLES))
@pytest.mark.parametrize("packed", [lambda x: x, bgzf])
def test_record_formats(tmp_path, name, packed):
    made = [SAMPLES[name].replace("{i}", str(i * 37)).split("\n") for i in range(150)]
    junk = [] if name in ("fastq", "sdf") else ["; junk before"]
    (tmp_path / "a").write_bytes(packed(plain(junk + [x for r in made for x in r])))
    n = (tmp_path / "a").stat().st_size
    for size in (40, 333, 100_000):
        reader = lines._Reader({"files": f'[["file://{tmp_path}/a", {n}]]', "splitbytes": str(size), "format": __import__("json").dumps(tables.RECORD_FORMATS[name])})
        got = sorted((p, v) for s in reader.partitions() for b in reader.read(s) for p, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
        assert [v for _, v in got] == made, (name, size)


def test_formats_are_all_tested():
    assert set(SAMPLES) == set(tables.RECORD_FORMATS)


def test_records_in_many_tasks(spark, tmp_path):
    made = [f"ID   {i}\nAC   P{i};\nGN   Name=G{i};\nDR   MIM; {i}; phenotype.\n//" for i in range(3000)]
    (tmp_path / "a.dat.gz").write_bytes(bgzf(plain(made), 3000))
    d = tables.record_scan(spark, str(tmp_path / "a.dat.gz"), "swissprot", split_bytes=4000)
    assert d.rdd.getNumPartitions() > 3
    assert sorted(tuple(r) for r in tables.uniprot(d).collect()) == sorted((f"P{i}", f"G{i}", str(i)) for i in range(3000))


def test_vcf_in_blocks(spark, tmp_path):
    head = ["##fileformat=VCFv4.1", '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    rows = [f"1\t{i}\t.\tA\tG\t.\tPASS\tDP={i}" for i in range(1, 4000)]
    for name in ("a.vcf.gz", "b.vcf"):  # a blocked file needs no name that says so
        (tmp_path / name).write_bytes(bgzf(plain(head + rows), 4000))
        d, header = vcf.read_vcf(spark, str(tmp_path / name), split_bytes=6000)
        assert d.rdd.getNumPartitions() > 2 and header.meta["INFO"]["DP"]["Type"] == "Integer"
        assert sorted(r.pos for r in d.collect()) == list(range(1, 4000))


def test_written_blocks_are_read_back(spark, tmp_path):
    rows = [r for r in text(3000, 9) if r] + ["x" * 300_000]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, value string").repartition(3)
    out = f"file://{tmp_path}/out"
    assert sum(r.lines for r in lines.write_blocked(d, out).collect()) == len(rows)
    assert sorted(r.value for r in lines.lines(spark, out, 5000).collect()) == sorted(rows)
    whole = b"".join(gzip.decompress((tmp_path / "out" / p).read_bytes()) for p in __import__("os").listdir(tmp_path / "out"))
    assert sorted(whole.decode().split("\n")[:-1]) == sorted(rows)


def genome(seed):
    draw = random.Random(seed)
    made = {f"c{i}": "".join(draw.choice("acgtN") for _ in range(draw.choice([0, 1, 60, 61, 999, 5000]))) for i in range(30)}
    return made, lambda name: draw.choice([10, 60, 61, 10_000])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("packed", [lambda x: x, bgzf, gzip.compress])
@pytest.mark.parametrize("ragged", [False, True])
def test_fasta_substrings_equal_brute_force(spark, tmp_path, end, packed, ragged):
    made, width = genome(4)
    body = ""
    for name, seq in made.items():
        w = width(name)
        rows = [seq[i : i + w] for i in range(0, len(seq), w)]
        if ragged and len(rows) > 3:
            rows[1:3] = [rows[1] + rows[2]]
        body += end.join([f">{name} about it", *rows]) + end
    (tmp_path / "g").write_bytes(packed(body.encode()))
    found = fasta.index(spark, str(tmp_path / "g"), 1500)
    rows = {r.chrom: r for r in found.collect()}
    assert {n: r.length for n, r in rows.items()} == {n: len(s) for n, s in made.items()}
    got = {}
    for r in fasta.chunks(spark, str(tmp_path / "g"), 700, 1500).orderBy("chrom", "chunk").collect():
        got[r.chrom] = got.get(r.chrom, "") + r.sequence
        assert r.offset == r.chunk * 700
    assert got == {n: s.upper() for n, s in made.items() if s}
    if packed(b"x") == b"x" and not ragged:
        draw = random.Random(6)
        ask = [(i, draw.choice([*made, "none"]), draw.randrange(0, 1200), draw.choice([1, 5, 59, 60, 61, 4000])) for i in range(400)]
        d = fasta.substrings(spark.createDataFrame(ask, "row int, chrom string, s int, n int"), found, "chrom", "s", "n", gap=50, run=3000)
        assert {r.row: r.bases for r in d.collect()} == {i: (made.get(c, "")[s : s + n].upper() or None) for i, c, s, n in ask}


def test_ranges_read_what_is_asked_for():
    draw = random.Random(2)
    rows = sorted((s := draw.randrange(10**7), s + draw.randrange(1, 500)) for _ in range(2000))
    got = fasta.ranges_of(rows, 1000, 20_000)
    assert [x for s, e, _, _ in got for x in range(s, e)] == list(range(len(rows)))
    assert all(b <= rows[i][0] and rows[i][1] <= e and e - b <= 20_000 for s, t, b, e in got for i in range(s, t))
    assert sum(e - b for _, _, b, e in got) <= sum(e - b for b, e in rows) + 1000 * len(rows)


def test_mrna_from_an_index(spark, tmp_path):
    seq = "ACGTACGTTTGGCCAAN" * 5
    (tmp_path / "a.fa").write_text(">chr1\n" + "\n".join(seq[i : i + 10] for i in range(0, len(seq), 10)) + "\n")
    t = spark.createDataFrame([(1, "t", "chr1", "-", [(2, 8), (20, 25)])], "gid int, name string, chrom string, strand string, exons array<struct<start:int,end:int>>")
    joined = seq[2:8] + seq[20:25]
    i = fasta.index(spark, str(tmp_path / "a.fa"))
    assert genes.mrna(t, indexed=i).first()["sequence"] == joined[::-1].translate(str.maketrans("ACGT", "TGCA"))

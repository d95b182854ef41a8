"""Sequence functions as Column expressions. Positions are 0-based unless named pos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in T, C, A, G order of the three bases.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
# Ambiguity codes of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# Amino acids by one letter and by three.
AMINO3 = {"A": "Ala", "R": "Arg", "N": "Asn", "D": "Asp", "C": "Cys", "Q": "Gln", "E": "Glu", "G": "Gly", "H": "His", "I": "Ile", "L": "Leu", "K": "Lys", "M": "Met", "F": "Phe", "P": "Pro", "S": "Ser", "T": "Thr", "W": "Trp", "Y": "Tyr", "V": "Val", "*": "Ter"}


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTRYKMBVDHacgtrykmbvdh", "TGCAYRMKVBHDtgcayrmkvbhd"))


def _unambiguous() -> dict[str, str]:
    """Amino acids of all codons, ambiguous ones where every reading agrees."""
    out = dict(CODONS)
    for a, x in IUPAC.items():
        for b, y in IUPAC.items():
            for c, z in IUPAC.items():
                found = {CODONS[i + j + k] for i in x for j in y for k in z}
                if len(found) == 1:
                    out[a + b + c] = found.pop()
    return out


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def amino_acid(codon: Column) -> Column:
    """One letter, X for a codon that several acids share or that isn't one."""
    return F.coalesce(F.try_element_at(_map(_unambiguous()), F.upper(codon)), F.lit("X"))


def translate(cds: Column) -> Column:
    """Amino acids of whole codons, stops as *."""
    table = _map(CODONS)
    n = F.floor(F.length(cds) / 3).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    codons = F.transform(steps, lambda i: F.upper(F.substr(cds, i * 3 + 1, F.lit(3))))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def codon_at(cds: Column, index: Column) -> Column:
    """struct<codon, aa_pos, aa, offset> of a CDS index; aa_pos and offset count from 1."""
    first = (F.floor(index / 3) * 3).cast("int")
    codon = F.upper(F.substr(cds, first + 1, F.lit(3)))
    return F.struct(codon.alias("codon"), (F.floor(index / 3) + 1).cast("int").alias("aa_pos"), amino_acid(codon).alias("aa"), (index % 3 + 1).cast("int").alias("offset"))


def codon_usage(wild: Column, mutant: Column, usage: dict[str, float]) -> Column:
    """up, down or same: how often the mutant codon is used, compared with the wild one."""
    a, b = (F.try_element_at(_map(usage), F.upper(c)) for c in (wild, mutant))
    return F.when(b > a, "up").when(b < a, "down").when(a == b, "same")


def to_three(letter: Column) -> Column:
    return F.try_element_at(_map(AMINO3), F.upper(letter))


def to_one(three: Column) -> Column:
    return F.try_element_at(_map({v: k for k, v in AMINO3.items()}), F.initcap(three))


def mutate(seq: Column, index: Column, ref_length: Column, alt: Column) -> Column:
    """seq with ref_length bases at index replaced by alt."""
    return F.concat(F.substr(seq, F.lit(1), index), alt, F.substr(seq, index + ref_length + 1, F.length(seq)))


def motif_positions(seq: Column, motif: Column) -> Column:
    """array<int> of the motif's starts, found from the left and not overlapping."""
    n, size = F.length(seq), F.length(motif)
    steps = F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(steps, lambda i: F.substr(seq, i + 1, size) == motif)
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("out"))

    def step(at: Column, i: Column) -> Column:
        take = i >= at["free"]
        return F.struct(F.when(take, i + size).otherwise(at["free"]).alias("free"), F.when(take, F.concat(at["out"], F.array(i))).otherwise(at["out"]).alias("out"))

    return F.aggregate(hits, start, step, lambda at: at["out"])


def spliced(chromosome: Column, exons: Column, strand: Column) -> Column:
    """Sequence of exons (array<struct<start, end>>, 0-based half-open), on the transcript's strand."""
    joined = F.array_join(F.transform(exons, lambda e: F.substr(chromosome, e["start"] + 1, e["end"] - e["start"])), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def coding(exons: Column, cds_start: Column, cds_end: Column) -> Column:
    """Exons clipped to the CDS, those outside left out."""
    cut = F.transform(exons, lambda e: F.struct(F.greatest(e["start"], cds_start).alias("start"), F.least(e["end"], cds_end).alias("end")))
    return F.filter(cut, lambda e: e["start"] < e["end"])


def length_of(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["start"])


def first_coding_exon(frames: Column) -> Column:
    """0-based exon whose frame is the first that isn't -1, null if none."""
    p = F.array_position(F.transform(frames, lambda f: f != -1), F.lit(True))
    return F.when(p > 0, p - 1)


def coding_exons(frames: Column) -> Column:
    return F.size(F.filter(frames, lambda f: f != -1))


def cds_defect(length: Column) -> Column:
    return F.when(length % 3 != 0, "CDS_NOT_MULTIPLE_OF_3")


def codons_around(utr: Column, index: Column) -> Column:
    """The whole codons of a 5' UTR that hold the base at an index, in each of the three frames: a new start lies among them."""
    at = F.transform(F.array(index, index - 1, index - 2), lambda i: F.when(i >= 0, F.substr(utr, (i + 1).cast("int"), F.lit(3))))
    return F.array_distinct(F.filter(at, lambda c: F.coalesce(F.length(c) == 3, F.lit(False))))


def utr5_index(base: Column, exons: Column, strand: Column) -> Column:
    """0-based index of a genomic base in the spliced transcript, on its strand; null outside of exons."""
    inside = F.exists(exons, lambda e: (base >= e["start"]) & (base < e["end"]))
    ahead = F.aggregate(exons, F.lit(0).cast("long"), lambda s, e: s + F.greatest(F.lit(0), F.least(base, e["end"]) - e["start"]))
    behind = F.aggregate(exons, F.lit(0).cast("long"), lambda s, e: s + F.greatest(F.lit(0), e["end"] - F.greatest(base + 1, e["start"])))
    return F.when(inside, F.when(strand == "-", behind).otherwise(ahead))


def pad_or_clip(values: Column, n: int, fill: str = ".") -> Column:
    """An array of exactly n elements."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), n)), 1, n)

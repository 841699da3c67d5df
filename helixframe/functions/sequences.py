"""Sequence functions as Columns."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The standard genetic code in TCAG order, the patterns of UTR features.
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
GENETIC_CODE = dict(zip(("".join(c) for c in product("TCAG", repeat=3)), AMINO, strict=True))
KOZAK = "GCCACC|CCACC"
TOP = "^C[CT]{4,15}"
G_QUAD = "G{3,}.{1,7}G{3,}.{1,7}G{3,}.{1,7}G{3,}"
POLY_A = "AATAAA"
ARE = "ATTTA"
MIRNA_SEED = "A[ACGT]{6}A"
PATTERNS = {"kozak": KOZAK, "top": TOP, "g_quadruplex": G_QUAD, "poly_a": POLY_A, "are": ARE, "mirna_seed": MIRNA_SEED}
UTR5_MOTIFS = {"Kozak": KOZAK, "TOP": TOP, "G-quadruplex": G_QUAD, "TISU": "SAASATGGCGGC", "IRES": "CCTATTGTT", "uORF": "ATG[ACGT]{3,30}?(TAA|TAG|TGA)", "GAIT": "ACTCCCC"}
UTR3_MOTIFS = {"Polyadenylation Signal": POLY_A, "AU-rich Element": ARE, "miRNA Seed Match": MIRNA_SEED, "GU-rich Element": "GTGTGT", "Stem-loop Structure": "[ACGT]{4,8}[ACGT]{4,8}", "CPE": "TTTTAT", "Musashi Binding Element": "GUAGU|AUAGU"}


def gc_percent(seq: str) -> Column:
    """G, C and S among the letters GCSATUW; null if there are none."""
    strong, all_ = F.length(F.regexp_replace(seq, "[^GCS]+", "")), F.length(F.regexp_replace(seq, "[^GCSATUW]+", ""))
    return strong * 100.0 / F.nullif(all_, F.lit(0))


def kmers(seq: str, k: int) -> Column:
    """Overlapping k-mers; none if the sequence is shorter. One pass: substrings by place would count from the start."""
    return F.regexp_extract_all(F.col(seq), F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def codons(seq: str) -> Column:
    """Codons in order; none unless the length is a multiple of three."""
    return F.when(F.length(seq) % 3 == 0, F.regexp_extract_all(F.col(seq), F.lit("(?s)..."), F.lit(0))).otherwise(F.array().cast("array<string>"))


def amino_acid(codon: str) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in GENETIC_CODE.items() for x in pair]), F.col(codon))


def transcribe(seq: str) -> Column:
    return F.translate(seq, "T", "U")


def dot_bracket(seq: str, min_loop: int = 3) -> str:
    """Nested or crossing Watson-Crick pairs, taken greedily from the 5' end: a base pairs with the last base that is
    complementary, still free and more than ``min_loop`` further on. Free bases are dots.

    The free places of each letter are kept in order, so the partner is the last of its complement's list.
    """
    rna = seq.upper().translate(str.maketrans("T", "U"))
    free = {letter: [i for i, c in enumerate(rna) if c == letter] for letter in "ACGU"}
    marks = {}
    for i, letter in enumerate(rna):
        rivals = free.get(letter.translate(str.maketrans("ACGU", "UGCA")), [])
        if letter in free and i not in marks and rivals and rivals[-1] - i > min_loop:
            marks[i], marks[rivals.pop()] = "(", ")"
            free[letter].remove(i)
    return "".join(marks.get(i, ".") for i in range(len(rna)))


@F.pandas_udf(T.StringType())
def folded(seq: pd.Series) -> pd.Series:
    return seq.map(dot_bracket, na_action="ignore")


def rna_metrics(structure: str, seq: str) -> list[Column]:
    """length, hairpins (opening brackets less dots, as defined by the analysis this follows), loops (dots), GC fraction."""
    n = lambda c: F.length(structure) - F.length(F.replace(F.col(structure), F.lit(c), F.lit("")))
    gc = F.length(F.regexp_replace(seq, "[^GC]", "")) / F.nullif(F.length(seq), F.lit(0))
    return [F.length(seq).alias("length"), (n("(") - n(".")).alias("hairpins"), n(".").alias("loops"), gc.alias("gc_content")]

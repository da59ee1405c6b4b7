"""Raw reads to amplicons: overlap merging and primer trimming, vectorised per Arrow batch.

Both run row by row without a shuffle; merged reads are dereplicated before trimming, so each distinct one is trimmed once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import IUPAC

MIN_OVERLAP = 10
MAX_OVERLAP = 300
MAX_MISMATCH = 0.25
ERROR_RATE = 0.1
_BITS = {code: sum(1 << "ACGT".index(b) for b in bases) for code, bases in IUPAC.items()}
_COMPLEMENT = str.maketrans("ACGTRYKMBVDH", "TGCAYRMKVBHD")


def _codes(text: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for code, bits in _BITS.items():
        table[ord(code)] = table[ord(code.lower())] = bits
    return table[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def merge_pair(forward: str, f_qual: str, reverse: str, r_qual: str, least: int = MIN_OVERLAP, most: int = MAX_OVERLAP) -> str | None:
    """One read from two that overlap: the overlap of lowest mismatch density, of equals the longest; the better base wins.

    ``reverse`` is as sequenced. Reads that run past each other ('outies') are merged too. None where nothing fits.
    """
    reverse, r_qual = reverse.translate(_COMPLEMENT)[::-1], r_qual[::-1]
    f, r = np.frombuffer(forward.encode(), np.uint8), np.frombuffer(reverse.encode(), np.uint8)
    best = None
    for shift in range(len(f) - min(len(f), most), len(f) - least + 1):
        n = min(len(f) - shift, len(r))
        if n >= least:
            density = np.count_nonzero(f[shift : shift + n] != r[:n]) / n
            if density <= MAX_MISMATCH and (best is None or (density, -n) < best[:2]):
                best = (density, -n, shift, 0)
    for skip in range(1, len(r) - least + 1):
        n = min(len(r) - skip, len(f), most)
        if n >= least and len(r) - skip <= most:
            density = np.count_nonzero(f[:n] != r[skip : skip + n]) / n
            if density <= MAX_MISMATCH and (best is None or (density, -n) < best[:2]):
                best = (density, -n, 0, skip)
    if best is None:
        return None
    _, n, shift, skip = best
    n = -n
    fq, rq = np.frombuffer(f_qual.encode(), np.uint8), np.frombuffer(r_qual.encode(), np.uint8)
    middle = np.where(rq[skip : skip + n] > fq[shift : shift + n], r[skip : skip + n], f[shift : shift + n])
    if skip:  # an outie: only the overlap is between the primers
        return middle.tobytes().decode()
    return forward[:shift] + middle.tobytes().decode() + reverse[n:] + forward[shift + n :]


def merge_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(sample, f_seq, f_qual, r_seq, r_qual) to (sample, seq) of those that merge."""
    def run(frames):
        for x in frames:
            seqs = [merge_pair(*row) for row in zip(x["f_seq"], x["f_qual"], x["r_seq"], x["r_qual"], strict=True)]
            yield pd.DataFrame({"sample": x["sample"], "seq": seqs}).dropna()

    return pairs.select("sample", "f_seq", "f_qual", "r_seq", "r_qual").mapInPandas(run, "sample string, seq string")


def find_primer(seq: np.ndarray, primer: np.ndarray, rate: float = ERROR_RATE, last: bool = False) -> tuple[int, int] | None:
    """Start and end of a whole primer in a sequence with at most rate * length mismatches; the fewest win."""
    n = len(primer)
    if len(seq) < n or not n:
        return None
    windows = np.lib.stride_tricks.sliding_window_view(seq, n)
    wrong = ((windows & primer) == 0).sum(axis=1)
    least = wrong.min()
    if least > int(rate * n):
        return None
    at = np.flatnonzero(wrong == least)
    at = int(at[-1] if last else at[0])
    return at, at + n


def trim(seq: str, left: np.ndarray, right: np.ndarray, rate: float = ERROR_RATE) -> str | None:
    """What lies between a left primer and a right one (both given as they read in the sequence); None without both."""
    codes = _codes(seq)
    a = find_primer(codes, left, rate)
    if a is None:
        return None
    b = find_primer(codes[a[1] :], right, rate, last=True)
    return None if b is None else seq[a[1] : a[1] + b[0]]


def trim_primers(merged: DataFrame, markers: list[tuple[str, str, str, int, int]], rate: float = ERROR_RATE, flip: bool = False) -> DataFrame:
    """merged(sample, seq, abundance) to (marker, sample, seq, abundance), dereplicated, for all markers in one pass.

    markers: (name, left primer, right primer, shortest, longest). The right primer is given as ordered, that is
    reverse-complemented in the read. ``flip`` also tries the reverse complement. Reads without both primers are dropped.
    """
    known = [(m, _codes(left.replace("I", "N")), _codes(right.replace("I", "N").translate(_COMPLEMENT)[::-1]), lo, hi) for m, left, right, lo, hi in markers]

    def run(frames):
        for x in frames:
            rows = []
            for sample, seq, n in zip(x["sample"], x["seq"], x["abundance"], strict=True):
                for name, left, right, lo, hi in known:
                    found = trim(seq, left, right, rate)
                    if found is None and flip:
                        found = trim(seq.translate(_COMPLEMENT)[::-1], left, right, rate)
                    if found is not None and lo <= len(found) <= hi:
                        rows.append((name, sample, found, n))
                        break
            yield pd.DataFrame(rows, columns=["marker", "sample", "seq", "abundance"])

    cut = merged.select("sample", "seq", F.col("abundance").cast("long").alias("abundance")).mapInPandas(run, "marker string, sample string, seq string, abundance long")
    return cut.groupBy("marker", "sample", F.upper("seq").alias("seq")).agg(F.sum("abundance").cast("long").alias("abundance"))

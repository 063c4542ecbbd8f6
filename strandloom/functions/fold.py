"""Hairpin scores: Arrow-batched, as alignments have no JVM expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i


def _batch(seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.full((len(seqs), max(1, int(n.max(initial=1)))), 9, np.uint8)
    for i, s in enumerate(seqs):
        out[i, : n[i]] = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    return out, n


def alignment_scores(seqs: list[str], match: int = 3, mismatch: int = -2, gap: int = -5) -> np.ndarray:
    """Best local alignment of every sequence with its reverse complement; all
    sequences of a batch advance together, one anti-diagonal at a time."""
    a, n = _batch(seqs)
    b = np.full_like(a, 9)
    for i in range(len(seqs)):
        r = a[i, : n[i]][::-1]
        b[i, : n[i]] = np.where(r < 4, 3 - r, 4)
    rows, m = a.shape
    best = np.zeros(rows, np.int32)
    last2, last = np.zeros((rows, m + 1), np.int32), np.zeros((rows, m + 1), np.int32)
    for d in range(2, 2 * m + 1):
        i = np.arange(max(1, d - m), min(m, d - 1) + 1)
        x, y = a[:, i - 1], b[:, d - i - 1]
        same = np.where((x == y) & (x < 4), match, np.where((x < 9) & (y < 9), mismatch, -(1 << 20)))
        now = np.zeros((rows, m + 1), np.int32)
        now[:, i] = np.maximum(0, np.maximum(last2[:, i - 1] + same, np.maximum(last[:, i - 1], last[:, i]) + gap))
        best = np.maximum(best, now[:, i].max(1))
        last2, last = last, now
    return best


@F.pandas_udf(T.IntegerType())
def hairpin_alignment(seq: pd.Series) -> pd.Series:
    """Hairpin score: best local alignment with the own reverse complement, 3 for a
    match, -2 for a mismatch, -5 for a gap; null for null, 0 for the empty sequence."""
    out = np.full(len(seq), -1, np.int64)
    good = seq.notna().to_numpy()
    values = seq[good].tolist()
    order = np.argsort([len(v) for v in values], kind="stable")
    scores = np.zeros(len(values), np.int64)
    for i in range(0, len(order), 512):
        part = order[i : i + 512]
        scores[part] = alignment_scores([values[j] for j in part])
    out[good] = scores
    return pd.Series(out, index=seq.index).where(good).astype("Int32")


# Free energies at 37 degrees in kcal/mol published by SantaLucia and Hicks 2004: stacked pairs by
# the 5'-3' step of one strand, loop initiation by size (hairpin and bulge from 1 or 3 to 9, interior from 3 to 9).
STACKS = {
    "AA": -1.00, "AT": -0.88, "TA": -0.58, "CA": -1.45, "GT": -1.44,
    "CT": -1.28, "GA": -1.30, "CG": -2.17, "GC": -2.24, "GG": -1.84,
}
HAIRPIN_LOOPS = [3.5, 3.5, 3.3, 4.0, 4.2, 4.3, 4.5]
BULGES = [4.0, 2.9, 3.2, 3.3, 3.5, 3.7, 3.9, 4.1, 4.3]
INTERIOR_LOOPS = [3.2, 3.6, 4.0, 4.4, 4.6, 4.8, 4.9]
#: Energy of a single mismatch inside a helix (an average), of each letter by which an interior loop is lopsided,
#: of an A-T pair at the end of a helix; growth of loops with the logarithm of their size.
MISMATCH, LOPSIDED, END_AT, GROWTH = 1.0, 0.3, 0.05, 2.44 * 0.0019872 * 310.15
#: Letters that a bulge or an interior loop may have.
LOOP = 30


def _sized(table: list[float], first: int, n: int) -> float:
    last = first + len(table) - 1
    return table[n - first] if n <= last else table[-1] + GROWTH * float(np.log(n / last))


def loop_energy(left: int, right: int) -> float:
    """A bulge or an interior loop of left and right unpaired letters (not both 0), without stacking."""
    n = left + right
    if not left or not right:
        return _sized(BULGES, 1, n)
    return MISMATCH if n == 2 else _sized(INTERIOR_LOOPS, 3, n) + LOPSIDED * abs(left - right)


def _stacks() -> np.ndarray:
    """Energy of a pair followed by the next one inwards, by the codes of the two letters on the 5' side."""
    out = np.zeros((5, 5), np.float32)
    for x in range(4):
        for y in range(4):
            step, other = "ACGT"[x] + "ACGT"[y], "ACGT"[3 - y] + "ACGT"[3 - x]
            out[x, y] = STACKS[step] if step in STACKS else STACKS[other]
    return out


def fold_energies(seqs: list[str]) -> np.ndarray:
    """The least free energy (kcal/mol, at most 0) of each sequence's secondary structures: helices of
    A-T and C-G pairs with hairpin loops of three letters or more, bulges and interior loops of up to ``LOOP``
    letters, side by side in any number, but no loop with three helices. All sequences of a
    batch advance together, one distance of paired letters at a time; time and memory grow with
    the square of the length."""
    a, n = _batch(seqs)
    rows, m = a.shape
    a = np.where(a > 4, 4, a)
    stack, inf = _stacks(), np.float32(1e6)
    inner = [(l1, t - l1, np.float32(loop_energy(l1, t - l1))) for t in range(1, LOOP + 1) for l1 in range(t + 1)]
    inside: dict[int, np.ndarray] = {}  # by distance: (rows, places) of structures closed by a pair
    step = stack[a[:, :-1], a[:, 1:]] if m > 1 else np.zeros((rows, 0), np.float32)
    over = stack[a[:, :-2], a[:, 2:]] if m > 2 else np.zeros((rows, 0), np.float32)  # across a bulged letter
    for d in range(4, m):
        k = m - d
        pair = (a[:, :k] < 4) & (a[:, d:] == 3 - a[:, :k])
        best = np.full((rows, k), _sized(HAIRPIN_LOOPS, 3, d - 1), np.float32)
        if d - 2 in inside:
            best = np.minimum(best, step[:, :k] + inside[d - 2][:, 1 : 1 + k])
        for l1, l2, e in inner:
            at = d - 2 - l1 - l2
            if at < 4:
                break
            near = inside[at][:, 1 + l1 : 1 + l1 + k]
            # a bulge of one letter leaves its helix stacked
            if l1 + l2 == 1:
                e = e + (over[:, :k] if l1 else step[:, :k])
            np.minimum(best, near + e, out=best)
        inside[d] = np.where(pair, best, inf)
    at_end = np.where((a == 0) | (a == 3), np.float32(END_AT), np.float32(0))
    whole = np.zeros((rows, m + 1), np.float32)  # the best of the first j letters
    for j in range(1, m + 1):
        best = whole[:, j - 1].copy()
        for d in range(4, j):
            i = j - 1 - d
            best = np.minimum(best, whole[:, i] + inside[d][:, i] + at_end[:, i])
        whole[:, j] = best
    return whole[np.arange(rows), n]


@F.pandas_udf(T.DoubleType())
def hairpin_energy(seq: pd.Series) -> pd.Series:
    """How far folding lowers the energy, in kcal/mol (see ``fold_energies``), to two places; N
    counts as A; null for null. Published stacking and loop energies without dangling ends,
    mismatch tables and branched loops, so near a folding program's value but not equal to it."""
    good = seq.notna().to_numpy()
    out = np.full(len(seq), np.nan)
    values = [v.upper().replace("N", "A") for v in seq[good].tolist()]
    order = np.argsort([len(v) for v in values], kind="stable")
    scores = np.zeros(len(values))
    for i in range(0, len(order), 256):
        part = order[i : i + 256]
        scores[part] = np.round(-fold_energies([values[j] for j in part]).astype(float), 2)
    out[good] = np.maximum(scores, 0)
    return pd.Series(out, index=seq.index).astype(object).where(good, None)

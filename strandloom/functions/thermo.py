"""Nearest-neighbour thermodynamics of DNA duplexes, as JVM expressions.

Energies are kept as integers (tenths of kcal/mol and of cal/(mol K)), so that
sums don't depend on order; they are divided once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .seq import count_of, gc_counts, is_palindrome, kmers, let

# Nearest-neighbour parameters (enthalpy kcal/mol, entropy cal/(mol K)); keys are
# 5'-3' steps. Published by Breslauer et al. 1986, Sugimoto et al. 1995 (hybrids of RNA and DNA, all 16
# steps of the RNA strand written with T), Sugimoto et al. 1996, SantaLucia 1998 (the unified set of
# Allawi and SantaLucia 1997), and SantaLucia and Hicks 2004.
BRESLAUER_1986 = {
    "AA": (-9.1, -24.0), "AT": (-8.6, -23.9), "TA": (-6.0, -16.9), "CA": (-5.8, -12.9), "GT": (-6.5, -17.3),
    "CT": (-7.8, -20.8), "GA": (-5.6, -13.5), "CG": (-11.9, -27.8), "GC": (-11.1, -26.7), "GG": (-11.0, -26.6),
    "init": (0.0, 0.0), "one_GC": (0.0, -16.8), "all_AT": (0.0, -20.1), "sym": (0.0, -1.3),
}
SUGIMOTO_1995_HYBRID = {
    "AA": (-11.5, -36.4), "AC": (-7.8, -21.6), "AG": (-7.0, -19.7), "AT": (-8.3, -23.9),
    "CA": (-10.4, -28.4), "CC": (-12.8, -31.9), "CG": (-16.3, -47.1), "CT": (-9.1, -23.5),
    "GA": (-8.6, -22.9), "GC": (-8.0, -17.1), "GG": (-9.3, -23.2), "GT": (-5.9, -12.3),
    "TA": (-7.8, -23.2), "TC": (-5.5, -13.5), "TG": (-9.0, -26.1), "TT": (-7.8, -21.9),
    "init": (1.9, -3.9), "sym": (0.0, 0.0),
}
SUGIMOTO_1996 = {
    "AA": (-8.0, -21.9), "AT": (-5.6, -15.2), "TA": (-6.6, -18.4), "CA": (-8.2, -21.0), "GT": (-9.4, -25.5),
    "CT": (-6.6, -16.4), "GA": (-8.8, -23.5), "CG": (-11.8, -29.0), "GC": (-10.5, -26.4), "GG": (-10.9, -28.4),
    "init": (0.6, -9.0), "sym": (0.0, -1.4),
}
SANTALUCIA_1998 = {
    "AA": (-7.9, -22.2), "AT": (-7.2, -20.4), "TA": (-7.2, -21.3), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.9),
    "init_GC": (0.1, -2.8), "init_AT": (2.3, 4.1), "sym": (0.0, -1.4),
}
SANTALUCIA_2004 = {
    "AA": (-7.6, -21.3), "AT": (-7.2, -20.4), "TA": (-7.2, -20.4), "CA": (-8.5, -22.7), "GT": (-8.4, -22.4),
    "CT": (-7.8, -21.0), "GA": (-8.2, -22.2), "CG": (-10.6, -27.2), "GC": (-9.8, -24.4), "GG": (-8.0, -19.0),
    "init": (0.2, -5.7), "init_GC": (0.0, 0.0), "init_AT": (2.2, 6.9), "sym": (0.0, -1.4),
}
TABLES = {"sugimoto_1996": SUGIMOTO_1996, "santalucia_1998": SANTALUCIA_1998, "breslauer_1986": BRESLAUER_1986, "sugimoto_1995_hybrid": SUGIMOTO_1995_HYBRID, "santalucia_2004": SANTALUCIA_2004}
#: The table for RNA probes on DNA targets, which melting temperatures of probes are computed with.
PROBES = "sugimoto_1995_hybrid"
#: Gas constant, cal/(mol K).
R = 1.987


def steps(table: str, part: int) -> dict[str, int]:
    """Tenths for all 16 steps: a step that isn't listed has its reverse complement's
    value; where both directions of a step are listed, the forward one holds."""
    comp, given = dict(zip("ACGT", "TGCA")), TABLES[table]
    out = {}
    for a in "ACGT":
        for b in "ACGT":
            key = a + b if a + b in given else comp[b] + comp[a]
            out[a + b] = round(given[key][part] * 10)
    return out


def _sum(seq: Column, table: str, part: int, symmetry: bool = True) -> Column:
    if table not in TABLES:
        raise ValueError(f"unknown table {table}; have {', '.join(TABLES)}")
    given = TABLES[table]
    tenths = lambda k: round(given[k][part] * 10)
    values = F.create_map(*[F.lit(x) for kv in steps(table, part).items() for x in kv])

    def whole(up):
        total = F.aggregate(kmers(up, 2), F.lit(tenths("init") if "init" in given else 0), lambda s, m: s + F.element_at(values, m))
        if "init_GC" in given:
            for e in (F.substring(up, 1, 1), F.substring(up, -1, 1)):
                total = total + F.when(e.isin("G", "C"), tenths("init_GC")).otherwise(tenths("init_AT"))
        if "one_GC" in given:
            total = total + F.when(up.rlike("[GC]"), tenths("one_GC")).otherwise(tenths("all_AT"))
        if symmetry:
            total = total + F.when(is_palindrome(up), tenths("sym")).otherwise(0)
        return F.when((F.length(up) >= 2) & up.rlike("^[ACGT]+$"), total)

    return let(F.upper(seq), whole)


def entropy_tenths(seq: Column, table: str = "sugimoto_1996") -> Column:
    """Duplex entropy in tenths of cal/(mol K); null below two bases and with any
    letter other than A, C, G, T."""
    return _sum(seq, table, 1)


def enthalpy_tenths(seq: Column, table: str = "sugimoto_1996") -> Column:
    """Duplex enthalpy in tenths of kcal/mol; null as for the entropy."""
    return _sum(seq, table, 0)


def gibbs_energy(seq: Column, kelvin: float = 310.15, table: str = "sugimoto_1996") -> Column:
    """Duplex free energy dH - T dS / 1000, kcal/mol."""
    return enthalpy_tenths(seq, table) / 10.0 - kelvin * (entropy_tenths(seq, table) / 10.0) / 1000.0


def tm_wallace(seq: Column) -> Column:
    """4 (G+C) + 2 (A+T)."""
    gc, n = gc_counts(seq)
    return F.when(n > 0, 2 * n + 2 * gc).cast("double")


def tm_gc(seq: Column, na: float = 50.0) -> Column:
    """81.5 + 16.6 log10(Na / 1000) + 0.41 GC% - 500 / length (Na in mM)."""
    gc, n = gc_counts(seq)
    return F.when(n > 0, 81.5 + 16.6 * F.log10(F.lit(na / 1000)) + 41.0 * gc / n - 500.0 / F.length(seq))


def tm_nn(seq: Column, table: str = "sugimoto_1996", na: float = 50.0, dnac1: float = 250.0, dnac2: float = 0.0) -> Column:
    """Melting temperature by nearest neighbours with salt-corrected entropy, for a
    duplex of dnac1 and dnac2 nM; below 14 bases the Wallace rule. Null where a
    letter other than A, C, G, T occurs."""
    k = (dnac1 - dnac2 / 2.0) * 1e-9
    salted = entropy_tenths(seq, table) / 10.0 + 0.368 * (F.length(seq) - 1) * F.log(F.lit(na / 1000.0))
    tm = 100.0 * enthalpy_tenths(seq, table) / (salted + R * F.log(F.lit(k))) - 273.15
    return F.when(F.length(seq) < 14, F.when(F.upper(seq).rlike("^[ACGT]+$"), tm_wallace(seq))).otherwise(tm)


def tm_probe(seq: Column, table: str = PROBES, na: float = 50.0, dnac1: float = 250.0, dnac2: float = 0.0) -> Column:
    """Melting temperature of any probe: by nearest neighbours from 14 letters on (a probe
    is not its own partner, so without the symmetry term); the Wallace rule below, over
    the bases alone; where another letter than A, C, G, T leaves a step unknown, the formula
    81.5 + 16.6 log10(Na / 1000) + 41 (G+C) / length - 500 / length. Null below two letters."""
    k = (dnac1 - dnac2 / 2.0) * 1e-9

    def by_length(up):
        gc, n = count_of(up, "GC"), count_of(up, "ACGT")
        salted = _sum(up, table, 1, False) / 10.0 + 0.368 * (F.length(up) - 1) * F.log(F.lit(na / 1000.0))
        nn = 100.0 * _sum(up, table, 0, False) / (salted + R * F.log(F.lit(k))) - 273.15
        plain = 81.5 + 16.6 * F.log10(F.lit(na / 1000)) + 41.0 * gc / F.length(up) - 500.0 / F.length(up)
        return F.when(F.length(up) < 2, None).when(F.length(up) < 14, (2 * n + 2 * gc).cast("double")).otherwise(F.coalesce(nn, plain))

    return let(F.upper(seq), by_length)

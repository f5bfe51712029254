"""Bases, genotypes and likelihood expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases in code order, and the codes of ambiguous base sets.
BASES = "ACGT"
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AG": "R", "CT": "Y", "CG": "S", "AT": "W", "GT": "K", "AC": "M", "CGT": "B", "AGT": "D", "ACT": "H", "ACG": "V", "ACGT": "N"}
#: The ten genotypes as pairs of base codes, and the six pairs of unequal bases, both in the usual order.
GENOTYPES = [(a, b) for a in range(4) for b in range(a, 4)]
PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def genotype(a: int, b: int) -> int:
    """Index of a genotype among the ten."""
    return GENOTYPES.index((min(a, b), max(a, b)))


def base_code(letter: Column) -> Column:
    """0-3 for ACGT in either case or the digits 0-3, null for anything else."""
    at = F.instr(F.lit(BASES), F.upper(letter))
    digit = F.when(letter.rlike("^[0-3]$"), letter).cast("int")
    return F.when(F.length(letter) == 1, F.coalesce(digit, F.when(at > 0, at - 1)))


def base_letter(code: Column) -> Column:
    """ACGT for 0-3, N for anything else."""
    return F.when(code.between(0, 3), F.substring(F.lit(BASES), code + 1, F.lit(1))).otherwise("N")


def is_transition(a: Column, b: Column) -> Column:
    """Whether two base codes differ by a transition (A and G, or C and T)."""
    return F.abs(a - b) == 2


def log_error(q: Column) -> tuple[Column, Column, Column]:
    """Natural logs of P(base | homozygous for it), P(base | one copy of it) and P(base | no copy) at Phred quality q."""
    e = F.pow(F.lit(10.0), -q / 10.0)
    return F.log(F.greatest(1 - e, F.lit(1e-12))), F.log(0.5 * (1 - e) + e / 6), F.log(e / 3)


def logsumexp(values: list[Column]) -> Column:
    """Log of the sum of exponentials, safe for large negative values."""
    top = F.greatest(*values)
    return top + F.log(sum((F.exp(v - top) for v in values[1:]), F.exp(values[0] - top)))


def harmonic(n: int) -> float:
    """Sum of 1/i below n."""
    return sum(1 / i for i in range(1, n))


def harmonic2(n: int) -> float:
    """Sum of 1/i^2 below n."""
    return sum(1 / (i * i) for i in range(1, n))


def neutrality(n: int, w: Column, pi: Column, fl: Column, fh: Column, el: Column) -> dict[str, Column]:
    """Tajima's D, Fu and Li's F and D, Fay and Wu's H and Zeng's E of a window, for n chromosomes; null where undefined."""
    a1, a2 = harmonic(n), harmonic2(n)
    s = w * a1
    # constants of the published variance formulas
    b1, b2 = (n + 1) / (3 * (n - 1)), 2 * (n * n + n + 3) / (9 * n * (n - 1))
    c1 = b1 - 1 / a1
    c2 = b2 - (n + 2) / (a1 * n) + a2 / (a1 * a1)
    e1, e2 = c1 / a1, c2 / (a1 * a1 + a2)
    cn = (2 * n * a1 - 4 * (n - 1)) / ((n - 1) * (n - 2)) if n > 2 else 1.0
    vd = 1 + a1 * a1 / (a2 + a1 * a1) * (cn - (n + 1) / (n - 1))
    ud = a1 - 1 - vd
    vf = (cn + 2 * (n * n + n + 3) / (9 * n * (n - 1)) - 2 / (n - 1)) / (a1 * a1 + a2)
    uf = (1 + (n + 1) / (3 * (n - 1)) - 4 * (n + 1) / (n - 1) ** 2 * (harmonic(n + 1) - 2 * n / (n + 1))) / a1 - vf
    a2n = harmonic2(n + 1)
    h2 = (18 * n * n * (3 * n + 2) * a2n - (88 * n**3 + 9 * n * n - 13 * n + 6)) / (9 * n * (n - 1) ** 2)
    h1 = (n - 2) / (6 * (n - 1))
    z1 = n / (2 * (n - 1)) - 1 / a1
    z2 = a2 / (a1 * a1) + 2 * (n / (n - 1)) ** 2 * a2 - 2 * (n * a2 - n + 1) / ((n - 1) * a1) - (3 * n + 1) / (n - 1)

    def ratio(top: Column, var: Column) -> Column:
        return F.when(var > 0, top / F.sqrt(var))

    return {
        "tajima": F.when(s == 0, 0.0).otherwise(ratio(pi - w, e1 * s + e2 * s * (s - 1))),
        "fuf": ratio(pi - fl, uf * s + vf * s * s),
        "fud": ratio(s - fl * a1, ud * s + vd * s * s),
        "fayh": ratio(pi - fh, h1 * s + h2 * s * s),
        "zeng": ratio(el - w, z1 * s + z2 * s * s),
    }

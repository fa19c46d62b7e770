"""PMI edge weights as column expressions (M1-M5).

Inputs are the pair statistics ``pv1, pv2, com, total, pot1, pot2, pot_joint``:
p(x) = pv1/pot1, p(y) = pv2/pot2, p(x, y) = com/pot_joint.  Divisions by zero give NULL
(``try_divide``), never an error and never infinity; a NULL weight drops the edge.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the weight formulas: the small constants added before taking logarithms.
EPS = 1e-40
EPS_TOTAL = 1e-20


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _lift(power: int = 1) -> Column:
    """com^power · pot1 · pot2 / (pv1 · pv2 · pot_joint^power), NULL when a denominator is 0."""
    num = F.pow(_d("com"), F.lit(power)) * _d("pot1") * _d("pot2") if power > 1 else _d("com") * _d("pot1") * _d("pot2")
    den = _d("pv2") * _d("pv1") * (F.pow(_d("pot_joint"), F.lit(power)) if power > 1 else _d("pot_joint"))
    return F.try_divide(num, den)


def pmi_weight_expr(norm: int) -> Column:
    """The weight column for normalisation index ``norm`` (1..5)."""
    if norm == 1:
        # normalised PMI × 100: log2(lift) / -log2(p(x, y))
        pxy = F.try_divide(_d("com"), _d("pot_joint"))
        return F.try_divide(F.log2(_lift() + F.lit(EPS)), -F.log2(pxy + F.lit(EPS))) * F.lit(100.0)
    if norm == 2:
        # powered PMI; true division com/total (the original divided integers)
        a = F.log2(F.try_divide(_d("com") * _d("total"), _d("pv2") * _d("pv1")) + F.lit(EPS))
        b = F.log2(F.try_divide(_d("com"), _d("total")) + F.lit(EPS_TOTAL))
        return F.pow(F.lit(2.0), a + b)
    if norm == 3:
        return F.log2(_lift() + F.lit(EPS))
    if norm in (4, 5):
        return F.log2(_lift(norm - 2) + F.lit(EPS))
    raise ValueError(f"no weight formula has the number {norm!r}")

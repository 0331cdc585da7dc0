"""Likelihoods of shared segments as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial, log, pi

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Settings:
    """A population's segment statistics, the genome and the thresholds."""

    load_cm: float = 5.0
    min_cm: float = 2.5
    max_cm: float = 10.0
    max_meioses: int = 40
    recombinations: float = 35.2548101
    chromosomes: int = 22
    exp_mean: float = 3.197036753
    pois_mean: float = 13.73
    confidence: float = 0.95
    sibling_z: float = 2.33
    masked_mb: float = 0.0

    @property
    def genome(self) -> float:
        return self.recombinations * 100 - 1.3 * self.masked_mb

    @property
    def rate(self) -> float:
        return 1 / (self.exp_mean - self.min_cm)

    @property
    def margin(self) -> float:
        """Half the chi-square quantile of two degrees of freedom."""
        return -log(1 - self.confidence)


IMPOSSIBLE = -9999999999.0


def ln_factorial(n: Column) -> Column:
    """ln of n!, from a table up to 15 and above by Stirling's series, exact to double precision there.

    ``z ln z`` and ``-z`` are one product and the small terms are added up
    first, as large sums would cost digits that results show.
    """
    small = F.array(*[F.lit(log(factorial(i))) for i in range(16)])
    z = (n + 1).cast("double")
    r = 1 / (z * z)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188))))) / z
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise((z - 0.5) * (F.ln(z) - 1) + (0.5 * log(2 * pi) - 0.5 + tail))


def poisson_ln(rate: Column, count: Column, ln_factorial: Column, base: Column | float = 0.0, ln_rate: Column | None = None) -> Column:
    """ln of a Poisson probability, added to ``base`` term by term; ``ln_rate`` where it is known.

    Sums over many segments are large, so the order in which they are made
    decides their last digits: every likelihood adds its terms from the left,
    background first.
    """
    return F.when(rate > 0, base - rate + count * (F.ln(rate) if ln_rate is None else ln_rate) - ln_factorial).otherwise(base + IMPOSSIBLE)


def exponential_ln(count: Column, total: Column, mean: Column, base: Column | float = 0.0) -> Column:
    """Sum of ln densities of ``count`` excesses that add up to ``total``, added to ``base``."""
    return base - count * F.ln(mean) - total / mean


def background_ln(count: Column, total: Column, ln_factorial: Column, s: Settings) -> Column:
    return poisson_ln(F.lit(s.pois_mean), count, ln_factorial) + count * log(s.rate) - total * s.rate


def direct_terms(n: Column, s: Settings) -> tuple[Column, Column]:
    """Rate and mean excess of the segments of direct descent over ``n`` meioses; so of one and two ancestors below."""
    bins = (n - 1) * (s.genome / 100) + s.chromosomes
    mean = F.when(n > 1, F.lit(s.genome) / bins).otherwise(100 * s.recombinations / s.chromosomes)
    return bins * F.exp(-s.min_cm / mean) * F.pow(F.lit(0.5), n - 1), mean


def one_ancestor_terms(n: Column, s: Settings, share: Column | float = 1.0) -> tuple[Column, Column]:
    bins = n * (s.genome / 100) + s.chromosomes
    mean = F.lit(s.genome) / bins
    return bins * F.exp(-s.min_cm / mean) * F.pow(F.lit(0.5), n - 1) * share, mean


def sibling_rate(s: Settings) -> float:
    return 0.75 * s.chromosomes + s.genome / 100 * 4 * 0.1875


def two_ancestor_terms(n: Column, s: Settings) -> tuple[Column, Column]:
    near = F.when(n == 2, s.genome * 0.75).otherwise(s.genome * 0.5) / sibling_rate(s)
    far = F.lit(100.0) / n
    rate = 2 * (n * (s.genome / 100) + s.chromosomes) * F.exp(-s.min_cm * n / 100) * F.pow(F.lit(0.5), n - 1)
    return F.when(n <= 3, sibling_rate(s)).otherwise(rate), F.when(n <= 3, near).otherwise(far)


def mixture_ln(x: Column, s: Settings) -> Column:
    """ln of the mixture of nine Erlang terms of a full sibling's segment excess."""
    speed = 2 * sibling_rate(s) / (s.genome * 0.75)
    term, total = F.lit(0.5 * speed), F.lit(0.5 * speed)
    for k in range(2, 10):
        term = term * x * (0.5 * speed / (k - 1))
        total = total + term
    return F.ln(total) - x * speed


def ibd2_sibling_ln(count: Column, total: Column, ln_factorial: Column, s: Settings, base: Column | float = 0.0) -> Column:
    import math

    rate = (s.genome / 100 + s.chromosomes) / 4 * math.exp(-s.min_cm / 25)
    return exponential_ln(count, total, F.lit(25.0), poisson_ln(F.lit(rate), count, ln_factorial, base))


def chi2_sf(x: Column, half_df: Column) -> Column:
    """Chi-square survival with an even number of degrees of freedom, 2 x half_df, for x of any size.

    The Poisson probabilities of fewer than half_df events at rate x / 2, each
    from the logarithm of the one before, so that none overflows.
    """
    first = F.struct((-x / 2).alias("ln"), F.exp(-x / 2).alias("sum"))
    steps = F.filter(F.sequence(F.lit(1), F.greatest(half_df - 1, F.lit(1))), lambda i: i < half_df)

    def add(acc: Column, i: Column) -> Column:
        ln = acc["ln"] + F.ln(x / 2) - F.ln(i)
        return F.struct(ln.alias("ln"), (acc["sum"] + F.exp(ln)).alias("sum"))

    return F.when(x <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.aggregate(steps, first, add, lambda acc: acc["sum"])))


def ascertained_ln(n: Column, ancestors: int, count: Column, total: Column, mixture: Column, s: Settings) -> Column:
    """ln densities of the lengths of segments at an ascertained locus under a model; their number tells nothing."""
    if ancestors == 0:
        bins = (n - 1) * (s.genome / 100) + s.chromosomes
        mean = F.when(n > 1, F.lit(s.genome) / bins).otherwise(100 * s.recombinations / s.chromosomes)
    elif ancestors == 1:
        mean = F.lit(s.genome) / (n * (s.genome / 100) + s.chromosomes)
    else:
        mean = F.when(n == 3, s.genome * 0.5 / sibling_rate(s)).otherwise(F.lit(100.0) / n)
    plain = exponential_ln(count, total, mean)
    return F.when(n == 2, mixture).otherwise(plain) if ancestors == 2 else plain

"""Probability expressions on a margin (yes minus no logit)."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_FLOOR, CLIP = 1e-15, 1e-12


#: exp at multiples of 1 / STEPS up to LIMIT on both sides: the nearest double, and what it lacks.
STEPS, LIMIT = 8, 40
with localcontext(prec=60):
    _EXPS = [(Decimal(k) / STEPS).exp() for k in range(-STEPS * LIMIT, STEPS * LIMIT + 1)]
    _NEAR, _REST = (f"array({', '.join(f'{v!r}D' for v in t)})" for t in ([float(e) for e in _EXPS], [float(e - Decimal(float(e))) for e in _EXPS]))


def exp(x: Column) -> Column:
    """exp to little more than half a unit of the last bit, as C libraries and so SQL engines have it; Spark's may be off by a whole one.

    That of the nearest multiple of 1 / STEPS, times that of the small rest. Beyond LIMIT it is Spark's own.
    """
    at = F.rint(x * STEPS)
    place = at.cast("int") + STEPS * LIMIT
    near, rest = (F.get(F.expr(t), place) for t in (_NEAR, _REST))
    return F.when(F.abs(x) <= LIMIT, near + (rest + near * F.expm1(x - at / STEPS))).otherwise(F.exp(x))


def sigmoid(margin: Column) -> Column:
    """Probability of Yes, by the same operations on both signs as SQL writes it: at a border of rounding the last bit decides whether opposite
    margins tie. Below -700 the exponential would overflow; there the quotient is its reciprocal."""
    return F.when(margin < -700, F.exp(margin)).otherwise(1 / (1 + exp(-margin)))


def to_tie(score: Column) -> Column:
    """A score of 0 or more at twelve digits, rounded as a double, half up, as SQL engines do. Spark's ``round`` takes the shortest decimal, which falls on the
    other side of a border where the product with 1e12 is a half."""
    return F.floor(score * 1e12 + 0.5) / 1e12


def digits(x: Column, n: int) -> Column:
    """``x`` at ``n`` digits, rounded as a double, halves away from zero, as SQL engines do: quotients such as 41 / 5120 lie on a border, where the product
    with the power of ten decides and not the shortest decimal, which Spark's ``round`` takes. A whole product is what ``round`` leaves alone."""
    # Beyond this the product could overflow, and there are no digits left to cut.
    return F.when(F.abs(x) < 1e290, F.round(x * 10.0**n) / 10.0**n).otherwise(x)


def entropy(p: Column) -> Column:
    """Binary entropy in nats; 0 log 0 is 0."""
    part = lambda q: F.when(q > 0, -q * F.ln(q)).otherwise(F.lit(0.0))
    return part(p) + part(1 - p)


def confidence(p: Column) -> Column:
    return F.greatest(p, 1 - p)


def nll(p: Column, truth: Column) -> Column:
    """One-sided floor on the probability of the truth."""
    return -F.ln(F.greatest(F.when(truth, p).otherwise(1 - p), F.lit(TRUE_FLOOR)))


def nll_clipped(p: Column, truth: Column) -> Column:
    """Two-sided clip of the probability of Yes."""
    q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return -F.ln(F.when(truth, q).otherwise(1 - q))


def brier(p: Column, truth: Column) -> Column:
    return (p - truth.cast("double")) * (p - truth.cast("double"))


def bin_index(conf: Column, bins: int) -> Column:
    """Equal-width bins that are open below and closed above; 0 falls into the first."""
    return F.least(F.greatest(F.ceil(conf * bins).cast("int") - 1, F.lit(0)), F.lit(bins - 1))


def ratio_ppm(a: Column, b: Column) -> Column:
    """Millionths, halves rounded up, in integers."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("div", a * 1000000 + F.call_function("div", b, F.lit(2)), b)


def softmax_entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits, by log-sum-exp."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    dot = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top) * (x - top))
    return F.ln(z) - dot / z


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def argmax(logits: Column) -> Column:
    """Zero-based place of the first largest logit."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def warmup_cosine(step: Column, total: int, warmup: int) -> Column:
    """Learning-rate factor after ``step`` completed steps: linear warm-up that ends at 1, then half a cosine to 0."""
    if not 0 <= warmup < total:
        raise ValueError("warm-up must be shorter than the run")
    progress = (step - warmup).cast("double") / (total - warmup)
    down = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * progress))
    return F.when(step < warmup, (step + 1).cast("double") / warmup).otherwise(down) if warmup else down


def reduced(a: Column, b: Column, most: int) -> Column:
    """The fraction a/b in lowest terms as text, 0/1 for an empty b, for b up to ``most``: the largest common divisor is
    Euclid's, unrolled to the steps that such numbers can need."""
    steps = 2 * max(1, most.bit_length())
    state = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    turn = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.greatest(s["y"], F.lit(1).cast("long"))).alias("y"))
    g = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, turn)["x"]
    part = lambda v: F.call_function("div", v.cast("long"), F.greatest(g, F.lit(1).cast("long"))).cast("string")
    return F.when(b == 0, F.lit("0/1")).otherwise(F.concat(part(a), F.lit("/"), part(b)))

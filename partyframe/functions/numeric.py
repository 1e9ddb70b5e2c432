"""Scalar Column expressions used across the operators.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; each takes and returns a ``Column``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ceil_log2(n) -> Column:
    """Exact ``ceil(log2(n))`` for integers n >= 1 (0 for n <= 1).

    Uses the bit length of ``n - 1`` instead of ``log2`` (which is inexact
    near large powers of two).
    """
    n = _c(n).cast("long")
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1))).cast("int")


def bits_to_bytes(bits) -> Column:
    """``ceil(bits / 8)`` in integer arithmetic."""
    return F.shiftright(_c(bits).cast("long") + F.lit(7), 3)


def round_to(x, digits: int) -> Column:
    """Round half-up to ``digits`` places; a negative zero becomes 0.0 (so hashes agree)."""
    r = F.round(_c(x).cast("double"), digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def round6(x) -> Column:
    return round_to(x, 6)


def sigmoid(z) -> Column:
    z = _c(z)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def softplus(z) -> Column:
    """Numerically stable ``log(1 + exp(z))``."""
    z = _c(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


# fixed values: fp16 grid constants (IEEE 754 binary16)
FP16_MIN_EXP = -14        # smallest normal exponent
FP16_MANTISSA_BITS = 10
FP16_OVERFLOW = 65520.0   # |x| >= this rounds to infinity


def fp16_round(x) -> Column:
    """Round a float / double to the nearest binary16 value (ties to even).

    ``e = max(floor(log2|x|), -14)``, grid step ``2^(e-10)``, ``rint`` on that
    grid; |x| >= 65520 becomes +-inf, 0 stays 0, NaN stays NaN.
    """
    x = _c(x).cast("double")
    ax = F.abs(x)
    e = F.greatest(F.floor(F.log2(ax)), F.lit(FP16_MIN_EXP))
    step = F.pow(F.lit(2.0), e - FP16_MANTISSA_BITS)
    rounded = F.rint(x / step) * step
    return (F.when(F.isnan(x), x)
            .when(ax == 0, x)
            .when(ax >= FP16_OVERFLOW, F.signum(x) * F.lit(float("inf")))
            .otherwise(rounded))


# Activation names accepted by the party model (any other name = identity).
# fixed values: leaky slope 0.01, ELU alpha 1.0, SELU alpha / scale constants.
LEAKY_SLOPE = 0.01
ELU_ALPHA = 1.0
SELU_ALPHA = 1.6732632423543772848170429916717
SELU_SCALE = 1.0507009873554804934193349852946


def _relu(x):
    return F.greatest(x, F.lit(0.0))


def _leaky(x):
    return F.when(x >= 0, x).otherwise(x * LEAKY_SLOPE)


def _elu(x):
    return F.when(x > 0, x).otherwise(F.lit(ELU_ALPHA) * F.expm1(x))


def _selu(x):
    return F.lit(SELU_SCALE) * F.when(x > 0, x).otherwise(F.lit(SELU_ALPHA) * F.expm1(x))


def _mish(x):
    return x * F.tanh(softplus(x))


ACTIVATIONS = {
    "relu": _relu,
    "leaky_relu": _leaky,
    "elu": _elu,
    "selu": _selu,
    "mish": _mish,
}


def activation(name: str, x) -> Column:
    x = _c(x)
    fn = ACTIVATIONS.get(name)
    return fn(x) if fn else x


def _exp_slope(x):
    return F.when(x > 0, F.lit(1.0)).otherwise(F.lit(ELU_ALPHA) * F.exp(x))


def _selu_slope(x):
    return F.lit(SELU_SCALE) * F.when(x > 0, F.lit(1.0)).otherwise(F.lit(SELU_ALPHA) * F.exp(x))


def _mish_slope(x):
    t = F.tanh(softplus(x))
    return t + x * (F.lit(1.0) - t * t) * sigmoid(x)


SLOPES = {
    "relu": lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    "leaky_relu": lambda x: F.when(x >= 0, F.lit(1.0)).otherwise(F.lit(LEAKY_SLOPE)),
    "elu": _exp_slope,
    "selu": _selu_slope,
    "mish": _mish_slope,
}


def activation_slope(name: str, x) -> Column:
    """Derivative of :func:`activation` (of any other name: 1)."""
    fn = SLOPES.get(name)
    return fn(_c(x)) if fn else F.lit(1.0)


def log2_ceil_py(n: int) -> int:
    """Driver-side twin of :func:`ceil_log2` for small constants."""
    return 0 if n <= 1 else (int(n) - 1).bit_length()


__all__ = ["ceil_log2", "bits_to_bytes", "round6", "round_to", "sigmoid", "softplus", "fp16_round",
           "activation", "activation_slope", "ACTIVATIONS", "log2_ceil_py"]

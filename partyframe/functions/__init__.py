"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from partyframe.functions.numeric import (  # noqa: F401
    ACTIVATIONS, activation, bits_to_bytes, ceil_log2, fp16_round, round6, sigmoid, softplus,
)

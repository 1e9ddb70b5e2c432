"""Messages as bytes: one BINARY column that holds what a codec sends, bit by bit (practical size, A8).

Layout: a header of :func:`header_bytes` bytes, then the body of
``ceil(bits / 8)`` bytes, where ``bits`` is :func:`.codec.message_bits`.

Header, little endian: codec (1 byte, its place in ``CODECS``), direction (1:
0 emb, 1 grad), widths of samples and dims (1 each), samples, dims, number of
values, heads, tails (4 each); then, as 8-byte floats, the scale of an 8- or
4-bit embedding, or the least and greatest value of such a gradient.

Body, highest bit first.  Dense codecs: the values in 32, 16, 8 or 4 bits
each.  Sparse ones: samples - 1 and dims - 1 in ceil(log2) bits, positions
(heads then tails, or top-k positions) in ceil(log2(samples x dims)) bits,
then the values in 32 or 16 bits.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partyframe.operators.codec import CODECS, DENSE_WIDTH

HEADER = "<BBBBIIIII"
MESSAGE = ("vals array<float>, codes array<smallint>, head array<int>, tail array<int>, idx array<int>, "
           "val array<float>, scale double, lo double, hi double")


def message_columns(codec: str, direction: str) -> list[str]:
    """The columns beside samples and dims that make up a message (see :func:`.codec.encode`)."""
    if codec in ("q8", "q4"):
        return ["codes", "scale"] if direction == "emb" else ["codes", "lo", "hi"]
    if codec in DENSE_WIDTH:
        return ["vals"]
    if direction == "emb":
        return ["vals", "head", "tail"]
    return ["vals"] if codec.startswith("svfl") else ["idx", "val"]


def header_bytes(codec: str, direction: str) -> int:
    """Bytes of the header: 24, and 8 for each scale."""
    return struct.calcsize(HEADER) + 8 * len({"scale", "lo", "hi"}.intersection(message_columns(codec, direction)))


# ---------------------------------------------------------------- bits of one message

def _width(n: int) -> int:
    """ceil(log2(n)), 0 for 1."""
    return max(0, int(n) - 1).bit_length()


def _to_bits(numbers: np.ndarray, width: int) -> np.ndarray:
    """Numbers below 2^width as bits, highest first."""
    raw = np.ascontiguousarray(numbers, ">u4").view(np.uint8).reshape(-1, 4)
    return np.unpackbits(raw, axis=1)[:, 32 - width:].reshape(-1)


def _from_bits(bits: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(0, np.int64)
    wide = np.zeros((len(bits) // width, 32), np.uint8)
    wide[:, 32 - width:] = bits.reshape(-1, width)
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype(np.int64)


def _float_bits(values: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(values, ">f2" if width == 16 else ">f4").view(np.uint8))


def _bits_float(bits: np.ndarray, width: int) -> np.ndarray:
    return np.packbits(bits).view(">f2" if width == 16 else ">f4").astype(np.float32)


def _value_width(codec: str) -> int:
    return DENSE_WIDTH.get(codec, 16 if codec.endswith("16") else 32)


def pack_message(codec: str, direction: str, samples: int, dims: int, parts: dict) -> bytes:
    columns = message_columns(codec, direction)
    values = np.asarray(parts[next(c for c in columns if c in ("vals", "codes", "val"))])
    head, tail = (np.asarray(parts.get(c, ()), np.int64) for c in ("head", "tail"))
    width, sparse = _value_width(codec), codec not in DENSE_WIDTH
    q0, q1, q2 = _width(samples), _width(dims), _width(samples * dims)
    out = struct.pack(HEADER, CODECS.index(codec), direction == "grad", q0, q1, samples, dims, len(values), len(head), len(tail))
    out += b"".join(struct.pack("<d", parts[c]) for c in columns if c in ("scale", "lo", "hi"))
    bits = []
    if sparse:
        bits += [_to_bits(np.array([samples - 1]), q0), _to_bits(np.array([dims - 1]), q1)]
        bits += [_to_bits(np.asarray(x, np.int64), q2) for x in (head, tail, parts.get("idx", ()))]
    bits.append(_to_bits(values, width) if "codes" in columns else _float_bits(values, width))
    return out + np.packbits(np.concatenate(bits)).tobytes()


def unpack_message(data: bytes) -> dict:
    number, grad, q0, q1, samples, dims, n, heads, tails = struct.unpack_from(HEADER, data)
    codec, direction = CODECS[number], "grad" if grad else "emb"
    columns = message_columns(codec, direction)
    out: dict = {"codec": codec, "direction": direction, "samples": samples, "dims": dims}
    at = struct.calcsize(HEADER)
    for c in (c for c in columns if c in ("scale", "lo", "hi")):
        out[c] = struct.unpack_from("<d", data, at)[0]
        at += 8
    bits, width, q2 = np.unpackbits(np.frombuffer(data, np.uint8, offset=at)), _value_width(codec), _width(samples * dims)
    place = q0 + q1 if codec not in DENSE_WIDTH else 0
    for c, size in (("head", heads), ("tail", tails), ("idx", n)):
        if c in columns:
            # a matrix of one cell has positions of no bits, all of them 0
            out[c] = _from_bits(bits[place:place + size * q2], q2) if q2 else np.zeros(size, np.int64)
            place += size * q2
    values = bits[place:place + n * width]
    if "codes" in columns:
        out["codes"] = _from_bits(values, width)
    else:
        out["val" if "val" in columns else "vals"] = _bits_float(values, width)
    return out


# ---------------------------------------------------------------- columns

def payload(codec: str, direction: str = "emb", message: str | None = None) -> Column:
    """The packed bytes of the message in the current row, or in its struct column ``message`` (Arrow batches of
    messages, each bounded by its batch)."""
    columns = message_columns(codec, direction)

    @F.pandas_udf("binary")
    def run(parts: pd.DataFrame) -> pd.Series:
        rows = (dict(zip(parts.columns, r)) for r in parts.itertuples(index=False, name=None))
        return pd.Series([pack_message(codec, direction, int(r["samples"]), int(r["dims"]), r) for r in rows], dtype=object)

    held = [F.col(message)[c].alias(c) if message else F.col(c) for c in columns]
    return run(F.struct("samples", "dims", *held))


def unpacked(data: str | Column, codec: str, direction: str = "emb") -> Column:
    """Struct of samples, dims and the message's columns; a payload of another codec or direction is an error."""
    columns = ["samples", "dims", *message_columns(codec, direction)]
    types = dict(f.strip().split(" ") for f in ("samples int, dims int, " + MESSAGE).split(","))

    @F.pandas_udf(", ".join(f"{c} {types[c]}" for c in columns))
    def run(data: pd.Series) -> pd.DataFrame:
        rows = [unpack_message(bytes(x)) for x in data]
        wrong = {(r["codec"], r["direction"]) for r in rows} - {(codec, direction)}
        if wrong:
            raise ValueError(f"payloads of {sorted(wrong)}, not of {codec} {direction}")
        return pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=None if c in ("samples", "dims", "scale", "lo", "hi")
                                          else object) for c in columns})

    return run(F.col(data) if isinstance(data, str) else data)


def unpack(df: DataFrame, codec: str, direction: str = "emb", payload_col: str = "payload") -> DataFrame:
    """Replaces the payload by samples, dims and the message's columns: what :func:`.codec.encode` gave, for
    :func:`.codec.decode` to read."""
    others = [c for c in df.columns if c not in (payload_col, "samples", "dims", *message_columns(codec, direction))]
    return df.select(*others, unpacked(payload_col, codec, direction).alias("_pf_m")).select(*others, "_pf_m.*")

"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    na, nb = norm(a), norm(b)
    return F.when((F.size(a) != F.size(b)) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    return F.when(norm(a) == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / norm(a)))


def quantize(a: Column) -> Column:
    """``struct(min, max, codes)``: codes truncate (x - min) * 127 / (max - min) to one byte; not-a-number counts 0."""
    clean = F.filter(_double(a), lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    low, high = F.coalesce(F.array_min(clean), F.lit(0.0)), F.coalesce(F.array_max(clean), F.lit(0.0))
    scale = F.when(high == low, F.lit(1.0)).otherwise(127.0 / (high - low))
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    code = lambda x: F.when(bad(x), F.lit(0)).otherwise(F.least(F.greatest((x - low) * scale, F.lit(-128.0)), F.lit(127.0)).cast("int")).cast("tinyint")
    return F.struct(low.alias("min"), high.alias("max"), F.transform(_double(a), code).alias("codes"))


def dequantize(q: Column) -> Column:
    scale = F.when(q["max"] == q["min"], F.lit(1.0)).otherwise((q["max"] - q["min"]) / 127.0)
    return F.transform(q["codes"], lambda c: q["min"] + c.cast("double") * scale)


def encode_blob(v: list[float]) -> bytes:
    """Little-endian float32, as stored vectors are."""
    return struct.pack(f"<{len(v)}f", *v)


def decode_blob(b: bytes) -> list[float]:
    if len(b) % 4:
        raise ValueError("the length of a vector blob is a multiple of 4")
    return list(struct.unpack(f"<{len(b) // 4}f", b))


def quantized_bytes(q: Column) -> Column:
    """``quantize`` as bytes: one signed byte a value; the range stands beside it in the table."""
    return F.unhex(F.array_join(F.transform(q["codes"], lambda c: F.lpad(F.hex(F.pmod(c.cast("int"), F.lit(256))), 2, "0")), ""))


def bytes_quantized(low: Column, high: Column, data: Column) -> Column:
    """The struct of ``quantize`` from range and bytes."""
    hexed = F.hex(data)
    byte = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    signed = lambda b: F.when(b > 127, b - 256).otherwise(b).cast("tinyint")
    at = F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.struct(low.alias("min"), high.alias("max"), F.transform(at, lambda i: signed(byte(i))).alias("codes"))

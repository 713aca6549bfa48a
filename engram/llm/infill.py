"""Fill-in-middle transformation with big-integer bit masks.

A text is its UTF-8 bytes, and a set of byte positions is one integer with a bit a byte, the first byte lowest.
``bytes.translate`` maps each byte to the digit 1 or 0 of a class and base 2 reads the digits, so a mask costs no loop over
characters. Shifted boolean operations mark where units start, ``bit_count`` gives their number n, and the k-th start is
found by halving: the lower half's bit count says which half holds it, and the search goes on there. All of it is linear
in the text.

Units: ``char`` (code points), ``word`` (a word with the blanks after it; leading blanks belong to the first) or ``line``
(with its line end). Every cut lies between two units, and the three pieces in their first order are the text.

The cuts, whether a text is transformed and in which order come from the sha256 of ``seed:key``; rows are independent and
reruns agree. A text that contains one of the marks stays plain, so ``restore`` can split the output at the marks.

Edge cases: a null text counts as empty; an empty text is plain with n = 0; a null key hashes as ``seed:``; repeated rows
each get the same answer; a text of blanks has no words, so it is one unit as ``word``; an empty table stays empty; extra
columns pass through whatever their names, but one named as ``out`` is replaced. The memory of a task is one Arrow batch
and a few copies of one text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.common import BLANKS

RESULT = "struct<n:bigint,form:string,prefix_units:bigint,middle_units:bigint,output:string>"
UNITS = ("char", "word", "line")


@dataclass(frozen=True)
class Plan:
    """Marks, the share (in hundredths) of texts that are transformed, and of these the share in suffix-first order."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    seed: int = 1
    unit: str = "char"


def _digits(members: bytes | range) -> bytes:
    inside = set(members)
    return bytes(0x31 if b in inside else 0x30 for b in range(256))


TAIL = _digits(range(0x80, 0xC0))
SOLID = _digits(set(range(256)) - set(BLANKS.encode()))
NEWLINE = _digits(b"\n")


def mask(data: bytes, digits: bytes) -> int:
    """The bytes of a class as one integer; bit i stands for byte i."""
    return int(data[::-1].translate(digits), 2) if data else 0


def starts(data: bytes, unit: str = "char") -> int:
    """The mask of the bytes that begin a unit; no bit for an empty text."""
    full = (1 << len(data)) - 1
    if unit == "char":
        return full & ~mask(data, TAIL)
    if unit == "line":
        return full & (mask(data, NEWLINE) << 1 | 1)
    solid = mask(data, SOLID)
    return solid & ~(solid << 1) or full & 1


def select(bits: int, width: int, k: int) -> int:
    """The position of set bit number ``k``, counted from 0, among the lowest ``width`` bits."""
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        inside = low.bit_count()
        if k < inside:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - inside, at + half
    return at


def cut(data: bytes, bits: int, n: int, k: int) -> int:
    """The byte after the first ``k`` of ``n`` units."""
    return 0 if k == 0 else len(data) if k == n else select(bits, len(data), k)


def infill(text: str | None, key: object, plan: Plan = Plan()) -> tuple:
    """(n, form, units of the prefix, units of the middle, output) of one text."""
    data = (text or "").encode()
    bits = starts(data, plan.unit)
    n = bits.bit_count()
    digest = hashlib.sha256(f"{plan.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    marks = [m.encode() for m in (plan.prefix, plan.suffix, plan.middle)]
    if not data or h3 % 100 >= plan.transformed or any(m in data for m in marks):
        return n, "plain", None, None, text or ""
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut(data, bits, n, first), cut(data, bits, n, second)
    prefix, middle, suffix = marks[0] + data[:a], marks[2] + data[a:b], marks[1] + data[b:]
    spm = h4 % 100 < plan.suffix_first
    return n, "spm" if spm else "psm", first, second - first, b"".join((suffix, prefix, middle) if spm else (prefix, suffix, middle)).decode()


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan(), out: str = "infill") -> DataFrame:
    """``docs`` with a struct column ``out``: n, form, prefix_units, middle_units (null if plain) and output."""
    if plan.unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    names, kinds = ("n", "form", "prefix_units", "middle_units", "output"), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    @F.arrow_udf(RESULT)
    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = [infill(t.as_py(), k, plan) for k, t in zip(keys.to_pylist(), texts, strict=True)]
        columns = zip(*rows, strict=True) if rows else [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], list(names))

    return docs.withColumn(out, run(F.col(key).cast("string"), F.col(text)))


def restore(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text of an output: split at the marks and put in order again."""
    part = lambda i: F.get(F.split(output, "|".join(rf"\Q{m}\E" for m in (plan.prefix, plan.suffix, plan.middle)), -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)

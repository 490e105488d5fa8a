"""Seeds and framed digests from built-in hash functions; every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED_DIGITS = 20


def _bytes(value: Column) -> Column:
    return F.encode(value, "utf-8")


def u64_from_hash(digest: Column) -> Column:
    """First eight bytes of a hex digest as a 20-digit decimal string."""
    return F.lpad(F.conv(F.substring(digest, 1, 16), 16, 10), SEED_DIGITS, "0")


def u64_bytes(decimal_text: Column) -> Column:
    """Big-endian eight bytes of an unsigned 64-bit number given as decimal text."""
    return F.unhex(F.lpad(F.conv(decimal_text, 10, 16), 16, "0"))


def derive_seed(root_seed: Column, *parts: Column) -> Column:
    """Text form: root seed and parts joined by the unit separator, hashed, first eight bytes."""
    return u64_from_hash(F.sha2(F.concat_ws("\x1f", root_seed, *parts), 256))


def derive_stage_seed(root_seed: Column, stage_id: Column, domain: str) -> Column:
    """Binary form: domain, NUL, eight seed bytes, NUL, stage id. Differs from the text form by design."""
    nul = F.unhex(F.lit("00"))
    return u64_from_hash(F.sha2(F.concat(_bytes(F.lit(domain)), nul, u64_bytes(root_seed), nul, _bytes(stage_id)), 256))


def framed_digest(domain: str, *fields: Column) -> Column:
    """SHA-256 over the domain and the binary fields, each preceded by its length in eight big-endian bytes."""
    framed = []
    for field in (_bytes(F.lit(domain)), *fields):
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(field).cast("bigint")), 16, "0")), field]
    return F.sha2(F.concat(*framed), 256)


def low_bit_of_first_byte(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2

"""Content-addressed ids, stable fractions, splits and sketches."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Borders of the hash split.
TEST_BELOW, VAL_BELOW = 0.05, 0.10


def stable_fraction(c: Column) -> Column:
    """The first eight bytes of the SHA-256 of c as a fraction of 2^64."""
    return (F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")) / F.lit(2.0**64)


def stable_fraction_sql(c: str) -> str:
    return f"(CAST(CAST('0x' || substr(sha256({c}), 1, 16) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0)"


def hash_split(c: Column) -> Column:
    """train, val or test by the stable fraction."""
    f = stable_fraction(c)
    return F.when(f < TEST_BELOW, "test").when(f < VAL_BELOW, "val").otherwise("train")


def hash_split_sql(c: str) -> str:
    f = stable_fraction_sql(c)
    return f"CASE WHEN {f} < {TEST_BELOW} THEN 'test' WHEN {f} < {VAL_BELOW} THEN 'val' ELSE 'train' END"


def record_id(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 over the NUL-joined parts."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 20)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash_of(tokens: list[str], n: int = 5) -> int:
    """SimHash-64 of token shingles with their counts as weights; SHA-256 features; a bit is set where the
    vote is not negative; no tokens give 0. Signed, as BIGINT stores it."""
    if not tokens:
        return 0
    grams = Counter(" ".join(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1)))
    heads = b"".join(hashlib.sha256(g.encode()).digest()[:8] for g in grams)
    bits = np.unpackbits(np.frombuffer(heads, dtype=np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    votes = np.fromiter(grams.values(), dtype=np.int64, count=len(grams)) @ (2 * bits - 1)
    return int.from_bytes(np.packbits(votes >= 0).tobytes(), "big", signed=True)


def multiset_fingerprint(line: Column) -> Column:
    """Aggregate: SHA-256 over the number of lines and two sums of 60-bit parts of their SHA-256. It does
    not depend on order and is combined on the map side, so no group of lines is ever gathered."""
    part = lambda at: F.sum(F.conv(F.substring(F.sha2(line, 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)), 256)


def multiset_fingerprint_sql(line: str) -> str:
    part = lambda at: f"CAST(sum(CAST('0x' || substr(sha256({line}), {at}, 15) AS BIGINT)) AS VARCHAR)"
    return f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {part(1)}, {part(16)}))"

"""Exact and near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.functions.ident import hamming


def first_wins(df: DataFrame, key: str, order: list[str], ident: str) -> DataFrame:
    """df with `first_id`, the id of the first row of its key in `order` (nulls first), and `duplicate`.

    The first row is an aggregate with map-side combining, not a window, so that a key which a third of
    all rows share is not gathered into one task; the join back is left to adaptive skew handling.
    """
    best = df.groupBy(key).agg(F.min_by(ident, F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("first_id"))
    return df.join(best, key).withColumn("duplicate", F.col(ident) != F.col("first_id"))


def near_first_match(df: DataFrame, ident: str, distance: int = 3, ratio: float = 0.8) -> DataFrame:
    """df(ident, tokens, simhash) -> (ident, near_duplicate_of): for each row the least id below its own in
    the same bucket, whose SimHash is within `distance` bits and whose token counts are within `ratio`.

    The bucket is the upper 16 bits of the SimHash, exclusive-or the binary logarithm of the token count.
    Rows with the same SimHash and token count are one class; classes are compared, not rows, so copies
    cost nothing, and each class stands for itself by its least id, which is all that any row can need.
    Two classes that differ in at most `distance` bits agree in one of distance + 1 pieces of the lower 48
    bits, so they are compared only where bucket and such a piece are the same; no bucket is one task.
    """
    bucket = F.shiftrightunsigned("simhash", 48).bitwiseXOR(F.floor(F.log2(F.col("tokens").cast("double"))).cast("long"))
    c = df.groupBy("simhash", "tokens").agg(F.min(ident).alias("low"))
    width = 48 // (distance + 1)
    piece = lambda i: F.shiftrightunsigned("simhash", i * width).bitwiseAND(F.lit((1 << width) - 1))
    c = c.withColumns({"bucket": bucket, "piece": F.explode(F.array(*[F.struct(F.lit(i).alias("i"), piece(i).alias("v")) for i in range(distance + 1)]))})
    a, b = c.alias("a"), c.alias("b")
    close = (
        (F.col("a.bucket") == F.col("b.bucket"))
        & (F.col("a.piece") == F.col("b.piece"))
        & (hamming(F.col("a.simhash"), F.col("b.simhash")) <= distance)
        & (F.least("a.tokens", "b.tokens") >= F.greatest("a.tokens", "b.tokens") * ratio)
    )
    best = a.join(b, close).groupBy(F.col("a.simhash").alias("simhash"), F.col("a.tokens").alias("tokens")).agg(F.min("b.low").alias("best"))
    out = df.join(best, ["simhash", "tokens"])
    return out.where(F.col("best") < F.col(ident)).select(ident, F.col("best").alias("near_duplicate_of"))

"""Vectors, overlaps and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lex_tokens


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; null elements count as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared distinct elements over the smaller set; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(0.0)


def document_key(path: Column) -> Column:
    """First 12 hex digits of the path's SHA-256."""
    return F.substring(F.sha2(path, 256), 1, 12)


def hash_features(df: DataFrame, id_col: str, text_col: str, dimension: int = 64) -> DataFrame:
    """(id, dim, weight): signed feature hashing of lexical tokens, L2-normalised; texts without tokens give no row.

    The place is the first four bytes of the token's MD5 modulo the dimension, the sign the parity of the fifth.
    """
    digest = F.md5("token")
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dimension
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    raw = (
        df.select(F.col(id_col).alias("id"), F.explode(lex_tokens(F.col(text_col))).alias("token"))
        .groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("id", place.cast("int").alias("dim")).agg(F.sum(F.col("n") * sign).cast("double").alias("w"))
    )
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").where(F.col("norm") > 0).select("id", "dim", (F.col("w") / F.col("norm")).alias("weight"))


def dense_vectors(features: DataFrame, dimension: int = 64) -> DataFrame:
    """(id, embedding ARRAY<DOUBLE>) of rows (id, dim, weight); absent places are 0."""
    by_dim = F.map_from_entries(F.collect_list(F.struct("dim", "weight")))
    wide = features.groupBy("id").agg(by_dim.alias("m"))
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    return wide.select("id", F.transform(places, lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0))).alias("embedding"))

"""Which of many patterns stand in which texts, by an inverted index of q-grams.

Every pattern is looked up by one of its q-grams, the one that the fewest texts have; texts and patterns meet by equality of
that q-gram and only then are compared.  Patterns shorter than q are q-grams of their own length.  So no text meets all patterns,
however many there are; a q-gram that many texts have is chosen only where a pattern has no rarer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q = 4


def grams(text: Column, q: int) -> Column:
    """The distinct q-grams of a text; none if it is shorter."""
    chars = F.split(text, "")
    each = F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.concat(*[F.element_at(chars, (i + k).cast("int")) for k in range(q)]))
    return F.when(F.length(text) >= q, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def rarest(patterns: DataFrame, texts: DataFrame, pattern: str, text: str, q: int = Q) -> DataFrame:
    """The distinct patterns of q characters or more with the q-gram that the fewest texts have (ties by the q-gram)."""
    own = patterns.where(F.length(pattern) >= q).select(F.col(pattern).alias("_p")).distinct().select("_p", F.explode(grams(F.col("_p"), q)).alias("_g"))
    wanted = own.select(F.col("_g").alias("_w")).distinct()
    seen = texts.select(F.explode(grams(F.col(text), q)).alias("_t")).join(wanted, F.col("_t") == F.col("_w"), "left_semi").groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    return own.join(seen, F.col("_g") == F.col("_t"), "left").groupBy("_p").agg(F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0)), "_g")).alias("_g"))


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str, q: int = Q, by: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``texts`` joined with each row of ``patterns`` whose pattern (not empty) stands in the text; with ``by`` those
    alone whose columns of these names are equal."""
    keyed = rarest(patterns, texts, pattern, text, q)
    long = patterns.join(keyed, F.col(pattern) == F.col("_p")).drop("_p")
    short = [patterns.where(F.length(pattern) == k).withColumn("_g", F.col(pattern)) for k in range(1, q)]
    index = long
    for s in short:
        index = index.unionByName(s)
    wanted = index.select(F.col("_g").alias("_w")).distinct()
    each = F.flatten(F.array(*[grams(F.col(text), k) for k in range(1, q + 1)]))
    asked = texts.withColumn("_t", F.explode(each)).join(wanted, F.col("_t") == F.col("_w"), "left_semi")
    same = F.col(by[0]) == F.col(by[1]) if by else F.lit(True)
    return asked.join(index, (F.col("_t") == F.col("_g")) & same).where(F.col(text).contains(F.col(pattern))).drop("_t", "_g")

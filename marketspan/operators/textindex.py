"""Containment of one text in another by q-grams: looked up by the rarest gram, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct runs of so many characters; none of a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(places, lambda k: F.substring(text, k, size)))).otherwise(F.array().cast("array<string>"))


def _sized(text: Column, size: int) -> Column:
    """The grams of up to ``size`` characters, as array of struct(size, gram)."""

    def of(n: int) -> Column:
        return F.transform(grams(text, n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram")))

    return F.flatten(F.array(*[of(n) for n in range(1, size + 1)]))


def gram_index(rows: DataFrame, key: str, text: Column, size: int = GRAM) -> DataFrame:
    """(size, gram, key): the grams of ``size`` characters of each text, and the shorter ones by which shorter texts are looked up."""
    return rows.select(key, F.inline(_sized(text, size))).distinct()


def contained(needles: DataFrame, texts: DataFrame, *, needle: str, text: str, size: int = GRAM) -> DataFrame:
    """Pairs of a needle row and a text row whose text contains the needle.

    Grams are counted over the texts; a needle is looked up by its gram that the
    fewest texts have (a needle shorter than a gram by the whole of it), and only what
    has this gram is compared.  Null and empty needles are in no text.  Columns must differ between both sides; each side's rows
    should be distinct texts, as a repeated one is looked up again.
    """
    asked = needles.where(F.length(needle) > 0)
    wanted = asked.select(needle, F.inline(_sized(F.col(needle), size))).distinct().where(F.col("size") == F.least(F.length(needle), F.lit(size)))
    # only grams that a needle has are counted and kept
    listed = texts.select(*texts.columns, F.inline(_sized(F.col(text), size))).join(wanted.select("size", "gram").distinct(), ["size", "gram"], "left_semi")
    often = listed.groupBy("size", "gram").agg(F.count("*").alias("_n"))
    rarest = wanted.join(often, ["size", "gram"], "left").groupBy(needle, "size").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_r")).where("_r.n > 0")
    keyed = asked.join(rarest.select(needle, "size", "_r.gram"), needle)
    return keyed.join(listed, ["size", "gram"]).where(F.col(text).contains(F.col(needle))).select(*needles.columns, *texts.columns)


def candidates(index: DataFrame, key: str, needle: str, size: int = GRAM) -> DataFrame | None:
    """The keys whose texts have the rarest gram of a needle, by an index of texts; the needle is still to be compared.

    None for an empty needle, which every text contains.
    """
    if not needle:
        return None
    n = min(size, len(needle))
    own = index.where((F.col("size") == n) & F.col("gram").isin(sorted({needle[k : k + n] for k in range(len(needle) - n + 1)})))
    rarest = own.groupBy("gram").agg(F.count("*").alias("_n")).orderBy("_n", "gram").limit(1).select("gram")
    return own.join(F.broadcast(rarest), "gram", "left_semi").select(key).distinct()

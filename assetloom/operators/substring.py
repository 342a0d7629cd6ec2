"""Which words contain which parts, by equi-joins on grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.sources.scratch import small_side, stored

#: Characters of grams: a part is met by runs of the most of these that it has room for.
SIZES = (1, 2, 3, 4, 6, 8, 12, 16, 24)


def _grams(text: Column, sizes: Column) -> Column:
    """All distinct runs of each of these numbers of characters; a shorter text has none."""
    fitting = F.filter(sizes, lambda n: n <= F.length(text))
    runs = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n))))
    return F.array_distinct(runs)


def matches(parts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (word, ...) once for every part that the word contains, with that as ``part``; empty and null parts have none.

    A part is met by the one of its longest grams that the fewest rows have, and the pair is then verified, so no part is
    held against all words. Rows are read twice and stay where they are as long as parts are few enough to be broadcast."""
    asked = stored(parts.select("part").filter("part <> ''").distinct())
    if asked.isEmpty():
        return rows.limit(0).withColumn("part", F.col("word"))
    size = F.array_max(F.filter(F.array(*map(F.lit, SIZES)), lambda n: n <= F.length("part")))
    wanted = stored(asked.select("part", size.alias("size"), F.explode(_grams(F.col("part"), F.array(size))).alias("gram")))
    sizes = sorted(r.size for r in wanted.select("size").distinct().collect())  # some of SIZES
    of_word = F.explode(_grams(F.col("word"), F.array(*map(F.lit, sizes)))).alias("gram")
    frequency = rows.select(of_word).join(small_side(wanted.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no row has rules its part out
    rarest = wanted.join(frequency, "gram", "left").groupBy("part").agg(F.min_by(F.struct("gram", "n"), F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("g"))
    met = small_side(rarest.filter("g.n is not null").select("part", "g.gram"))
    return rows.select("*", of_word).join(met, "gram").filter(F.col("word").contains(F.col("part"))).drop("gram")


def containing(parts: DataFrame, words: DataFrame) -> DataFrame:
    """(part, word) for every word that contains the part, once each; empty and null parts have none.

    ``parts`` has a column part, ``words`` a column word."""
    return matches(parts, stored(words.select("word").filter("word is not null").distinct())).select("part", "word")

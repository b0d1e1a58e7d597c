"""Joins of texts by the words they share, without meeting at common words.

Words are put in one order, the rarest first. If two sets share `least` words, they share
one of the first n - least + 1 words of the one, whatever the other has of them: only such
prefixes are joined, and what they find is counted exactly. A word that all texts have is
in a prefix only of texts with hardly any other word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvana.plans.tables import shared_folder


def _written(rows: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read from there: what joins them sees a plain scan."""
    uri = shared_folder(rows.sparkSession)
    rows.write.parquet(uri)
    return rows.sparkSession.read.schema(rows.schema).parquet(uri)


def frequencies(*sides: DataFrame) -> DataFrame:
    """word, df over the sides (columns id, words), counted with map-side combine and written first.

    A join with an aggregate right below it would keep Spark from splitting a word that very many rows have.
    """
    words = [s.select(F.explode("words").alias("word")) for s in sides]
    every = words[0]
    for w in words[1:]:
        every = every.union(w)
    return _written(every.groupBy("word").agg(F.count(F.lit(1)).alias("df")))


def ranked(rows: DataFrame, df: DataFrame) -> DataFrame:
    """id, n, word, place of every word of every row (id, words); place 1 is the rarest. A row bounds a task's group."""
    each = rows.select("id", F.size("words").alias("n"), F.explode("words").alias("word"))
    w = Window.partitionBy("id").orderBy("df", "word")
    return each.join(df, "word").select("id", "n", "word", F.row_number().over(w).alias("place"))


def needed(n: Column, threshold: float) -> Column:
    """The fewest words of a set of n that reach an overlap coefficient with a larger one."""
    return F.greatest(F.lit(1), F.ceil(n * threshold - 1e-9).cast("int"))


def overlapping(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b, overlap of pairs of left (id, words) and right whose overlap coefficient reaches the threshold (above 0).

    The smaller set's prefix meets all words of the larger one, in both directions.
    """
    df = frequencies(left, right)
    x = ranked(left, df).toDF("a", "na", "word", "pa")
    y = ranked(right, df).toDF("b", "nb", "word", "pb")
    small_x = x.filter(F.col("pa") <= F.col("na") - needed(F.col("na"), threshold) + 1).join(y, "word").filter("na <= nb")
    small_y = x.join(y.filter(F.col("pb") <= F.col("nb") - needed(F.col("nb"), threshold) + 1), "word").filter("na > nb")
    pairs = small_x.select("a", "b").union(small_y.select("a", "b")).distinct()
    both = pairs.join(left.toDF("a", "_l"), "a").join(right.toDF("b", "_r"), "b")
    overlap = F.size(F.array_intersect("_l", "_r")) / F.least(F.size("_l"), F.size("_r"))
    return both.select("a", "b", overlap.alias("overlap")).filter(F.col("overlap") >= threshold)


def sharing(rows: DataFrame, least: int) -> DataFrame:
    """a, b, shared of pairs of rows (id, words; a before b) that share at least `least` words: prefixes of both meet."""
    r = ranked(rows, frequencies(rows)).filter(F.col("place") <= F.col("n") - least + 1)
    x, y = r.select(F.col("id").alias("a"), "word"), r.select(F.col("id").alias("b"), "word")
    pairs = x.join(y, "word").filter("a < b").select("a", "b").distinct()
    both = pairs.join(rows.toDF("a", "_l"), "a").join(rows.toDF("b", "_r"), "b")
    return both.select("a", "b", F.size(F.array_intersect("_l", "_r")).cast("long").alias("shared")).filter(F.col("shared") >= least)


def first_sharing(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """a, b, shared words: for each left row (id, words) the first `most` right rows (id, ord, words), in their order, that share a word.

    Of the right rows with a word only the first `most` can be among a left row's, so a
    word meets no more of them.
    """
    w = Window.partitionBy("word").orderBy("ord", "id")
    posted = right.select("id", "ord", F.explode("words").alias("word")).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    met = left.select(F.col("id").alias("a"), F.explode("words").alias("word")).join(posted.select(F.col("id").alias("b"), "ord", "word"), "word")
    pairs = met.groupBy("a", "b", "ord").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    first = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("ord", "b"))).filter(F.col("_r") <= most).select("a", "b")
    both = first.join(left.toDF("a", "_l"), "a").join(right.select(F.col("id").alias("b"), F.col("words").alias("_r")), "b")
    return both.select("a", "b", F.sort_array(F.array_intersect("_l", "_r")).alias("shared"))

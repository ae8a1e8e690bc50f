"""How much of a paragraph was said before: shares of its word runs found in the filing it is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.functions import text as T


def runs_of(rows: DataFrame, keys: list[str], text: str, width: int = 4) -> DataFrame:
    """keys, position, run: every run of `width` words with its place; the whole text where it has no more words than that."""
    words = T.said(F.col(text))
    sized = rows.select(*keys, words.alias("w")).where(F.size("w") > 0)
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return sized.select(*keys, F.posexplode(F.transform(places, lambda i: F.array_join(F.slice("w", i, width), " "))).alias("position", "run"))


def overlaps(quotes: DataFrame, texts: DataFrame, key: str, against: str, width: int = 4) -> DataFrame:
    """key, runs, found, share: of each quote's distinct runs those that stand in the text `against` which it is compared.

    `quotes` has key, `against` and quote; `texts` has `against` and text.  Runs meet in a join on (text, run), so no
    task holds a filing's runs; a run that many quotes share is looked up once.
    """
    mine = runs_of(quotes.select(key, against, "quote"), [key, against], "quote", width).select(key, against, "run").distinct()
    known = runs_of(texts.select(against, "text"), [against], "text", width).select(against, "run").distinct()
    looked = mine.join(known.withColumn("there", F.lit(1)), [against, "run"], "left")
    return looked.groupBy(key).agg(F.count("*").alias("runs"), F.count("there").alias("found")).withColumn("share", F.bround(F.col("found") / F.col("runs"), 6))


def new_words(quotes: DataFrame, texts: DataFrame, key: str, against: str, width: int = 4) -> DataFrame:
    """key, words, new, longest: words of a quote in no run that the text has too, and the longest row of them.

    Quotes of fewer than `width` words are left out: they are looked for by name.
    """
    long = quotes.select(key, against, "quote", F.size(T.said(F.col("quote"))).alias("n")).where(F.col("n") >= width)
    known = runs_of(texts.select(against, "text"), [against], "text", width).select(against, "run").distinct()
    mine = runs_of(long, [key, against, "n"], "quote", width)
    hits = mine.join(known.withColumn("there", F.lit(1)), [against, "run"], "left").groupBy(key, "n").agg(F.collect_set(F.when(F.col("there") == 1, F.col("position"))).alias("hits"))
    # a word is covered by any of the runs that start up to width - 1 words before it
    marks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: ~F.exists("hits", lambda h: (h <= i) & (i < h + width)))
    rows = hits.withColumn("marks", marks)
    step = lambda acc, m: F.struct(F.when(m, acc["run"] + 1).otherwise(0).alias("run"), F.greatest(acc["best"], F.when(m, acc["run"] + 1).otherwise(0)).alias("best"))
    longest = F.aggregate("marks", F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda acc: acc["best"])
    return rows.select(key, F.col("n").alias("words"), F.size(F.filter("marks", lambda m: m)).alias("new"), longest.alias("longest"))


def already_said(quotes: DataFrame, texts: DataFrame, key: str, against: str) -> DataFrame:
    """Keys of quotes that the compared text holds too: half their runs found, and no new clause of four words in a row."""
    shares = overlaps(quotes, texts, key, against)
    fresh = new_words(quotes, texts, key, against)
    return shares.join(fresh, key).where((F.col("share") >= 0.5) & (F.col("longest") < 4)).select(key)

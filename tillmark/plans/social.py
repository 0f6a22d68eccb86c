"""Lexicon sentiment over posts.

Tokens are exploded and matched to the lexicon; the sums per post are combined
on the map side before the shuffle, so a long post costs one row there. The
lexicon is a table: Spark broadcasts it while it is small and shuffles both
sides once it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions import scalars as S



# Links, mentions, and runs of anything that is neither a letter nor a mark of any script separate words.
WORD_BREAK = r"https?://\S+|@[\p{L}\p{M}\p{N}_]*|[^\p{L}\p{M}@]+"


def tokens(text: Column) -> Column:
    """Lower-case words of the whole text, none of a null one; links and mentions are dropped."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def tokenize(posts: DataFrame, keep: Sequence[str] = ("post_id",)) -> DataFrame:
    return posts.select(*keep, F.posexplode(tokens(F.col("text"))).alias("position", "token"))


def polarity(posts: DataFrame, lexicon: DataFrame, negators: Sequence[str] = ("not", "no", "never"),
             keep: Sequence[str] = ("brand", "country", "created_on", "engagement")) -> DataFrame:
    """Polarity (mean weight of the lexicon hits) and subjectivity (share of tokens hit) per post.

    A hit right after a negator counts with the opposite sign.
    """
    words = posts.select("post_id", *keep, tokens(F.col("text")).alias("_w")).withColumn("n_tokens", F.size("_w"))
    # Each token travels with the one before it. The empty token closing every post keeps posts without any
    # hit through the inner join, which drops all other misses before the aggregation.
    end = F.array(F.lit(""))
    paired = F.arrays_zip(
        F.concat(F.col("_w"), end).alias("token"), F.concat(F.array(F.lit(None).cast("string")), "_w").alias("before")
    )
    keys = ["post_id", *keep, "n_tokens"]
    exploded = words.select(*keys, F.explode(paired).alias("t")).select(*keys, "t.*")
    entries = lexicon.select("token", "weight", F.lit(1).alias("hit")).unionByName(
        lexicon.sparkSession.range(1).select(F.lit("").alias("token"), F.lit(0.0).alias("weight"), F.lit(0).alias("hit"))
    )
    sign = F.when(F.col("before").isin(list(negators)), -F.col("weight")).otherwise(F.col("weight"))
    out = exploded.join(entries, "token").groupBy(*keys).agg(F.sum("hit").alias("hits"), F.sum(sign).alias("_s"))
    return out.select(
        "post_id", *keep, "n_tokens", "hits",
        S.safe_ratio(F.col("_s"), F.col("hits")).alias("polarity"),
        S.safe_ratio(F.col("hits"), F.col("n_tokens")).alias("subjectivity"),
    )


def classify(scored: DataFrame, margin: float = 0.05) -> DataFrame:
    return scored.withColumn(
        "sentiment",
        F.when(F.col("polarity") > margin, "positive").when(F.col("polarity") < -margin, "negative").otherwise("neutral"),
    )


def sentiment_by(classified: DataFrame, *keys) -> DataFrame:
    return classified.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(F.col("sentiment") == "positive").alias("positive"),
        F.count_if(F.col("sentiment") == "negative").alias("negative"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral"),
        F.avg("polarity").alias("mean_polarity"),
    )


def stability(scored: DataFrame, by: str = "brand") -> DataFrame:
    return scored.groupBy(by).agg(F.stddev_samp("polarity").alias("polarity_std"), F.count(F.lit(1)).alias("posts"))


def engagement_correlation(scored: DataFrame, by: str | None = None) -> DataFrame:
    grouped = scored.groupBy(by) if by else scored.groupBy()
    return grouped.agg(F.corr("polarity", F.col("engagement").cast("double")).alias("correlation"))


# ---- lexicon learned from labelled posts -----------------------------------------
def word_log_odds(posts: DataFrame, labels: DataFrame, prior_words: float = 500.0) -> DataFrame:
    """(token, good, bad, log_odds, z) of every word of the labelled posts.

    `labels` has post_id and label (1 or 0). The log-odds of a word between the two groups are taken with an informative
    prior: `prior_words` imaginary words for each group, spread like the words of all labelled posts. z is the log-odds
    over its standard deviation.
    """
    words = tokenize(posts.join(labels, "post_id"), ("label",))
    counts = words.groupBy("token").agg(F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("bad"))
    totals = counts.agg(F.struct(F.sum("good").cast("double").alias("good"), F.sum("bad").cast("double").alias("bad"))).scalar()
    held = counts.withColumn("_t", totals)
    n, all_words = F.col("good") + F.col("bad"), F.col("_t.good") + F.col("_t.bad")
    prior = F.lit(prior_words) * n / all_words

    def odds(side: str) -> Column:
        seen = F.col(side) + prior
        return F.log(seen / (F.col(f"_t.{side}") + F.lit(prior_words) - seen))

    delta = odds("good") - odds("bad")
    spread = F.sqrt(1 / (F.col("good") + prior) + 1 / (F.col("bad") + prior))
    # a prior of every word at once leaves no odds against it: such a word says nothing
    return held.select("token", "good", "bad", F.coalesce(delta, F.lit(0.0)).alias("log_odds"), F.coalesce(delta / spread, F.lit(0.0)).alias("z"))


def learned_lexicon(posts: DataFrame, labels: DataFrame, prior_words: float = 500.0, least_z: float = 1.96) -> DataFrame:
    """(token, weight) of the words whose z-score is beyond `least_z`; the weight is the log-odds, shrunk by the prior."""
    return word_log_odds(posts, labels, prior_words).where(F.abs("z") >= least_z).select("token", F.col("log_odds").alias("weight"))


def agreement(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """How polarity and labels agree over the posts that both have: posts, hits, share of right signs where there is one."""
    both = scored.join(labels, "post_id")
    told = F.col("polarity") != 0
    right = (F.col("polarity") > 0) == (F.col("label") == 1)
    return both.agg(F.count(F.lit(1)).alias("posts"), F.count_if(told).alias("told"), F.count_if(told & right).alias("right"),
                    F.count_if(told & (F.col("label") == 1)).alias("good"))

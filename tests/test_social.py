"""Tokens of posts in several languages and scripts."""

from pyspark.sql import functions as F

from tillmark.plans import social


def words(spark, text):
    return spark.createDataFrame([(text,)], "text string").select(social.tokens(F.col("text"))).first()[0]


def test_accented_words_stay_whole(spark):
    assert words(spark, "Für Élan était über naïve") == ["für", "élan", "était", "über", "naïve"]
    assert words(spark, "Straße, señor; garçon!") == ["straße", "señor", "garçon"]


def test_other_scripts_and_combining_marks(spark):
    assert words(spark, "Привет мир 東京 नमस्ते") == ["привет", "мир", "東京", "नमस्ते"]
    assert words(spark, "étude") == ["étude"]


def test_links_mentions_and_digits_are_no_words(spark):
    assert words(spark, "see https://a.b/ü @Élise_1 now 24x7") == ["see", "now", "x"]


def test_no_letter_is_lost(spark, folder):
    posts = spark.read.parquet(f"{folder}/documents.parquet").where("text NOT LIKE '%@%' AND text NOT LIKE '%http%'")
    letters = F.length(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]", ""))
    kept = F.length(F.array_join(social.tokens(F.col("text")), ""))
    assert posts.where(letters != kept).count() == 0


def test_learned_lexicon_finds_the_words_that_tell(spark):
    posts = spark.createDataFrame([(i, ("fine " if i % 2 else "awful ") + "the day " * 3, "b", "c", None, 1) for i in range(60)]
                                  + [(100, "not fine", "b", "c", None, 1), (101, None, "b", "c", None, 1)],
                                  "post_id int, text string, brand string, country string, created_on date, engagement int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "post_id int, label int")
    lexicon = {r["token"]: r["weight"] for r in social.learned_lexicon(posts, labels, prior_words=10).collect()}
    assert set(lexicon) == {"fine", "awful"} and lexicon["fine"] > 0 > lexicon["awful"]
    scored = {r["post_id"]: r["polarity"] for r in social.polarity(
        posts, social.learned_lexicon(posts, labels, prior_words=10), keep=()).collect()}
    assert scored[1] > 0 > scored[0] and scored[100] < 0 and scored[101] == 0
    told = social.agreement(social.polarity(posts, social.learned_lexicon(posts, labels, prior_words=10), keep=()), labels).first()
    assert (told["posts"], told["told"], told["right"]) == (60, 60, 60)
    # more imaginary words shrink the odds
    shrunk = {r["token"]: r["log_odds"] for r in social.word_log_odds(posts, labels, prior_words=1000).collect()}
    assert 0 < shrunk["fine"] < lexicon["fine"]
    assert social.learned_lexicon(posts, labels.where("label > 1")).count() == 0

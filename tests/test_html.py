"""The two readers of tags agree, in Python and in the JVM."""

import random

from pyspark.sql import functions as F

from lexweave.functions import html

PARTS = ["<p>", "</p>", "a", " ", "<", ">", '"', "'", "=", "/", "!", "?", "<!--", "-->", "<b", "<prime ", "<a title='x > y'>", '<a title="<b>">', "<br/>", "<!DOCTYPE x>", "<?x?>", "é", "\n", " ", "<1", "< c>"]


def test_both_readers_agree(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(1, 14))) for _ in range(4000)] + ["prime <cotisation <b>x</b>", "<a " + 'b="c" ' * 50_000 + ">d", "<a " + "b " * 200_000, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_replace("t", html.TAG_JAVA, "|").alias("got"))
    for t, got in df.collect():
        assert got == html.TAG.sub("|", t), t[:200]


def test_a_less_than_sign_is_text(spark):
    df = spark.createDataFrame([("prime <cotisation <b>x</b>",)], "t string")
    assert df.select(F.regexp_replace("t", html.TAG_JAVA, "|")).first()[0] == "prime <cotisation |x|"

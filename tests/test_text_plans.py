"""Facts of texts: what is worked out once stands once in the plan, and the patterns over texts read what tokens say."""

import random

from pyspark.sql import functions as F

from hearth.functions import facts as T
from hearth.functions.posts import listings_from_posts
from hearth.functions.rent import rent
from hearth.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adverts_are_not_cut_into_tokens(spark, sf):
    assert "regexp_extract_all" not in plan(QUERIES["advert_facts"](spark, sf))


def test_rent_reads_each_label_once(spark):
    texts = spark.createDataFrame([("Rp 5jt/bulan",)], "t string")
    assert plan(texts.select(rent(F.col("t")).alias("r"))).count("(?:Z|[N1n]d?[MbYt]|[MbYtOo])") == 1


def test_posts_are_cleaned_once(spark):
    posts = spark.createDataFrame([(1, "Me", "Villa in the hills\nsee more")], "post_id long, poster string, text string")
    assert plan(listings_from_posts(posts)).count("see more") == 1


def test_least_stays_and_distances_as_tokens_say(spark):
    rnd, words = random.Random(3), ["min", "minimum", "5", "12", "2,5", "6", "month", "months", "years", "yr", "-", "to", ".", ",", "m2", "m²", "m", "km", "mins", "beach", "pantai", "villa", "walk", "distance", "x2", "\n", "to", "the"]
    texts = ["".join(rnd.choice(words) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(2, 9))) for _ in range(4000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4).cache()

    def by_tokens(tokens, kinds):
        before, wanted = r"l\.?[^E.!]{0,6}?", r"[NL]-?[MY]"
        n = T.behind(tokens, kinds, before, wanted).try_cast("int")
        return F.when(F.regexp_extract(kinds, before + wanted, 0).endswith("Y"), n * 12).otherwise(n)

    stays = rows.select("t", T.min_months(F.col("t")).alias("got"), T.typed(F.col("t"), by_tokens).alias("want"))
    assert stays.filter("got is not null").count() > 10
    assert stays.filter("not (got <=> want)").collect() == []

    # a distance in km comes first: of a range, the end
    def in_km(tokens, kinds):
        number = r"[NL](?:-[NL])?"
        lead = rf"(?:B[^E]{{0,5}}?(?={number}-?k)|(?={number}-?k[^NLE.!]{{0,6}}?B))"
        at = F.regexp_instr(kinds, F.lit(f"{lead}{number}"))
        rest = F.substring(kinds, at, F.length(kinds))
        return F.when(at > 0, T.amount(F.get(tokens, at - 2 + F.length(F.regexp_extract(rest, f"^{lead}{number}", 0)))))

    near = rows.select("t", T.beach_km(F.col("t")).alias("got"), T.typed(F.col("t"), in_km).alias("want")).filter("want is not null")
    assert near.count() > 10
    assert near.filter("not (got <=> want)").collect() == []


def test_texts_are_dealt_over_tasks(spark, sf):
    """A table in one row group is read by one task: its texts went through that task, however many there were."""
    for name, pattern in (("rent_in_text", "(?:Z|[N1n]d?[MbYt]|[MbYtOo])"), ("posts_to_listings", "see more")):
        lines = plan(QUERIES[name](spark, sf)).splitlines()
        dealt = [i for i, line in enumerate(lines) if "RepartitionByExpression [id" in line]
        # the outer steps of a plan are printed first
        assert dealt and max(i for i, line in enumerate(lines) if pattern in line) < dealt[0]

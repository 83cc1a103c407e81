"""Adapters over stored pages: partitions, hosts, faults."""

import pytest

from hearth.sources import sites as S


PAGES = [
    ("https://www.one.example/villa/12", "<title> Villa </title>"),
    ("https://m.one.example/", "<title>All</title>" + "".join(f'<a class="x" href="/villa/{i}">' for i in range(7)) + '<a href="/villa/0">'),
    ("https://two.example/a/7?x=1", '<title>Two</title><meta name="d" content="quiet">'),
    ("https://two.example/a/8", "no title"),
    ("https://notone.example/3", "<title>Other</title>"),
    (None, "<title>No address</title>"),
    ("https://two.example/a/9", None),
    ("http://[broken", "<title>Broken</title>"),
]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "pages")
    spark.createDataFrame(PAGES, "url string, html string").repartition(3).write.parquet(path)
    return path


def test_rows_of_all_adapters(spark, path):
    class Shouting(S.Adapter):  # in here, so that workers get it by value
        def detail(self, url, html):
            return {"title": self.title(html).upper(), "about": []}

    S.register(spark, [Shouting("one", ("one.example",)), S.Adapter("two", ("two.example",)), S.Adapter("rest")])
    df = spark.read.format("sites").option("path", path).load()
    assert df.rdd.getNumPartitions() >= 9  # an adapter and a file each
    got = {(r["source"], r["kind"], r["url"], r["ref"], r["title"], tuple(r["about"] or ()), r["error"]) for r in df.collect()}
    assert got == {
        ("one", "detail", PAGES[0][0], "12", "VILLA", (), None),
        ("one", "list", PAGES[1][0], None, "All", tuple(f"/villa/{i}" for i in range(7)), None),
        ("two", "detail", PAGES[2][0], "7", "Two", ("quiet",), None),
        ("two", "detail", PAGES[3][0], "8", None, (), "ValueError: no title"),
        ("rest", "detail", PAGES[4][0], "3", "Other", (), None),
        ("rest", "detail", None, None, "No address", (), None),
        ("two", None, PAGES[6][0], None, None, (), "ValueError: no page"),
        ("rest", "detail", PAGES[7][0], None, "Broken", (), None),
    }
    some = spark.read.format("sites").option("path", path).option("sources", "two").load()
    assert some.count() == 3 and {r["source"] for r in some.collect()} == {"two"}


def test_unknown_sources_are_refused(spark, path):
    S.register(spark, [S.Adapter("rest")])
    with pytest.raises(Exception, match="no adapter for gone"):
        spark.read.format("sites").option("path", path).option("sources", "gone").load().count()

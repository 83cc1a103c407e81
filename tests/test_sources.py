"""Pages, sitemaps and chat exports from small literal inputs."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from hearth.sources import chat, pages

PAGE = """<html><head><title>A &amp; B</title><meta property="og:title" content="One"><meta property="og:title" content="Two"><meta name="twitter:card" content="big">
<script type="application/ld+json">{"@graph": [{"@type": "House", "name": "x"}, {"@type": "Org"}]}</script><script type='application/ld+json'>{broken</script>
<script id="__NEXT_DATA__" type="application/json">{"props": {"id": 7}}</script><style>p{}</style></head>
<body data-page="{&quot;a&quot;:1}"><p>One&nbsp;two</p><ul><li>x<li>y</ul><a href="/a">l</a><a href="/a">m</a><script>var t="</p>";</script></body></html>"""


def test_page_parts(spark):
    row = spark.createDataFrame([(PAGE,)], "html string")
    html = F.col("html")
    got = row.select(
        pages.page_title(html).alias("title"), pages.meta_tags(html).alias("meta"), pages.json_ld_udf("House")(html).alias("ld"),
        F.variant_get(pages.next_data(html), "$.props.id", "int").alias("next"), F.variant_get(pages.inertia(html), "$.a", "int").alias("inertia"), pages.html_text(html).alias("text"), pages.links(html).alias("links"),
    ).first()
    assert (got["title"], got["meta"], got["next"], got["inertia"], got["links"]) == ("A & B", {"og:title": "One", "twitter:card": "big"}, 7, 1, ["/a"])
    assert [json.loads(x)["name"] for x in got["ld"]] == ["x"]
    assert "One two\n" in got["text"] and "var t" not in got["text"]
    assert spark.createDataFrame([(None,), ("",)], "html string").select(pages.html_text(html)).distinct().collect() == [(None,)]


def test_sitemap(spark):
    xml = "<urlset><url><loc>https://x.example/l/5/five</loc><lastmod>2026-01-02</lastmod></url><url><loc>https://x.example/about</loc></url><url><loc>https://x.example/l/5/again</loc></url><url><loc>https://x.example/l/9/nine</loc></url></urlset>"
    rows = pages.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).orderBy(F.desc("id")).collect()
    assert [tuple(r) for r in rows] == [("https://x.example/l/9/nine", 9, "nine", None), ("https://x.example/l/5/five", 5, "five", "2026-01-02")]


def test_adapters(spark):
    rows = spark.createDataFrame([("https://www.a.example/x",), ("https://b.a.example/",), ("https://nota.example",), (None,)], "u string")
    assert [r[0] for r in rows.select(pages.adapter_of(F.col("u"), {"a.example": "a"})).collect()] == ["a", "a", "generic", "generic"]


def test_chat_headers(spark):
    android = "13/02/2024, 9:05 pm - Ann: first\nsecond line\n14/02/2024, 12:10 am - ~ Bob: IMG-1.jpg (file attached)\n14/02/2024, 10:00 - group created\n"
    ios = "‎[2/13/24, 08:00:05] Cid: ‎<attached: a.jpg>\n[2/14/24, 08:01:00] Cid: This message was deleted.\n[2/14/24, 08:02:00] Cid: hi <This message was edited>\n[2/14/24, 08:03:00] Cid: image omitted"
    files = spark.createDataFrame([("a", android), ("i", ios), ("e", ""), ("n", None)], "file string, content string")
    got = {(r["file"], r["ordinal"]): r for r in chat.messages(files, 480).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 3), ("i", 1), ("i", 2), ("i", 3), ("i", 4)}
    assert (got["a", 1]["ts"], got["a", 1]["text"], got["a", 1]["sender"]) == (datetime(2024, 2, 13, 13, 5), "first\nsecond line", "Ann")
    assert (got["a", 2]["ts"], got["a", 2]["sender"], got["a", 2]["attachments"]) == (datetime(2024, 2, 13, 16, 10), "Bob", ["IMG-1.jpg"])
    assert got["a", 3]["system"] and not got["a", 1]["system"]
    assert (got["i", 1]["ts"], got["i", 1]["attachments"]) == (datetime(2024, 2, 13, 0, 0, 5), ["a.jpg"])
    assert got["i", 2]["deleted"] and got["i", 3]["edited"] and got["i", 3]["text"] == "hi" and got["i", 4]["omitted"]


def test_exports_in_archives(spark, tmp_path):
    """A plain text, an archive with a small and a named text, one inside another, and one without a chat."""
    import io
    import zipfile

    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files.items():
                z.writestr(name, data)
        return out.getvalue()

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.zip").write_bytes(packed({"notes.txt": "longer than the chat", "x/_chat.txt": "two", "p.jpg": b"x"}))
    (tmp_path / "c.zip").write_bytes(packed({"in.zip": packed({"WhatsApp Chat with Ann.txt": "three"})}))
    (tmp_path / "d.zip").write_bytes(packed({"p.jpg": b"x"}))
    got = {r["file"].rsplit("/", 1)[1]: r["content"] for r in chat.read_exports(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.txt": "one", "b.zip": "two", "c.zip": "three"}


def test_batches_of_records(spark, tmp_path):
    from hearth.operators.lifecycle import read_batch

    (tmp_path / "batch.json").write_text("\n".join(['{"key": "a", "price": 1}', "no json", '{"price": 2}', '{"key": "b", "price": 3}']))
    rows = read_batch(spark, f"file://{tmp_path}/batch.json", "key string, price long, _bad string", 3).collect()
    assert [(r["key"], r["refused"]) for r in rows] == [("a", None), (None, "not json"), (None, "no key"), ("b", "over the limit")]

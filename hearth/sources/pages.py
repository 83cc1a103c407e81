"""Web pages, sitemaps and embedded data as columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.facts import _part

BLOCKS = r"(?i)<br\s*/?>|</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)>"


def entities(text: Column) -> Column:
    """Named and decimal entities; the ampersand last, so that nothing is decoded twice."""
    for name, sign in (("quot", '"'), ("apos", "'"), ("#0?39", "'"), ("lt", "<"), ("gt", ">"), ("nbsp", " ")):
        text = F.regexp_replace(text, f"&{name};", sign)
    return F.regexp_replace(text, "&amp;", "&")


def html_text(html: Column) -> Column:
    """Text with breaks where blocks end; null if there is none."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    text = entities(F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n\n"), "<[^>]+>", ""))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+", " "), r" *\n *", "\n")
    return F.nullif(F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit(" \n")), F.lit(""))


def title_source(html: Column) -> Column:
    """The page's title as it is written, its entities undecoded; null if there is none."""
    return _part(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_title(html: Column) -> Column:
    return F.trim(entities(title_source(html)))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*\bhref="([^"]*)"'), F.lit(1)))


def meta_tags(html: Column) -> Column:
    """og: and twitter: tags as a map; the first value of each wins."""
    tag = r'(?i)<meta\b[^>]*?(?:property|name)="((?:og|twitter):[^"]*)"[^>]*?content="([^"]*)"'
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(tag), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(tag), F.lit(2)).alias("v"))
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(first)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")


def adapter_of(url: Column, adapters: dict[str, str], fallback: str = "generic") -> Column:
    """The adapter whose host the address has, or is under."""
    own = host(url)
    found = [F.when((own == h) | own.endswith(f".{h}"), name) for h, name in adapters.items()]
    return F.coalesce(*found, F.lit(fallback))


def sitemap_urls(xml: DataFrame, column: str = "xml") -> DataFrame:
    """url, id, slug, lastmod of listing addresses; the first of each id wins, the newest id comes first in order."""
    block = F.posexplode(F.regexp_extract_all(F.col(column), F.lit(r"(?is)<url>(.*?)</url>"), F.lit(1))).alias("pos", "block")
    rows = xml.select(block).select("pos", _part(F.col("block"), r"<loc>\s*([^<\s]+)\s*</loc>", 1).alias("url"), _part(F.col("block"), r"<lastmod>\s*([^<\s]+)\s*</lastmod>", 1).alias("lastmod"))
    rows = rows.withColumns({"id": _part(F.col("url"), r"/(\d+)/([^/?#]+)", 1).try_cast("bigint"), "slug": _part(F.col("url"), r"/(\d+)/([^/?#]+)", 2)}).filter("id is not null")
    return rows.groupBy("id").agg(F.min_by(F.struct("url", "slug", "lastmod"), "pos").alias("u")).select("u.url", "id", "u.slug", "u.lastmod")


_SCRIPT = re.compile(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>""")


def _walk(node, kinds):
    if isinstance(node, list):
        for x in node:
            yield from _walk(x, kinds)
    elif isinstance(node, dict):
        kind = node.get("@type")
        if kinds.intersection(kind if isinstance(kind, list) else [kind]):
            yield json.dumps(node, ensure_ascii=False, sort_keys=True)
        for key in ("@graph", "item", "itemListElement", "mainEntity"):
            yield from _walk(node.get(key), kinds)


def json_ld_udf(*kinds: str):
    """The page's linked-data nodes of these types, each as JSON; broken blocks are skipped."""
    wanted = set(kinds)

    @F.pandas_udf("array<string>")
    def of(pages: pd.Series) -> pd.Series:
        def one(html):
            out = []
            for block in _SCRIPT.findall(html or ""):
                try:
                    out += _walk(json.loads(block), wanted)
                except ValueError:
                    continue
            return out

        return pages.map(one)

    return of


def next_data(html: Column) -> Column:
    """The state that a page embeds, as a variant; null if it is broken or missing."""
    return F.try_parse_json(_part(html, r'(?is)<script\b[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1))


def inertia(html: Column) -> Column:
    return F.try_parse_json(entities(_part(html, r'(?is)\bdata-page="([^"]*)"', 1)))


def literal_to_json(source: Column) -> Column:
    """A script's object literal as JSON: names quoted, single quotes turned, trailing commas dropped; null if it still isn't JSON."""
    turned = F.regexp_replace(source, r"'((?:[^'\\\\\"]|\\\\.)*)'", "\"$1\"")
    named = F.regexp_replace(turned, r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", "$1\"$2\":")
    plain = F.regexp_replace(F.regexp_replace(named, r",(\s*[}\]])", "$1"), r":\s*undefined\b", ":null")
    return F.when(F.try_parse_json(plain).isNotNull(), plain)


def hydration(html: Column, name: str) -> Column:
    """The object that a page's script assigns to window.<name>, as JSON."""
    return literal_to_json(_part(html, rf"(?is)window\.{name}\s*=\s*(\{{.*?\}})\s*;?\s*</script>", 1))


def generic_page(html: Column) -> Column:
    """struct of what any page says of a home: title, description, picture, price, rooms, sizes, chat number and map."""
    from hearth.functions import facts, notes

    meta, text = meta_tags(html), html_text(html)
    price, sizes = notes.price_in_window(text), notes.land_and_building(text)
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(entities(F.try_element_at(meta, F.lit(n)))), F.lit("")) for n in names])
    return F.struct(
        F.coalesce(tag("og:title", "twitter:title"), page_title(html)).alias("title"),
        tag("og:description", "twitter:description").alias("description"),
        tag("og:image", "twitter:image").alias("image"),
        price["amount"].alias("price"),
        price["per"].alias("per"),
        facts.bedrooms(text).alias("bedrooms"),
        sizes["land_m2"].alias("land_m2"),
        sizes["build_m2"].alias("build_m2"),
        notes.whatsapp_link(html).alias("whatsapp"),
        notes.map_link(html).alias("map_url"),
    )


def index_card(text: Column) -> Column:
    """struct<ref, price, per, bedrooms> of an index card's text; null if it holds more than one reference, price or number
    of rooms: then several cards have run together."""
    from hearth.functions import facts

    many = lambda pattern: F.size(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(pattern), F.lit(0)))) > 1
    dirty = many(r"\bRF\d+[A-Z]?\b") | many(r"(?:IDR|RP\.?)\s*\d[\d.,]*") | many(r"BEDROOMS?\s*:\s*>?\s*\d")
    price = facts.price_field(text)
    return F.when(~dirty, F.struct(F.nullif(F.regexp_extract(F.upper(text), r"\bRF\d+[A-Z]?\b", 0), F.lit("")).alias("ref"), price["amount"].alias("price"), price["per"].alias("per"), facts.bedrooms(text).alias("bedrooms")))

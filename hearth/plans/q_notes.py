"""Queries of the rules over notes, codes, cards and pages, each over a table of cases."""

from pyspark.sql import functions as F

from hearth.functions import facts as T
from hearth.functions import notes as N
from hearth.functions import posts as P
from hearth.plans.cases import by_cases

_c = F.col
_today = lambda: F.lit("2025-10-15").cast("date")


def _simple(name: str, make, cases: list[tuple], kind: str = "string") -> None:
    by_cases(name, {"text": kind}, cases, ["value"], lambda r: {"id": _c("id"), "value": make(_c("text"))})


def _fields(name: str, make, fields: list[str], cases: list[tuple], inputs: dict[str, str] | None = None) -> None:
    inputs = inputs or {"text": "string"}
    by_cases(name, inputs, cases, fields, lambda r: {"id": _c("id"), **{f: make(*map(_c, inputs))[f] for f in fields}})


_fields("land_and_building", N.land_and_building, ["land_m2", "build_m2"], [
    ("Land size 300 m2, building: 150 sqm", 300, 150),
    ("Tanah 3 are, bangunan 120 m²", 300, 120),
    ("Building area of 200m2", None, 200),
    ("300 m2", None, None),
    (None, None, None),
])
_fields("prices_in_windows", N.price_in_window, ["amount", "per"], [
    ("Deposit IDR 5.000.000 and more words to come here, so that the next one is far. IDR 40.000.000 / month", 40_000_000, "month"),
    ("Only Rp 25 juta here", 25_000_000, None),
    ("no price", None, None),
    (None, None, None),
])
OFFERS = "array<struct<kind:string,price:double,currency:string,length:int,unit:string>>"


def _offers(text):
    """kind;price;currency;length;unit, offers divided by |."""
    part = lambda o, i: F.nullif(F.get(F.split(o, ";"), F.lit(i)), F.lit(""))
    offer = lambda o: F.struct(part(o, 0).alias("kind"), part(o, 1).try_cast("double").alias("price"), part(o, 2).alias("currency"), part(o, 3).try_cast("int").alias("length"), part(o, 4).alias("unit"))
    return N.offer_prices(F.transform(F.split(text, r"\|"), offer))


_fields("offer_prices", _offers, ["month", "year"], [
    ("LeaseOut;2000;USD;1;month|LeaseOut;300000000;IDR;1;Year", 32_000_000, 300_000_000),
    ("LeaseOut;2000;USD;6;month|;1000;EUR;;months", 17_500_000, None),
    ("Sell;2000000;USD;1;month|LeaseOut;5;AUD;1;year", None, None),
    ("LeaseOut;-5;IDR;1;year", None, None),
    (None, None, None),
])
by_cases("offers_in_rupiah", {"price": "double", "currency": "string"}, [(100.0, "usd", 1_600_000), (5.0, None, 5), (2.0, "EUR", 35_000), (1.0, "AUD", None), (0.0, "IDR", None), (None, "IDR", None)], ["idr"], lambda r: {"id": _c("id"), "idr": N.offer_idr(_c("price"), _c("currency"))})
_simple("dates_in_notes", N.date_in_note, [
    ("Avail Oct 30, 2026", "2026-10-30"),
    ("Avail 5 Sept 2025 or Nov 2026", "2025-09-05"),
    ("RENTED until June 2020", "2020-06-01"),
    ("Av 1st April 2025", "2025-04-01"),
    ("Villa 12 Sunset 2026", None),
    (None, None),
])
by_cases("occupancy", {"status": "string", "end": "string"}, [
    ("available", None, False, None),
    ("available", "2026-03-31", False, "2026-04-01"),
    ("Rented", "2025-12-30", False, "2025-12-31"),
    ("rented", "2026-05-30", True, None),
    ("booked", None, True, None),
    ("taken", "2025-10-01", False, None),
    (None, None, False, None),
], ["gone", "free"], lambda r: {"id": _c("id"), "gone": N.occupancy(_c("status"), _c("end"), _today())["gone"], "free": N.occupancy(_c("status"), _c("end"), _today())["available_from"].cast("string")})
by_cases("card_statuses", {"availability": "string", "suffix": "string", "banner": "string"}, [
    ("Rented", "Avail Nov 2025", None, False, "2025-11-01"),
    ("Rented", "Avail June 2026", None, True, None),
    (None, "Avail June 2026", None, False, "2026-06-01"),
    (None, "Avail June 2024", None, False, None),
    ("Available", None, "SOLD OUT", True, None),
    (None, None, None, False, None),
], ["gone", "free"], lambda r: {"id": _c("id"), "gone": N.card_status(_c("availability"), _c("suffix"), _c("banner"), _today())["gone"], "free": N.card_status(_c("availability"), _c("suffix"), _c("banner"), _today())["available_from"]})
_fields("note_sources", N.note_source, ["source", "note"], [("[src:fb-bali.rentals] from Ketut", "fb-bali.rentals", "from Ketut"), ("[src:x]", "x", None), ("plain", None, "plain"), ("[src:-x] no", None, "[src:-x] no"), (None, None, None)])
_simple("amenity_chips", lambda t: F.array_join(F.array_sort(F.transform(F.map_entries(N.amenity_chips(t)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ","), [
    ('<span class="amenity-tag">Pool</span><span class="amenity-tag amenity-tag--off">Air  Con</span>', "air con=false,pool=true"),
    ('<i class="other">Pool</i>', ""),
    ("", ""),
])
_simple("spec_pairs", lambda t: F.array_join(F.array_sort(F.transform(F.map_entries(N.spec_pairs(t)), lambda e: F.concat_ws("=", e["key"], e["value"]))), ","), [
    ("<p>Kamar</p><p class=x>3</p>", "kamar=3"),
    (f"<p>{'x' * 40}</p><p>Luas <b>Tanah</b></p><p>100 m2</p><p></p>", "luas tanah=100 m2"),
    ("<div>none</div>", ""),
])
_fields("code_lines", N.code_line, ["ref", "suffix"], [("IP 874 - Avail Oct 30, 2026", "IP-874", "Avail Oct 30, 2026"), ("Code: ar18b", "AR-18B", None), ("Code : IP 036 | RENTED OUT", "IP-036", "RENTED OUT"), ("no code", None, None), (None, None, None)])
_fields("meta_lines", N.meta_line, ["ref", "location"], [("ID V009-4425 | VILLA - Pererenan", "V009-4425", "Pererenan"), ("id x1", "X1", None), ("| HOUSE - Tanah Lot - North ", None, "Tanah Lot - North"), (None, None, None)])
_simple("periods_of_urls", N.period_of_url, [("https://a.example/for-rent/villa/annually/x", "year"), ("/for-rent/villa/Monthly/x", "month"), ("/for-rent/villa/yearly/", "year"), ("/for-sale/villa/monthly/", None), (None, None)])
by_cases("galleries", {"html": "string", "folder": "string"}, [
    ('<img src="https://c.example/l/ab-1/1.jpg"><img src="https://c.example/l/zz/9.jpg"><img src="https://c.example/l/ab-1/2.PNG"><img src="https://c.example/l/ab-1/2.png"><img src="https://c.example/l/ab-1/1.jpg">', "ab-1", "https://c.example/l/ab-1/1.jpg https://c.example/l/ab-1/2.png"),
    ("nothing", "ab-1", ""),
    (" ".join(f"https://c.example/f/{i}.webp" for i in range(25)), "f", " ".join(f"https://c.example/f/{i}.webp" for i in range(20))),
], ["urls"], lambda r: {"id": _c("id"), "urls": F.array_join(N.gallery(_c("html"), _c("folder")), " ")})
_simple("whatsapp_links", N.whatsapp_link, [('<a href="https://wa.me/6281234567890?text=x">', "+6281234567890"), ('href="https://api.whatsapp.com/send?text=a&amp;phone=+62811222333"', "+62811222333"), ("wa.me/12", None), (None, None)])
_simple("map_links", N.map_link, [('<a href="https://www.google.com/maps?q=-8.6,115.1&amp;z=2">', "https://www.google.com/maps?q=-8.6,115.1&z=2"), ("<a href='https://maps.app.goo.gl/abc'>", "https://maps.app.goo.gl/abc"), ('"https://google.com/search"', None), (None, None)])
by_cases("portal_noise", {"title": "string", "url": "string", "price": "string"}, [
    ("Villa Canggu", "/villa-canggu", "Rp 165 Juta /tahun", False),
    ("Villa Canggu", "/villa", "Rp 1 Juta / hari", True),
    ("Kost putri", "/x", None, True),
    ("House", "/guest-house-2", None, True),
    ("Ruko 2 lantai", "", "", True),
    (None, None, None, False),
], ["noise"], lambda r: {"id": _c("id"), "noise": N.is_noise(_c("title"), _c("url"), _c("price"))})
_simple("sale_slugs", N.slug_is_sale, [("villa-for-sale-canggu", True), ("villa-sale-or-rent", False), ("wholesale-villa", False), ("LAND-ubud", True), ("freehold", True), (None, False)])
by_cases("rental_tests", {"function": "string", "crumb": "string", "category": "string"}, [
    ("LeaseOut", "/long-term", "Villa", True),
    ("Sell", "/long-term", "Villa", False),
    ("LeaseOut", "/kost/x", "House", False),
    ("LeaseOut", None, "Guest room in villa", False),
    ("LeaseOut", None, None, False),
], ["rental"], lambda r: {"id": _c("id"), "rental": N.is_rental(_c("function"), _c("crumb"), _c("category"))})
_simple("group_names", N.group_name, [("x/WhatsApp Chat with Villa 🌴 Bali (Rent).txt", "Villa Bali (Rent)"), ("WhatsApp Chat - Ünder.zip", "Ünder"), ("🌴.txt", None), (None, None)])
by_cases("local_dates", {"ts": "timestamp_ntz"}, [("2025-03-01 15:59:59", "2025-03-01", "2025-02-27"), ("2025-03-01 16:00:00", "2025-03-02", "2025-02-28"), (None, None, None)], ["day", "before"], lambda r: {"id": _c("id"), "day": N.local_date(_c("ts"), "Asia/Makassar").cast("string"), "before": N.local_date(_c("ts"), "Asia/Makassar", -2).cast("string")})
_simple("slug_lists", lambda t: F.array_join(N.slugs_of(t), " "), [("a/Seseh, b/ubud,c/seseh,", "seseh ubud"), ("x", "x"), ("", ""), (None, None)])
by_cases("construction_mentions", {"texts": "array<string>"}, [(["A Building Site next door", "fine"], True), (["quiet"], False), (["", "soon under Construction"], True)], ["said"], lambda r: {"id": _c("id"), "said": N.mentions_any(_c("texts"), ["construction", "building site"])})
_fields("chat_senders", N.chat_sender, ["name", "phone"], [("~ Ketut", "Ketut", False), ("+62 812-3456-7890", "+62 812-3456-7890", True), ("‎Ann", "Ann", False), ("Bo 12", "Bo 12", False), (None, None, None)])

# Functions of older modules.
_simple("slugs", P.slug, [("Café  Ünder – 2!", "cafe-under-2"), ("--", ""), ("Ñandú/Ōsaka", "nandu-osaka"), (None, None)])
_fields("map_pins", T.lat_lng, ["lat", "lng"], [("https://maps.example/@-8.65,115.13,17z", -8.65, 115.13), ("x?q=loc:-8.5,%20115", None, None), ("?q=-8.5,115.25", -8.5, 115.25), ("!3d-8.1!4d115.2", -8.1, 115.2), ("-8.7 115.3", -8.7, 115.3), ("@-98,115", None, None), (None, None, None)])
_now = lambda: F.lit("2025-10-03 12:00:00").cast("timestamp_ntz")
_simple("said_times", lambda t: P.said_at(t, _now()).cast("string"), [
    ("6d", "2025-09-27 12:00:00"), ("3h", "2025-10-03 09:00:00"), ("Yesterday at 8:15 PM", "2025-10-02 20:15:00"), ("September 12 at 11:04 PM", "2025-09-12 23:04:00"),
    ("12 December at 10:20", "2024-12-12 10:20:00"), ("Sep 12", "2025-09-12 00:00:00"), ("31 February", None), ("soon", None), (None, None),
])
_simple("view_words", T.view_of, [("Ocean front", "ocean"), ("Sawah", "rice"), ("forest and river", "river"), ("City", "none"), ("x", None), (None, None)])
_simple("style_words", T.style_of, [("Minimalist", "modern"), ("Joglo modern", "joglo"), ("traditional balinese", None), (None, None)])
_simple("yes_no_words", T.yes_no, [(" Yes, daily", 1), ("ada", 1), ("Tidak ada", 0), ("none", 0), ("maybe", None), (None, None)])
_simple("furnished_words", T.furnished, [("Un-furnished", 0), ("kosongan", 0), ("Semi furnished", 1), ("berperabot", 1), ("x", None), (None, None)])
_simple("living_words", T.living_open, [("Enclosed living", 0), ("Open living", 1), ("x", None), (None, None)])
by_cases("amenity_lists", {"items": "array<string>"}, [(["Big pool", "AC"], 1, 1, None), (["Kitchen"], None, None, 1), ([""], None, None, None)], ["pool", "aircon", "kitchen_full"], lambda r: {"id": _c("id"), **{n: T.amenity_flags(_c("items"))[n] for n in ("pool", "aircon", "kitchen_full")}})
_simple("periods_of_texts", T.period_of, [("Rp 165 Juta Total /tahun", "year"), ("Rp 5 jt / Bulan", "month"), ("per month", None), (None, None)])
_simple("refs_of_urls", T.ref_of_url, [("https://a.example/villa-canggu-hos12345/", "hos12345"), ("https://a.example/rf9183?x=1", "rf9183"), ("https://a.example/villa", None), (None, None)])
_simple("unwrapped_images", T.unwrap_image, [("https://p.example/img?url=https%3A%2F%2Fc.example%2F1.jpg&w=2", "https://c.example/1.jpg"), ("https://c.example/2.jpg", "https://c.example/2.jpg"), (None, None)])

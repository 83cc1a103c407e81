"""PII pseudonyms by Feistel networks that preserve format.

Found and checked: e-mail addresses, IPv4 addresses (bytes up to 255), dates (from 1900-01-01 to 2099-12-31, by the
calendar), social security numbers (assignable ones), phone numbers (10 to 15 digits) and card numbers (13 to 19
digits with a right check digit). A value is brought to a canonical form (digits, a day, a number), permuted under the
key within its format, and written back into the separators of the place where it stood. The permutation depends on
key, kind and canonical value alone, so equal values get equal pseudonyms in all documents, whatever their separators;
different values get different ones. What fails its check is left alone.

In a run of groups of digits, the groups that form a card as cards are printed (CARD_FORMS) and pass the check are taken
first, wherever they stand in the run (before an expiry date, after a reference number). What remains of the run is
searched for all kinds, and there a card may have any grouping.

Null texts stay null, empty ones empty; very long texts are whole; equal rows get equal texts. Where two kinds fit one
place, the first of those listed above wins. Only DataFrame functions are used: each row is
worked on where it is, without a shuffle. Columns other than text are kept; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Assignable area and group numbers, and serial numbers, less one.
SSN = (898 * 99, 9999)

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
DATE = r"(?<![\w\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w\-/])"
SSN_FORM = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
PHONE = r"(?:(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|(?<![\w(])\(\d{3}\) ?\d{3}[ .\-]\d{4}|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w])"
CARD = r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w])"
#: A run of at least 13 digits in groups, up to its last group unless an address or a date begins there.
RUN = r"(?<![\w.\-])\d(?:[ \-]?\d){12}(?:[\d \-]*\d)?(?!\w)(?<![ ]\d{1,3}(?=(?:\.\d{1,3}){3}(?!\w|\.\d)))(?<![ ]\d\d(?=/\d\d/\d{4}(?![\w\-/])))"
#: Sizes of the groups in which cards are printed; only the first two can fit in one place, and the longer is tried first.
CARD_FORMS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 5, 6), (4, 6, 4), (4, 4, 5), (4, 3, 3, 3), (4, 4, 4, 1), (6, 13), *((n,) for n in range(13, 20)))
ANY = "|".join(f"(?:{x})" for x in (EMAIL, IPV4, DATE, SSN_FORM, PHONE, CARD))
PLACES = "|".join(f"(?:{x})" for x in (EMAIL, IPV4, DATE, SSN_FORM, PHONE, RUN, CARD))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _number(hexes: Column) -> Column:
    return F.conv(hexes, 16, 10).cast("long")


def _steps(start: Column, merge) -> Column:
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, merge)


def permute_numbers(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """struct<a, b>: a permutation of the pairs (a, b) with a < sizes[0], b < sizes[1]."""

    def add(x, other, i, size):
        word = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256)
        return F.pmod(x + _number(F.substring(word, 1, 15)), F.lit(size)).cast("long")

    pair = lambda x, y: F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))
    return _steps(pair(a, b), lambda s, i: F.when(i % 2 == 0, pair(add(s["a"], s["b"], i, sizes[0]), s["b"])).otherwise(pair(s["a"], add(s["b"], s["a"], i, sizes[1]))))


def permute_text(x: Column, key: str, kind: str) -> Column:
    """A permutation of the strings of one length, letters to letters and digits to digits; up to 128 characters."""

    def add(half, other, i):
        word = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), other), 512)

        def one(c, j):
            by = F.ascii(c) + _number(F.substring(word, 2 * j + 1, F.lit(2)))
            turned = lambda first, size: F.char(F.pmod(by - first, F.lit(size)) + first)
            return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(half, ""), one), "")

    half = F.floor(F.length(x) / 2).cast("int")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    out = _steps(pair(F.substring(x, F.lit(1), half), F.substring(x, half + 1, F.length(x))), lambda s, i: F.when(i % 2 == 0, pair(add(s["a"], s["b"], i), s["b"])).otherwise(pair(s["a"], add(s["b"], s["a"], i))))
    return F.concat(out["a"], out["b"])


def put_digits(form: Column, digits: Column) -> Column:
    """form with its digits replaced by these, in order."""
    pair = lambda out, k: F.struct(out.alias("out"), k.alias("k"))
    return F.aggregate(F.split(form, ""), pair(F.lit(""), F.lit(1)), lambda s, c: F.when(c.between("0", "9"), pair(F.concat(s["out"], F.substring(digits, s["k"], F.lit(1))), s["k"] + 1)).otherwise(pair(F.concat(s["out"], c), s["k"])))["out"]


def luhn_sum(digits: Column) -> Column:
    """The check sum, the last digit not doubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _part(x: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(x, pattern, group)


def kind_of(m: Column) -> Column:
    """email, ip, date, ssn, phone or card; null if the check fails."""
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("int"))
    digits = _digits(m)
    day = _day(m)
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
        .when(m.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})$"), F.when((day >= 0) & (day < DAYS[0] * DAYS[1]), "date"))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(m.rlike(rf"^{PHONE}$") & F.length(digits).between(10, 15), "phone")
        .when(F.length(digits).between(13, 19), F.when(luhn_sum(digits) % 10 == 0, "card"))
    )


def _checked(m: Column) -> Column:
    return F.struct(m.alias("m"), kind_of(m).alias("kind"))


def _pieces(run: Column) -> Column:
    """array<struct<m, kind>>: cards in the run, and what lies between them (null kind), in order."""
    groups = F.regexp_extract_all(run, F.lit(r"\d+[ \-]*"), F.lit(0))
    piece = lambda m, kind: F.array(F.struct(m.alias("m"), F.lit(kind).cast("string").alias("kind")))
    state = lambda out, rest, skip: F.struct(out.alias("out"), rest.alias("rest"), skip.cast("int").alias("skip"))
    forms = [r"[ \-]".join(rf"\d{{{n}}}" for n in form) for form in CARD_FORMS]

    def step(s, i):
        ahead = F.array_join(F.slice(groups, i, 5), "")
        fits = F.array(*[F.regexp_extract(ahead, rf"^(?:{x})(?!\d)", 0) for x in (forms[0], "|".join(forms[1:]))])
        card = F.get(F.filter(fits, lambda c: (c != "") & (luhn_sum(_digits(c)) % 10 == 0)), F.lit(0))
        count = F.size(F.regexp_extract_all(card, F.lit(r"\d+"), F.lit(0)))
        last = F.element_at(groups, i + count - 1)
        taken = state(F.concat(s["out"], piece(s["rest"], None), piece(card, "card")), F.regexp_extract(last, r"[ \-]*$", 0), count - 1)
        return F.when(s["skip"] > 0, state(s["out"], s["rest"], s["skip"] - 1)).when(card.isNotNull(), taken).otherwise(state(s["out"], F.concat(s["rest"], F.element_at(groups, i)), F.lit(0)))

    start = state(F.array().cast("array<struct<m:string,kind:string>>"), F.lit(""), F.lit(0))
    return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda s: F.concat(s["out"], piece(s["rest"], None)))


def _found_in(place: Column) -> Column:
    """array<struct<m, kind>>: the place, or the parts of a run of digits."""
    none = F.lit(None).cast("string")

    def searched(text):
        gaps = F.transform(F.split(text, ANY, -1), lambda g: F.array(F.struct(g.alias("m"), none.alias("kind"))))
        values = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.array(_checked(m)))
        return F.flatten(F.zip_with(gaps, values, lambda g, v: F.concat(g, F.coalesce(v, F.array().cast("array<struct<m:string,kind:string>>")))))

    parts = F.flatten(F.transform(_pieces(place), lambda p: F.when(p["kind"].isNull(), searched(p["m"])).otherwise(F.array(p))))
    return F.when(place.rlike(r"^\d[\d \-]*$") & (F.length(_digits(place)) >= 13), parts).otherwise(F.array(_checked(place)))


def _day(m: Column) -> Column:
    """Days after the first day, by the calendar; null if there is no such day."""
    iso = F.when(F.contains(m, F.lit("/")), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(m)
    return F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date"))


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    local = F.lower(_part(m, r"^(.*)@", 1))
    email = F.concat(permute_text(local, key, "email"), _part(m, r"(@.*)$", 1))

    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("int")
    ip = permute_numbers(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key, "ip")
    ip = F.aggregate(F.array(ip), F.lit(""), lambda _, p: F.concat_ws(".", *[F.floor(x).cast("string") for x in (p["a"] / 256, p["a"] % 256, p["b"] / 256, p["b"] % 256)]))

    moved = permute_numbers(F.floor(_day(m) / DAYS[1]), _day(m) % DAYS[1], DAYS, key, "date")
    iso = F.aggregate(F.array(moved), F.lit(""), lambda _, p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["a"] * DAYS[1] + p["b"]).cast("int")), "yyyy-MM-dd"))
    slashed = F.aggregate(F.array(iso), F.lit(""), lambda _, d: F.concat_ws("/", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4)))
    date = F.when(F.contains(m, F.lit("/")), slashed).otherwise(iso)

    area = F.substring(m, 1, 3).cast("int")
    index = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + F.substring(m, 5, 2).cast("int") - 1
    ssn = permute_numbers(index, F.substring(m, 8, 4).cast("int") - 1, SSN, key, "ssn")

    def written(_, p):
        a = F.floor(p["a"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((a, 3), (p["a"] % 99 + 1, 2), (p["b"] + 1, 4))])

    ssn = F.aggregate(F.array(ssn), F.lit(""), written)

    country = _part(m, r"^(\+\d{1,3}(?!\d))", 1)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    phone = F.concat(country, put_digits(rest, permute_text(_digits(rest), key, "phone")))

    digits = _digits(m)
    inner = F.concat(F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    with_check = F.aggregate(F.array(inner), F.lit(""), lambda _, d: F.concat(d, ((10 - luhn_sum(F.concat(d, F.lit("0"))) % 10) % 10).cast("string")))
    card = put_digits(m, with_check)

    out = F.when(kind == "email", email)
    for name, value in (("ip", ip), ("date", date), ("ssn", ssn), ("phone", phone), ("card", card)):
        out = out.when(kind == name, value)
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str, found: str = "pii") -> DataFrame:
    """docs with the texts' values replaced, and a column of what was found: array<struct<kind, pseudonym>>."""
    names = docs.columns
    held = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PLACES), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn("__hearth_all", held)
    kinds = F.transform("__hearth_all", _found_in)
    named = lambda x: F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["m"]).otherwise(_pseudonym(x["m"], x["kind"], key)).alias("pseudonym"))
    out = out.withColumn("__hearth_all", F.when(F.size("__hearth_all") > 0, F.transform(kinds, lambda parts: F.transform(parts, named))))
    gaps = F.split("text", PLACES, -1)
    written = F.transform("__hearth_all", lambda parts: F.array_join(F.transform(parts, lambda x: x["pseudonym"]), ""))
    joined = F.array_join(F.zip_with(gaps, written, lambda gap, p: F.concat(gap, F.coalesce(p, F.lit("")))), "")
    result = F.filter(F.flatten(F.coalesce("__hearth_all", F.array().cast("array<array<struct<kind:string,pseudonym:string>>>"))), lambda x: x["kind"].isNotNull())
    return out.select(*[F.when(F.col("__hearth_all").isNotNull(), joined).otherwise(F.col("text")).alias("text") if n == "text" else n for n in names], result.alias(found))

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from hearth.llm import pii as P
from hearth.llm.q_pii import KEY, op10_pii
from hearth.session import table
from helpers import CLASHES, docs

TEXTS = [
    "mail Jo.Doe9@example.com or JO.DOE9@example.com now",
    "born 1990-02-28, again 28/02/1990; no date: 2021-02-30",
    "ssn 123-45-6789 not 000-12-3456",
    "call +1 415 555 0123 or (415) 555-0199",
    "card 4111 1111 1111 1111, 4111111111111111; bad 4111 1111 1111 1112",
    "host 192.168.1.10 not 192.168.1.300",
    None,
    "",
    "no values 12 and 7",
    "mail Jo.Doe9@example.com or JO.DOE9@example.com now",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def run(spark, texts, key="k"):
    rows = P.pseudonymise(docs(spark, texts).withColumns({c: F.lit(1) for c in CLASHES}), key).collect()
    return {r["doc_id"]: r for r in rows}


def test_formats_and_links(spark):
    got = run(spark, TEXTS)
    text = {i: r["text"] for i, r in got.items()}
    kinds = {i: [x["kind"] for x in r["pii"]] for i, r in got.items()}
    assert kinds == {0: ["email"] * 2, 1: ["date"] * 2, 2: ["ssn"], 3: ["phone"] * 2, 4: ["card"] * 2, 5: ["ip"], 6: [], 7: [], 8: [], 9: ["email"] * 2}
    one, two = re.findall(r"\S+@example\.com", text[0])
    assert one == two and re.fullmatch(r"[a-z]{2}\.[a-z]{3}\d@example\.com", one) and one != "jo.doe9@example.com"
    iso, slashed = re.search(r"born (\d{4}-\d\d-\d\d), again (\d\d/\d\d/\d{4}); no date: 2021-02-30", text[1]).groups()
    assert iso == "-".join(reversed(slashed.split("/"))) and iso != "1990-02-28"
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} not 000-12-3456", text[2]) and "123-45-6789" not in text[2]
    assert re.fullmatch(r"call \+1 \d{3} \d{3} \d{4} or \(\d{3}\) \d{3}-\d{4}", text[3])
    spaced, plain = re.search(r"card ([\d ]+), (\d+); bad 4111 1111 1111 1112", text[4]).groups()
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain != "4111111111111111"
    assert re.fullmatch(r"host \d+\.\d+\.\d+\.\d+ not 192.168.1.300", text[5])
    assert (text[6], text[7], text[8], text[9]) == (None, "", TEXTS[8], text[0])
    assert run(spark, TEXTS, "other")[2]["text"] != text[2]


def test_different_values_stay_different(spark):
    days = [f"{1950 + i // 300}-{1 + i % 12:02d}-{1 + i // 12 % 25:02d}" for i in range(1500)]
    got = run(spark, days)
    assert len({r["text"] for r in got.values()}) == len(set(days))


def test_query_covers_all_rows(spark, sf):
    rows = {r["doc_id"]: r for r in op10_pii(spark, sf).collect()}
    plain = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert set(rows) == set(plain) and sum(r["n_values"] for r in rows.values()) > 0
    for i, r in rows.items():
        assert (r["text"] == plain[i]) or r["n_values"] > 0
        mails = set(re.findall(P.EMAIL, plain[i]))
        assert not [m for m in mails if m in r["text"] and any(c.isalpha() for c in m.split("@")[0]) and len(m.split("@")[0]) > 3]
    assert P.pseudonymise(docs(spark, []), KEY).count() == 0


def test_very_long_text(spark):
    text = "word " * 60_000 + "a.b.c.d.e@example.org " + "5" * 20_000
    out = run(spark, [text])[0]
    assert len(out["text"]) == len(text) and len(out["pii"]) == 1


def test_cards_beside_other_digits(spark):
    card, amex = "4111 1111 1111 1111", "3782 822463 10005"
    texts = [
        f"{card} 12/25", f"{card} 123", f"ref 12 {card}", f"12 34 56 {card} 12", f"1234 {card} 5678", f"{amex} 12/25", f"7 {amex} 1234", f"{card} 5500 0000 0000 0004", "4111111111111111 12-25",
        f"{card}-123", f"{card} 2024-01-05", f"{card} 05/06/2024 x", f"{card} 123 192.168.1.10", f"{card} 12/25, 4111-1111-1111-1111", "4111 1111 1111 1112 12/25", "41 11 11 11 11 11 11 11",
    ]
    got = run(spark, texts)
    kinds = [[x["kind"] for x in got[i]["pii"]] for i in range(len(texts))]
    assert kinds == [["card"]] * 7 + [["card"] * 2] + [["card"]] * 2 + [["card", "date"]] * 2 + [["card", "ip"], ["card"] * 2, [], ["card"]]
    assert not [r["text"] for r in got.values() if "1111 1111 1111 1111" in r["text"] or "822463" in r["text"] or "4111111111111111" in r["text"]]
    same = got[0]["pii"][0]["pseudonym"]
    assert [got[i]["text"] for i in (0, 1, 2, 3, 4, 9)] == [f"{same} 12/25", f"{same} 123", f"ref 12 {same}", f"12 34 56 {same} 12", f"1234 {same} 5678", f"{same}-123"]
    assert got[14]["text"] == texts[14] and luhn(same.replace(" ", ""))


def test_very_long_run_of_groups(spark):
    text = "12 " * 3_000 + "4111 1111 1111 1111 " + "7 " * 3_000
    out = run(spark, [text])[0]
    assert len(out["text"]) == len(text) and "4111 1111 1111 1111" not in out["text"]


def plain_numbers(a, b, sizes, key, kind):
    word = lambda i, other: int(hashlib.sha256(f"{key}:{kind}:{i}:{other}".encode()).hexdigest()[:15], 16)
    for i in range(8):
        if i % 2 == 0:
            a = (a + word(i, b)) % sizes[0]
        else:
            b = (b + word(i, a)) % sizes[1]
    return a, b


def plain_text(x, key, kind):
    def add(half, other, i):
        word = hashlib.sha512(f"{key}:{kind}:{i}:{other}".encode()).hexdigest()
        by = [ord(c) + int(word[2 * j : 2 * j + 2], 16) for j, c in enumerate(half)]
        return "".join(chr((n - 48) % 10 + 48) if c.isdigit() else chr((n - 97) % 26 + 97) if "a" <= c <= "z" else c for c, n in zip(half, by))

    a, b = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(8):
        a, b = (add(a, b, i), b) if i % 2 == 0 else (a, add(b, a, i))
    return a + b


def plain_pseudonym(m, key):
    """Written anew, value by value."""
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        local, host = m.split("@")
        return f"{plain_text(local.lower(), key, 'email')}@{host}"
    if m.count(".") == 3:
        o = list(map(int, m.split(".")))
        a, b = plain_numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}", m):
        day = datetime.date(*map(int, m.split("-"))) if "-" in m else datetime.date(*map(int, reversed(m.split("/"))))
        n = (day - datetime.date(1900, 1, 1)).days
        a, b = plain_numbers(n // 4297, n % 4297, (17, 4297), key, "date")
        return (datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)).strftime("%Y-%m-%d" if "-" in m else "%d/%m/%Y")
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        a, b = plain_numbers((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "ssn")
        area = a // 99 + 1
        return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if m[0] in "+(":
        country = re.match(r"(\+\d{1,3}(?!\d))?", m).group()
        new = iter(plain_text(re.sub("[^0-9]", "", m[len(country) :]), key, "phone"))
        return country + re.sub(r"\d", lambda _: next(new), m[len(country) :])
    inner = digits[0] + plain_text(digits[1:-1], key, "card")
    new = iter(inner + next(c for c in "0123456789" if luhn(inner + c)))
    return re.sub(r"\d", lambda _: next(new), m)


def test_values_equal_plain_python(spark):
    values = ["jo.doe9@example.com", "a@b.example", "10.0.0.255", "1.2.3.4", "1990-02-28", "28/02/1990", "1900-01-01", "2099-12-31", "123-45-6789", "899-01-0001", "667-99-9999"]
    values += ["+1 415 555 0123", "(415) 555-0199", "+62 812-3456-7890", "4111 1111 1111 1111", "378282246310005", "5555-5555-5555-4444"]
    got = run(spark, [f"x {v} y" for v in values], "secret")
    assert [got[i]["text"] for i in range(len(values))] == [f"x {plain_pseudonym(v, 'secret')} y" for v in values]
    assert all(len(got[i]["pii"]) == 1 for i in range(len(values)))


def test_query_changes_found_values_only(spark, sf):
    """On the whole table: addresses and numbers that a plain search finds are gone, and texts without any are as they were."""
    before = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    after = {r["doc_id"]: r for r in op10_pii(spark, sf).collect()}
    mail, number = re.compile(r"[\w.+-]+@[\w-]+\.[a-z]{2,}"), re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
    for i, text in before.items():
        for found in mail.findall(text or ""):
            assert found not in after[i]["text"]
        for found in number.findall(text or ""):
            if not re.match(r"000|666|9|...-00|.*-0000", found):
                assert found not in after[i]["text"] and plain_pseudonym(found, KEY) in after[i]["text"]
        if not re.search(r"[0-9@]", text or ""):
            assert after[i]["text"] == text

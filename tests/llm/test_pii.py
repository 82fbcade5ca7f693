"""Pseudonyms against a Feistel network written a second time, in Python, over thousands of values of each format."""

import hashlib
import random
import re
from datetime import date, timedelta

import pytest
import xxhash
from pyspark.sql import functions as F

from weir.llm import pii

KEY = "a key"


def prf(*parts):
    digest = hashlib.sha256("|".join([KEY, *map(str, parts)]).encode()).hexdigest()
    x = xxhash.xxh64_intdigest(digest, 42)
    return x - (1 << 64) if x >> 63 else x


def feistel(left, right, a, b, kind):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + prf(kind, a, i, right)) % a
        else:
            right = (right + prf(kind, b, i, left)) % b
    return left, right


def digits(text, kind):
    u = len(text) // 2
    left, right = feistel(int(text[:u]), int(text[u:]), 10**u, 10 ** (len(text) - u), kind)
    return f"{left:0{u}}{right:0{len(text) - u}}"


def refill(value, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def check_digit(payload):
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def card(value):
    d = re.sub(r"\D", "", value)
    if check_digit(d[:-1]) != d[-1]:
        return value
    new = digits(d[:-1], "card")
    return refill(value, new + check_digit(new))


def phone(value):
    d = re.sub(r"\D", "", value)
    code = d[:1] if len(d) > 10 or value[0] == "+" else ""
    return refill(value, code + digits(d[len(code) :], "phone"))


def ssn(value):
    a, g, s = map(int, value.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return value
    left, right = feistel((a - 1 - (a > 666)) * 99 + g - 1, s - 1, 898 * 99, 9999, "ssn")
    a = left // 99
    return f"{a + 1 + (a >= 665):03}-{left % 99 + 1:02}-{right + 1:04}"


def address(value):
    o = list(map(int, value.split(".")))
    if max(o) > 255:
        return value
    left, right = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return ".".join(str(x) for half in (left, right) for x in divmod(half, 256))


def other_day(day):
    first, modern = date(1, 1, 1), date(1900, 1, 1)
    span, modern_at = 272 * 272, (modern - first).days
    is_modern = modern_at <= (day - first).days < modern_at + span
    now = day
    while True:
        at = (now - first).days
        if is_modern:
            left, right = feistel(*divmod(at - modern_at, 272), 272, 272, "date")
            now = modern + timedelta(left * 272 + right)
        else:
            left, right = feistel(*divmod(at if at < modern_at else at - span, 8419), 425, 8419, "date")
            to = left * 8419 + right
            now = first + timedelta(to if to < modern_at else to + span)
        if (now.day > 12) == (day.day > 12):
            return now


def real(y, m, d):
    try:
        return date(int(y), int(m), int(d))
    except ValueError:
        return None


def a_date(value):
    if "-" in value:
        day = real(*value.split("-"))
        return other_day(day).isoformat() if day else value
    one, two, year = value.split("/")
    for form, day in (("{d}/{m}/{y}", real(year, two, one)), ("{m}/{d}/{y}", real(year, one, two))):
        if day:
            new = other_day(day)
            return form.format(d=f"{new.day:02}", m=f"{new.month:02}", y=f"{new.year:04}")
    return value


def values(kind, rng):
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "card":
        for n in (13, 15, 16, 19):
            for _ in range(400):
                payload = number(n - 1)
                yield payload + (check_digit(payload) if rng.random() < 0.8 else number(1))
        for _ in range(400):
            d = number(15)
            d += check_digit(d)
            yield f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}"
    if kind == "phone":
        for _ in range(700):
            d = number(10)
            yield f"{d[:3]}-{d[3:6]}-{d[6:]}"
            yield f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
            yield f"+{number(rng.randint(7, 15))}"
        yield from ("+44 20 7946 0958", "+44 (0)20 7946 0958", "+49-30-1234567", "+33.1.23.45.67.89", "+4930 123 4567", "1 415 555 2671")
    if kind == "ssn":
        yield from (f"{a:03}-{g:02}-{s:04}" for a in (0, 1, 665, 666, 667, 898, 899, 900) for g in (0, 1, 50, 99) for s in (0, 1, 9999))
        for _ in range(1500):
            yield f"{number(3)}-{number(2)}-{number(4)}"
    if kind == "address":
        yield from ("0.0.0.0", "255.255.255.255", "256.1.1.1", "1.1.1.999")
        for _ in range(2000):
            yield ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "date":
        for y in (1, 2, 1582, 1899, 1900, 1984, 2101, 2102, 2103, 2150, 9998, 9999):
            for at in range(0, 366, 3):
                day = date(y, 1, 1) + timedelta(min(at, 364))
                yield day.isoformat()
                yield f"{day.day:02}/{day.month:02}/{day.year:04}"
                yield f"{day.month:02}/{day.day:02}/{day.year:04}"
        yield from ("0000-01-01", "1999-02-29", "2000-02-29", "1900-02-29", "31/02/2000", "13/13/2000", "00/01/2000", "9999-12-31", "0001-01-01")


@pytest.mark.parametrize(("kind", "want"), [("card", card), ("phone", phone), ("ssn", ssn), ("address", address), ("date", a_date)])
def test_every_format_against_a_second_feistel_network(spark, kind, want):
    old = sorted(set(values(kind, random.Random(kind))))
    got = spark.createDataFrame([(v, f"it is {v}, they say") for v in old], "old string, text string").repartition(8)
    got = {r["old"]: r["text"] for r in pii.pseudonymise(got, KEY).collect()}
    for v in old:
        assert got[v] == f"it is {want(v)}, they say", v
    assert len(set(got.values())) == len(old)  # what isn't private stays, and no pseudonym meets another one of its format
    assert sum(got[v] != f"it is {v}, they say" for v in old) > 0.7 * len(old)


def test_dates_of_a_span_are_permuted_within_it(spark):
    days = spark.range(pii.MODERN_DAY, pii.MODERN_DAY + pii.MODERN_DAYS).select(F.date_from_unix_date(F.col("id").cast("int")).cast("string").alias("d"))
    got = days.select("d", pii._date(F.col("d"), KEY).alias("p")).agg(F.countDistinct("p"), F.min("p"), F.max("p"), F.min("d"), F.max("d")).first()
    assert got[0] == pii.MODERN_DAYS and got[1] == got[3] == "1900-01-01" and got[2] == got[4]


def test_slashed_dates_have_no_two_readings(spark):
    both = [(f"{a:02}/{b:02}/{y}",) for y in (1890, 1984, 2024) for a in range(1, 32) for b in range(1, 32)]
    got = spark.createDataFrame(both, "d string").select("d", pii._date(F.col("d"), KEY).alias("p")).filter("p is not null").collect()
    assert len({r["p"] for r in got}) == len(got) == sum(bool(real(d[6:], d[3:5], d[:2]) or real(d[6:], d[:2], d[3:5])) for (d,) in both)


def test_a_text_with_the_mark_is_cut_in_another_way(spark):
    text = f"{pii.MARK}a{pii.MARK} 97.51.17.173 and 4111111111111111{pii.MARK}"
    got = pii.pseudonymise(spark.createDataFrame([(text,), (text.replace(pii.MARK, ""),)], "text string"), KEY).collect()
    assert got[0]["text"].replace(pii.MARK, "") == got[1]["text"] and got[0]["n_private"] == 2 and got[0]["text"].count(pii.MARK) == 3


def test_long_texts_of_one_kind_of_character(spark):
    rows = ["a" * 300_000, "1" * 300_000, "(" * 300_000, "+1" * 150_000, "f" * 300_000 + "1", "a." * 150_000 + "@", "1-" * 150_000]
    got = pii.pseudonymise(spark.createDataFrame([(t,) for t in rows], "text string"), KEY).collect()
    assert [len(r["text"]) for r in got] == list(map(len, rows))

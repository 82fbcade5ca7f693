"""PII pseudonyms by keyed Feistel permutations within the value's own format, in DataFrame operations only.

Card numbers that pass the Luhn check, phone numbers, valid social security numbers, IPv4 addresses and calendar dates
become other values of the same form: digits change, separators stay, a card number passes the Luhn check again, a social
security number is a valid one, an address has four octets, a date is a date. Each is a permutation under the key of all
values that its written format has, so equal values get equal pseudonyms in all documents and different values different
ones. E-mail names and hexadecimal secrets become keyed hashes of the same kind (80 bits, and as many as the secret had).
Numbers that fail their validation stay as they are.

Formats of phone numbers: North American ones of ten digits, with or without the code 1, and international ones with a plus
and 7 to 15 digits, separated by blanks, dots, hyphens and brackets in any way; the first digit of the code stays. Dates are
``yyyy-MM-dd``, ``dd/MM/yyyy`` and ``MM/dd/yyyy`` of the years 1 to 9999; what can be read day first is. A date of 1900 to
2102 becomes one of these years, and a day after the 12th one after the 12th, so that no pseudonym can be read the other way.

Defined cases: a null text stays null and an empty one empty; a text without such values stays as it is, byte for byte;
very long texts are treated whole; where two formats fit at one place, the first of e-mail, secret, address, date, social
security number, phone and card counts; repeated rows change alike; an empty table stays empty; other columns are kept;
``n_private`` is replaced if it exists.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import unused

ROUNDS = 10
#: Unix days of 0001-01-01 and 1900-01-01; days up to 9999-12-31, and of those the ones from 1900 on that stay together.
FIRST_DAY, MODERN_DAY, DAYS, MODERN_DAYS = -719162, -25567, 3652059, 272 * 272
#: The two kinds of dates as pairs of numbers below these: 272 * 272 and 425 * 8419 = DAYS - MODERN_DAYS.
MODERN_PAIR, OTHER_PAIR = (272, 272), (425, 8419)
#: Steps within which a walk is back among dates of its own kind; the odds of a longer walk are below 10 ** -13 at 64.
WALK = 64

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,8}"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d(?:[ .-]?\(?\d\)?){6,14}(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d/-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\d/-])"
#: What begins with a digit, a plus or a bracket is asked for there only, which spares most places of a text.
NUMBERS = f"(?=[0-9+(])(?:{'|'.join((SECRET, ADDRESS, DATE, SSN, PHONE, CARD))})|(?=[A-Fa-f]){SECRET}"
ANY = f"{EMAIL}|{NUMBERS}"
#: Stands before and after a value while a text is cut; a text that holds it itself is cut in another way.
MARK = "\ue000"


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _prf(key: str, kind: str, *parts: Column) -> Column:
    """64 bits from the key, the kind of value and the parts: a hash of their SHA-256."""
    return F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)), 256))


def _feistel(left: Column, right: Column, mod_left: Column, mod_right: Column, key: str, kind: str) -> Column:
    """A permutation of pairs below the moduli: each side in turn is moved by a function of the other."""
    pair = "struct<l:bigint,r:bigint>"

    def turn(acc: Column, i: Column) -> Column:
        moved = F.when(i % 2 == 0, F.struct(F.pmod(acc["l"] + F.pmod(_prf(key, kind, mod_left, i, acc["r"]), mod_left), mod_left).alias("l"), acc["r"].alias("r")))
        return moved.otherwise(F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + F.pmod(_prf(key, kind, mod_right, i, acc["l"]), mod_right), mod_right).alias("r"))).cast(pair)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.alias("l"), right.alias("r")).cast(pair), turn)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _padded(number: Column, n: Column | int) -> Column:
    return F.lpad(number.cast("string"), n, F.lit("0") if isinstance(n, Column) else "0")


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Other digits, as many, for a string of 2 to 36 digits."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    mixed = _feistel(F.substr(digits, F.lit(1), u).try_cast("long"), F.substr(digits, u + 1).try_cast("long"), ten(u), ten(v), key, kind)
    return _with(mixed, lambda m: F.concat(_padded(m["l"], u), _padded(m["r"], v)))


def luhn(digits: Column) -> Column:
    """The Luhn sum, divisible by ten for a valid number."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(digits, n - i + 1, F.lit(1)).try_cast("int")
        return acc + F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""
    state = "struct<out:string,i:int>"

    def put(digits: Column, acc: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(is_digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + is_digit.cast("int")).alias("i")).cast(state)

    return _with(digits, lambda d: F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")).cast(state), lambda acc, c: put(d, acc, c))["out"])


def _card(digits: Column, key: str) -> Column:
    payload = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _with(payload, lambda p: F.concat(p, _with(F.concat(p, F.lit("0")), lambda d: F.pmod(10 - luhn(d), F.lit(10)).cast("string"))))


def _phone(digits: Column, plus: Column, key: str) -> Column:
    """The code's first digit stays, so that numbers with the code 1 and without it stay linked."""
    code = F.when((F.length(digits) > 10) | plus, 1).otherwise(0)
    return F.concat(F.substr(digits, F.lit(1), code), _with(F.substr(digits, code + 1), lambda d: permuted_digits(d, key, "phone")))


def _ssn(digits: Column, key: str) -> Column:
    """Areas 1 to 899 without 666, groups 1 to 99 and serials 1 to 9999 as two numbers from 0; null for others."""
    part = lambda at, n: F.substr(digits, F.lit(at), F.lit(n)).try_cast("long")
    area, group, serial = part(1, 3), part(4, 2), part(6, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    mixed = _feistel((area - 1 - (area > 666).cast("long")) * 99 + group - 1, serial - 1, _long(898 * 99), _long(9999), key, "ssn")
    written = lambda m, a: F.concat(_padded(a + 1 + (a >= 665).cast("long"), 3), _padded(F.pmod(m["l"], _long(99)) + 1, 2), _padded(m["r"] + 1, 4))
    return F.when(valid, _with(mixed, lambda m: written(m, F.floor(m["l"] / 99))))


def _address(value: Column, key: str) -> Column:
    def written(o: Column) -> Column:
        ip = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), key, "ip")
        dotted = _with(ip, lambda m: F.concat_ws(".", *(x.cast("string") for half in ("l", "r") for x in (F.floor(m[half] / 256), F.pmod(m[half], F.lit(256))))))
        return F.when(F.forall(o, lambda x: x <= 255), dotted)

    return _with(F.transform(F.split(value, r"\."), lambda x: x.try_cast("long")), written)


def _other_day(day: Column, key: str) -> Column:
    """A permutation of Unix days of the years 1 to 9999 that keeps modern ones modern, and days after the 12th after the 12th."""
    late = lambda d: F.dayofmonth(F.date_from_unix_date(d.cast("int"))) > 12
    modern = day.between(MODERN_DAY, MODERN_DAY + MODERN_DAYS - 1)
    left, right = (F.when(modern, _long(m)).otherwise(_long(o)) for m, o in zip(MODERN_PAIR, OTHER_PAIR))
    state = "struct<at:bigint,day:bigint>"  # the place among dates of the kind, and the day there

    def to_day(at: Column) -> Column:
        return F.when(modern, at + MODERN_DAY).when(at + FIRST_DAY < MODERN_DAY, at + FIRST_DAY).otherwise(at + FIRST_DAY + MODERN_DAYS)

    def step(acc: Column) -> Column:
        mixed = _feistel(F.floor(acc["at"] / right), F.pmod(acc["at"], right), left, right, key, "date")
        return _with(_with(mixed, lambda m: m["l"] * right + m["r"]), lambda at: F.struct(at.alias("at"), to_day(at).alias("day")).cast(state))

    def turn(acc: Column, i: Column) -> Column:
        return F.when((i > 1) & (late(acc["day"]) == late(day)), acc).otherwise(step(acc))

    first = F.when(modern, day - MODERN_DAY).when(day < MODERN_DAY, day - FIRST_DAY).otherwise(day - FIRST_DAY - MODERN_DAYS)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.struct(first.alias("at"), day.alias("day")).cast(state), turn)["day"]


def _date(value: Column, key: str) -> Column:
    """A date of the same format, or null if it isn't one."""
    part = lambda text, at, n: F.substr(text, F.lit(at), F.lit(n))
    slashed = value.contains("/")
    one, two, year = part(value, 1, 2), part(value, 4, 2), part(value, 7, 4)
    first, second = (F.concat_ws("-", year, m, d).try_cast("date") for m, d in ((two, one), (one, two)))
    day = F.unix_date(F.when(slashed, F.coalesce(first, second)).otherwise(value.try_cast("date"))).cast("long")

    def written(iso: Column) -> Column:
        year, month, day_of = part(iso, 1, 4), part(iso, 6, 2), part(iso, 9, 2)
        return F.when(~slashed, iso).when(first.isNotNull(), F.concat_ws("/", day_of, month, year)).otherwise(F.concat_ws("/", month, day_of, year))

    return _with(day, lambda d: F.when(d >= FIRST_DAY, _with(F.date_from_unix_date(_other_day(d, key).cast("int")).cast("string"), written)))


def pseudonym(value: Column, key: str) -> Column:
    """Another value of the same kind, or null for what isn't private after all."""
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(value)), 256), 1, 20), F.lit("@"), domain)
    secret = F.substr(F.sha2(F.concat(F.lit(f"{key}|secret|"), F.lower(value)), 256), F.lit(1), F.length(value))  # one value in either case
    numbers = lambda d: (
        F.when(_whole(value, SSN), _refilled(value, _ssn(d, key)))
        .when(_whole(value, PHONE), _refilled(value, _phone(d, value.startswith("+"), key)))
        .when(luhn(d) % 10 == 0, _refilled(value, _card(d, key)))
    )
    return (
        F.when(value.contains("@"), F.when(name != "", mail))
        .when(_whole(value, SECRET), F.when(value == F.upper(value), F.upper(secret)).otherwise(secret))
        .when(_whole(value, ADDRESS), _address(value, key))
        .when(_whole(value, DATE), _date(value, key))
        .otherwise(_with(F.regexp_replace(value, r"\D", ""), numbers))
    )


def _cut(text: Column) -> Column:
    """The text in parts, of which every second one may be private; null where there can be none."""
    marked = lambda pattern: F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    both = F.flatten(F.zip_with(F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda gap, found: F.array(gap, found)))
    odd = F.filter(both, lambda x: x.isNotNull())
    has = lambda x: F.contains(text, F.lit(x))
    return F.when(has(MARK), odd).when(has("@"), marked(ANY)).when(text.rlike("[0-9]"), marked(NUMBERS))


def pseudonymise(docs: DataFrame, key: str = "weir") -> DataFrame:
    """``docs`` with private values in ``text`` replaced, and how many were: ``n_private``."""
    text, parts, new = F.col("text"), unused(docs, "parts_"), unused(docs, "new_")
    out = docs.withColumn(parts, _cut(text))
    out = out.withColumn(new, F.when(F.size(parts) > 1, F.transform(parts, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)))))
    out = out.withColumn("n_private", F.coalesce(F.size(F.filter(new, lambda x: x.isNotNull())), F.lit(0)))
    put = F.array_join(F.zip_with(parts, new, lambda old, x: F.coalesce(x, old)), "")
    return out.withColumn("text", F.when(F.col("n_private") > 0, put).otherwise(text)).drop(parts, new)

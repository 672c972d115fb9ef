"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One pattern finds the values; each kind has a check (Luhn, mod 97, octets, calendar) and is permuted within its own
format by a keyed Feistel network: a value's characters are halved, and in each round one half is shifted, character
by character inside its alphabet, by a hash of key, kind, round and the other half. Dates are permuted as day numbers.
Check digits are set anew. The permutation depends on key and value alone, so equal values stay linked across
documents and runs, and nobody without the key can turn a pseudonym back.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Only for tests and demonstrations; a deployment passes its own secret.
DEFAULT_KEY = "quirefold"
KEY_SETTING = "spark.quirefold.pii.key"

#: Patterns of the kinds; the first that matches at a place counts. Fixed values.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Characters stay inside their alphabet. Fixed values.
PLAIN = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
HEX = ["0123456789", "abcdef", "ABCDEF"]
#: Any 400 years have 146,097 days, which is 189 * 773; dates are permuted inside the 400 years, from 1800 back and on,
#: that they lie in, from the year 1000 to 9799.
FIRST_DAY, DAYS, DAY_ROWS, DAY_COLUMNS, ERAS = "1800-01-01", 146_097, 189, 773, (-2, 19)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def _number(key: str, *parts: Column) -> Column:
    """A hash of the parts under the key, as a number below 2 ** 60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256), 1, 15), 16, 10).cast("long")


def _shifted(half: Column, other: Column, key: str, kind: str, turn: Column, alphabets: list[str]) -> Column:
    """half with every character moved inside its alphabet by a keyed hash of the other half."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), F.length(half).cast("string"), other, F.lit(key)), 512)

    def moved(key_stream: Column) -> Callable[[Column, Column], Column]:
        def move(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(key_stream, ((i * 4) % 125 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            out = c
            for a in alphabets:
                at = F.position(c, F.lit(a))
                out = F.when(at > 0, F.substring(F.lit(a), (F.pmod(at - 1 + by, F.lit(len(a))) + 1).cast("int"), F.lit(1))).otherwise(out)
            return out

        return move

    return let(stream, lambda x: F.array_join(F.transform(_chars(half), moved(x)), ""))


def permuted(value: Column, key: str, kind: str, alphabets: list[str] = PLAIN) -> Column:
    """A keyed permutation of the strings that have value's length and, at every place, a character of its alphabet."""
    cut = lambda v: F.floor(F.length(v) / 2).cast("int")
    start = let(value, lambda v: F.struct(F.substring(v, F.lit(1), cut(v)).alias("a"), F.substring(v, cut(v) + 1, F.length(v)).alias("b")))

    def turn(s: Column, r: Column) -> Column:
        even = F.struct(_shifted(s["a"], s["b"], key, kind, r, alphabets).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), _shifted(s["b"], s["a"], key, kind, r, alphabets).alias("b"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(form: Column, new: Column) -> Column:
    """form with its digits and letters replaced, in order, by the characters of new."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def putting(filler: Column) -> Callable[[Column, Column], Column]:
        def put(s: Column, c: Column) -> Column:
            kept = F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))
            return F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(s["out"], F.substring(filler, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(kept)

        return put

    return let(new, lambda x: F.aggregate(_chars(form), start, putting(x), lambda s: s["out"]))


def _email(v: Column, key: str) -> Column:
    return F.concat(permuted(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _secret(v: Column, key: str) -> Column:
    return permuted(v, key, "secret", HEX)


def mod97(value: Column) -> Column:
    """The remainder by 97 of an account number, letters counting from 10 for A."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    number = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(_chars(moved), F.lit(0), lambda s, c: (F.when(c.rlike("[0-9]"), s * 10 + number(c)).otherwise(s * 100 + number(c))) % 97)


def _iban(v: Column, key: str) -> Column:
    def checked(country: Column, body: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0")
        return F.concat(country, check, body)

    def moved(plain: Column) -> Column:
        new = let(permuted(F.substring(plain, F.lit(5), F.length(plain)), key, "iban"), lambda body: checked(F.substring(plain, 1, 2), body))
        return F.when(mod97(plain) == 1, refilled(v, new)).otherwise(v)

    return let(F.regexp_replace(v, " ", ""), moved)


#: Areas of valid numbers, and serials of a group.
SSN_AREAS, SERIALS = 898, 9999


def _feistel(a: Column, b: Column, rows: int, columns: int, key: str, kind: str) -> Column:
    """(a, b), a below rows and b below columns, permuted as a struct of both."""

    def turn(s: Column, r: Column) -> Column:
        shift = lambda other: _number(key, F.lit(kind), r.cast("string"), other.cast("string"))
        even = F.struct(((s["a"] + shift(s["b"])) % rows).alias("a"), s["b"].alias("b"))
        odd = F.struct(s["a"].alias("a"), ((s["b"] + shift(s["a"])) % columns).alias("b"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _ip(v: Column, key: str) -> Column:
    part = lambda i: F.try_element_at(F.split(v, r"\."), F.lit(i)).cast("long")
    valid = (F.greatest(*[part(i) for i in range(1, 5)]) <= 255) & ~v.rlike(r"(?:^|\.)0[0-9]")
    new = _feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), 65536, 65536, key, "ip")
    show = lambda n: F.concat_ws(".", *[x.cast("string") for half in "ab" for x in (F.floor(n[half] / 256), n[half] % 256)])
    return F.when(valid, let(new, show)).otherwise(v)


def _date(v: Column, key: str) -> Column:
    iso = v.rlike("^[0-9]{4}-")
    turned = F.concat(F.substring(v, 7, 4), F.lit("-"), F.substring(v, 4, 2), F.lit("-"), F.substring(v, 1, 2))
    mark = F.substring(v, 3, 1)

    def shown(era: Column) -> Callable[[Column], Column]:
        return lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), (era * DAYS + n["a"] * DAY_COLUMNS + n["b"]).cast("int")).cast("string")

    def written(out: Column) -> Column:
        return F.when(iso, out).otherwise(F.concat(F.substring(out, 9, 2), mark, F.substring(out, 6, 2), mark, F.substring(out, 1, 4)))

    def moved(day: Column) -> Column:
        era, at = F.floor(day / DAYS), F.pmod(day, F.lit(DAYS))
        new = _feistel(F.floor(at / DAY_COLUMNS), at % DAY_COLUMNS, DAY_ROWS, DAY_COLUMNS, key, "date")
        return F.when(era.between(*ERAS), let(let(new, shown(era)), written)).otherwise(v)

    return let(F.datediff(F.when(iso, v).otherwise(turned).try_cast("date"), F.lit(FIRST_DAY).cast("date")), moved)


def _ssn(v: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01 and serials from 0001 are numbered, and the numbers permuted."""
    plain = digits(v)
    part = lambda at, n: F.substring(plain, at, n).cast("long")
    area, rest = part(1, 3) - 1 - (part(1, 3) > 666).cast("long"), (part(4, 2) - 1) * SERIALS + part(6, 4) - 1

    def shown(n: Column) -> Column:
        number = n["a"] + 1 + (n["a"] >= 665).cast("long")
        return F.concat(*[F.lpad(x.cast("string"), w, "0") for x, w in ((number, 3), (F.floor(n["b"] / SERIALS) + 1, 2), (n["b"] % SERIALS + 1, 4))])

    new = let(_feistel(area, rest, SSN_AREAS, 99 * SERIALS, key, "ssn"), shown)
    return F.when(v.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), refilled(v, new)).otherwise(v)


def _phone(v: Column, key: str) -> Column:
    """The country code stays; 7 to 15 digits count as a number."""
    code = F.regexp_extract(v, r"^\+[0-9]{1,3}(?![0-9])", 0)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    return F.when(F.length(digits(v)).between(7, 15), F.concat(code, refilled(rest, permuted(digits(rest), key, "phone")))).otherwise(v)


def _card(v: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.get(F.filter(F.transform(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.concat(body, d)), lambda n: F.call_function("luhn_check", n)), 0)

    def moved(plain: Column) -> Column:
        new = let(permuted(F.substring(plain, F.lit(1), F.length(plain) - 1), key, "card"), checked)
        return F.when(F.call_function("luhn_check", plain), refilled(v, new)).otherwise(v)

    return let(digits(v), moved)


RULES: dict[str, Callable[[Column, str], Column]] = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(v: Column, key: str) -> Column:
    out = v
    for kind in reversed(KINDS):
        out = F.when(v.rlike(f"^(?:{KINDS[kind]})$"), RULES[kind](v, key)).otherwise(out)
    return out


def secret_of(spark: SparkSession) -> str:
    """The key of a session: its setting spark.quirefold.pii.key, or, with a warning, the published one."""
    key = spark.conf.get(KEY_SETTING, "") or spark.sparkContext.getConf().get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set; pseudonyms under the published key can be turned back", stacklevel=2)
    return key or DEFAULT_KEY


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """docs with pseudonyms in text, and pii_found and pii_changed, the numbers of values found and replaced.

    Values that fail their kind's check stay as they are. A null text stays null with counts of 0, an empty one stays
    empty; texts may be of any length; columns of the two names are replaced; other columns and repeated rows stay; an
    empty table gives no row.
    """
    likely = F.col("text").rlike("[0-9@]|[0-9A-Fa-f]{32}")
    found = F.when(likely, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(F.size("_pii_found") > 0, F.split("text", ANY, -1))
    staged = docs.withColumn("_pii_found", F.coalesce(found, F.array().cast("array<string>")))
    staged = staged.withColumn("_pii_new", F.transform("_pii_found", lambda v: pseudonym(v, key))).withColumn("_pii_between", between)
    rebuilt = F.array_join(F.flatten(F.zip_with("_pii_between", "_pii_new", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("_pii_found", "_pii_new", lambda a, b: a != b), lambda x: x))
    out = staged.withColumn("pii_found", F.size("_pii_found").cast("long")).withColumn("pii_changed", changed.cast("long")).withColumn("text", F.when(F.size("_pii_found") > 0, rebuilt).otherwise(F.col("text")))
    return out.drop("_pii_found", "_pii_new", "_pii_between")

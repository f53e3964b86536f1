"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation; DataFrame functions only.

Candidates are found by one pattern and then validated: card numbers by their check digit, IBANs by their remainder,
social security numbers by their ranges, addresses by their octets, dates by the calendar (1900 to 2099). A valid value
becomes a list of numbers, each below a radix of its own (the letters and digits of an e-mail address, the digits of a
card without its check digit, the octets of an address, a date's year and place in it, ...). An unbalanced Feistel network with
SHA-256 as its keyed round function permutes all lists of those radices, and the value is written again in its own
format, check digits renewed, separators and letter case kept. Equal values of a kind therefore get equal pseudonyms in
all documents, different ones different pseudonyms, and lengths stay. Days of the month up to 12, from 13 to 28, over 28
and 29 February are permuted among themselves, so that all spellings of a date share one permutation and day and month
are read from a pseudonym as they were from the date. Separators and letter case do not enter the
permutation, so that spellings of one value stay linked, too.

Values that fail validation, and texts without candidates, stay as they are. A null text stays null; an empty table
gives no rows. Rows are rewritten one by one, so repeated rows and ids and further columns are harmless.
"""

from __future__ import annotations

import hashlib
import hmac
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import let

ROUNDS = 8
#: The setting that holds the secret key (its name is one that Spark redacts), and the key where it is unset: for tests.
KEY_SETTING, TEST_KEY = "spark.ledgerloom.pii.secret.key", "no secret"
#: Derived keys begin with this mark, by which session_key has Spark redact them in plans.
MARK, REDACTION = "pii-key-", "spark.sql.redaction.string.regex"

_NOT_INSIDE, _ENDS = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})",
    "secret": _NOT_INSIDE + r"(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)" + _ENDS,
    "iban": _NOT_INSIDE + r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+" + _ENDS,
    "ip": r"(?<![0-9A-Za-z.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?![0-9A-Za-z]|\.[0-9])",
    "iso_date": r"(?<![0-9A-Za-z-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])",
    "slash_date": r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9A-Za-z/])",
    "dot_date": r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{13,19}+|(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})" + _ENDS,
    "phone": r"(?<![0-9A-Za-z+(])(?:\+[1-9](?:[ .()-]{0,2}[0-9]){7,14}+|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})" + _ENDS,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every candidate has one of these characters.
HINT = "[0-9@]"
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
FIRST_DAY, LAST_DAY = "1900-01-01", "2099-12-31"
#: The months and days over 28, without 29 February.
MONTH_ENDS = [(m, d) for d in (29, 30, 31) for m in range(1, 13) if d <= (28 if m == 2 else 30 if m in (4, 6, 9, 11) else 31)]


def chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


# ------------------------------------------------------------------ the permutation
def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """Permute an array of numbers, each below its radix: rounds add to one half what the key makes of the other."""
    half = lambda a: F.floor(F.size(a) / 2).cast("int")

    def one(a: Column, r: Column) -> Column:
        first = F.pmod(r, F.lit(2)) == 0
        other = F.filter(a, lambda _, i: (i < half(a)) != first)
        text = F.concat_ws(":", F.lit(key), F.lit(kind), r.cast("string"), F.size(a).cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))

        def move(v: Column, i: Column, base: Column) -> Column:
            digest = F.substring(F.sha2(F.concat_ws("#", base, i.cast("string")), 256), 1, 14)
            add = F.conv(digest, 16, 10).cast("long")
            return F.when((i < half(a)) == first, F.pmod(v + add, F.get(radices, i))).otherwise(v)

        return let(text, lambda base: F.transform(a, lambda v, i: move(v, i, base)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.transform(values, lambda v: v.cast("long")), lambda a, r: one(a, r))


def longs(*values: Column | int) -> Column:
    return F.array(*((F.lit(v) if isinstance(v, int) else v).cast("long") for v in values))


def respelled(value: Column, alphabets, key: str, kind: str) -> Column:
    """Permute the characters that have an alphabet of their own; alphabets(value characters) gives one a position."""

    def write(letters: Column, own: Column) -> Column:
        free = F.filter(own, lambda a: F.length(a) > 1)
        spots = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.length(F.get(own, i)) > 1)
        values = F.transform(spots, lambda i: F.instr(F.get(own, i), F.get(letters, i)) - 1)
        moved = feistel(values, F.transform(free, lambda a: F.length(a).cast("long")), key, kind)

        def put(new: Column) -> Column:
            nth = lambda i: F.size(F.filter(spots, lambda s: s < i))
            return F.array_join(F.transform(own, lambda a, i: F.when(F.length(a) > 1, F.substr(a, F.get(new, nth(i)).cast("int") + 1, F.lit(1))).otherwise(a)), "")

        return let(moved, put)

    return let(chars(value), lambda letters: let(alphabets(letters), lambda own: write(letters, own)))


def plain_alphabet(c: Column) -> Column:
    return F.when(c.between("0", "9"), DIGITS).when(c.between("a", "z"), LOWER).when(c.between("A", "Z"), UPPER).otherwise(c)


# ------------------------------------------------------------------ kinds
def email(m: Column, key: str) -> Column:
    """The part before the @ is respelled; the host stays."""
    local = F.substring_index(m, "@", 1)
    return F.concat(respelled(local, lambda s: F.transform(s, plain_alphabet), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    low = respelled(F.lower(m), lambda s: F.transform(s, lambda _: F.lit(HEX)), key, "secret")
    return F.when(m == F.lower(m), low).otherwise(F.upper(low))


def luhn(digits: Column) -> Column:
    """Remainder of a digit string's check sum by 10, the last digit being the check digit."""

    def part(c: Column, i: Column) -> Column:
        v = c.cast("int")
        twice = F.pmod(F.length(digits) - i, F.lit(2)) == 0
        return F.when(twice, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.pmod(F.aggregate(F.transform(chars(digits), part), F.lit(0), lambda a, v: a + v), F.lit(10))


def card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = F.substr(m, F.lit(1), F.length(m) - 1)
    moved = respelled(body, lambda s: F.transform(s, lambda c: F.when(c.between("0", "9"), DIGITS).otherwise(c)), key, "card")

    def close(new: Column) -> Column:
        rest = luhn(F.concat(F.regexp_replace(new, "[^0-9]", ""), F.lit("0")))
        return F.concat(new, F.pmod(10 - rest, F.lit(10)).cast("string"))

    return F.when(luhn(digits) == 0, let(moved, close)).otherwise(m)


def mod97(text: Column) -> Column:
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(chars(text), number), F.lit(0), lambda a, v: F.pmod(a * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)))


def iban(m: Column, key: str) -> Column:
    land, body = F.substring(m, 1, 2), F.substr(m, F.lit(5), F.length(m) - 4)
    valid = mod97(F.concat(body, F.substring(m, 1, 4))) == 1

    def close(new: Column) -> Column:
        check = 98 - mod97(F.concat(new, land, F.lit("00")))
        return F.concat(land, F.lpad(check.cast("string"), 2, "0"), new)

    return F.when(valid, let(respelled(body, lambda s: F.transform(s, plain_alphabet), key, "iban"), close)).otherwise(m)


def ip(m: Column, key: str) -> Column:
    """Octets keep their number of digits: 0-9, 10-99 and 100-255 are permuted among themselves."""
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    least = lambda o: F.when(o < 10, 0).when(o < 100, 10).otherwise(100)
    many = lambda o: F.when(o < 10, 10).when(o < 100, 90).otherwise(156)

    def write(own: Column) -> Column:
        moved = feistel(F.transform(own, lambda o: o - least(o)), F.transform(own, lambda o: many(o).cast("long")), key, "ip")
        return F.array_join(F.zip_with(own, moved, lambda o, v: (least(o) + v).cast("string")), ".")

    return let(octets, write)


def ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substring(m, a, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(longs(area - 1 - (area > 666).cast("int"), group - 1, serial - 1), longs(898, 99, 9999), key, "ssn")

    def write(v: Column) -> Column:
        low = F.get(v, 0) + 1
        own = low + (low >= 666).cast("int")
        return F.concat_ws("-", *(F.lpad(x.cast("string"), n, "0") for x, n in ((own, 3), (F.get(v, 1) + 1, 2), (F.get(v, 2) + 1, 4))))

    return F.when(valid, let(moved, write)).otherwise(m)


def day(date: Column, pattern: str, key: str) -> Column:
    """Another day of the same class between FIRST_DAY and LAST_DAY, written by the same pattern; null for no date."""
    d, month, year = F.day(date), F.month(date), F.year(date)
    ends = F.array(*(F.lit(100 * m + n) for m, n in MONTH_ENDS))
    written = lambda y, m, n: F.date_format(F.make_date(y.cast("int"), m.cast("int"), n.cast("int")), pattern)

    def within(first: int, wide: int, kind: str) -> Column:
        moved = feistel(longs(year - 1900, (month - 1) * wide + d - first), longs(200, 12 * wide), key, kind)
        return let(moved, lambda v: written(F.get(v, 0) + 1900, F.floor(F.get(v, 1) / wide) + 1, F.pmod(F.get(v, 1), F.lit(wide)) + first))

    late = feistel(longs(year - 1900, F.array_position(ends, 100 * month + d) - 1), longs(200, len(MONTH_ENDS)), key, "date:late")
    end = lambda v: F.get(ends, F.get(v, 1).cast("int"))
    leap = (year - 1904) / 4
    leap_moved = feistel(longs(F.floor(leap / 7), F.pmod(leap, F.lit(7))), longs(7, 7), key, "date:leap")
    new = (
        F.when(d <= 12, within(1, 12, "date:early"))
        .when(d <= 28, within(13, 16, "date:middle"))
        .when((d == 29) & (month == 2), let(leap_moved, lambda v: written(1904 + 4 * (7 * F.get(v, 0) + F.get(v, 1)), F.lit(2), F.lit(29))))
        .otherwise(let(late, lambda v: written(F.get(v, 0) + 1900, F.floor(end(v) / 100), F.pmod(end(v), F.lit(100)))))
    )
    return F.when(date.between(FIRST_DAY, LAST_DAY), new)


def phone(m: Column, key: str) -> Column:
    """National digits are respelled; of North American numbers an area or exchange keeps its class of first digits."""
    after = lambda i: F.length(F.regexp_replace(F.substr(m, i + 1), "[^0-9]", ""))
    american = (F.length(F.regexp_replace(m, "[^0-9]", "")) == 10) | m.startswith("+1")

    def alphabet(c: Column, i: Column) -> Column:
        lead = american & after(i).isin(10, 7)
        return (
            F.when(~c.between("0", "9"), c)
            .when(m.startswith("+") & (after(i) > F.when(american, 10).otherwise(7)), c)
            .when(lead & (c >= "2"), "23456789")
            .when(lead, "01")
            .otherwise(DIGITS)
        )

    return respelled(m, lambda s: F.transform(s, alphabet), key, "phone")


def kind_of(m: Column) -> Column:
    chain = F
    for kind, pattern in PATTERNS.items():
        chain = chain.when(m.rlike(f"^(?:{pattern})$"), kind)
    return chain


def pseudonym(m: Column, key: str) -> Column:
    """(kind, text) of one candidate; kind is null where it is not valid."""

    def of(kind: Column) -> Column:
        date = lambda pattern: F.coalesce(day(F.try_to_date(m, pattern), pattern, key), m)
        # a month is never over 12, so a text is a date in one of these orders only
        slash = F.coalesce(day(F.try_to_date(m, "MM/dd/yyyy"), "MM/dd/yyyy", key), F.when(F.substring(m, 1, 2) > "12", day(F.try_to_date(m, "dd/MM/yyyy"), "dd/MM/yyyy", key)), m)
        new = (
            F.when(kind == "email", email(m, key))
            .when(kind == "secret", secret(m, key))
            .when(kind == "iban", iban(m, key))
            .when(kind == "ip", ip(m, key))
            .when(kind == "iso_date", date("yyyy-MM-dd"))
            .when(kind == "slash_date", slash)
            .when(kind == "dot_date", date("dd.MM.yyyy"))
            .when(kind == "ssn", ssn(m, key))
            .when(kind == "card", card(m, key))
            .when(kind == "phone", phone(m, key))
            .otherwise(m)
        )
        return let(new, lambda t: F.struct(F.when(t != m, F.regexp_replace(kind, ".*_date", "date")).alias("kind"), t.alias("text")))

    return let(kind_of(m), of)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """row (the input row), text (rewritten), kinds (of the replaced values, in order)."""
    own = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = own.select("row", "text", F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("found"))
    some = F.size(F.coalesce("found", F.array().cast("array<string>"))) > 0
    new = found.select("row", "text", F.when(some, F.transform("found", lambda m: pseudonym(m, key))).alias("new"))
    joined = F.array_join(F.transform(F.split("text", ANY), lambda p, i: F.concat(p, F.coalesce(F.get("new", i)["text"], F.lit("")))), "")
    kinds = F.filter(F.transform("new", lambda x: x["kind"]), lambda k: k.isNotNull())
    return new.select("row", F.when(F.col("new").isNotNull(), joined).otherwise(F.col("text")).alias("text"), F.coalesce(kinds, F.array().cast("array<string>")).alias("kinds"))


def derived(secret: str) -> str:
    return MARK + hmac.new(secret.encode(), b"pseudonyms", hashlib.sha256).hexdigest()


def session_key(spark: SparkSession) -> str:
    """A key derived from the session's secret; Spark shows neither of them.

    Without a secret the public TEST_KEY is used, with a warning: its pseudonyms can be turned back by anyone.
    """
    secret = spark.conf.get(KEY_SETTING, None)
    if secret is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public test key", stacklevel=2)
    hidden = spark.conf.get(REDACTION, None)
    if MARK not in (hidden or ""):
        spark.conf.set(REDACTION, f"{hidden}|{MARK}[0-9a-f]+" if hidden else f"{MARK}[0-9a-f]+")
    return derived(TEST_KEY if secret is None else secret)

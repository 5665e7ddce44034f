"""Operator 1: personal data replaced by format-preserving pseudonyms, in SQL expressions only.

Numbers that pass their check (Luhn, mod 97, octets, calendar, ...) are permuted within their own format by a keyed
Feistel network: a card number becomes another valid card number with the same spacing, a date another date.  One
key gives one permutation, so equal values stay equal across documents and different ones different.  Mail addresses
and secrets, which have no number format, become keyed digests of the same kind.  What fails its check is left alone, unless
a word like "password" stands before it: then it is a secret, whatever it looks like.

The key is never part of a plan: it comes from a table of one row, read by a scalar subquery, so that neither explain
nor the UI nor event logs show it.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeworks.llm.common import table

ROUNDS = 10
#: What stands behind a word like "password" is a secret from so many characters on, to its closing quote or white space; there is no upper bound.
LEAST_SECRET = 8
#: For the query on test tables; a real run passes its own secret.
DEMO_KEY = "demonstration-key"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SECRET_WORD = r"(?i:token|secret|passwd|password|api[_-]?key)[\"']?+\s*+(?::=|=>|[=:])\s*+[\"']?+"


def secret_pattern() -> str:
    """A secret word and what it stands for: up to the closing quote where there is one, else up to white space."""
    run = lambda inside: rf"(?:(?!{SECRET_WORD}){inside}){{{LEAST_SECRET},}}+"
    quoted = "|".join(rf"(?<={q})(?=[^{q}\n]*+{q}){run(rf'[^{q}\n]')}" for q in "\"'")
    unclosed = r"(?<!\")(?<!')|(?<=\")(?![^\"\n]*+\")|(?<=')(?![^'\n]*+')"
    return rf"{SECRET_WORD}(?:{quoted}|(?:{unclosed}){run(r'\S')})"


#: Length of an IBAN by country (fixed values); a longer run of groups is an IBAN and something else.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    groups = lambda n: rf"(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    parts = [rf"(?:{countries.replace(' ', '|')})\d{{2}}{groups(n - 4)}" for n, countries in IBAN_LENGTHS.items()]
    other = rf"(?!{known})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*parts, other])})(?![A-Za-z0-9])"


PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.(?=[\p{L}\p{N}-])[\p{L}\p{N}-]++)++(?<=\p{L}{2})",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": secret_pattern(),
    "iban": iban_pattern(),
    "ip": rf"(?<!\d)(?<!\d\.)(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![./-]?\d)",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


Key = str | Column


def as_column(key: Key) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def digest(key: Key, *parts: Column) -> Column:
    """Keyed SHA-256 in two passes, hexadecimal."""
    inner = F.sha2(F.concat(as_column(key), F.lit("\x01"), F.concat_ws("\x1f", *parts)), 256)
    return F.sha2(F.concat(as_column(key), F.lit("\x02"), inner), 256)


def draw(key: Key, tweak: str, turn: Column, half: Column, size: Column) -> Column:
    """A keyed number below size (< 10**18)."""
    wide = F.conv(F.substring(digest(key, F.lit(tweak), turn.cast("string"), half.cast("string")), 1, 15), 16, 10)
    return F.pmod(wide.cast("long"), size)


def power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permuted_digits(key: Key, tweak: str, digits: Column) -> Column:
    """A keyed permutation of all strings of so many digits (2 to 36): unbalanced Feistel, ten rounds.

    digits must be a plain attribute or lambda variable, as it is used often.
    """
    u = F.floor(F.length(digits) / 2).cast("int")
    v = F.length(digits) - u
    state = F.struct(
        F.substring(digits, F.lit(1), u).cast("long").alias("a"), F.substring(digits, u + 1, v).cast("long").alias("b")
    )

    def turn(s: Column, i: Column) -> Column:
        size = power(F.when(i % 2 == 0, u).otherwise(v))
        moved = F.pmod(s["a"] + draw(key, f"{tweak}", F.concat_ws(":", i, F.length(digits)), s["b"], size), size)
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn,
        lambda s: F.concat(F.lpad(s["a"].cast("string"), u, "0"), F.lpad(s["b"].cast("string"), v, "0")),
    )


def divisor(size: int) -> int:
    """The largest divisor up to the square root."""
    return next(d for d in range(math.isqrt(size), 0, -1) if size % d == 0)


def permuted_index(key: Key, tweak: str, index: Column, size: int) -> Column:
    """A keyed permutation of 0 .. size - 1: Feistel on a rectangle of exactly that size, so that nothing falls outside.

    The two halves are numbers below rows and columns, rows * columns = size, and are moved in turn.
    """
    rows = divisor(size)
    if rows == 1:
        raise ValueError("a prime number of values has no rectangle")
    sides = (rows, size // rows)

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        side = F.when(even, sides[0]).otherwise(sides[1])
        moved = F.pmod(s["a"] + draw(key, tweak, i, s["b"], side), side)
        return F.struct(s["b"].alias("a"), moved.alias("b"))

    state = F.struct(F.floor(index / sides[1]).cast("long").alias("a"), F.pmod(index.cast("long"), F.lit(sides[1])).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, turn, lambda s: s["a"] * sides[1] + s["b"])


def named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda s, x: s + x)


def mod_97(text: Column) -> Column:
    """A string of digits and capitals (A = 10, ...) modulo 97."""

    def step(s: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(s * F.when(c.between("0", "9"), 10).otherwise(100) + value, F.lit(97))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def relaid(pattern: Column, digits: Column) -> Column:
    """The digits, in order, in the places where pattern has digits."""

    def place(i: Column) -> Column:
        c = F.substring(pattern, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(pattern, F.lit(1), i), r"[^0-9]", ""))
        return F.when(c.between("0", "9"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(pattern)), place), "")


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


#: Dates are permuted among those of 1900 to 2099, and all others from 0001 to 9999 among themselves: first day, days of the
#: first range, place of the first range among all days, all days.
FIRST_DAY, DAYS, DAYS_BEFORE, ALL_DAYS = "0001-01-01", 73_049, 693_595, 3_652_059

# --- one function for each kind: what was found -> its pseudonym, or the same again if it fails its check ---------


def mail(key: Key, m: Column) -> Column:
    return named(digest(key, F.lit("mail"), F.lower(m)), lambda h: F.concat(F.lit("u"), F.substring(h, 1, 12), F.lit("@"), F.substring(h, 13, 8), F.lit(".invalid")))


def cloud_key(key: Key, m: Column) -> Column:
    return F.concat(F.substring(m, 1, 4), F.upper(F.substring(digest(key, F.lit("cloud"), m), 1, 16)))


def secret(key: Key, m: Column) -> Column:
    """A digest of the value, spun out by a counter to its length."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(m) - 1) / 64).cast("int"))
    spun = lambda h: F.array_join(F.transform(blocks, lambda i: digest(key, F.lit("secret"), h, i.cast("string"))), "")
    return F.substring(named(digest(key, F.lit("secret"), m), spun), F.lit(1), F.length(m))


def iban(key: Key, m: Column) -> Column:
    def checked(plain: Column) -> Column:
        body = F.substring(plain, F.lit(5), F.length(plain))
        new_body = named(only_digits(body), lambda d: F.when(F.length(d) >= 2, relaid(body, permuted_digits(key, "iban", d))).otherwise(body))
        country = F.substring(plain, 1, 2)
        new = named(new_body, lambda b: F.concat(country, F.lpad((98 - mod_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        good = mod_97(F.concat(body, country, F.substring(plain, 3, 2))) == 1
        return F.when(good, new)

    new = named(F.regexp_replace(m, " ", ""), checked)
    spaced = named(new, lambda n: F.when(F.instr(m, " ") > 0, F.trim(F.regexp_replace(n, "(.{4})", "$1 "))).otherwise(n))
    return F.coalesce(spaced, m)


def ip(key: Key, m: Column) -> Column:
    part = F.split(m, r"\.")
    index = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    return named(
        permuted_index(key, "ip", index, 1 << 32),
        lambda x: F.concat_ws(".", *(F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0))),
    )


def date(key: Key, m: Column) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    parts = F.split(m, r"[./-]")
    first, second, third = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
    year, a, b = F.when(iso, first).otherwise(third), second, F.when(iso, third).otherwise(first)
    day_first = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(a.cast("string"), 2, "0"), F.lpad(b.cast("string"), 2, "0")), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(b.cast("string"), 2, "0"), F.lpad(a.cast("string"), 2, "0")), "yyyy-MM-dd")
    start = F.lit(FIRST_DAY).cast("date")

    def moved(found: Column) -> Column:
        index = F.datediff(found, start)
        recent = index - DAYS_BEFORE
        other = F.when(recent < 0, index).otherwise(index - DAYS)
        near = permuted_index(key, "date", recent, DAYS) + DAYS_BEFORE
        far = named(permuted_index(key, "other date", other, ALL_DAYS - DAYS), lambda x: F.when(x < DAYS_BEFORE, x).otherwise(x + DAYS))
        new = F.when((recent >= 0) & (recent < DAYS), near).otherwise(far)
        return F.when((index >= 0) & (index < ALL_DAYS), F.date_add(start, new.cast("int")))

    def written(new: Column, pattern: str) -> Column:
        return F.replace(F.date_format(new, pattern), F.lit("."), F.substring(m, 3, 1))

    return F.coalesce(
        F.when(iso, F.date_format(named(day_first, moved), "yyyy-MM-dd")),
        F.when(~iso & day_first.isNotNull(), written(named(day_first, moved), "dd.MM.yyyy")),
        F.when(~iso & day_first.isNull(), written(named(month_first, moved), "MM.dd.yyyy")),
        m,
    )


def social(key: Key, m: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written(x: Column) -> Column:
        a = F.floor(x / (99 * 9999)).cast("long") + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        g, s = F.pmod(F.floor(x / 9999).cast("long"), F.lit(99)) + 1, F.pmod(x, F.lit(9999)) + 1
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad(g.cast("string"), 2, "0"), F.lpad(s.cast("string"), 4, "0"))

    return F.when(good, named(permuted_index(key, "social", index, 898 * 99 * 9999), written)).otherwise(m)


def phone(key: Key, m: Column) -> Column:
    """The country code stays; 7 to 15 digits follow or it is no phone number."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return named(
        only_digits(rest),
        lambda d: F.when(F.length(d).between(7, 15), F.concat(code, relaid(rest, permuted_digits(key, "phone", d)))).otherwise(m),
    )


def card(key: Key, m: Column) -> Column:
    """The first digit, which tells the scheme, stays; the last is the new check digit."""

    def checked(d: Column) -> Column:
        inner = named(F.substring(d, F.lit(2), F.length(d) - 2), lambda x: F.concat(F.substring(d, 1, 1), permuted_digits(key, "card", x)))
        new = named(inner, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, relaid(m, new)).otherwise(m)

    return named(only_digits(m), checked)


KINDS = {"mail": mail, "cloud_key": cloud_key, "iban": iban, "ip": ip, "date": date, "social": social, "phone": phone, "card": card}


def pseudonym(key: Key, m: Column) -> Column:
    """What stands for a value told by its own form; a value of no kind is given back as it is."""
    out = None
    for name, kind in KINDS.items():
        test, value = m.rlike(rf"^(?:{PATTERNS[name]})$"), kind(key, m)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(m)


def replaced(key: Key, m: Column) -> Column:
    """What stands for a match.  Behind a word like "password" everything is a secret: its kind's pseudonym, else a digest."""
    word = F.regexp_extract(m, rf"^{SECRET_WORD}", 0)

    def of_value(w: Column, v: Column) -> Column:
        return named(pseudonym(key, v), lambda n: F.concat(w, F.when((w != "") & (n == v), secret(key, v)).otherwise(n)))

    return named(word, lambda w: named(F.substring(m, F.length(w) + 1, F.length(m)), lambda v: of_value(w, v)))


def key_table(spark: SparkSession, key: str) -> DataFrame:
    """A key as a table of one row; in production it is read from where keys are kept."""
    return spark.createDataFrame([(key,)], "key string")


def pseudonymised(docs: DataFrame, key: str | DataFrame, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal data in text_col replaced; all other columns, and texts without any, as they are.

    key: a table of one row and one column, or a string.  A null text stays null (count 0), an empty one empty; an empty
    table gives an empty one.  Repeated rows get the same pseudonyms.  Very long texts cost time in proportion.
    count_col, if given, is added (or replaced): how many values were changed.
    """
    keys = key_table(docs.sparkSession, key) if isinstance(key, str) else key
    held = f"_pii_{uuid.uuid4().hex}"  # one column that no caller has, for what is under way
    text = F.col(text_col)
    possible = text.rlike("[0-9@]|(?i:token|secret|passw|api[_-]?key)")
    work = docs.withColumn(held, F.struct(F.when(possible, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found")))
    found = F.col(f"{held}.found")
    some = F.size(found) > 0
    work = work.withColumn(held, F.struct(found.alias("found"), F.when(some, F.split(text, ANY, -1)).alias("gaps"), keys.select(keys.columns[0]).scalar().alias("key")))
    secret_key = F.col(f"{held}.key")
    new = F.when(some, F.transform(found, lambda m: replaced(secret_key, m)))
    work = work.withColumn(held, F.struct(found.alias("found"), F.col(f"{held}.gaps").alias("gaps"), new.alias("new")))
    gaps, new = F.col(f"{held}.gaps"), F.col(f"{held}.new")
    joined = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(new)), new, lambda g, n: F.concat(g, n)), ""), F.element_at(gaps, -1))
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    out = work.withColumn(text_col, F.when(new.isNotNull(), joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(new.isNotNull(), changed).otherwise(F.lit(0)))
    return out.drop(held)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents"), DEMO_KEY, count_col="n_replaced")


QUERIES = {"op1_pii": op1_pii}
ORACLE_SQL: dict[str, str] = {}

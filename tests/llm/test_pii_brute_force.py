"""Pseudonyms against a plain Python version: the same patterns, a Feistel network of its own, calendar and check digits."""

import datetime as dt
import hashlib
import random
import time

import pytest
import regex
from pyspark.sql import functions as F

from noticeworks.llm import pii

from .conftest import prose

KEY = "k2"


def digest(*parts):
    inner = hashlib.sha256((KEY + "\x01" + "\x1f".join(parts)).encode()).hexdigest()
    return hashlib.sha256((KEY + "\x02" + inner).encode()).hexdigest()


def draw(tweak, turn, half, size):
    return int(digest(tweak, str(turn), str(half))[:15], 16) % size


def permuted_digits(tweak, d):
    u = len(d) // 2
    v = len(d) - u
    a, b = int(d[:u]), int(d[u:])
    for i in range(10):
        size = 10 ** (v if i % 2 else u)
        a, b = b, (a + draw(tweak, f"{i}:{len(d)}", b, size)) % size
    return f"{a:0{u}d}{b:0{v}d}"


def permuted_index(tweak, x, size):
    rows = max(k for k in range(1, int(size**0.5) + 1) if size % k == 0)
    sides = rows, size // rows
    a, b = divmod(x, sides[1])
    for i in range(10):
        side = sides[i % 2]
        a, b = b, (a + draw(tweak, i, b, side)) % side
    return a * sides[1] + b


def relaid(pattern, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in pattern)


def only_digits(s):
    return "".join(c for c in s if c in "0123456789")


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def iban(m):
    plain = m.replace(" ", "")
    country, body = plain[:2], plain[4:]
    if mod97(body + plain[:4]) != 1:
        return m
    digits = only_digits(body)
    new = relaid(body, permuted_digits("iban", digits)) if len(digits) > 1 else body
    out = f"{country}{98 - mod97(new + country + '00'):02d}{new}"
    return " ".join(out[i : i + 4] for i in range(0, len(out), 4)) if " " in m else out


def date(m):
    parts = [int(x) for x in regex.split(r"[./-]", m)]
    if m[4] == "-":
        ways = [((parts[0], parts[1], parts[2]), "%Y-%m-%d")]
    else:
        ways = [((parts[2], parts[1], parts[0]), "%d{0}%m{0}%Y"), ((parts[2], parts[0], parts[1]), "%m{0}%d{0}%Y")]
    for ymd, form in ways:
        try:
            day = dt.date(*ymd)
        except ValueError:
            continue
        first, last = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()
        n = day.toordinal()
        if first <= n < last:
            new = first + permuted_index("date", n - first, last - first)
        else:
            others = [*range(1, first), *range(last, dt.date(9999, 12, 31).toordinal() + 1)]
            new = others[permuted_index("other date", others.index(n), len(others))]
        d = dt.date.fromordinal(new)
        return form.format(m[2]).replace("%Y", f"{d.year:04d}").replace("%m", f"{d.month:02d}").replace("%d", f"{d.day:02d}")
    return m


def social(m):
    area, group, serial = map(int, m.split("-"))
    if not (1 <= area <= 899 and area != 666 and group and serial):
        return m
    x = permuted_index("social", ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    a = x // (99 * 9999) + 1
    return f"{a + (a >= 666):03d}-{x // 9999 % 99 + 1:02d}-{x % 9999 + 1:04d}"


def phone(m):
    code = regex.search(r"^\+\d{1,3}(?=[ .(-])|^", m)[0]
    rest = m[len(code) :]
    digits = only_digits(rest)
    return code + relaid(rest, permuted_digits("phone", digits)) if 7 <= len(digits) <= 15 else m


def card(m):
    d = only_digits(m)
    if luhn(d):
        return m
    head = d[0] + permuted_digits("card", d[1:-1])
    return relaid(m, head + str(-luhn(head + "0") % 10))


def ip(m):
    a, b, c, d = map(int, m.split("."))
    x = permuted_index("ip", ((a * 256 + b) * 256 + c) * 256 + d, 1 << 32)
    return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))


def mail(m):
    h = digest("mail", m.lower())
    return f"u{h[:12]}@{h[12:20]}.invalid"


def cloud_key(m):
    return m[:4] + digest("cloud", m)[:16].upper()


def secret(v):
    whole = digest("secret", v)
    return "".join(digest("secret", whole, str(i)) for i in range((len(v) + 63) // 64))[: len(v)]


KINDS = {"mail": mail, "cloud_key": cloud_key, "iban": iban, "ip": ip, "date": date, "social": social, "phone": phone, "card": card}
EXPRESSIONS = {n: regex.compile(rf"(?:{p})", regex.ASCII) for n, p in pii.PATTERNS.items()}
ANY = regex.compile(pii.ANY, regex.ASCII)
WORD = regex.compile(rf"^{pii.SECRET_WORD}", regex.ASCII)


def pseudonym(m):
    for name, kind in KINDS.items():
        if EXPRESSIONS[name].fullmatch(m):
            return kind(m)
    return m


def replaced(m):
    word = WORD.match(m)
    if not word:
        return pseudonym(m)
    value = m[word.end() :]
    new = pseudonym(value)
    return word[0] + (secret(value) if new == value else new)


def brute(text):
    if text is None:
        return None, 0
    n = 0

    def one(m):
        nonlocal n
        new = replaced(m[0])
        n += new != m[0]
        return new

    out = ANY.sub(one, text)
    return out, n


def samples():
    r = random.Random(11)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(60):
        body = digits(15)
        good = next(c for c in "0123456789" if not luhn(body + c))
        number = "DE" + digits(2) + digits(18)
        number = f"DE{98 - mod97(number[4:] + 'DE00'):02d}{number[4:]}"
        out += [
            f"{body}{good} {body[:4]} {body[4:8]} {body[8:12]} {body[12:]}{good} {digits(16)}", f"{r.randrange(300)}.{r.randrange(256)}.0.{r.randrange(256)}",
            f"{r.randrange(1880, 2120)}-{r.randrange(1, 14):02d}-{r.randrange(1, 32):02d} {r.randrange(1, 32):02d}/{r.randrange(1, 32):02d}/{r.randrange(1900, 2100)} {r.randrange(1, 29):02d}.{r.randrange(1, 13):02d}.1999",
            f"{digits(3)}-{digits(2)}-{digits(4)}", f"+{r.randrange(1, 99)} {digits(3)} {digits(4)} {digits(2)} ({digits(3)}) {digits(3)}-{digits(4)} {digits(3)}.{digits(3)}.{digits(4)}",
            f"{number} {' '.join(number[i : i + 4] for i in range(0, 22, 4))} EUR", f"{'x' * r.randrange(1, 200)}.y{digits(3)}@mail.{'long' * 20}-host.example.org. A@b.c",
            f"token{' ' * r.randrange(9)}={' ' * r.randrange(9)}\"{prose(r.randrange(99), 1)}{digits(r.randrange(1, 300))}\" Password:{digits(14)} secret: {body}{good} apikey=short",
            f"{prose(r.randrange(99), 20)} AKIA{digits(16)} ASIA{digits(15)}Z",
        ]
    return [*out, "", None, " ", "password=abcdefghijkltoken=12345678901234", "日本 10.0.0.7 🙂", "x" * 70000 + " 10.0.0.7", "a." * 30000 + "b@c.de", "a@" + "b." * 30000 + "de"]


def test_equals_plain_python(spark):
    texts = samples()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"__found": F.lit(1), "__new": F.lit("y"), "found": F.lit(2)})
    out = pii.pseudonymised(docs, pii.key_table(spark, KEY), count_col="n")
    assert out.columns == ["doc_id", "text", "__found", "__new", "found", "n"]
    got = {r.doc_id: (r.text, r.n) for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), t
    assert pii.pseudonymised(docs.limit(0), KEY).collect() == []


def test_secrets_of_any_length_and_spacing(spark):
    texts = ["token=" + "a1" * 66, "password=hunter2hunt", "secret   =   abcdefgh12", f"{'m' * 80}@example.org", "password=short1"]
    out = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert all(a != b for a, b in zip(out[:4], texts)) and [len(x) for x in out[:3]] == [len(x) for x in texts[:3]]
    assert "a1a1" not in out[0] and "hunter" not in out[1] and "abcdefgh" not in out[2] and "mmm" not in out[3] and out[4] == texts[4]


#: Written by hand: a text, and what of it must go; the rest stays as it is.
SECRETS = [
    ("token=eyJhbGci.eyJzdWIi.SflKxwRJ end", "eyJhbGci.eyJzdWIi.SflKxwRJ"), ("password: Tr0ub4dor&3xyz9", "Tr0ub4dor&3xyz9"), ("password=p@ssw0rd!longer x", "p@ssw0rd!longer"),
    ("password=abc!defgh12", "abc!defgh12"), ("API_KEY='abcd.efgh.ijkl'.", "abcd.efgh.ijkl"), ("api-key: k3y-k3y-k3y", "k3y-k3y-k3y"), ("passwd := hunter2!hunter", "hunter2!hunter"),
    ('{"password": "two words and more", "x": 1}', "two words and more"), ("secret='no closing quote here", "") , ("password='unclosed!1 x", "unclosed!1"), ('password="short", "x": "yyyyyyyyy"', ""),
    ("a\nTOKEN = \"x!y?z.w,v;u\"\nb", "x!y?z.w,v;u"), ("password=pässwörd€uro1 ok", "pässwörd€uro1"), ("mail jürgen.größe@müller-straße.de now", "jürgen.größe@müller-straße.de"),
    ("born 1850-02-28.", "1850-02-28"), ("ends 31.12.2199", "31.12.2199"), ("year 0001-01-01", "0001-01-01"), ("no 2023-02-30 day", ""), ("0000-01-01", ""),
]


def test_hand_made_secrets(spark):
    out = pii.pseudonymised(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECRETS)], "doc_id long, text string"), KEY, count_col="n")
    for r in out.collect():
        text, gone = SECRETS[r.doc_id]
        if not gone:
            assert (r.text, r.n) == (text, 0)
            continue
        before, _, behind = text.partition(gone)
        assert r.n == 1 and r.text.startswith(before) and r.text.endswith(behind), (text, r.text)
        new = r.text[len(before) : len(r.text) - len(behind)]
        assert new != gone and (len(new) == len(gone) or "@" in gone)
        assert not any(part in r.text for part in regex.findall(r"\w{5,}", gone)), (text, r.text)


def test_a_secret_of_ten_megabytes(spark):
    text = "password=" + "aB3!x" * 2_000_000 + " end"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    frame.count()
    began = time.monotonic()
    out = pii.pseudonymised(frame, KEY).select(F.length("text"), F.substring("text", 1, 9), F.substring("text", -4, 4), F.instr("text", "aB3!x")).first()
    assert tuple(out) == (len(text), "password=", " end", 0) and time.monotonic() - began < 60


def test_rectangles_are_permutations(spark):
    for size in (150, 261 * 280, 17 * 43):
        got = spark.range(size).select(pii.permuted_index("k", "t", F.col("id"), size).alias("p"))
        assert got.distinct().count() == size and got.agg(F.max("p"), F.min("p")).first()[:] == (size - 1, 0)
    with pytest.raises(ValueError, match="prime"):
        pii.permuted_index("k", "t", F.lit(1), 13)


def test_key_shows_in_no_plan(spark, capsys):
    docs = spark.createDataFrame([(1, "10.0.0.7")], "doc_id long, text string")
    out = pii.pseudonymised(docs, "hidden-key-of-a-test")
    out.collect()
    out.explain(True)
    assert "hidden-key-of-a-test" not in capsys.readouterr().out

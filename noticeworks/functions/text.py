"""Text expressions: folding, keys, dates, word sets.  All native, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain letters, position by position (fixed values).
MARKED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčćďěňřťůąęńśźżőű"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncszccdenrtuaenszzou"

#: Query parameters that do not change a page (fixed values).
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|t|_|ts|lang|locale|sessionid|jsessionid|phpsessid|p_l_back_url)$"


def fold(text: Column) -> Column:
    """Lower case, Latin marks dropped, typographic apostrophes straightened."""
    lower = F.translate(F.lower(text), "’‘`´", "''''")
    return F.translate(lower, MARKED, PLAIN)


def commune_key(name: Column) -> Column:
    """A commune's name for comparison: folded, without what it is called besides, one blank between words."""
    bare = F.regexp_replace(fold(name), r"^\s*(comune|citta|citta metropolitana)\s+di\s+", "")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_pattern(phrases: list[str]) -> str:
    """One regular expression for whole phrases; a * after a word stands for any ending, blanks for any white space."""
    word = lambda w: _escape(w[:-1]) + r"\w*" if w.endswith("*") else _escape(w)
    parts = [r"\s+".join(word(w) for w in p.split()) for p in phrases]
    return r"(?<!\w)(?:" + "|".join(parts) + r")(?!\w)"


def _escape(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)


def first_rule(text: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first (name, pattern) that is found in text."""
    out = reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))
    return out.otherwise(F.lit(default))


def safe_date(text: Column) -> Column:
    """The date that text begins with, as yyyy-mm-dd; null if there is none, it is impossible or of year 0."""
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.when((day != "") & ~day.startswith("0000"), F.try_to_date(day, "yyyy-MM-dd"))


#: Month names (Italian, long and short) by number; fixed values.
MONTHS = {
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8, "settembre": 9,
    "ottobre": 10, "novembre": 11, "dicembre": 12, "gen": 1, "feb": 2, "mar": 3, "apr": 4, "mag": 5, "giu": 6, "lug": 7,
    "ago": 8, "set": 9, "ott": 10, "nov": 11, "dic": 12,
}
ENGLISH = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def _number_of(name: Column, months: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return F.try_element_at(table, name)


def _day(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), two(month), two(day)), "yyyy-MM-dd")


def tolerant_date(text: Column) -> Column:
    """The day meant by an ISO date or time, an e-mail date, dd/mm/yy(yy), or day month-name year; else null."""
    t = F.trim(text)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), safe_date(t))
    mail = r"^(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})\s+\d{1,2}:\d{2}"
    mail_day = _day(F.regexp_extract(t, mail, 3), _number_of(F.lower(F.regexp_extract(t, mail, 2)), ENGLISH), F.regexp_extract(t, mail, 1))
    digits = r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})\b"
    year = F.regexp_extract(t, digits, 3).try_cast("int")
    numeric = _day(F.when(year < 100, year + 2000).otherwise(year), F.regexp_extract(t, digits, 2), F.regexp_extract(t, digits, 1))
    long = r"(?iU)\b(\d{1,2})\s+([a-zà]+)\s+(\d{4})\b"
    named = _day(F.regexp_extract(t, long, 3), _number_of(F.lower(F.regexp_extract(t, long, 2)), MONTHS), F.regexp_extract(t, long, 1))
    return F.coalesce(iso, F.when(t.rlike(mail), mail_day), F.when(t.rlike(digits), numeric).otherwise(F.when(t.rlike(long), named)))


def url_key(url: Column) -> Column:
    """Address without scheme, www, default port, index page, fragment and tracking parameters; parameters sorted."""
    u = F.trim(url)
    rest = F.regexp_replace(F.regexp_replace(u, r"^https?://", ""), r"#.*$", "")
    before, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    host = F.lower(F.regexp_extract(before, r"^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(before, r"^[^/]*(/.*)$", 1), r"/+", "/")
    path = F.regexp_replace(F.regexp_replace(path, r"(?i)/(index|default)\.(html?|php|aspx?)$", "/"), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_extract(p, r"^([^=]*)", 1).rlike(TRACKING)))
    pairs = F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))))
    tail = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(u.rlike(r"^https?://"), F.concat(host, path, tail))


# Addresses of services, and those among them that are acts after all.
SERVICE, ACT = r"(?i)(\.json|\.xml|\.csv|/api/|/feed/?$|/rss)", r"(?i)/bancadati/(atti|burt)/"


def is_service_url(key: Column) -> Column:
    """Data files, feeds and programming interfaces rather than a notice's page."""
    return key.rlike(SERVICE) & ~key.rlike(ACT)


def fingerprint(title: Column, summary: Column) -> Column:
    """32 hexadecimal digits that change with title or summary."""
    return F.substring(F.sha2(F.concat(F.trim(title), F.lit("\n"), F.trim(F.coalesce(summary, F.lit("")))), 256), 1, 32)


def words(text: Column, stop: list[str] | None = None, shortest: int = 2) -> Column:
    """Distinct folded words, sorted."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    keep = F.filter(found, lambda w: (F.length(w) >= shortest) & ~w.isin(stop or [""]))
    return F.array_sort(F.array_distinct(keep))


def jaccard(a: Column, b: Column) -> Column:
    """Common share of two word sets; 0 if one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard, or 0.9 of the share of the smaller set (of 4 words at least) that is in the other, if larger."""
    small = F.least(F.size(a), F.size(b))
    inside = F.when(small >= 4, F.size(F.array_intersect(a, b)) / small).otherwise(0.0)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.greatest(jaccard(a, b), 0.9 * inside)).otherwise(0.0)


def years(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20[0-4]\d)(?!\d)"), F.lit(1))))


def editions_compatible(a: Column, b: Column) -> Column:
    """Year sets agree if one is empty or one holds the other."""
    return (F.size(a) == 0) | (F.size(b) == 0) | (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)


def masked(text: Column) -> Column:
    """Template of a message: runs of digits and slashes become N."""
    return F.regexp_replace(text, "[0-9/]+", "N")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def iso_week(ts: Column) -> Column:
    """2024-W05: ISO year and week."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def whole_months(start: Column, end: Column) -> Column:
    """Whole months from start to end, by (year, month, day)."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) - (F.dayofmonth(end) < F.dayofmonth(start)).cast("int")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to one decimal, 0 whole counting as 1."""
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), 1)


def line_changes(old: Column, new: Column) -> Column:
    """Lines of new that old does not have, in order, repeats kept."""
    before = F.split(F.coalesce(old, F.lit("")), "\n")
    return F.filter(F.split(F.coalesce(new, F.lit("")), "\n"), lambda line: ~F.array_contains(before, line) & (F.trim(line) != ""))


def contains_all_words(text: Column, query: str) -> Column:
    """Every word of query occurs in text, in any place and case."""
    return reduce(lambda a, w: a & F.lower(text).contains(w), query.lower().split(), F.lit(True))


def has_personal_data(text: Column) -> Column:
    """Tax codes, mail addresses or telephone numbers, which a company profile must not hold."""
    return text.rlike(r"\b[A-Za-z]{6}\d{2}[A-Za-z]\d{2}[A-Za-z]\d{3}[A-Za-z]\b|[\w.+-]+@[\w-]+\.[\w.]+|(?<!\d)(\+39)?\s?3\d{2}[\s.-]?\d{6,7}(?!\d)")

"""What a notice's title says, part by part: years, editions, lettered or numbered parts, places, and the words that are left.

A part that is found is taken out before the next is looked for, so "Linea A" or "secondo sportello" leave no words behind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeworks.functions.notices import ROLES
from noticeworks.functions.text import fold

# Words without weight in titles, ordinals, nouns of editions and of parts, words of authorities, words of calls.
TITLE_WORDS = (
    "il lo la i gli le un una di del dello della dei degli delle a al allo alla ai agli alle da dal dalla dai in nel nella nei nelle con su sul sulla "
    "per tra fra e ed o od che anno anni annualita n nr art s l d it www bando bandi avviso pubblico pubblicata pubblicato pubblicate approvata "
    "approvato approvate approvazione nuovo nuova"
).split()
ORDINALS = {
    "primo": 1, "prima": 1, "i": 1, "secondo": 2, "seconda": 2, "ii": 2, "terzo": 3, "terza": 3, "iii": 3,
    "quarto": 4, "quarta": 4, "iv": 4, "quinto": 5, "quinta": 5, "v": 5, "sesto": 6, "sesta": 6, "vi": 6,
}
COUNTED = "sportello|edizione|finestra|call|bando|avviso|apertura|tranche|semestre"
NUMBERED = "sportello|edizione|finestra|call|tranche|semestre"
PARTS = "linea|misura|lotto|asse|intervento|azione|n|nr|numero"
AUTHORITY_WORDS, AUTHORITY_KINDS = ["cciaa", "camera", "commercio", "regione", "comune"], ["camera", "regione", "comune", "provincia"]
CALL_WORDS = r"(?<!\w)(bando|avviso|contribut\w*|incentiv\w*|voucher|agevolazion\w*|finanziament\w*|fondo perduto|sostegno|aiut[oi])(?!\w)"

YEAR = r"(?<!\d)(20[0-4]\d)(?!\d)"
#: A number before its noun (not a digit behind a point or comma: "4.0 bando"), or a noun before its number.
BEFORE = rf"\b({'|'.join(ORDINALS)}|(?<![.,])\d)\s*(?:°|ª|o|a)?\s*({COUNTED})\b"
BEHIND = rf"\b({NUMBERED})\s+({'|'.join(ORDINALS)}|\d)\b"
EDITION = rf"{BEFORE}|{BEHIND}"
PART = rf"\b({PARTS})\.?\s+([a-z]|\d+(?:\.\d+)*)\b"


def sorted_set(items: Column) -> Column:
    return F.array_sort(F.array_distinct(items))


def title_text(title: Column) -> Column:
    """Folded, with camel case apart: "GreenTour" and "Green Tour" are one name."""
    return fold(F.regexp_replace(F.coalesce(title, F.lit("")), r"([a-z])([A-Z])", "$1 $2"))


def edition_marks(text: Column) -> Column:
    """sportello2, edizione3, ... and lineaa, n4, ... of a title's text."""
    number = F.create_map(*(F.lit(x) for pair in ORDINALS.items() for x in (pair[0], str(pair[1]))))
    plain = lambda n: F.coalesce(F.try_element_at(number, n), n)

    def edition(m: Column) -> Column:
        first = F.concat(F.regexp_extract(m, EDITION, 2), plain(F.regexp_extract(m, EDITION, 1)))
        return F.when(F.regexp_extract(m, EDITION, 1) != "", first).otherwise(F.concat(F.regexp_extract(m, EDITION, 3), plain(F.regexp_extract(m, EDITION, 4))))

    def part(m: Column) -> Column:
        noun = F.regexp_extract(m, PART, 1)
        return F.concat(F.when(noun.isin("n", "nr", "numero"), "n").otherwise(noun), F.regexp_extract(m, PART, 2))

    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.concat(F.transform(every(EDITION), edition), F.transform(every(PART), part))


def title_parts(title: Column, issuer: Column) -> Column:
    """struct(words, years, editions, places), each a sorted set.  issuer: an ``issuer_key``, whose names are places, not words."""
    text = title_text(title)
    rest = text
    for pattern in (*(p for _, p in ROLES), YEAR, EDITION, PART):
        rest = F.regexp_replace(rest, pattern, " ")
    of_issuer = F.array_except(F.split(F.coalesce(issuer, F.lit("")), " "), F.array(*map(F.lit, AUTHORITY_KINDS)))
    dull = F.array(*map(F.lit, TITLE_WORDS + AUTHORITY_WORDS))
    found = F.array_except(F.filter(F.regexp_extract_all(rest, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 1), dull)
    return F.struct(
        sorted_set(F.array_except(found, of_issuer)).alias("words"), sorted_set(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1))).alias("years"),
        sorted_set(edition_marks(text)).alias("editions"), sorted_set(F.array_intersect(found, of_issuer)).alias("places"),
    )


def describes_call(title: Column, words: Column) -> Column:
    """Whether a title says what call it speaks of, besides what it does to it: four words, and one of funding."""
    return (F.size(words) >= 4) & fold(F.coalesce(title, F.lit(""))).rlike(CALL_WORDS)

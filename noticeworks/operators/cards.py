"""Structured cards of calls: their checks, the form of their aid, and keeping links of announcements."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.functions.text import fold, url_key

# Admitted values of a card's fields, numeric fields and percentages, lists that state each constraint.
MOST_AMOUNT = 5_000_000_000
STATES = ("vincolo", "nessun_vincolo", "non_noto")
ADMITTED = {
    "seat_rule": ("legale", "operativa", "legale_o_operativa", "da_attivare"),
    "subjects": ("impresa", "libero_professionista", "aspirante_imprenditore", "ente_terzo_settore", "ente_pubblico", "persona_fisica", "altro"),
    "forms_in": ("ditta_individuale", "snc", "sas", "srl", "srls", "spa", "sapa", "societa_semplice", "cooperativa", "consorzio", "rete_imprese", "associazione_professionale", "stp", "altro"),
    "sizes": ("micro", "piccola", "media", "grande"),
    "kinds": ("fondo_perduto", "credito_imposta", "finanziamento_agevolato", "garanzia", "voucher", "servizi", "premio", "altro"),
    "regimes": ("de_minimis", "de_minimis_agricolo", "gber", "aber", "temporary_framework", "notificato", "non_aiuto", "altro"),
    "selection": ("sportello", "sportello_valutativo", "graduatoria", "click_day", "automatica", "negoziale", "altro"),
    "completeness": ("bando_ufficiale", "solo_sintesi", "nessun_documento"),
    "codes_version": ("2007", "2025", "incoerente"),
}
NUMBERS = (
    "contribution_max", "percent", "grant_max", "percent_grant", "loan_max", "budget", "spend_min", "spend_max", "staff_min", "staff_max",
    "turnover_min", "turnover_max", "age_min", "age_max", "contribution_min",
)
PERCENTS = ("percent", "percent_grant")
LISTS = {
    "territory": ("regions", "provinces", "communes"), "subjects": ("subjects",), "forms": ("forms_in", "forms_out"), "sizes": ("sizes",), "codes": ("codes_in", "codes_out"),
    "age": ("age_min", "age_max"), "requirements": ("required",), "staff": ("staff_min", "staff_max"), "turnover": ("turnover_min", "turnover_max"), "spend": ("spend_min", "spend_max"), "regime": ("regimes",),
}
HOUR = r"^([01]\d|2[0-3]):[0-5]\d$"


def card_problems(cards: DataFrame, documents: bool = False) -> Column:
    """Every failed check of a card, in words: values that are not admitted, dates, hours, amounts, percentages, amounts
    that contradict one another, constraints that are stated but not given.  Fields that cards lacks are not checked.

    documents: cards has texts_of_call, the number of documents that hold the text of a call.
    """
    have = {f.name: f.dataType.simpleString() for f in cards.schema.fields}
    out: list[Column] = []

    def when(test: Column, *words: str | Column) -> None:
        out.append(F.when(test, F.concat(*[F.lit(w) if isinstance(w, str) else w for w in words])))

    for name, values in ADMITTED.items():
        if name in have:
            mine = F.coalesce(name, F.array().cast("array<string>")) if have[name].startswith("array") else F.array_compact(F.array(name))
            bad = F.array_except(mine, F.array(*map(F.lit, values)))
            when(F.size(bad) > 0, f"{name}: not admitted: ", F.array_join(bad, ", "))
    for name in ("opens_text", "deadline_text", "closed_on_text"):
        if name in have:
            good = F.col(name).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(name, "yyyy-MM-dd").isNotNull()
            when(F.col(name).isNotNull() & ~good, f"{name}: no date")
    for name in ("opens_at", "deadline_at"):
        if name in have:
            when(~F.col(name).rlike(HOUR), f"{name}: no hour")
    if {"opens", "deadline"} <= set(have):
        when(F.col("opens") > F.col("deadline"), "opens after the deadline")
    if "deadline" in have:
        when(F.year("deadline") < 2015, "deadline too old")
    for name in NUMBERS:
        if name in have:
            off = (F.col(name) < 0) | (F.col(name) > MOST_AMOUNT)
            when(off, f"{name}: not plausible")
            if name in PERCENTS:
                when(~off & (F.col(name) > 100), f"{name}: over 100")
    if {"grant_max", "contribution_max"} <= set(have):
        when(F.col("grant_max") > F.col("contribution_max"), "grant above the contribution")
    if {"kind", "percent", "loan_max"} <= set(have):
        when((F.col("kind") == "misto") & (F.col("percent") == 100) & (F.coalesce("loan_max", F.lit(0)) != 0), "mixed aid at 100 %")
    if "constraints" in have:
        explained = F.coalesce("explained", F.array().cast("array<string>")) if "explained" in have else F.array().cast("array<string>")
        for name, fields in LISTS.items():
            state = F.try_element_at("constraints", F.lit(name))
            when(~F.coalesce(state.isin(*STATES), F.lit(False)), f"{name}: state missing")
            here = [f for f in fields if f in have]
            given = [F.coalesce(F.size(f) > 0, F.lit(False)) if have[f].startswith("array") else F.col(f).isNotNull() for f in here]
            empty = ~F.greatest(*given, F.lit(False)) if given else F.lit(True)
            words = F.coalesce("territory_text", F.lit("")) != "" if name == "territory" and "territory_text" in have else F.lit(False)
            when((state == "vincolo") & empty & ~words & ~F.array_contains(explained, name), f"{name}: stated but not given")
    if documents and "completeness" in have:
        when((F.col("completeness") == "bando_ufficiale") & (F.coalesce("texts_of_call", F.lit(0)) == 0), "official but no text of a call")
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


# --- the form of the aid ------------------------------------------------------------------------------------------------

# Names of forms in the order in which they are told, names of sizes.
FORM_NAMES = {
    "fondo_perduto": "fondo perduto", "finanziamento_agevolato": "finanziamento agevolato", "credito_imposta": "credito d'imposta", "garanzia": "garanzia", "voucher": "voucher",
    "servizi": "servizi gratuiti", "premio": "premio", "contributo_interessi": "contributo in conto interessi", "altro": "altra forma",
}
SIZE_ROWS = {"micro": "Micro imprese", "piccola": "Piccole imprese", "media": "Medie imprese", "grande": "Grandi imprese"}


def incentive_rows() -> Column:
    """array<struct<for_whom, forms array<struct<form, percent, most>>>>: what a card's fields tell of the aid; null without a kind.

    Fields: kinds, kind, base_percent, percent, percent_grant, grant_max, contribution_max, loan_max, loan_percent,
    by_size (map of size to percentage), lines (array of struct name, kinds, percent, grant_max, contribution_max).
    One row a line of the call; else one a size where percentages differ; else one for all.
    """
    order = F.array(*map(F.lit, FORM_NAMES))
    ordered = lambda kinds: F.filter(order, lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False)))
    own = ordered(F.coalesce("kinds", F.array().cast("array<string>")))
    kinds = F.when(F.size(own) > 0, own).otherwise(ordered(F.array("kind")))
    nonzero = lambda c: F.nullif(c, F.lit(0.0))
    highest = F.coalesce("percent_grant", "percent")
    percent = F.coalesce("base_percent", highest)
    most = F.coalesce(nonzero(F.col("grant_max")), F.col("contribution_max"))

    def forms(names: Column, share: Column, limit: Column) -> Column:
        only = F.size(names) == 1

        def one(k: Column) -> Column:
            loan, grant = k == "finanziamento_agevolato", k == "fondo_perduto"
            of_loan = F.when(only & share.isNotNull(), share).otherwise(F.col("loan_percent"))
            return F.struct(
                k.alias("form"), F.when(grant, share).when(loan, of_loan).when((k != "garanzia") & only, share).alias("percent"),
                F.when(grant, limit).when(loan, F.coalesce(nonzero(F.col("loan_max")), F.when(only, limit))).when(only, limit).alias("most"),
            )

        return F.transform(names, one)

    def line(x: Column) -> Column:
        of_line = ordered(F.coalesce(x["kinds"], F.array().cast("array<string>")))
        share = F.when(x["percent"].isNotNull() & ~x["percent"].eqNullSafe(highest), x["percent"]).otherwise(percent)
        limit = F.coalesce(nonzero(x["grant_max"]), nonzero(x["contribution_max"]), most)
        return F.struct(F.coalesce(F.nullif(x["name"], F.lit("")), F.lit("Linea")).alias("for_whom"), forms(F.when(F.size(of_line) > 0, of_line).otherwise(kinds), share, limit).alias("forms"))

    told = F.filter("lines", lambda x: x["percent"].isNotNull() | x["grant_max"].isNotNull() | x["contribution_max"].isNotNull())
    sizes = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in SIZE_ROWS.items()]), lambda s: F.try_element_at("by_size", s["k"]).isNotNull())
    shares = F.array_distinct(F.transform(sizes, lambda s: F.try_element_at("by_size", s["k"])))
    of_size = lambda s: F.struct(s["v"].alias("for_whom"), forms(kinds, F.try_element_at("by_size", s["k"]), most).alias("forms"))
    everyone = F.array(F.struct(F.lit("Tutti i beneficiari").alias("for_whom"), forms(kinds, percent, most).alias("forms")))
    rows = F.when(F.size(told) > 0, F.transform(told, line)).when(F.size(shares) > 1, F.transform(sizes, of_size)).otherwise(everyone)
    return F.when(F.size(kinds) > 0, rows)


def number_words(x: Column) -> Column:
    """1234567.0 -> 1.234.567"""
    return F.translate(F.format_number(x, 0), ",", ".")


def described(row: Column) -> Column:
    """A row in a phrase: fondo perduto 30% (fino a 50.000 €) + finanziamento agevolato 70%."""
    names = F.create_map(*[F.lit(x) for pair in FORM_NAMES.items() for x in pair])
    plain = lambda p: F.replace(F.regexp_replace(p.cast("string"), r"\.0+$", ""), F.lit("."), F.lit(","))
    one = lambda f: F.concat(
        F.try_element_at(names, f["form"]), F.coalesce(F.concat(F.lit(" "), plain(f["percent"]), F.lit("%")), F.lit("")),
        F.coalesce(F.concat(F.lit(" (fino a "), number_words(f["most"]), F.lit(" €)")), F.lit("")),
    )
    return F.array_join(F.transform(row["forms"], one), " + ")


# --- keeping what linking decided ---------------------------------------------------------------------------------------


def persisted(announcements: DataFrame, linked: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """What a plan of linking changes: new calls, links, open doubts, and calls that nothing refers to any more.

    announcements: id, call_id, by_hand, title; linked: id, call (null in doubt), how, doubt;
    calls: call_id, kept (never deleted).  A link made by hand stays; an announcement in doubt is not linked; a group
    with a linked announcement keeps that call, another gets a call named by its smallest announcement.
    """
    rows = announcements.join(linked, "id", "left")
    sure = rows.filter(F.col("doubt").isNull() & F.col("call").isNotNull())
    known = sure.filter("call_id IS NOT NULL").groupBy("call").agg(F.min("call_id").alias("known_id"))
    placed = sure.join(known, "call", "left").withColumn("target", F.coalesce("known_id", F.col("call")))
    links = placed.filter(~F.coalesce("by_hand", F.lit(False)) & ~F.col("call_id").eqNullSafe(F.col("target"))).select("id", F.col("target").alias("call_id"), "how")
    new = placed.filter("known_id IS NULL").groupBy(F.col("target").alias("call_id")).agg(F.min_by("title", "id").alias("title"), F.count("*").alias("n"))
    doubts = rows.filter("(doubt IS NOT NULL OR how = 'doubt') AND call_id IS NULL").select("id", F.col("doubt").alias("candidate"))
    after = rows.select("id", "call_id").join(links.select("id", F.col("call_id").alias("new_id")), "id", "left").select(F.coalesce("new_id", "call_id").alias("call_id"))
    orphans = calls.filter(~F.coalesce("kept", F.lit(False))).join(after.filter("call_id IS NOT NULL").distinct(), "call_id", "left_anti").select("call_id")
    return {"calls": new, "links": links, "doubts": doubts, "orphans": orphans}


# Words that do not tell titles apart.
TITLE_STOP = "di del della dei degli delle per a al alla e ed il lo la le i gli un una in con da su anno bando avviso contributi".split()


def letter_counts(text: Column) -> Column:
    """How often each of a-z, 0-9 and the blank stands in a text."""
    letters = F.array(*map(F.lit, "abcdefghijklmnopqrstuvwxyz0123456789 "))
    return F.transform(letters, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))


def found_elsewhere(lost: DataFrame, announcements: DataFrame, least: float = 0.72) -> DataFrame:
    """id, found, how (address, title or null), score: lost items looked up among announcements (id, url, title).

    By the address key, else by the title with the largest matching-blocks ratio among those that share a word, if that
    reaches ``least``.  Ties go to the smaller id.  The ratio is at most twice the shared letters (with their counts) over
    both lengths, and so at most twice the shorter length over both: pairs below ``least`` by lengths are not paired and
    those below it by letters not scored, which loses no answer.  A word that very many titles of one length share still
    makes as many pairs to look at.
    """
    words = lambda c: F.filter(F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: ~w.isin(*TITLE_STOP))
    a = lost.select("id", url_key(F.col("url")).alias("key"), words(F.col("title")).alias("words"))
    b = announcements.select(F.col("id").alias("other"), url_key(F.col("url")).alias("key"), words(F.col("title")).alias("words"))
    by_key = b.filter("key IS NOT NULL").groupBy("key").agg(F.min("other").alias("by_address"))
    a = a.join(by_key, "key", "left").drop("key")
    size = lambda name: F.length(F.array_join("words", " ")).alias(name)
    open_ = a.filter("by_address IS NULL").select("id", size("n_id"), F.explode(F.array_distinct("words")).alias("word"))
    near = 2 * F.least("n_id", "n_other") >= (least - 1e-9) * (F.col("n_id") + F.col("n_other"))
    pairs = open_.join(b.select("other", size("n_other"), F.explode(F.array_distinct("words")).alias("word")), "word").filter(near).select("id", "other").distinct()

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)], dtype=float)

    text = lambda df, name: df.select(name, F.array_join("words", " ").alias(f"t_{name}")).withColumn(f"l_{name}", letter_counts(F.col(f"t_{name}")))
    shared = F.aggregate(F.zip_with("l_id", "l_other", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    alike = 2 * shared >= (least - 1e-9) * (F.length("t_id") + F.length("t_other"))
    scored = pairs.join(text(a, "id"), "id").join(text(b, "other"), "other").filter(alike).withColumn("score", ratio("t_id", "t_other"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("other", "score"), F.struct("score", -F.col("other"))).alias("best")).filter(F.col("best.score") >= least)
    rows = a.select("id", "by_address").join(best, "id", "left")
    how = F.when(F.col("by_address").isNotNull(), "address").when(F.col("best").isNotNull(), "title")
    return rows.select("id", F.coalesce("by_address", "best.other").alias("found"), how.alias("how"), F.when(F.col("by_address").isNull(), F.round("best.score", 4)).alias("score"))

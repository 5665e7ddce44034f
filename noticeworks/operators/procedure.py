"""Where a call stands: situation, phase, reason, who decided and when, by one ordered list of rules.

The names of situations, phases and steps, and the wording of reasons, are fixed values.  Columns of a call: id,
merged_into, completeness, state, deadline, closed_on, has_preliminary, for_companies, benefit, recipients (array),
pre_state, edition, text_of_call, second_reading, pre_reason, pre_by, pre_at, pre_writer, grave (array), grave_at,
verified, problem, verified_reason, verified_by, second_outcome, second_at, corrected, second_grave, card_at,
card_model, documentation, documentation_reason, page_state, page_reason, page_at, attachments_at, to_update,
recheck_state, recheck_reason, state_at, updated_at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginning of the names of models whose cards count as written by a person's session.
SESSION_MODEL = "session"
PROBLEMS = ("manca", "solo_sintesi", "altro_bando", "edizione_vecchia", "bozza", "atto_generico", "graduatoria")


def chain(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    out = reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0]))
    return out if default is None else out.otherwise(default)


def step() -> Column:
    """How far a call's document and card have been checked."""
    name = F.lit
    return chain([
        (~F.coalesce("verified", F.lit("")).isin("si", "no"), name("documento_da_verificare")),
        (F.col("verified") == "no", name("da_recuperare")),
        (F.col("second_outcome").isNull() | F.col("second_at").isNull(), name("secondo_controllo_da_fare")),
        (F.col("second_at") < F.col("card_at"), name("secondo_controllo_da_fare")),
        ((F.col("second_outcome") == "grave") & (F.coalesce("corrected", F.lit("false")) != "true"), name("errori_da_correggere")),
    ], name("pronto"))


def is_grave() -> Column:
    return F.coalesce(F.size("grave") > 0, F.lit(False))


def non_profit_only() -> Column:
    """No call for companies, but an aid that non-profit bodies can ask for."""
    test = (F.col("for_companies") == "no") & (F.coalesce("benefit", F.lit("")) != "no") & F.array_contains("recipients", "non_profit")
    return F.coalesce(test, F.lit(False))


def proposable() -> Column:
    """Whether a call is proposed: card on the official text, no grave problem, every step done."""
    return F.coalesce((F.col("completeness") == "bando_ufficiale") & ~is_grave() & (step() == "pronto"), F.lit(False))


def situations(calls: DataFrame, versions: DataFrame | None = None, session_model: str = SESSION_MODEL) -> DataFrame:
    """id, situation, phase, reason, decided_by, decided_at of every call.

    versions: id, saved_at, merged_into, preliminary (text) of the rows that were replaced; they date decisions that
    carry no time of their own.  calls then needs preliminary too.
    """
    card, official = F.col("completeness").isNotNull(), F.col("completeness") == "bando_ufficiale"
    closed_pre = (F.col("edition") == "no") | (F.col("pre_state") == "chiuso")
    weak = F.col("documentation").isin("sintesi", "nessuno")
    name = F.lit
    phase_non_profit = chain([
        ((F.col("state") == "chiuso") | (~card & closed_pre), name("non_profit_chiuso")), (official, name("non_profit_con_scheda")), (card, name("non_profit_scheda_su_sintesi")),
        ((F.col("text_of_call") == "no") | weak, name("non_profit_senza_testo")),
    ], name("scheda_non_profit_in_coda"))
    phase_target = chain([
        (F.col("recipients").isNull() | F.array_contains("recipients", "da_determinare"), name("destinatari_da_determinare")),
        (F.col("benefit") == "no", name("non_agevolazione")), (card, name("dopo_la_scheda")),
    ], name("prima_della_scheda"))
    working = lambda test, phase: (test, "in_lavorazione", name(phase))
    rules = [
        (F.col("merged_into").isNotNull(), "unito", name("unito")),
        (non_profit_only(), "per_non_profit", phase_non_profit),
        (F.col("for_companies") == "no", "fuori_target", phase_target),
        (card & (F.col("state") == "chiuso"), "chiuso_con_scheda", F.when(F.col("closed_on").isNotNull(), "chiusura_anticipata").otherwise("scaduto")),
        (official & is_grave(), "nascosto_per_errori", name("problemi_gravi")),
        (official & (step() == "da_recuperare"), "in_disparte", name("documento_non_valido")),
        (official & (step() != "pronto"), "in_lavorazione", step()),
        (official, "proponibile", F.when(F.col("to_update").isNotNull(), "scheda_da_aggiornare").otherwise("scheda_pronta")),
        (card, "in_disparte", F.concat(F.lit("scheda_"), "completeness")),
        working(F.col("second_reading") == "da_fare", "seconda_lettura_in_coda"),
        (F.col("edition") == "no", "scartato_chiuso", name("edizione_passata")),
        (F.col("pre_state") == "chiuso", "scartato_chiuso", name("chiuso")),
        (F.col("text_of_call") == "no", "scartato_altro", name("senza_testo_del_bando")),
        (weak, "in_disparte", F.concat(F.lit("senza_scheda_"), "documentation")),
        working(F.col("page_state").isNull(), "pagina_da_cercare"),
        working(F.col("page_state") == "non_trovata", "pagina_non_trovata"),
        working(F.col("attachments_at").isNull(), "documenti_da_scaricare"),
        working(F.col("documentation").isNull(), "filtro_da_fare"),
        working(~F.col("has_preliminary"), "preliminare_in_coda"),
        working(F.lit(True), "scheda_in_coda"),
    ]
    both = chain([(test, F.struct(F.lit(s).alias("situation"), p.alias("phase"))) for test, s, p in rules])
    rows = calls.withColumn("at", both).withColumns({"situation": F.col("at.situation"), "phase": F.col("at.phase")}).drop("at")
    if versions is None:
        rows = rows.withColumns({"merged_at": F.lit(None).cast("timestamp"), "preliminary_at": F.lit(None).cast("timestamp")})
    else:
        old = versions.select(F.col("id").alias("v_id"), "saved_at", F.col("merged_into").alias("v_merged"), F.col("preliminary").alias("v_preliminary"))
        changed = lambda a, b: F.max(F.when(~F.col(a).eqNullSafe(F.col(b)), F.col("saved_at")))
        now = calls.select("id", "merged_into", "preliminary")
        dates = old.join(now, F.col("v_id") == F.col("id")).groupBy("id").agg(changed("v_merged", "merged_into").alias("merged_at"), changed("v_preliminary", "preliminary").alias("preliminary_at"))
        rows = rows.join(dates, "id", "left")
    return rows.select("id", "situation", "phase", reason().alias("reason"), decider(session_model).alias("decided_by"), decided_at().alias("decided_at"))


REJECTED = ("per_non_profit", "fuori_target", "scartato_chiuso", "scartato_altro")


def reason() -> Column:
    """Why a call is where it is, in words."""
    is_, phase = (lambda *names: F.col("situation").isin(*names)), (lambda *names: F.col("phase").isin(*names))
    text, some = (lambda s: F.lit(s)), (lambda c: F.nullif(c, F.lit("")))
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    more = lambda before, c: F.coalesce(F.concat(F.lit(before), c), F.lit(""))
    recipients = F.when(F.col("recipients").isNotNull(), F.replace(F.array_join("recipients", ", "), F.lit("_"), F.lit(" ")))
    target = chain([(phase("destinatari_da_determinare"), text("destinatari da determinare")), (F.col("benefit") == "no", text("non e' un'agevolazione"))],
                   F.concat(text("destinatari: "), F.coalesce(some(recipients), text("non indicati"))))
    closing = chain([(F.col("closed_on").isNotNull(), F.concat(text("chiuso il "), day("closed_on"))), (F.col("deadline").isNotNull(), F.concat(text("scaduto il "), day("deadline")))], text("chiuso"))
    again = F.when(F.col("recheck_state").isin("chiuso", "esaurito"), F.col("recheck_reason"))
    return chain([
        (is_("unito"), F.concat(text("doppione: unito al bando n. "), F.col("merged_into").cast("string"))),
        (is_("per_non_profit", "fuori_target"), F.concat(target, more(". ", some(F.col("pre_reason"))))),
        (is_("scartato_chiuso", "scartato_altro") | phase("seconda_lettura_in_coda"), F.col("pre_reason")),
        (is_("chiuso_con_scheda"), F.concat(closing, more(": ", again))),
        (is_("nascosto_per_errori"), F.array_join("grave", "; ")),
        (phase("documento_non_valido"), F.concat(text("documento non valido ("), F.coalesce("problem", text("non indicato")), text(")"), more(": ", some(F.col("verified_reason"))))),
        (phase("documento_da_verificare"), text("nessuno ha ancora verificato che il documento sia il testo ufficiale giusto")),
        (phase("secondo_controllo_da_fare"), text("scheda da controllare con il testo del bando (secondo controllo)")),
        (phase("errori_da_correggere"), F.concat(F.coalesce(F.col("second_grave").cast("string"), text("")), text(" errori gravi trovati dal secondo controllo, da correggere"))),
        (is_("proponibile"), F.col("to_update")),
        (phase("scheda_solo_sintesi"), text("scheda fatta su una sintesi: manca il testo ufficiale del bando")),
        (phase("scheda_nessun_documento"), text("scheda fatta senza documenti del bando")),
        (is_("in_disparte"), F.col("documentation_reason")),
        (phase("pagina_non_trovata"), F.col("page_reason")),
        (phase("scheda_in_coda"), F.concat(text("controllo preliminare superato: "), F.coalesce("pre_reason", text("")))),
        (phase("preliminare_in_coda"), F.col("documentation_reason")),
    ])


def decider(session_model: str) -> Column:
    """sessione, ia, regole, or null."""
    is_, phase = (lambda *names: F.col("situation").isin(*names)), (lambda *names: F.col("phase").isin(*names))
    by_session = F.coalesce(F.col("pre_reason").startswith("Ricontrollo") | F.col("pre_writer").startswith(session_model), F.col("pre_reason").startswith("Ricontrollo"), F.col("pre_writer").startswith(session_model), F.lit(False))
    return chain([
        (is_(*REJECTED) | phase("seconda_lettura_in_coda"), F.coalesce("pre_by", F.when(by_session, "sessione").otherwise("ia"))),
        (is_("chiuso_con_scheda"), F.when(F.col("recheck_state").isin("chiuso", "esaurito"), "sessione").otherwise("regole")),
        (is_("nascosto_per_errori"), F.lit("regole")),
        (phase("documento_non_valido"), F.coalesce("verified_by", F.lit("regole"))),
        (phase("documento_da_verificare", "secondo_controllo_da_fare", "errori_da_correggere"), F.lit("regole")),
        (is_("proponibile", "in_disparte") & F.col("completeness").isNotNull(), F.when(F.col("card_model").startswith(session_model), "sessione").when(F.col("card_model").isNotNull(), "ia")),
        (is_("in_disparte"), F.lit("regole")),
    ])


def decided_at() -> Column:
    is_ = lambda *names: F.col("situation").isin(*names)
    return chain([
        (is_("unito"), F.col("merged_at")),
        (is_(*REJECTED) | (F.col("phase") == "seconda_lettura_in_coda"), F.coalesce("pre_at", "preliminary_at")),
        (is_("chiuso_con_scheda"), F.col("state_at")),
        (is_("nascosto_per_errori"), F.col("grave_at")),
        (F.col("completeness").isNotNull(), F.col("card_at")),
        (is_("in_disparte"), F.col("attachments_at")),
    ], F.greatest("updated_at", "page_at", "attachments_at"))


def copied_verification(calls: DataFrame, now: Column) -> DataFrame:
    """calls with verified, problem, verified_reason, verified_by, verified_at taken over from the preliminary check.

    Further columns: pre_document (what the check says of the document), verified_at.  A verification by a person or a
    session stays; an automatic one gives way to a later check; an uncertain answer changes nothing.
    """
    answered = F.col("pre_document").isin("verificato", *PROBLEMS) & F.col("merged_into").isNull()
    later = (F.col("verified_by") == "ia") & (F.col("verified_at") < F.coalesce("pre_at", now))
    take = F.coalesce(answered & (F.col("verified").isNull() & F.col("verified_by").isNull() | later), F.lit(False))
    good = F.col("pre_document") == "verificato"
    new = {
        "verified": F.when(good, "si").otherwise("no"), "problem": F.when(~good, F.col("pre_document")), "verified_reason": F.col("pre_reason"),
        "verified_by": F.when(F.col("pre_by") == "sessione", "sessione").otherwise("ia"), "verified_at": F.coalesce("pre_at", now),
    }
    return calls.withColumn("__take", take).withColumns({n: F.when(F.col("__take"), v).otherwise(F.col(n)) for n, v in new.items()}).drop("__take")


def passes_preliminary(non_profit: bool = False) -> Column:
    """Why a card is not asked for after the preliminary check, or null where it is."""
    stop = (F.col("for_companies") == "no") & ~(non_profit_only() if non_profit else F.lit(False))
    kind = F.when(non_profit_only(), "non-profit bodies only").otherwise("neither for companies nor for non-profit bodies")
    return chain([
        (stop, kind), (F.col("edition") == "no", F.lit("past edition")), (F.col("pre_state") == "chiuso", F.lit("closed")), (F.col("text_of_call") == "no", F.lit("no text to read")),
    ])


def to_recover(situated: DataFrame, calls: DataFrame, only_eu: DataFrame, today: Column, limit: int) -> DataFrame:
    """Open calls without a verified document, others than those of EU sources only first, then by deadline: a report of ``limit`` rows."""
    rows = situated.join(calls.select("id", "state", "deadline", "verified"), "id").join(only_eu, "id", "left")
    rows = rows.filter(~F.col("state").eqNullSafe("chiuso") & (F.col("deadline").isNull() | (F.col("deadline") >= today)))
    rows = rows.filter((F.col("situation") == "in_disparte") | (F.col("situation") == "proponibile") & (F.col("verified") == "no"))
    return rows.orderBy(F.coalesce("only_eu", F.lit(False)), F.col("deadline").asc_nulls_last(), "id").limit(limit)

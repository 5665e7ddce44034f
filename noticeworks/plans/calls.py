"""Calls over the order tables: procedure and situations, offers and their orders, loading, small merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeworks.operators import health, history, offers, procedure
from noticeworks.plans.base import query
from noticeworks.streaming import visits


def literal(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


DIVISORS = (1, 2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97)


def drawn(number: str, spec: dict[str, list]) -> dict[str, Column]:
    """Made-up columns: name -> one of some values, by a number."""
    out = {}
    for (name, values), d in zip(spec.items(), DIVISORS, strict=False):
        mixed = F.floor(F.pmod(F.col(number) * 7919, F.lit(100_003)) / d)
        out[name] = F.element_at(F.array(*map(F.lit, values)), (mixed % len(values) + 1).cast("int"))
    return out


def drawn_sql(number: str, spec: dict[str, list]) -> str:
    """The same columns as SQL."""
    one = lambda name, values, d: f"[{', '.join(map(literal, values))}][CAST(({number} * 7919 % 100003 // {d}) % {len(values)} AS INTEGER) + 1] AS {name}"
    return ", ".join(one(name, values, d) for (name, values), d in zip(spec.items(), DIVISORS, strict=False))


PROCEDURE = {
    "dup": [0] * 9 + [1], "for_companies": ["si", "si", "no", "incerto", None], "benefit": [None, "si", "no"],
    "listed": [None, "imprese", "non_profit", "non_profit,enti_pubblici", "da_determinare", "persone_fisiche", ""], "state": ["aperto", "chiuso", None, "in_arrivo"],
    "completeness": ["bando_ufficiale", "bando_ufficiale", "solo_sintesi", "nessun_documento", None, None, None, None], "graves": [0, 0, 0, 0, 1, 2], "early": [0, 0, 1],
    "verified": ["si", "si", "no", None, "incerto"], "problem": ["bozza", "manca", None], "second_outcome": ["ok", "ok", "grave", None], "second_day": [None, 1, 5, 9],
    "card_day": [None, 3, 6], "corrected": ["true", "false", None], "to_update": [None, None, "faq"], "second_reading": [None, None, None, "da_fare"], "edition": ["si", None, "si", "no"],
    "pre_state": ["aperto", None, "aperto", "chiuso"], "text_of_call": ["si", None, "si", "no"], "documentation": [None, "bando", "bando", "sintesi", "nessuno"],
    "page_state": ["trovata", "trovata", None, "non_trovata"], "searched": [1, 1, 0], "pre": [1, 1, 0], "pre_reason": ["motivo", "Ricontrollo di ottobre", None, ""],
    "recheck_state": [None, "esaurito", "aperto"], "card_model": [None, "session-1", "model-2"],
}
PROCEDURE_SQL = drawn_sql("o_orderkey", PROCEDURE)


def procedure_calls(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), *[c.alias(n) for n, c in drawn("o_orderkey", PROCEDURE).items()])
    after = lambda n: F.when(F.col(n).isNotNull(), F.date_add("day", F.col(n)).cast("timestamp"))
    none = F.lit(None).cast("string")
    graves = F.when(F.col("graves") > 0, F.transform(F.sequence(F.lit(1), F.col("graves")), lambda i: F.concat(F.lit("problem "), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumns({
        "id": F.col("o_orderkey"), "merged_into": F.when(F.col("dup") == 1, F.col("o_orderkey") + 1), "deadline": F.when(F.col("o_orderkey") % 3 > 0, F.date_add("day", 60)),
        "closed_on": F.when(F.col("early") == 1, F.date_add("day", 30)), "recipients": F.when(F.col("listed") == "", F.array().cast("array<string>")).otherwise(F.split("listed", ",")),
        "has_preliminary": F.col("pre") == 1, "pre_by": F.when(F.col("o_orderkey") % 5 == 0, "sessione"), "pre_at": F.when(F.col("o_orderkey") % 4 == 0, F.date_add("day", 2).cast("timestamp")),
        "pre_writer": none, "grave": graves, "grave_at": F.date_add("day", 4).cast("timestamp"), "verified_reason": F.col("pre_reason"), "verified_by": F.when(F.col("o_orderkey") % 6 == 0, "ia"),
        "second_at": after("second_day"), "card_at": after("card_day"), "second_grave": F.when(F.col("o_orderkey") % 2 == 0, F.col("graves")), "documentation_reason": F.concat(F.lit("d"), F.col("documentation")),
        "page_reason": F.lit("no page"), "page_at": F.date_add("day", 8).cast("timestamp"), "attachments_at": F.when(F.col("searched") == 1, F.date_add("day", 7).cast("timestamp")),
        "recheck_reason": F.concat(F.lit("r "), F.col("recheck_state")), "state_at": F.date_add("day", 70).cast("timestamp"), "updated_at": F.date_add("day", 5).cast("timestamp"),
        "preliminary": F.concat_ws("/", "for_companies", "pre_reason"),
    })


def procedure_versions(lineitem: DataFrame) -> DataFrame:
    """Rows that were replaced: the first lines of an order, some as they are now, some otherwise."""
    k = F.col("l_orderkey")
    spark = {n: c for n, c in drawn("l_orderkey", PROCEDURE).items() if n in ("dup", "for_companies", "pre_reason")}
    rows = lineitem.filter("l_linenumber <= 3").select("l_orderkey", "l_linenumber", "l_shipdate", *[c.alias(n) for n, c in spark.items()])
    line = F.col("l_linenumber")
    return rows.select(
        k.alias("id"), F.col("l_shipdate").cast("timestamp").alias("saved_at"), F.when((F.col("dup") == 1) & (line == 2), k + 1).alias("merged_into"),
        F.when(line == 1, "otherwise").otherwise(F.concat_ws("/", "for_companies", "pre_reason")).alias("preliminary"),
    )


STEP_SQL = """CASE WHEN verified IS NULL OR verified NOT IN ('si', 'no') THEN 'documento_da_verificare' WHEN verified = 'no' THEN 'da_recuperare'
        WHEN second_outcome IS NULL OR second_at IS NULL OR second_at < card_at THEN 'secondo_controllo_da_fare'
        WHEN second_outcome = 'grave' AND corrected IS DISTINCT FROM 'true' THEN 'errori_da_correggere' ELSE 'pronto' END"""
CALLS_SQL = f"""raw AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {PROCEDURE_SQL} FROM orders),
    c AS (SELECT *, CASE WHEN listed = '' THEN [] ELSE string_split(listed, ',') END AS recipients, CAST(day + CAST(second_day AS INTEGER) AS TIMESTAMP) AS second_at, CAST(day + CAST(card_day AS INTEGER) AS TIMESTAMP) AS card_at,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(day + 2 AS TIMESTAMP) END AS pre_at, CASE WHEN searched = 1 THEN CAST(day + 7 AS TIMESTAMP) END AS attachments_at FROM raw),
    p AS (SELECT *, {STEP_SQL} AS step, coalesce(for_companies = 'no' AND benefit IS DISTINCT FROM 'no' AND list_contains(recipients, 'non_profit'), false) AS np,
        completeness IS NOT NULL AS card, coalesce(completeness = 'bando_ufficiale', false) AS official FROM c)"""
SITUATION_SQL = f"""{CALLS_SQL},
    s AS (SELECT *, CASE WHEN dup = 1 THEN 'unito/unito'
        WHEN np THEN 'per_non_profit/' || CASE WHEN state = 'chiuso' OR (NOT card AND (edition = 'no' OR pre_state = 'chiuso')) THEN 'non_profit_chiuso' WHEN official THEN 'non_profit_con_scheda' WHEN card THEN 'non_profit_scheda_su_sintesi'
            WHEN text_of_call = 'no' OR documentation IN ('sintesi', 'nessuno') THEN 'non_profit_senza_testo' ELSE 'scheda_non_profit_in_coda' END
        WHEN for_companies = 'no' THEN 'fuori_target/' || CASE WHEN recipients IS NULL OR list_contains(recipients, 'da_determinare') THEN 'destinatari_da_determinare' WHEN benefit = 'no' THEN 'non_agevolazione'
            WHEN card THEN 'dopo_la_scheda' ELSE 'prima_della_scheda' END
        WHEN card AND state = 'chiuso' THEN 'chiuso_con_scheda/' || CASE WHEN early = 1 THEN 'chiusura_anticipata' ELSE 'scaduto' END
        WHEN official THEN CASE WHEN graves > 0 THEN 'nascosto_per_errori/problemi_gravi' WHEN step = 'da_recuperare' THEN 'in_disparte/documento_non_valido' WHEN step <> 'pronto' THEN 'in_lavorazione/' || step
            WHEN to_update IS NULL THEN 'proponibile/scheda_pronta' ELSE 'proponibile/scheda_da_aggiornare' END
        WHEN card THEN 'in_disparte/scheda_' || completeness
        ELSE CASE WHEN second_reading = 'da_fare' THEN 'in_lavorazione/seconda_lettura_in_coda' WHEN edition = 'no' THEN 'scartato_chiuso/edizione_passata' WHEN pre_state = 'chiuso' THEN 'scartato_chiuso/chiuso'
            WHEN text_of_call = 'no' THEN 'scartato_altro/senza_testo_del_bando' WHEN documentation IN ('sintesi', 'nessuno') THEN 'in_disparte/senza_scheda_' || documentation
            WHEN page_state IS NULL THEN 'in_lavorazione/pagina_da_cercare' WHEN page_state = 'non_trovata' THEN 'in_lavorazione/pagina_non_trovata' WHEN searched = 0 THEN 'in_lavorazione/documenti_da_scaricare'
            WHEN documentation IS NULL THEN 'in_lavorazione/filtro_da_fare' WHEN pre = 0 THEN 'in_lavorazione/preliminare_in_coda' ELSE 'in_lavorazione/scheda_in_coda' END END AS both_ FROM p),
    t AS (SELECT *, split_part(both_, '/', 1) AS situation, split_part(both_, '/', 2) AS phase FROM s),
    v AS (SELECT l.l_orderkey AS vid, max(CASE WHEN (CASE WHEN dup = 1 AND l_linenumber = 2 THEN l_orderkey + 1 END) IS DISTINCT FROM (CASE WHEN dup = 1 THEN l_orderkey + 1 END) THEN l_shipdate END) AS merged_at,
        max(CASE WHEN l_linenumber = 1 AND concat_ws('/', for_companies, pre_reason) <> 'otherwise' THEN l_shipdate END) AS prelim_at FROM lineitem l JOIN c ON c.o_orderkey = l.l_orderkey WHERE l_linenumber <= 3 GROUP BY 1)"""


@query(f"""WITH {SITUATION_SQL} SELECT o_orderkey AS id, situation, phase,
    CASE WHEN situation = 'unito' THEN 'doppione: unito al bando n. ' || (o_orderkey + 1)
        WHEN situation IN ('per_non_profit', 'fuori_target') THEN CASE WHEN phase = 'destinatari_da_determinare' THEN 'destinatari da determinare' WHEN benefit = 'no' THEN 'non e'' un''agevolazione'
            ELSE 'destinatari: ' || coalesce(nullif(replace(array_to_string(recipients, ', '), '_', ' '), ''), 'non indicati') END || coalesce('. ' || nullif(pre_reason, ''), '')
        WHEN situation IN ('scartato_chiuso', 'scartato_altro') OR phase = 'seconda_lettura_in_coda' THEN pre_reason
        WHEN situation = 'chiuso_con_scheda' THEN CASE WHEN early = 1 THEN 'chiuso il ' || strftime(day + 30, '%d/%m/%Y') WHEN o_orderkey % 3 > 0 THEN 'scaduto il ' || strftime(day + 60, '%d/%m/%Y') ELSE 'chiuso' END
            || CASE WHEN recheck_state = 'esaurito' THEN ': r esaurito' ELSE '' END
        WHEN situation = 'nascosto_per_errori' THEN CASE graves WHEN 1 THEN 'problem 1' ELSE 'problem 1; problem 2' END
        WHEN phase = 'documento_non_valido' THEN 'documento non valido (' || coalesce(problem, 'non indicato') || ')' || coalesce(': ' || nullif(pre_reason, ''), '')
        WHEN phase = 'documento_da_verificare' THEN 'nessuno ha ancora verificato che il documento sia il testo ufficiale giusto'
        WHEN phase = 'secondo_controllo_da_fare' THEN 'scheda da controllare con il testo del bando (secondo controllo)'
        WHEN phase = 'errori_da_correggere' THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(graves AS VARCHAR) ELSE '' END || ' errori gravi trovati dal secondo controllo, da correggere'
        WHEN situation = 'proponibile' THEN to_update WHEN phase = 'scheda_solo_sintesi' THEN 'scheda fatta su una sintesi: manca il testo ufficiale del bando'
        WHEN phase = 'scheda_nessun_documento' THEN 'scheda fatta senza documenti del bando' WHEN situation = 'in_disparte' OR phase = 'preliminare_in_coda' THEN 'd' || documentation
        WHEN phase = 'pagina_non_trovata' THEN 'no page' WHEN phase = 'scheda_in_coda' THEN 'controllo preliminare superato: ' || coalesce(pre_reason, '') END AS reason,
    CASE WHEN situation IN ('per_non_profit', 'fuori_target', 'scartato_chiuso', 'scartato_altro') OR phase = 'seconda_lettura_in_coda'
            THEN CASE WHEN o_orderkey % 5 = 0 OR starts_with(pre_reason, 'Ricontrollo') THEN 'sessione' ELSE 'ia' END
        WHEN situation = 'chiuso_con_scheda' THEN CASE WHEN recheck_state = 'esaurito' THEN 'sessione' ELSE 'regole' END WHEN situation = 'nascosto_per_errori' THEN 'regole'
        WHEN phase = 'documento_non_valido' THEN CASE WHEN o_orderkey % 6 = 0 THEN 'ia' ELSE 'regole' END WHEN phase IN ('documento_da_verificare', 'secondo_controllo_da_fare', 'errori_da_correggere') THEN 'regole'
        WHEN situation IN ('proponibile', 'in_disparte') AND card THEN CASE card_model WHEN 'session-1' THEN 'sessione' WHEN 'model-2' THEN 'ia' END WHEN situation = 'in_disparte' THEN 'regole' END AS decided_by,
    CASE WHEN situation = 'unito' THEN merged_at WHEN situation IN ('per_non_profit', 'fuori_target', 'scartato_chiuso', 'scartato_altro') OR phase = 'seconda_lettura_in_coda' THEN coalesce(pre_at, prelim_at)
        WHEN situation = 'chiuso_con_scheda' THEN CAST(day + 70 AS TIMESTAMP) WHEN situation = 'nascosto_per_errori' THEN CAST(day + 4 AS TIMESTAMP) WHEN card THEN card_at
        WHEN situation = 'in_disparte' THEN attachments_at ELSE CAST(day + 8 AS TIMESTAMP) END AS decided_at
    FROM t LEFT JOIN v ON vid = o_orderkey""")
def call_situations(t) -> DataFrame:
    """Ten situations and 33 phases, with reason, decider and time."""
    return procedure.situations(procedure_calls(t("orders")), procedure_versions(t("lineitem")))


@query(f"WITH {SITUATION_SQL} SELECT situation, phase, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2")
def situation_counts(t) -> DataFrame:
    return procedure.situations(procedure_calls(t("orders"))).groupBy("situation", "phase").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS_SQL} SELECT o_orderkey AS id, step, official AND graves = 0 AND step = 'pronto' AS proposable,
    CASE WHEN for_companies = 'no' THEN CASE WHEN np THEN 'non-profit bodies only' ELSE 'neither for companies nor for non-profit bodies' END WHEN edition = 'no' THEN 'past edition' WHEN pre_state = 'chiuso' THEN 'closed'
        WHEN text_of_call = 'no' THEN 'no text to read' END AS stopped FROM p""")
def procedure_steps(t) -> DataFrame:
    """How far each call is checked, whether it is proposed, and why its preliminary check stopped it."""
    rows = procedure_calls(t("orders"))
    return rows.select("id", procedure.step().alias("step"), procedure.proposable().alias("proposable"), procedure.passes_preliminary().alias("stopped"))


@query("""WITH d AS (SELECT o_orderkey AS k, ['verificato', 'bozza', 'incerto', 'manca'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS doc, o_orderkey % 7 = 0 AS dup,
        CASE o_orderkey % 5 WHEN 0 THEN 'ia' WHEN 1 THEN 'sessione' END AS by_, o_orderkey % 3 = 0 AS later FROM orders),
    e AS (SELECT *, doc <> 'incerto' AND NOT dup AND (by_ IS NULL OR (by_ = 'ia' AND later)) AS take FROM d)
    SELECT k AS id, CASE WHEN take THEN CASE doc WHEN 'verificato' THEN 'si' ELSE 'no' END WHEN by_ IS NOT NULL THEN 'si' END AS verified, CASE WHEN take AND doc <> 'verificato' THEN doc END AS problem,
        CASE WHEN take THEN 'ia' ELSE by_ END AS verified_by FROM e""")
def copied_verification(t) -> DataFrame:
    """Answers of the preliminary check taken over, persons' decisions kept."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    by = F.when(k % 5 == 0, "ia").when(k % 5 == 1, "sessione")
    day = F.lit("2001-01-10").cast("timestamp")
    rows = t("orders").select(
        k.alias("id"), F.element_at(F.array(*map(F.lit, ("verificato", "bozza", "incerto", "manca"))), (k % 4 + 1).cast("int")).alias("pre_document"), F.when(k % 7 == 0, k).alias("merged_into"), by.alias("verified_by"),
        F.when(by.isNotNull(), "si").alias("verified"), none.alias("problem"), none.alias("verified_reason"), F.when(by.isNotNull(), day).alias("verified_at"),
        F.when(k % 3 == 0, F.lit("2001-01-11").cast("timestamp")).otherwise(F.lit("2001-01-09").cast("timestamp")).alias("pre_at"), none.alias("pre_reason"), none.alias("pre_by"),
    )
    return procedure.copied_verification(rows, F.lit("2001-02-01").cast("timestamp")).select("id", "verified", "problem", "verified_by")


# --- offers ------------------------------------------------------------------------------------------------------

OFFERS = {
    "kinds_text": ["fondo_perduto", "credito_imposta", "garanzia,finanziamento_agevolato", "servizi", "servizi,altro", "misto", "voucher,garanzia", "", None], "kind": [None, None, "premio", "altro", "garanzia", ""],
    "grant_max": [None, None, 0, 5000, 20000], "contribution_max": [None, 0, 7000, 9000], "percent": [None, 0, 40, 50], "percent_grant": [None, None, 30, 60], "days": [None, -3, 0, 9, 15, 16, 40],
    "level": ["compatible", "to_verify", "to_verify", "excluded"], "zone": [0, 0, 1], "doubt_1": ["age unknown", "activity code missing", "territory unknown, call of another region", "no site"],
    "doubt_2": [None, "subjects in words", "activities unknown"], "interests": [0, 1, 2], "favour": [None, "site in territory", "bonus requirement"], "card_days": [None, 2, 6, 7, 30],
}
OFFERS_SQL = drawn_sql("p_partkey", OFFERS)
TODAY = "2001-08-02"


def made_offers(part: DataFrame) -> DataFrame:
    rows = part.select("p_partkey", "p_brand", *[c.alias(n) for n, c in drawn("p_partkey", OFFERS).items()])
    today, none = F.lit(TODAY).cast("date"), F.array().cast("array<string>")
    return rows.withColumns({
        "kinds": F.when(F.col("kinds_text") == "", none).otherwise(F.split("kinds_text", ",")), "deadline": F.when(F.col("days").isNotNull(), F.date_add(today, F.col("days"))), "out_of_zone": F.col("zone") == 1,
        "doubts": F.when(F.col("level") == "to_verify", F.array_compact(F.array("doubt_1", "doubt_2"))).otherwise(none), "favours": F.array_compact(F.array("favour")),
        "heavy_doubts": F.when(F.col("level") == "to_verify", F.when(F.col("doubt_1") == "age unknown", 0).otherwise(1) + F.when(F.col("doubt_2").isNull(), 0).otherwise(1)).otherwise(0),
        "card_on": F.when(F.col("card_days").isNotNull(), F.date_sub(today, F.col("card_days"))),
    })


OFFER_SQL = f"""o AS (SELECT p_partkey, p_brand, {OFFERS_SQL} FROM part),
    k AS (SELECT *, coalesce(CASE WHEN kinds_text = '' THEN [] ELSE string_split(kinds_text, ',') END, []) AS ks, DATE '{TODAY}' + CAST(days AS INTEGER) AS deadline, nullif(kind, '') AS one, zone = 1 AS oz,
        CASE WHEN level = 'to_verify' THEN list_filter([doubt_1, doubt_2], lambda x: x IS NOT NULL) ELSE [] END AS ds FROM o),
    n AS (SELECT *, coalesce(grant_max, 0) <> 0 OR list_has_any(ks, ['fondo_perduto', 'voucher', 'premio']) OR coalesce(one IN ('fondo_perduto', 'voucher', 'premio'), false) AS fp,
        CASE WHEN one IS NULL THEN ks ELSE list_append(ks, one) END AS al, CASE WHEN len(ks) > 0 THEN ks WHEN one IS NOT NULL THEN [one] ELSE [] END AS own FROM k),
    m AS (SELECT *, len(own) > 0 AND len(list_filter(own, lambda x: x NOT IN ('servizi', 'altro'))) = 0 AND NOT fp AS sp,
        CASE WHEN coalesce(grant_max, 0) <> 0 THEN grant_max WHEN coalesce(contribution_max, 0) <> 0 AND (fp OR list_has_any(al, ['credito_imposta', 'misto'])) THEN contribution_max END AS benefit FROM n),
    r AS (SELECT *, CASE WHEN sp THEN 5 WHEN fp THEN 0 ELSE coalesce(list_min(list_transform(al, lambda x: CASE x WHEN 'credito_imposta' THEN 1 WHEN 'finanziamento_agevolato' THEN 2 WHEN 'garanzia' THEN 3 ELSE 4 END)), 4) END AS kr,
        CASE level WHEN 'compatible' THEN 0 WHEN 'to_verify' THEN 1 ELSE 2 END AS lv, len(ds) AS nd, len(list_filter(ds, lambda x: x <> 'age unknown')) AS hd,
        CASE WHEN coalesce(grant_max, 0) <> 0 THEN grant_max WHEN fp AND coalesce(contribution_max, 0) <> 0 THEN contribution_max ELSE 0 END AS amt,
        CASE WHEN fp THEN coalesce(nullif(percent_grant, 0), nullif(percent, 0), 0) ELSE 0 END AS pct, CASE WHEN level = 'compatible' THEN 0 WHEN oz THEN 2 ELSE 1 END AS gp FROM m)"""
RELEVANCE_SQL = "lv, oz, hd, nd, interests DESC, deadline NULLS LAST, p_partkey"


def places(keys: dict[str, str]) -> str:
    return ", ".join(f"CAST(row_number() OVER (PARTITION BY p_brand ORDER BY {order}) AS INTEGER) AS {name}" for name, order in keys.items())


@query(f"""WITH {OFFER_SQL} SELECT p_partkey, {places({
    "by_relevance": RELEVANCE_SQL, "by_deadline": f"deadline NULLS LAST, {RELEVANCE_SQL}", "by_benefit": f"benefit DESC NULLS LAST, {RELEVANCE_SQL}", "by_kind": f"kr, {RELEVANCE_SQL}",
    "grants_first": f"lv, sp, fp DESC, {RELEVANCE_SQL}", "my_calls": f"gp, sp, fp DESC, deadline NULLS LAST, {RELEVANCE_SQL}",
    "proposals": f"level <> 'compatible', oz, fp DESC, amt DESC, pct DESC, deadline NULLS LAST, {RELEVANCE_SQL}"})} FROM r""")
def offer_orders(t) -> DataFrame:
    """Every order of the same offers, each brand being one company's list."""
    keys = {f"by_{c}": offers.ordered_by(c, "p_partkey") for c in ("relevance", "deadline", "benefit", "kind")}
    keys |= {"grants_first": offers.non_repayable_first("p_partkey"), "my_calls": offers.my_calls_order("p_partkey"), "proposals": offers.proposal_order("p_partkey")}
    place = {n: F.row_number().over(Window.partitionBy("p_brand").orderBy(*k)) for n, k in keys.items()}
    return made_offers(t("part")).select("p_partkey", *[c.alias(n) for n, c in place.items()])


@query(f"WITH {OFFER_SQL} SELECT p_partkey, CAST(benefit AS INTEGER) AS benefit, CAST(kr AS INTEGER) AS kind_rank, fp AS non_repayable, sp AS second_rank, coalesce(days BETWEEN 0 AND 15, false) AS closing FROM r")
def offer_values(t) -> DataFrame:
    return made_offers(t("part")).select(
        "p_partkey", offers.benefit().alias("benefit"), offers.kind_rank().alias("kind_rank"), offers.non_repayable().alias("non_repayable"), offers.second_rank().alias("second_rank"),
        offers.within_days(F.col("deadline"), F.lit(TODAY).cast("date"), 15).alias("closing"),
    )


PLAIN_SQL = """CASE x WHEN 'age unknown' THEN 'check the company''s age' WHEN 'activity code missing' THEN 'give the activity code: it tells whether your sector is admitted' WHEN 'no site' THEN 'give the company''s site'
    WHEN 'subjects in words' THEN 'check whether you are among the beneficiaries' WHEN 'activities unknown' THEN 'check the activity code' ELSE x END"""


@query(f"""WITH {OFFER_SQL}, w AS (SELECT *, list_transform(ds, lambda x: {PLAIN_SQL}) AS ps FROM r)
    SELECT p_partkey, CASE gp WHEN 0 THEN 'suitable' WHEN 1 THEN 'to_weigh' ELSE 'elsewhere' END AS "group", CAST(days AS INTEGER) AS days_left, coalesce(days BETWEEN 0 AND 15, false) AS soon, coalesce(card_days < 7, false) AS new,
        array_to_string(ps, '; ') AS plain_doubts, CASE WHEN level = 'compatible' THEN CASE WHEN favour = 'site in territory' THEN 'requirements met: site in territory' ELSE 'nothing excludes the company' END
            ELSE coalesce(ps[1], 'to be checked in the official call') END AS why FROM w WHERE level <> 'excluded'""")
def company_view(t) -> DataFrame:
    rows = made_offers(t("part")).filter(F.col("level") != "excluded")
    view = offers.company_view(rows, F.lit(TODAY).cast("date"))
    return view.select("p_partkey", "group", "days_left", "soon", "new", F.array_join("plain_doubts", "; ").alias("plain_doubts"), "why")


@query(f"""WITH {OFFER_SQL} SELECT p_brand, CAST(count(*) FILTER (WHERE gp = 0) AS BIGINT) AS suitable, CAST(count(*) FILTER (WHERE gp = 1) AS BIGINT) AS to_weigh, CAST(count(*) FILTER (WHERE gp = 2) AS BIGINT) AS elsewhere,
    CAST(count(*) FILTER (WHERE days BETWEEN 0 AND 15) AS BIGINT) AS soon, CAST(count(*) FILTER (WHERE card_days < 7) AS BIGINT) AS new FROM r WHERE level <> 'excluded' GROUP BY 1""")
def company_counts(t) -> DataFrame:
    rows = made_offers(t("part")).filter(F.col("level") != "excluded")
    return offers.view_counts(offers.company_view(rows, F.lit(TODAY).cast("date")), "p_brand")


@query("""WITH a AS (SELECT l_orderkey AS c, CAST(l_suppkey % 9 AS INTEGER) AS s FROM lineitem),
    f AS (SELECT c, s, ['ue', 'nazionale', 'regione', 'camera'][s % 4 + 1] AS level, ['LOM', 'ITA', 'PIE'][s % 3 + 1] AS territory FROM a),
    g AS (SELECT c, list_sort(list_distinct(list(level) FILTER (WHERE s NOT IN (1, 2)))) AS own, list_sort(list_distinct(list(level))) AS any_, list_sort(list_distinct(list(territory))) AS ts FROM f GROUP BY 1)
    SELECT o_orderkey AS call_id, coalesce(array_to_string(CASE WHEN len(own) > 0 THEN own ELSE any_ END, ','), '') AS levels, coalesce(array_to_string(list_filter(ts, lambda x: x <> 'ITA'), ','), '') AS regions
    FROM orders LEFT JOIN g ON c = o_orderkey WHERE o_orderkey % 10 <> 3""")
def loaded_calls(t) -> DataFrame:
    """Calls with the levels and regions of their sources, aggregators counting only where there is no other."""
    calls = t("orders").select(F.col("o_orderkey").alias("call_id"), F.when(F.col("o_orderkey") % 10 == 3, F.col("o_orderkey")).alias("merged_into"))
    announcements = t("lineitem").select(F.col("l_orderkey").alias("call_id"), (F.col("l_suppkey") % 9).cast("string").alias("source_id"))
    names = [(str(s), ("ue", "nazionale", "regione", "camera")[s % 4], ("LOM", "ITA", "PIE")[s % 3]) for s in range(9)]
    sources = calls.sparkSession.createDataFrame(names, "source_id string, level string, territory string")
    rows = offers.with_sources(calls, announcements, sources, ["1", "2"], ["LOM", "PIE"])
    return rows.select("call_id", F.array_join("levels", ",").alias("levels"), F.array_join("source_regions", ",").alias("regions"))


@query("""SELECT l_orderkey, '[' || string_agg('{"nome":"' || l_shipmode_ || '","categoria":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey) || ']' AS documents
    FROM (SELECT *, 'd' || l_linenumber AS l_shipmode_ FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1""")
def documents_json(t) -> DataFrame:
    """An ordered JSON list of objects a group."""
    rows = t("lineitem").filter("l_linestatus = 'F'")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.struct(F.concat(F.lit("d"), F.col("l_linenumber").cast("string")).alias("nome"), F.col("l_returnflag").alias("categoria")).alias("o"))
    return rows.groupBy("l_orderkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["o"])).alias("documents"))


@query("""WITH j AS (SELECT event_id, '[{"categoria":"' || event_type || '"},{"categoria":"k' || (event_id % 5) || '"}]' AS problems FROM events)
    SELECT event_id FROM j WHERE json_contains(problems, '{"categoria":"error"}') OR json_contains(problems, '{"categoria":"k3"}')""")
def json_containment(t) -> DataFrame:
    """Rows whose JSON list holds an object with a given field."""
    k = F.concat(F.lit("k"), (F.col("event_id") % 5).cast("string"))
    rows = t("events").withColumn("problems", F.to_json(F.array(F.struct(F.col("event_type").alias("categoria")), F.struct(k.alias("categoria")))))
    held = F.from_json("problems", "array<struct<categoria:string>>")
    return rows.filter(F.exists(held, lambda p: p["categoria"].isin("error", "k3"))).select("event_id")


# --- visitors, merges, queues -------------------------------------------------------------------------------------

# agents and what they are, one a row: named apart from the table that tells them
KNOWN_AGENTS = (
    [(a, "ai") for a in "OAI-SearchBot ChatGPT-User GPTBot Claude-SearchBot Claude-User ClaudeBot Claude-Web anthropic-ai Perplexity-User PerplexityBot Google-Extended GoogleOther Gemini-Deep-Research Google-NotebookLM "
     "Applebot-Extended Meta-ExternalAgent Meta-ExternalFetcher CCBot Bytespider Amazonbot MistralAI-User DuckAssistBot cohere-ai YouBot Diffbot Timpibot DeepSeekBot AI2Bot Omgili".split()]
    + [(a, "search") for a in "Googlebot Google-InspectionTool Storebot-Google AdsBot-Google Google-Site-Verification Bingbot BingPreview msnbot AdIdxBot Applebot DuckDuckBot YandexBot Baiduspider Qwantbot SeznamBot "
       "PetalBot MojeekBot Yeti Sogou".split()]
    + [(a, "other") for a in "facebookexternalhit LinkedInBot Twitterbot Slackbot WhatsApp TelegramBot Discordbot AhrefsBot SemrushBot MJ12bot DotBot DataForSeoBot okhttp axios Go-http-client libwww-perl UptimeRobot node-fetch httpx "
       "python-requests Scrapy HeadlessChrome".split()]
    + [("Screaming Frog", "other"), ("curl/8", "other"), ("Java/17", "other"), ("Firefox", "person"), ("Safari", "person")]
)
REFERRERS = [
    ("https://chatgpt.com/c/1", "ai"), ("https://www.kagi.com/search", "ai"), ("https://eu.perplexity.ai/", "ai"), ("https://www.google.it/x", "search"), ("https://it.search.yahoo.com", "search"),
    ("android-app://com.google.android.googlequicksearchbox/", "search"), ("https://l.facebook.com/", "social"), ("https://lnkd.in/x", "social"), ("https://own.example/a", "internal"), ("https://m.x.com/a", "social"), ("http://news.example", "other"), ("", "direct"),
]


@query(f"""WITH a AS (SELECT unnest([{', '.join(f"{{'agent': '{a}', 'kind': '{k}'}}" for a, k in KNOWN_AGENTS)}]) AS x), n AS (SELECT x.agent, x.kind, row_number() OVER () - 1 AS i FROM a),
    r AS (SELECT unnest([{', '.join(f"{{'url': '{u}', 'grp': '{g}'}}" for u, g in REFERRERS)}]) AS x), q AS (SELECT x.url, x.grp, row_number() OVER () - 1 AS i FROM r)
    SELECT event_id, n.kind, q.grp AS came_from FROM events JOIN n ON n.i = event_id % {len(KNOWN_AGENTS)} JOIN q ON q.i = event_id % {len(REFERRERS)}""")
def visitor_agents(t) -> DataFrame:
    """Every known program and kind of referrer."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % len(values) + 1).cast("int"))
    agent = F.concat(F.lit("Mozilla/5.0 (compatible; "), pick([a for a, _ in KNOWN_AGENTS]), F.lit(")"))
    domain = visits.referrer_domain(pick([u for u, _ in REFERRERS]), ["own.example"])
    return t("events").select("event_id", visits.visitor_kind(agent).alias("kind"), visits.referrer_group(domain).alias("came_from"))


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_custkey % 3 = 0 AS paused FROM customer WHERE c_custkey % 5 > 0), n AS (SELECT c_custkey AS id, lower(c_name) AS name FROM customer WHERE c_custkey % 7 > 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(o.paused, false) AS paused FROM o FULL JOIN n USING (id)""")
def registry_merge(t) -> DataFrame:
    """A registry read again: everything new but the column that people set."""
    k = F.col("c_custkey")
    old = t("customer").filter(k % 5 > 0).select(k.alias("id"), F.col("c_name").alias("name"), (k % 3 == 0).alias("paused"))
    new = t("customer").filter(k % 7 > 0).select(k.alias("id"), F.lower("c_name").alias("name"), F.lit(False).alias("paused"))
    return history.replaced_keeping(old, new, "id", ["paused"])


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS outcome, CASE WHEN o_orderkey % 4 = 0 THEN 'person' ELSE 'rules' END AS by_, CASE WHEN o_orderkey % 4 = 0 THEN 'first' END AS prop FROM orders)
    SELECT id, CASE WHEN id % 3 = 0 THEN 'X' ELSE outcome END AS outcome, CASE WHEN id % 3 = 0 THEN 'person' ELSE by_ END AS decided_by, CASE WHEN id % 3 = 0 AND by_ <> 'person' THEN outcome ELSE prop END AS proposed FROM o""")
def overridden(t) -> DataFrame:
    """Corrections by hand, the first automatic proposal being kept."""
    k = F.col("o_orderkey")
    person = k % 4 == 0
    old = t("orders").select(k.alias("id"), F.col("o_orderstatus").alias("outcome"), F.when(person, "person").otherwise("rules").alias("decided_by"), F.when(person, "first").alias("proposed"))
    return history.overridden(old, t("orders").filter(k % 3 == 0).select(k.alias("id"), F.lit("X").alias("outcome")), "id", "person")


@query("""WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    q AS (SELECT user_id, max(ts) FILTER (WHERE event_id % 3 = 0) AS checked FROM events GROUP BY 1)
    SELECT user_id, checked FROM q WHERE checked IS NULL OR checked < TIMESTAMP '2024-01-31' - INTERVAL 2 DAY ORDER BY checked NULLS FIRST, user_id LIMIT 10""")
def work_queue(t) -> DataFrame:
    """The ten entities whose last check is oldest, of those that have cooled down: a bounded queue."""
    checked = t("events").groupBy("user_id").agg(F.max(F.when(F.col("event_id") % 3 == 0, F.col("ts"))).alias("checked"))
    return health.work_queue(checked, "checked", "user_id", F.lit("2024-01-31").cast("timestamp"), 2, 10)


@query("""WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS first_day FROM events GROUP BY 1)
    SELECT CAST(ts AS DATE) AS day, CAST(count(*) FILTER (WHERE CAST(ts AS DATE) > first_day) AS BIGINT) AS news, CAST(count(*) FILTER (WHERE CAST(ts AS DATE) = first_day) AS BIGINT) AS first_reads FROM events JOIN f USING (user_id) GROUP BY 1""")
def first_reads(t) -> DataFrame:
    """What the first reading of a source finds is no news."""
    rows = t("events").select("user_id", "event_id", F.to_date("ts").alias("day"))
    marked = health.first_read_suppressed(rows, "user_id", "day")
    return marked.groupBy("day").agg(F.count_if(~F.col("from_backlog")).alias("news"), F.count_if("from_backlog").alias("first_reads"))


@query("""SELECT event_id, json_merge_patch(props, '{"seen":"' || event_type || '"}')->>'seen' AS seen, json_merge_patch(props, '{"seen":"' || event_type || '"}')->>'k' AS k FROM events""")
def json_merge(t) -> DataFrame:
    """Two JSON objects put together, the later one winning."""
    merged = history.merged_json(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("seen"))))
    return t("events").select("event_id", F.get_json_object(merged, "$.seen").alias("seen"), F.get_json_object(merged, "$.k").alias("k"))

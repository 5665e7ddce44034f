"""Documents, pages and titles: triage, sufficiency, budgets, address keys, linking; and matching of profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeworks.functions import notices as nx
from noticeworks.functions import phrases as px
from noticeworks.functions import text as tx
from noticeworks.operators import documents, history, linking, matching
from noticeworks.operators.lineage import cut_lineage
from noticeworks.plans.base import query
from noticeworks.sources import pages as page_source

SECTIONS = [("excluded", ["licensed under", "released under"]), ("relevant", ["the by*", "le la", "der die", "de la"]), ("other", ["and", "und", "et", "y"])]
SIGNS = {"article": "(?i)\\bthe\\b", "subject": "(?i)\\band\\b", "of": "(?i)\\bof\\b", "verb": "(?i)\\b(is|ist|est|es)\\b", "token": "token = "}


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(f, '(^|[^a-z0-9_])(licensed\s+under|released\s+under)($|[^a-z0-9_])') THEN 'excluded'
        WHEN regexp_matches(f, '(^|[^a-z0-9_])(the\s+by[a-z0-9_]*|le\s+la|der\s+die|de\s+la)($|[^a-z0-9_])') THEN 'relevant'
        WHEN regexp_matches(f, '(^|[^a-z0-9_])(and|und|et|y)($|[^a-z0-9_])') THEN 'other' END AS section
    FROM (SELECT doc_id, replace(replace(replace(replace(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčćďěňřťůąęńśźżőű', 'aaaaaaeeeeiiiiooooouuuuyyncszccdenrtuaenszzou'), '’', ''''), '‘', ''''), '`', ''''), '´', '''') AS f FROM documents)""")
def triage(t) -> DataFrame:
    return t("documents").select("doc_id", documents.triage(F.col("text"), SECTIONS).alias("section"))


#: Rules for invented prose in the form of a rule file: every section, groups with and without needs, unfinished words.
RULES = px.read_rules({
    "relevant": [
        {"group": "english", "words": ["the by*", "whereof", "is the of*"]},
        {"group": "french", "words": ["le la", "de la", "queel*"], "with": ["ment*", "eau le", "oi"]},
        {"group": "german", "words": ["der die", "keit*", "heit und"]},
        {"group": "spanish", "words": ["que el", "cion*", "los las"]},
    ],
    "business": [{"group": "firms", "words": ["tion", "auf*", "par", "que de", "threti*"]}],
    "private": [{"group": "homes", "words": ["hest*", "ing the", "ouer", "un*", "password", "api_key"]}],
    "other": [
        {"group": "notices", "words": ["licensed under", "released under", "all rights*"]},
        {"group": "fragments", "words": ["ernt", "retion*", "is and"], "with": ["and", "le", "und"]},
    ],
})


def rule_sql(section: str) -> str:
    """CASE of the first rule of a section that fires over the folded text f."""
    border = r"[^\pL\pM\p{Nd}\p{Pc}]"

    def occurs(phrase: str) -> str:
        body = r"\s+".join(px.plain(phrase.rstrip("*")).split()) + (r"[\pL\pM\p{Nd}\p{Pc}]*" if phrase.endswith("*") else "")
        return f"regexp_matches(f, '(^|{border}){body}($|{border})')"

    text = lambda r, n: f"{r.section}/{r.group}: '{r.phrase}'" + (f" + '{n}'" if n else "")
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    whens = [f"WHEN {occurs(r.phrase)}{f' AND {occurs(n)}' if n else ''} THEN {quoted(text(r, n))}" for r in RULES if r.section == section for n in r.needs or ("",)]
    return f"CASE {' '.join(whens)} END"


@query(f"""WITH d AS (SELECT doc_id, replace(replace(replace(replace(translate(lower(coalesce(text, '')), '{tx.MARKED}', '{tx.PLAIN}'), '’', ''''), '‘', ''''), '`', ''''), '´', '''') AS f FROM documents),
    h AS (SELECT doc_id, {", ".join(f"{rule_sql(s)} AS {s}" for s in ("relevant", "business", "private", "other"))} FROM d)
    SELECT doc_id, CASE WHEN relevant IS NULL THEN CASE WHEN other IS NULL THEN 'to_review' ELSE 'not_relevant' END WHEN private IS NOT NULL AND business IS NULL THEN 'not_relevant' ELSE 'relevant' END AS outcome,
        CASE WHEN relevant IS NULL THEN other WHEN private IS NOT NULL AND business IS NULL THEN private ELSE relevant END AS reason,
        CASE WHEN private IS NOT NULL AND business IS NULL THEN relevant END AS overruled FROM h""")
def triage_reasons(t) -> DataFrame:
    """Every document's outcome by the rules, with the rule that decided and the one that it overruled."""
    return t("documents").select("doc_id", px.triage_decision(F.col("text"), RULES).alias("d")).select("doc_id", "d.*")


@query("SELECT doc_id, translate(lower(substr(text, 1, 200)), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčćďěňřťůąęńśźżőű', 'aaaaaaeeeeiiiiooooouuuuyyncszccdenrtuaenszzou') AS folded FROM documents WHERE lang IN ('fr', 'es')")
def accent_fold(t) -> DataFrame:
    return t("documents").filter("lang IN ('fr', 'es')").select("doc_id", tx.fold(F.substring("text", 1, 200)).alias("folded"))


@query("SELECT doc_id, replace(replace(replace(replace(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčćďěňřťůąęńśźżőű', 'aaaaaaeeeeiiiiooooouuuuyyncszccdenrtuaenszzou'), '’', ''''), '‘', ''''), '`', ''''), '´', '''') AS folded FROM documents")
def fold_texts(t) -> DataFrame:
    """Every text folded whole, in any language; the SQL of accent_fold asks only for the beginnings of two languages."""
    return t("documents").select("doc_id", tx.fold(F.col("text")).alias("folded"))


SIGN_SQL = " + ".join(f"CAST(regexp_matches(text, '{p}') AS INTEGER)" for p in SIGNS.values())


@query(f"""WITH s AS (SELECT source, doc_id, {SIGN_SQL} AS signs, length(text) AS chars FROM documents),
    g AS (SELECT source, count(*) FILTER (WHERE chars >= 3000 AND signs >= 4) AS n_good, max(chars) AS longest,
        arg_max(doc_id, (signs, chars, -doc_id)) FILTER (WHERE chars >= 3000 AND signs >= 4) AS best FROM s GROUP BY 1)
    SELECT source, CASE WHEN n_good > 0 THEN 'full' WHEN longest >= 300 THEN 'summary' ELSE 'none' END AS verdict, best, CAST(n_good AS BIGINT) AS n_good, CAST(longest AS INTEGER) AS longest FROM g""")
def doc_sufficiency(t) -> DataFrame:
    return documents.sufficiency(t("documents"), "source", SIGNS, 3000, 4, 300)


COMMON_SQL = "[" + ", ".join(f"'{w}'" for w in documents.COMMON) + "]"


@query(f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS words, length(regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g')) AS solid,
        length(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters FROM documents)
    SELECT doc_id, coalesce(CASE WHEN len(words) < 150 THEN solid > 0 AND letters / greatest(solid, 1) >= 0.3
        ELSE len(list_filter(words, lambda x: list_contains({COMMON_SQL}, x))) / len(words) >= 0.05 END, false) AS readable FROM w""")
def doc_readable(t) -> DataFrame:
    return t("documents").select("doc_id", documents.readable(F.col("text")).alias("readable"))


@query("""WITH s AS (SELECT doc_id, source, text, length(text) AS chars, lower(trim(regexp_replace(substr(text, 1, 5000), '\\s+', ' ', 'g'))) AS seen FROM documents),
    u AS (SELECT *, row_number() OVER (PARTITION BY source, CASE WHEN length(seen) > 2000 THEN md5(seen) END ORDER BY doc_id) AS n FROM s),
    k AS (SELECT * FROM u WHERE length(seen) <= 2000 OR n = 1), f AS (SELECT *, least(chars, least(30000, floor(150000 / (2 * count(*) OVER (PARTITION BY source))))) AS q FROM k),
    r AS (SELECT *, 150000 - sum(q) OVER (PARTITION BY source) AS rest, sum(chars - q) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS need FROM f)
    SELECT doc_id, source, CAST(q + least(need, rest) - least(need - (chars - q), rest) AS BIGINT) AS quota FROM r""")
def doc_budget(t) -> DataFrame:
    return documents.budget(t("documents").select("doc_id", "source", "text"), "source", [F.col("doc_id").asc()], 150_000).select("doc_id", "source", "quota")


@query("""SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.]+') AS mail, regexp_matches(text, 'token = ') AS token FROM documents""")
def pii_flags(t) -> DataFrame:
    text = F.col("text")
    return t("documents").select("doc_id", text.rlike(r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+").alias("mail"), text.contains("token = ").alias("token"))


@query("""WITH p AS (SELECT quality, CASE WHEN contains(text, ' | ') OR contains(text, '%%%') OR contains(text, '!! ') THEN 0 ELSE 1 END AS guess FROM documents JOIN labels USING (doc_id))
    SELECT quality, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE guess = quality) AS BIGINT) AS agreed, round(100.0 * count(*) FILTER (WHERE guess = quality) / greatest(count(*), 1), 1) AS share FROM p GROUP BY 1""")
def rule_agreement(t) -> DataFrame:
    text = F.col("text")
    guess = F.when(text.contains(" | ") | text.contains("%%%") | text.contains("!! "), 0).otherwise(1)
    rows = t("documents").join(t("labels"), "doc_id").withColumn("guess", guess)
    agreed = F.count_if(F.col("guess") == F.col("quality"))
    return rows.groupBy("quality").agg(F.count("*").alias("n"), agreed.alias("agreed"), tx.percent(agreed, F.count("*")).alias("share"))


@query("""SELECT lang, CAST(count(*) AS BIGINT) AS n, CAST(count(quality) AS BIGINT) AS labelled, round(100.0 * count(quality) / greatest(count(*), 1), 1) AS coverage
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage_by_stratum(t) -> DataFrame:
    rows = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    n = F.count("quality")
    return rows.groupBy("lang").agg(F.count("*").alias("n"), n.alias("labelled"), tx.percent(n, F.count("*")).alias("coverage"))


@query("""SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('sample' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 2""")
def stratified_sample(t) -> DataFrame:
    return documents.stratified_sample(t("documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "sample", 2).select("doc_id", "lang", "source")


@query("""WITH r AS (SELECT doc_id, lang, n_chars >= 2000 AS long, source, coalesce(quality, 0) AS quality, md5('cover-' || doc_id) AS h
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)),
    a AS (SELECT * FROM r WHERE quality > 0 QUALIFY row_number() OVER (PARTITION BY lang, long ORDER BY h, doc_id) = 1),
    b AS (SELECT * FROM r WHERE doc_id NOT IN (SELECT doc_id FROM a) QUALIFY row_number() OVER (PARTITION BY lang, long ORDER BY h, doc_id) = 1),
    p AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY quality > 0 DESC, h, doc_id) AS k FROM r WHERE source <> '')
    SELECT doc_id, lang, source, 'relevant' AS why FROM a UNION ALL SELECT doc_id, lang, source, 'any' FROM b
    UNION ALL SELECT doc_id, lang, source, 'platform' FROM p WHERE k = 1 AND n >= 2 AND NOT EXISTS (SELECT 1 FROM a WHERE a.source = p.source) AND NOT EXISTS (SELECT 1 FROM b WHERE b.source = p.source)""")
def covering_sample(t) -> DataFrame:
    """Documents picked so that each language, short and long, and each source is seen."""
    quality = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = t("documents").select("doc_id", "lang", (F.col("n_chars") >= 2000).alias("long"), "source").join(quality, "doc_id", "left")
    return documents.covering_sample(rows, ["lang", "long"], "source", "doc_id", "quality", "cover-").select("doc_id", "lang", "source", "why")


@query("""SELECT template, CAST(count(*) AS BIGINT) AS n, min(event_id) AS example FROM (SELECT event_id, regexp_replace(event_type || ' ' || props, '[0-9/]+', 'N', 'g') AS template FROM events) GROUP BY 1""")
def template_groups(t) -> DataFrame:
    rows = t("events").select("event_id", tx.masked(F.concat_ws(" ", "event_type", "props")).alias("template"))
    return rows.groupBy("template").agg(F.count("*").alias("n"), F.min("event_id").alias("example"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') AND NOT starts_with(s, '0000') THEN left(s, 10) END AS DATE) AS day
    FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') || ' and more' WHEN 1 THEN strftime(ts, '%Y-13-%d') WHEN 2 THEN '0000-01-01' WHEN 3 THEN 'on ' || strftime(ts, '%Y-%m-%d')
        ELSE strftime(ts, '%Y-02-') || lpad(CAST(event_id % 32 AS VARCHAR), 2, '0') END AS s FROM events)""")
def safe_dates(t) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    case = F.col("event_id") % 5
    s = (
        F.when(case == 0, F.concat(day, F.lit(" and more"))).when(case == 1, F.concat(F.date_format("ts", "yyyy"), F.lit("-13-"), F.date_format("ts", "dd")))
        .when(case == 2, "0000-01-01").when(case == 3, F.concat(F.lit("on "), day))
        .otherwise(F.concat(F.date_format("ts", "yyyy-'02-'"), F.lpad((F.col("event_id") % 32).cast("string"), 2, "0")))
    )
    return t("events").select("event_id", tx.safe_date(s).alias("day"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day FROM events""")
def tolerant_dates(t) -> DataFrame:
    """Five spellings of a day are read back as that day."""
    months = F.create_map(*[F.lit(x) for name, n in list(tx.MONTHS.items())[:12] for x in (n, name)])
    case = F.col("event_id") % 5
    long = F.concat_ws(" ", F.lit("scade il"), F.dayofmonth("ts").cast("string"), F.element_at(months, F.month("ts")), F.year("ts").cast("string"))
    s = (
        F.when(case == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(case == 1, F.date_format("ts", "E, d MMM yyyy HH:mm:ss '+0000'"))
        .when(case == 2, F.date_format("ts", "dd/MM/yyyy")).when(case == 3, F.date_format("ts", "'entro' d.M.yy")).otherwise(long)
    )
    return t("events").select("event_id", tx.tolerant_date(s).alias("day"))


@query(r"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '^https?://', ''), '#.*$', '') AS rest FROM pages),
    q AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^.*@', ''), '^www\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_replace(regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+', '/', 'g'), '(?i)/(index|default)\.(html?|php|aspx?)$', '/'), '/+$', '') AS path,
        list_sort(list_transform(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(string_split(x, '=')[1], '^(?i)(utm_\w+|fbclid|gclid|t|_|ts|lang|locale|sessionid|jsessionid|phpsessid|p_l_back_url)$')),
            lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS args FROM p)
    SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://') THEN host || path || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS url_key FROM q""")
def url_key(t) -> DataFrame:
    return t("pages").select("page_id", tx.url_key(F.col("url")).alias("url_key"))


@query(r"""WITH k AS (SELECT page_id, regexp_extract(url, '^https?://(?:www\.)?([^/?#]*)', 1) || '/' || regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1) AS folder FROM pages)
    SELECT folder, CAST(count(*) AS BIGINT) AS n, min(page_id) AS first FROM k GROUP BY 1 HAVING count(*) > 1""")
def duplicate_page(t) -> DataFrame:
    """Folders that several pages share."""
    folder = F.concat(F.regexp_extract("url", r"^https?://(?:www\.)?([^/?#]*)", 1), F.lit("/"), F.regexp_extract("url", r"^https?://[^/]*/([^/?#]*)", 1))
    return t("pages").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")


@query()
def page_links(t) -> DataFrame:
    return page_source.links(t("pages"), least=2, chrome=True)


@query()
def page_text(t) -> DataFrame:
    return page_source.readable_text(t("pages"))


def no_text():
    return F.lit(None).cast("string")


def titles(documents_: DataFrame) -> DataFrame:
    """The first words of each document as a title; documents have no address."""
    title = F.array_join(F.slice(F.split(F.substring("text", 1, 400), r"\s+"), 1, 14), " ")
    return documents_.select(
        F.col("doc_id").alias("id"), "source", F.col("source").alias("issuer"), F.upper("lang").alias("territory"), F.array().cast("array<string>").alias("urls"),
        nx.official_code(no_text(), no_text(), F.col("text")).alias("code"), title.alias("title"), F.col("doc_id").alias("seen"),
    )


@query(r"""WITH w AS (SELECT item_id, list_sort(list_distinct(list_filter(regexp_extract_all(translate(lower(text), 'àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžčćďěňřťůąęńśźżőű', 'aaaaaaeeeeiiiiooooouuuuyyncszccdenrtuaenszzou'), '[a-z0-9]+'), lambda x: length(x) >= 2))) AS words FROM benchmark),
    p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.words, b.words)) AS common, len(a.words) AS na, len(b.words) AS nb FROM w a JOIN w b ON a.item_id < b.item_id)
    SELECT a, b, round(CASE WHEN na > 0 AND nb > 0 THEN greatest(common / (na + nb - common), CASE WHEN least(na, nb) >= 4 THEN 0.9 * common / least(na, nb) ELSE 0 END) ELSE 0 END, 6) AS score FROM p
    WHERE na > 0 AND nb > 0 AND greatest(common / (na + nb - common), CASE WHEN least(na, nb) >= 4 THEN 0.9 * common / least(na, nb) ELSE 0 END) >= 0.15""")
def title_similarity(t) -> DataFrame:
    rows = t("benchmark").select(
        F.col("item_id").alias("id"), tx.words(F.lower("text")).alias("words"), F.array().cast("array<string>").alias("years"), F.lit("ALL").alias("territory")
    )
    return linking.title_pairs(rows, 0.15).select("a", "b", F.round("score", 6).alias("score"))


@query()
def link_groups(t) -> DataFrame:
    return linking.link_groups(cut_lineage(titles(t("documents"))))


def page_titles(pages: DataFrame) -> DataFrame:
    """Pages as announcements: address, whole title, and a code from address or anywhere in the page."""
    html = F.col("html")
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"&#?\w+;", " ")
    host = F.regexp_extract("url", r"^https?://([^/?#]*)", 1)
    lang = F.nullif(F.upper(F.regexp_extract(html, r"(?is)<html[^>]*\slang=[\"']?([a-z]+)", 1)), F.lit(""))
    return pages.select(
        F.col("page_id").alias("id"), host.alias("source"), host.alias("issuer"), F.coalesce(lang, F.lit("ITA")).alias("territory"), F.array(tx.url_key(F.col("url"))).alias("urls"),
        nx.official_code(no_text(), F.col("url"), html).alias("code"), title.alias("title"), F.col("page_id").alias("seen"),
    )


@query()
def link_pages(t) -> DataFrame:
    """Linking by all three rules: code, address, title."""
    return linking.link_groups(cut_lineage(page_titles(t("pages"))))


# --- matching: customers as profiles, the parts of fifty sizes as calls ---------------------------------------------


def calls(part: DataFrame) -> DataFrame:
    """One call for each part size, with attributes that follow from it."""
    k = F.col("p_size")
    state = lambda m: F.when(k % m == 0, "unconstrained").when(k % m == 1, "unknown").otherwise("constrained")
    names = ["territory", "subjects", "forms", "sizes", "codes", "age", "requirements", "staff", "turnover"]
    constraints = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), state(i + 3))])
    text = lambda *v: F.array(*[F.lit(x) if isinstance(x, str) else x for x in v])
    none = F.array().cast("array<string>")
    rows = part.groupBy("p_size").agg(F.count("*").alias("parts"), F.max("p_retailprice").alias("amount"))
    return rows.select(
        k.alias("call_id"), constraints.alias("constraints"), F.when(k % 4 == 3, none).otherwise(text(F.concat(F.lit("R"), (k % 5).cast("string")))).alias("regions"),
        none.alias("provinces"), none.alias("province_regions"), F.when(k % 6 == 0, text("national")).otherwise(text("region")).alias("levels"), F.when(k % 8 == 5, "to_open").alias("seat_rule"),
        F.when(k % 5 == 4, none).otherwise(text("company", F.when(k % 2 == 0, "freelancer").otherwise("other"))).alias("subjects"),
        F.when(k % 3 == 2, text("srl", "spa")).otherwise(none).alias("forms_in"), F.when(k % 7 == 2, text("snc")).otherwise(none).alias("forms_out"),
        F.when(k % 2 == 0, text("micro", "small")).otherwise(text("medium", "large")).alias("sizes"), F.when(k % 3 == 0, text("10", "25.1")).otherwise(text("62")).alias("codes_in"),
        F.when(k % 10 == 9, text("25")).otherwise(none).alias("codes_out"), F.when(k % 4 == 2, 24).alias("age_min"), F.when(k % 4 == 3, 120).alias("age_max"),
        F.when(k % 5 == 2, text("female")).otherwise(none).alias("required"), text("young").alias("bonus"), F.when(k % 6 == 4, 5).alias("staff_min"), F.when(k % 6 == 5, 100).alias("staff_max"),
        F.when(k % 9 == 4, 1_000_000.0).alias("turnover_min"), F.lit(None).cast("double").alias("turnover_max"), text("green", "digital").alias("topics"), text("machines").alias("spend"),
        F.when(k % 11 == 0, "summary").otherwise("official").alias("completeness"), F.when(k % 13 == 12, "closed").otherwise("open").alias("state"),
        F.date_add(F.lit("2001-08-02").cast("date"), k * 3).alias("deadline"), "amount",
    )


PROFILE = ["p_regions", "p_provinces", "subject", "legal_form", "size", "staff", "turnover", "balance", "codes", "founded", "to_be_formed", "requirements", "p_topics", "p_spend"]


def profiles(customer: DataFrame) -> DataFrame:
    n, seg = F.col("c_nationkey"), F.col("c_mktsegment")
    none = F.array().cast("array<string>")
    return customer.select(
        F.col("c_custkey").alias("code"), F.when(n % 7 == 6, none).otherwise(F.array(F.concat(F.lit("R"), (n % 5).cast("string")))).alias("p_regions"), none.alias("p_provinces"),
        F.when(seg == "BUILDING", "freelancer").otherwise("company").alias("subject"), F.get(F.array(*map(F.lit, ["srl", "srls", "snc", "spa"])), n % 4).alias("legal_form"),
        F.lit(None).cast("string").alias("size"), F.when(n % 9 != 8, n * 12).alias("staff"), F.when(n % 4 != 3, n.cast("double") * 900_000).alias("turnover"), F.lit(None).cast("double").alias("balance"),
        F.when(seg == "MACHINERY", F.array(F.lit("25.11"))).when(seg == "AUTOMOBILE", F.array(F.lit("10"))).when(seg == "FURNITURE", F.array(F.lit("62.01"))).otherwise(none).alias("codes"),
        F.add_months(F.lit("2001-08-02").cast("date"), -(n * 9)).alias("founded"), F.lit(False).alias("to_be_formed"),
        F.create_map(F.lit("female"), n % 2 == 0, F.lit("young"), n % 3 == 0).alias("requirements"), F.array(F.lit("green")).alias("p_topics"), F.array(F.lit("machines")).alias("p_spend"),
    )


def matched(t, keep_excluded: bool = True) -> DataFrame:
    return matching.match(calls(t("part")), profiles(t("customer")), F.lit("2001-08-02").cast("date"), PROFILE, keep_excluded=keep_excluded)


MATCH_SQL = r"""
    WITH c AS (SELECT p_size AS k, max(p_retailprice) AS amount FROM part GROUP BY 1),
    p AS (SELECT c_custkey AS code, c_nationkey AS n, c_mktsegment AS seg FROM customer),
    d AS (SELECT DISTINCT n, seg FROM p),
    f AS (SELECT d.*, c.*, CASE WHEN seg = 'BUILDING' THEN 'freelancer' ELSE 'company' END AS subject, ['srl', 'srls', 'snc', 'spa'][n % 4 + 1] AS form, CASE WHEN n % 9 <> 8 THEN n * 12 END AS staff,
        CASE WHEN n % 4 <> 3 THEN n * 900000.0 END AS turnover, CASE seg WHEN 'MACHINERY' THEN '25.11' WHEN 'AUTOMOBILE' THEN '10' WHEN 'FURNITURE' THEN '62.01' END AS act FROM d CROSS JOIN c),
    g AS (SELECT *, CASE WHEN staff IS NULL THEN NULL WHEN staff < 10 THEN 0 WHEN staff < 50 THEN 1 WHEN staff < 250 THEN 2 ELSE 3 END AS by_staff,
        CASE WHEN turnover IS NULL THEN NULL WHEN turnover <= 2000000 THEN 0 WHEN turnover <= 10000000 THEN 1 WHEN turnover <= 50000000 THEN 2 ELSE 3 END AS by_money FROM f),
    h AS (SELECT *, CASE WHEN staff IS NOT NULL OR turnover IS NOT NULL THEN greatest(by_staff, by_money) END AS size, CASE WHEN by_money > by_staff THEN by_staff END AS possible,
        (k % 2 = 0) AS small_call, (n % 5 = k % 5 AND n % 7 <> 6 AND k % 4 <> 3) AS here, n % 7 = 6 AS nowhere FROM g),
    r AS (SELECT *,
        CASE WHEN k % 3 = 0 OR (k % 3 = 1 AND k % 6 = 0) THEN NULL WHEN k % 3 = 1 THEN 'd:territory unknown' WHEN nowhere THEN 'd:no site' WHEN k % 4 = 3 THEN 'd:territory in words' WHEN here THEN 'f:site in territory'
            WHEN k % 8 = 5 THEN 'd:a site must be opened' ELSE 'e:no site in territory' END AS r1,
        CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'd:subjects unknown' WHEN k % 5 = 4 THEN 'd:subjects in words' WHEN subject = 'company' OR k % 2 = 0 THEN 'f:subject admitted' ELSE 'd:other subjects admitted' END AS r2,
        CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'd:forms unknown' WHEN k % 7 = 2 AND form = 'snc' THEN 'e:legal form excluded' WHEN k % 3 = 2 AND form = 'snc' THEN 'e:legal form not admitted'
            WHEN k % 3 <> 2 AND k % 7 <> 2 THEN 'd:forms in words' END AS r3,
        CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN 'd:sizes unknown' WHEN size IS NULL THEN 'd:size missing' WHEN (size <= 1) = small_call THEN 'f:size admitted'
            WHEN (possible <= 1) = small_call THEN 'd:size depends on the balance sheet' ELSE 'e:size not admitted' END AS r4,
        CASE WHEN act IS NULL AND (k % 7 <> 0 OR k % 10 = 9) THEN 'd:activity code missing' WHEN act IS NULL THEN NULL WHEN k % 10 = 9 AND starts_with(act, '25') THEN 'e:activity excluded' WHEN k % 7 = 0 THEN NULL
            WHEN k % 7 = 1 THEN 'd:activities unknown' WHEN (k % 3 = 0 AND (starts_with(act, '10') OR starts_with(act, '25.1'))) OR (k % 3 <> 0 AND starts_with(act, '62')) THEN 'f:activity admitted' ELSE 'e:activity not admitted' END AS r5,
        CASE WHEN k % 8 = 0 THEN NULL WHEN k % 8 = 1 THEN 'd:age unknown' WHEN k % 4 NOT IN (2, 3) THEN 'd:age in words' WHEN k % 4 = 2 AND n * 9 < 24 THEN 'e:too young' WHEN k % 4 = 3 AND n * 9 > 120 THEN 'e:too old' END AS r6,
        CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'd:requirements unknown' WHEN k % 5 <> 2 THEN 'd:requirements in words' WHEN n % 2 = 1 THEN 'e:requirement not met' ELSE 'f:requirements met' END AS r7,
        CASE WHEN n % 3 = 0 THEN 'f:bonus requirement' END AS r8,
        CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 'd:range unknown' WHEN k % 6 NOT IN (4, 5) THEN NULL WHEN staff IS NULL THEN 'd:staff missing' WHEN k % 6 = 4 AND staff < 5 THEN 'e:staff below minimum'
            WHEN k % 6 = 5 AND staff > 100 THEN 'e:staff above maximum' END AS r9,
        CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN 'd:range unknown' WHEN k % 9 <> 4 THEN NULL WHEN turnover IS NULL THEN 'd:turnover missing' WHEN turnover < 1000000 THEN 'e:turnover below minimum' END AS r10,
        CASE WHEN k % 13 = 12 THEN 'e:closed' END AS r12 FROM h),
    s AS (SELECT *, list_filter([r1, r2, r3, r4, r5, r6, r7, r8, r9, r10], lambda x: x IS NOT NULL) AS rs FROM r),
    u AS (SELECT *, list_transform(list_filter(rs, lambda x: starts_with(x, 'e:')), lambda x: x[3:]) AS e0, list_transform(list_filter(rs, lambda x: starts_with(x, 'd:')), lambda x: x[3:]) AS d0,
        list_transform(list_filter(rs, lambda x: starts_with(x, 'f:')), lambda x: x[3:]) AS favours FROM s),
    v AS (SELECT n, seg, k AS call_id, amount, size, CASE WHEN r12 IS NOT NULL THEN list_append(e0, 'closed') ELSE e0 END AS exclusions,
        CASE WHEN len(e0) = 0 AND k % 11 = 0 THEN list_append(d0, 'summary only') ELSE d0 END AS doubts, favours,
        ((k % 3 = 1 AND k % 6 <> 0 AND NOT nowhere AND NOT here) OR r1 = 'd:a site must be opened') AS out_of_zone FROM u),
    w AS (SELECT *, CASE WHEN len(exclusions) > 0 THEN 'excluded' WHEN len(doubts) > 0 THEN 'to_verify' ELSE 'compatible' END AS level,
        len(list_filter(doubts, lambda x: x NOT IN ('range unknown', 'summary only', 'no document read', 'age unknown', 'forms unknown', 'requirements unknown', 'state unknown', 'age in words', 'forms in words'))) AS heavy_doubts,
        2 AS interests, DATE '2001-08-02' + CAST(call_id * 3 AS INTEGER) AS deadline FROM v),
    m AS (SELECT p.code, w.* FROM p JOIN w USING (n, seg))"""


@query(MATCH_SQL + """ SELECT code, call_id, level, array_to_string(exclusions, '; ') AS exclusions, array_to_string(doubts, '; ') AS doubts, array_to_string(favours, '; ') AS favours,
    coalesce(out_of_zone, false) AS out_of_zone, CAST(heavy_doubts AS INTEGER) AS heavy_doubts, interests FROM m""")
def match_profiles(t) -> DataFrame:
    joined = [F.array_join(c, "; ").alias(c) for c in ("exclusions", "doubts", "favours")]
    return matched(t).select("code", "call_id", "level", *joined, "out_of_zone", "heavy_doubts", "interests")


@query(MATCH_SQL + """ SELECT code, call_id, CAST(rn AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY CASE level WHEN 'compatible' THEN 0 WHEN 'to_verify' THEN 1 ELSE 2 END,
    coalesce(out_of_zone, false), CASE WHEN level = 'to_verify' THEN heavy_doubts ELSE 0 END, CASE WHEN level = 'to_verify' THEN len(doubts) ELSE 0 END, interests DESC, deadline, call_id) AS rn FROM m WHERE level <> 'excluded') WHERE rn <= 5""")
def catalogue_sorted(t) -> DataFrame:
    rows = matched(t, keep_excluded=False)
    return history.latest_per_key(rows, ["code"], matching.relevance("call_id"), 5).select("code", "call_id", F.col("rn").cast("int").alias("place"))


@query(MATCH_SQL + """, b AS (SELECT *, least(amount, CASE size WHEN 0 THEN 1000 WHEN 1 THEN 1200 WHEN 2 THEN 1500 ELSE 2000 END) AS benefit FROM m WHERE level <> 'excluded')
    SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE level = 'compatible') AS BIGINT) AS compatible, max(benefit) AS best, arg_max(call_id, (benefit, -call_id)) AS best_call FROM b GROUP BY 1""")
def campaign_top(t) -> DataFrame:
    size, _ = matching.size_class()
    rows = matched(t, keep_excluded=False).withColumn("cls", size)
    benefit = matching.capped_benefit(F.col("amount"), F.col("cls"), {"micro": 1000.0, "small": 1200.0, "medium": 1500.0, "large": 2000.0})
    return rows.withColumn("benefit", benefit).groupBy("code").agg(
        F.count("*").alias("n"), F.count_if(F.col("level") == "compatible").alias("compatible"), F.max("benefit").alias("best"), F.max_by("call_id", F.struct("benefit", -F.col("call_id"))).alias("best_call")
    )


@query("""SELECT p_partkey, m.name FROM part JOIN (VALUES ('plating', ['PLATED', 'POLISHED']), ('metals', ['STEEL', 'COPPER']), ('economy', ['ECONOMY'])) m(name, words) ON list_has_any(string_split(p_type, ' '), m.words)""")
def measures_overlap(t) -> DataFrame:
    """Parts with the measures that share a category: a literal table of three rows on the other side."""
    part = t("part")
    rows = [("plating", ["PLATED", "POLISHED"]), ("metals", ["STEEL", "COPPER"]), ("economy", ["ECONOMY"])]
    measures = part.sparkSession.createDataFrame(rows, "name string, categories array<string>")
    return part.join(F.broadcast(measures), F.arrays_overlap(F.split("p_type", " "), "categories")).select("p_partkey", "name")

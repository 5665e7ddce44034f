"""Matching of calls with company profiles under three-valued constraints.

Each constraint of a call is *constrained*, *unconstrained* or *unknown*.  Unconstrained passes; unknown is to be
verified and never passes; constrained is evaluated, and a missing list or profile value is to be verified.  A pair
keeps its reasons in arrays: any exclusion excludes, else any doubt makes it ``to_verify``, else it is
``compatible``.  All rules are column expressions on (call, profile) pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeworks.functions.text import commune_key, squeeze, whole_months

UNCONSTRAINED, UNKNOWN, CONSTRAINED = "unconstrained", "unknown", "constrained"
COMPATIBLE, TO_VERIFY, EXCLUDED = "compatible", "to_verify", "excluded"

#: Class, employees below, turnover up to, balance up to (EU recommendation 2003/361; fixed values).
SIZES = (("micro", 10, 2_000_000, 2_000_000), ("small", 50, 10_000_000, 10_000_000), ("medium", 250, 50_000_000, 43_000_000))
SIZE_NAMES = ("micro", "small", "medium", "large")

#: Doubts of no weight for the order of results.
LIGHT = ("range unknown", "summary only", "no document read", "age unknown", "forms unknown", "requirements unknown", "state unknown", "age in words", "forms in words")

#: Levels of a source that speak for one place only; subjects that run a business.
LOCAL = ("region", "chamber", "capital", "province", "foundation")
BUSINESS = ("company", "freelancer", "aspiring")

# A territory in words that means the whole country; words that tell companies among the beneficiaries;
# phrases that admit companies in special cases only; social enterprises; titles of calls for non-profit bodies.
WHOLE_COUNTRY = (
    r"(?iu)stat[oi] membr|horizon|paesi (ammissibili|partecipanti)|unione europea|\bue\b|"
    r"tutt[oa] (il territorio|italia)|territorio nazionale|nazionale|\bitalia\b"
)
COMPANY_WORDS = (
    r"(?iu)impres|aziend|societ[aà]|\bditt[ae]\b|operatori economici|\bm?pmi\b|consorzi|cooperativ|"
    r"start-?up|professionist|commercian|esercent|artigian|datori di lavoro|partita iva|"
    r"lavorator[ei] autonom"
)
ONLY_IN_PART = (
    r"(?iu)solo per (le )?iniziative (senza|non a) scopo di lucro|"
    r"non (devono|possono) essere (usat|utilizzat)\w* per attivit[aà] economic\w*|"
    r"imprese singole possono beneficiare solo|non sono ammesse le imprese"
)
SOCIAL = r"(?iu)(impres[ae]|cooperativ[ae])( \w+)? social[ei]"
NON_PROFIT_TITLE = r"(?iu)senza scopo di lucro|non a scopo di lucro|no[- ]?profit|terzo settore|volontariato"

#: What is to be checked with the company, whatever the level: aid regimes and ways of selection that ask for it.
DE_MINIMIS = ("de_minimis", "de_minimis_agricolo")
FIRST_COME = ("sportello", "sportello_valutativo", "click_day")

#: Calls of at most so many rows are broadcast to the profiles; more are dealt block by block.
BROADCAST_CALLS = 20_000


def state_of(constraint: str) -> Column:
    return F.coalesce(F.try_element_at("constraints", F.lit(constraint)), F.lit(UNKNOWN))


def size_class() -> tuple[Column, Column]:
    """(class, smaller class that is possible if the balance sheet, which is missing, were low)."""

    def rank(test) -> Column:
        out = F.when(test(SIZES[0]), 0)
        for i, s in enumerate(SIZES[1:], 1):
            out = out.when(test(s), i)
        return out.otherwise(3)

    staff, turnover, balance = F.col("staff"), F.col("turnover"), F.col("balance")
    by_staff = F.when(staff.isNotNull(), rank(lambda s: staff < s[1]))
    by_money = F.when(
        turnover.isNotNull() | balance.isNotNull(), rank(lambda s: F.coalesce(turnover <= s[2], F.lit(False)) | F.coalesce(balance <= s[3], F.lit(False)))
    )
    guess = F.when(staff.isNotNull() | turnover.isNotNull(), F.greatest(by_staff, by_money))
    name = lambda r: F.get(F.array(*map(F.lit, SIZE_NAMES)), r)
    possible = F.when(F.col("size").isNull() & (by_money > by_staff) & balance.isNull(), name(by_staff))
    return F.coalesce("size", name(guess)), possible


class Reasons:
    """Reason arrays under way, in the order of the rules."""

    def __init__(self) -> None:
        self.found: dict[str, list[Column]] = {"exclude": [], "doubt": [], "favour": []}

    def constraint(self, name: str, unknown: str, rules: list[tuple[Column, str, str]], skip: Column | None = None) -> None:
        """rules in order: (test, 'exclude' | 'doubt' | 'favour' | 'pass', reason); the first that holds decides."""
        state = state_of(name)
        all_rules = [(state == UNCONSTRAINED, "pass", ""), (state == UNKNOWN, "doubt", unknown), *rules]
        if skip is not None:
            all_rules.insert(0, (skip, "pass", ""))
        self.decide(all_rules)

    def decide(self, rules: list[tuple[Column, str, str]]) -> None:
        for kind, out in self.found.items():
            if any(k == kind for _, k, _ in rules):
                chain = reduce(
                    lambda c, r: c.when(r[0], F.lit(r[2]) if r[1] == kind else F.lit(None).cast("string")), rules[1:],
                    F.when(rules[0][0], F.lit(rules[0][2]) if rules[0][1] == kind else F.lit(None).cast("string")),
                )
                out.append(F.array(chain))

    def each(self, when: Column, items: Column, rules: list[tuple[object, str, str]]) -> None:
        """A reason for each item of an array, where ``when`` holds; rules: (item -> test, kind, reason), the first that holds."""
        def reason(kind: str):
            word = lambda r: F.lit(r[2]) if r[1] == kind else F.lit(None).cast("string")
            return lambda x: reduce(lambda c, r: c.when(r[0](x), word(r)), rules[1:], F.when(rules[0][0](x), word(rules[0])))

        for kind, out in self.found.items():
            if any(k == kind for _, k, _ in rules):
                out.append(F.when(when, F.transform(items, reason(kind))).otherwise(F.array().cast("array<string>")))

    def columns(self) -> dict[str, Column]:
        names = {"exclude": "exclusions", "doubt": "doubts", "favour": "favours"}
        none = F.array().cast("array<string>")
        return {names[k]: F.filter(F.concat(*c, none), lambda x: x.isNotNull()) for k, c in self.found.items()}


def empty(array: str) -> Column:
    return F.coalesce(F.size(array) == 0, F.lit(True))


def has(array: str, value: Column) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def overlap(a: str, b: str) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def code_covers(allowed: Column, code: Column) -> Column:
    """yes: the hierarchical code lies in allowed; maybe: allowed is a part of it; else no."""
    return F.when(code.startswith(allowed), "yes").when(allowed.startswith(code), "maybe").otherwise("no")


def territory(r: Reasons, cols: set[str], partial: bool, provinces: dict[str, str]) -> None:
    """Sites against regions, provinces and communes.  Pairs with p_sites (structs of kind, region, province, commune)
    are judged site by site, the best one counting; others by their lists of regions and provinces."""
    text = F.coalesce("territory_text", F.lit("")) if "territory_text" in cols else F.lit("")
    wide = ~empty("levels") & F.forall("levels", lambda x: x.isin("eu", "national"))
    if "territory_text" in cols:
        wide = wide & text.rlike(WHOLE_COUNTRY)
    unknown, free = state_of("territory") == UNKNOWN, state_of("territory") == UNCONSTRAINED
    if "p_sites" not in cols:
        here = overlap("p_provinces", "provinces") | overlap("p_regions", "regions")
        nowhere = empty("p_regions") & empty("p_provinces")
        lists = ~(empty("regions") & empty("provinces"))
        r.decide([
            *([(nowhere, "pass", "")] if partial else []),
            (free, "pass", ""),
            (unknown & wide, "pass", ""),
            (unknown, "doubt", "territory unknown"),
            (nowhere, "doubt", "no site"),
            (~lists, "doubt", "territory in words"),
            (here, "favour", "site in territory"),
            (~empty("provinces") & empty("p_provinces") & overlap("p_regions", "province_regions"), "doubt", "province of the site missing"),
            (F.col("seat_rule") == "to_open", "doubt", "a site must be opened"),
            (F.lit(True), "exclude", "no site in territory"),
        ])
        return
    none = F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for pair in provinces.items() for x in pair]) if provinces else F.create_map(F.lit(""), F.lit(""))
    region_of = lambda s: F.coalesce(s["region"], F.try_element_at(table, F.upper(F.trim(s["province"]))))
    get = lambda n: F.coalesce(F.col(n), none) if n in cols else none
    sites = F.filter(F.coalesce("p_sites", F.array()), lambda s: s["region"].isNotNull() | s["province"].isNotNull() | s["commune"].isNotNull())
    nowhere = F.size(sites) == 0
    regions, wanted, communes = get("regions"), F.transform(get("provinces"), F.upper), F.transform(get("communes"), commune_key)
    own = get("source_regions")
    local = (F.size(own) > 0) & F.forall(get("levels"), lambda x: x.isin(*LOCAL))
    elsewhere = local & ~F.arrays_overlap(F.filter(F.transform(sites, region_of), lambda x: x.isNotNull()), own)
    seat = F.coalesce("seat_rule", F.lit("any"))
    kinds = F.when(seat == "legal", F.array(F.lit("legal"), F.lit("both"))).when(seat == "operative", F.array(F.lit("operative"), F.lit("both")))
    suits = lambda s: kinds.isNull() | F.array_contains(kinds, F.coalesce(s["kind"], F.lit("both")))
    fitting = F.filter(sites, suits)
    fallback = (seat == "operative") & (F.size(fitting) == 0)
    fitting = F.when(fallback, F.filter(sites, lambda s: s["kind"] == "legal")).otherwise(fitting)
    covered = F.filter(F.transform(wanted, lambda p: F.try_element_at(table, p)), lambda x: x.isNotNull())
    of_communes = F.when(F.size(regions) > 0, regions).when((F.size(communes) > 0) & (F.size(wanted) == 0), own).otherwise(none)
    in_ = lambda x, array: F.coalesce(F.array_contains(array, x), F.lit(False))

    def grade(s: Column) -> Column:
        """2: here, 1: maybe, 0: no."""
        region, province = region_of(s), F.upper(s["province"])
        return (
            F.when(in_(commune_key(s["commune"]), communes), 2).when(in_(province, wanted), 2)
            .when(in_(region, regions) & ~in_(region, covered), F.when(F.size(communes) > 0, 1).otherwise(2))
            .when((F.size(communes) > 0) & s["commune"].isNull() & ((F.size(of_communes) == 0) | in_(region, of_communes)), 1)
            .when((F.size(wanted) > 0) & s["province"].isNull() & in_(region, covered), 1).otherwise(0)
        )

    best = F.coalesce(F.array_max(F.transform(fitting, grade)), F.lit(0))
    in_words = F.size(regions) + F.size(wanted) + F.size(communes) == 0
    r.decide([
        *([(nowhere, "pass", "")] if partial else []),
        (free & elsewhere & ~nowhere & ~empty("levels"), "doubt", "the project belongs elsewhere"),
        (free, "pass", ""),
        (unknown & wide, "pass", ""),
        (unknown & elsewhere, "doubt", "territory unknown, call of another region"),
        (unknown, "doubt", "territory unknown"),
        (nowhere, "doubt", "no site"),
        (in_words & text.rlike(WHOLE_COUNTRY), "pass", ""),
        (in_words, "doubt", "territory in words"),
        ((best == 2) & fallback, "doubt", "legal seat may not be operative"),
        (best == 2, "favour", "site in territory"),
        (best == 1, "doubt", "province of the site missing"),
        (seat == "to_open", "doubt", "a site must be opened"),
        (F.lit(True), "exclude", "no site in territory"),
    ])


def subjects(r: Reasons, cols: set[str], partial: bool) -> None:
    """Kind of beneficiary; calls with for_whom (the beneficiaries in words), title and for_companies are also read."""
    subject = F.when(F.col("to_be_formed"), "aspiring").otherwise(F.col("subject"))
    runs, state = subject.isin(*BUSINESS), state_of("subjects")
    admitted = F.coalesce("subjects", F.array().cast("array<string>"))
    rules: list[tuple[Column, str, str]] = [(subject.isNull(), "pass", "")] if partial else []
    if "for_whom" in cols:
        words = F.coalesce(squeeze(F.col("for_whom")), F.lit(""))
        title = F.coalesce("title", F.lit("")) if "title" in cols else F.lit("")
        maybe = F.coalesce(F.col("for_companies") == "incerto", F.lit(False)) if "for_companies" in cols else F.lit(False)
        business = F.arrays_overlap(admitted, F.array(*map(F.lit, BUSINESS)))
        first = F.get(admitted, F.lit(0))
        concerned = F.coalesce(runs, F.lit(False)) & (state != UNCONSTRAINED)
        others = concerned & ~business & ((F.size(admitted) == 0) | has("subjects", F.lit("other"))) & ~words.rlike(COMPANY_WORDS)
        listed = (words != "") & ((F.size(admitted) > 0) | maybe)
        social = concerned & (state == CONSTRAINED) & words.rlike(SOCIAL) & ~F.regexp_replace(words, SOCIAL, " ").rlike(COMPANY_WORDS)
        social = social & (F.coalesce(first, F.lit("company")) != "company")
        is_social = F.try_element_at("requirements", F.lit("social_enterprise"))
        rules += [
            (concerned & business & words.rlike(ONLY_IN_PART) & ~first.isin(*BUSINESS), "exclude", "companies in special cases only"),
            (others & listed, "exclude", "not for companies"),
            (others & (maybe | title.rlike(NON_PROFIT_TITLE)), "exclude", "companies not shown to be admitted"),
            (social & is_social.isNull(), "doubt", "social enterprise or not"),
            (social & ~is_social, "exclude", "social enterprises only"),
            (social, "pass", ""),
        ]
    r.decide([
        *rules,
        (state == UNCONSTRAINED, "pass", ""),
        (state == UNKNOWN, "doubt", "subjects unknown"),
        (subject.isNull(), "doubt", "subject missing"),
        (empty("subjects"), "doubt", "subjects in words"),
        (has("subjects", subject), "favour", "subject admitted"),
        (has("subjects", F.lit("other")), "doubt", "other subjects admitted"),
        (F.lit(True), "exclude", "subject not admitted"),
    ])


def advisory(cols: set[str]) -> Column:
    """What is to be checked with the company before it applies: aid received, exclusions, haste, lines."""
    get = lambda n: F.coalesce(F.col(n), F.array().cast("array<string>")) if n in cols else F.array().cast("array<string>")
    selection = F.col("selection") if "selection" in cols else F.lit(None).cast("string")
    lines = F.coalesce("lines", F.lit(0)) if "lines" in cols else F.lit(0)
    spend = F.col("amount_wanted") > F.col("spend_max") if {"amount_wanted", "spend_max"} <= cols else F.lit(False)
    return F.array_compact(F.array(
        F.when(spend, "spend above the maximum"),
        F.when(F.arrays_overlap(get("regimes"), F.array(*map(F.lit, DE_MINIMIS))), "de minimis aid of three years"),
        F.when(F.size(get("excluded_subjects")) > 0, F.concat(F.lit("excluded: "), F.array_join(get("excluded_subjects"), ", "))),
        F.when(selection.isin(*FIRST_COME), F.concat(F.lit("apply early: "), selection)),
        F.when(lines > 1, F.concat(lines.cast("string"), F.lit(" lines: choose one"))),
    ))


def evaluate(pairs: DataFrame, today: Column, partial: bool = False, provinces: dict[str, str] | None = None) -> DataFrame:
    """Adds level, exclusions, doubts, favours, interests, heavy_doubts, out_of_zone to (call, profile) pairs.

    Call columns: constraints, regions, provinces, levels, subjects, forms_in, forms_out, sizes, codes_in, codes_out,
    age_min, age_max, required, bonus, staff_min, staff_max, turnover_min, turnover_max, topics, spend, completeness,
    state.  Profile columns: p_regions, p_provinces, subject, legal_form, size, staff, turnover, balance, codes,
    founded, to_be_formed, requirements (map), p_topics, p_spend.  partial: what the profile lacks is not looked at.
    Further columns are judged where they are there: p_sites, communes, source_regions, territory_text (provinces
    gives the region of a province); for_whom, title, for_companies; codes_version, p_codes_version; amount_wanted,
    spend_min, spend_max, regimes, excluded_subjects, selection, lines (which fill ``advice``).
    """
    cols = set(pairs.columns)
    size, possible = size_class()
    pairs = pairs.withColumns({"__size": size, "__possible": possible, "__months": F.when(F.col("to_be_formed"), 0).otherwise(whole_months(F.col("founded"), today))})
    r = Reasons()
    missing = lambda test: test if partial else None

    territory(r, cols, partial, provinces or {})
    subjects(r, cols, partial)
    # legal form: a simplified limited company is a limited company; exclusions first
    form = F.col("legal_form")
    fits = has("forms_in", form) | ((form == "srls") & has("forms_in", F.lit("srl")))
    r.constraint("forms", "forms unknown", [
        (form.isNull(), "doubt", "legal form missing"),
        (has("forms_out", form), "exclude", "legal form excluded"),
        (~empty("forms_in") & ~fits & has("forms_in", F.lit("other")), "doubt", "other forms admitted"),
        (~empty("forms_in") & ~fits, "exclude", "legal form not admitted"),
        (empty("forms_in") & empty("forms_out"), "doubt", "forms in words"),
    ], missing(form.isNull()))
    # size
    r.constraint("sizes", "sizes unknown", [
        (F.col("__size").isNull(), "doubt", "size missing"),
        (empty("sizes"), "doubt", "sizes in words"),
        (has("sizes", F.col("__size")), "favour", "size admitted"),
        (has("sizes", F.col("__possible")), "doubt", "size depends on the balance sheet"),
        (F.lit(True), "exclude", "size not admitted"),
    ], missing(F.col("__size").isNull()))
    # activity codes: exclusions hold even without a constraint
    answer = lambda listed, value: F.exists(F.coalesce(listed, F.array()), lambda x: F.exists("codes", lambda c: code_covers(x, c) == value))
    no_code = empty("codes")
    same = F.lit(True)  # whether call and profile number activities alike
    if "codes_version" in cols:
        client = F.coalesce("p_codes_version", F.lit("2025")) if "p_codes_version" in cols else F.lit("2025")
        same = F.col("codes_version").isNull() | (F.col("codes_version") == client)
    r.decide([
        *([(no_code, "pass", "")] if partial else []),
        (no_code & ((state_of("codes") != UNCONSTRAINED) | ~empty("codes_out")), "doubt", "activity code missing"),
        (no_code, "pass", ""),
        (answer(F.col("codes_out"), "yes") & same, "exclude", "activity excluded"),
        (answer(F.col("codes_out"), "yes"), "doubt", "activity excluded in another version"),
        (state_of("codes") == UNCONSTRAINED, "pass", ""),
        (state_of("codes") == UNKNOWN, "doubt", "activities unknown"),
        (empty("codes_in") & empty("codes_out"), "doubt", "activities in words"),
        (empty("codes_in"), "pass", ""),
        (answer(F.col("codes_in"), "yes") & same, "favour", "activity admitted"),
        (answer(F.col("codes_in"), "yes"), "doubt", "activity admitted in another version"),
        (answer(F.col("codes_in"), "maybe"), "doubt", "only a part of the activity admitted"),
        (same, "exclude", "activity not admitted"),
        (F.lit(True), "doubt", "activity not found in another version"),
    ])
    # age in whole months
    months = F.col("__months")
    r.constraint("age", "age unknown", [
        (F.col("age_min").isNull() & F.col("age_max").isNull(), "doubt", "age in words"),
        (months.isNull(), "doubt", "founding date missing"),
        (months < F.col("age_min"), "exclude", "too young"),
        (months > F.col("age_max"), "exclude", "too old"),
    ], missing(months.isNull()))
    # requirements: a map of true, false or missing
    if not partial:
        known = lambda x: F.when((x == "new_company") & F.col("to_be_formed"), F.lit(True)).otherwise(F.try_element_at("requirements", x))
        state = state_of("requirements")
        r.constraint("requirements", "requirements unknown", [(empty("required"), "doubt", "requirements in words")])
        r.each((state == CONSTRAINED) & ~empty("required"), F.col("required"), [
            (lambda x: (x == "other") | known(x).isNull(), "doubt", "requirement to check"),
            (known, "favour", "requirements met"),
            (lambda x: F.lit(True), "exclude", "requirement not met"),
        ])
    r.each(F.lit(True), F.coalesce("bonus", F.array().cast("array<string>")), [(lambda x: F.coalesce(F.try_element_at("requirements", x), F.lit(False)), "favour", "bonus requirement")])
    # numeric ranges
    for field in ("staff", "turnover"):
        value, low, high = F.col(field), F.col(f"{field}_min"), F.col(f"{field}_max")
        r.constraint(field, "range unknown", [
            (low.isNull() & high.isNull(), "pass", ""),
            (value.isNull(), "doubt", f"{field} missing"),
            (value < low, "exclude", f"{field} below minimum"),
            (value > high, "exclude", f"{field} above maximum"),
        ], missing(value.isNull()))
    if {"amount_wanted", "spend_min"} <= cols:
        r.decide([(F.col("amount_wanted") < F.col("spend_min"), "doubt", "project below the least spend")])
    # completeness and state
    before = F.size(r.columns()["exclusions"]) > 0
    r.decide([
        (before | F.coalesce(F.col("completeness") == "official", F.lit(False)), "pass", ""),
        (F.col("completeness") == "summary", "doubt", "summary only"),
        (F.lit(True), "doubt", "no document read"),
    ])
    if not partial:
        r.decide([
            (F.col("state").isin("open", "coming"), "pass", ""),
            (F.col("state") == "closed", "exclude", "closed"),
            (F.lit(True), "doubt", "state unknown"),
        ])
    interests = sum((F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)) for a, b in (("topics", "p_topics"), ("spend", "p_spend"))), F.lit(0))
    out = pairs.withColumns(r.columns()).withColumn("interests", interests.cast("int"))
    far = ("a site must be opened", "the project belongs elsewhere", "territory unknown, call of another region")
    out_of_zone = F.exists("doubts", lambda d: d.isin(*far))
    if "p_sites" not in cols:
        local = ~empty("levels") & F.forall("levels", lambda x: x.isin(*LOCAL))
        somewhere = ~empty("p_regions") | ~empty("p_provinces")
        out_of_zone = out_of_zone | (state_of("territory") == UNKNOWN) & local & somewhere & ~overlap("p_provinces", "provinces") & ~overlap("p_regions", "regions")
    out = out.withColumns({"out_of_zone": F.coalesce(out_of_zone, F.lit(False)), "advice": advisory(cols)})
    level = F.when(F.size("exclusions") > 0, EXCLUDED).when(F.size("doubts") > 0, TO_VERIFY).otherwise(COMPATIBLE)
    heavy = F.size(F.filter("doubts", lambda d: ~d.isin(*LIGHT)))
    return out.withColumns({"level": level, "heavy_doubts": heavy}).drop("__size", "__possible", "__months")


def relevance(tie: str) -> list[Column]:
    """Order of results: level, zone, doubts (of those to verify), common interests, deadline, then tie."""
    level = F.when(F.col("level") == COMPATIBLE, 0).when(F.col("level") == TO_VERIFY, 1).otherwise(2)
    doubts = lambda c: F.when(F.col("level") == TO_VERIFY, c).otherwise(0)
    return [level.asc(), F.col("out_of_zone").asc(), doubts(F.col("heavy_doubts")).asc(), doubts(F.size("doubts")).asc(), F.col("interests").desc(), F.col("deadline").asc_nulls_last(), F.col(tie).asc()]


def _key(name: str, kind: T.DataType) -> Column:
    return F.array_sort(F.map_entries(name)) if isinstance(kind, T.MapType) else F.col(name)


def _areas(kind: str, *names: str) -> list[Column]:
    return [F.transform(F.coalesce(n, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), x)) for n in names]


def match(calls: DataFrame, profiles: DataFrame, today: Column, profile_cols: list[str], code: str = "code", keep_excluded: bool = True) -> DataFrame:
    """Every profile with every call, equal profiles evaluated once; without keep_excluded, excluded pairs are left out.

    Two profiles are equal if all their columns are (null equals null, maps compared by their sorted entries): the
    columns themselves are the key, no digest of them.  All pairs are what is asked for where keep_excluded; calls are
    broadcast if they are few, and else dealt in blocks.  Without excluded pairs, closed calls go first, and calls bound
    to a territory meet only profiles with a site there (by an equi-join on regions and provinces) or without any.
    """
    kinds = {f.name: f.dataType for f in profiles.schema.fields}
    keyed = profiles.select(code, F.struct(*[_key(c, kinds[c]).alias(c) for c in profile_cols]).alias("__profile"))
    unpack = {c: F.map_from_entries(f"__profile.{c}") if isinstance(kinds[c], T.MapType) else F.col(f"__profile.{c}") for c in profile_cols}
    distinct = keyed.select("__profile").distinct().withColumns(unpack)

    def all_pairs(some_calls: DataFrame, some_profiles: DataFrame) -> DataFrame:
        few = some_calls.count() <= BROADCAST_CALLS
        return some_profiles.crossJoin(F.broadcast(some_calls) if few else some_calls)

    if keep_excluded:
        done = evaluate(all_pairs(calls, distinct), today)
    else:
        lists = ~(empty("regions") & empty("provinces"))
        bound = (state_of("territory") == CONSTRAINED) & lists & ~F.coalesce(F.col("seat_rule") == "to_open", F.lit(False))
        calls = calls.filter(~F.coalesce(F.col("state") == "closed", F.lit(False))).withColumn("__bound", bound)
        nowhere = empty("p_regions") & empty("p_provinces")
        here = F.array_distinct(F.concat(*_areas("r", "regions", "province_regions"), *_areas("p", "provinces")))
        there = F.array_distinct(F.concat(*_areas("r", "p_regions"), *_areas("p", "p_provinces")))
        placed = calls.filter("__bound").withColumn("__here", here).withColumn("__area", F.explode("__here"))
        sited = distinct.filter(~nowhere).withColumn("__there", there).withColumn("__area", F.explode("__there"))
        near = sited.join(placed, "__area").filter(F.col("__area") == F.array_min(F.array_intersect("__here", "__there"))).drop("__area", "__here", "__there")
        pairs = near.unionByName(all_pairs(calls.filter("NOT __bound"), distinct)).unionByName(all_pairs(calls.filter("__bound"), distinct.filter(nowhere)))
        done = evaluate(pairs.drop("__bound"), today).filter(F.col("level") != EXCLUDED)
    return keyed.join(done, "__profile").drop("__profile")


def capped_benefit(amount: Column, size: Column, caps: dict[str, float]) -> Column:
    """An amount cut at what a company of this size can plausibly use."""
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return F.least(amount, F.coalesce(F.try_element_at(table, size), F.lit(max(caps.values()))))

"""Answers of interfaces: JSON taken apart by expressions alone, at any depth, in the order of the document.

A node is a value's text with its kind: { for an object, [ for a list, s for anything else.  Nested values are opened a
level at a time by a fold inside the row, so neither a bound on the depth nor a shuffle is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which an interface gives an announcement's fields, in the order in which they are tried
# (in any case), blocks whose keys count as the record's own, and keys of the text in a value that is an object.
JSON_KEYS = {
    "title": ["titolo", "title", "titolo_bando", "nome", "denominazione", "oggetto", "name", "label", "ntt_name_italian", "sys_title"],
    "url": ["url", "link", "@id", "href", "permalink", "url_bando", "pagina", "full_url", "sys_canonical_url", "alias"],
    "summary": ["description", "descrizione", "riassunto", "summary", "excerpt", "contenuto", "abstract", "sottotitolo",
                "sommario", "intro", "news_description", "txt_descr"],
    "published": ["effective", "published", "pubblicato_il", "data_notizia", "date", "data", "apertura_adesione",
                  "data_pubblicazione", "datapubblicazione", "publish_up", "data_apertura", "published_date",
                  "news_publication_date", "firstpublishedat", "publishedat", "startdate", "last_modified",
                  "modifiedon", "modified", "changed", "created"],
    "external_id": ["id", "codice_bando", "codice", "identifier", "UID", "productnumber", "slug", "codename"],
}
NESTED = ["attributes", "elements", "system", "metadata", "fields", "path", "categoria"]
WRAPPERS = ["rendered", "ita-IT", "it", "url", "href", "@id", "value", "text"]


@dataclass(frozen=True)
class Family:
    """How the answers of one kind of interface are read: where records lie, which are no announcements, where fields lie.

    records: names from the root to the list, none for the longest list of objects; skipped: values of @type;
    fields: paths by field, tried in turn, in place of the known keys; address: a template such as https://x/{a.b}.
    """

    records: tuple[str, ...] = ()
    skipped: tuple[str, ...] = ()
    fields: dict[str, list[str]] = field(default_factory=dict)
    address: str | None = None


# Paths of the families.
FAMILIES = {
    "generic": Family(),
    "wordpress": Family(),
    "plone": Family(("items",), ("Folder", "PNAnnouncementsContainer")),
    "opencity": Family(("searchHits",), fields={
        "title": ["metadata.name"], "url": ["metadata.link", "metadata.url"], "published": ["metadata.published", "metadata.modified"],
        "external_id": ["metadata.id"], "summary": ["data.ita-IT.abstract", "data.ita-IT.description", "data.abstract", "data.description"],
    }),
    "ckan": Family(("result", "results"), fields={
        "title": ["title", "name"], "summary": ["notes"], "published": ["metadata_modified"], "external_id": ["id"],
    }, address="https://www.dati.gov.it/view-dataset/dataset?id={id}"),
}

STATE = "struct<open:array<struct<at:array<int>,kind:string,text:string,nodes:array<struct<name:string,text:string,kind:string>>>>,best:struct<n:int,at:array<int>,text:string>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(text: Column, type_: Column) -> Column:
    """The kind of a value; a text that only looks like an object or a list is told by its variant type."""
    return F.when(type_ == "STRING", "s").when(text.startswith("{"), "{").when(text.startswith("["), "[").otherwise("s")


def root_kind(raw: Column) -> Column:
    first = F.regexp_extract(raw, r"^\s*([\[{])", 1)
    return F.when(first != "", first).otherwise("s")


def nodes(text: Column, kind: Column) -> Column:
    """name, text and kind of the values in an object or a list, in order; null for anything else and where it is no JSON."""
    object_, list_ = kind == "{", kind == "["
    named, typed = F.from_json(text, "map<string,string>"), F.from_json(text, "map<string,variant>")
    texts = F.when(object_, F.map_values(named)).when(list_, F.from_json(text, "array<string>"))
    values = F.when(object_, F.map_values(typed)).when(list_, F.from_json(text, "array<variant>"))
    types = F.transform(F.coalesce(values, F.array().cast("array<variant>")), F.schema_of_variant)
    both = F.zip_with(texts, types, lambda x, t: F.struct(x.alias("text"), kind_of(x, t).alias("kind")))
    names = F.when(object_, F.map_keys(named)).otherwise(F.array().cast("array<string>"))
    return F.zip_with(names, both, lambda n, b: F.struct(n.alias("name"), b["text"].alias("text"), b["kind"].alias("kind")))


def _folded(text: Column, kind: Column, picked: Callable[[Column], Column], found: Callable[[Column], Column]) -> Column:
    """The best of what found(open node) lists over all levels below a value, where only picked(open node) is opened.

    Places are counted downwards, so that of equally good finds the largest place is the first one in the document.
    """
    opened = lambda at, n: F.struct(at.alias("at"), n["kind"].alias("kind"), n["text"].alias("text"), nodes(n["text"], n["kind"]).alias("nodes"))
    start = F.struct(
        F.array(opened(F.array().cast("array<int>"), F.struct(text.alias("text"), kind.alias("kind")))).alias("open"),
        F.struct(F.lit(0).alias("n"), F.array(F.lit(1)).alias("at"), F.lit(None).cast("string").alias("text")).alias("best"),
    ).cast(STATE)

    def below(o: Column) -> Column:
        placed = F.transform(picked(o), lambda n, i: F.struct(F.concat(o["at"], F.array(-i)).alias("at"), n["text"].alias("text"), n["kind"].alias("kind")))
        return F.transform(F.filter(placed, lambda n: n["kind"] != "s"), lambda n: opened(n["at"], n))

    def step(s: Column, _: Column) -> Column:
        best = F.array_max(F.concat(F.array(s["best"]), F.flatten(F.transform(s["open"], found))))
        return F.when(F.size(s["open"]) == 0, s).otherwise(F.struct(F.flatten(F.transform(s["open"], below)).alias("open"), best.alias("best")).cast(STATE))

    levels = F.sequence(F.lit(1), F.length(F.regexp_replace(text, r"[^\[{]+", "")))  # as many as brackets: the depth at least
    return F.when(kind != "s", F.aggregate(levels, start, step)["best"]["text"])


def longest_list_text(raw: Column) -> Column:
    """The text of the longest list of objects at any depth of an answer; of equally long ones the first; null if there is none."""
    children = lambda o: F.coalesce(o["nodes"], F.array().cast("array<struct<name:string,text:string,kind:string>>"))

    def found(o: Column) -> Column:
        whole = (o["kind"] == "[") & (F.size(o["nodes"]) > 0) & F.forall(o["nodes"], lambda n: n["kind"] == "{")
        one = F.struct(F.size(o["nodes"]).alias("n"), F.concat(o["at"], F.array(F.lit(1))).alias("at"), o["text"].alias("text"))
        return F.when(whole, F.array(one)).otherwise(F.array().cast("array<struct<n:int,at:array<int>,text:string>>"))

    return _folded(raw, root_kind(raw), children, found)


def text_of(text: Column, kind: Column) -> Column:
    """The text of a value: a list's first element, an object's first known key, else its first text; never empty."""
    none = F.array().cast("array<struct<name:string,text:string,kind:string>>")

    def picked(o: Column) -> Column:
        known = F.array_min(F.transform(F.filter(o["nodes"], lambda n: n["name"].isin(*WRAPPERS)), lambda n: F.array_position(F.array(*map(F.lit, WRAPPERS)), n["name"])))
        wrapped = F.filter(o["nodes"], lambda n: n["name"] == F.get(F.array(*map(F.lit, WRAPPERS)), (known - 1).cast("int")))
        return F.coalesce(F.when(o["kind"] == "[", F.slice(o["nodes"], 1, 1)).when(known.isNotNull(), F.slice(wrapped, -1, 1)).otherwise(o["nodes"]), none)

    def found(o: Column) -> Column:
        texts = F.transform(picked(o), lambda n, i: F.struct(F.lit(1).alias("n"), F.concat(o["at"], F.array(-i)).alias("at"), F.when(n["kind"] == "s", stripped(n["text"])).alias("text")))
        return F.filter(texts, lambda x: x["text"].isNotNull())

    return bound(F.struct(text.alias("text"), kind.alias("kind")), lambda v: F.when(v["kind"] == "s", stripped(v["text"])).otherwise(_folded(v["text"], v["kind"], picked, found)))


def stripped(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(""))


def at_paths(parsed: Column, paths: list[str]) -> Column:
    """The texts of the values that dotted paths name in a variant, as a list; null where there is none."""
    steps = ["$" + "".join(f"[{part}]" if part.isdigit() else f'["{part}"]' for part in re.findall(r"[\w@-]+", p)) for p in paths]

    def text(v: Column) -> Column:
        return bound(F.try_variant_get(v, "$", "string"), lambda t: text_of(t, kind_of(t, F.schema_of_variant(v))))

    return F.transform(F.array(*[F.try_variant_get(parsed, p, "variant") for p in steps]), text)


def from_template(parsed: Column, template: str) -> Column:
    """An address by a template such as https://x/{slug} or https://x/{attributes.url}; null if one of its values is missing."""
    parts = re.split(r"\{([\w.\[\]]+)\}", template)
    if len(parts) == 1:
        return F.lit(template)
    return bound(at_paths(parsed, parts[1::2]), lambda v: F.concat(*[F.get(v, F.lit(i // 2)) if i % 2 else F.lit(p) for i, p in enumerate(parts)]))


def settled(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds a column which the optimizer does not compute anew in each filter and expression that uses it: a generated one."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def resolved(address: Column, base: str) -> Column:
    """An address as seen from base; steps such as ../ stay as they are written."""
    scheme, origin = re.match(r"[a-z]+:", base), re.match(r"[a-z]+://[^/?#]*", base)
    if not scheme or not origin:
        return address
    plain = re.sub(r"[?#].*", "", base)
    folder = plain[: plain.rindex("/") + 1] if "/" in plain[origin.end():] else origin[0] + "/"
    return (
        F.when(address.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), address).when(address.startswith("//"), F.concat(F.lit(scheme[0]), address))
        .when(address.startswith("/"), F.concat(F.lit(origin[0]), address)).when(address.startswith("#"), F.concat(F.lit(re.sub(r"#.*", "", base)), address))
        .when(address.startswith("?"), F.concat(F.lit(plain), address)).otherwise(F.concat(F.lit(folder), address))
    )


def known_fields(rows: DataFrame, raw: str, into: str) -> DataFrame:
    """Adds a struct of the announcement's fields by the known keys of one JSON object a row; nulls where it is none.

    A record's own key wins over those of its blocks, and of keys that differ by case the last; an empty value gives way to
    the next key of the field.  Numbers and truth values are given as JSON writes them.
    """
    own, every, first = f"{into}_own", f"{into}_every", f"{into}_first"
    keys = list(dict.fromkeys(k.lower() for names in JSON_KEYS.values() for k in names))
    rows = rows.withColumn(own, F.reverse(F.when(root_kind(F.col(raw)) == "{", nodes(F.col(raw), F.lit("{")))))

    none = F.array().cast("array<struct<name:string,text:string,kind:string>>")

    def block(name: Column) -> Column:
        return bound(F.get(F.filter(own, lambda n: n["name"] == name), F.lit(0)), lambda n: F.coalesce(F.reverse(nodes(n["text"], n["kind"])), none))

    named = lambda a: F.filter(F.transform(a, lambda n: F.struct(F.lower(n["name"]).alias("name"), n["text"].alias("text"), n["kind"].alias("kind"))), lambda n: n["name"].isin(*keys))
    rows = rows.withColumn(every, named(F.concat(own, F.flatten(F.transform(F.array(*map(F.lit, NESTED)), block)))))
    empty = lambda n: n["text"].isNull() | (n["text"] == "") | ((n["kind"] != "s") & n["text"].rlike(r"^[\[{]\s*[\]}]$"))
    rows = rows.withColumn(first, F.filter(F.filter(every, lambda n, i: F.array_position(F.col(f"{every}.name"), n["name"]) == i + 1), lambda n: ~empty(n)))

    def chosen(names: list[str]) -> Column:
        place = lambda n: F.array_position(F.array(*[F.lit(k.lower()) for k in names]), n["name"])
        ranked = F.transform(F.filter(first, lambda n: place(n) > 0), lambda n: F.struct(place(n).alias("place"), n["text"].alias("text"), n["kind"].alias("kind")))
        return F.array_min(ranked)

    texts = F.transform(F.array(*map(chosen, JSON_KEYS.values())), lambda v: text_of(v["text"], v["kind"]))
    fields = bound(texts, lambda x: F.struct(*[F.get(x, F.lit(i)).alias(f) for i, f in enumerate(JSON_KEYS)]))
    return settled(rows, fields, into).drop(own, every, first)


def records(answers: DataFrame, family: Family, raw: str = "raw", into: str = "item") -> DataFrame:
    """A row for each record of an answer, with its JSON text in ``into``; answers without records, or no JSON, give none."""
    text = F.col(raw)
    for name in family.records:
        text = F.try_element_at(F.from_json(text, "map<string,string>"), F.lit(name))
    items = F.from_json(text if family.records else longest_list_text(F.col(raw)), "array<string>")
    rows = answers.select("*", F.explode_outer(items).alias(into)).filter(F.col(into).isNotNull())
    if family.skipped:
        rows = rows.filter(~F.coalesce(F.get(at_paths(F.try_parse_json(F.col(into)), ["@type"]), F.lit(0)).isin(*family.skipped), F.lit(False)))
    return rows


def family_fields(rows: DataFrame, family: Family, raw: str, into: str) -> DataFrame:
    """Adds a struct of a record's fields: by the family's paths, else by the known keys; an address template goes first."""
    parsed, address = f"{into}_parsed", f"{into}_address"
    if family.fields or family.address:
        rows = rows.withColumn(parsed, F.try_parse_json(F.col(raw)))
    if family.address:
        rows = settled(rows, from_template(F.col(parsed), family.address), address)
    if family.fields:
        paths = [p for f in JSON_KEYS for p in family.fields.get(f, [])]
        by_field = lambda x, f: F.coalesce(*[F.get(x, F.lit(paths.index(p))) for p in family.fields.get(f, [])], F.lit(None).cast("string")).alias(f)
        rows = settled(rows, bound(at_paths(F.col(parsed), paths), lambda x: F.struct(*[by_field(x, f) for f in JSON_KEYS])), into)
    else:
        rows = known_fields(rows, raw, into)
    if family.address:
        rows = rows.withColumn(into, F.col(into).withField("url", F.coalesce(address, f"{into}.url")))
    return rows.drop(parsed, address)

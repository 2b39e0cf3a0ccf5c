"""Metadata documents of several shapes, read as VARIANT; fetching them is left to the caller."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UUID, text, trim
from ..operators.catalog import make_row


def doc(column: Column) -> Column:
    return F.try_parse_json(column)


def at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def as_array(v: Column) -> Column:
    """An array of variants from an array, a single value (one element) or null (none)."""
    many = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(many, F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))


def unwrapped(v: Column) -> Column:
    """Text of a value, of {"$": value}, or of the first of a list of those."""
    one = lambda x: F.coalesce(at(x, "$['$']", "string"), at(x, "$", "string"))
    return F.coalesce(one(F.get(as_array(v), F.lit(0))), F.lit(""))


def _plain(v: Column) -> Column:
    return F.coalesce(at(v, "$['@value']", "string"), at(v, "$", "string"), F.lit(""))


def _is_map(v: Column) -> Column:
    """An object that maps languages to texts (``{"@value": ..}`` is a text)."""
    return F.schema_of_variant(v).startswith("OBJECT") & at(v, "$['@value']").isNull()


def _languages(v: Column) -> Column:
    """For each language that has some, its first text; languages in order of their codes, as a VARIANT keeps no other."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.filter(F.transform(values, lambda x: F.get(F.transform(as_array(x), _plain), F.lit(0))), lambda x: x.isNotNull())


def label(v: Column) -> Column:
    """Text of a catalog label: of a map the first text of each language, of a list all, joined by blanks."""
    listed = F.array_join(F.transform(as_array(v), _plain), " ")
    return trim(F.when(_is_map(v), F.array_join(_languages(v), " ")).otherwise(listed))


def all_texts(v: Column) -> Column:
    """Text of a label: all that a map or list holds, joined by blanks."""
    values = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
    mapped = F.array_join(F.flatten(F.transform(values, lambda x: F.transform(as_array(x), _plain))), " ")
    return trim(F.when(_is_map(v), mapped).otherwise(F.array_join(F.transform(as_array(v), _plain), " ")))


def first_text(v: Column) -> Column:
    """Text of a manifest's label or value: the first that a map or list holds."""
    first = F.get(as_array(v), F.lit(0))
    inner = F.when(_is_map(first), F.get(_languages(first), F.lit(0))).otherwise(_plain(first))
    return F.coalesce(F.when(_is_map(v), F.get(_languages(v), F.lit(0))).otherwise(inner), F.lit(""))


def without_tags(column: Column) -> Column:
    return F.regexp_replace(text(column), "<[^>]+>", " ")


def mods(records: DataFrame, key: str, column: str) -> DataFrame:
    """publisher_text, year_text, title_text and places of MODS records (object or array at any level)."""
    m = at(doc(F.col(column)), "$.nyplAPI.response.mods")
    origins, titles = as_array(at(m, "$.originInfo")), as_array(at(m, "$.titleInfo"))
    first = lambda xs: F.coalesce(F.get(F.filter(xs, lambda x: x != ""), F.lit(0)), F.lit(""))
    primary = F.filter(titles, lambda t: at(t, "$.usage", "string") == "primary")
    chosen = F.coalesce(F.get(primary, F.lit(0)), F.get(titles, F.lit(0)))
    number = unwrapped(at(chosen, "$.partNumber"))
    title = F.concat_ws(" ", F.nullif(unwrapped(at(chosen, "$.title")), F.lit("")), F.nullif(number, F.lit("")))
    places = F.filter(F.flatten(F.transform(as_array(at(m, "$.subject")), lambda s: F.transform(as_array(at(s, "$.geographic")), unwrapped))), lambda x: x != "")
    dates = F.flatten(F.transform(origins, lambda o: F.transform(F.concat(as_array(at(o, "$.dateIssued")), as_array(at(o, "$.dateCreated"))), unwrapped)))
    return records.select(key, first(F.transform(origins, lambda o: unwrapped(at(o, "$.publisher")))).alias("publisher_text"), F.concat_ws(" ", first(dates), title).alias("year_text"), title.alias("title_text"), places.alias("places"), F.lit(None).cast("string").alias("error"))


def _rows(found: DataFrame, source: str, ident: Column, title: Column, year: Column, institution: str, city: str = "") -> DataFrame:
    return found.select(*make_row(F.lit(source), ident, title, year, F.lit(city), F.lit(institution)))


def collection_items(pages: DataFrame, column: str) -> DataFrame:
    """Catalog rows of a library's IIIF collection; items whose id holds no UUID are left out."""
    d = pages.select(F.explode(as_array(at(doc(F.col(column)), "$.items"))).alias("i"))
    ident = F.regexp_extract(text(at(F.col("i"), "$.id", "string")), f"({UUID})", 1)
    return _rows(d.where(ident != ""), "nypl", ident, label(at(F.col("i"), "$.label")), F.lit(""), "NYPL")


def _until(pages: DataFrame, page: str, ends: Column) -> DataFrame:
    """Pages up to the first that ends the listing; ends is asked of each page."""
    last = pages.where(ends).agg(F.min(page).alias("_last"))  # one row
    return pages.join(F.broadcast(last), F.coalesce(F.col(page) <= F.col("_last"), F.lit(True))).drop("_last")


def search_pages(pages: DataFrame, page: str, column: str, per: int = 200) -> DataFrame:
    """Items of a search's result pages, up to the first page that is empty or reaches ``numFound``; items without identifier are left out."""
    v = F.col("_v")
    docs = as_array(at(v, "$.response.docs"))
    d = pages.select(page, doc(F.col(column)).alias("_v"))
    ends = (F.size(docs) == 0) | (F.col(page) * per >= F.coalesce(at(v, "$.response.numFound", "long"), F.lit(0)))
    i = F.col("i")
    d = _until(d, page, ends).select(F.explode(docs).alias("i")).where(text(at(i, "$.identifier", "string")) != "")
    year = F.coalesce(F.nullif(at(i, "$.year", "string"), F.lit("")), at(i, "$.date", "string"), F.lit(""))
    return _rows(d, "ia", at(i, "$.identifier", "string"), label(at(i, "$.title")), year, "Internet Archive")


def with_fallback(items: DataFrame, single: DataFrame) -> DataFrame:
    """The collection's rows, or the single item's if there are none."""
    some = items.select(F.lit(1).alias("_some")).limit(1)
    return items.unionByName(single.join(some, F.lit(True), "left_anti"))


def congress_results(pages: DataFrame, column: str, page: str | None = None, per: int = 100) -> DataFrame:
    """Catalog rows of search results that are items or resources, texts only (or of no stated type).

    page: the page's number; pages after the first short one don't count.
    """
    v = F.col("_v")
    d = pages.select(*([page] if page else []), doc(F.col(column)).alias("_v"))
    if page:
        d = _until(d, page, F.size(as_array(at(v, "$.results"))) < per)
    i = F.col("i")
    kinds = F.transform(as_array(at(i, "$.type")), lambda x: F.lower(at(x, "$", "string")))
    ident = congress_id(F.coalesce(F.nullif(at(i, "$.id", "string"), F.lit("")), at(i, "$.url", "string"), F.lit("")))
    d = d.select(F.explode(as_array(at(v, "$.results"))).alias("i")).where((F.array_contains(kinds, "text") | (F.size(kinds) == 0)) & (ident != ""))
    return _rows(d, "loc", ident, label(at(i, "$.title")), text(at(i, "$.date", "string")), "Library of Congress")


def congress_item(documents: DataFrame, column: str, url: str) -> DataFrame:
    """The catalog row of each single item; its id is the one in the URL that was asked for."""
    v = at(doc(F.col(column)), "$.item")
    return _rows(documents, "loc", congress_id(F.col(url)), label(at(v, "$.title")), text(at(v, "$.date", "string")), "Library of Congress")


def congress_id(url: Column) -> Column:
    """The item's bare id, or '' for what is no item or resource."""
    return F.regexp_extract(url, r"loc\.gov/(?:item|resource)/([^/?#]+)", 1)


def iiif(documents: DataFrame, column: str, url: str) -> DataFrame:
    """Catalog rows of a collection's members that have an id, or of the manifest itself under the URL that was asked for."""
    v = F.col("_v")
    d = documents.select(url, doc(F.col(column)).alias("_v"))
    kind = F.coalesce(F.nullif(at(v, "$.type", "string"), F.lit("")), at(v, "$['@type']", "string"), F.lit(""))
    is_collection = F.contains(kind, F.lit("Collection"))
    i = F.col("i")
    ident = F.coalesce(F.nullif(at(i, "$.id", "string"), F.lit("")), at(i, "$['@id']", "string"), F.lit(""))
    items = as_array(at(v, "$.items"))
    members = F.when(F.size(items) > 0, items).otherwise(as_array(at(v, "$.manifests")))
    of_collections = d.where(is_collection).select(F.explode(members).alias("i")).where(ident != "")
    rows = _rows(of_collections, "iiif", ident, label(at(i, "$.label")), F.lit(""), "")
    return rows.unionByName(_rows(d.where(~is_collection & v.isNotNull()), "iiif", F.col(url), label(at(v, "$.label")), F.lit(""), ""))


def canvases(manifests: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, canvas, service, image, width, height, label (its place if it has none) of each canvas, of versions 2 and 3."""
    v = doc(F.col(column))
    d = manifests.select(key, F.posexplode(F.coalesce(F.try_variant_get(v, "$.sequences[0].canvases", "array<variant>"), F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "c"))
    c = F.col("c")
    body = F.coalesce(at(c, "$.images[0].resource"), at(c, "$.items[0].items[0].body"))
    service = F.get(as_array(at(body, "$.service")), F.lit(0))
    either = lambda x, *names: F.coalesce(*[at(x, f"$['{n}']", "string") for n in names])
    return d.select(key, "pos", either(c, "id", "@id").alias("canvas"), either(service, "id", "@id").alias("service"), either(body, "id", "@id").alias("image"), at(c, "$.width", "int").alias("width"), at(c, "$.height", "int").alias("height"), F.coalesce(F.when(at(c, "$.label").isNotNull(), first_text(at(c, "$.label"))), F.col("pos").cast("string")).alias("label"))


def image_url(service: Column, image: Column, width: int = 1300) -> Column:
    return F.when(text(service) != "", F.concat(F.rtrim(service, F.lit("/")), F.lit(f"/full/{width},/0/default.jpg"))).otherwise(image)


def manifest_url(source: Column, ident: Column) -> Column:
    """Where a volume's manifest is; null for sources that aren't known."""
    source, ident = F.lower(trim(text(source))), trim(text(ident))
    return (
        F.when(source == "nypl", F.concat(F.lit("https://api-collections.nypl.org/manifests/"), ident))
        .when(source == "ia", F.concat(F.lit("https://iiif.archive.org/iiif/"), ident, F.lit("/manifest.json")))
        .when((source == "loc") & ~F.startswith(ident, F.lit("http")), F.concat(F.lit("https://www.loc.gov/item/"), ident, F.lit("/manifest.json")))
        .when(source.isin("loc", "iiif"), ident)
    )


def fetched(volumes: DataFrame, cache: DataFrame, fetch, tries: int = 3, wait: float = 1.5) -> DataFrame:
    """source, id, body and error of each volume's manifest: from the cache if that has more than 100 bytes, else by ``fetch(url)``.

    A fetch that raises is tried again after ``wait`` seconds, then twice that, and so on; after the last try its error is
    kept and the body is null.  volumes: source and id; cache: source, id and body, a row for each.
    """

    def get(url):
        for k in range(tries):
            try:
                return fetch(url), None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(wait * (k + 1) if k + 1 < tries else 0)
        return None, error

    def run(frames):
        for frame in frames:
            got = [(None, "unknown source") if url is None else get(url) for url in frame["url"]]
            yield frame[["source", "id"]].assign(body=[b for b, _ in got], error=[e for _, e in got])

    known = cache.where(F.length("body") > 100).select("source", "id", "body")
    todo = volumes.select("source", "id").distinct().join(known, ["source", "id"], "left_anti").withColumn("url", manifest_url(F.col("source"), F.col("id")))
    new = todo.mapInPandas(run, "source string, id string, body string, error string")
    return known.join(volumes.select("source", "id"), ["source", "id"], "left_semi").withColumn("error", F.lit(None).cast("string")).unionByName(new)


def manifest_meta(manifests: DataFrame, key: str, column: str) -> DataFrame:
    """key, manifest_id, title (all of the label's texts), first_title, year and identifier (the first that aren't empty), and
    the metadata as a map of labels to all their texts."""
    v = doc(F.col(column))
    pairs = F.transform(as_array(at(v, "$.metadata")), lambda m: F.struct(F.lower(first_text(at(m, "$.label"))).alias("k"), all_texts(at(m, "$.value")).alias("v"), first_text(at(m, "$.value")).alias("first")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    one = lambda name: F.coalesce(F.get(F.filter(pairs, lambda p: (p["k"] == name) & (p["first"] != "")), F.lit(0))["first"], F.lit(""))
    ident = F.coalesce(F.nullif(at(v, "$.id", "string"), F.lit("")), at(v, "$['@id']", "string"), F.lit(""))
    entries = F.transform(last, lambda p: F.struct(p["k"].alias("key"), p["v"].alias("value")))
    return manifests.select(key, ident.alias("manifest_id"), all_texts(at(v, "$.label")).alias("title"), first_text(at(v, "$.label")).alias("first_title"), one("date").alias("year"), one("identifier").alias("identifier"), F.map_from_entries(entries).alias("meta"))


def haystack(folder: Column, manifest_id: Column, identifier: Column) -> Column:
    """What a volume's id is looked for in, in lower case."""
    return F.lower(F.concat_ws(" ", folder, text(manifest_id), text(identifier)))


def contributors(documents: DataFrame, key: str, column: str) -> DataFrame:
    """id and contributor, uploader, collection as arrays of text."""
    v = doc(F.col(column))
    texts = lambda n: F.transform(as_array(at(v, f"$.result.{n}")), lambda x: F.coalesce(at(x, "$", "string"), F.lit("")))
    return documents.select(F.col(key).alias("id"), *[texts(n).alias(n) for n in ("contributor", "uploader", "collection")])

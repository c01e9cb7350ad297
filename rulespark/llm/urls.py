"""URL filters with redirect equivalence.

Pages that redirect to each other, or name another page as canonical, are one resource under several
addresses. Addresses are nodes, a page's ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``
are edges, and connected components make the classes. Tags are read as a browser reads them: not in
comments, scripts and other raw text, attributes by their whole names and quotes, numeric character
references and the five that XML names, ``<base>``, and dots in paths. A ``>`` within quotes ends a tag
here. A rule decides the addresses it fits. An
address that no rule fits takes the decision of its class: allow if a rule allows any member (an
explicit allow goes before a block), block if a rule blocks any member, and allow otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions.text import bound

from .components import connected_components
from .scratch import Scratch

#: (verdict, rule): host, then path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: Elements whose content holds no tags.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in RAW)
_TAG = r"(?is)<{}[\s/]([^>]*)>"
_ATTRIBUTE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
_TARGET = r"""(?is)(?:^|[\s;,])url\s*=\s*["']?\s*([^"'\s]+)"""
_REFERENCE = r"(?is)&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|amp|lt|gt|quot|apos);|[^&]+|&"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The node of a url: scheme and host in lower case, without the fragment."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    return F.concat(lowered(F.regexp_extract(plain, r"(?s)^(.*?://[^/?]*)", 1)), F.regexp_replace(plain, r"(?s)^.*?://[^/?]*", ""))


def without_dots(url: Column) -> Column:
    """The url with ``.`` and ``..`` segments of its path taken away, as a browser does."""
    origin, path, rest = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1)
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))).otherwise(F.concat(kept, F.array(s)))
    parts = F.slice(F.split(path, "/"), 2, F.greatest(F.lit(1), F.size(F.split(path, "/"))))
    folder = F.when(path.rlike(r"/\.{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), folder)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(origin, F.lit("/"), F.array_join(kept, "/"), rest)).otherwise(url)


#: The references that XML names.
ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def unescaped(value: Column) -> Column:
    """A value with its character references read, each once; numbers that are no character stay."""

    def read(part: Column) -> Column:
        low = F.lower(part)
        number = F.when(low.startswith("&#x"), F.conv(F.regexp_extract(low, r"^&#x([0-9a-f]+);$", 1), 16, 10)).when(low.startswith("&#"), F.regexp_extract(low, r"^&#([0-9]+);$", 1))
        code = F.nullif(number, F.lit("")).cast("long")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        out = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), char)
        for name, plain in ENTITIES.items():
            out = out.when(low == name, F.lit(plain))
        return out.otherwise(part)

    return F.when(~value.contains("&"), value).otherwise(F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), 0), read), ""))


def tags(html: Column, name: str) -> Column:
    """The attributes of each tag of that name, as they are written."""
    return F.regexp_extract_all(html, F.lit(_TAG.format(name)), 1)


def attribute(written: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name, without quotes and outer white space, references read; blank without one."""

    def value(s: Column) -> Column:
        raw = F.coalesce(F.get(s["values"], (F.array_position(s["names"], name) - 1).cast("int")), F.lit(""))
        return bound(raw, lambda r: bound(F.when(r.startswith('"') | r.startswith("'"), F.substring(r, F.lit(2), F.length(r) - 2)).otherwise(r), lambda v: F.regexp_replace(unescaped(v), r"^\s+|\s+$", "")))

    found = lambda group: F.regexp_extract_all(written, F.lit(_ATTRIBUTE), group)
    return bound(F.struct(F.transform(found(1), lowered).alias("names"), found(2).alias("values")), value)


def resolved(base: Column, link: Column) -> Column:
    """A link against the page's url: absolute, scheme-relative, rooted, query-only or relative to the folder."""
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(path_of(base), F.lit("")), r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path_of(base), link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, or null; earlier rules go before later ones of that length."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def edges_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): addresses joined by a canonical or refresh link; null, empty and self links are left out."""
    html = F.regexp_replace(F.coalesce(F.col(html_col).cast("string"), F.lit("")), _UNREAD, " ")
    read = pages.select(F.col(url_col).cast("string").alias("url"), html.alias("html")).filter("url is not null")
    words = lambda v: F.split(lowered(v), r"\s+")
    canonical = F.transform(F.filter(tags(F.col("html"), "link"), lambda t: F.array_contains(words(attribute(t, "rel")), "canonical")), lambda t: attribute(t, "href"))
    refresh = F.transform(F.filter(tags(F.col("html"), "meta"), lambda t: lowered(attribute(t, "http-equiv")) == "refresh"), lambda t: F.regexp_extract(attribute(t, "content"), _TARGET, 1))
    bases = F.filter(F.transform(tags(F.col("html"), "base"), lambda t: attribute(t, "href")), lambda v: v != "")
    links = read.select("url", F.coalesce(F.get(bases, F.lit(0)), F.lit("")).alias("base"), F.explode(F.concat(canonical, refresh)).alias("link")).filter("link <> ''")
    # each step is bound in a lambda: written out, the steps would repeat each other many times over
    base = lambda s: F.when(s["base"] == "", s["url"]).otherwise(bound(resolved(s["url"], s["base"]), without_dots))
    joined = lambda s: bound(F.struct(base(s).alias("base"), s["link"].alias("link")), lambda t: resolved(t["base"], t["link"]))
    target = bound(bound(F.struct("url", "base", "link"), joined), without_dots)
    return links.select(address(F.col("url")).alias("a"), bound(target, address).alias("b")).filter("a <> b and a <> '' and b <> ''")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, host, path, rule, verdict, address, component) for every row; ``row`` is the input row.

    A null url, or one without ``://``, has an empty host and path, fits no rule, has no aliases and
    is allowed. Repeated rows are judged alike. Links to addresses that are no page still join the
    pages that name them, and are themselves judged by the rules. An empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    tmp = Scratch(pages.sparkSession, "urls")
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    comps = connected_components(edges_of(pages, url_col, html_col), tmp)
    judged = comps.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    classes = judged.groupBy("component").agg(F.bool_or(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"), F.bool_or(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"))
    # a table of its own, so that a page address that very many rows have can be split in the join
    aliases = tmp.save(comps.join(classes, "component").select(F.col("node").alias("_node"), "component", "allowed", "blocked"))
    # rows without an address have no aliases, and are not all dealt to one task
    key = F.when(F.col("address") == "", F.concat(F.lit("\x00"), F.monotonically_increasing_id().cast("string"))).otherwise(F.col("address"))
    out = rows.withColumn("_key", key).join(aliases, F.col("_key") == F.col("_node"), "left")
    inherited = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow")
    return out.select("row", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", inherited).alias("verdict"), "address", F.coalesce("component", "address").alias("component"))

"""Block and allow rules for page addresses, carried over to their aliases.

A page names its aliases by a canonical link or a refresh to another address; a crawl may
add redirects. Addresses joined that way are equivalent: the components of that graph. An
address that no rule fits takes its component's decision: allow if a rule allows one of its
addresses, else block if a rule blocks one, else allow.

The rules are a short list, a parameter, and become one expression. Only addresses with an
alias enter the graph; a component of any size is labelled by minima (``components``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import column, components, written

# (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Tags that name an alias, the base of relative links, and where in a tag the address stands.
CANONICAL = "(?is)<link\\b[^>]*\\brel\\s*=\\s*(?:[\"'][^\"'>]*\\bcanonical\\b|canonical\\b)[^>]*>"
REFRESH = "(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"']?\\s*refresh\\b[^>]*>"
BASE = "(?is)<base\\b[^>]*\\bhref\\b[^>]*>"
HREF = "(?is)\\bhref\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
TARGET = "(?is)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"
# Named references that an address may hold (fixed values); the first four may lack the semicolon.
REFERENCES = {
    "amp": "&", "quot": '"', "lt": "<", "gt": ">", "apos": "'", "sol": "/", "colon": ":", "period": ".", "quest": "?",
    "num": "#", "equals": "=", "lowbar": "_", "percnt": "%", "commat": "@", "plus": "+", "comma": ",", "semi": ";",
}
BARE = ("amp", "quot", "lt", "gt")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty for a null url or one without ://."""
    rest = F.coalesce(F.regexp_extract(url, "(?s)://(.*)", 1), F.lit(""))
    return (
        F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER),
        F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    )


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does.

    A rule fits its host and the hosts below it, if the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last tested is the first to count.
    for decision, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def decoded(text: Column) -> Column:
    """The text with its numeric references, and the named ones listed above, read."""

    def one(part: Column) -> Column:
        """What follows an ampersand."""
        hexadecimal = F.regexp_extract(part, "^#[xX]([0-9a-fA-F]{1,6})", 1)
        decimal = F.regexp_extract(part, "^#([0-9]{1,7})", 1)
        number = F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10)).when(decimal != "", F.conv(decimal, 10, 10)).cast("long")
        letter = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        out = F.when(number.isNull(), F.concat(F.lit("&"), part)).otherwise(
            F.concat(letter, F.regexp_replace(part, "^#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", ""))
        )
        for name, value in REFERENCES.items():
            end = ";?" if name in BARE else ";"
            out = F.when(part.rlike(f"^{name}{end}"), F.concat(F.lit(value), F.regexp_replace(part, f"^{name}{end}", ""))).otherwise(out)
        return out

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(text.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def without_dots(path: Column) -> Column:
    """A path without . and .. segments, query and fragment as they are."""
    names = F.regexp_extract(path, "^[^?#]*", 0)
    tail = F.substring(path, F.length(names) + 1, F.length(path))

    def step(done: Column, name: Column) -> Column:
        back = F.regexp_replace(done, "/[^/]*$", "")
        return F.when(name == "..", back).when(name == ".", done).otherwise(F.concat(done, F.lit("/"), name))

    segments = F.split(F.regexp_replace(names, "^/", ""), "/")
    clean = F.concat(F.aggregate(segments, F.lit(""), step), F.when(names.rlike("/\\.\\.?$"), "/").otherwise(""))
    return F.when(names.rlike("/\\.\\.?(/|$)"), F.concat(clean, tail)).otherwise(path)


def address(url: Column) -> Column:
    """What names a page: host, path and query. Scheme and fragment don't; null without a host."""
    host, _ = host_and_path(url)
    tail = F.regexp_extract(url, "(?s)://[^/?#]*([^#]*)", 1)
    return F.when(host != "", F.concat(host, without_dots(tail)))


def absolute(link: Column, base: Column) -> Column:
    """A link's address, seen from the page ``base``; null if it names no other page of the web."""
    host, path = host_and_path(base)
    site = F.when(host != "", F.concat(F.lit("http://"), host))
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "^/", ""))
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), link)
        .when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, folder, link))
    )


def _links(page: Column, words: tuple[str, str], tag: str, place: str) -> Column:
    """What all tags of a kind name, decoded and trimmed."""
    # Most pages have none of the words, which is found out much sooner than a tag.
    tags = F.when(page.contains(words[0]) | page.contains(words[1]), F.regexp_extract_all(page, F.lit(tag), F.lit(0)))

    def named(found: Column) -> Column:
        raw = F.regexp_replace(F.regexp_extract(found, place, 1), "^[\"']|[\"']$", "")
        return F.trim(decoded(raw))

    return F.coalesce(F.transform(tags, named), F.array().cast("array<string>"))


def judge(
    pages: DataFrame,
    rules=RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``redirects`` has (source, target) urls of a crawl. Null ids, urls and pages are kept: a
    url that is null or has no :// has neither host nor aliases. Repeated rows are judged
    alike. All canonical links and refreshes of a page count; relative ones are seen from its url, or from
    its base element. An empty table gives none.
    """
    spark = pages.sparkSession
    page = column(html_col)
    url = column(url_col)
    host, path = host_and_path(url)
    rows = pages.select(
        column(id_col).cast("long").alias("page_id"),
        url.alias("url"),
        host.alias("host"),
        path.alias("path"),
        F.concat(
            _links(page, ("anonical", "ANONICAL"), CANONICAL, HREF), _links(page, ("efresh", "EFRESH"), REFRESH, TARGET)
        ).alias("links"),
        F.get(_links(page, ("<base", "<BASE"), BASE, HREF), F.lit(0)).alias("base"),
    )
    base = F.coalesce(absolute(F.col("base"), F.col("url")), F.col("url"))
    rows = rows.select(
        "page_id",
        "host",
        "path",
        address(F.col("url")).alias("node"),
        F.transform("links", lambda link: address(absolute(link, base))).alias("aliases"),
    )
    rows = written(rows, "url-pages")

    links = rows.select(F.col("node").alias("u"), F.explode("aliases").alias("v"))
    if redirects is not None:
        links = links.unionAll(
            redirects.select(address(F.col("source")).alias("u"), address(F.col("target")).alias("v"))
        )
    links = links.where("u <> v").distinct()
    members = components(spark, links, "url-components")

    node_url = F.concat(F.lit("http://"), F.col("node"))
    decision = longest_rule(*host_and_path(node_url), rules)[1]
    members = members.withColumn("decision", decision)
    decided = (
        members.where("decision is not null")
        .groupBy("root")
        .agg(F.min("decision").alias("decision"))  # "allow" comes before "block"
    )
    inherited = members.select("node", "root").join(decided, "root").select("node", "decision")
    inherited = written(inherited, "url-inherited")

    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return (
        rows.select("page_id", "host", "path", "node", rule.alias("rule"), verdict.alias("own"))
        .join(inherited, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("own", "decision", F.lit("allow")).alias("verdict"),
        )
    )


def _oracle() -> str:
    """The same in SQL: rules by cases, one row a link, paths cleaned from a list, components by walking the links."""

    def parsed(u: str) -> tuple[str, str]:
        rest = f"CASE WHEN contains({u}, '://') THEN {u}[strpos({u}, '://') + 3:] ELSE '' END"
        return (
            f"translate(regexp_extract({rest}, '^[^/?#]*'), '{UPPER}', '{LOWER}')",
            f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)",
        )

    def case(value, host: str, path: str) -> str:
        whens = " ".join(
            f"WHEN ({host} = '{h}' OR suffix({host}, '.{h}')) AND prefix({path}, '{p}') THEN '{value((d, h, p))}'"
            for d, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
        )
        return f"CASE {whens} END"

    def node(u: str) -> str:
        """Host, segments that are left when each .. takes the one before it, and query."""
        host, path = parsed(u)
        query = f"regexp_extract({u}, '(?s)://[^/?#]*[^?#]*([?][^#]*)', 1)"
        parts = f"string_split({path}, '/')"
        kept = (
            f"list_reduce(list_transform({parts}, lambda s: [s]), lambda a, s:"
            " CASE WHEN s[1] = '..' THEN a[:greatest(len(a) - 1, 1)] WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END)"
        )
        closed = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END"
        return f"CASE WHEN {host} <> '' THEN {host} || array_to_string({kept}, '/') || {closed} || {query} END"

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def decode(x: str) -> str:
        names = " ".join(
            f"WHEN regexp_matches(p, '^{n}{';?' if n in BARE else ';'}') THEN {quoted(v)} || regexp_replace(p, '^{n};?', '')"
            for n, v in REFERENCES.items()
        )
        return f"""array_to_string(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p
          WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]') THEN chr(CAST('0x' || regexp_extract(p, '^#.([0-9a-fA-F]{{1,6}})', 1) AS INT))
            || regexp_replace(p, '^#.[0-9a-fA-F]{{1,6}};?', '')
          WHEN regexp_matches(p, '^#[0-9]') THEN chr(CAST(regexp_extract(p, '^#([0-9]{{1,7}})', 1) AS INT))
            || regexp_replace(p, '^#[0-9]{{1,7}};?', '') {names} ELSE '&' || p END), '')"""

    def seen(link: str, site: str, path: str) -> str:
        return f"""CASE WHEN {link} = '' OR prefix({link}, '#') THEN NULL
          WHEN regexp_matches({link}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN regexp_matches({link}, '^[^:]*://') THEN {link} END
          WHEN prefix({link}, '//') THEN 'http:' || {link} WHEN prefix({link}, '/') THEN 'http://' || {site} || {link}
          WHEN prefix({link}, '?') THEN 'http://' || {site} || {path} || {link}
          ELSE 'http://' || {site} || regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '[^/]*$', '') || {link} END"""

    def named(tag: str, place: str) -> str:
        """What the tags of a kind name, quotes off."""
        return f"""list_transform(regexp_extract_all(html, {quoted(tag)}), lambda t:
          regexp_replace(regexp_extract(t, {quoted(place)}, 1), '^["'']|["'']$', '', 'g'))"""

    host, path = parsed("url")
    ohost, opath = parsed("origin")
    nhost, npath = parsed("('http://' || b)")
    return f"""
    WITH RECURSIVE p AS (
        SELECT page_id, url, html, {host} AS host, {path} AS path, {node('url')} AS node FROM pages),
    o AS (SELECT *, trim({decode(f"coalesce({named(BASE, HREF)}[1], '')")}) AS base FROM p),
    f AS (SELECT *, coalesce({seen('base', "nullif(host, '')", 'path')}, url) AS origin FROM o),
    r AS (SELECT node, {ohost} AS host, {opath} AS path,
        unnest(list_concat({named(CANONICAL, HREF)}, {named(REFRESH, TARGET)})) AS raw FROM f),
    t AS (SELECT node, host, path, trim({decode('raw')}) AS link FROM r),
    g AS (SELECT node, {seen('link', "nullif(host, '')", 'path')} AS target FROM t),
    l AS (SELECT DISTINCT node AS a, {node('target')} AS b FROM g),
    e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
    w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
    d AS (SELECT a, min({case(lambda r: r[0], nhost, npath)}) AS decision FROM w GROUP BY a)
    SELECT page_id, host, path, {case(lambda r: r[1] + r[2], 'host', 'path')} AS rule,
           coalesce({case(lambda r: r[0], 'host', 'path')}, decision, 'allow') AS verdict
    FROM p LEFT JOIN d ON p.node = d.a
    """


ORACLE = _oracle()

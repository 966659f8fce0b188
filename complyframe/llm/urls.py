"""URL filters: host and path rules, carried along redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complyframe.llm.components import components
from complyframe.llm.shared import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are followed; none leads above the root."""
    segments = F.split(F.regexp_replace(path, r"/(\.\.?)\z", "/$1/"), "/")

    def follow(way: Column, segment: Column) -> Column:
        up = F.regexp_replace(way, r"/[^/]*\z", "")
        return F.when(segment == ".", way).when(segment == "..", up).otherwise(F.concat(way, F.lit("/"), segment))

    followed = F.aggregate(F.slice(segments, 2, F.size(segments)), F.lit(""), follow)
    return F.when(path.rlike(r"/\.\.?(/|\z)"), followed).otherwise(path)


def node_of(url: Column) -> Column:
    """A URL without fragment and dot segments, scheme and host in lower case; null if it has no ``://``."""
    parts = r"(?s)^(.*?://[^/?#]*)([^?#]*)([^#]*)"
    site, path, query = (F.regexp_extract(url, parts, k) for k in (1, 2, 3))
    return F.when(F.contains(url, F.lit("://")), F.concat(F.translate(site, UPPER, LOWER), without_dots(path), query))


#: Named character references that stand in URLs.
REFERENCES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'"}


def unescaped(text: Column) -> Column:
    """Text with character references decoded; what is none, or names no character, stays."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-z]+;|[^&]+|&"), F.lit(0))

    def decoded(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^&#([0-9]+);\z", 1).try_cast("int")
        code = F.coalesce(decimal, F.conv(F.nullif(F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);\z", 1), F.lit("")), 16, 10).try_cast("int"))
        character = F.when(
            code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        )
        for name, meant in REFERENCES.items():
            character = character.when(piece == name, meant)
        return character.otherwise(piece)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def ruled(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``rule`` and ``own`` (its verdict) by ``host`` and ``path``: the longest rule that fits.

    A rule fits its host and all subdomains, if the path starts with its own.
    Between rules of one length an allow goes first.
    """
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = (F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))
        fits &= F.startswith("path", F.lit(path))
        rule, own = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(own)
    return df.withColumns({"rule": rule, "own": own})


def _resolved(base: Column, link: Column) -> Column:
    """An absolute URL for a link found at ``base``; null for schemes without ``//``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(link, F.lit("#")), base)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(src, dst) of each page's canonical link and each redirect by ``meta refresh``.

    Both are read off the page itself, whole, with character references decoded,
    and start from its first ``base href`` if it has one. Tags without a target,
    and pages whose URL is null or has no ``://``, give no edge.
    """
    based = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
    target = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""
    tags = F.regexp_extract_all(html_column, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = pages.where(F.col(html_column).rlike(r"(?i)<link\b|<meta\b[^>]*http-equiv")).select(
        F.col(url_column).alias("_url"),
        F.regexp_extract(html_column, based, 1).alias("_based"),
        F.explode(tags).alias("_tag"),
    )
    link = F.when(
        F.col("_tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), F.regexp_extract("_tag", target, 1)
    ).when(
        F.col("_tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("_tag", refresh, 1)
    )
    # Each step is written: a filter pushed below them would repeat every expression many times over.
    raw = stored(found.select("_url", "_based", link.alias("_link")).where("_link <> ''"), "tags")
    read = stored(raw.select("_url", unescaped(F.col("_based")).alias("_based"), unescaped(F.col("_link")).alias("_link")), "decoded")
    based_on = F.when(F.col("_based") != "", _resolved(F.col("_url"), F.col("_based")))
    bases = stored(read.select("_url", "_link", based_on.alias("_base")), "bases")
    base = F.when(F.contains("_base", F.lit("://")), F.col("_base")).otherwise(F.col("_url"))
    bases = stored(bases.select("_url", "_link", base.alias("_base")), "starts")
    targets = stored(bases.select("_url", _resolved(F.col("_base"), F.col("_link")).alias("_target")), "targets")
    ends = stored(targets.select(node_of(F.col("_url")).alias("src"), node_of(F.col("_target")).alias("dst")), "edges")
    return ends.where("src IS NOT NULL AND dst IS NOT NULL")


def judge(
    pages: DataFrame,
    edges: DataFrame | None = None,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict.

    A URL's own rule decides, so an explicit allow holds whatever its aliases
    are. URLs without one are blocked if a URL of their component, over the
    ``edges`` (src, dst: redirects and canonical links, by default those in the
    pages), has a block rule of its own; else they are allowed. A target that is
    no page itself is judged and passes its block on, too. A URL's own rule goes
    by its path as it stands, its aliases' by paths without dot segments.

    A null URL and one without ``://`` have empty host and path, fit no rule and
    have no alias. Repeated rows and URLs are judged alike; other columns are
    dropped.
    """
    if edges is None:
        edges = links(pages, url_column, html_column)
    parts = pages.select(
        F.col(id_column).alias("page_id"),
        host_of(F.col(url_column)).alias("host"),
        path_of(F.col(url_column)).alias("path"),
        node_of(F.col(url_column)).alias("_node"),
    )
    parts = ruled(parts, rules)
    edges = stored(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    if edges.isEmpty():
        verdict = F.coalesce("own", F.lit("allow"))
        return parts.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    groups = components(edges)
    nodes = ruled(groups.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    blocked = nodes.where("own = 'block'").select("component").distinct()
    aliases = nodes.where("own IS DISTINCT FROM 'allow'").join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit("block").alias("_passed"))
    verdict = F.coalesce("own", "_passed", F.lit("allow"))
    return parts.join(aliases, "_node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))

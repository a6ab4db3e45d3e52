"""URL rules with redirect equivalence.

A rule names a host and a path and allows or blocks; it fits its host and all
subdomains when the path of a url starts with the rule's path, and the longest
fitting rule wins. What no rule fits is judged by its aliases: redirect and
canonical-link edges connect pages, connected components are found in the table
of edges, and a decision of any member holds for the members without one, an
explicit allow before a block. Pages that nothing decides are allowed.

Targets are resolved against the url of their page, or against its base element
where it has one; ``.`` and ``..`` segments of relative targets are resolved, and
urls that stand whole keep them.

All work is DataFrame expressions and joins.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule and has no aliases; a null page is one without links; repeated rows get
the same verdict each; an empty table gives an empty result. Columns besides id,
url and html are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import cut_lineage
from cohortwise.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """What names a page: the url without its fragment, scheme and host in lower case; null where there is none."""
    at = F.instr(url, "://")
    plain = F.regexp_extract(url, r"\A([^#]*)", 1)
    host = F.length(F.regexp_extract(_rest(url), r"\A([^/?#]*)", 1))
    head = at + F.lit(2) + host
    return F.when(at > 0, F.concat(lower_ascii(F.substring(plain, F.lit(1), head)), F.substring(plain, head + 1, F.length(plain))))


def _without_dots(segments: Column) -> Column:
    """An absolute path, split at its slashes, without its ``.`` and ``..`` segments."""
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments) - 1),
        F.array().cast("array<string>"),
        lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.array_append(held, x)),
    )
    end = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), end), r"\A//\z", "/")


def resolved(table: DataFrame, target: str, base: str) -> DataFrame:
    """Column ``target`` as it stands when it names a scheme, else as seen from the url in ``base``; null where that has no ``://``.

    Each step is a projection of its own: nested in one, the expressions would multiply.
    """
    names, t, u = table.columns, F.col(target), F.col(base)
    steps = table.withColumns(
        {
            "__at": F.instr(u, "://"),
            "__plain": F.regexp_extract(u, r"\A([^#]*)", 1),
            "__authority": F.regexp_extract(_rest(u), r"\A([^/?#]*)", 1),
            "__base_path": path_of(u),
            "__path": F.regexp_extract(t, r"\A([^?#]*)", 1),
        }
    )
    path, base_path = F.col("__path"), F.col("__base_path")
    steps = steps.withColumns(
        {
            "__site": F.concat(F.substring("__plain", F.lit(1), F.col("__at") + 2), "__authority"),
            "__query": F.substring(t, F.length(path) + 1, F.length(t)),
            "__whole": F.when(path.startswith("/"), path).otherwise(F.concat(F.when(base_path == "", "/").otherwise(F.regexp_extract(base_path, r"\A(.*/)", 1)), path)),
        }
    )
    steps = steps.withColumn("__segments", F.split("__whole", "/")).withColumn("__clean", F.when(F.col("__whole").contains("/."), _without_dots(F.col("__segments"))).otherwise(F.col("__whole")))
    relative = (
        F.when(t.startswith("//"), F.concat(F.substring(u, F.lit(1), F.col("__at")), t))
        .when((t == "") | t.startswith("#"), F.col("__plain"))
        .when(t.startswith("?"), F.concat("__site", "__base_path", t))
        .otherwise(F.concat("__site", "__clean", "__query"))
    )
    return steps.withColumn(target, F.when(t.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), t).when(F.col("__at") > 0, relative)).select(*names)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct(length, rule, verdict)`` of the longest fitting rule, else null. Of equal texts an allow comes first."""
    if not rules:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.text)).alias("length"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in sorted(rules, key=lambda r: r.verdict)
    ]
    fitting = F.array_compact(F.array(*fits))
    longest = F.array_max(F.transform(fitting, lambda x: x["length"]))
    return F.get(F.filter(fitting, lambda x: x["length"] == longest), F.lit(0))


# what holds no elements of the page: comments, scripts and styles, up to the end where they are not closed
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
_IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_TAG = rf"(?i)<(?:link|meta)\b{_IN_TAG}"
_BASE_TAG = rf"(?i)<base\b{_IN_TAG}"
_ATTRIBUTE = r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_WORTH_READING = r"(?i)<link\b|<meta\b"
_PIECES = r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});?|&amp;?|[^&]+|&"


def _without_references(text: Column) -> Column:
    """Numeric character references and ``&amp;`` as the characters they stand for."""

    def shown(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"(?i)&#x?([0-9a-f]+)", 1)
        code = F.when(piece.rlike("(?i)^&#x"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        character = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.when(piece.rlike("^&#"), character).when(piece.rlike("(?i)^&amp"), "&").otherwise(piece)

    return F.when(text.contains("&"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), shown), "")).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """The value of the tag's first attribute of that name, null where it has none."""
    names, values = (F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(group)) for group in (1, 2))
    value = F.get(values, (F.array_position(F.transform(names, lower_ascii), name) - 1).cast("int"))
    return F.trim(_without_references(F.regexp_replace(value, r"""\A["']|["']\z""", "")))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(source, target)`` nodes of canonical links and refresh redirects.

    Tags in comments, scripts and styles are none; a ``>`` inside quotes ends no tag; references in values are decoded.
    """
    linked = pages.where(F.col(url).isNotNull() & F.col(html).rlike(_WORTH_READING) & F.col(html).rlike("(?i)canonical|refresh"))
    shown = linked.select(F.col(url).alias("page"), F.regexp_replace(html, _HIDDEN, " ").alias("shown"))
    based = resolved(
        shown.select("page", _attribute(F.regexp_extract("shown", _BASE_TAG, 0), "href").alias("base"), F.regexp_extract_all("shown", F.lit(_TAG), F.lit(0)).alias("tags")), "base", "page"
    )
    tags = based.select("page", F.coalesce("base", "page").alias("base"), F.explode("tags").alias("tag"))
    read = tags.select("page", "base", *[_attribute(F.col("tag"), name).alias(name.replace("-", "_")) for name in ("rel", "href", "http-equiv", "content")])
    canonical = F.when(F.array_contains(F.split(lower_ascii(F.col("rel")), r"\s+"), "canonical"), F.col("href"))
    refresh = F.when(lower_ascii(F.col("http_equiv")) == "refresh", F.regexp_extract("content", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>;]+)", 1))
    found = read.select("page", "base", F.coalesce(canonical, refresh).alias("target")).where("target <> ''")
    edges = resolved(found, "target", "base").select(node_of(F.col("page")).alias("source"), node_of(F.col("target")).alias("target"))
    # written, so that filters on the nodes are not pushed down as copies of all steps
    return cut_lineage(edges).where("source is not null and target is not null")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None, id_column: str = "page_id") -> DataFrame:
    """``(page_id, host, path, rule, verdict, component)`` for every page.

    ``redirects`` holds further edges as columns ``source`` and ``target`` with urls.
    """
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("source"), node_of(F.col("target")).alias("target")))
    members = connected_components(edges, "source", "target")
    # targets that are no pages decide as well: their urls have rules
    decided = members.select("component", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"].alias("verdict"))
    by_component = decided.groupBy("component").agg(F.min("verdict").alias("alias_verdict"))  # allow sorts before block
    aliases = members.join(by_component, "component").select("node", "component", "alias_verdict")
    judged = pages.select(
        F.col(id_column).alias("page_id"),
        F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"),
        F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"),
        node_of(F.col("url")).alias("node"),
    ).withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    # no node holds a line feed: pages without a node are dealt out by their id and meet nobody
    dealt = judged.withColumn("node", F.coalesce("node", F.concat(F.lit("\n"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    return dealt.join(aliases, "node", "left").select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"), "component"
    )

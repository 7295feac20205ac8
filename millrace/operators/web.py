"""URLs, HTML documents and dates in texts."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.html import classes, main_text, parse, select_css, select_xpath
from millrace.plans.registry import operator

#: The components of a URL, in the order of their columns.
COMPONENTS = ["scheme", "host", "path", "port", "query", "fragment", "origin", "args"]
#: Default ports of schemes.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ssh": "22", "sftp": "22", "ws": "80", "wss": "443"}
#: The generic form of a URI (RFC 3986, appendix B).
URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


@operator("url_component_extraction_mapper", "table")
def url_component_extraction_mapper(df: DataFrame, field: str, required_components: set[str] | None = None) -> DataFrame:
    """A string column for each component asked for, in one fixed order. What a URL lacks is empty, a null URL gives nulls.

    A missing port is the scheme's own. All of it is built-in expressions.
    """
    wanted = required_components or {"scheme", "host", "path", "port", "query"}
    if wanted - set(COMPONENTS):
        raise ValueError(f"unknown URL components: {sorted(wanted - set(COMPONENTS))}")
    url = F.trim(F.col(f"`{field}`"))
    part = lambda i: F.regexp_extract(url, URI, i)
    scheme, authority = F.lower(part(1)), part(2)
    server = F.regexp_replace(authority, "^.*@", "")
    host = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
    own_port = F.regexp_extract(server, r":([0-9]+)$", 1)
    usual = F.element_at(F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv)), scheme)
    port = F.when(own_port != "", own_port).otherwise(usual)
    shown_port = F.when((own_port != "") & ~own_port.eqNullSafe(usual), F.concat(F.lit(":"), own_port)).otherwise(F.lit(""))
    made = {
        "scheme": scheme,
        "host": host,
        "path": part(3),
        "port": port,
        "query": part(4),
        "fragment": part(5),
        "origin": F.concat(scheme, F.lit("://"), host, shown_port),
        "args": F.when(part(4) != "", F.to_json(F.str_to_map(part(4), F.lit("&"), F.lit("=")))).otherwise(F.lit("{}")),
    }
    return df.select("*", *(F.when(url.isNotNull(), made[c]).alias(c) for c in COMPONENTS if c in wanted))


def _plain_path(path: Column) -> Column:
    """Without empty and dot segments; a slash at either end stays."""
    absolute = F.startswith(path, F.lit("/"))
    step = lambda done, part: (
        F.when(part.isin("", "."), done)
        .when(part != "..", F.array_append(done, part))
        .when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .when(absolute, done)
        .otherwise(F.array_append(done, part))
    )
    joined = F.array_join(F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step), "/")
    return F.when(absolute, F.concat(F.lit("/"), joined, F.when(F.endswith(path, F.lit("/")) & (joined != ""), "/").otherwise(""))).otherwise(
        F.concat(F.when(joined == "", ".").otherwise(joined), F.when(F.endswith(path, F.lit("/")), "/").otherwise(""))
    )


def _plain_query(query: Column) -> Column:
    """Pairs with a value, by name and value, written anew: all but letters, digits and ``-._~`` as UTF-8 bytes, a space as ``+``."""
    decoded = lambda c: F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    given = F.filter(F.split(query, "&", -1), lambda kv: kv.rlike("(?s)^[^=]*=."))
    pairs = F.transform(given, lambda kv: F.struct(decoded(F.regexp_extract(kv, "(?s)^([^=]*)=", 1)).alias("k"), decoded(F.regexp_extract(kv, "(?s)^[^=]*=(.*)$", 1)).alias("v")))
    return F.array_join(F.transform(F.array_sort(pairs), lambda kv: F.concat(coded(kv["k"]), F.lit("="), coded(kv["v"]))), "&")


@operator("url_normalization_mapper", "map")
def url_normalization_mapper(df: DataFrame, col: Column) -> Column:
    """URLs in normal form, all in built-in expressions; null and empty ones stay, and those whose port is no number.

    Scheme and host in lower case; user, fragment and the scheme's usual port (80 or 443) dropped; dot segments of the path resolved, an empty
    path becomes ``/``; parameters without a value dropped, the others sorted and encoded anew.
    """
    url = F.regexp_replace(F.regexp_replace(col, r"^[\s\x00-\x20]+|\s+$", ""), r"[\t\r\n]", "")
    form = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(url, form, i)
    scheme, server = F.lower(part(1)), F.regexp_replace(part(2), "(?s)^.*@", "")
    host = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
    own_port = F.regexp_extract(server, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = own_port.try_cast("int")
    usual = F.when(scheme == "http", 80).when(scheme == "https", 443).otherwise(-1)
    port = F.when((own_port == "") | (number == usual), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    # what follows a semicolon in the last segment is no part of the path
    whole, params = F.regexp_extract(part(3), "(?s)^((?:.*/)?[^/;]*)", 1), F.regexp_extract(part(3), "(?s)^(?:.*/)?[^/;]*;([^/]*)$", 1)
    path = F.when(whole == "", "/").otherwise(_plain_path(whole))
    query = _plain_query(part(4))
    has_server = url.rlike("^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//")
    between = F.when(has_server & ~F.startswith(path, F.lit("/")), "/").otherwise("")
    made = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(has_server, F.concat(F.lit("//"), host, port)).otherwise(""),
        between, path, F.when(params != "", F.concat(F.lit(";"), params)).otherwise(""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    fine = (own_port == "") | own_port.rlike("^[0-9]{1,9}$") & (number <= 65535)
    return F.when((F.length(col) > 0) & fine, made).otherwise(col)


@operator("html_content_extract_mapper", "map")
def html_content_extract_mapper(df: DataFrame, col: Column) -> Column:
    """The main text of a page, by text and link density of its blocks; null where there is none."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else main_text(p) or None)

    return text(col)


@operator("css_extraction_mapper", "map")
def css_extraction_mapper(df: DataFrame, col: Column) -> Column:
    """Sorted distinct class names of a page; null stays null."""

    @F.pandas_udf("array<string>")
    def names(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else classes(p))

    return names(col)


@operator("dom_element_extraction_mapper", "map")
def dom_element_extraction_mapper(df: DataFrame, col: Column, css_selector: str | None = None, xpath_selector: str | None = None, as_written: bool = False) -> Column:
    """The HTML of the elements that one selector matches, in document order; empty where none does, null stays null.

    It is serialised anew, so quotes and character references may differ from the page's. ``as_written``: what stands in the page, letter by letter.

    CSS: types, ``*``, ``.class``, ``#id``, ``[attr]`` with ``= ~= ^= $= *=``, ``:first-child``, ``:nth-child(n)``, the four combinators and
    lists. XPath: ``/`` and ``//`` steps, ``*``, ``[n]``, ``[@a]``, ``[@a='v']``, ``contains(@a, 'v')``.
    """
    if bool(css_selector) == bool(xpath_selector):
        raise ValueError("exactly one of css_selector and xpath_selector must be given")
    chosen = (lambda root: select_css(root, css_selector)) if css_selector else (lambda root: select_xpath(root, xpath_selector))
    chosen(parse(""))

    @F.pandas_udf("string")
    def pick(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else "".join(p[e.start : e.end] if as_written else e.html() for e in chosen(parse(p))))

    return pick(col)


#: What a date written in a text may consist of.
_MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_TIME = r"(?:[ T,]|\s+at\s+){1,2}\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:\s*[ap]\.?m\b\.?)?(?:\s?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
_DAY = r"\d{1,2}(?:st|nd|rd|th)?"
_DATE = re.compile(
    rf"\b(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{4}}|{_MONTH}\s+{_DAY},?\s+\d{{4}}|{_DAY}\s+(?:of\s+)?{_MONTH},?\s+\d{{4}})(?:{_TIME})?(?!\d)", re.IGNORECASE
)
#: Parts that a string leaves out are those of this moment, so that results do not depend on the day.
DEFAULT = dt.datetime(2000, 1, 1)


def dates_in(text: str) -> list[str]:
    from dateutil import parser

    out = []
    for m in _DATE.finditer(text):
        raw = re.sub(r"\s+at\s+|\bof\s+", " ", m[0], flags=re.IGNORECASE)
        try:
            out.append(str(parser.parse(raw, default=DEFAULT)))
        except (ValueError, OverflowError):
            continue
    return out


@operator("datetime_extraction_mapper", "map")
def datetime_extraction_mapper(df: DataFrame, col: Column) -> Column:
    """The dates and times written in a text, as ``YYYY-MM-DD hh:mm:ss``; an empty list where there are none, null stays null."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else dates_in(t))

    return found(col)


@operator("timestamp_mapper", "map")
def timestamp_mapper(df: DataFrame, col: Column, tz: str = "UTC") -> Column:
    """Seconds since 1970 of the moment that a string means on the clocks of ``tz`` (``UTC+08:00`` is eight hours east).

    A zone within the string is not regarded; strings that cannot be read, and zones that there are not, give null.
    Full ISO strings are read by built-in functions, others in Arrow batches.
    """
    offset = re.fullmatch(r"(?:UTC|GMT)([+-])(\d{1,2}):?(\d{2})?", tz)
    zone = f"{offset[1]}{int(offset[2]):02d}:{offset[3] or '00'}" if offset else tz

    iso = col.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$")
    clock = F.try_to_timestamp(F.concat(F.regexp_replace(F.when(iso, col), "T", " "), F.lit(zone if offset else f" {tz}")), F.lit("yyyy-MM-dd HH:mm:ssXXX" if offset else "yyyy-MM-dd HH:mm:ss VV"))

    seconds = (1 if offset[1] == "+" else -1) * (int(offset[2]) * 3600 + int(offset[3] or 0) * 60) if offset else None

    @F.pandas_udf("long")
    def other(texts: pd.Series) -> pd.Series:
        from dateutil import parser
        from dateutil import tz as zones

        there = zones.gettz(tz) if seconds is None else zones.tzoffset(None, seconds)

        def one(t):
            try:
                return int(parser.parse(t, default=DEFAULT).replace(tzinfo=there).timestamp()) if t and there else None
            except (ValueError, OverflowError):
                return None

        return texts.map(one).astype("Int64")

    return F.when(iso, F.unix_timestamp(clock)).otherwise(other(F.when(~iso, col)))

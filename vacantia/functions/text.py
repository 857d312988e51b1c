"""Markup and whitespace cleaning as column functions."""
from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python treats as whitespace; Java's \s alone misses most of them.
WS = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# The HTML5 names as the standard library has them: those that end in ";", and the older ones that may lack it.
_CLOSED = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
_OPEN = {k: v for k, v in html5.items() if not k.endswith(";")}
_FREQUENT = ("amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "middot", "ndash", "mdash", "rsquo", "lsquo", "ldquo", "rdquo", "bull", "hellip")
# Fixed values of the HTML standard: numbers 128 to 159 mean the characters of windows-1252.
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
_REFERENCE = "^(?:#([0-9]+);?|#[xX]([0-9a-fA-F]+);?|([^\\t\\n\\f <&#;]{1,32});?)"


def lit_or_col(value) -> Column:
    """A Column as is; anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def falsy_to_null(c: Column) -> Column:
    """Empty text as NULL, so that ``coalesce`` acts like an ``or`` chain."""
    return F.nullif(c, F.lit(""))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


@cache
def _json(which: str) -> str:
    table = {"closed": _CLOSED, "open": _OPEN, "windows": {str(k): v for k, v in _WINDOWS.items()}}[which]
    first = [k for k in _FREQUENT if k in table]  # a map is searched from its start
    return json.dumps({k: table[k] for k in dict.fromkeys([*first, *table])})


def _look_up(which: str, key: Column) -> Column:
    """Entry of a table that is one literal in the plan; Catalyst parses it once."""
    return F.try_element_at(F.from_json(F.lit(_json(which)), "map<string,string>"), key)


def _character(code: Column) -> Column:
    """The character of a numeric reference (decimal text): "" for what is none, U+FFFD for what can't be."""
    n = code.try_cast("bigint")
    wide = n.isNull() | (n > 0x10FFFF) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n == 0)
    control = ((n >= 1) & (n <= 8)) | (n == 11) | ((n >= 14) & (n <= 31)) | (n == 127) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(wide, "\ufffd").when((n >= 128) & (n <= 159), _look_up("windows", n.cast("string"))).when(n == 13, "\r").when(control, "").otherwise(plain)


def _decoded(part: Column) -> Column:
    """Text after an "&", with the reference it begins with decoded."""
    head = F.regexp_extract(part, _REFERENCE, 0)
    rest = F.substr(part, F.length(head) + 1)
    decimal, hexadecimal, name = (F.regexp_extract(part, _REFERENCE, i) for i in (1, 2, 3))
    number = F.when(decimal != "", decimal).otherwise(F.when(F.length(F.ltrim(hexadecimal, F.lit("0"))) <= 8, F.conv(hexadecimal, 16, 10)).otherwise("99999999"))
    closed = F.when(head.endswith(";"), _look_up("closed", name))
    lengths = sorted({len(k) for k in _OPEN}, reverse=True)
    older = F.filter(F.array(*[
        F.struct(_look_up("open", F.when(F.length(name) >= k, F.substring(name, 1, k))).alias("c"), F.lit(k).alias("k"))
        for k in lengths]), lambda x: x["c"].isNotNull())
    kept = F.concat(F.lit("&"), part)
    prefix = let(older, lambda o: F.when(F.size(o) > 0, F.concat(F.get(o, F.lit(0))["c"], F.substr(part, F.get(o, F.lit(0))["k"] + 1))).otherwise(kept))
    return F.when(head == "", kept).when(head.startswith("#"), F.concat(_character(number), rest)).otherwise(
        F.coalesce(F.concat(closed, rest), prefix))


def unescape_entities(c: Column) -> Column:
    """Decode HTML character references (all names of HTML5, numbers), without leaving the JVM."""
    parts = F.split(c, "&")
    tail = F.transform(F.slice(parts, 2, 1 << 30), _decoded)
    return F.when(c.contains("&"), F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))).otherwise(c)


def strip_html(c: Column, escaped: bool = False) -> Column:
    """Plain text of markup. ``escaped`` input is entity-escaped markup: decode, strip, decode."""
    text = unescape_entities(c) if escaped else c
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    return F.coalesce(squeeze_ws(unescape_entities(bare)), F.lit(""))


def snippet_of(clean: Column, length: int = 300) -> Column:
    """Cut already clean text at a word boundary and mark the cut."""
    head = F.regexp_replace(F.substring(clean, 1, length), " [^ ]*$", "")
    short = F.concat(F.regexp_replace(head, "[.,;:—-]+$", ""), F.lit("…"))
    return F.when(F.length(clean) <= length, clean).otherwise(short)


def make_snippet(c: Column, length: int = 300, escaped: bool = False) -> Column:
    return snippet_of(strip_html(c, escaped), length)

"""Pages as a stream of tags folded over a stack of open elements, a page at a time in Arrow batches.

Comments and the text of script, style and the like are no tags. End tags that are implied, missing or stray are handled as browsers
do as far as forms are concerned: an element that closes takes the open ones inside with it, a form inside a form is ignored, `</form>`
ends the form for what follows outside of its open elements, and a form directly in a table holds nothing. Attribute values and titles
have their character references decoded, as browsers do also some that no semicolon closes; strict: only closed ones. Null pages have no
title and empty lists.
"""

from __future__ import annotations

import html as _html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

_ATTRS = r"""((?:[^>"']|"[^"]*"|'[^']*')*+)"""
_TOKEN = re.compile(rf"""(?is)<!--.*?(?:--!?>|\Z)|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]){_ATTRS}>(?P<text>.*?)(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*){_ATTRS}>""")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TABLE = ("table", "tbody", "thead", "tfoot", "tr")
_SCOPE = frozenset(("table", "td", "th", "caption", "object", "template", "marquee", "applet"))
#: What a start tag ends first: elements it can't be inside of, up to the nearest of those it belongs in.
_WITHIN = {"td": ("tr",), "th": ("tr",), "tr": ("tbody", "thead", "tfoot", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}

SCHEMA = "title string, forms array<struct<action: string, method: string, inputs: array<struct<name: string, input_type: string, value: string>>>>, links array<string>, scripts array<string>"


def _closed(text: str) -> str:
    """text with the character references decoded that end with a semicolon."""
    return _REFERENCE.sub(lambda m: _html.unescape(m[0]) if m[1][0] == "#" or m[1] in html5 else m[0], text)


def _attrs(text: str, decode) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), decode(next((v for v in m.groups()[1:] if v is not None), "")))
    return out


def tokens(page: str):
    """(tag, is an end tag, attributes, raw text) of the tags of a page, in order."""
    last, at = page.rfind(">"), page.find("<")
    while at >= 0:
        m = _TOKEN.match(page, at)
        if m is None:
            if at > last:
                return
            at = page.find("<", at + 1)
            continue
        if m["raw"]:
            yield m["raw"].lower(), False, m[2], m["text"]
        elif m["tag"]:
            yield m["tag"].lower(), bool(m["end"]), m[6], None
        at = page.find("<", m.end())


def analyse(page: str | None, anchors: int = 20, scripts: int = 10, strict: bool = False) -> dict:
    """Title, forms with their inputs, distinct targets of the first anchors, sources of the first scripts."""
    decode = _closed if strict else _html.unescape
    title, forms, links, sources, n_links = None, [], [], [], 0
    stack: list[tuple[str, tuple[int, ...]]] = [("", ())]  # tag, the forms that it is inside of
    pointer: int | None = None
    for tag, ends, attrs, raw in tokens(page or ""):
        if ends:
            if tag == "form":
                if pointer is not None:
                    form, pointer = pointer, None
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "form" and stack[i][1][-1] == form:
                            del stack[i]
                            break
                        if stack[i][0] in _SCOPE:
                            break
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in (("table", "template") if tag in _TABLE or tag in ("td", "th", "caption") else _SCOPE):
                    break
            continue
        if tag == "title" and raw is not None:
            title = decode(raw).strip() if title is None else title
        elif tag == "script" and "src" in (a := _attrs(attrs, decode)) and len(sources) < scripts:
            sources.append(a["src"].strip())
        elif tag == "a" and n_links < anchors and "href" in (a := _attrs(attrs, decode)):
            n_links += 1
            if (target := a["href"].strip()) and target not in links:
                links.append(target)
        elif tag == "input" and stack[-1][1]:
            a = _attrs(attrs, decode)
            for f in stack[-1][1]:
                forms[f]["inputs"].append({"name": a.get("name", ""), "input_type": a.get("type", "text"), "value": a.get("value", "")})
        if raw is not None or tag in _VOID:
            continue
        if tag in _WITHIN:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in _WITHIN[tag]:
                    del stack[i + 1 :]
                    break
                if stack[i][0] in ("table", "template"):
                    break
        inside = stack[-1][1]
        if tag == "form":
            if pointer is not None:
                continue
            a = _attrs(attrs, decode)
            forms.append({"action": a.get("action", ""), "method": a.get("method", "GET"), "inputs": []})
            pointer = len(forms) - 1
            if stack[-1][0] in _TABLE:
                continue
            inside = (*inside, pointer)
        stack.append((tag, inside))
    return {"title": title or None, "forms": forms, "links": links, "scripts": sources}


def page_analysis(html: Column | str, strict: bool = False) -> Column:
    """A struct of SCHEMA for each page; strict: a reference without its semicolon is text."""

    def batch(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(p, strict=strict) for p in pages], columns=["title", "forms", "links", "scripts"])

    return pandas_udf(batch, SCHEMA)(html)

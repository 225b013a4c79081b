"""Product fields from a table of saved pages.

Semantics of the reference: find every element with the given class; only if
there is exactly one, return its text (or the text of a descendant with
``text_class``) and the ``src`` of a descendant with ``img_class``; pages with
zero or several matches give nothing.

Pages of regular markup never leave the JVM: a page is split into tags and the
texts between them, and a stack of open tags, folded with ``aggregate``, finds
where the element ends. Pages it can't be sure of (tags closed out of order,
comments or scripts inside the element, stray ``<``, unusual entities) are
flagged, and the standard-library HTML parser reads those alone, in the same
scan; for all others Python gets a null.
"""

from __future__ import annotations

import html as html_lib
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that have no end.
VOID = ("img", "br", "meta", "link", "input", "hr")
#: An attribute value, an attribute and a tag of regular markup.
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'<>=`/]++)"""
ATTRIBUTE = rf"(?:\s++[A-Za-z_:][A-Za-z0-9_:.-]*+(?:\s*+=\s*+{VALUE})?+)"
TAG = rf"</?+[A-Za-z][A-Za-z0-9]*+{ATTRIBUTE}*+\s*+/?+>"
#: What is no markup, or markup without elements, and the mark put in its place.
SKIPPED = (r"(?is)<(?:!--(?!-?>).*?--|!DOCTYPE[^<>]*+"
           r"|(?<raw>script|style)(?=[\s>])[^<>]*+>.*?</\k<raw>\s*+)>")
MARK = "\u0001"
#: Tags, one after the other, of pages that only the parser reads right: raw text elements, tags in a
#: title, empty classes and classes with an entity.
UNUSUAL = (r"(?i)<(?:textarea|xmp|iframe|noembed|noframes|plaintext|noscript|svg|math)\b"
           r"|<title[^<>]*+>(?!</title)|\sclass\s*=\s*(?:\"\"|''|\"[^\"]*&|'[^']*&|[^\s\"'>]*&)")
UNUSUAL_BEFORE = (r"(?i)<(?:textarea|xmp|iframe|noembed|noframes|plaintext|noscript|svg|math)\b"
                  r"|<title[^<>]*+>[^<]*+<(?!/title)")
#: Entities replaced here; a page with others in the element goes to the parser.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0", "&#x27;": "'", "&amp;": "&"}


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name, empty without one."""
    got = F.regexp_extract(tag, rf"(?i)^<[A-Za-z][A-Za-z0-9]*+{ATTRIBUTE}*?\s++{name}\s*+=\s*+({VALUE})", 1)
    return F.regexp_replace(got, "^[\"']|[\"']$", "")


def _has_class(tag: Column, name: str) -> Column:
    return F.array_contains(F.split(_attribute(tag, "class"), r"(?U)[\s\x1c-\x1f]+"), name)


def _name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, "^</?+([A-Za-z][A-Za-z0-9]*+)", 1))


def _end(tags: Column, start: Column) -> Column:
    """Index of the tag that ends the element opened at ``start``; -1 if tags aren't closed in order."""
    def step(state, tag):
        name, stack = _name(tag), state["stack"]
        closing = tag.startswith("</")
        ignored = name.isin(*VOID) | tag.endswith("/>")
        right = F.try_element_at(stack, F.lit(-1)) == name
        pushed = F.when(closing, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(ignored, stack).otherwise(
            F.concat(stack, F.array(name)))
        move = F.struct(pushed.alias("stack"), (state["at"] + 1).alias("at"),
                        (closing & ~right).alias("bad"))
        return F.when(state["bad"] | (F.size(stack) == 0), state).otherwise(move)

    own = F.try_element_at(tags, start + 1)
    begin = F.struct(F.array(_name(own)).alias("stack"), start.alias("at"),
                     (_name(own).isin(*VOID) | own.endswith("/>")).alias("bad"))
    return F.aggregate(F.slice(tags, start + 2, F.size(tags)), begin, step,
                       lambda s: F.when(~s["bad"] & (F.size(s["stack"]) == 0), s["at"]).otherwise(-1))


def _decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def _undecodable(text: Column) -> Column:
    known = "|".join(e[1:-1] for e in ENTITIES)
    return text.rlike(rf"&(?!(?:{known});)[#A-Za-z]") | text.contains(MARK)


def _region(html: Column, shown: str, tag: str) -> Column:
    """The part of a page to split into tags. Where the class is shown once and all markup before it is regular,
    the part from its element to the first end tag, or to the end of the page if elements of that name
    are nested; else the whole page."""
    element = rf"<{tag}(?=\s)[^<>]*{shown}"
    head = F.regexp_extract(html, rf"(?is)\A((?:[^<]++|{SKIPPED[5:]}|(?!{element}){TAG})*+)(?={element})", 1)
    usual = (F.regexp_count(html, F.lit(f"(?i){shown}")) == 1) & ~head.rlike(UNUSUAL_BEFORE)
    tail = F.substring(html, F.length(head) + 1, F.length(html))
    first = F.regexp_extract(tail, rf"(?is)\A(<[^<]*+(?:(?!</?{tag}\b)<[^<]*+)*+</{tag}\s*+>)", 1)
    return F.when(~usual, html).when((F.length(head) > 0) & (first != ""), first).otherwise(
        F.when(F.length(head) > 0, tail).otherwise(html))


def _once(df: DataFrame, *columns) -> DataFrame:
    """The named columns and the fields of the last, a struct, which is computed once a row however often
    later steps use it (a filter above a plain projection would compute it again)."""
    return df.select(*columns[:-1], F.inline(F.array(columns[-1])))


def _quoted(name: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", name)


def extract_unique(pages: DataFrame, element_class: str, text_class: str | None = None,
                   img_class: str | None = None, tag: str = "div",
                   id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, description, image)`` for pages with exactly one matching element.

    Null and empty pages give nothing; the image is null without ``img_class`` or such a descendant.
    """
    named = _quoted(element_class)
    shown = rf"class\s*=\s*(?:\"[^\"]*(?:{named}|&)|'[^']*(?:{named}|&)|[^\s\"'>]*(?:{named}|&))"
    page = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).alias("html")).where(
        F.col("html").rlike(f"(?i){shown}"))
    text = F.regexp_replace(_region(F.col("html"), shown, _quoted(tag)), SKIPPED, MARK)
    page = _once(page.select("page_id", "html", text.alias("text")), "page_id", "html", F.struct(
        (F.col("html").contains("--!>") | F.col("html").contains(MARK)).alias("odd"), F.split("text", TAG, -1).alias("texts"),
        F.regexp_extract_all("text", F.lit(TAG), F.lit(0)).alias("tags")))
    # the plain tests come first: few tags reach the pattern of the class
    matches = lambda t: t.contains(element_class) & ~t.startswith("</") & (_name(t) == tag.lower()) & _has_class(t, element_class)
    page = _once(page, "page_id", "html", "texts", "tags", F.struct(
        (F.col("odd") | F.array_join("tags", "").rlike(UNUSUAL) | F.exists("texts", lambda t: t.contains("<"))).alias("odd"),
        F.filter(F.transform("tags", lambda t, i: F.when(matches(t), i)), lambda i: i.isNotNull()).alias("at")))
    page = _once(page.where("odd OR size(at) = 1"), "page_id", "html", "texts", "tags", F.struct(
        F.coalesce(F.try_element_at("at", F.lit(1)), F.lit(-1)).alias("start"),
        F.when(~F.col("odd"), _end(F.col("tags"), F.col("at")[0])).otherwise(-1).alias("stop")))
    inside = F.slice("tags", F.col("start") + 2, F.greatest(F.col("stop") - F.col("start") - 1, F.lit(0)))
    opened = lambda name: lambda t: t.contains(name) & ~t.startswith("</") & _has_class(t, name)
    if text_class:
        nth = F.array_position(F.transform(inside, opened(text_class)), True).cast("int")
        page = _once(page, *page.columns, F.struct(F.when(nth > 0, F.col("start") + nth).alias("from")))
        page = page.select("*", F.when(F.col("from").isNotNull() & (F.col("stop") >= 0),
                                       _end(F.col("tags"), F.col("from"))).alias("to"))
    else:
        page = page.select("*", F.col("start").alias("from"), F.col("stop").alias("to"))
    src = F.lit(None).cast("string")
    if img_class:
        src = _attribute(F.try_element_at(F.filter(inside, opened(img_class)), F.lit(1)), "src")
    body = F.array_join(F.slice("texts", F.col("from") + 2, F.greatest(F.col("to") - F.col("from"), F.lit(0))), "")
    page = _once(page, "page_id", "html", "stop", "to", F.struct(
        F.coalesce(body, F.lit("")).alias("body"), src.alias("src")))
    hard = (F.col("stop") < 0) | F.coalesce(F.col("to") < 0, F.lit(False)) | _undecodable(
        F.col("body")) | F.coalesce((F.col("src") == "") | _undecodable(F.col("src")), F.lit(False))

    @F.pandas_udf("description STRING, image STRING, found BOOLEAN")
    def parsed(docs: pd.Series) -> pd.DataFrame:
        got = [parse_unique(d, element_class, text_class, img_class, tag) for d in docs]
        return pd.DataFrame([(*g, True) if g else (None, None, False) for g in got],
                            columns=["description", "image", "found"])

    page = _once(page, "page_id", "html", "body", "src", F.struct(hard.alias("hard")))
    page = _once(page, "page_id", "body", "src", "hard", parsed(F.when(F.col("hard"), F.col("html"))))
    return page.where("NOT hard OR found").select(
        "page_id", F.when(F.col("hard"), F.col("description")).otherwise(_decoded(F.col("body"))).alias("description"),
        F.when(F.col("hard"), F.col("image")).otherwise(_decoded(F.col("src"))).alias("image"))


class _ClassFinder(HTMLParser):
    """Collect elements carrying a class, with descendant text and image link."""

    def __init__(self, element_class, text_class, img_class, tag):
        super().__init__(convert_charrefs=True)
        self.element_class, self.text_class = element_class, text_class
        self.img_class, self.tag = img_class, tag
        self.found = []      # [text parts, image]
        self.stack = []      # open tags: (tag, in_match, in_text)

    @staticmethod
    def _classes(attrs):
        for name, value in attrs:
            if name == "class" and value:
                return value.split()
        return []

    def handle_starttag(self, tag, attrs):
        in_match = self.stack[-1][1] if self.stack else False
        in_text = self.stack[-1][2] if self.stack else False
        classes = self._classes(attrs)
        if tag == self.tag and self.element_class in classes:
            self.found.append([[], None, self.text_class is None, False])
            in_match, in_text = True, self.text_class is None
        elif in_match and self.found:
            cur = self.found[-1]
            if self.text_class and self.text_class in classes and not cur[3]:
                in_text, cur[3] = True, True
            if self.img_class and self.img_class in classes and cur[1] is None:
                cur[1] = dict(attrs).get("src")
        if tag not in VOID:
            self.stack.append((tag, in_match, in_text))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self.stack and self.stack[-1][2] and self.found:
            self.found[-1][0].append(data)


def parse_unique(doc, element_class, text_class=None, img_class=None, tag="div"):
    """Per-page helper: ``(description, image)`` or None unless exactly one match."""
    if doc is None:
        return None
    finder = _ClassFinder(element_class, text_class, img_class, tag)
    finder.feed(doc)
    finder.close()
    if len(finder.found) != 1:
        return None
    parts, image, _, _ = finder.found[0]
    return "".join(parts), (html_lib.unescape(image) if image else image)

"""Forum pages to records with the standard library's parser: links, threads, posts, predicates."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of denied and challenge pages, and the date of a post.
DENIED = ("you do not have permission", "not logged in", "ليس لديك صلاحية", "ليس لديك الصلاحية")
CHALLENGE = ("just a moment", "checking your browser", "cf-challenge", "attention required")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}, \d{2}:\d{2}")
_FORUM = re.compile(r"forumdisplay\.php\?f=(\d+)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Tree(HTMLParser):
    """Flat list of elements: (tag, attributes, parent index, text parts)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, dict[str, str], int, list[str]]] = [("", {}, -1, [])]
        self.stack = [0]

    def handle_starttag(self, tag, attrs):
        self.nodes.append((tag, {k: v or "" for k, v in attrs}, self.stack[-1], []))
        if tag not in _VOID:
            self.stack.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, 0, -1):
            if self.nodes[self.stack[k]][0] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        if data.strip():
            for k in self.stack:
                self.nodes[k][3].append(data.strip())

    def inside(self, k: int, top: int) -> bool:
        while k > 0:
            if k == top:
                return True
            k = self.nodes[k][2]
        return top == 0


def _parse(html: str | None) -> _Tree:
    t = _Tree()
    t.feed(html or "")
    return t


def forum_links(html: str | None, scope: str | None = None, header: bool = False) -> list[tuple[str, str]]:
    """(forum_id, title), first title of an id wins, empty titles skipped; ``scope``: only inside that category's body; ``header``: category headers."""
    t, found = _parse(html), {}
    top = 0
    if scope is not None:
        top = next((k for k, n in enumerate(t.nodes) if n[0] == "tbody" and n[1].get("id") == f"collapseobj_forumbit_{scope}"), -1)
        if top < 0:
            return []
    cells = {k for k, n in enumerate(t.nodes) if n[0] == "td" and "tcat" in n[1].get("class", "").split()}
    for k, (tag, attrs, _, parts) in enumerate(t.nodes):
        m = _FORUM.search(attrs.get("href", "")) if tag == "a" else None
        if m and t.inside(k, top) and (not header or any(t.inside(k, c) for c in cells)):
            title = " ".join(parts)
            if title and m[1] not in found:
                found[m[1]] = title
    return list(found.items())


def has_next(html: str | None) -> bool:
    """Whether the page navigation has a next page."""
    t = _parse(html)
    navs = [k for k, n in enumerate(t.nodes) if n[0] == "div" and "pagenav" in n[1].get("class", "").split()]
    return any(n[0] == "a" and "next" in n[1].get("rel", "").split() and any(t.inside(k, v) for v in navs) for k, n in enumerate(t.nodes))


def threads(html: str | None) -> list[tuple[str, str]]:
    """(thread_id, title) once each."""
    found: dict[str, str] = {}
    for tag, attrs, _, parts in _parse(html).nodes:
        if tag == "a" and attrs.get("id", "").startswith("thread_title_"):
            found.setdefault(attrs["id"][len("thread_title_") :], " ".join(parts))
    return list(found.items())


def posts(html: str | None) -> list[tuple[str, str | None, str | None, str]]:
    """(post_id, author, timestamp, text): tables ``post<digits>``; the body's text parts one a line."""
    t, out = _parse(html), []
    for k, (tag, attrs, _, _) in enumerate(t.nodes):
        pid = attrs.get("id", "")[4:]
        if tag != "table" or not attrs.get("id", "").startswith("post") or not pid.isdigit():
            continue
        own = [n for j, n in enumerate(t.nodes) if t.inside(j, k)]
        body = next((n for n in own if n[1].get("id") == f"post_message_{pid}"), None)
        if body is None:
            continue
        author = next((" ".join(n[3]) for n in own if n[0] == "a" and "bigusername" in n[1].get("class", "").split()), None)
        when = next((m[0] for n in own if n[0] == "td" and "thead" in n[1].get("class", "").split() for m in [_DATE.search(" ".join(n[3]))] if m), None)
        out.append((pid, author, when, "\n".join(body[3])))
    return out


def permission_denied(c: Column) -> Column:
    """Whether the page says that access is denied (built-in expression)."""
    low = F.lower(c)
    out = low.contains(DENIED[0])
    for m in DENIED[1:]:
        out = out | low.contains(m)
    return out


def is_challenge(c: Column) -> Column:
    """Whether the first 2000 characters are a challenge page."""
    low = F.lower(F.substring(c, 1, 2000))
    out = low.contains(CHALLENGE[0])
    for m in CHALLENGE[1:]:
        out = out | low.contains(m)
    return out


def posts_column(c: Column) -> Column:
    """Array of post records; explode with ``inline``."""

    @F.pandas_udf("array<struct<post_id:string,author:string,timestamp:string,text:string>>")
    def posts_udf(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [dict(zip(("post_id", "author", "timestamp", "text"), p)) for p in posts(h)])

    return posts_udf(c)


def threads_column(c: Column) -> Column:
    """Array of thread records; explode with ``inline``."""

    @F.pandas_udf("array<struct<thread_id:string,title:string>>")
    def threads_udf(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"thread_id": a, "title": b} for a, b in threads(h)])

    return threads_udf(c)


def links_column(c: Column, scope: str | None = None, header: bool = False) -> Column:
    """Array of forum links of a page; explode with ``inline``."""

    @F.pandas_udf("array<struct<forum_id:string,title:string>>")
    def links_udf(s: pd.Series) -> pd.Series:
        return s.map(lambda h: [{"forum_id": a, "title": b} for a, b in forum_links(h, scope, header)])

    return links_udf(c)


def has_next_column(c: Column) -> Column:
    """Whether a page has a next one; false for null."""

    @F.pandas_udf("boolean")
    def next_udf(s: pd.Series) -> pd.Series:
        return s.map(has_next).astype(bool)

    return next_udf(c)

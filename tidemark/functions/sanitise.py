"""HTML that is safe to show: inline formatting and links only, cut to a length of text (FN21)."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F

#: Elements that stay, those that go with what is in them, schemes of links, and encoded characters.
INLINE = frozenset("b big br cite code del em i ins q s small span strike strong sub sup tt u".split())
DROPPED = frozenset("script style noscript iframe object textarea title".split())
SCHEMES = ("http://", "https://", "mailto:")
ENCODED = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "@": "&#64;", "=": "&#61;", "+": "&#43;", "`": "&#96;"})


class _Safe(HTMLParser):
    def __init__(self, limit: int | None):
        super().__init__(convert_charrefs=True)
        self.limit, self.spent, self.out, self.open, self.hidden = limit, 0, [], [], 0

    @property
    def full(self) -> bool:
        return self.limit is not None and self.spent > self.limit

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in DROPPED
        if self.full or self.hidden:
            return
        href = next((v for k, v in attrs if k == "href" and v and v.lower().startswith(SCHEMES)), None)
        if tag == "a" and href:
            self.out.append(f'<a href="{href.translate({34: "&#34;", 38: "&amp;", 60: "&lt;", 62: "&gt;"})}" rel="nofollow">')
        elif tag in INLINE:
            self.out.append(f"<{tag} />" if tag == "br" else f"<{tag}>")
        else:
            return
        if tag != "br":
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in DROPPED and self.hidden > 0
        if not self.full and tag in self.open:
            while True:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        if self.hidden or self.full:
            return
        left = None if self.limit is None else self.limit - self.spent
        self.spent += len(data)
        if left is not None and len(data) > left:
            data = "..." if left < 4 else data[: left - 3] + "..."
        self.out.append(data.translate(ENCODED))

    def result(self) -> str:
        return "".join(self.out) + "".join(f"</{t}>" for t in reversed(self.open))


def safe_html(value: str | None, limit: int | None = None) -> str | None:
    if value is None:
        return None
    p = _Safe(limit)
    p.feed(value)
    p.close()
    return p.result()


def sanitise(c: Column | str, limit: int | None = None) -> Column:
    """Safe HTML of a column, its text cut to ``limit`` characters."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: safe_html(v, limit), na_action="ignore")

    return run(F.col(c) if isinstance(c, str) else c)

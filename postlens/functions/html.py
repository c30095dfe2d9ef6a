"""HTML to text, as Arrow-batched functions: the standard parser walks each document once.

Where broken markup would be repaired by a tree builder, this reads the tags as they come.
"""

from __future__ import annotations

import html as entities
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose content is dropped, elements that break a line, elements and attributes that a
# cleaned description may keep.
DROPPED = {"script", "style", "noscript", "iframe", "object", "embed", "svg"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "section", "article", "br", "blockquote", "dd", "dt"}
KEPT = {"p", "br", "ul", "ol", "li", "strong", "b", "em", "i", "u", "h1", "h2", "h3", "h4", "h5", "h6", "a", "blockquote", "code", "pre", "table", "thead", "tbody", "tr", "td", "th", "hr"}
VOID = {"br", "hr", "img", "input", "meta", "link", "embed"}


class _Walker(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skipping = 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED and tag not in VOID:
            self.skipping += 1
        elif not self.skipping:
            self.opened(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        if not self.skipping and tag not in DROPPED:
            self.opened(tag, attrs)
            if tag not in VOID:
                self.closed(tag)

    def handle_endtag(self, tag):
        if tag in DROPPED:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping:
            self.closed(tag)

    def handle_data(self, data):
        if not self.skipping:
            self.text(data)

    def run(self, source: str):
        self.feed(source)
        self.close()
        return self


class _Lines(_Walker):
    """Text with a break at every text node (bullets marked), or at blocks only."""

    def __init__(self, blocks_only: bool):
        super().__init__()
        self.blocks_only, self.out, self.items = blocks_only, [], 0

    def opened(self, tag, attrs):
        if tag == "li" and not self.blocks_only:
            self.out.append("\n")
            self.items += 1
            self.bullet = True
        elif tag in BLOCKS:
            self.out.append("\n")

    def closed(self, tag):
        if tag == "li":
            self.items = max(0, self.items - 1)
        if tag in BLOCKS:
            self.out.append("\n")

    def text(self, data):
        if self.blocks_only or self.items:
            if self.items and getattr(self, "bullet", False) and data.strip():
                data, self.bullet = f"- {data.lstrip()}", False
            self.out.append(data)
        else:
            self.out.append(f"{data}\n")


def to_text(source: str | None) -> str:
    """Readable lines: list items marked, entities read, runs of blank lines one."""
    if not source or not source.strip():
        return ""
    text = "".join(_Lines(blocks_only=False).run(source).out)
    text = entities.unescape(text).replace("\xa0", " ")
    lines = "\n".join(line.strip() for line in text.splitlines())
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def to_blocks(source: str | None) -> str:
    """One line a block; inline elements do not part a sentence."""
    if not source or not source.strip():
        return ""
    text = "".join(_Lines(blocks_only=True).run(source).out)
    text = entities.unescape(text).replace("\xa0", " ").replace("​", "")
    return "\n".join(re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in text.splitlines() if line.strip())


class _Cleaner(_Walker):
    def __init__(self):
        super().__init__()
        self.out, self.open = [], []

    def opened(self, tag, attrs):
        if tag not in KEPT:
            return
        href = next((v for k, v in attrs if k == "href" and v and re.match(r"(?i)\s*(?:https?|mailto):", v)), None) if tag == "a" else None
        link = f' href="{entities.escape(href.strip())}" rel="noopener noreferrer"' if href else ""
        self.out.append(f"<{tag}{link}>")
        if tag not in VOID:
            self.open.append(tag)

    def closed(self, tag):
        if tag in self.open:
            while self.open:
                last = self.open.pop()
                self.out.append(f"</{last}>")
                if last == tag:
                    break

    def text(self, data):
        self.out.append(entities.escape(data, quote=False))


def cleaned(source: str | None) -> str:
    """The description with allowed elements and link schemes only, and every element closed."""
    if not source or not source.strip():
        return ""
    walker = _Cleaner().run(source)
    return ("".join(walker.out) + "".join(f"</{t}>" for t in reversed(walker.open))).strip()


def links(source: str | None) -> list[str]:
    """Link targets and embedded URLs in order, each once."""
    if not source:
        return []
    found = re.findall(r"""(?i)(?:href|src|action|data-url)\s*=\s*["']([^"']+)["']|(https?://[^\s"'<>\\]+)""", source)
    return list(dict.fromkeys(entities.unescape(a or b).rstrip(".,;)") for a, b in found))


def _function(f, kind):
    @F.pandas_udf(kind)
    def run(column: pd.Series) -> pd.Series:
        return column.map(f, na_action=None)

    return run


html_text = _function(to_text, T.StringType())
html_blocks = _function(to_blocks, T.StringType())
html_clean = _function(cleaned, T.StringType())
html_links = _function(links, T.ArrayType(T.StringType()))

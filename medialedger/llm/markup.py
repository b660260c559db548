"""HTML markup in one pass: where comments, raw text and tags begin and end, in time that is linear in any page.

A tag ends at the first '>' outside of quoted values; quotes count after an equals sign only. A quote that is never closed is
an ordinary character, and a tag whose every '>' is within quotes ends at the first of them; a start without any '>' behind it
is text. What was searched for in vain once is not searched for again, so no page is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][\w:-]*+)([^<>=]*+>)?|[!?/])")
#: The rest of a usual tag, which ends within so many characters.
USUAL, LOOK = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=(?!\s*+[\"']))*+>"), 400
STEP = re.compile(r"[^>=]*+(?:(>)|=\s*+([\"'])?+)")
LONG_NUMBER = re.compile(r"&#([0-9]{100,});?")


class Scanner:
    """Finds the ends of tags in one page."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {x: page.rfind(x) for x in ('"', "'", ">", "<!--")}
        self.doomed: set[int] = set()  # from here no '>' follows outside of quotes
        self.closing: dict[str, re.Pattern] = {}

    def tag_end(self, at: int) -> int:
        """After the '>' of a tag whose name ends at `at`; -1 if none follows."""
        page, pos, seen = self.page, at, []
        if at > self.last[">"]:
            return -1
        usual = None if self.doomed else USUAL.match(page, at, at + LOOK)
        if usual:
            return usual.end()
        while pos not in self.doomed:
            seen.append(pos)
            m = STEP.match(page, pos)
            if m is None:
                break
            pos = m.end()
            if m[1]:
                return pos
            if m[2] and pos <= self.last[m[2]]:
                pos = page.find(m[2], pos) + 1
        self.doomed.update(seen)
        return page.find(">", at) + 1

    def close_of(self, tag: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag stands."""
        if tag not in self.closing:
            self.closing[tag] = re.compile(rf"</{tag}\s*+>", re.I)
        m = self.closing[tag].search(self.page, at)
        return m.span() if m else None


def tokens(page: str, raw: frozenset[str], closed: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, str, str, str]]:
    """The markup of a page in order: start, end, kind, tag and attributes. Kinds are "comment", "raw" (an element with all that it
    holds), "open", "close" and "other". What `raw` elements hold is not looked at; without an end they run to the page's; so with
    `closed` ones, but those without an end are ordinary tags.
    """
    scan, pos = Scanner(page), 0
    open_ended: set[str] = set()
    while m := START.search(page, pos):
        start = m.start()
        if m[1]:
            end = page.find("-->", start + 4)
            pos = len(page) if end < 0 else end + 3
            yield start, pos, "comment", "", ""
            continue
        if not m[3]:
            end = page.find(">", m.end()) if m.end() <= scan.last[">"] else -1
            if end < 0:
                pos = m.end()
                if pos > scan.last["<!--"]:
                    return
                continue
            pos = end + 1
            yield start, pos, "other", "", ""
            continue
        end = m.end() if m[4] else scan.tag_end(m.end())
        if end < 0:
            pos = m.end()
            if pos > scan.last["<!--"]:
                return
            continue
        tag = m[3].lower()
        if not m[2] and tag in raw or tag in closed and not m[2] and tag not in open_ended:
            found = scan.close_of(tag, end)
            if found or tag in raw:
                pos = found[1] if found else len(page)
                yield start, pos, "raw", tag, ""
                continue
            open_ended.add(tag)
        pos = end
        yield start, end, "close" if m[2] else "open", tag, page[m.end(3) : end - 1]


def short_numbers(text: str) -> str:
    """Character references by numbers of absurd length, which Python refuses to read, by shorter ones of the same meaning."""
    return LONG_NUMBER.sub(lambda m: f"&#{(m[1].lstrip('0') or '0')[:9]};", text) if "&#" in text else text

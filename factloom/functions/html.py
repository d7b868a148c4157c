"""Main content and links of HTML pages, parsed in Arrow batches with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

#: Elements whose text is never content, elements around content, and elements that end a line.
DROPPED = {"script", "style", "noscript", "nav", "footer", "header", "aside", "form", "svg", "template"}
BLOCKS = {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.lines, self.title, self.in_title, self.links = 0, [""], "", False, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag == "title":
            self.in_title = True
        if tag in DROPPED:
            self.skip += 1
        elif tag in BLOCKS and not self.skip:
            self.lines.append({"h1": "# ", "h2": "## ", "h3": "### ", "h4": "### ", "li": "- "}.get(tag, ""))

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS and not self.skip:
            self.lines.append("")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.lines[-1] += data


def _read(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _contents(html: pd.Series) -> pd.DataFrame:
    out = []
    for h in html:
        page = _read(h)
        lines = [" ".join(x.split()) for x in page.lines]
        seen = dict.fromkeys(x for x in lines if x.strip("#- "))
        out.append((" ".join(page.title.split()), "\n".join(seen), page.links))
    return pd.DataFrame(out, columns=["title", "text", "links"])


def main_content(html):
    """Title, lines of content (headings as #, list items as -, each line once) and link targets in order."""
    return F.pandas_udf(_contents, "struct<title:string,text:string,links:array<string>>")(html)


#: Links to persons' pages, words of menus that are no persons, and roles.
PROFILE = re.compile(r"/(?:profiles?|people|leaders?|leadership|team|board|bio)/[^/?#]+", re.I)
NO_PERSONS = ("navigation", "language", "cookie", "menu", "skip to", "united states", "worldwide", "english", "chinese", "deutsch", "español", "português")
ROLE = re.compile(r"\b(Chief(?:\s+[A-Za-z][A-Za-z /&-]{1,50})?(?:\s+Officer)?|Global Head[A-Za-z /&-]{0,60}|Regional Managing Director[A-Za-z /&-]{0,40}|Board Member|Chair(?:man|person)?)\b", re.I)


class _Cards(HTMLParser):
    """Links to persons with what names them: image labels, then the link's own label or title; and their text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.open: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "a" and PROFILE.search(a.get("href") or ""):
            self.open = {"href": a["href"], "label": a.get("aria-label") or a.get("title") or "", "images": [], "words": []}
            self.cards.append(self.open)
        elif tag == "img" and self.open is not None and (a.get("alt") or "").strip():
            self.open["images"].append(a["alt"].strip())

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = None

    def handle_data(self, data):
        if self.open is not None and data.strip():
            self.open["words"].append(" ".join(data.split()))


def _people(html: str | None) -> list[str]:
    page, out = _Cards(), {}
    page.feed(html or "")
    page.close()
    for card in page.cards:
        slug = re.sub(r"[?#].*$", "", card["href"]).rstrip("/").rsplit("/", 1)[-1]
        name = next(iter(card["images"]), "") or card["label"].strip() or " ".join(w.capitalize() for w in slug.replace("_", "-").split("-") if w.isalpha())
        low = name.lower()
        if not re.search("[A-Za-z]{2,}", name) or len(name) > 60 or "," in name or any(w in low for w in NO_PERSONS) or low in out:
            continue
        role = ROLE.search(re.sub(r"\bPronouns?\b.*$", "", " ".join(card["words"][:12]), flags=re.I))
        role = " ".join(role[0].split()).strip(" -|/") if role else ""
        out[low] = f"{name} serves as {role}." if len(role) >= 4 and role.lower() not in low else f"{name} is listed among the organization's leaders."
    return list(out.values())


def people_lines(html):
    """Sentences on the persons that a page's profile links name, with their roles; each person once."""
    return F.pandas_udf(lambda s: s.map(_people), "array<string>")(html)


#: What a page's frame is marked by, beside its elements; lines that are left of it; characters of a body that are kept.
FRAME_ROLES = {"navigation", "banner", "contentinfo", "complementary"}
FRAME_IDS = {"onetrust-consent-sdk", "cookie-banner"}
FRAME_CLASSES = {"ot-sdk-container", "cookie-banner", "cookie-consent", "cookies", "newsletter", "subscribe", "social-share", "share-buttons", "breadcrumb", "breadcrumbs", "menu", "site-menu", "mobile-menu"}
CRUMB = re.compile(r"(back|close|news archive|menu|skip to (content|main)|accept all|reject all)\s*", re.I)
BODY_CHARS = 80_000
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Body(HTMLParser):
    """Lines of a page's main part, or else its article, or else all of it, without frames."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []  # elements, and whether they begin a frame
        self.lines: dict[str, list[str]] = {"main": [], "article": [], "": []}
        self.title, self.mark = "", ""

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in BLOCKS:
                self.line("")
            return
        a = {k: (v or "") for k, v in attrs}
        frame = tag in DROPPED or tag == "iframe" or a.get("role") in FRAME_ROLES or a.get("id") in FRAME_IDS or a.get("aria-label") == "breadcrumb" or bool(FRAME_CLASSES & set(a.get("class", "").split()))
        self.open.append((tag, frame))
        if tag in BLOCKS:
            self.line({"h1": "# ", "h2": "## ", "h3": "### ", "h4": "### ", "li": "- "}.get(tag, ""))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag in BLOCKS:
            self.line("")

    def line(self, mark: str) -> None:
        for part in self.lines.values():
            part.append(mark)

    def handle_data(self, data):
        tags = [t for t, _ in self.open]
        if "title" in tags:
            self.title += data
        elif not any(frame for _, frame in self.open):
            for part, lines in self.lines.items():
                if part in ("", *tags):
                    lines[-1:] = [(lines[-1] if lines else "") + data]


def _page_text(html: str | None, url: str | None) -> str:
    page = _Body()
    page.feed(html or "")
    page.close()
    tidy = lambda lines: [x for x in (" ".join(y.split()) for y in lines) if x.strip("#- ")]
    lines = next((x for part in ("main", "article", "") if (x := tidy(page.lines[part]))), [])
    body = "\n".join(x for x in lines if not CRUMB.fullmatch(x))
    people = "\n".join(_people(html))
    whole = body + ("\n\n" if body and people else "") + people
    return f"# {' '.join(page.title.split()) or url}\n\nSource: {url}\n\n{whole[:BODY_CHARS]}"


def page_text(html, url):
    """A page as it is stored: its title and URL, the lines of its main part without frames, and the persons it names."""
    return F.pandas_udf(lambda h, u: pd.Series([_page_text(x, y) for x, y in zip(h, u, strict=True)]), "string")(html, url)

"""Whether a page holds prose or only its frame, from the lines of its body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.arrays import let

#: Phrases of page frames, and lines that are menu entries.
CHROME = (
    "site map", "sitemap", "privacy policy", "terms of use", "terms of service", "cookie policy", "cookie preferences", "cookie settings", "cookie", "cookies", "accessibility", "close menu", "sign in", "log in", "log out", "subscribe",
    "newsletter", "reject all", "accept all", "confirm my choices", "personalize ads", "targeted advertising", "cookie list", "leg.interest", "all rights reserved", "follow us", "skip to content", "skip to main",
)
NAV_LINE = r"(?i)^(home|about|about us|contact|contact us|careers|blog|news|newsroom|solutions|products|services|resources|support|help|faq|login|sign in|sign out|log in|log out|close menu|search|menu|pricing|partners|company|investors)\s*$"


def body_lines(html: Column) -> Column:
    """Lines of a page's body: scripts, styles and frames dropped, block elements ending lines, other tags blanks."""
    t = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|iframe|nav|footer|header)\b[^>]*>.*?</(script|style|noscript|svg|iframe|nav|footer|header)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)</?(p|div|li|ul|ol|br|tr|table|section|article|main|h[1-6]|title|head|body)\b[^>]*>", "\n"), r"(?s)<[^>]*>", " ")
    return F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _capitalised(line: Column) -> Column:
    """Whether all words of letters alone begin with a capital."""
    return ~F.exists(_words(line), lambda w: w.rlike("^[A-Za-z]+$") & ~w.rlike("^[A-Z]"))


def prose_lines(lines: Column) -> Column:
    """Lines without menu entries, short lines of the frame, and capitalised crumbs that are no names; headings and items stay."""
    def stays(x: Column) -> Column:
        letters = F.filter(_words(x), lambda w: w.rlike("^[A-Za-z]+$"))
        person = F.size(letters).between(2, 4) & ~F.exists(letters, lambda w: ~w.rlike("^[A-Z][a-z]*$"))
        crumb = (F.size(_words(x)) <= 6) & _capitalised(x) & ~person & ~x.rlike("[.!?]") & (F.char_length(x) < 60)
        framed = (F.char_length(x) < 80) & F.exists(F.array(*map(F.lit, CHROME)), lambda m: F.lower(x).contains(m))
        return x.startswith("#") | x.startswith("- ") | ~(x.rlike(NAV_LINE) | framed | crumb)

    return F.filter(lines, stays)


def page_quality(lines: Column, links: Column, least: int = 400) -> Column:
    """unique_prose_chars, link_density, chrome_hits, chrome_heavy and reason (ok, or why a page is thin)."""
    def judged(x: Column) -> Column:
        unique = F.array_join(x["prose"], " ")
        whole, n = F.lower(F.array_join(x["lines"], " ")), F.char_length(unique)
        words = F.greatest(F.lit(1), F.size(F.regexp_extract_all(F.when(n > 0, unique).otherwise(F.array_join(x["lines"], " ")), F.lit("[A-Za-z]{2,}"), F.lit(0))))
        titled = F.size(F.filter(F.slice(x["lines"], 1, 40), lambda y: (F.size(_words(y)) <= 5) & _capitalised(y) & ~y.rlike("[.!?]")))
        known = F.struct(n.alias("n"), (links / F.greatest(words / 8.0, F.lit(1.0))).alias("density"), F.size(F.filter(F.array(*map(F.lit, CHROME)), lambda m: whole.contains(m))).alias("hits"), titled.alias("titled"), F.size(F.regexp_extract_all(unique, F.lit("[.!?]"), F.lit(0))).alias("stops"))

        def told(k: Column) -> Column:
            heavy = ((k["hits"] >= 4) & (k["n"] < 3 * least)) | ((k["titled"] >= 8) & (k["n"] < 2 * least))
            reason = F.when(k["n"] < least, "short_prose").when((k["density"] > 4.0) & (k["n"] < 2 * least), "high_link_density").when(heavy & (k["n"] < 2 * least), "chrome_heavy").when((k["stops"] < 2) & (k["n"] < 1.5 * least), "few_sentences").otherwise("ok")
            return F.struct(k["n"].alias("unique_prose_chars"), F.round(k["density"], 3).alias("link_density"), k["hits"].alias("chrome_hits"), heavy.alias("chrome_heavy"), reason.alias("reason"))

        return let(known, told)

    return let(F.struct(lines.alias("lines"), prose_lines(lines).alias("prose")), judged)

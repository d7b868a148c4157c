"""URL and path functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path shapes of core, chronicle, people and skipped pages.
CORE = ("/about", "/leader", "/leadership", "/our-team", "/team/", "/company", "/who-we-are", "/our-story", "/management", "/executives", "/board", "/what-we-do", "/services", "/solutions", "/offerings", "/capabilities", "/products", "/platform", "/partnerships", "/partners", "/docs", "/documentation", "/developer", "/developers", "/support/docs", "/help/docs")
CHRONICLE = ("/news", "/newsroom", "/press", "/blog", "/blogs", "/insights", "/articles", "/stories", "/podcast", "/webinar", "/events", "/decoder", "/glossary", "/tag/", "/tags/", "/category/")
PEOPLE = ("/profiles/leaders", "/profiles/board", "/about-us/leaders", "/about/leaders", "/about/team", "/company/leaders", "/company/leadership", "/leadership-team", "/leadership", "/our-team", "/management-team", "/board-of-directors", "/executives")
SKIPPED = ("/clients/", "/client/", "/case-stud", "/case_stud", "/customer-stor", "/success-stor", "/decoder", "/glossary", "/tag/", "/tags/", "/category/", "/careers/jobs", "/job/", "/jobs/", "/events/", "/webinar", "/podcast", "/login", "/signin", "/sign-in", "/cart", "/checkout")
#: Endings that are never pages.
STATIC = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".css", ".js", ".json", ".mp4", ".mp3", ".woff", ".woff2", ".ttf", ".ico", ".zip")


def either(markers: tuple[str, ...]) -> str:
    """A pattern that any of the markers matches; markers hold no pattern characters but dots."""
    return "(" + "|".join(m.replace(".", "[.]") for m in markers) + ")"


def url_path(u: Column) -> Column:
    """Lower-case path of a URL, or of a crawled file's name."""
    raw = F.regexp_replace(u, r"^\s+|\s+$", "")
    of_url = F.lower(F.regexp_replace(F.regexp_replace(raw, r"[?#].*$", ""), r"^https?://[^/]*", ""))
    of_name = F.replace(F.concat(F.lit("/"), F.replace(F.replace(F.lower(raw), F.lit(".md"), F.lit("")), F.lit("_"), F.lit("/"))), F.lit("//"), F.lit("/"))
    return F.when(raw.startswith("http"), F.when(of_url == "", "/").otherwise(of_url)).otherwise(of_name)


def is_chronicle(path: Column) -> Column:
    return path.rlike(either(CHRONICLE))


def is_people(path: Column) -> Column:
    return path.rlike(either(PEOPLE))


def is_core(path: Column) -> Column:
    """Chronicle pages aren't core, wherever they lie."""
    return ~is_chronicle(path) & path.rlike(either(CORE))


def is_skipped(path: Column) -> Column:
    return path.rlike(either(SKIPPED))


def locale(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^/([a-z]{2}-[a-z]{2})(/|$)", 1), F.lit(""))


def trust_weight(u: Column) -> Column:
    """Source trust: people, core, chronicle, other web pages, other documents."""
    p = url_path(u)
    web = u.rlike(r"^\s*https?://") | F.lower(u).rlike(r"^\s*www\.")
    return F.when(is_people(p), 0.92).when(is_core(p), 0.88).when(is_chronicle(p), 0.42).when(web, 0.62).otherwise(0.78)


def crawl_priority(u: Column) -> Column:
    """Lower is sooner."""
    p = url_path(u)
    slashes = F.char_length(p) - F.char_length(F.replace(p, F.lit("/"), F.lit("")))
    return (
        F.when(is_chronicle(p), 80).when(is_people(p), 3).when(is_core(p), 6).when(p.rlike("/profiles?/"), 45).when(p.isin("", "/"), 12).when(slashes <= 1, 18).when(p.rlike("/(careers|investors|radar)"), 25).otherwise(40)
    )


def clean_url(u: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(u, r"[?#].*$", "")


def host(u: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)), r"^www\.", "")


def slug(u: Column) -> Column:
    """File name of a crawled page."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^https?://[^/]*", ""), r"^/+|/+$", ""), "/", "_")
    safe = F.substring(F.regexp_replace(F.when(path == "", "index").otherwise(path), r"[^A-Za-z0-9._-]+", "_"), 1, 80)
    return F.concat(F.regexp_extract(u, r"^https?://([^/?#]*)", 1), F.lit("_"), safe, F.lit(".md"))


def section(u: Column) -> Column:
    """Corpus section of a web page, by its first path segment."""
    first = F.regexp_extract(url_path(u), r"^/+([^/]+)", 1)
    return (
        F.when(first == "", "site-home").when(first.isin("news", "press", "blog", "insights", "articles"), "chronicle").when(first.isin("about", "about-us", "company", "who-we-are"), "identity")
        .when(first.isin("services", "solutions", "what-we-do", "offerings", "products"), "offerings").when(first.contains("leader") | first.contains("team"), "people").otherwise(F.substring(first, 1, 40))
    )


def ancestors(path: Column) -> Column:
    """All proper ancestors of a path, nearest first, the root last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.when(F.size(parts) > 1, F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(parts) > 0, F.concat(F.transform(steps, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))), F.array(F.lit("/")))).otherwise(F.array().cast("array<string>"))


#: Questions for news.
CHRONICLE_ASKED = r"\b(news|press|blog|announced|announcement|insights?\s+blog|podcast|webinar|yesterday|last\s+week)\b"


def asks_chronicle(q: Column) -> Column:
    return q.rlike("(?i)" + CHRONICLE_ASKED)

"""A crawl over stored pages and links: which links count, which pages are kept, and in which order they come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import quality, text, web
from factloom.operators.lineage import cut
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.texts import _PATH, _U, _urls

#: Path words that biographies don't repeat, and words that name no topic.
STRUCTURAL_WORDS = ("profiles", "profile", "leaders", "leadership", "team", "board", "people", "about", "executives", "management")
NO_TOPICS = ("the", "and", "for", "our", "com", "www")


@query("s10_skip_policy", f"""WITH {_U}, l AS (SELECT page_id, p, regexp_extract(url, '^https?://[^/?#]*') AS host, regexp_extract(p, '^/([a-z]{{2}}-[a-z]{{2}})(/|$)', 1) AS loc FROM x), s AS (SELECT host, min(loc) AS seed FROM l WHERE p NOT LIKE '/%/%' GROUP BY 1)
    SELECT page_id, regexp_matches(p, '/clients?/|/case[-_]stud|/customer-stor|/success-stor|/decoder|/glossary|/tags?/|/category/|/careers/jobs|/jobs?/|/events/|/webinar|/podcast|/login|/signin|/sign-in|/cart|/checkout') OR (loc <> '' AND loc <> coalesce(seed, '')) AS skipped FROM l LEFT JOIN s USING (host)""")
def _(d: Data) -> DataFrame:
    """Pages that aren't crawled: by path, and mirrors in another locale than their host's top pages."""
    l = _urls(d).select("page_id", F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("host"), web.url_path(F.col("url")).alias("p"))  # noqa: E741
    l = l.withColumn("loc", F.coalesce(web.locale(F.col("p")), F.lit("")))  # noqa: E741
    seed = l.where("p NOT LIKE '/%/%'").groupBy("host").agg(F.min("loc").alias("seed"))
    other = (F.col("loc") != "") & (F.col("loc") != F.coalesce("seed", F.lit("")))
    return l.join(seed, "host", "left").select("page_id", (web.is_skipped(F.col("p")) | other).alias("skipped"))


def absolute(href: Column, base: Column) -> Column:
    """A link resolved against its page, without query and fragment."""
    origin = F.regexp_extract(base, "^https?://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"([^/:])/[^/]*$", "$1")
    full = F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^https?:", 0), href)).when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.regexp_replace(full, r"[?#].*$", "")


@query("s11_page_links", r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS href FROM pages), t AS (SELECT page_id, url, trim(href) AS href FROM h), k AS (SELECT * FROM t WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|javascript:|tel:)')),
    a AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^https?:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^https?://[^/?#]*') || href ELSE regexp_extract(regexp_replace(url, '[?#].*$', '') || '/', '^(https?://.*[^/:])/[^/]*/?$', 1) || '/' || href END, '[?#].*$', '') AS link FROM k)
    SELECT page_id, link, count(*) AS n FROM a WHERE regexp_matches(link, '^https?:') AND NOT regexp_matches(lower(link), '\.(png|jpg|jpeg|gif|webp|svg|css|js|json|mp4|mp3|woff|woff2|ttf|ico|zip)$') GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    """Links of pages, made absolute; anchors, mail, scripts and static files aren't links."""
    href = F.trim("href")
    found = d.pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))).alias("href"))
    links = found.where((href != "") & ~href.rlike("^(#|mailto:|javascript:|tel:)")).select("page_id", absolute(href, F.col("url")).alias("link"))
    static = "(" + "|".join(x.replace(".", r"\.") for x in web.STATIC) + ")$"
    return links.where(F.col("link").rlike("^https?:") & ~F.lower("link").rlike(static)).groupBy("page_id", "link").agg(F.count("*").alias("n"))


def plain(html: Column) -> Column:
    """The words of a page, roughly: scripts, styles and tags dropped."""
    return text.stripped(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>", " "), r"(?s)<[^>]*>", " "), r"\s+", " "))


def topic_tokens(u: Column) -> Column:
    """Up to six words of a path that its page should hold."""
    parts = F.filter(F.split(F.regexp_replace(web.url_path(u), "^/+|/+$", ""), "/"), lambda s: ~s.isin("", "index", "home", "en", "www"))
    words = F.flatten(F.transform(parts, lambda s: F.split(F.regexp_replace(s, "[^a-z0-9-]+", "-"), "-")))
    return F.slice(F.filter(words, lambda w: (F.char_length(w) >= 3) & ~w.isin(*NO_TOPICS)), 1, 6)


def topic_weak(u: Column, t: Column) -> Column:
    """Whether a page barely holds the words of its path; for people only their names count."""
    low, words = F.lower(t), topic_tokens(u)
    names = F.filter(words, lambda w: ~w.isin(*STRUCTURAL_WORDS))
    found = lambda ws: F.size(F.filter(ws, lambda w: low.contains(w)))
    need = lambda ws, small: F.when(F.size(ws) <= small, 1).otherwise(F.greatest(F.lit(1), F.floor(F.size(ws) / 2)))
    one = F.get(words, 0)
    times = F.when(F.char_length(one) > 0, (F.char_length(low) - F.char_length(F.replace(low, one, F.lit("")))) / F.char_length(one))
    people = F.when(F.size(names) == 0, False).otherwise(found(names) < need(names, 2))
    return F.when(F.size(words) == 0, False).when(web.is_people(web.url_path(u)), people).when(F.size(words) == 1, times < 2).otherwise(found(words) < need(words, 1))


_WORDS = r"""list_filter(flatten(list_transform(list_filter(string_split(trim(p, '/'), '/'), lambda s: s NOT IN ('', 'index', 'home', 'en', 'www')), lambda s: string_split(regexp_replace(s, '[^a-z0-9-]+', '-', 'g'), '-'))), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for', 'our', 'com', 'www'))[1:6]"""
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|nav)[^>]*>.*?</(script|style|nav)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"""
#: SQL: every page at its URL and, numbered from a million on, at the URL of its first link; each with the words and links of its own text.
_BODY = rf"""b AS (SELECT page_id, url, html FROM pages UNION ALL SELECT 1000000 + page_id, regexp_extract(url, '^https?://[^/?#]*') || regexp_extract(html, '<a href="(/[^"]*)"', 1), html FROM pages), v AS (SELECT page_id, {_PATH} AS p, regexp_extract(url, '^https?://[^/?#]*') AS host, {_PLAIN} AS t, len(regexp_extract_all(html, '<a ')) AS links FROM b),
    w AS MATERIALIZED (SELECT page_id, p, host, regexp_matches(p, '/profiles/leaders|/about-us/leaders|/leadership') AS people, t, lower(t) AS low, links, {_WORDS} AS words FROM v),
    n AS (SELECT *, list_filter(words, lambda w: w NOT IN ('profiles', 'profile', 'leaders', 'leadership', 'team', 'board', 'people', 'about', 'executives', 'management')) AS names FROM w),
    weak AS MATERIALIZED (SELECT *, CASE WHEN len(words) = 0 THEN false WHEN people THEN len(names) > 0 AND len(list_filter(names, lambda w: contains(low, w))) < CASE WHEN len(names) <= 2 THEN 1 ELSE greatest(1, len(names) // 2) END
        WHEN len(words) = 1 THEN (length(low) - length(replace(low, words[1], ''))) / length(words[1]) < 2 ELSE len(list_filter(words, lambda w: contains(low, w))) < greatest(1, len(words) // 2) END AS weak FROM n)"""


def _bodies(d: Data) -> DataFrame:
    """Every page at its URL and, numbered from a million on, at the URL of its first link; each with the words and links of its own text."""
    host = F.regexp_extract("url", "^https?://[^/?#]*", 0)
    linked = d.pages.select((1_000_000 + F.col("page_id")).alias("page_id"), F.concat(host, F.regexp_extract("html", r'<a href="(/[^"]*)"', 1)).alias("url"), "html")
    both = d.pages.select("page_id", "url", "html").unionByName(linked)
    return both.select("page_id", "url", host.alias("host"), plain(F.col("html")).alias("t"), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).alias("links"))


@query("s16_topic_coverage", f"WITH {_BODY} SELECT page_id, weak FROM weak")
def _(d: Data) -> DataFrame:
    """Whether pages barely hold the words of their path."""
    return _bodies(d).select("page_id", topic_weak(F.col("url"), F.col("t")).alias("weak"))


@query("s17_crawl_decision", f"""WITH {_BODY}, q AS (SELECT *, length(t) AS size, links / greatest(greatest(1, len(regexp_extract_all(t, '[A-Za-z]{{2,}}'))) / 8.0, 1.0) AS density, len(regexp_extract_all(t, '[.!?]')) AS stops, page_id = min(page_id) OVER (PARTITION BY host, page_id >= 1000000) AS seed FROM weak),
    verdict AS (SELECT *, size < 400 OR (density > 4.0 AND size < 800) OR (stops < 2 AND size < 600) AS thin, people AND size >= 400 AS person FROM q)
    SELECT page_id, CASE WHEN thin AND NOT person THEN 'skip_thin' WHEN size < 40 THEN 'skip_thin' WHEN weak AND seed AND NOT person THEN 'skip_weak' ELSE 'keep' END AS decision FROM verdict""")
def _(d: Data) -> DataFrame:
    """Whether a crawled page is kept, each by its own text; biographies of enough prose always are, and a host's first page must hold the words of its path."""
    t, size, p = F.col("t"), F.char_length("t"), web.url_path(F.col("url"))
    density = F.col("links") / F.greatest(F.greatest(F.lit(1), F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{2,}"), F.lit(0)))) / 8.0, F.lit(1.0))
    thin = (size < 400) | ((density > 4.0) & (size < 800)) | ((F.size(F.regexp_extract_all(t, F.lit("[.!?]"), F.lit(0))) < 2) & (size < 600))
    person = web.is_people(p) & (size >= 400)
    pages = cut(_bodies(d))
    seeds = pages.groupBy("host", F.col("page_id") >= 1_000_000).agg(F.min("page_id").alias("page_id")).select("page_id", F.lit(True).alias("seed"))
    told = pages.join(seeds, "page_id", "left")
    return told.select("page_id", F.when((thin & ~person) | (size < 40), "skip_thin").when(topic_weak(F.col("url"), t) & F.coalesce("seed", F.lit(False)) & ~person, "skip_weak").otherwise("keep").alias("decision"))


def crawl(pages: DataFrame, links: DataFrame, seeds: DataFrame, depth: int = 4, most: int = 500, leads: DataFrame | None = None) -> DataFrame:
    """host, url, depth, place of pages (host, url, priority) that a crawl from the seeds (host, url) reaches by links (host, url, to) of one host.

    With ``leads`` (host, to, page), a link names what it opens, and all pages of that name are reached: links of many pages
    to many pages are given by their two ends alone, and each name is opened once, at its least depth.
    Pages are found level by level, each at its least depth, the levels written; a host's pages come by depth,
    priority and name, ``most`` of them.
    """
    found = seeds.join(pages, ["host", "url"], "left_semi").select("host", "url", F.lit(0).alias("depth"))
    frontier, opened = found, None
    for level in range(1, depth + 1):
        ahead = frontier.join(links, ["host", "url"]).select("host", "to").distinct()
        if leads is not None:
            names = cut(ahead if opened is None else ahead.join(opened, ["host", "to"], "left_anti"))
            opened = names if opened is None else opened.unionByName(names)
            ahead = names.join(leads, ["host", "to"]).select("host", F.col("page").alias("to")).distinct()
        ahead = ahead.withColumnRenamed("to", "url").join(pages, ["host", "url"], "left_semi")
        frontier = cut(ahead.join(found, ["host", "url"], "left_anti").select("host", "url", F.lit(level).alias("depth")))
        found = found.unionByName(frontier)
    order = Window.partitionBy("host").orderBy("depth", "priority", "url")
    return found.join(pages, ["host", "url"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("host", "url", "depth", "place")


@query("s07_crawl_order", f"""WITH RECURSIVE {_U}, h AS MATERIALIZED (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*') AS host, p AS url FROM x), k AS MATERIALIZED (SELECT host, url, CASE WHEN regexp_matches(url, '/(news|newsroom|press|blog|blogs|insights|articles|stories|podcast|webinar|events|decoder|glossary)|/tags?/|/category/') THEN 80 WHEN regexp_matches(url, '/profiles/leaders|/about-us/leaders|/leadership') THEN 3 WHEN regexp_matches(url, '/about|/products') THEN 6 WHEN regexp_matches(url, '/profiles?/') THEN 45 WHEN url IN ('', '/') THEN 12
        WHEN length(url) - length(replace(url, '/', '')) <= 1 THEN CASE WHEN false THEN 0 ELSE 18 END WHEN regexp_matches(url, '/(careers|investors|radar)') THEN 25 ELSE 40 END AS priority FROM h),
    l AS MATERIALIZED (SELECT a.host, a.url, b.url AS dst FROM h a JOIN h b ON a.host = b.host AND a.url <> b.url AND ((a.url = '/' AND length(b.url) - length(replace(b.url, '/', '')) <= 1) OR (a.url <> '/' AND substr(b.url, 2, 2) = substr(a.url, 2, 2)))),
    w(host, url, depth) AS (SELECT host, url, 0 FROM h WHERE url = '/' UNION SELECT w.host, l.dst, depth + 1 FROM w JOIN l ON l.host = w.host AND l.url = w.url WHERE depth < 4), f AS (SELECT host, url, min(depth) AS depth FROM w GROUP BY ALL)
    SELECT host, url, CAST(depth AS INTEGER) AS depth, CAST(row_number() OVER o AS INTEGER) AS place FROM f JOIN k USING (host, url) WINDOW o AS (PARTITION BY host ORDER BY depth, priority, url) QUALIFY row_number() OVER o <= 500""")
def _(d: Data) -> DataFrame:
    """A crawl replayed over the stored pages: from each host's home page to its top pages, and on to pages of like names."""
    path = web.url_path(F.col("url"))
    pages = cut(_urls(d).select(F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("host"), path.alias("url"), web.crawl_priority(F.col("url")).alias("priority")).distinct())
    slashes = F.char_length("url") - F.char_length(F.replace(F.col("url"), F.lit("/"), F.lit("")))
    # the home page opens its host's top pages, any other the pages of its first two letters
    home, alike = F.lit("home"), F.concat(F.lit(":"), F.substring("url", 2, 2))
    links = pages.select("host", "url", F.when(F.col("url") == "/", home).otherwise(alike).alias("to"))
    leads = pages.where(slashes <= 1).select("host", home.alias("to"), F.col("url").alias("page")).unionByName(pages.select("host", alike.alias("to"), F.col("url").alias("page")))
    return crawl(pages, links, pages.where("url = '/'").select("host", "url"), leads=leads)


_FRAMES = "CASE page_id % 6 WHEN 0 THEN '<p>Home</p><p>Contact Us</p><p>Our Great Products</p><p>Ada King</p><p>Accept all cookies</p><p>All rights reserved</p><p>Follow us</p><p>Sign in</p>' WHEN 1 THEN '<p>Alpha Beta</p><p>Gamma Delta Eps</p><p>Zeta Eta</p><p>Theta Iota</p><p>Kappa Lam</p><p>Mu Nu</p><p>Xi Omi</p><p>Pi Rho</p><p>Sig Tau Ups Phi Chi</p>' ELSE '' END"
_CAPITAL = "len(list_filter(string_split({x}, ' '), lambda w: regexp_full_match(w, '[A-Za-z]+') AND NOT regexp_matches(w, '^[A-Z]'))) = 0"


@query("s15_quality_gate", rf"""WITH h AS (SELECT page_id, {_FRAMES} || html AS html FROM pages), t AS (SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|svg|iframe|nav|footer|header)\b[^>]*>.*?</(script|style|noscript|svg|iframe|nav|footer|header)>', chr(10), 'g'), '(?i)</?(p|div|li|ul|ol|br|tr|table|section|article|main|h[1-6]|title|head|body)\b[^>]*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM h),
    l AS MATERIALIZED (SELECT page_id, links, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM t),
    u AS MATERIALIZED (SELECT page_id, links, lines, list_filter(lines, lambda x: x[1] = '#' OR starts_with(x, '- ') OR NOT (regexp_matches(x, '(?i)^(home|about|about us|contact|contact us|careers|blog|news|newsroom|solutions|products|services|resources|support|help|faq|login|sign in|sign out|log in|log out|close menu|search|menu|pricing|partners|company|investors)\s*$')
        OR (length(x) < 80 AND regexp_matches(lower(x), 'site map|sitemap|privacy policy|terms of use|terms of service|cookie|accessibility|close menu|sign in|log in|log out|subscribe|newsletter|reject all|accept all|confirm my choices|personalize ads|targeted advertising|leg\.interest|all rights reserved|follow us|skip to content|skip to main'))
        OR (len(string_split(x, ' ')) <= 6 AND {_CAPITAL.format(x='x')} AND NOT (len(list_filter(string_split(x, ' '), lambda w: regexp_full_match(w, '[A-Za-z]+'))) BETWEEN 2 AND 4 AND len(list_filter(string_split(x, ' '), lambda w: regexp_full_match(w, '[A-Za-z]+') AND NOT regexp_full_match(w, '[A-Z][a-z]*'))) = 0) AND NOT regexp_matches(x, '[.!?]') AND length(x) < 60))) AS prose FROM l),
    k AS (SELECT page_id, length(array_to_string(prose, ' ')) AS n, links / greatest(greatest(1, len(regexp_extract_all(CASE WHEN len(prose) > 0 THEN array_to_string(prose, ' ') ELSE array_to_string(lines, ' ') END, '[A-Za-z]{{2,}}'))) / 8.0, 1.0) AS density, len(list_filter(['site map', 'sitemap', 'privacy policy', 'terms of use', 'terms of service', 'cookie policy', 'cookie preferences', 'cookie settings', 'cookie', 'cookies', 'accessibility', 'close menu', 'sign in', 'log in', 'log out', 'subscribe', 'newsletter', 'reject all', 'accept all', 'confirm my choices', 'personalize ads', 'targeted advertising', 'cookie list', 'leg.interest', 'all rights reserved', 'follow us', 'skip to content', 'skip to main'], lambda m: contains(lower(array_to_string(lines, ' ')), m))) AS hits,
        len(list_filter(lines[1:40], lambda y: len(string_split(y, ' ')) <= 5 AND {_CAPITAL.format(x='y')} AND NOT regexp_matches(y, '[.!?]'))) AS titled, len(regexp_extract_all(array_to_string(prose, ' '), '[.!?]')) AS stops FROM u), j AS (SELECT *, (hits >= 4 AND n < 1200) OR (titled >= 8 AND n < 800) AS heavy FROM k)
    SELECT page_id, CAST(n AS INTEGER) AS unique_prose_chars, round(density, 3)::DOUBLE AS link_density, CAST(hits AS INTEGER) AS chrome_hits, heavy AS chrome_heavy, CASE WHEN n < 400 THEN 'short_prose' WHEN density > 4.0 AND n < 800 THEN 'high_link_density' WHEN heavy AND n < 800 THEN 'chrome_heavy' WHEN stops < 2 AND n < 600 THEN 'few_sentences' ELSE 'ok' END AS reason FROM j""")
def _(d: Data) -> DataFrame:
    """Whole pages, some with frames put before them: how much prose they hold, and why they are thin."""
    k = F.col("page_id")
    frames = F.when(k % 6 == 0, "<p>Home</p><p>Contact Us</p><p>Our Great Products</p><p>Ada King</p><p>Accept all cookies</p><p>All rights reserved</p><p>Follow us</p><p>Sign in</p>").when(k % 6 == 1, "<p>Alpha Beta</p><p>Gamma Delta Eps</p><p>Zeta Eta</p><p>Theta Iota</p><p>Kappa Lam</p><p>Mu Nu</p><p>Xi Omi</p><p>Pi Rho</p><p>Sig Tau Ups Phi Chi</p>").otherwise("")
    pages = d.pages.select("page_id", F.concat(frames, "html").alias("html"))
    q = quality.page_quality(quality.body_lines(F.col("html")), F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))))
    return pages.select("page_id", q.alias("q")).select("page_id", "q.*")

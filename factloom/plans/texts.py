"""Web, gate, signal, chunk and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import html, text, web
from factloom.operators import chunks, retrieval
from factloom.plans.datasets import Data
from factloom.plans.registry import query

_E = web.either
#: URLs with the paths that rules look for, besides the pages' own.
_PATHS = ("/about-us/leaders", "/news/press/1", "/products/x", "/about/news", "/careers", "/profiles/a", "/", "/en-au/about", "/jobs/7", "/contact")
_URLS = "SELECT page_id, url FROM pages UNION ALL SELECT 1000000 + page_id * 10 + i, regexp_extract(url, '^https?://[^/?#]*') || p FROM pages, (SELECT unnest(range(10)) AS i, unnest([" + ", ".join(f"'{p}'" for p in _PATHS) + "]) AS p) WHERE page_id < 20"
_PATH = "CASE WHEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '') = '' THEN '/' ELSE lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', '')) END"
_U = f"u AS ({_URLS}), v AS (SELECT *, {_PATH} AS p FROM u), x AS (SELECT *, regexp_matches(p, '{_E(web.CHRONICLE)}') AS chronicle, regexp_matches(p, '{_E(web.PEOPLE)}') AS people, NOT regexp_matches(p, '{_E(web.CHRONICLE)}') AND regexp_matches(p, '{_E(web.CORE)}') AS core FROM v)"


def _urls(d: Data) -> DataFrame:
    more = d.pages.where("page_id < 20").select("page_id", "url", F.posexplode(F.array(*map(F.lit, _PATHS))))
    more = more.select((1000000 + F.col("page_id") * 10 + F.col("pos")).alias("page_id"), F.concat(F.regexp_extract("url", "^https?://[^/?#]*", 0), "col").alias("url"))
    return d.pages.select("page_id", "url").unionByName(more)


@query("f11_path_class", f"WITH {_U} SELECT page_id, chronicle, people, core, regexp_matches(p, '{_E(web.SKIPPED)}') AS skipped FROM x")
def _(d: Data) -> DataFrame:
    p = web.url_path(F.col("url"))
    return _urls(d).select("page_id", web.is_chronicle(p).alias("chronicle"), web.is_people(p).alias("people"), web.is_core(p).alias("core"), web.is_skipped(p).alias("skipped"))


@query("f12_trust", f"WITH {_U} SELECT page_id, CASE WHEN people THEN 0.92 WHEN core THEN 0.88 WHEN chronicle THEN 0.42 ELSE 0.62 END::DOUBLE AS trust FROM x")
def _(d: Data) -> DataFrame:
    return _urls(d).select("page_id", web.trust_weight(F.col("url")).alias("trust"))


@query("f13_section", f"""WITH {_U}, s AS (SELECT page_id, regexp_extract(p, '^/+([^/]+)', 1) AS f FROM x) SELECT page_id, CASE WHEN f = '' THEN 'site-home' WHEN f IN ('news', 'press', 'blog', 'insights', 'articles') THEN 'chronicle'
    WHEN f IN ('about', 'about-us', 'company', 'who-we-are') THEN 'identity' WHEN f IN ('services', 'solutions', 'what-we-do', 'offerings', 'products') THEN 'offerings' WHEN contains(f, 'leader') OR contains(f, 'team') THEN 'people' ELSE substr(f, 1, 40) END AS section FROM s""")
def _(d: Data) -> DataFrame:
    return _urls(d).select("page_id", web.section(F.col("url")).alias("section"))


@query("f14_criticality", f"SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name || ' ' || p_type || c), '{'|'.join(text.CRITICAL)}') THEN 'Critical' WHEN regexp_matches(lower(p_name || ' ' || p_type || c), '{'|'.join(text.IMPORTANT)}') THEN 'Important' ELSE 'Informational' END AS criticality FROM (SELECT *, CASE p_size % 5 WHEN 0 THEN ' policy' WHEN 1 THEN ' api' ELSE '' END AS c FROM part)")
def _(d: Data) -> DataFrame:
    t = F.concat("p_name", F.lit(" "), "p_type", F.when(F.col("p_size") % 5 == 0, " policy").when(F.col("p_size") % 5 == 1, " api").otherwise(""))
    return d.table("part").select("p_partkey", text.criticality(t).alias("criticality"))


@query("s08_crawl_priority", f"""WITH {_U} SELECT page_id, CASE WHEN chronicle THEN 80 WHEN people THEN 3 WHEN core THEN 6 WHEN regexp_matches(p, '/profiles?/') THEN 45 WHEN p = '/' THEN 12 WHEN length(p) - length(replace(p, '/', '')) <= 1 THEN 18
    WHEN regexp_matches(p, '/(careers|investors|radar)') THEN 25 ELSE 40 END AS priority FROM x""")
def _(d: Data) -> DataFrame:
    return _urls(d).select("page_id", web.crawl_priority(F.col("url")).alias("priority"))


@query("s09_canonical", f"""WITH {_U} SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '') AS host,
    regexp_extract(url, '^https?://([^/?#]*)', 1) || '_' || substr(regexp_replace(CASE WHEN s = '' THEN 'index' ELSE s END, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 80) || '.md' AS slug
    FROM (SELECT *, replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '^/+|/+$', '', 'g'), '/', '_') AS s FROM x)""")
def _(d: Data) -> DataFrame:
    u = F.col("url")
    return _urls(d).select("page_id", web.clean_url(u).alias("clean"), web.host(u).alias("host"), web.slug(u).alias("slug"))


@query("s10_locale_skip", f"WITH {_U} SELECT page_id, nullif(regexp_extract(p, '^/([a-z]{{2}}-[a-z]{{2}})(/|$)', 1), '') AS locale FROM x")
def _(d: Data) -> DataFrame:
    return _urls(d).select("page_id", web.locale(web.url_path(F.col("url"))).alias("locale"))


@query("j17_nearest_ancestor", f"""WITH {_U}, h AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*') AS host, CASE WHEN length(p) > 1 THEN regexp_replace(p, '/+$', '') ELSE p END AS p FROM x)
    SELECT a.host, a.p, arg_max(b.p, length(b.p)) AS parent FROM h a JOIN h b ON a.host = b.host AND a.p <> b.p AND (b.p = '/' OR starts_with(a.p, b.p || '/')) GROUP BY ALL""")
def _(d: Data) -> DataFrame:
    """Nearest existing ancestor: every page's ancestors are exploded, so the range join is an equi-join."""
    p = F.regexp_replace(web.url_path(F.col("url")), "(?<=.)/+$", "")
    h = _urls(d).select(F.regexp_extract("url", "^https?://[^/?#]*", 0).alias("host"), p.alias("p")).distinct()
    up = h.select("host", "p", F.posexplode(web.ancestors(F.col("p"))).alias("distance", "parent"))
    found = up.join(h.select("host", F.col("p").alias("parent")), ["host", "parent"])
    return found.groupBy("host", "p").agg(F.min_by("parent", "distance").alias("parent"))


@query("s11_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def _(d: Data) -> DataFrame:
    """Links of pages, one row each."""
    return d.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("s13_main_content")
def _(d: Data) -> DataFrame:
    """Title and content lines of HTML pages."""
    return chunks.small_batches(d.pages).select("page_id", html.main_content("html").alias("m")).select("page_id", "m.title", "m.text", F.size("m.links").alias("n_links"))


@query("s13_page_text")
def _(d: Data) -> DataFrame:
    """Pages as they are stored: title, URL, main lines without frames, persons."""
    return chunks.small_batches(d.pages).select("page_id", html.page_text("html", "url").alias("text"))


@query("s14_people_lines")
def _(d: Data) -> DataFrame:
    """Persons on pages: those of a made-up grid of leaders, one card for each supplier, and whatever the stored pages link."""
    k, n = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    name = F.concat(F.element_at(F.array(*map(F.lit, ("Ada", "Grace", "Alan"))), (k % 3 + 1).cast("int")), F.lit(" "), F.element_at(F.array(*map(F.lit, ("Hopper", "Turing"))), (k % 2 + 1).cast("int")))
    label = F.when(k % 4 == 0, F.concat(F.lit('><noscript><img alt="'), name, F.lit('"></noscript>'))).when(k % 4 == 1, F.concat(F.lit(' aria-label="'), name, F.lit('">'))).when(k % 4 == 2, F.lit(' title="Main menu">')).otherwise(F.lit(">"))
    card = F.concat(F.lit('<a href="/profiles/leaders/'), F.lower(F.replace(name, F.lit(" "), F.lit("-"))), F.lit('"'), label, F.lit("<p>"), F.when(k % 3 == 0, "Chief Data Officer").when(k % 3 == 1, "Board Member Pronouns she").otherwise("Reads a lot"), F.lit("</p></a>"))
    made = d.table("supplier").select((2_000_000 + k).alias("page_id"), F.concat(F.lit("<html><body>"), card, card, F.lit("</body></html>")).alias("html"))
    return made.unionByName(d.pages.select("page_id", "html")).select("page_id", F.explode(html.people_lines("html")).alias("line"))


@query("s15_page_quality")
def _(d: Data) -> DataFrame:
    """Link density, prose and reasons why a page is thin."""
    m = chunks.small_batches(d.pages).select("page_id", html.main_content("html").alias("m"))
    words = F.size(F.filter(F.split("m.text", r"\s+"), lambda w: w != ""))
    density = F.size("m.links") / F.greatest(words / 8.0, F.lit(1.0))
    prose = F.char_length("m.text")
    reason = F.when(prose < 400, "short_prose").when(density > 4, "high_link_density").when(text.boilerplate_penalty(F.col("m.text")) >= 1.0, "chrome_heavy")
    return m.select("page_id", prose.alias("prose_chars"), F.round(density, 3).alias("link_density"), reason.alias("thin_reason"))


_QUESTIONS = ("hello there!", "How do you do?", "I will kill the process now", "compare SL3000 and SL2000", "what a b-i.t.c.h", "good morning", "you 1d10t", "What is Quartz?", "difference between alpha and beta", "fuck   you", "hi what is this", "A vs B", "plain words", "want some sex now", "hey there you hot stuff", "hello darling are you in", "you are a spic", "make a bomb")


def _questions(d: Data) -> DataFrame:
    q = d.spark.range(len(_QUESTIONS)).select(F.col("id").alias("q"), F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("id") + 1).cast("int")).alias("t"))
    return q.unionByName(d.messages.where("role = 'user'").select((1000 + F.col("id")).alias("q"), F.col("content").alias("t")))


_Q = "q AS (SELECT unnest(range(" + str(len(_QUESTIONS)) + ")) AS q, unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in _QUESTIONS) + "]) AS t UNION ALL SELECT 1000 + id, content FROM messages WHERE role = 'user')"


@query("f01_moderation", rf"""WITH {_Q}, n AS (SELECT *, translate(regexp_replace(regexp_replace(lower(regexp_replace(t, '^\s+|\s+$', '', 'g')), '[*._-]+', ' ', 'g'), '\s+', ' ', 'g'), '013@', 'oiea') AS plain FROM q), b AS (SELECT *, t || chr(10) || plain AS bo, regexp_extract_all(plain, '[a-z]+') AS w FROM n)
    SELECT q, CASE WHEN regexp_matches(bo, '(?i)\b(i\s+will\s+(kill|hurt|rape)|rape\s+you|bomb\s+you|terrorist\s+attack|make\s+a\s+bomb)\b') THEN 'INAPPROPRIATE_THREAT'
        WHEN regexp_matches(bo, '(?i)\b(nigg(er|a)|faggot|fag|tranny|kike|spic|chink|wetback)\b') THEN 'INAPPROPRIATE_HATE'
        WHEN list_has_any(w, string_split('sex sexy sexier sexiest sexual sexually porn porno pornography xxx onlyfans hentai nude nudes naked boobs tits pussy vagina penis cock dick blowjob handjob cybersex orgasm erotic fetish horny nsfw babe babes bae slut whore hookup booty', ' '))
            OR regexp_matches(bo, '(?i)\b(fuck\s+me|send\s+(nudes|pics)|dick\s*pic|hot\s*stuff|make\s+love|sleep\s+with\s+me|kiss\s+me|date\s+me|marry\s+me|love\s+you\s+baby|are\s+you\s+single|wanna\s+hook\s*up|hook\s*up\s+tonight|netflix\s+and\s+chill|masturbat\w*)\b')
            OR regexp_matches(bo, '(?i)\b(how\s+are\s+you|hi|hello|hey)\b.+\b(sexy|hot|babe|baby|darling|sweetheart)\b') OR regexp_matches(bo, '(?i)\b(sexy|hot|babe|baby|darling|sweetheart)\b.+\b(how\s+are\s+you|hi|hello|hey)\b') THEN 'INAPPROPRIATE_SEXUAL'
        WHEN list_has_any(w, string_split('asshole bastard bitch bitches cunt motherfucker dipshit shithead dumbass jackass bullshit', ' ')) OR regexp_matches(bo, '(?i)\b(fuck\s+you|screw\s+you|damn\s+you|kill\s+yourself|kys|go\s+to\s+hell|piece\s+of\s+shit|f+u+c+k+(ing|er|ed|off)?|s+h+i+t+(ty)?|idiot|moron|retard(ed)?)\b') THEN 'INAPPROPRIATE_ABUSE' END AS reason FROM b""")
def _(d: Data) -> DataFrame:
    """Moderation of questions: four classes in their order."""
    return _questions(d).select("q", text.moderation(F.col("t")).alias("reason"))


_GREET = text.GREETING.replace("'", "''")


@query("f03_greeting", rf"WITH {_Q} SELECT q, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) <= 60 AND regexp_matches(t, '(?i){_GREET}') AS greeting FROM q")
def _(d: Data) -> DataFrame:
    return _questions(d).select("q", text.is_greeting(F.col("t")).alias("greeting"))


@query("f24_window", "SELECT event_id, (hour(ts) - 22 + 24) % 24 < 5 AS busy FROM events")
def _(d: Data) -> DataFrame:
    """A maintenance window over midnight."""
    return d.events.select("event_id", text.in_window(F.hour("ts"), 22, 5).alias("busy"))


@query("g07_entity_name", r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(p_name || '_' || p_brand || 'xY (' || p_type || ')', '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_/-]+', ' ', 'g'), '\s+', ' ', 'g')), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g')) AS name,
    regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key FROM part""")
def _(d: Data) -> DataFrame:
    raw = F.concat("p_name", F.lit("_"), "p_brand", F.lit("xY ("), "p_type", F.lit(")"))
    return d.table("part").select("p_partkey", text.entity_name(raw).alias("name"), text.alnum_key(F.col("p_brand")).alias("key"))


@query("amount_parse", r"""SELECT p_partkey, CAST(replace(regexp_extract(s, '(\d{1,3}(,\d{3})+|\d+)(\.\d+)?%?', 1), ',', '') AS DOUBLE) AS amount FROM (SELECT p_partkey, 'Price = $' || CAST(CAST(floor(p_retailprice) AS BIGINT) * 1000 AS VARCHAR) AS s FROM part)""")
def _(d: Data) -> DataFrame:
    s = F.concat(F.lit("Price = $"), (F.floor("p_retailprice") * 1000).cast("string"))
    return d.table("part").select("p_partkey", text.amount(s).alias("amount"))


_PIECES = "SELECT doc_id, k AS ordinal, 780 * k AS char_start, least(n_chars, 780 * k + 900) AS char_end, substr(text, CAST(780 * k + 1 AS BIGINT), 900) AS piece FROM (SELECT *, unnest(range(0, CASE WHEN n_chars <= 900 THEN 1 ELSE CAST(ceil((n_chars - 900) / 780.0) AS BIGINT) + 1 END)) AS k FROM documents)"


@query("r01_chunks", f"SELECT doc_id, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS piece FROM ({_PIECES}) WHERE regexp_matches(piece, '\\S')")
def _(d: Data) -> DataFrame:
    """Chunks of 900 characters with an overlap of 120, broken at headings or blank lines."""
    return chunks.chunked(d.documents.select("doc_id", "text"), "doc_id", "text").select("doc_id", "char_start", "char_end", "piece")


@query("r02_tokens", "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens FROM documents")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def _sql_penalty(t: str) -> str:
    phrases = " + ".join("CASE WHEN regexp_matches({t}, '{p}') THEN 0.35 ELSE 0.0 END".format(t=t, p=p) for p in text.BOILERPLATE)
    words = f"regexp_extract_all({t}, '[A-Za-z]{{3,}}')"
    titled = f"len(list_filter({words}, lambda w: regexp_full_match(w, '[A-Z][a-z]+')))"
    return rf"""CASE WHEN length(regexp_replace({t}, '^\s+|\s+$', '', 'g')) < 20 THEN 0.4 ELSE least(1.5, {phrases} + CASE WHEN len({words}) >= 8 AND {titled} / len({words}) >= 0.72 AND length({t}) < 280 THEN 0.4 ELSE 0.0 END
        + CASE WHEN length({t}) - length(replace({t}, '|', '')) >= 3 OR (length({t}) - length(replace({t}, chr(10), '')) >= 8 AND length({t}) < 400) THEN 0.2 ELSE 0.0 END) END"""


@query("r03_boilerplate", f"SELECT doc_id, round(CAST({_sql_penalty('text')} AS DOUBLE), 4) AS penalty FROM documents")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", F.round(text.boilerplate_penalty(F.col("text")), 4).alias("penalty"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(b, '{p}') THEN '{n}'" for n, p in text.KINDS) + rf" WHEN regexp_matches(b, '{text.NAVISH}') AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 400 THEN 'nav' ELSE 'unknown' END"
_SIGNALS = rf"""s0 AS (SELECT doc_id, lang, text, source || chr(10) || substr(text, 1, 800) AS b, least(1.0::DOUBLE, CAST({_sql_penalty("(source || chr(10) || text)")} AS DOUBLE) / 1.5) AS chrome, len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) AS words, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS size FROM documents),
    s1 AS (SELECT *, {_KIND} AS kind, greatest(0.0, least(1.0, 0.55::DOUBLE * least(1.0::DOUBLE, length(text) / 600.0::DOUBLE) + 0.45::DOUBLE * (1.0 - chrome))) AS f FROM s0), s2 AS (SELECT *, CASE WHEN words < 12 THEN least(f, 0.25) ELSE f END AS prose FROM s1)"""


@query("r04_signals", rf"""WITH {_SIGNALS} SELECT doc_id, round(prose, 3) AS prose_score, round(chrome, 3) AS chrome_score, kind AS doc_kind, regexp_matches(b || text, '\b(20\d{{2}}|19\d{{2}})\b') AS has_dated_claim, (chrome >= 0.75 AND prose < 0.28) OR (kind = 'nav' AND size < 280) OR size < 40 AS quarantine FROM s2""")
def _(d: Data) -> DataFrame:
    """Passage signals."""
    return d.documents.select("doc_id", text.passage_struct(F.col("source"), F.col("text")).alias("s")).select("doc_id", "s.*")


@query("a14_readiness", f"""WITH {_SIGNALS} SELECT lang, count(*) AS scored, count(*) FILTER (WHERE (chrome >= 0.75 AND prose < 0.28) OR (kind = 'nav' AND size < 280) OR size < 40) AS quarantined, round(100.0 * count(*) FILTER (WHERE chrome >= 0.55) / count(*), 1) AS chrome_heavy_pct, count(*) FILTER (WHERE kind = 'policy') AS policies FROM s2 WHERE size >= 20 GROUP BY 1""")
def _(d: Data) -> DataFrame:
    s = text.passage_struct(F.col("source"), F.col("text")).alias("s")
    rows = d.documents.where(F.char_length(text.stripped(F.col("text"))) >= 20).select("lang", s).select("lang", F.col("s.quarantine").alias("q"), F.col("s.chrome_score").alias("c"), F.col("s.doc_kind").alias("k"))
    return rows.groupBy("lang").agg(F.count("*").alias("scored"), F.count_if("q").alias("quarantined"), F.round(100.0 * F.count_if(F.col("c") >= 0.55) / F.count("*"), 1).alias("chrome_heavy_pct"), F.count_if(F.col("k") == "policy").alias("policies"))


_TERM = ("the of", "thntion", "license")


def _sql_lexical() -> str:
    out = []
    for t in _TERM:
        w = 3.0 if " " in t else 1.0
        out.append(f"CASE WHEN contains(lower(text), '{t}') THEN {w} ELSE 0.0 END + CASE WHEN contains(lower(source), '{t}') THEN 1.5 ELSE 0.0 END + 0.15::DOUBLE * ((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)})")
    return " + ".join(out)


@query("r09_lexical_top", f"SELECT doc_id, round(CAST({_sql_lexical()} AS DOUBLE), 4) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def _(d: Data) -> DataFrame:
    """Documents ranked by lexical score."""
    return d.documents.select("doc_id", F.round(text.lexical_score(F.col("text"), F.col("source"), list(_TERM)), 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(25)


@query("r08_term_overlap", f"SELECT doc_id, round(({' + '.join(f'CAST(contains(lower(text), {chr(39)}{t}{chr(39)}) AS INTEGER)' for t in _TERM)}) / {float(len(_TERM))}, 4) AS overlap FROM documents")
def _(d: Data) -> DataFrame:
    """Share of question terms found."""
    return d.documents.select("doc_id", F.round(retrieval.term_overlap(F.col("text"), list(_TERM)), 4).alias("overlap"))


@query("r12_excerpt", """SELECT doc_id, CASE WHEN pos > 0 THEN substr(text, greatest(1, pos - 100), pos + 7 + 220 - greatest(1, pos - 100)) ELSE substr(text, 1, 320) END AS excerpt FROM (SELECT *, instr(lower(text), 'license') AS pos FROM documents)""")
def _(d: Data) -> DataFrame:
    return d.documents.select("doc_id", text.excerpt(F.col("text"), "license").alias("excerpt"))


@query("r13_recency", r"SELECT conv_id, turn, round(CAST(least(1.6, greatest(0.0, (coalesce(list_max(list_transform(regexp_extract_all(substr('in ' || (2010 + conv_id % 15) || ' ' || text, 1, 500), '\b((?:19|20)\d{2})\b', 1), lambda y: CAST(y AS INTEGER))), 2016) - 2016) * 0.16)) AS DOUBLE), 4) AS bonus FROM conversations")
def _(d: Data) -> DataFrame:
    t = F.concat(F.lit("in "), (2010 + F.col("conv_id") % 15).cast("string"), F.lit(" "), "text")
    return d.table("conversations").select("conv_id", "turn", F.round(text.recency_bonus(t), 4).alias("bonus"))


@query("r14_path_bonus", f"WITH {_U} SELECT page_id, CASE WHEN people THEN 8.0 WHEN core THEN 5.0 WHEN chronicle THEN -8.0 ELSE 0.0 END::DOUBLE AS bonus FROM x")
def _(d: Data) -> DataFrame:
    p = web.url_path(F.col("url"))
    return _urls(d).select("page_id", F.when(web.is_people(p), 8.0).when(web.is_core(p), 5.0).when(web.is_chronicle(p), -8.0).otherwise(0.0).alias("bonus"))


@query("r24_trust_score", "SELECT id, round(least(1.0, greatest(0.0, 0.20 * 1.0 + 0.20 * (turn % 5) / 4.0 + 0.35 * coalesce(trust, 0) + 0.25 * least(1.0, length(content) / 600.0) - CASE WHEN decision = 'clarify' THEN 0.15 ELSE 0.0 END)), 4) AS overall FROM messages WHERE role = 'assistant'")
def _(d: Data) -> DataFrame:
    """Component-wise trust."""
    m = d.messages.where("role = 'assistant'")
    return m.select("id", F.round(retrieval.trust(F.lit(1.0), (F.col("turn") % 5) / 4.0, F.coalesce("trust", F.lit(0.0)), F.least(F.lit(1.0), F.char_length("content") / 600.0), F.col("decision") == "clarify"), 4).alias("overall"))


@query("r25_decision", """SELECT id, CASE WHEN trust IS NULL THEN 'refuse' WHEN decision = 'clarify' THEN 'clarify' WHEN trust < 0.55 THEN 'verify' ELSE 'answer' END AS final FROM messages WHERE role = 'assistant'""")
def _(d: Data) -> DataFrame:
    m = d.messages.where("role = 'assistant'")
    return m.select("id", F.when(F.col("trust").isNull(), "refuse").when(F.col("decision") == "clarify", "clarify").when(F.col("trust") < 0.55, "verify").otherwise("answer").alias("final"))


@query("r32_slug_tokens", f"WITH {_U} SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda s: length(s) >= 3)[-4:], ' ') AS tokens FROM x")
def _(d: Data) -> DataFrame:
    parts = F.filter(F.split(web.url_path(F.col("url")), "/"), lambda s: F.char_length(s) >= 3)
    return _urls(d).select("page_id", F.array_join(F.when(F.size(parts) > 4, F.slice(parts, -4, 4)).otherwise(parts), " ").alias("tokens"))


@query("t03_gap_fill", f"""WITH s AS (SELECT doc_id, lower(text) AS t, round(CAST({_sql_lexical()} AS DOUBLE), 4) AS score FROM documents), k AS (SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 6),
    g AS (SELECT term, doc_id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS r FROM s JOIN (SELECT unnest(['the of', 'thntion', 'license']) AS term) ON contains(t, term))
    SELECT doc_id, score FROM k UNION SELECT doc_id, score FROM g WHERE r = 1""")
def _(d: Data) -> DataFrame:
    """The best passages, and for every term the best that has it."""
    s = d.documents.select("doc_id", F.lower("text").alias("t"), F.round(text.lexical_score(F.col("text"), F.col("source"), list(_TERM)), 4).alias("score"))
    return retrieval.evidence_pack(s, list(_TERM), 6)


def _sql_pack() -> str:
    score = " + ".join(f"CASE WHEN contains(lower(piece), '{t}') THEN {3.0 if ' ' in t else 1.0} ELSE 0.0 END + CASE WHEN contains(lower(source), '{t}') THEN 1.5 ELSE 0.0 END + 0.15::DOUBLE * ((length(piece) - length(replace(lower(piece), '{t}', ''))) / {len(t)})" for t in ("the of", "thntion", "license"))
    blob = "(source || chr(10) || piece)"
    return rf"""WITH one AS (SELECT *, 0 AS z FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id DESC) = 1), cut AS (SELECT doc_id, source, unnest(range(0, CASE WHEN n_chars <= 900 THEN 1 ELSE CAST(ceil((n_chars - 900) / 780.0) AS BIGINT) + 1 END)) AS k, text, n_chars FROM one),
    p AS (SELECT doc_id, source, k AS ordinal, 780 * k AS char_start, least(n_chars, 780 * k + 900) AS char_end, regexp_replace(substr(text, CAST(780 * k + 1 AS BIGINT), 900), '^\s+|\s+$', '', 'g') AS piece FROM cut), q AS MATERIALIZED (SELECT *, least(1.0::DOUBLE, CAST({_sql_penalty(blob)} AS DOUBLE) / 1.5) AS chrome, len(regexp_extract_all(piece, '[A-Za-z]{{3,}}')) AS words, length(piece) AS size FROM p WHERE piece <> ''),
    f AS (SELECT *, greatest(0.0, least(1.0, 0.55::DOUBLE * least(1.0::DOUBLE, size / 600.0::DOUBLE) + 0.45::DOUBLE * (1.0 - chrome))) AS full_score FROM q), g AS (SELECT *, CASE WHEN words < 12 THEN least(full_score, 0.25) ELSE full_score END AS prose FROM f),
    s AS (SELECT doc_id, ordinal, char_start, char_end, round(CAST({score} AS DOUBLE), 4) AS score, instr(lower(piece), 'the of') AS pos, piece FROM g WHERE NOT ((chrome >= 0.75 AND prose < 0.28) OR size < 40 OR (size < 280 AND regexp_matches(source || chr(10) || substr(piece, 1, 800), '(?i)\b(site\s*map|cookie|close menu|sign in|log in|skip to (content|main)|all rights reserved)\b')))),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id, ordinal) AS rank FROM s)
    SELECT doc_id, ordinal, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end, score, CASE WHEN pos > 0 THEN substr(piece, greatest(1, pos - 100), pos + 6 + 220 - greatest(1, pos - 100)) ELSE substr(piece, 1, 320) END AS excerpt, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""


@query("lexical_evidence_pack", _sql_pack())
def _(d: Data) -> DataFrame:
    """Deduplicate, chunk, score and rank passages, with excerpts: the flagship."""
    return retrieval.lexical_pack(d.documents, list(_TERM), 20)

"""Evidence packs: passages scored for questions, and what the pack allows to answer. The SQL states its patterns itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import evidence, questions
from factloom.plans.asks import SHAPE, _TEAM, _once
from factloom.plans.datasets import Data
from factloom.plans.registry import query

#: The stated questions that passages are scored for.
SUITE = (
    "Who is the CEO of Acme?", "Who are the executives on the leadership team?", "Compare SL3000 and SL2000", "How do I renew a licence?", "What is a BUILDING account?", "How many offices and how many years since 2010?", "Name some capabilities and services", "difference between gold plan and silver plan?", "Who is in the team?",
    "weather in Rome", "What is the transformation pathway?", "When did 'Grace Hopper' sign?", "Tell me about Cloud Data Services",
)
_SUITE = "s AS (SELECT unnest(range(" + str(len(SUITE)) + ")) AS q, unnest([" + ", ".join("'" + x.replace("'", "''") + "'" for x in SUITE) + "]) AS t)"

_PERSON = r"([A-Z][a-z]+([ \t]+[A-Z]\.?)?([ \t]+[A-Z][A-Za-z''’-]+)+)"
_TITLE = r"(Executive\s+Vice\s+President|Vice\s+President|Chief\s+[A-Z][A-Za-z]+(\s+(and|&)\s+[A-Z][A-Za-z]+)*(\s+[A-Z][A-Za-z]+){0,3}\s+Officer|Managing\s+Director|President(\s+and\s+CEO)?|Chairman|Chairwoman|Chair|CEO|COO|CFO|CTO|CIO|CHRO|CMO|CLO|EVP|SVP)"
#: SQL: passages with their text beside the title, the persons in it, and how much of it is chrome.
_P = rf"""p0 AS (SELECT id, title, text, title || chr(10) || text AS blob FROM passages), p1 AS MATERIALIZED (SELECT *, lower(blob) AS low, list_filter(list_concat(regexp_extract_all(blob, '\b{_PERSON}\b([ \t]*[,–—-][ \t]*|[ \t]+|[ \t]*\n[ \t]*){_TITLE}\b', 1), regexp_extract_all(blob, '\b{_TITLE}\b([ \t]+|[ \t]*\n[ \t]*){_PERSON}\b', 7)),
        lambda n: length(n) >= 5 AND NOT list_has_any(regexp_split_to_array(lower(n), '\s+'), string_split('president chairman chairwoman chief executive operating financial information officer vice managing director partner board company senior global recognized', ' '))) AS named,
        regexp_extract_all(blob, '[A-Za-z]{{3,}}') AS words FROM p0),
    p2 AS MATERIALIZED (SELECT id, title, text, blob, low, {_once('named')} AS people, CASE WHEN length(trim(blob)) < 20 THEN 0.4 ELSE least(1.5::DOUBLE, 0.35::DOUBLE * (CAST(regexp_matches(low, '\bsite\s*map\b') AS INTEGER) + CAST(regexp_matches(low, '\bprivacy\s*policy\b.{{0,80}}\bterms\b') AS INTEGER) + CAST(regexp_matches(low, '\bcookie\s*(policy|preferences|settings|list)\b') AS INTEGER)
            + CAST(regexp_matches(low, '\baccessibility\b.{{0,40}}\b(statement|center|policy)\b') AS INTEGER) + CAST(regexp_matches(low, '\bsubscribe\b.{{0,40}}\bnewsletter\b') AS INTEGER) + CAST(regexp_matches(low, '\b(skip to (content|main)|all rights reserved|follow us)\b') AS INTEGER) + CAST(regexp_matches(low, '\b(accept all|reject all|confirm my choices)\b') AS INTEGER)
            + CAST(regexp_matches(blob, '(\|?[ \t\n\r\f]*[A-Z][A-Za-z &/-]{{2,28}}[ \t\n\r\f]*){{6,}}') AS INTEGER))
        + CASE WHEN len(words) >= 8 AND len(list_filter(words, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) / len(words) >= 0.72 AND length(blob) < 280 THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN length(blob) - length(replace(blob, '|', '')) >= 3 OR (length(blob) - length(replace(blob, chr(10), '')) >= 8 AND length(blob) < 400) THEN 0.2::DOUBLE ELSE 0.0 END) END AS pen FROM p1)"""
#: SQL: labels of offers of a passage.
_LABELS = rf"""l0 AS (SELECT *, list_filter(list_transform(list_concat(regexp_extract_all(text, '(?m)^#{{1,3}}\s+(.+)$', 1), CASE WHEN OFFERS OR regexp_matches(text, '(?i)\b(capabilities|services|offerings?|solutions|what we do|how we help)\b') THEN regexp_extract_all(substr(text, 1, 2400), '\b([A-Z][a-z0-9]+(\s+[A-Z][a-z0-9]+){{1,4}})\b', 1) ELSE [] END), lambda x: regexp_replace(regexp_replace(x, '^[\s#–—|:-]+|[\s#–—|:-]+$', '', 'g'), '\s+', ' ', 'g')),
        lambda x: length(x) BETWEEN 4 AND 60 AND NOT regexp_matches(lower(x), '^(about us|read more|learn more|contact us|get started|how we|what we|why we|our work|case study|case studies|privacy policy|cookie policy|terms of|source|blog|news)')
            AND NOT (regexp_full_match(x, '[A-Z][a-z]+\s+[A-Z][a-z]+') AND NOT regexp_matches(x, '(?i)\b(service|platform|ai|data|cloud|software|product|experience|engineering|advisory|modernization|capability|center|centre)\b'))) AS found FROM p2)"""
_SERVICE = "regexp_matches(lower(title), 'what-we-do|what_we_do|[/_](services|solutions|offerings|capabilities|products|platform)')"


def _suite(d: Data) -> DataFrame:
    return d.spark.range(len(SUITE)).select(F.col("id").alias("q"), F.element_at(F.array(*map(F.lit, SUITE)), (F.col("id") + 1).cast("int")).alias("t"))


def _known() -> dict:
    """What is known of a passage and of a question before they are paired."""
    return {c: F.col(c) for c in ("pen", "n", "density", "qterms", "sides", "anchors")}


def _pairs(d: Data, terms: bool = False) -> DataFrame:
    """q, t, shape (and terms) of the stated questions with every passage: a broadcast of as many rows as SUITE has; pen, n, density, qterms, sides, anchors: the facts of each, computed before the pairs."""
    t = F.col("t")
    asks = _suite(d).select("q", "t", questions.evidence_shape(t).alias("shape"), *([questions.required_terms(t).alias("terms")] if terms else []), *(v.alias(c) for c, v in evidence.question_facts(t).items()))
    return d.passages.select("*", *(v.alias(c) for c, v in evidence.passage_facts(F.col("title"), F.col("text")).items())).crossJoin(F.broadcast(asks))


@query("r05_person_titles", f"WITH {_P} SELECT id, array_to_string(people, '|') AS people FROM p2")
def _(d: Data) -> DataFrame:
    """Persons named beside a title."""
    return d.passages.select("id", F.array_join(evidence.people(evidence.blob_of(F.col("title"), F.col("text"))), "|").alias("people"))


@query("f17_page_shapes", rf"SELECT id, {_SERVICE} AS service, regexp_matches(lower(title), '(leadership|career|learning)[-_]path|(employee|talent|career)-development') AND NOT regexp_matches(lower(title), 'learning_pathx') AS career, regexp_matches(lower(title), '/(insights|blog|news)/|_(insights|blog|news)_|[/_](decoder|glossary)') AS insight, regexp_matches(text, '\b[A-Z][a-z]{{2,}}\.\s+[A-Z][a-z]{{2,}}\.\s+[A-Z][a-z]{{2,}}\.') AS triad FROM passages")
def _(d: Data) -> DataFrame:
    t = F.col("title")
    return d.passages.select("id", evidence.is_service_page(t).alias("service"), evidence.is_career_page(t).alias("career"), evidence.is_insight_page(t).alias("insight"), evidence.has_triad(F.col("text")).alias("triad"))


@query("r28_offering_labels", f"WITH {_P}, {_LABELS.replace('OFFERS', _SERVICE)}, l1 AS (SELECT id, {_once('found', 8)} AS labels FROM l0), m0 AS (SELECT id, found FROM ({_LABELS.replace('OFFERS', 'false').removeprefix('l0 AS (').removesuffix(')')})), m1 AS (SELECT id, len({_once('found', 12)}) AS n FROM m0) SELECT id, array_to_string(labels, '|') AS labels, CASE WHEN n >= 4 THEN 0.9 WHEN n >= 2 THEN 0.55 WHEN n >= 1 THEN 0.3 ELSE 0.0 END::DOUBLE AS density FROM l1 JOIN m1 USING (id)")
def _(d: Data) -> DataFrame:
    """Labels of offers, and how densely they stand."""
    return d.passages.select("id", F.array_join(evidence.offering_labels(F.col("text"), F.col("title"), 8), "|").alias("labels"), evidence.offering_density(F.col("text")).alias("density"))


ANSWERS = (
    "The sources do not contain this.", "The licence is renewed yearly. The sources do not specify a fee.", "I could not find it. It is Rome.", "There is no information about it", "Insufficient evidence.", "It requires two forms [1], and a fee [2].\n\nReferences:\n[1] a.pdf\n[2] b.pdf", "One [1] [2]\nTwo [3]\n\n\n\nThree.\nSources: [1], [2]", "Sources mention gold, but do not state more. End", "[1] [2] [3]",
    "Plain claim.", "  spaced out  [4]  ", "This lies outside the knowledge base.", "",
)
_ANSWERS = "w AS (SELECT unnest(range(" + str(len(ANSWERS)) + ")) AS a, unnest([" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in ANSWERS) + "]) AS t UNION ALL SELECT 1000 + id, content FROM messages WHERE role = 'assistant')"


def _answers(d: Data) -> DataFrame:
    own = d.spark.range(len(ANSWERS)).select(F.col("id").alias("a"), F.element_at(F.array(*map(F.lit, ANSWERS)), (F.col("id") + 1).cast("int")).alias("t"))
    return own.unionByName(d.messages.where("role = 'assistant'").select((1000 + F.col("id")).alias("a"), F.col("content").alias("t")))


@query("f21_unsupported", rf"""WITH {_ANSWERS}, f AS (SELECT a, regexp_extract(regexp_replace(lower(t), '^\s+', ''), '^(.*?[.!?])(\s|$)', 1) AS s, regexp_replace(lower(t), '^\s+|\s+$', '', 'g') AS whole FROM w), g AS (SELECT a, CASE WHEN s = '' THEN whole ELSE s END AS s FROM f)
    SELECT a, regexp_matches(s, '\b(do not|don''t|does not|doesn''t|did not|didn''t)\s+contain\b|\b(do not|don''t|does not|doesn''t)\s+(specify|provide|include|state)\b|\b(no|not\s+any|without\s+any)\s+(information|evidence|data|details|mention|number|count|estimate)\b|\b(could not|couldn''t|cannot|can''t)\s+find\b|\b(not\s+enough|insufficient)\s+evidence\b|\bsources?\s+mention\b.{{0,80}}\bbut\s+do\s+not\b|\bno\s+(specific|relevant)\s+information\b|\boutside\s+(the\s+)?(knowledge\s+base|connected\s+sources)\b')
        OR regexp_matches(s, '\bsources?\s+(do not|don''t|does not|doesn''t|mention.{{0,40}}but)\s+(contain|mention|address|discuss|specify|provide)?\b|\bprovided\s+(sources?|evidence|quotes?)\s+(do not|don''t|does not|doesn''t|mention|discuss)\b') AS unsupported FROM g""")
def _(d: Data) -> DataFrame:
    """Answers whose first sentence says that nothing was found."""
    return _answers(d).select("a", evidence.is_unsupported(F.col("t")).alias("unsupported"))


@query("r30_plain_answers", r"""WITH """ + _ANSWERS + r""", c AS (SELECT a, regexp_replace(regexp_replace(t, '(?is)\n(#{1,3}\s*)?(references|sources|citations)\s*:?\s*\n.*', ''), '^\s+|\s+$', '', 'g') AS t FROM w),
    e AS (SELECT a, regexp_replace(regexp_replace(regexp_replace(t, '(?i)\n*\s*(references|sources|citations)\s*:\s*(\[\d+\](\s*,\s*)?)+\s*$', ''), '(\s*\[\d+\]\s*,?)+\s*$', ''), '(?m)^\s*(\[\d+\]\s*)+\s*$', '', 'g') AS t FROM c),
    l AS (SELECT a, array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(regexp_replace(x, '(\s*\[\d+\])+\s*$', ''), '\s*\[\d+\](\s|,|$)', '\1', 'g')), chr(10)) AS t FROM e)
    SELECT a, regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS answer FROM l""")
def _(d: Data) -> DataFrame:
    """Answers without footers and marks of citation."""
    return _answers(d).select("a", evidence.without_references(F.col("t")).alias("answer"))


_FIT = rf"""x0 AS MATERIALIZED (SELECT q, t, {SHAPE} AS shape, {_TEAM} AS clarify, list_filter(list_concat(regexp_extract_all(t, '\b([A-Z]{{2,}}\d{{2,}}|\d{{3,}}[A-Z]+|[A-Z]{{3,}}\d+)\b'), regexp_extract_all(t, '["'']([^"'']{{3,80}})["'']', 1), list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_-]{{3,}}'), lambda w: NOT list_contains(string_split('about team teams page home site menu contact learn more click here read see view info information general overview introduction leadership leader leaders executive executives management', ' '), lower(w))), regexp_extract_all(t, '\b[A-Z]{{2,4}}\b')), lambda w: length(w) >= 2) AS found FROM s),
    x1 AS MATERIALIZED (SELECT q, t, shape, clarify, {_once('found')} AS terms, CASE q WHEN 2 THEN ['sl3000', 'sl2000'] WHEN 7 THEN ['gold plan', 'silver plan'] ELSE [] END AS sides FROM x0),
    x2 AS (SELECT x1.*, p2.*, least(1.0::DOUBLE, pen / 1.5) AS chrome, len(people) AS n, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda w: contains(low, lower(w)))) / len(terms)::DOUBLE ELSE 0.0 END AS ov, len(list_filter(sides, lambda w: contains(low, w))) AS n_both,
        least(5, len(regexp_extract_all(low, '\b(must|should|require[sd]?|step\s*\d|first|then|next|click|select|submit|enable|disable|configure|install|renew)\b'))) AS actions, least(5, len(regexp_extract_all(low, '(\b20\d{{2}}\b|\b\d{{1,3}}(,\d{{3}})+\+?\b|\b\d+\+\b|\b\d{{1,5}}\s*(%|percent|pages?|people|employees?|offices?|countries?|years?|months?|decades?)\b|\b\d+\s+(street|ave|road|blvd)\b)'))) AS facts,
        regexp_matches(low, '\b(is\s+a|are\s+a|refers\s+to|means|defined\s+as|consists\s+of|provides|represents)\b') AS defines, regexp_matches(low, '\b20\d{{2}}\b') AS dated, regexp_matches(low, '\d{{1,3}}(,\d{{3}})+\+?\s+\w+|\b\d+\+\s+years?\b|\b\d+\s+offices?\b|\b\d+\s+countries?\b') AS metric, regexp_matches(low, '\b(my|his|her|their)\s+\d+\+?\s+years?\b|\b\d+\+?\s+years?\s+of\s+(experience|career)\b') AS personal, regexp_matches(lower(t), '\b(how\s+many|how\s+long|offices?|countries?)\b') AS org FROM x1, p2),
    x3 AS (SELECT *, 0.35::DOUBLE * (1.0 - chrome) + 0.15::DOUBLE * (1.0 - chrome) AS base FROM x2),
    x4 AS MATERIALIZED (SELECT *, CASE shape WHEN 'list_people' THEN CASE WHEN n >= 2 THEN least(1.0, 0.55 + 0.15 * least(n, 4) + base) WHEN n = 1 THEN least(1.0, 0.45 + base) ELSE greatest(0.0, 0.08 * (1.0 - chrome) - 0.2 * chrome) END
        WHEN 'attribute' THEN CASE WHEN n > 0 AND ov >= 0.2 THEN least(1.0, 0.7 + base) WHEN n > 0 OR ov >= 0.45 THEN least(1.0, 0.5 + base) ELSE greatest(0.0, ov * 0.5 + base * 0.3) END
        WHEN 'compare' THEN CASE WHEN len(sides) >= 2 THEN least(1.0, 0.25 * n_both + 0.2 * (1.0 - chrome) + CASE WHEN n_both = 2 THEN 0.35 ELSE 0.0 END) ELSE base + 0.2 * ov END
        WHEN 'how_to' THEN least(1.0, base + 0.12 * actions + 0.15 * ov) WHEN 'define' THEN least(1.0, base + CASE WHEN defines THEN 0.35 ELSE 0.0 END + 0.3 * ov - 0.25 * chrome)
        WHEN 'factoid' THEN least(1.0, base + 0.12 * facts + CASE WHEN dated THEN 0.2 ELSE 0.0 END + CASE WHEN org AND metric THEN 0.35 WHEN org AND personal THEN -0.25 ELSE 0.0 END + 0.25 * ov) ELSE least(1.0, base + 0.45 * ov) END::DOUBLE AS fit FROM x3)"""


@query("r16_contract_fit", f"WITH {_SUITE}, {_P}, {_FIT} SELECT q, id, shape, round(fit, 4) AS fit FROM x4")
def _(d: Data) -> DataFrame:
    """How well every passage has the shape of evidence that the stated questions need."""
    return _pairs(d).select("q", "id", "shape", F.round(evidence.fit(F.col("shape"), F.col("t"), F.col("title"), F.col("text"), _known()), 4).alias("fit"))


@query("r18_quote_support")
def _(d: Data) -> DataFrame:
    """How strongly every passage supports the stated questions."""
    fits = _pairs(d).withColumn("fit", evidence.fit(F.col("shape"), F.col("t"), F.col("title"), F.col("text"), _known()))
    return fits.select("q", "id", F.round(evidence.support(F.col("shape"), F.col("t"), F.col("title"), F.col("text"), F.col("fit"), _known()), 4).alias("support"))


@query("r15_people_bonus", r"""WITH """ + _SUITE + ", " + _P + r""", b AS (SELECT q, id, q = 1 AS roster, q = 0 AS officer, len(people) AS n, low, lower(title) AS tl, blob, title FROM s, p2)
    SELECT q, id, CASE WHEN roster THEN CASE WHEN n >= 2 THEN 12.0 + 2 * least(n, 8) WHEN n = 1 THEN 6.0 WHEN regexp_matches(low, '\b(leadership|executive|board)\b') THEN -7.0 ELSE 0.0 END - CASE WHEN n < 2 AND regexp_matches(tl, '\b(spotlight|employee of the|team of the|celebrat(e|ing)|culture\s+story|meet (the|our) team)\b') THEN 8.0 ELSE 0.0 END
            + CASE WHEN n > 0 AND regexp_matches(tl, 'named|appoint|executive|board|officer|ceo|press|newsroom|letter|leadership') THEN 4.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS roster,
        CASE WHEN officer THEN CASE WHEN regexp_matches(tl, '[/_]leaders|leadership') THEN 10.0 ELSE 0.0 END + CASE WHEN regexp_matches(low, '\bserves\s+as\s+chief\b') THEN 12.0 ELSE 0.0 END + CASE WHEN regexp_matches(blob, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b.{0,40}\bchief\s+executive|\bserves\s+as\s+chief\s+executive') THEN 8.0 ELSE 0.0 END
            - CASE WHEN regexp_matches(low, '\b(former|ex-|stepped\s+down|until\s+20\d\d|from\s+20\d\d\s+(to|until|through)\b|was\s+the\s+c[efot]o|served\s+as\s+c[efot]o)\b') THEN 14.0 ELSE 0.0 END - CASE WHEN regexp_matches(low, '\b(emerita|emeritus|i\s+became\s+cto|was\s+the\s+cto)\b') THEN 12.0 ELSE 0.0 END - CASE WHEN regexp_matches(tl, 'insights|blog|news|letter|social-change|report') THEN 8.0 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS officer FROM b""")
def _(d: Data) -> DataFrame:
    """What passages gain or lose for questions on a roster or an officer."""
    q, title, t = F.col("t"), F.col("title"), F.col("text")
    return _pairs(d).select("q", "id", evidence.roster_bonus(q, title, t).cast("double").alias("roster"), evidence.officer_bonus(q, title, t).cast("double").alias("officer"))


@query("r10_hybrid_top")
def _(d: Data) -> DataFrame:
    """The eight best passages of each stated question by hybrid score."""
    scored = _pairs(d, True).select("q", "id", F.round(evidence.hybrid_score(F.col("shape"), F.col("t"), F.col("terms"), F.col("title"), F.col("text"), F.lit(0.0), _known()), 4).alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 8")


@query("r17_contract_verdict", f"""WITH {_SUITE}, {_P}, {_FIT}, k AS (SELECT * FROM x4 QUALIFY row_number() OVER (PARTITION BY q ORDER BY fit DESC, id) <= 5),
    g AS (SELECT q, any_value(t) AS t, any_value(shape) AS shape, any_value(clarify) AS clarify, any_value(terms) AS terms, any_value(sides) AS sides, string_agg(low, chr(10) ORDER BY fit DESC, id) AS low, max(n) AS n, max(pen) AS pen, avg(fit) AS mean_fit, max(fit) AS best, bool_or(actions > 0) AS acts, bool_or(defines) AS defines, bool_or(facts > 0 OR dated) AS concrete FROM k GROUP BY q),
    h AS (SELECT *, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda w: contains(low, lower(w)))) / len(terms)::DOUBLE ELSE 0.0 END AS ov, len(list_filter(sides, lambda w: contains(low, w))) AS n_both FROM g),
    v AS (SELECT *, CASE WHEN clarify THEN 'TEAM_SCOPE_AMBIGUOUS' WHEN shape = 'list_people' AND n = 0 THEN 'CONTRACT_LIST_PEOPLE_UNMET' WHEN shape = 'attribute' AND n = 0 AND ov < 0.35 THEN 'CONTRACT_ATTRIBUTE_UNMET' WHEN shape = 'compare' AND len(sides) >= 2 AND n_both < 2 THEN 'CONTRACT_COMPARE_UNMET' WHEN shape = 'how_to' AND NOT acts AND ov < 0.35 THEN 'CONTRACT_HOW_TO_UNMET'
        WHEN shape = 'define' AND ov < 0.2 AND NOT defines THEN 'CONTRACT_DEFINE_UNMET' WHEN shape = 'factoid' AND NOT concrete AND ov < 0.35 THEN 'CONTRACT_FACTOID_UNMET' WHEN shape = 'open' AND ((ov < 0.15 AND pen >= 0.7) OR best < 0.252) THEN 'CONTRACT_OPEN_UNMET' ELSE 'CONTRACT_OK' END AS reason FROM h)
    SELECT q, shape, reason, round(least(1.0, CASE WHEN reason = 'CONTRACT_OK' THEN 0.55 ELSE 0.2 END + 0.45 * mean_fit), 4) AS coverage FROM v""")
def _(d: Data) -> DataFrame:
    """Whether the five best passages meet what each stated question needs, why not, and how far."""
    fits = _pairs(d).withColumn("fit", evidence.fit(F.col("shape"), F.col("t"), F.col("title"), F.col("text"), _known()))
    ranked = fits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("fit"), "id"))).where("r <= 5")
    low = F.lower(evidence.blob_of(F.col("title"), F.col("text")))
    each = ranked.select("q", "t", "shape", "r", "fit", low.alias("low"), "n", "pen")
    pack = each.groupBy("q", "t", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "low"))), lambda x: x["low"]), "\n").alias("low"), F.max("n").alias("n"), F.max("pen").alias("pen"), F.avg("fit").alias("mean_fit"), F.max("fit").alias("best"))
    q, has = F.col("t"), lambda p: F.col("low").rlike(p)
    pack = pack.withColumns({"ov": evidence.overlap(questions.question_terms(q), F.col("low")), "sides": F.slice(questions.compare_sides(q), 1, 2), "clarify": questions.needs_team(q)})
    is_ = lambda s: F.col("shape") == s
    both = F.size(evidence.hits(F.col("sides"), F.col("low")))
    reason = (
        F.when(F.col("clarify"), "TEAM_SCOPE_AMBIGUOUS").when(is_("list_people") & (F.col("n") == 0), "CONTRACT_LIST_PEOPLE_UNMET").when(is_("attribute") & (F.col("n") == 0) & (F.col("ov") < 0.35), "CONTRACT_ATTRIBUTE_UNMET")
        .when(is_("compare") & (F.size("sides") >= 2) & (both < 2), "CONTRACT_COMPARE_UNMET").when(is_("how_to") & ~has(evidence.ACTIONABLE) & (F.col("ov") < 0.35), "CONTRACT_HOW_TO_UNMET").when(is_("define") & (F.col("ov") < 0.2) & ~has(evidence.DEFINITIONAL), "CONTRACT_DEFINE_UNMET")
        .when(is_("factoid") & ~has(evidence.CONCRETE) & (F.col("ov") < 0.35), "CONTRACT_FACTOID_UNMET").when(is_("open") & (((F.col("ov") < 0.15) & (F.col("pen") >= 0.7)) | (F.col("best") < 0.42 * 0.6)), "CONTRACT_OPEN_UNMET").otherwise("CONTRACT_OK")
    )
    return pack.withColumn("reason", reason).select("q", "shape", "reason", F.round(F.least(F.lit(1.0), F.when(F.col("reason") == "CONTRACT_OK", 0.55).otherwise(0.2) + 0.45 * F.col("mean_fit")), 4).alias("coverage"))

"""From text to graph: rule entities, fields, evidence spans, merged entities, and what questions resolve to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import evidence, questions, text, web
from factloom.functions.arrays import distinct_ci, found
from factloom.operators.components import components
from factloom.operators.lineage import cut
from factloom.plans.asks import ASKS, _COMPARE, asked
from factloom.plans.datasets import LEAST_PARTS, Data
from factloom.plans.packs import _P, _SUITE, _known, _pairs, _suite
from factloom.plans.registry import query

#: Titles that one task pairs with the stated questions, about: a small file of many rows is one task's otherwise.
TITLES = 25_000
#: Entities that rules find in text, by kind.
ENTITIES = (
    ("Concept", r"([A-Z][\w]+(?:\s+[A-Z][\w+/.-]+){0,6}\s+(?:Agreement|License|Policy|Standard|Specification|Addendum|Amendment))", 8, 90),
    ("Concept", r"([A-Z][\w]+(?:\s+[A-Z][\w]+){0,4}\s+v\d+)\b", 5, 80),
    ("Person", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1, 999),
    ("Concept", r"\b([A-Z]{2,6}-\d{2,})\b", 1, 999),
    ("Concept", r"\b([A-Z]{1,8}\d{2,4})\b", 1, 999),
    ("SecurityLevel", r"(?i)\b((?:Security|Output\s+Protection|License\s+Security)\s+Level\s+\d{2,4})\b", 1, 999),
)
NO_ENTITIES = ("utf8", "utf16", "sha256", "md5")
#: Fields of agreements and cover sheets.
FIELDS = (
    ("Agreement Number", r"(?i)Agreement\s*#\s*[:\s]*([A-Z0-9][\w-]*)"), ("Agreement Number", r"(?i)Agreement\s*(?:Number|No\.?)\s*[:#]?\s*([A-Z0-9][\w-]*)"), ("Company", r"(?i)Company\s*:\s*([^\n\r]+)"),
    ("Signer Email", r"(?i)Signer\s*email\s*:\s*(\S+@\S+)"), ("Approval Token", r"(?i)Approval\s*token\s*:\s*([A-Fa-f0-9]+)"), ("Source Document", r"(?i)Document\s*:\s*([^\n\r]+)"),
)
_SHEETS = """sheets AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Cover. Agreement #: AG-' || s_suppkey || chr(10) || 'Company: ' || s_name || chr(10) WHEN 1 THEN 'Master Supply Agreement for POL-0' || s_suppkey || ' and SL200' || s_suppkey % 10 || '. Agreement No. X' || s_suppkey || chr(10) || 'Signer email: s' || s_suppkey || '@mail.example.org' || chr(10)
    WHEN 2 THEN 'Approval token: ab' || s_suppkey || 'cd' || chr(10) || 'Document: handbook ' || s_suppkey || '.pdf' || chr(10) || 'Output Protection Level 270 and Data Retention Policy v' || (1 + s_suppkey % 3) ELSE 'The Acme Data License of ' || s_name || ' uses SHA256, UTF8 and OPL270' END AS t FROM supplier)"""


def sheets(d: Data) -> DataFrame:
    """id, t: cover sheets of four kinds, one for each supplier"""
    k, n, br = F.col("s_suppkey"), F.col("s_suppkey").cast("string"), F.lit("\n")
    t = F.when(k % 4 == 0, F.concat(F.lit("Cover. Agreement #: AG-"), n, br, F.lit("Company: "), "s_name", br))
    t = t.when(k % 4 == 1, F.concat(F.lit("Master Supply Agreement for POL-0"), n, F.lit(" and SL200"), (k % 10).cast("string"), F.lit(". Agreement No. X"), n, br, F.lit("Signer email: s"), n, F.lit("@mail.example.org"), br))
    t = t.when(k % 4 == 2, F.concat(F.lit("Approval token: ab"), n, F.lit("cd"), br, F.lit("Document: handbook "), n, F.lit(".pdf"), br, F.lit("Output Protection Level 270 and Data Retention Policy v"), (1 + k % 3).cast("string")))
    return d.table("supplier").select(k.alias("id"), t.otherwise(F.concat(F.lit("The Acme Data License of "), "s_name", F.lit(" uses SHA256, UTF8 and OPL270"))).alias("t"))


def entities(t: Column) -> Column:
    """kind and name of every entity that rules find, each name once; the last rule that finds a name decides its kind."""
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def of(rule: int, kind: str, pattern: str, least: int, most: int) -> Column:
        names = F.filter(F.transform(found(t, pattern, 1), tidy), lambda n: F.char_length(n).between(least, most) & ~F.lower(n).isin(*NO_ENTITIES))
        return F.transform(names, lambda n: F.struct(F.lower(n).alias("key"), F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), n.alias("name")))

    return F.flatten(F.array(*(of(i, *e) for i, e in enumerate(ENTITIES))))


_FOUND = r"""SELECT id, lower(n) AS key, {i} AS rule, '{kind}' AS kind, n AS name FROM (SELECT id, trim(regexp_replace(unnest(regexp_extract_all(t, '{pattern}', 1)), '\s+', ' ', 'g')) AS n FROM texts) WHERE length(n) BETWEEN {least} AND {most} AND lower(n) NOT IN ('utf8', 'utf16', 'sha256', 'md5')"""
_RULES = (
    ("Concept", r"([A-Z][\w]+(?:\s+[A-Z][\w+/.-]+){0,6}\s+(?:Agreement|License|Policy|Standard|Specification|Addendum|Amendment))", 8, 90), ("Concept", r"([A-Z][\w]+(?:\s+[A-Z][\w]+){0,4}\s+v\d+)\b", 5, 80), ("Person", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1, 999),
    ("Concept", r"\b([A-Z]{2,6}-\d{2,})\b", 1, 999), ("Concept", r"\b([A-Z]{1,8}\d{2,4})\b", 1, 999), ("SecurityLevel", r"(?i)\b((?:Security|Output\s+Protection|License\s+Security)\s+Level\s+\d{2,4})\b", 1, 999),
)


@query("g10_rule_entities", f"WITH {_SHEETS}, texts AS (SELECT id, t FROM sheets UNION ALL SELECT 1000000 + id, text FROM passages), f AS (" + " UNION ALL ".join(_FOUND.format(i=i, kind=k, pattern=p, least=a, most=b) for i, (k, p, a, b) in enumerate(_RULES)) + ") SELECT id, key, arg_max(kind, rule) AS kind FROM f GROUP BY ALL")
def _(d: Data) -> DataFrame:
    """Entities that rules find in texts: titled agreements, versions, addresses, ids, codes, levels."""
    texts = sheets(d).unionByName(d.passages.select((1000000 + F.col("id")).alias("id"), F.col("text").alias("t")))
    each = texts.select("id", F.explode(entities(F.col("t"))).alias("e")).select("id", "e.*")
    return each.groupBy("id", "key").agg(F.max_by("kind", "rule").alias("kind"))


_FIELD = r"""SELECT id, {i} AS place, '{field}' AS field, trim(regexp_extract(t, '{pattern}', 1)) AS value, instr(t, regexp_extract(t, '{pattern}')) - 1 AS span_start, instr(t, regexp_extract(t, '{pattern}')) - 1 + length(regexp_extract(t, '{pattern}')) AS span_end FROM sheets WHERE regexp_matches(t, '{pattern}')"""
_FIELD_RULES = (("Agreement Number", r"(?i)Agreement\s*#\s*[:\s]*([A-Z0-9][\w-]*)"), ("Agreement Number", r"(?i)Agreement\s*(?:Number|No\.?)\s*[:#]?\s*([A-Z0-9][\w-]*)"), ("Company", r"(?i)Company\s*:\s*([^\n\r]+)"), ("Signer Email", r"(?i)Signer\s*email\s*:\s*(\S+@\S+)"), ("Approval Token", r"(?i)Approval\s*token\s*:\s*([A-Fa-f0-9]+)"), ("Source Document", r"(?i)Document\s*:\s*([^\n\r]+)"))


@query("g11_text_fields", f"WITH {_SHEETS}, f AS (" + " UNION ALL ".join(_FIELD.format(i=i, field=n, pattern=p) for i, (n, p) in enumerate(_FIELD_RULES)) + ") SELECT id, field, value, span_start, span_end, 0.95::DOUBLE AS weight, 0.96::DOUBLE AS confidence FROM f WHERE value <> ''")
def _(d: Data) -> DataFrame:
    """Fields of cover sheets with the span that bears them: the first match of each pattern."""
    t = F.col("t")
    one = lambda field, p: F.struct(F.lit(field).alias("field"), F.trim(F.regexp_extract(t, p, 1)).alias("value"), (F.expr("regexp_instr(t, '" + p.replace("\\", "\\\\") + "')") - 1).cast("long").alias("span_start"), F.char_length(F.regexp_extract(t, p, 0)).cast("long").alias("size"))
    each = sheets(d).select("id", F.explode(F.array(*(one(f, p) for f, p in FIELDS))).alias("f")).select("id", "f.*").where("value <> ''")
    return each.select("id", "field", "value", "span_start", (F.col("span_start") + F.col("size")).alias("span_end"), F.lit(0.95).alias("weight"), F.lit(0.96).alias("confidence"))


#: Fixed value: short codes, which never take in longer names.
CODE_NAME = r"^[a-z]{1,8}\d{2,}$"


def merged_entities(names: DataFrame) -> DataFrame:
    """id, root, alias of entities (id, type, name): those of one name, and those of one type whose names are related, are one; the root is the smallest id, and names that differ from its own are its aliases.

    Related: without blanks and marks the names are equal, or one of six characters or more lies in the other, at most 2.2
    times as long, and neither is a code. Names that hold different numbers are never one: not two versions, not a policy
    and its version, not SL200 and SL2000. That parts all names before any are linked, so no chain of links can join what must stay apart.
    Names meet by their rarest piece. All are taken at once: the outcome doesn't depend on an order.
    """
    numbers = F.array_join(F.regexp_extract_all(F.lower("name"), F.lit(r"\d+"), F.lit(0)), ",")
    keyed = cut(names.select("id", "type", F.lower("name").alias("name"), text.alnum_key(F.col("name")).alias("key"), numbers.alias("numbers")).where("key <> ''"))
    by_name = keyed.groupBy("name").agg(F.min("id").alias("a"))
    same = keyed.join(by_name, "name").where("id <> a").select("a", F.col("id").alias("b"))
    one = keyed.groupBy("type", "numbers", "key").agg(F.min("id").alias("a"))
    alike = keyed.join(one, ["type", "numbers", "key"]).where("id <> a").select("a", F.col("id").alias("b"))
    long = one.where((F.char_length("key") >= 6) & ~F.col("key").rlike(CODE_NAME))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("key") - 4), lambda i: F.substring(F.col("key"), i, 5)))
    place = ["type", "numbers", "g"]
    held = cut(long.select("type", "numbers", "key", "a", F.explode(grams).alias("g")))
    often = held.groupBy(*place).agg(F.count("*").alias("n"))
    rare = held.join(often, place).groupBy("type", "numbers", "key", "a").agg(F.min(F.struct("n", "g"))["g"].alias("g"))
    other = held.select(*place, F.col("key").alias("longer"), F.col("a").alias("b"))
    related = rare.join(other, place).where((F.col("key") != F.col("longer")) & F.col("longer").contains(F.col("key")) & (F.char_length("longer") <= F.char_length("key") * 2.2)).select("a", "b")
    roots = components(same.unionByName(alike).unionByName(related))
    placed = keyed.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "name", F.coalesce("root", "id").alias("root"))
    own = keyed.select(F.col("id").alias("root"), F.col("name").alias("known"))
    return placed.join(own, "root").select("id", "root", F.when(F.col("name") != F.col("known"), F.col("name")).otherwise("").alias("alias"))


@query("g09_merged_entities", r"""WITH RECURSIVE t AS (SELECT id, type, name FROM kg_nodes WHERE type IN ('Product', 'Topic', 'Section') UNION ALL SELECT 'policy:' || p_partkey, 'Concept', CASE p_partkey % 4 WHEN 0 THEN p_brand || ' Data Policy' WHEN 1 THEN p_brand || ' Data Policy v' || p_size ELSE 'SL' || (200 + p_size) || CASE WHEN p_partkey % 4 = 2 THEN '0' ELSE '' END END FROM part),
    k AS MATERIALIZED (SELECT id, type, lower(name) AS name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key, array_to_string(regexp_extract_all(name, '\d+'), ',') AS nums FROM t), n AS MATERIALIZED (SELECT type, nums, key, min(id) AS id FROM k GROUP BY ALL), m AS MATERIALIZED (SELECT name, min(id) AS id FROM k GROUP BY ALL),
    e0 AS (SELECT m.id AS a, k.id AS b FROM k JOIN m USING (name) UNION SELECT n.id, k.id FROM k JOIN n USING (type, key) UNION SELECT x.id, y.id FROM n x JOIN n y ON x.type = y.type AND x.nums = y.nums AND x.key <> y.key AND length(x.key) >= 6 AND NOT regexp_matches(x.key, '^[a-z]{1,8}\d{2,}$') AND NOT regexp_matches(y.key, '^[a-z]{1,8}\d{2,}$') AND contains(y.key, x.key) AND length(y.key) <= length(x.key) * 2.2),
    e AS MATERIALIZED (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b), w(id, r) AS (SELECT id, id FROM k UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.id WHERE w.r < e.b), r AS (SELECT id, min(r) AS root FROM w GROUP BY 1)
    SELECT r.id, root, CASE WHEN k.name <> o.name THEN k.name ELSE '' END AS alias FROM r JOIN k ON k.id = r.id JOIN k o ON o.id = root""")
def _(d: Data) -> DataFrame:
    """Products, topics, sections and policies with their versions and levels, merged by name."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    level = F.concat(F.lit("SL"), (200 + F.col("p_size")).cast("string"), F.when(k % 4 == 2, "0").otherwise(""))
    policy = F.when(k % 4 == 0, F.concat("p_brand", F.lit(" Data Policy"))).when(k % 4 == 1, F.concat("p_brand", F.lit(" Data Policy v"), size)).otherwise(level)
    more = d.table("part").select(F.concat(F.lit("policy:"), k.cast("string")).alias("id"), F.lit("Concept").alias("type"), policy.alias("name"))
    return merged_entities(d.nodes.where("type IN ('Product', 'Topic', 'Section')").select("id", "type", "name").unionByName(more))


@query("g08_question_entities", rf"""WITH {ASKS}, t0 AS (SELECT q, t, {_COMPARE} AS comparison, list_concat(regexp_extract_all(t, '\b[A-Z][A-Za-z0-9]+(\s+[A-Z][A-Za-z0-9]+)*\b'), regexp_extract_all(t, '["“]([^"”]{{2,60}})["”]', 1), regexp_extract_all(t, '\b[A-Za-z]{{1,8}}\d{{2,}}\b')) AS found FROM (SELECT q, t FROM a UNION ALL SELECT 900000 + r_regionkey, 'What is in ' || upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) || ' and the Moon' FROM region UNION ALL SELECT 910000 + n_nationkey, 'Tell me about ' || upper(n_name) FROM nation)),
    t1 AS (SELECT DISTINCT q, comparison, lower(trim(unnest(found))) AS term FROM t0), t2 AS (SELECT * FROM t1 WHERE length(term) >= 3 AND term NOT IN ('what', 'who', 'how', 'when', 'where', 'which', 'why', 'the', 'tell', 'compare', 'does', 'is', 'name', 'find', 'explain') QUALIFY row_number() OVER (PARTITION BY q ORDER BY length(term) DESC, term) <= 12),
    n AS MATERIALIZED (SELECT id, normalized_name AS n FROM kg_nodes WHERE type IN ('Topic', 'Section')), x AS (SELECT q, comparison, term, id, n, 0 AS cls FROM t2 JOIN n ON n = term), y AS (SELECT q, comparison, term, id, n, 1 AS cls FROM t2 JOIN n ON length(term) >= 4 AND starts_with(n, term) AND n <> term),
    r AS (SELECT * FROM x UNION ALL SELECT * FROM y WHERE (q, term) NOT IN (SELECT (q, term) FROM x)), g AS (SELECT q, comparison, term, min(id) AS id, count(*) AS n, max(length(n)) - min(length(n)) AS gap FROM r GROUP BY ALL)
    SELECT q, term, CASE WHEN n > 1 AND gap <= 8 AND NOT comparison THEN NULL ELSE id END AS id, n > 1 AND gap <= 8 AND NOT comparison AS ambiguous FROM g""")
def _(d: Data) -> DataFrame:
    """Entities of questions: names and codes, the twelve longest, by exact name, else by prefix; several alike are ambiguous unless things are compared."""
    name = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 99)))
    more = d.table("region").select((900000 + F.col("r_regionkey")).alias("q"), F.concat(F.lit("What is in "), name(F.col("r_name")), F.lit(" and the Moon")).alias("t")).unionByName(d.table("nation").select((910000 + F.col("n_nationkey")).alias("q"), F.concat(F.lit("Tell me about "), F.upper("n_name")).alias("t")))
    t = F.col("t")
    terms = F.concat(found(t, r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b"), found(t, '["“]([^"”]{2,60})["”]', 1), questions.codes(t))
    each = asked(d).unionByName(more).select("q", questions.is_comparison(t).alias("comparison"), F.explode(distinct_ci(terms)).alias("term")).select("q", "comparison", F.lower(F.trim("term")).alias("term")).distinct()
    kept = each.where((F.char_length("term") >= 3) & ~F.col("term").isin("what", "who", "how", "when", "where", "which", "why", "the", "tell", "compare", "does", "is", "name", "find", "explain"))
    kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.char_length("term")), "term"))).where("r <= 12").drop("r")
    n = d.nodes.where("type IN ('Topic', 'Section')").select("id", F.col("normalized_name").alias("n"))
    exact = kept.join(n, F.col("n") == F.col("term"))
    prefix = n.withColumn("term", F.explode(F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), F.char_length("n") - 1)), lambda i: F.substring(F.col("n"), F.lit(1), i)))).where("term <> n").distinct()
    near = kept.join(exact.select("q", "term"), ["q", "term"], "left_anti").join(prefix, "term")
    g = exact.select("q", "comparison", "term", "id", "n").unionByName(near.select("q", "comparison", "term", "id", "n")).groupBy("q", "comparison", "term").agg(F.min("id").alias("id"), F.count("*").alias("k"), (F.max(F.char_length("n")) - F.min(F.char_length("n"))).alias("gap"))
    ambiguous = (F.col("k") > 1) & (F.col("gap") <= 8) & ~F.col("comparison")
    return g.select("q", "term", F.when(~ambiguous, F.col("id")).alias("id"), ambiguous.alias("ambiguous"))


_TERMS = r"""v0 AS (SELECT q, t, lower(t) AS ql, list_filter(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9_-]{3,}'), lambda w: NOT list_contains(string_split('about team teams page home site menu contact learn more click here read see view info information general overview introduction leadership leader leaders executive executives management who what when where why how which does did are is', ' '), lower(w))) AS w, regexp_extract_all(t, '\b[A-Z]{2,4}\b') AS caps, regexp_extract_all(t, '["'']([^"'']{3,80})["'']', 1) AS quoted, regexp_extract_all(t, '\b([A-Z]{2,}\d{2,}|\d{3,}[A-Z]+|[A-Z]{3,}\d+)\b') AS codes FROM s),
    v1 AS MATERIALIZED (SELECT q, t, ql, list_distinct(list_transform(list_concat(codes, quoted, w, caps), lambda x: lower(x))) AS terms FROM v0)"""


@query("r19_graph_base", f"""WITH {_SUITE}, {_P}, {_TERMS}, o AS (SELECT q, id, pen, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda w: contains(low, w))) / len(terms)::DOUBLE ELSE 0.0 END AS ov FROM v1, p2), r AS (SELECT q, id, greatest(0.0, least(1.0, CASE WHEN ov < 0.15 AND pen >= 0.35 THEN least(0.12, greatest(0.0, ov - 0.35 * pen)) ELSE greatest(0.0, ov - 0.35 * pen) END)) AS rel FROM o)
    SELECT q, id, round(rel, 4)::DOUBLE AS relevance, rel >= 0.45 AND NOT (rel < 0.55) AS leads, round(CASE WHEN rel < 0.2 THEN 0.28 + 0.1 * 0.8 WHEN rel < 0.45 THEN 0.4 + 0.25 * rel + 0.05 * 0.8 ELSE 0.55 + 0.4 * rel + 0.05 * 0.8 END, 4)::DOUBLE AS base FROM r""")
def _(d: Data) -> DataFrame:
    """How far passages, as evidence of a trail of strength .7, answer the stated questions; whether they lead a pack of coverage .5; the score they enter with."""
    blob = evidence.blob_of(F.col("title"), F.col("text"))
    o = _pairs(d).select("q", "id", evidence.content_overlap(F.col("t"), F.lower(blob), _known()).alias("ov"), "pen")
    return o.withColumn("rel", evidence.trail_relevance(F.col("ov"), F.col("pen"))).select("q", "id", F.round("rel", 4).alias("relevance"), evidence.graph_leads(F.col("rel"), F.lit(0.7), F.lit(0.5)).alias("leads"), F.round(evidence.graph_base(F.col("rel"), F.lit(0.8)), 4).alias("base"))


@query("r14_title_bonus", rf"""WITH {_SUITE}, p AS (SELECT q, t, id, title, lower(title) AS path, replace(replace(lower(title), '_', ' '), '-', ' ') AS name, regexp_matches(lower(t), '\b(news|press|blog|announced|announcement|insights?\s+blog|podcast|webinar|yesterday|last\s+week)\b') AS news FROM s, passages),
    w AS (SELECT *, regexp_matches(path, '/about/leaders|/about-us/leaders|/leadership') AS people, regexp_matches(path, '/news|/insights') AS chronicle, regexp_matches(path, '/about|/services') AS core, len(list_filter(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]{{3,}}')), lambda x: x NOT IN ('what', 'how', 'who', 'the', 'and', 'for', 'with', 'from', 'does', 'are', 'can', 'document', 'about') AND contains(name, x))) AS hit FROM p)
    SELECT q, id, CASE WHEN people THEN 8.0 WHEN core AND NOT chronicle THEN 5.0 WHEN chronicle AND NOT news THEN -8.0 ELSE 0.0 END::DOUBLE AS path, least(6.0, 1.5 * hit)::DOUBLE AS words FROM w""")
def _(d: Data) -> DataFrame:
    """What titles gain for the stated questions by their path and by the questions' words."""
    title, t = F.col("title"), F.col("t")
    asks = _suite(d).select("q", web.asks_chronicle(t).alias("news"), evidence.title_words(t).alias("plain"))  # as many rows as SUITE has
    parts = max(LEAST_PARTS, -(-d.table("customer").count() // TITLES))
    told = d.passages.select("id", "title").repartition(parts, "id").select("id", web.url_path(title).alias("path"), evidence.title_name(title).alias("name"))
    told = told.select("id", "name", evidence.place_bonus(F.col("path")).alias("place"))
    path = F.when((F.col("place") < 0) & F.col("news"), 0.0).otherwise(F.col("place"))
    return told.crossJoin(F.broadcast(asks)).select("q", "id", path.cast("double").alias("path"), evidence.name_bonus(F.col("name"), F.col("plain")).cast("double").alias("words"))


@query("r22_overview_quotes", r"""WITH k AS (SELECT id, regexp_replace(title, '/[0-9]+$', '') AS doc, text, lower(text) AS low FROM passages), i AS (SELECT *, 2.0 * CAST(contains(low, 'experience') AS INTEGER) + 2.0 * CAST(contains(low, 'education') AS INTEGER) + 1.5 * CAST(contains(low, 'skills') AS INTEGER) + 2.0 * CAST(contains(low, 'resume') AS INTEGER) + 2.0 * CAST(contains(low, 'curriculum vitae') AS INTEGER) + 1.5 * CAST(contains(low, 'work history') AS INTEGER) + CAST(contains(low, 'linkedin') AS INTEGER) + 0.5 * CAST(contains(low, 'email') AS INTEGER) + 0.5 * CAST(contains(low, 'phone') AS INTEGER)
        + 1.3 * (2.0 * CAST(contains(low, 'license') AS INTEGER) + 2.0 * CAST(contains(low, 'agreement') AS INTEGER) + 1.8 * CAST(contains(low, 'contract') AS INTEGER) + 1.5 * CAST(contains(low, 'under this') AS INTEGER) + 1.5 * CAST(contains(low, 'intellectual property') AS INTEGER) + CAST(contains(low, 'product') AS INTEGER) + CAST(contains(low, 'rights') AS INTEGER) + 0.8 * CAST(contains(low, 'specification') AS INTEGER))
        - 1.5 * (CAST(contains(low, '©') AS INTEGER) + CAST(contains(low, 'all rights reserved') AS INTEGER) + CAST(contains(low, 'contact us') AS INTEGER) + CAST(contains(low, 'terms of use') AS INTEGER) + CAST(contains(low, 'html5') AS INTEGER)) AS info FROM k),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY id) AS nth FROM i), c AS (SELECT doc, id, 0 AS part, text FROM f WHERE nth = 1 UNION ALL SELECT doc, id, CAST(r AS INTEGER), text FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY info DESC, id) AS r FROM f WHERE nth > 1) WHERE r = 1 OR (r <= 3 AND info >= 0.5))
    SELECT doc, id, part, round(0.95 - 0.04 * part, 2)::DOUBLE AS score FROM c WHERE length(text) >= 40""")
def _(d: Data) -> DataFrame:
    """For the question what the agreement says: every document's first passage and up to three that tell most."""
    low = F.lower("text")
    k = d.passages.select("id", F.regexp_replace("title", "/[0-9]+$", "").alias("doc"), "text", F.round(evidence.info_score(low, F.lit("what does the agreement say")), 4).alias("info"))
    f = k.withColumn("nth", F.row_number().over(Window.partitionBy("doc").orderBy("id")))
    rest = f.where("nth > 1").withColumn("part", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("info"), "id"))).where("part = 1 OR (part <= 3 AND info >= 0.5)")
    chosen = f.where("nth = 1").withColumn("part", F.lit(0)).select("doc", "id", "part", "text").unionByName(rest.select("doc", "id", "part", "text"))
    return chosen.where(F.char_length("text") >= 40).select("doc", "id", "part", F.round(0.95 - 0.04 * F.col("part"), 2).alias("score"))


@query("r11_candidates")
def _(d: Data) -> DataFrame:
    """Candidates of the stated questions by six scans, the best entry of each, then ranked by hybrid score: eight each."""
    q, title, t, shape = F.col("t"), F.col("title"), F.col("text"), F.col("shape")
    entered = _pairs(d, True).withColumn("base", evidence.entry_score(shape, q, F.col("terms"), title, t, _known())).where("base IS NOT NULL")
    scored = entered.select("q", "id", F.round("base", 4).alias("base"), F.round(evidence.hybrid_score(shape, q, F.col("terms"), title, t, F.col("base"), _known()), 4).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where("rank <= 8")

"""Questions resolved to entities: the terms they name, what each may stand for, and whether to ask back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import questions, terms
from factloom.operators import entities
from factloom.operators.lineage import cut, sorted_join
from factloom.plans.asks import _OVERVIEW, _SIDES, ASKS, asked
from factloom.plans.datasets import Data
from factloom.plans.registry import query
from factloom.plans.relational import _ALIASES, _aliases


def _norm(x: str) -> str:
    """SQL: a normalised name."""
    return rf"trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(trim({x}), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_/-]+', ' ', 'g'), '\s+', ' ', 'g')), '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g'))"


def _nodes(d: Data) -> DataFrame:
    """id, name of all nodes but sections, and of each part's brand, policy and level."""
    k, size, brand = F.col("p_partkey"), F.col("p_size").cast("string"), F.regexp_replace("p_brand", "Brand#", "")
    name = F.when(k % 4 == 0, F.concat(F.lit("Brand "), brand)).when(k % 4 == 3, F.concat(F.lit("SL"), (2000 + F.col("p_size")).cast("string"))).otherwise(F.concat(F.lit("Brand"), brand, F.lit(" Data Policy v"), size))
    more = d.table("part").select(F.concat(F.lit("policy:"), k.cast("string")).alias("id"), name.alias("name"))
    return d.nodes.where("type <> 'Section'").select("id", "name").unionByName(more)


def _questions(d: Data) -> DataFrame:
    """q, t: stated questions, those of the users, and one about each part."""
    k, size, brand = F.col("p_partkey"), F.col("p_size"), F.regexp_replace("p_brand", "#", "")
    s = size.cast("string")
    t = F.when(k % 8 == 0, F.concat(F.lit("What does the "), brand, F.lit(" Data Policy require?"))).when(k % 8 == 1, F.concat(F.lit("What does "), brand, F.lit(" Data Policy v"), s, F.lit(" say, unlike Data Policy?")))
    t = t.when(k % 8 == 2, F.concat(F.lit("Where is SL"), (2000 + size).cast("string"), F.lit(" used with POL-"), s, F.lit("?"))).when(k % 8 == 3, F.concat(F.lit("Compare "), brand, F.lit(" and Brand"), (size % 30).cast("string")))
    t = t.when(k % 8 == 4, F.concat(F.lit('Who makes "'), "p_name", F.lit('" for Supplier or Customer'))).when(k % 8 == 5, F.concat(F.lit("Is the SL"), s, F.lit(" standard a Data Policy?"))).when(k % 8 == 6, F.concat(F.lit("Tell me about "), F.initcap("p_name"), F.lit(" "), "p_brand"))
    t = t.otherwise(F.concat(F.lit("Does Nation "), (k % 30).cast("string"), F.lit(" own NATION_"), (k % 30).cast("string"), F.lit(" or the Gold-Standard (old) v2")))
    return asked(d).unionByName(d.table("part").select((10_000_000_000 + k).alias("q"), t.alias("t")))


_A = ASKS.replace("a AS (", "a0 AS (", 1) + """, a AS (SELECT q, t FROM a0 UNION ALL SELECT 10000000000 + k, CASE k % 8 WHEN 0 THEN 'What does the ' || b || ' Data Policy require?' WHEN 1 THEN 'What does ' || b || ' Data Policy v' || s || ' say, unlike Data Policy?' WHEN 2 THEN 'Where is SL' || (2000 + s) || ' used with POL-' || s || '?' WHEN 3 THEN 'Compare ' || b || ' and Brand' || s % 30
    WHEN 4 THEN 'Who makes "' || p_name || '" for Supplier or Customer' WHEN 5 THEN 'Is the SL' || s || ' standard a Data Policy?' WHEN 6 THEN 'Tell me about ' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' || p_brand ELSE 'Does Nation ' || k % 30 || ' own NATION_' || k % 30 || ' or the Gold-Standard (old) v2' END FROM (SELECT p_partkey AS k, p_size AS s, replace(p_brand, '#', '') AS b, p_name, p_brand FROM part))"""
_FRAMING = "string_split('what how who the this that does can and or for with from into vs versus between compare difference about which when where your our any all', ' ')"
_HARVEST = rf"""{_A}, {_SIDES}, h0 AS MATERIALIZED (SELECT a.q, a.t, regexp_replace(a.t, '[À-ɏ]', '_', 'g') AS tt, k.comparison, (CASE WHEN len(coded) >= 2 THEN coded ELSE s END)[1:4] AS sides FROM a JOIN k ON k.q = a.q),
    h1 AS MATERIALIZED (SELECT *, list_filter(list_concat(regexp_extract_all(tt, '\b[A-Z]{{2,6}}\b'), regexp_extract_all(tt, '\b[A-Z]{{2,6}}-\d{{2,}}\b'), regexp_extract_all(tt, '(?i)(?:Agreement|License|Policy|Contract)\s*(?:Number|#|No\.?)'), regexp_extract_all(tt, '(?i)\b[\w][\w\s/-]{{2,40}}\s+v\d+\b'), regexp_extract_all(tt, '\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b'), regexp_extract_all(t, '["“]([^"”]{{2,60}})["”]', 1), regexp_extract_all(tt, '\b[A-Za-z]{{1,8}}\d{{2,}}\b')), lambda x: NOT list_contains(sides, x)) AS others FROM h0),
    h2 AS (SELECT q, unnest(sides) AS x, generate_subscripts(sides, 1) AS i, 0 AS part, 0 AS n FROM h1 UNION ALL SELECT q, unnest(others), generate_subscripts(others, 1), 1, 0 FROM h1), h3 AS MATERIALIZED (SELECT q, x, row_number() OVER (PARTITION BY q ORDER BY part, CASE part WHEN 1 THEN -length(x) ELSE 0 END, i) AS i FROM h2),
    vs AS MATERIALIZED (SELECT q, list({_norm('x')}) AS vs FROM h3 WHERE regexp_matches(x, '(?i)\bv\d+\b') GROUP BY 1),
    h4 AS (SELECT q, i, CASE WHEN NOT list_contains({_FRAMING}, lower(regexp_extract(trim(x), '^\S+'))) THEN trim(x) WHEN regexp_matches(trim(x), '\s') THEN regexp_replace(regexp_replace(trim(x), '^\S+\s+', ''), '\s+', ' ', 'g') END AS term FROM h3),
    h5 AS (SELECT h4.q, i, term, {_norm('term')} AS norm, {_norm(r"regexp_replace(term, '(?i)\s+v\d+\b', '', 'g')")} AS stem, coalesce(vs, []) AS vs FROM h4 LEFT JOIN vs ON vs.q = h4.q WHERE term <> ''),
    h6 AS (SELECT q, min(i) AS i, arg_min(term, i) AS term FROM h5 WHERE NOT (stem <> '' AND norm = stem AND len(list_filter(vs, lambda v: starts_with(v, stem || ' v'))) > 0) GROUP BY q, lower(term)),
    h AS MATERIALIZED (SELECT q, term, CAST(row_number() OVER (PARTITION BY q ORDER BY i) AS INTEGER) AS pos FROM h6 QUALIFY row_number() OVER (PARTITION BY q ORDER BY i) <= 12)"""
_RESOLVED = rf"""keyed AS MATERIALIZED (SELECT id, name, {_norm('name')} AS n FROM (SELECT id, name FROM kg_nodes WHERE type <> 'Section' UNION ALL SELECT 'policy:' || p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Brand ' || replace(p_brand, 'Brand#', '') WHEN 3 THEN 'SL' || (2000 + p_size) ELSE replace(p_brand, '#', '') || ' Data Policy v' || p_size END FROM part)),
    nm AS MATERIALIZED (SELECT n, min(id) AS id, min(name) AS name, count(*) AS copies FROM keyed WHERE n <> '' GROUP BY 1), al AS MATERIALIZED (SELECT normalized_alias AS key, n, min(node_id) AS id, count(*) AS copies FROM ({_ALIASES}) JOIN keyed ON id = node_id GROUP BY 1, 2),
    tm AS MATERIALIZED (SELECT term, {_norm('term')} AS norm FROM (SELECT DISTINCT term FROM h)),
    r1 AS MATERIALIZED (SELECT term, n, min(id) AS id, max(copies) AS copies FROM (SELECT term, n, id, copies FROM tm JOIN nm ON n = norm UNION ALL SELECT term, n, id, copies FROM tm JOIN al ON key = norm) GROUP BY 1, 2), t1 AS MATERIALIZED (SELECT * FROM tm WHERE term NOT IN (SELECT term FROM r1)),
    r2 AS MATERIALIZED (SELECT term, n, id, copies, row_number() OVER (PARTITION BY term ORDER BY id, n) AS rank FROM (SELECT *, regexp_replace(norm, '[^a-z0-9]', '', 'g') AS key FROM t1) JOIN nm ON key IN (replace(replace(n, ' ', ''), '-', ''), lower(replace(replace(name, ' ', ''), '-', ''))) WHERE regexp_full_match(key, '[a-z]{{1,8}}\d{{2,}}') AND length(key) >= 4 QUALIFY rank <= 8), t2 AS MATERIALIZED (SELECT * FROM t1 WHERE term NOT IN (SELECT term FROM r2)),
    f0 AS (SELECT n, n AS key FROM nm UNION SELECT n, key FROM al), f1 AS (SELECT norm, n, CASE WHEN norm = key THEN 0 WHEN starts_with(key, norm) OR starts_with(norm, key) THEN 1 WHEN (length(norm) >= 5 AND contains(key, norm)) OR (length(key) >= 5 AND contains(norm, key)) THEN 2 END AS cls, abs(length(norm) - length(key)) AS gap FROM (SELECT DISTINCT norm FROM t2) JOIN f0 ON length(norm) >= 4 AND length(key) >= 4),
    f2 AS MATERIALIZED (SELECT norm, n, row_number() OVER (PARTITION BY norm ORDER BY min((cls, gap)), n) AS rank FROM f1 WHERE cls IS NOT NULL GROUP BY 1, 2 QUALIFY rank <= 4),
    s0 AS (SELECT term, n, id, copies, sum(copies) OVER (PARTITION BY term) AS together, row_number() OVER (PARTITION BY term ORDER BY n) AS rank FROM tm JOIN nm ON n = norm OR starts_with(n, norm || ' v') WHERE length(norm) >= 4 AND regexp_matches(n, '\bv\d+\b') AND NOT regexp_matches(term, '\b[A-Za-z]{{1,8}}\d{{2,}}\b') AND NOT regexp_matches(term, '(?i)\bv\d+\b')),
    r AS MATERIALIZED (SELECT term, n, x.id, nm.name, x.copies, CAST(rank AS INTEGER) AS rank, how FROM (SELECT term, n, id, copies, row_number() OVER (PARTITION BY term ORDER BY id, n) AS rank, 'exact' AS how FROM r1 UNION ALL SELECT term, n, id, copies, rank, 'code' FROM r2 UNION ALL SELECT term, n, nm.id, copies, rank, 'fuzzy' FROM t2 JOIN f2 USING (norm) JOIN nm USING (n) UNION ALL SELECT term, n, id, copies, rank, 'version' FROM s0 WHERE together > 1 AND rank <= 12) x JOIN nm USING (n))"""
_KEY = "regexp_replace({}, '[^a-z0-9]', '', 'g')"
_DECIDED = rf"""c0 AS (SELECT h.q, t, comparison, list_contains(list_transform(sides, lambda x: lower(x)), lower(h.term)) AS side, h.term, n, id, name, copies, rank, how, coalesce(bool_or(how = 'version') OVER (PARTITION BY h.q, h.term), false) AND NOT comparison AS open, lower(trim(h.term)) AS low, lower(name || ' ' || n) AS blob FROM h JOIN h0 ON h0.q = h.q JOIN r ON r.term = h.term),
    c1 AS (SELECT *, {_KEY.format('low')} <> '' AND (contains(blob, low) OR (length({_KEY.format('low')}) >= 4 AND contains({_KEY.format('blob')}, {_KEY.format('low')}))) AS related, CASE WHEN n = low THEN 1000 WHEN contains(blob, low) THEN 600 ELSE 0 END + 150 * len(list_filter(regexp_extract_all(lower(t), '[a-z0-9]{{4,}}'), lambda w: w <> low AND contains(blob, w))) - 5 * greatest(0, length(name) - 40) AS score FROM c0 WHERE (how = 'version') = open),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY q, term ORDER BY score DESC, rank, n) AS place FROM c1),
    c3 AS (SELECT q, term, any_value(t) AS t, any_value(low) AS low, bool_or(comparison) AS comparison, bool_or(side) AS side, count(*) AS names, max(length(n)) - min(length(n)) AS gap, bool_or(n = low) AS itself, count(*) FILTER (related) AS near, coalesce(sum(copies) FILTER (related), 0) AS near_matches, arg_min({{'id': id, 'name': name}}, rank) AS first, arg_min({{'id': id, 'name': name}}, rank) FILTER (related) AS near_one, arg_min({{'id': id, 'name': name}}, place) AS best, max(score) FILTER (place = 1) AS top, max(score) FILTER (place = 2 OR (place = 1 AND copies > 1)) AS second, list(name ORDER BY rank) FILTER (rank <= 4) AS options FROM c2 GROUP BY 1, 2),
    c4 AS (SELECT *, names > 1 AND NOT itself AND gap <= 8 AND (NOT comparison OR side) AND NOT (NOT regexp_matches(low, '\s') AND regexp_matches(t, '(?i)\b(report|index|survey|whitepaper|certification|standard)\b')) AS alike, regexp_full_match(low, '[a-z]{{1,8}}\d{{2,}}') AND near = 0 AS outside, top >= 600 AND top >= second + 300 AS clear FROM c3),
    c5 AS (SELECT q, term, options, alike AND NOT outside AND NOT clear AND near_matches <> 1 AS ambiguous, CASE WHEN outside THEN NULL WHEN alike AND clear THEN best WHEN alike AND near_matches <> 1 THEN NULL WHEN near > 0 THEN near_one ELSE first END AS pick FROM c4),
    dec AS MATERIALIZED (SELECT h.q, h.term, pos, pick.id AS id, pick.name AS name, coalesce(ambiguous, false) AS ambiguous, CASE WHEN ambiguous THEN options ELSE [] END AS options FROM h LEFT JOIN c5 ON c5.q = h.q AND c5.term = h.term)"""


def _asks(d: Data) -> DataFrame:
    """q, t, comparison, sides, side, term, pos: the terms of all questions; those of one text are found once"""
    t, asks = F.col("t"), _questions(d)
    told = cut(asks.select("t").distinct().select("t", questions.is_comparison(t).alias("comparison"), questions.compare_sides(t).alias("sides"), terms.harvested(t).alias("terms")))
    each = asks.join(sorted_join(told), "t").select("q", "t", "comparison", "sides", F.posexplode("terms").alias("pos", "term"))
    return each.withColumn("pos", F.col("pos") + 1).withColumn("side", F.array_contains(F.transform("sides", F.lower), F.lower("term")))


def _found(d: Data, asks: DataFrame) -> DataFrame:
    return entities.resolved(asks.select("term"), _nodes(d), _aliases(d))


@query("g08_question_terms", f"WITH {_HARVEST} SELECT q, pos, term FROM h")
def _(d: Data) -> DataFrame:
    """The terms that questions name, in the order in which they are tried."""
    return _asks(d).select("q", "pos", "term")


@query("g07_resolved_terms", f"WITH {_HARVEST}, {_RESOLVED} SELECT term, n, id, name, copies, rank, how FROM r")
def _(d: Data) -> DataFrame:
    """What each term may stand for: exact name or alias, else code, else near names; and the versions that it leaves open."""
    return _found(d, _asks(d)).select("term", "n", "id", "name", F.col("copies").cast("long").alias("copies"), "rank", "how")


@query("g08_decided_terms", f"WITH {_HARVEST}, {_RESOLVED}, {_DECIDED} SELECT q, term, id, name, ambiguous, array_to_string(options, '|') AS options FROM dec")
def _(d: Data) -> DataFrame:
    """The entity of every term of every question, or that it has to be asked back, with the options."""
    asks = _asks(d)
    return entities.decided(asks.select("q", "t", "comparison", "side", "term"), _found(d, asks)).select("q", "term", "id", "name", "ambiguous", F.coalesce(F.array_join("options", "|"), F.lit("")).alias("options"))


@query("g08_question_outcomes", rf"""WITH {_HARVEST}, {_RESOLVED}, {_DECIDED}, per AS (SELECT q, count(*) FILTER (id IS NOT NULL) AS n, bool_or(ambiguous) AS unsure, flatten(list(options ORDER BY pos)) AS o FROM dec GROUP BY 1), ov AS MATERIALIZED (SELECT q, {_OVERVIEW} AS overview FROM a), z AS (SELECT h0.q, coalesce(n, 0) AS n, coalesce(unsure, false) AS unsure, coalesce(o, []) AS o, comparison, comparison AND len(sides) >= 2 AS two, overview FROM h0 JOIN ov ON ov.q = h0.q LEFT JOIN per ON per.q = h0.q)
    SELECT q, n AS entities, two OR (NOT unsure AND n > 0) AS clear, CASE WHEN two THEN '' WHEN unsure THEN 'ENTITY_AMBIGUOUS' WHEN n = 0 AND NOT overview AND NOT comparison THEN 'ENTITY_NOT_RESOLVED' ELSE '' END AS reason, CASE WHEN unsure AND NOT two THEN array_to_string(list_filter(o, lambda x, i: list_position(list_transform(o, lambda y: lower(y)), lower(x)) = i)[1:4], '|') ELSE '' END AS options FROM z""")
def _(d: Data) -> DataFrame:
    """Whether each question is resolved, why not, and what it is asked back with."""
    t, asks = F.col("t"), sorted_join(cut(_asks(d)))
    whole = _questions(d).select("q", questions.is_comparison(t).alias("comparison"), questions.compare_sides(t).alias("sides"), questions.is_overview(t).alias("overview"))
    decisions = entities.decided(asks.select("q", "t", "comparison", "side", "term"), _found(d, asks))
    return entities.outcomes(whole, asks.select("q", "term", "pos"), decisions).select("q", "entities", "clear", "reason", F.array_join("options", "|").alias("options"))

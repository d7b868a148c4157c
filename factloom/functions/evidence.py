"""How passages support a question, as column rules over a question's shape and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import questions, text, web
from factloom.functions.arrays import distinct_ci, found, hits, let
from factloom.functions.questions import has

#: Titles of officers, names of persons, what may stand between them, and words that are no names.
TITLE = r"(?:Executive\s+Vice\s+President|Vice\s+President|Chief\s+Executive\s+Officer|Chief\s+Operating\s+Officer|Chief\s+Financial\s+Officer|Chief\s+Information\s+Officer|Chief\s+[A-Z][A-Za-z]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z]+)*(?:\s+[A-Z][A-Za-z]+){0,3}\s+Officer|Managing\s+Director|President(?:\s+and\s+CEO)?|Chairman|Chairwoman|Chair|CEO|COO|CFO|CTO|CIO|CHRO|CMO|CLO|EVP|SVP)"
PERSON = r"([A-Z][a-z]+(?:[ \t]+[A-Z]\.?)?(?:[ \t]+[A-Z][A-Za-z'’-]+)+)"
GAP = r"(?:[ \t]*[,–—\-][ \t]*|[ \t]+|[ \t]*\n[ \t]*)"
NO_PERSONS = "president chairman chairwoman chief executive operating financial information officer vice managing director partner board company senior global recognized".split()
#: What actions, definitions and facts look like.
ACTIONABLE = r"\b(must|should|require[sd]?|step\s*\d|first|then|next|click|select|submit|enable|disable|configure|install|renew)\b"
DEFINITIONAL = r"\b(is\s+a|are\s+a|refers\s+to|means|defined\s+as|consists\s+of|provides|represents)\b"
CONCRETE = r"(\b20\d{2}\b|\b\d{1,3}(?:,\d{3})+\+?\b|\b\d+\+\b|\b\d{1,5}\s*(?:%|percent|pages?|people|employees?|offices?|countries?|years?|months?|decades?)\b|\b\d+\s+(?:street|ave|road|blvd)\b)"
PERSONAL = r"\b(my|his|her|their)\s+\d+\+?\s+years?\b|\b\d+\+?\s+years?\s+of\s+(?:experience|career)\b"
METRIC = r"\b(?:more\s+than|over|about|approximately)?\s*\d{1,3}(?:,\d{3})+\+?\s+\w+|\b\d+\+\s+years?\b|\b\d+\s+offices?\b|\b\d+\s+countries?\b"
NUMBERS = r"\b\d{1,3}(?:,\d{3})+\+?\b|\b\d+\+\s*(?:years?|offices?|countries?)?\b"
#: Factoids that ask for counts, and those that years of service don't answer.
COUNT_ASKED = r"\b(how\s+many|how\s+long|offices?|countries?)\b"
LENGTH_ASKED = r"\b(how\s+long|how\s+many)\b"
#: Path shapes of pages that offer services, careers and opinions; three words as a slogan.
SERVICE_PATHS = ("what-we-do", "what_we_do", "/services", "_services", "/solutions", "_solutions", "/offerings", "_offerings", "/capabilities", "_capabilities", "/products", "_products", "/platform", "_platform")
CAREER_PATHS = ("leadership-pathway", "leadership_pathway", "career-path", "career_path", "learning-path", "learning_path", "employee-development", "talent-development", "career-development")
INSIGHT_PATHS = ("/insights/", "_insights_", "/blog/", "_blog_", "/news/", "_news_", "/decoder", "_decoder", "/glossary", "_glossary")
TRIAD = r"\b([A-Z][a-z]{2,})\.\s+([A-Z][a-z]{2,})\.\s+([A-Z][a-z]{2,})\."
#: Labels that offer nothing, and words that make two names an offer.
NO_OFFERS = ("about us", "read more", "learn more", "contact us", "get started", "how we", "what we", "why we", "our work", "case study", "case studies", "privacy policy", "cookie policy", "terms of", "source", "blog", "news")
OFFER_CUE = r"\b(service|platform|ai|data|cloud|software|product|experience|engineering|advisory|modernization|capability|center|centre)\b"
#: Answers whose point is that nothing was found, and claims.
NO_EVIDENCE = (
    r"\b(do not|don't|does not|doesn't|did not|didn't)\s+contain\b", r"\b(do not|don't|does not|doesn't)\s+(specify|provide|include|state)\b", r"\b(no|not\s+any|without\s+any)\s+(information|evidence|data|details|mention|number|count|estimate)\b", r"\b(could not|couldn't|cannot|can't)\s+find\b",
    r"\b(not\s+enough|insufficient)\s+evidence\b", r"\bprovided\s+(sources?|evidence|quotes?)\s+(do not|don't|does not|doesn't|mention|discuss)\b", r"\bsources?\s+(do not|don't|does not|doesn't|mention.{0,40}but)\s+(contain|mention|address|discuss|specify|provide)?\b",
    r"\bsources?\s+mention\b.{0,80}\bbut\s+do\s+not\b", r"\bno\s+(specific|relevant)\s+information\b", r"\boutside\s+(the\s+)?(knowledge\s+base|connected\s+sources)\b",
)
CLAIM = r"\b(is|are|was|were|means|refers|includes|requires|provides|covers|offers|located|holds|titled)\b"
#: What roster and officer answers are marked by.
SPOTLIGHT = r"\b(spotlight|employee of the|team of the|celebrat(?:e|ing)|culture\s+story|meet (?:the|our) team)\b"
ROSTER_TITLES = ("named", "appoint", "executive", "board", "officer", "ceo", "press", "newsroom", "letter", "leadership")
PAST_OFFICE = r"\b(former|ex-|stepped\s+down|until\s+20\d\d|from\s+20\d\d\s+(?:to|until|through)\b|was\s+the\s+c[efot]o|served\s+as\s+c[efot]o)\b"


def blob_of(title: Column, t: Column) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(t, F.lit("")))


def people(blob: Column) -> Column:
    """Names of persons beside a title, in order, each once."""
    names = F.concat(found(blob, rf"\b{PERSON}\b{GAP}{TITLE}\b", 1), found(blob, rf"\b{TITLE}\b(?:[ \t]+|[ \t]*\n[ \t]*){PERSON}\b", 1))
    sound = lambda n: (F.char_length(n) >= 5) & ~F.arrays_overlap(F.split(F.lower(n), r"\s+"), F.array(*map(F.lit, NO_PERSONS)))
    return distinct_ci(F.filter(F.transform(names, lambda n: F.trim(n)), sound))


def any_in(low: Column, markers: tuple[str, ...]) -> Column:
    return low.rlike("|".join(markers))


def is_service_page(title: Column) -> Column:
    return any_in(F.lower(title), SERVICE_PATHS)


def is_career_page(title: Column) -> Column:
    return any_in(F.lower(title), CAREER_PATHS)


def is_insight_page(title: Column) -> Column:
    return any_in(F.lower(title), INSIGHT_PATHS)


def has_triad(t: Column) -> Column:
    return t.rlike(TRIAD)


def offering_labels(t: Column, title: Column, most: int) -> Column:
    """Labels of offers: headings, and capitalised spans where services are spoken of."""
    tidy = lambda s: F.regexp_replace(F.regexp_replace(s, r"^[\s#\-–—|:]+|[\s#\-–—|:]+$", ""), r"\s+", " ")
    names = lambda s: s.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+$") & ~has(s, OFFER_CUE)
    sound = lambda s: F.char_length(s).between(4, 60) & ~F.lower(s).rlike("^(?:" + "|".join(NO_OFFERS) + ")") & ~names(s)
    offers = is_service_page(title) | has(t, r"\b(capabilities|services|offerings?|solutions|what we do|how we help)\b")
    spans = F.when(offers, found(F.substring(t, 1, 2400), r"\b([A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+){1,4})\b", 1)).otherwise(F.array().cast("array<string>"))
    return distinct_ci(F.filter(F.transform(F.concat(found(t, r"(?m)^#{1,3}\s+(.+)$", 1), spans), tidy), sound), most)


def offering_density(t: Column) -> Column:
    n = F.size(offering_labels(t, F.lit(""), 12))
    return F.when(n >= 4, 0.9).when(n >= 2, 0.55).when(n >= 1, 0.3).otherwise(0.0)


def supports_offers(title: Column, t: Column, density: Column | None = None) -> Column:
    return is_service_page(title) | ((offering_density(t) if density is None else density) >= 0.55) | (has_triad(t) & has(blob_of(title, t), r"\b(pathway|transformation|offer|service|capabilit)\b"))


def is_unsupported(answer: Column) -> Column:
    """Whether an answer's first sentence says that nothing was found."""
    low = F.lower(text.stripped(answer))
    first = F.get(F.filter(F.split(low, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != ""), 0)
    return F.coalesce(first.rlike("|".join(NO_EVIDENCE)), F.lit(False))


def without_references(answer: Column) -> Column:
    """Answers without footers of references and marks of citation."""
    t = F.regexp_replace(F.get(F.split(text.stripped(answer), r"(?i)\n(?:#{1,3}\s*)?(?:references|sources|citations)\s*:?\s*\n", 2), 0), r"\s+$", "")
    for pattern in (r"(?im)^\s*(?:references|sources|citations)\s*:\s*(?:\[\d+\]\s*,?\s*)+\s*$", r"(?i)\n*\s*(?:references|sources|citations)\s*:\s*(?:\[\d+\](?:\s*,\s*)?)+\s*$", r"(?:\s*\[\d+\]\s*,?)+\s*$", r"(?m)^\s*(?:\[\d+\]\s*)+\s*$"):
        t = F.regexp_replace(t, pattern, "")
    lines = F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?:\s*\[\d+\])+\s*$", ""), r"\s*\[\d+\](?=\s|,|$)", ""))
    return text.stripped(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def overlap(terms: Column, low: Column) -> Column:
    """Share of terms that a lower-case text holds; 0 without terms."""
    return F.when(F.size(terms) > 0, F.size(hits(terms, low)) / F.size(terms)).otherwise(0.0)


def facts(q: Column, blob: Column) -> dict[str, Column]:
    """What rules ask of a passage or a question alone; whoever pairs many of them computes it before, once for each."""
    return {"pen": text.boilerplate_penalty(blob), "n": F.size(people(blob))} | question_facts(q)


def passage_facts(title: Column, t: Column) -> dict[str, Column]:
    blob = blob_of(title, t)
    return {"pen": text.boilerplate_penalty(blob), "n": F.size(people(blob)), "density": offering_density(t)}


def question_facts(q: Column) -> dict[str, Column]:
    return {"qterms": questions.question_terms(q), "sides": questions.compare_sides(q), "anchors": questions.anchors(q)}


def passage_parts(title: Column, t: Column) -> dict[str, Column]:
    """What else rules ask of a passage alone: texts in one case, and the points of its title."""
    parts = {"low": F.lower(blob_of(title, t)), "low_title": F.lower(title), "name": title_name(title), "place": place_bonus(web.url_path(title))}
    return parts | {"trust": web.trust_weight(title), "recency": F.greatest(text.recency_bonus(title), text.recency_bonus(t))}


def question_parts(q: Column) -> dict[str, Column]:
    """What else rules ask of a question alone."""
    parts = {"asked": F.lower(q), "roster": questions.is_roster(q), "officer": questions.is_officer(q), "overview": questions.is_overview(q)}
    return parts | {"news": web.asks_chronicle(q), "words": title_words(q)}


def factual_parts(blob: Column) -> dict[str, Column]:
    """What a factoid's fit counts of a passage alone, and the points for its numbers; metric counts where a question asks how many.

    Each pattern needs a digit at a word's beginning, which is asked first.
    """
    some = lambda c: F.when(blob.rlike(r"\b\d"), c).otherwise(0.0)
    metric = F.when(has(blob, METRIC), 0.35).when(has(blob, PERSONAL), -0.25).otherwise(0.0)
    parts = {"concrete": 0.12 * F.least(F.lit(5), F.size(found(blob, "(?i)" + CONCRETE))), "dated": F.when(blob.rlike(r"\b20\d{2}\b"), 0.2).otherwise(0.0), "metric": metric, "numbers": F.when(has(blob, NUMBERS), 4.0).otherwise(0.0)}
    return {c: some(v) for c, v in parts.items()}


def fit(shape: Column, q: Column, title: Column, t: Column, known: dict[str, Column] | None = None) -> Column:
    """How well a passage has the shape of evidence that a question needs, 0 to 1; known: the ``facts`` of both."""
    blob = blob_of(title, t)
    k = passage_parts(title, t) | question_parts(q) | (known or facts(q, blob))
    low, one = k["low"], F.lit(1.0)
    count = lambda pattern: F.least(F.lit(5), F.size(found(blob, "(?i)" + pattern)))

    def scored(x: Column) -> Column:
        chrome, n, ov, sides = x["chrome"], x["n"], x["ov"], x["sides"]
        prose = F.greatest(F.lit(0.0), 1.0 - chrome)
        base = 0.35 * prose + 0.15 * (1.0 - chrome)
        both = F.size(hits(F.slice(sides, 1, 2), low))
        org = k["asked"].rlike(COUNT_ASKED)
        metric = has(blob, METRIC)
        bonus = F.when(org & metric, 0.35).when(org & has(blob, PERSONAL), -0.25).otherwise(0.0)
        listed = F.when(n >= 2, F.least(one, 0.55 + 0.15 * F.least(n, F.lit(4)) + base)).when(n == 1, F.least(one, 0.45 + base)).otherwise(F.greatest(F.lit(0.0), 0.08 * prose - 0.2 * chrome))
        attribute = F.when((n > 0) & (ov >= 0.2), F.least(one, 0.7 + base)).when((n > 0) | (ov >= 0.45), F.least(one, 0.5 + base)).otherwise(F.greatest(F.lit(0.0), ov * 0.5 + base * 0.3))
        compared = F.when(F.size(sides) >= 2, F.least(one, 0.25 * both + 0.2 * prose + F.when(both == 2, 0.35).otherwise(0.0))).otherwise(base + 0.2 * ov)
        how_to = F.least(one, base + 0.12 * count(ACTIONABLE) + 0.15 * ov)
        defined = F.least(one, base + F.when(has(blob, DEFINITIONAL), 0.35).otherwise(0.0) + 0.3 * ov - 0.25 * chrome)
        factual = F.least(one, base + 0.12 * count(CONCRETE) + F.when(blob.rlike(r"\b20\d{2}\b"), 0.2).otherwise(0.0) + bonus + 0.25 * ov)
        return F.when(shape == "list_people", listed).when(shape == "attribute", attribute).when(shape == "compare", compared).when(shape == "how_to", how_to).when(shape == "define", defined).when(shape == "factoid", factual).otherwise(F.least(one, base + 0.45 * ov))

    return let(F.struct(F.least(one, k["pen"] / 1.5).alias("chrome"), k["n"].alias("n"), overlap(k["qterms"], low).alias("ov"), k["sides"].alias("sides")), scored)


def support(shape: Column, q: Column, title: Column, t: Column, fits: Column, known: dict[str, Column] | None = None) -> Column:
    """How strongly a quote supports a question, 0 to 1: one that lacks what the question names doesn't."""
    low, asked = F.lower(blob_of(title, t)), F.lower(q)
    offers = supports_offers(title, t, known["density"] if known else None)
    tail = lambda a, n: F.lower(F.array_join(F.slice(F.filter(F.split(a, " "), lambda p: F.char_length(p) > 1), -n, n), " "))
    long = lambda a, n: F.size(F.filter(F.split(a, " "), lambda p: F.char_length(p) > 1)) >= n
    named = lambda a: low.contains(F.lower(a)) | (long(a, 2) & F.when(long(a, 2), low.contains(tail(a, 2)))) | (long(a, 3) & F.when(long(a, 3), low.contains(tail(a, 3))))
    define = shape == "define"
    about_offers = asked.rlike(r"\b(capabilities|services|offerings?|solutions)\b")

    def scored(x: Column) -> Column:
        missed = F.when(offers & shape.isin("define", "open", "factoid"), F.greatest(F.lit(0.55), fits)).when(shape.isin("factoid", "define", "attribute", "open", "how_to"), 0.0).otherwise(fits * 0.35)
        hit = F.when(define & about_offers & ~offers, fits * 0.25).otherwise(F.least(F.lit(1.0), 0.55 * fits + 0.45))
        loose = F.when((x["ov"] < 0.25) & (fits < 0.45), 0.0).otherwise(F.least(F.lit(1.0), 0.5 * fits + 0.5 * x["ov"]))
        anchored = F.when(F.exists(x["anchors"], named), hit).otherwise(missed)
        strong = (asked.contains("pathway") | asked.contains("transformation")) & has_triad(t)
        served = offers & asked.rlike(r"\b(capabilities|services|offerings?|solutions|capability|what\s+is|what\s+are)\b")
        return F.when(define & strong, F.greatest(F.lit(0.72), fits)).when(define & served, F.greatest(F.lit(0.65), fits)).when(F.size(x["anchors"]) > 0, anchored).otherwise(loose)

    terms = known["qterms"] if known else questions.question_terms(q)
    return let(F.struct((known["anchors"] if known else questions.anchors(q)).alias("anchors"), overlap(terms, low).alias("ov")), scored)


def roster_bonus(q: Column, title: Column, t: Column, asks: Column | None = None) -> Column:
    """Named officers count for questions on a roster; words of leadership without names count against."""
    blob = blob_of(title, t)

    def scored(n: Column) -> Column:
        soft = F.when(has(blob, r"\b(leadership|executive|board)\b"), -7.0).otherwise(0.0)
        out = F.when(n >= 2, 12.0 + 2.0 * F.least(n, F.lit(8))).when(n == 1, 6.0).otherwise(soft)
        return out - F.when(has(title, SPOTLIGHT) & (n < 2), 8.0).otherwise(0.0) + F.when((n > 0) & any_in(F.lower(title), ROSTER_TITLES), 4.0).otherwise(0.0)

    return F.when(questions.is_roster(q) if asks is None else asks, let(F.size(people(blob)), scored)).otherwise(0.0)


def officer_bonus(q: Column, title: Column, t: Column, asked: Column | None = None) -> Column:
    """Pages that name today's officers count for questions on one; past officers and opinions count against."""
    blob = blob_of(title, t)
    low, low_title = F.lower(blob), F.lower(title)
    plus = lambda condition, points: F.when(condition, points).otherwise(0.0)
    asks = lambda short, full: has(q, rf"\b({short}|chief\s+{full}(?:\s+officer)?)\b")
    regional = low.rlike(r"\b(americas|emea|europe|asia|region)\b.{0,40}\bcto\b|\bcto\b.{0,40}\b(americas|emea|europe|asia)\b")
    out = plus(any_in(low_title, ("/leaders", "_leaders", "leadership", "/profiles/leaders")), 10.0) + plus(low.rlike(r"\bserves\s+as\s+chief\b"), 12.0)
    out += plus(asks("ceo", "executive") & blob.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b.{0,40}\bchief\s+executive|\bserves\s+as\s+chief\s+executive"), 8.0)
    out += plus(asks("cfo", "financial") & low.rlike(r"\bserves\s+as\s+chief\s+financial|\bchief\s+financial\s+officer\b"), 8.0)
    out += plus(asks("cto", "technology") & low.rlike(r"\bserves\s+as\s+chief\s+technology|\bchief\s+technology\s+officer\b"), 8.0) - plus(asks("cto", "technology") & regional, 10.0)
    out -= plus(has(blob, PAST_OFFICE), 14.0) + plus(low.rlike(r"\b(emerita|emeritus|i\s+became\s+cto|was\s+the\s+cto)\b"), 12.0) + plus(any_in(low_title, ("insights", "blog", "news", "letter", "social-change", "report")), 8.0)
    return F.when(questions.is_officer(q) if asked is None else asked, out).otherwise(0.0)


def title_name(title: Column) -> Column:
    """A title as words are looked for in it."""
    return F.replace(F.replace(F.replace(F.lower(title), F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" ")), F.lit(".pdf"), F.lit(" "))


def title_words(q: Column) -> Column:
    """Words of a question that a title may hold."""
    return F.filter(F.array_distinct(found(F.lower(q), "[a-z0-9]{3,}")), lambda w: ~w.isin("what", "how", "who", "the", "and", "for", "with", "from", "does", "are", "can", "document", "about"))


def filename_bonus(name: Column, words: Column, terms: Column) -> Column:
    """Words of the question, and its terms, that a title's name holds."""
    return name_bonus(name, words) + F.when(name == "", 0.0).otherwise(F.least(F.lit(8.0), 2.5 * F.size(hits(terms, name))))


def name_bonus(name: Column, words: Column) -> Column:
    """What a title's name gains by a question's words."""
    return F.when(name == "", 0.0).otherwise(F.least(F.lit(6.0), 1.5 * F.size(hits(words, name))))


def place_bonus(path: Column) -> Column:
    """What a passage gains by its path; stories lose nothing where they are asked for."""
    return F.when(web.is_people(path), 8.0).when(web.is_core(path), 5.0).when(web.is_chronicle(path), -8.0).otherwise(0.0)


def path_bonus(place: Column, news: Column) -> Column:
    """``place_bonus``, for a question that asks for news or doesn't."""
    return F.when((place < 0) & F.coalesce(news, F.lit(True)), 0.0).otherwise(place)


def hybrid_score(shape: Column, q: Column, terms: Column, title: Column, t: Column, base: Column, known: dict[str, Column] | None = None) -> Column:
    """Score of a passage for a question: terms, title, path, prose, people, and the fit of its shape.

    Passages without a term count a fifth of their base, but for rosters that name persons. Stories and their
    characters aren't looked for.
    """
    blob = blob_of(title, t)
    k = passage_parts(title, t) | question_parts(q) | (known or facts(q, blob))
    low, asked = k["low"], k["asked"]
    plus = lambda condition, points: F.when(condition, points).otherwise(0.0)
    strong = lambda x: x.rlike(r"\d") | x.contains(" ")

    def scored(x: Column) -> Column:
        n_hits = F.size(x["hits"])
        some, all_strong = F.filter(x["hits"], strong), F.filter(terms, strong)
        out = base + 3.5 * F.size(some) + 1.0 * (n_hits - F.size(some)) + plus((F.size(all_strong) > 0) & (F.size(some) == F.size(all_strong)), 8.0) + plus(n_hits - F.size(some) >= 2, 3.0)
        out += F.when(F.size(terms) > 0, 2.0 * n_hits / F.greatest(F.size(terms), F.lit(1))).otherwise(0.0) + 2.5 * F.size(hits(terms, k["low_title"]))
        out += path_bonus(k["place"], k["news"]) + filename_bonus(k["name"], k["words"], terms) + 8.0 * (k["trust"] - 0.55) - 4.0 * k["pen"] + k["recency"]
        out += roster_bonus(q, title, t, k["roster"]) + officer_bonus(q, title, t, k["officer"]) + 10.0 * x["fit"] + 3.0 * overlap(terms, low)
        out += F.when(k["roster"], F.when(x["people"] > 0, 2.0).otherwise(-3.0)).otherwise(0.0)
        tenure = asked.rlike(LENGTH_ASKED) & has(blob, r"\b\d+\+?\s+years?\s+of\s+(?:experience|career|technology consulting)\b") & ~has(blob, r"\b(?:more\s+than|over)\s+\d{1,3}(?:,\d{3})+|\b\d+\+\s+years?\s+of\s+technology\s+consulting\b|\b\d+\s+offices?\b")
        out += F.when(shape == "factoid", plus(has(blob, NUMBERS), 4.0) - plus(tenure, 5.0)).otherwise(0.0)
        dense, service = (known["density"] if known else offering_density(t)) >= 0.55, is_service_page(title)
        offers = asked.rlike(r"\b(capabilities|services|offerings?|solutions)\b")
        out += F.when(
            shape == "define",
            plus(dense | service, 3.5) + plus((asked.contains("pathway") | asked.contains("transformation")) & has_triad(t), 10.0) - plus(asked.contains("pathway") & is_career_page(title), 12.0)
            + F.when(offers, F.when(service, 8.0).when(dense, 5.0).otherwise(0.0)).otherwise(0.0) - plus(is_insight_page(title) & asked.rlike(r"\b(pathway|capabilities|services|offerings?)\b"), 6.0),
        ).otherwise(0.0)
        return F.when((n_hits == 0) & ~((shape == "list_people") & (x["people"] > 0)), base * 0.2).otherwise(out)

    return let(F.struct(hits(terms, low).alias("hits"), k["n"].alias("people"), fit(shape, q, title, t, known).alias("fit")), scored)


#: Words of resumes and of agreements with their weights, and words of page frames.
RESUME_INFO = (("experience", 2.0), ("education", 2.0), ("skills", 1.5), ("resume", 2.0), ("curriculum vitae", 2.0), ("work history", 1.5), ("linkedin", 1.0), ("email", 0.5), ("phone", 0.5))
AGREEMENT_INFO = (("license", 2.0), ("agreement", 2.0), ("contract", 1.8), ("under this", 1.5), ("intellectual property", 1.5), ("product", 1.0), ("rights", 1.0), ("specification", 0.8))
FRAME_INFO = ("©", "all rights reserved", "contact us", "terms of use", "html5")


def info_score(low: Column, asked: Column) -> Column:
    """How much a passage tells about a resume or an agreement, more so if the question asks for one."""
    sums = lambda listed: sum((F.when(low.contains(w), points).otherwise(0.0) for w, points in listed), F.lit(0.0))
    resume = F.when(asked.rlike("resume|cv|whose|experience|candidate"), 1.4).otherwise(1.0)
    agreement = F.when(asked.rlike("agreement|license|contract|policy"), 1.3).otherwise(0.35)
    return resume * sums(RESUME_INFO) + agreement * sums(AGREEMENT_INFO) - sums((w, 1.5) for w in FRAME_INFO)


def content_overlap(q: Column, low: Column, known: dict[str, Column] | None = None) -> Column:
    """Share of a question's terms, without question words, that a lower-case text holds."""
    return overlap(F.filter(known["qterms"] if known else questions.question_terms(q), lambda w: ~F.lower(w).isin("who", "what", "when", "where", "why", "how", "which", "does", "did", "are", "is")), low)


def trail_relevance(ov: Column, penalty: Column) -> Column:
    """How far a trail's names and quotes answer a question, 0 to 1, from the overlap and the boilerplate penalty."""
    score = F.greatest(F.lit(0.0), ov - 0.35 * penalty)
    return F.least(F.lit(1.0), F.when((ov < 0.15) & (penalty >= 0.35), F.least(score, F.lit(0.12))).otherwise(score))


def graph_leads(relevance: Column, strength: Column, coverage: Column) -> Column:
    """Whether a trail's evidence may lead the pack."""
    return (relevance >= 0.45) & (strength >= 0.6) & ~((coverage >= 0.45) & (relevance < 0.55))


def graph_base(relevance: Column, confidence: Column) -> Column:
    """The score that a trail's quote enters the pack with."""
    return F.when(relevance < 0.2, 0.28 + 0.1 * confidence).when(relevance < 0.45, 0.4 + 0.25 * relevance + 0.05 * confidence).otherwise(0.55 + 0.4 * relevance + 0.05 * confidence)


def entry_score(shape: Column, q: Column, terms: Column, title: Column, t: Column, known: dict[str, Column] | None = None) -> Column:
    """The best score that any scan lets a passage enter with; null if none finds it.

    Scans: terms and shapes in the text, rosters, officers, definitions and offers, the section of the path, whole documents.
    """
    k = passage_parts(title, t) | question_parts(q) | (known or passage_facts(title, t))
    low, asked, low_title = k["low"], k["asked"], k["low_title"]

    def scanned(n: Column) -> Column:
        offers = asked.rlike(r"\b(capabilities|services|offerings?|solutions)\b")
        shaped = (shape == "define") & (((asked.contains("pathway") | asked.contains("transformation")) & has_triad(t)) | (offers & supports_offers(title, t, k["density"])))
        lexical = F.when(shaped, 0.85).when((F.size(hits(terms, low)) > 0) | (F.size(terms) == 0), 0.55)
        roster = F.when(k["roster"] & (n > 0) & (F.char_length(t) >= 40), 0.7 + 0.05 * F.least(n, F.lit(6)))
        role = F.when(asked.rlike(r"\b(ceo|chief\s+executive)\b"), low.rlike(r"serves\s+as\s+chief\s+executive|chief\s+executive\s+officer")).when(asked.rlike(r"\b(cfo|chief\s+financial)\b"), low.rlike(r"chief\s+financial")).when(asked.rlike(r"\b(cto|chief\s+technology)\b"), low.rlike(r"chief\s+technology")).otherwise(False)
        officer = F.when(k["officer"] & role, F.when(low_title.contains("leaders"), 1.8).otherwise(1.4))
        define = F.when((shape == "define") & (asked.contains("pathway") | asked.contains("transformation")) & has_triad(t), 1.35).when((shape == "define") & offers & (is_service_page(title) | (k["density"] >= 0.55)), 1.2)
        section = F.when(F.size(hits(terms, low_title)) > 0, F.when(is_insight_page(title), 0.95).otherwise(1.4))
        overview = F.when(k["overview"], 0.5)
        return F.when((F.char_length(F.trim(t)) >= 20) & ~((k["pen"] >= 1.125) & (F.char_length(t) < 280)), F.greatest(lexical, roster, officer, define, section, overview))

    return let(k["n"], scanned)

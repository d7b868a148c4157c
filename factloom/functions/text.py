"""Text gates, signals and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.arrays import let

#: Moderation keywords and patterns, in the order of their classes.
THREAT = (r"\b(i\s+will\s+(kill|hurt|rape)|rape\s+you|bomb\s+you)\b", r"\b(terrorist\s+attack|make\s+a\s+bomb)\b")
HATE = (r"\b(nigg(?:er|a)|faggot|\bfag\b|tranny|kike|spic|chink|wetback)\b",)
SEXUAL_WORDS = (
    "sex sexy sexier sexiest sexual sexually porn porno pornography xxx onlyfans hentai nude nudes naked boobs tits pussy vagina penis cock dick blowjob handjob cybersex orgasm erotic fetish horny nsfw babe babes bae slut whore hookup booty"
).split()
SEXUAL = (
    r"\b(have|want|do|need|lets?|let'?s)\s+(a\s+|some\s+|to\s+)?sex\b",
    r"\bsex\s+(with|chat|talk|please|now|tonight)\b",
    r"\b(fuck\s+me|send\s+(nudes|pics)|dick\s*pic)\b",
    r"\b(hot\s*stuff|make\s+love|sleep\s+with\s+me|kiss\s+me)\b",
    r"\b(date\s+me|marry\s+me|love\s+you\s+baby)\b",
    r"\b(how\s+are\s+you|hi|hello|hey)\b.+\b(sexy|hot|babe|baby|darling|sweetheart)\b",
    r"\b(sexy|hot|babe|baby|darling|sweetheart)\b.+\b(how\s+are\s+you|hi|hello|hey)\b",
    r"\b(are\s+you\s+single|wanna\s+hook\s*up|hook\s*up\s+tonight|netflix\s+and\s+chill)\b",
    r"\bmasturbat\w*\b",
)
ABUSE_WORDS = ("asshole", "bastard", "bitch", "bitches", "cunt", "motherfucker", "dipshit", "shithead", "dumbass", "jackass", "bullshit")
ABUSE = (
    r"\b(fuck\s+you|screw\s+you|damn\s+you)\b",
    r"\b(kill\s+yourself|kys)\b",
    r"\b(go\s+to\s+hell|piece\s+of\s+shit)\b",
    r"\bf+u+c+k+(?:ing|er|ed|off)?\b",
    r"\bs+h+i+t+(?:ty)?\b",
    r"\b(idiot|moron|retard(?:ed)?)\b",
)
GREETING = r"^\s*(hi|hello|hey|howdy|hola|namaste|yo|good\s*(morning|afternoon|evening|day)|greetings|(hi|hello|hey)\s+(there|friend|folks|everyone|all|team)|what'?s\s+up|how\s+are\s+you(?:\s+doing)?|how\s+do\s+you\s+do|nice\s+to\s+(?:meet|see)\s+you)[\s!?.,]*$"
#: Chrome phrases, each worth .35.
BOILERPLATE = (
    r"(?i)\bsite\s*map\b",
    r"(?i)\bprivacy\s*policy\b.{0,80}\bterms\b",
    r"(?i)\bcookie\s*(policy|preferences|settings|list)\b",
    r"(?i)\baccessibility\b.{0,40}\b(statement|center|policy)\b",
    r"(?i)\bsubscribe\b.{0,40}\bnewsletter\b",
    r"(?i)\b(skip to (content|main)|all rights reserved|follow us)\b",
    r"(?i)\b(accept all|reject all|confirm my choices)\b",
    r"(?:\|?\s*[A-Z][A-Za-z &/-]{2,28}\s*){6,}",
)
#: Kinds of documents, in the order they are tried.
KINDS = (
    ("spotlight", r"(?i)\b(spotlight|employee of the|team of the|celebrat(?:e|ing)|culture\s+story|meet (?:the|our) team)\b"),
    ("letter", r"(?i)\b(letter\s+from|annual\s+letter|shareholder\s+letter|president\s+and\s+ceo)\b"),
    ("press", r"(?i)\b(press[-_ ]?release|newsroom|named|appoint(?:ed|s)?|investor|earnings|media\s+release|announces)\b"),
    ("policy", r"(?i)\b(policy|compliance|privacy|terms|license|agreement|specification|standard|guideline)\b"),
)
NAVISH = r"(?i)\b(site\s*map|cookie|close menu|sign in|log in|skip to (?:content|main)|all rights reserved)\b"
#: What makes a section critical or important.
CRITICAL = ("complian", "regulat", "policy", "legal", "security", "privacy", "mortgage", "hipaa")
IMPORTANT = ("product", "api", "architect", "service", "auth", "payment")


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def alnum_key(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "[^a-z0-9]", "")


def entity_name(t: Column) -> Column:
    """Normalised entity name: camel case split, separators to spaces, brackets dropped."""
    s = F.regexp_replace(F.regexp_replace(stripped(t), r"([a-z0-9])([A-Z])", r"$1 $2"), r"[_/-]+", " ")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, r"\s+", " ")), r"\s*\([^)]*\)\s*", " ")
    return stripped(F.regexp_replace(s, r"\s+", " "))


def moderation(t: Column) -> Column:
    """Reason code of a blocked question, or null: threats, hate, sexual content, abuse."""
    low = F.regexp_replace(F.regexp_replace(F.lower(stripped(t)), r"[*._-]+", " "), r"\s+", " ")
    plain = F.translate(low, "013@", "oiea")
    both = F.concat_ws("\n", t, plain)
    words = F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))
    any_of = lambda patterns: both.rlike("(?i)" + "|".join(patterns))
    one_of = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed)))
    return (
        F.when(any_of(THREAT), "INAPPROPRIATE_THREAT").when(any_of(HATE), "INAPPROPRIATE_HATE").when(one_of(SEXUAL_WORDS) | any_of(SEXUAL), "INAPPROPRIATE_SEXUAL").when(one_of(ABUSE_WORDS) | any_of(ABUSE), "INAPPROPRIATE_ABUSE")
    )


def is_greeting(t: Column) -> Column:
    q = stripped(t)
    return (F.char_length(q) <= 60) & (q != "") & q.rlike("(?i)" + GREETING)


def count_of(t: Column, char: str) -> Column:
    return F.char_length(t) - F.char_length(F.replace(t, F.lit(char), F.lit("")))


def boilerplate_penalty(t: Column) -> Column:
    """Higher is worse, up to 1.5; tiny texts .4."""
    words = F.regexp_extract_all(t, F.lit("[A-Za-z]{3,}"), F.lit(0))
    titled = F.size(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]+$")))
    phrases = sum((F.when(t.rlike(p), 0.35).otherwise(0.0) for p in BOILERPLATE), F.lit(0.0))
    title_like = F.when((F.char_length(t) < 280) & (F.size(words) >= 8) & (titled / F.size(words) >= 0.72), 0.4).otherwise(0.0)
    menu = F.when((count_of(t, "|") >= 3) | ((count_of(t, "\n") >= 8) & (F.char_length(t) < 400)), 0.2).otherwise(0.0)
    return F.when(F.char_length(stripped(t)) < 20, 0.4).otherwise(F.least(F.lit(1.5), phrases + title_like + menu))


def doc_kind(title: Column, t: Column) -> Column:
    blob = F.concat(title, F.lit("\n"), F.substring(t, 1, 800))
    out = F
    for name, pattern in KINDS:
        out = out.when(blob.rlike(pattern), name)
    return out.when(blob.rlike(NAVISH) & (F.char_length(stripped(t)) < 400), "nav").otherwise("unknown")


def passage_known(title: Column, t: Column) -> Column:
    """What a passage's signals follow from, as a struct: give it a column of its own, so that it is computed once."""
    blob = F.concat(title, F.lit("\n"), t)
    return F.struct(
        F.least(F.lit(1.0), boilerplate_penalty(blob) / 1.5).alias("chrome"), F.size(F.regexp_extract_all(t, F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("words"),
        doc_kind(title, t).alias("kind"), F.char_length(stripped(t)).alias("size"), F.char_length(t).alias("n"), blob.rlike(r"\b(20\d{2}|19\d{2})\b").alias("dated"),
    )


def passage_scored(x: Column) -> Column:
    """prose_score, chrome_score, doc_kind, has_dated_claim and quarantine of what ``passage_known`` tells."""
    full = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 * F.least(F.lit(1.0), x["n"] / 600.0) + 0.45 * (1.0 - x["chrome"])))
    prose = F.when(x["words"] < 12, F.least(full, F.lit(0.25))).otherwise(full)
    quarantine = ((x["chrome"] >= 0.75) & (prose < 0.28)) | ((x["kind"] == "nav") & (x["size"] < 280)) | (x["size"] < 40)
    return F.struct(F.round(prose, 3).alias("prose_score"), F.round(x["chrome"], 3).alias("chrome_score"), x["kind"].alias("doc_kind"), x["dated"].alias("has_dated_claim"), quarantine.alias("quarantine"))


def passage_struct(title: Column, t: Column) -> Column:
    """The signals of a passage, as one struct whose parts are computed once."""
    return let(passage_known(title, t), passage_scored)


def quarantine_parts(title: Column, t: Column) -> Column:
    """What the quarantine of a passage follows from: its sizes, whether it is a frame, and whether it has less than twelve words.

    Prose lies below .28 only for such or for less than 306 characters, since .55 of the length's share of 600 counts.
    Give it, and then ``quarantine_chrome``, columns of their own: what stands twice in an expression is computed for every row.
    """
    size = F.char_length(stripped(t))
    words = t.rlike(r"\A(?:(?:[^A-Za-z]++|[A-Za-z]{1,2}+(?![A-Za-z]))*+[A-Za-z]{3,}+){12}")
    return F.struct(size.alias("size"), F.char_length(t).alias("n"), F.when(size < 280, doc_kind(title, t) == "nav").otherwise(False).alias("nav"), (~words).alias("few"))


def quarantine_chrome(parts: Column, title: Column, t: Column) -> Column:
    """The chrome score where it can matter, else 0."""
    return F.when((parts["n"] < 306) | parts["few"], F.least(F.lit(1.0), boilerplate_penalty(F.concat(title, F.lit("\n"), t)) / 1.5)).otherwise(0.0)


def quarantined(parts: Column, chrome: Column) -> Column:
    """The quarantine signal alone."""
    low = parts["few"] | (0.55 * (parts["n"] / 600.0) + 0.45 * (1.0 - chrome) < 0.28)
    return (parts["size"] < 40) | parts["nav"] | ((chrome >= 0.75) & low)


def amount(t: Column) -> Column:
    """The first number's whole part as a double, thousands separators dropped; null without one."""
    n = F.regexp_extract(t, r"(?i)(?<![A-Za-z])(?:USD|US\$|\$|€|£)?\s*(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?", 1)
    return F.when(n != "", F.replace(n, F.lit(","), F.lit("")).cast("double"))


def criticality(t: Column) -> Column:
    has = lambda hints: F.lower(t).rlike("|".join(hints))
    return F.when(has(CRITICAL), "Critical").when(has(IMPORTANT), "Important").otherwise("Informational")


def in_window(hour: Column, start: int, duration: int) -> Column:
    """Whether an hour of the day lies in a window that may wrap at midnight."""
    return F.lit(duration > 0) & (F.pmod(hour - start, F.lit(24)) < duration)


def token_estimate(t: Column) -> Column:
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.char_length(t) / 4))).cast("long")


def lexical_score(t: Column, title: Column, terms: list[str]) -> Column:
    """Per term found 3 if it has a digit or space, else 1, 1.5 more in the title, and .15 per occurrence of any."""
    low, low_title = F.lower(t), F.lower(title)
    out = F.lit(0.0)
    for term in terms:
        strong = any(c.isdigit() or c == " " for c in term)
        hits = (F.char_length(low) - F.char_length(F.replace(low, F.lit(term), F.lit("")))) / len(term)
        out = out + F.when(low.contains(term), 3.0 if strong else 1.0).otherwise(0.0) + F.when(low_title.contains(term), 1.5).otherwise(0.0) + 0.15 * hits
    return out


def recency_bonus(t: Column) -> Column:
    """(Latest year of the first 500 characters - 2016) * .16, between 0 and 1.6."""
    years = F.transform(F.regexp_extract_all(F.substring(t, 1, 500), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.least(F.lit(1.6), F.greatest(F.lit(0.0), (F.coalesce(F.array_max(years), F.lit(2016)) - 2016) * 0.16))


def excerpt(t: Column, term: str, before: int = 100, after: int = 220) -> Column:
    """The text around the first occurrence of a term; its beginning without one."""
    at = F.locate(term, F.lower(t))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(t, start, at + len(term) + after - start)).otherwise(F.substring(t, 1, before + after))

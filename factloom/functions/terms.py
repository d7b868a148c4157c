"""What a question names: its terms, longest first, without framing words and bare names of versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import questions, text
from factloom.functions.arrays import found, let, lowered

#: What counts as a term, in the order of harvest; then capitalised runs, quotes and codes.
TERMS = (r"\b[A-Z]{2,6}\b", r"\b[A-Z]{2,6}-\d{2,}\b", r"(?i)(?:Agreement|License|Policy|Contract)\s*(?:Number|#|No\.?)", r"(?i)\b[\w][\w\s/-]{2,40}\s+v\d+\b")
RUNS = r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)*\b"
QUOTES = "[\"“]([^\"”]{2,60})[\"”]"
CODES = r"\b[A-Za-z]{1,8}\d{2,}\b"
VERSION = r"(?i)\bv\d+\b"
#: Words that frame a question.
FRAMING = "what how who the this that does can and or for with from into vs versus between compare difference about which when where your our any all".split()
#: Questions that name a document of their own.
ARTIFACT = r"(?i)\b(report|index|survey|whitepaper|certification|standard)\b"


def is_code(term: Column) -> Column:
    return term.rlike(r"^[A-Za-z]{1,8}\d{2,}$")


def harvested(q: Column) -> Column:
    """Up to twelve terms: compared sides first, then the longest; each once, whatever its case.

    A framing word in front goes; the bare name of something goes where the question names a version of it.
    """
    framing = F.array(*map(F.lit, FRAMING))
    version = r"(?i)\s+v\d+\b"

    def ordered(sides: Column) -> Column:
        others = F.concat(*(found(q, p) for p in TERMS), found(q, RUNS), found(q, QUOTES, 1), found(q, CODES))
        rest = F.filter(others, lambda t: ~F.array_contains(sides, t))
        ranked = F.array_sort(F.transform(rest, lambda t, i: F.struct((-F.char_length(t)).alias("n"), i.alias("i"), t.alias("t"))))
        return F.concat(sides, F.transform(ranked, lambda r: r["t"]))

    def unframed(t: Column) -> Column:
        bare = text.stripped(t)
        more = bare.rlike(r"\s")
        lead = F.lower(F.regexp_extract(bare, r"^\S+", 0))
        return F.when(~F.array_contains(framing, lead), bare).when(more, F.regexp_replace(F.regexp_replace(bare, r"^\S+\s+", ""), r"\s+", " "))

    def kept(raw: Column) -> Column:
        versions = F.transform(F.filter(raw, lambda t: t.rlike(VERSION)), text.entity_name)
        named = F.filter(F.transform(raw, unframed), lambda t: t.isNotNull() & (t != ""))

        def superseded(t: Column) -> Column:
            stem = text.entity_name(F.regexp_replace(t, version, ""))
            return (stem != "") & (text.entity_name(t) == stem) & F.exists(versions, lambda v: v.startswith(F.concat(stem, F.lit(" v"))))

        return F.filter(named, lambda t: ~superseded(t))

    def once(ts: Column) -> Column:
        return let(lowered(ts), lambda low: F.slice(F.filter(ts, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, 12))

    return let(let(let(questions.compare_sides(q), ordered), kept), once)

"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Strong patterns are reported wherever they stand. Weak candidates (account names, 40-character tokens,
endpoints) are reported only where complementary parts lie within the same scope: a weak secret near an access
identifier, a weak identifier near a secret, an endpoint near both. The interval join is a sweep over a row's
parts in order of position, once forwards and once backwards, so it needs no shuffle and never forms pairs.

Positions are code points, ends exclusive. Null and empty texts have no spans. Equal rows get equal spans; of
spans with one start the kinds' order decides. Very long texts take time in proportion to their length and matches;
an empty table gives no rows. Columns of the input are kept; one named as the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds, in the order of their report.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
#: Weak kinds, reported only when linked.
WEAK_ID = r"""(?<![A-Za-z0-9_])(?i:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+"
#: Code points between the starts of parts of one scope, less than.
SCOPE = 256
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
ROLES = {"assign": "s", "access": "i", "hex": "s", "weak_id": "i", "weak_secret": "s", "endpoint": "e"}
#: Elements of an array that are summed one by one, and code points of the pieces that a text is cut from.
BLOCK, PIECE = 64, 256
_SPAN = "array<struct<start:int,end:int,kind:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(xs: Column, plus: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """The array of x1, x1 + x2, x1 + x2 + x3, ... for an associative ``plus``.

    Blocks of ``BLOCK`` are summed by themselves, then their totals in the same way: appending to one long array
    would copy it each time, which takes time with the square of its length.
    """
    none = F.slice(xs, 1, 0)
    if not levels:
        return F.aggregate(xs, none, lambda acc, x: F.array_append(acc, F.when(F.size(acc) > 0, plus(F.element_at(acc, -1), x)).otherwise(x)))

    def carry(sums: Column) -> Column:
        before = running(F.transform(sums, lambda b: F.element_at(b, -1)), plus, levels - 1)
        return let(before, lambda t: F.flatten(F.transform(sums, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: plus(F.get(t, i - 1), x))))))

    def blocked(ys: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / BLOCK).cast("int"))
        return let(F.transform(starts, lambda i: running(F.slice(ys, i * BLOCK + 1, F.lit(BLOCK)), plus, 0)), carry)

    return let(xs, lambda ys: F.when(F.size(ys) > BLOCK, blocked(ys)).otherwise(running(ys, plus, 0)))


def matches(text: Column, pattern: str, least: tuple[int, int] | None = None, holds: str = "") -> Column:
    """Leftmost non-overlapping matches: the code points before each and of each, and whether it counts.

    least: a group and the characters it needs, else the match is dropped. holds: what every match contains.
    """
    kind = "struct<gaps:array<int>,sizes:array<int>,good:array<boolean>>"
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.char_length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda b: F.char_length(b))
    good = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])), lambda g: F.char_length(g) >= least[1]) if least else F.array().cast("array<boolean>")
    some = text.contains(holds) & text.rlike(pattern) if holds else text.rlike(pattern)
    return F.when(some, F.struct(gaps.alias("gaps"), sizes.alias("sizes"), good.alias("good")).cast(kind)).otherwise(F.struct(*(F.array().alias(c) for c in ("gaps", "sizes", "good"))).cast(kind))


def placed(found: Column, kind: Column) -> Column:
    """The spans of ``matches`` that count."""
    ends = running(F.zip_with(F.slice(found["gaps"], F.lit(1), F.size(found["sizes"])), found["sizes"], lambda g, m: g + m), lambda x, y: x + y)
    spans = F.zip_with(ends, found["sizes"], lambda e, m: F.struct((e - m).alias("start"), e.alias("end"), kind.alias("kind")))
    return F.filter(spans, lambda s, i: F.coalesce(F.get(found["good"], i), F.lit(True)))


def _near(parts: Column) -> Column:
    """Of every part, in order: whether an identifier and a secret stand at it or before it within the scope."""
    far = F.lit(-(2**30))
    role = lambda p: F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), p["kind"] + 1)
    at = F.transform(parts, lambda p: F.struct(F.when(role(p) == "i", p["start"]).otherwise(far).alias("i"), F.when(role(p) == "s", p["start"]).otherwise(far).alias("s")))
    last = running(at, lambda x, y: F.struct(F.greatest(x["i"], y["i"]).alias("i"), F.greatest(x["s"], y["s"]).alias("s")))
    return F.zip_with(parts, last, lambda p, x: F.struct((p["start"] - x["i"] < SCOPE).alias("i"), (p["start"] - x["s"] < SCOPE).alias("s")))


def link(parts: Column) -> Column:
    """The parts, sorted, without weak ones that lack their complement."""
    backwards = F.transform(F.reverse(parts), lambda p: F.struct((-p["start"]).alias("start"), p["end"].alias("end"), p["kind"].alias("kind")))
    return let(F.transform(F.array(parts, backwards), _near), lambda near: _linked(parts, near[0], F.reverse(near[1])))


def _linked(parts: Column, before: Column, after: Column) -> Column:
    near = F.zip_with(before, after, lambda a, b: F.struct((a["i"] | b["i"]).alias("i"), (a["s"] | b["s"]).alias("s")))
    joined = F.zip_with(parts, near, lambda p, n: F.struct(p.alias("p"), n.alias("n")))
    kind = {k: F.lit(i) for i, k in enumerate(KINDS)}

    def stays(x: Column) -> Column:
        of = lambda k: x["p"]["kind"] == kind[k]
        return (x["p"]["kind"] <= kind["hex"]) | (of("weak_id") & x["n"]["s"]) | (of("weak_secret") & x["n"]["i"]) | (of("endpoint") & x["n"]["i"] & x["n"]["s"])

    return F.transform(F.filter(joined, stays), lambda x: x["p"])


def scan(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``spans`` (or as ``out`` says): array<struct<start, end, kind>> by start, then kind (its place in KINDS)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = [matches(text, ASSIGN, least=(2, LEAST_ASSIGNED)), matches(text, ACCESS, holds="AKIA"), matches(text, HEX), matches(text, WEAK_ID), matches(text, WEAK_SECRET), matches(text, ENDPOINT, holds="://")]
    parts = docs.withColumn(out, F.array_sort(F.flatten(F.transform(F.array(*found), placed))))
    return parts.withColumn(out, F.when(F.exists(out, lambda p: p["kind"] > 2), link(F.col(out))).otherwise(F.col(out)))


def render(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by one mark.

    What stays is put together from pieces of ``PIECE`` code points, so that no cut walks through the whole text.
    """

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        """Code points a to b, exclusive."""
        i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head, tail = F.get(pieces, i), F.coalesce(F.get(pieces, j), F.lit(""))
        across = F.concat(F.substring(head, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(tail, F.lit(1), b % PIECE))
        return F.when(b <= a, F.lit("")).when(i == j, F.substring(head, a % PIECE + 1, b - a)).otherwise(across)

    def marked(pieces: Column, ends: Column) -> Column:
        until = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
        out = F.transform(spans, lambda s, i: F.when(s["start"] >= until(i), F.concat(cut(pieces, until(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(out, ""), cut(pieces, F.element_at(ends, -1), F.char_length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    return F.when(F.size(spans) > 0, let(pieces, lambda p: let(ends, lambda e: marked(p, e)))).otherwise(text)

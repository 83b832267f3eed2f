"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.llm.tables import let, whole

LOCAL = "A-Za-z0-9._%+-"
#: A match may only begin where a run of its first characters begins, or where the match before it ended. That
#: leaves the matches of the plain pattern as they are, and a run that leads nowhere is read once.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """True where the digits pass the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)
        doubled = lambda v: F.when(v > 9, v - 9).otherwise(v)
        return _sum(F.transform(
            F.sequence(F.lit(1), n),
            lambda i: let(d.substr(i, F.lit(1)).cast("long"), lambda v: F.when((n - i) % 2 == 1, doubled(v * 2)).otherwise(v)),
        ))

    return let(_digits(found), lambda d: F.when(F.length(d) > 0, total(d) % 10 == 0).otherwise(False))


def mod97(found: Column) -> Column:
    """True where an IBAN's rearranged number leaves 1 when divided by 97."""

    def rest(s: Column) -> Column:
        moved = F.concat(s.substr(F.lit(5), F.length(s)), s.substr(F.lit(1), F.lit(4)))
        return let(moved, lambda m: F.aggregate(
            F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.ascii(m.substr(i, F.lit(1))).cast("long")),
            F.lit(0).cast("long"),
            lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97),
        ))

    return let(F.regexp_replace(found, " ", ""), lambda s: F.length(s).between(15, 34) & (rest(s) == 1))


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: what proposes a span, what confirms it, what its score starts from."""

    name: str
    pattern: str
    needs: str
    confirm: Callable[[Column], Column]
    score: float
    context: list[str] = field(default_factory=list)


def _count(found: Column, low: int, high: int) -> Column:
    return F.length(_digits(found)).between(low, high)


KINDS = [
    Kind("email", EMAIL, "@", lambda x: F.lit(True), 0.8, ["mail", "contact", "write", "correo"]),
    Kind("ip", IP, ".", lambda x: x.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), 0.6, ["ip", "host", "server", "address"]),
    Kind("card", CARD, "", lambda x: _count(x, 13, 19) & luhn(x), 0.7, ["card", "visa", "credit", "payment", "karte", "carte", "tarjeta"]),
    Kind("phone", PHONE, "+", lambda x: _count(x, 9, 15), 0.6, ["phone", "call", "tel", "mobile", "fax"]),
    Kind("iban", IBAN, "", mod97, 0.8, ["iban", "bank", "account", "konto", "compte", "cuenta"]),
]
BASE = ["email", "ip", "card", "phone"]
BLOCK, NEARBY = 256, 40


def running(numbers: Column) -> Column:
    """For every element the sum of those before it; in blocks, so long arrays aren't summed again and again."""

    def inner(block: Column, before: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(block)), lambda k: before + _sum(F.slice(block, F.lit(1), k - 1)))

    def blocks(xs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        return let(F.transform(parts, _sum), lambda sums: F.flatten(F.transform(parts, lambda p, i: inner(p, _sum(F.slice(sums, F.lit(1), i))))))

    return F.when(F.size(numbers) > 0, let(blocks(numbers), joined)).otherwise(numbers)


def _span_type() -> str:
    return "array<struct<kind:string,start:long,end:long,score:double>>"


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind; the pieces between the matches give their places."""
    pattern = F.lit(kind.pattern)
    words = "|".join(kind.context)

    def placed(found: Column) -> Column:
        def at(pieces: Column) -> Column:
            # Before match i stand the pieces 0..i and the matches 0..i-1.
            steps = F.transform(found, lambda x, i: F.length(F.get(pieces, i)).cast("long") + F.length(x))
            return let(running(steps), lambda before: F.transform(
                F.filter(
                    F.transform(found, lambda x, i: F.struct(x.alias("text"), (F.get(before, i) + F.length(F.get(pieces, i))).alias("start"), F.get(pieces, i).alias("piece"))),
                    lambda s: kind.confirm(s["text"]),
                ),
                lambda s: F.struct(
                    F.lit(kind.name).alias("kind"),
                    s["start"].alias("start"),
                    (s["start"] + F.length(s["text"])).alias("end"),
                    F.when(F.lower(F.right(s["piece"], F.lit(NEARBY))).rlike(rf"\b(?:{words})"), F.lit(min(1.0, kind.score + 0.2))).otherwise(F.lit(kind.score)).alias("score"),
                ),
            ))

        return F.when(F.size(found) > 0, let(F.split(text, kind.pattern, -1), at)).otherwise(F.array().cast(_span_type()))

    none = F.array().cast(_span_type())
    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), placed).cast(_span_type())
    # A cheap look first: the patterns need these characters.
    maybe = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(maybe, found).otherwise(none)


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", min_score: float = 0.0) -> DataFrame:
    """``docs`` with a column ``out``: an array of (kind, start, end, score), by kind as in ``KINDS``, then by start.

    Regular expressions propose the spans (leftmost, non-overlapping for each kind; code points, end
    exclusive). Address parts up to 255, Luhn, digit counts and mod-97 confirm them; a proposal that fails is
    dropped. A context word among the ``NEARBY`` characters before a span, after the match in front of it,
    raises its score by 0.2. Spans below
    ``min_score`` are left out. Null and empty texts have none; spans of different kinds may overlap. Every row
    stays as it is, repeated ones too, and nothing is shuffled.
    """
    text = whole(text_col)
    spans = F.concat(*[_spans(text, kind) for kind in KINDS])
    return docs.withColumn(out, F.filter(spans, lambda s: s["score"] >= min_score) if min_score > 0 else spans)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every confirmed span replaced by its kind in brackets.

    The kinds follow each other in the order of ``KINDS``, each on the text that the one before it left, so
    data of two kinds at one place are replaced once. Null texts stay null.
    """
    done = docs
    for kind in KINDS:
        text = F.col(text_col)

        def rebuilt(found: Column) -> Column:
            marks = F.transform(found, lambda x: F.when(kind.confirm(x), F.lit(f"[{kind.name.upper()}]")).otherwise(x))
            return let(F.split(text, kind.pattern, -1), lambda pieces: let(F.concat(marks, F.array(F.lit(""))), lambda m: F.array_join(
                F.transform(pieces, lambda p, i: F.concat(p, F.get(m, i))), "")))

        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        maybe = F.contains(text, F.lit(kind.needs)) if kind.needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
        done = done.withColumn(text_col, F.when(maybe, let(found, rebuilt)).otherwise(text))
    return done


def written(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

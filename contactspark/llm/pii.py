"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds and their proof: email (shape), ip (parts at most 255), card (16 to 19
digits, Luhn), phone (8 to 15 digits after a plus), and beyond these iban
(mod 97), short_card (13 to 15 digits, Luhn), ssn and secret (16 letters and digits
or more, of both kinds), which need a context word nearby, and access_key (shape). A span's score is its kind's base plus what context words add; base
kinds always stay, the others from ``LEAST`` on.

Everything runs in built-in expressions: a text is split at a kind's matches,
and running sums of the pieces' lengths give positions in code points. The
patterns are possessive and anchored where a match may begin, so they take time
in proportion to the text, however long a word or run of digits is.

Defined cases: a null or empty text has no spans; rows with equal ids or texts
are scanned one by one; an empty table gives an empty result; further columns
are kept, and a column named ``spans`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import fresh

#: Code points around a span in which context words count, and the least score of added kinds.
NEAR, LEAST = 40, 0.8
_CHUNK = 128


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap pattern or, with one character, a text that a match must hold
    score: float
    context: str
    base: bool = True


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,}+", "", 0.9, "card|visa|credit|debit|master"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.9, "iban|account|bank", base=False),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+", "", 0.6, "card|visa|credit|debit|amex", base=False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.5, r"\bssn\b|social security", base=False),
    Kind("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", "IA", 0.8, "key|aws|access", base=False),
    Kind("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+", "", 0.5, r"passw|passphrase|token|secret|api.?key|credential|bearer", base=False),
]
BASE = [k.name for k in KINDS if k.base]
#: What a context word adds.
CONTEXT = 0.3


def running_sums(numbers: Column) -> Column:
    """Inclusive prefix sums of an array of longs, in chunks, so that no step copies more than a chunk."""
    n = F.size(numbers)

    def sums(part: Column, start: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    zero = F.lit(0).cast("long")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / _CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(numbers, c * _CHUNK + 1, F.lit(_CHUNK)))
    starts = sums(F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(chunks, lambda c, i: F.slice(sums(c, F.get(starts, i)), F.lit(2), F.greatest(F.size(c), F.lit(0)))))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind in ("card", "short_card"):
        low, high = (16, 19) if kind == "card" else (13, 15)
        return F.when(n.between(low, high), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(hit, " ", ""))
    if kind == "secret":
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.lit(True)


def _spans(kind: Kind) -> Column:
    """The confirmed spans of a kind, from its columns of hits, gaps and ends."""
    hits, gaps, ends = (F.col(f"_{kind.name}_{x}") for x in ("hits", "gaps", "ends"))

    def span(hit: Column, i: Column) -> Column:
        around = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(around.rlike(kind.context), CONTEXT).otherwise(0.0))
        start = F.get(ends, i) - F.length(hit)
        return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), F.get(ends, i).alias("end"), score.alias("score"), hit.alias("value"))

    found = F.filter(F.transform(hits, span), lambda s: _confirmed(kind.name, s["value"]))
    found = found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST)
    return F.coalesce(found, F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,value:string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans``: array of struct (kind, start, end, score, value), by kind as listed, then start; end is exclusive."""
    kept = [c for c in docs.columns if c.lower() != "spans"]
    text = F.col("_text")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_doc"), F.coalesce("text", F.lit("")).alias("_text"))

    def hits(k: Kind) -> Column:
        found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        return F.when(F.contains(text, F.lit(k.hint)), found) if k.hint else found

    held = held.select("*", *[hits(k).alias(f"_{k.name}_hits") for k in KINDS])
    some = {k.name: F.size(f"_{k.name}_hits") > 0 for k in KINDS}
    held = held.select("*", *[F.when(some[k.name], F.split(text, k.pattern, -1)).alias(f"_{k.name}_gaps") for k in KINDS])

    def ends(k: Kind) -> Column:
        gaps = F.col(f"_{k.name}_gaps")
        return running_sums(F.transform(f"_{k.name}_hits", lambda h, i: (F.length(F.get(gaps, i)) + F.length(h)).cast("long")))

    held = held.select("_doc", *[f"_{k.name}_{x}" for k in KINDS for x in ("hits", "gaps")], *[F.when(some[k.name], ends(k)).alias(f"_{k.name}_ends") for k in KINDS])
    return held.select(*[F.col(f"_doc.`{c}`") for c in kept], F.concat(*map(_spans, KINDS)).alias("spans"))

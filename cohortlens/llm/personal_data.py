"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression on one row's text, so nothing is shuffled and no Python runs
on the executors. A pattern is applied twice: once to list its matches and once to split the text
at them, and the running lengths of both give the places. Texts that a cheap test excludes
(no ``@``, no digits in a row, ...) are not searched for that kind.

Four kinds are certain once their check holds: ``email``, ``ip``, ``card`` (Luhn) and ``phone`` (written
with +). Three more are kept from a score on: ``iban`` (mod-97, length by country),
``local_phone`` (no +, so it needs a word such as "tel" nearby) and ``spelled_email``
("name [at] mail [dot] org"). The score of a span starts from its kind, rises with a fitting
word and falls with a misleading one ("order", "version", ...) in the 40 characters before it
and the 20 after it, as far as no other span of its kind lies between.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPANS = "array<struct<kind:string,start:long,end:long,score:double,base:boolean,text:string>>"
BEFORE, AFTER = 40, 20

# fixed values: characters of an IBAN by country
IBAN_LENGTHS = {
    "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22,
    "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26,
}
MISLEADING = r"order|invoice|version|isbn|serial|sku|bestell|rechnung|factura|facture"
LETTER_OR_DIGIT = "[A-Za-z0-9]"


def iban_pattern(lengths: dict[str, int] = IBAN_LENGTHS) -> str:
    """Each country's letters, two check digits and its number of characters, with or without spaces."""
    by = {n: "|".join(c for c, m in lengths.items() if m == n) for n in sorted(set(lengths.values()))}
    return "|".join(f"(?:{names})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in by.items())


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _walk(lengths: Column, base: Column) -> Column:
    start = F.struct(F.array().cast("array<long>").alias("out"), base.alias("at"))
    return F.aggregate(lengths, start, lambda s, v: F.struct(F.concat(s["out"], F.array(s["at"])).alias("out"), (s["at"] + v).alias("at")),
                       lambda s: s["out"])


def totals_before(lengths: Column) -> Column:
    """For each entry of a long array the total of all entries before it; in blocks of 256, as
    appending one at a time would be quadratic in a text of very many spans."""
    zero = F.lit(0).cast("long")
    count = F.lit(256)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(lengths) - 1, F.lit(0)) / count).cast("int")),
                         lambda b: F.slice(lengths, b * count + 1, count))
    sums = lambda x: F.transform(x, lambda b: F.aggregate(b, zero, lambda s, v: s + v))
    return let(blocks, lambda x: F.flatten(F.zip_with(x, _walk(sums(x), zero), _walk)))


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: array of start and end (in code points, end exclusive), text,
    and the characters before and after that belong to no other match."""
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    lengths = lambda x: F.transform(x["hits"], lambda h, i: (F.length(h) + F.length(x["gaps"][i])).cast("long"))

    def one(x: Column, at: Column, i: Column) -> Column:
        gap, hit = x["gaps"][i], x["hits"][i]
        start = at + F.length(gap)
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("text"),
                        F.substring(gap, -BEFORE, BEFORE).alias("before"), F.substring(x["gaps"][i + 1], 1, AFTER).alias("after"))

    return let(both, lambda x: F.transform(totals_before(lengths(x)), lambda at, i: one(x, at, i)))


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def is_ip(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int")
    return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(part(p) <= 255, F.lit(False)))


def is_card(hit: Column) -> Column:
    return F.length(digits(hit)).between(13, 19) & F.call_function("luhn_check", digits(hit))


def is_iban(hit: Column) -> Column:
    """Remainder 1 of 97 when the first four characters go last and letters count from 10."""
    chars = F.filter(F.split(F.regexp_replace(hit, " ", ""), ""), lambda c: c != "")
    turned = let(chars, lambda c: F.concat(F.slice(c, 5, 64), F.slice(c, 1, 4)))
    step = lambda s, c: F.when(c >= "A", (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``check`` of the match confirms. ``guard`` tells of a text whether the pattern can match at all."""

    name: str
    pattern: str
    guard: Callable[[Column], Column]
    check: Callable[[Column], Column]
    score: float
    fitting: str
    base: bool = True
    alone: bool = False  # no letter or digit may touch it


# Possessive forms of greedy patterns whose parts cannot match each other's characters: the same matches, without
# backtracking. After (?:\G|(?<!..)) a match begins where its characters begin or at the end of the one before: further
# in, it would fail for the same reason.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")),
         lambda m: F.lit(True), 0.9, r"mail|contact|kontakt|correo|courriel|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda t: t.rlike(r"[0-9]\.[0-9]"), is_ip, 0.6, r"\bip\b|server|host|address|adresse|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), is_card, 0.8, r"card|visa|karte|tarjeta|carte|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(digits(m)).between(9, 15), 0.7,
         r"tel|phone|call|mobil|fax|appel|llam"),
    Kind("iban", iban_pattern(), lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), is_iban, 0.7, r"iban|bank|konto|account|cuenta|compte", base=False, alone=True),
    Kind("local_phone", r"[(]?[0-9]{2,5}[)]?(?:[ /-]{1,2}[0-9]{2,5}){1,4}", lambda t: t.rlike(r"[0-9][)]?[ /-]{1,2}[0-9]"),
         lambda m: F.length(digits(m)).between(7, 12), 0.2, r"\btel\b|telefon|phone|\bcall\b|mobil|\bfax\b", base=False, alone=True),
    Kind("spelled_email", r"[A-Za-z0-9._%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]+)+",
         lambda t: t.rlike(r"[(\[]at[)\]]"), lambda m: F.lit(True), 0.6, r"mail|contact|kontakt|correo|courriel|write", base=False),
)


def _score(kind: Kind, m: Column) -> Column:
    near = F.lower(F.concat(m["before"], F.lit("\n"), m["after"]))
    return F.lit(kind.score) + F.when(near.rlike(kind.fitting), 0.4).otherwise(0.0) - F.when(near.rlike(MISLEADING), 0.3).otherwise(0.0)


def _spans(kind: Kind, text: Column, threshold: float) -> Column:
    span = lambda m, s: F.struct(F.lit(kind.name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                                 F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)).alias("score"), F.lit(kind.base).alias("base"), m["text"].alias("text"))
    good = F.filter(matches(text, kind.pattern), lambda m: kind.check(m["text"]))
    if kind.alone:
        touched = lambda m: m["before"].rlike(r"[A-Za-z0-9+.,/-]\z") | m["after"].rlike(rf"\A{LETTER_OR_DIGIT}")
        good = F.filter(good, lambda m: ~touched(m))
    out = F.transform(good, lambda m: span(m, _score(kind, m)))
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= threshold)
    return F.when(kind.guard(text), out.cast(SPANS)).otherwise(F.array().cast(SPANS))


def personal_data(text: Column, threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Array of spans (kind, start, end, score, base, text) by kind as listed, then start.

    Places are code points, the end exclusive. Base kinds stay whatever their score; the others need
    ``threshold`` and must not touch a base span. A NULL text has no spans, like the empty one.
    """
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[_spans(k, text, threshold) for k in kinds if k.base])
    more = F.concat(*[_spans(k, text, threshold) for k in kinds if not k.base])
    apart = lambda b, s: (b["end"] <= s["start"]) | (b["start"] >= s["end"])
    return let(base, lambda b: F.concat(b, F.filter(more, lambda s: F.forall(b, lambda x: apart(x, s)))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with [kind] in place of each span; of overlapping ones the first, in order of start, names the place."""
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        added = F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return F.struct(F.when(x["start"] >= s["at"], added).otherwise(s["out"]).alias("out"), F.greatest(s["at"], x["end"]).alias("at"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, none, step, rest)).otherwise(text)


def find_personal_data(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus __spans, see ``personal_data``.

    Rows never meet: copies, repeated rows, repeated and NULL ids each keep their row, columns other than __spans are
    untouched, and an empty table gives an empty result. Whole texts are searched; NULL, empty and blank ones have no spans.
    """
    return docs.withColumn("__spans", personal_data(F.col(text_col), threshold))


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

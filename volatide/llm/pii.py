r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything is a DataFrame expression. A span is struct(kind, start, end, score): offsets count code points from 0,
the end is exclusive. Kinds, in this order: email, ip, card, phone (the base kinds), iban (added).

Offsets come without any position function: `split` by a pattern gives the texts between its matches and
`regexp_extract_all` the matches themselves, both from the same leftmost non-overlapping scan, so a match starts
at the total length of the gaps and matches before it. These running sums are made by doubling: each round adds the
value 1, 2, 4, ... places before, so n matches take n log n steps. Parts of a text are cut from a copy in UTF-32,
where a code point's place is known without a scan.

The patterns match exactly what the plain forms in KINDS' comments match. Possessive quantifiers only stand where
backtracking can't help, and `\G|(?<!...)` lets a scan start only at the beginning of a run or at the end of the
last match; a start inside a run fails whenever the run's beginning fails. So no text needs quadratic time or deep
recursion.

Defined results: null text counts as empty; empty text has no spans; other columns are kept untouched; rows are
independent, so repeated rows and ties give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volatide.llm.common import unused

_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"

# Kind -> (guard that any match needs, pattern).
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    # country, check digits, 11 to 30 more, perhaps in groups
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9_])"),
}
BASE = ("email", "ip", "card", "phone")

# Score of a confirmed span, and words that raise it by CONTEXT_BONUS when they stand shortly before.
SCORES = {"email": 0.85, "ip": 0.6, "card": 0.8, "phone": 0.55, "iban": 0.85}
CONTEXT = {
    "email": "mail|contact|write|adresse|correo|courriel",
    "ip": r"\bip\b|address|server|host|login",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
}
CONTEXT_CHARS = 40
CONTEXT_BONUS = 0.15


def _mod97(value: Column) -> Column:
    """Remainder of an IBAN by 97, a character at a time."""
    moved = F.concat(F.substring(value, 5, 64), F.substring(value, 1, 4))
    digit = lambda c: F.when(c >= 65, c - 55).otherwise(c - 48)
    return F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, x: F.when(x == "", acc).otherwise(
            (acc * F.when(F.ascii(x) >= 65, F.lit(100)).otherwise(F.lit(10)) + digit(F.ascii(x))) % 97
        ),
    )


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(found, r"[\x20-]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(found, "[^0-9]", "")).between(9, 15)
    if kind == "iban":
        packed = F.regexp_replace(found, r"\x20", "")
        return F.length(packed).between(15, 34) & (_mod97(packed) == 1)
    return F.lit(True)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """At each place the `join` (a sum, a maximum) of all values up to it."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))

    def step(acc: Column, j: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), j)
        return F.transform(acc, lambda x, i: F.when(i >= far, join(x, F.get(acc, i - far))).otherwise(x))

    return F.aggregate(rounds, values, step)


def _wide(text: Column) -> Column:
    return F.encode(text, "UTF-32")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value read once: a binary column would be copied for each span."""
    return F.get(F.transform(F.array(value), use), 0)


def _cut(wide: Column, start: Column, end: Column) -> Column:
    """Code points start to end (exclusive) of a text in UTF-32."""
    return F.decode(F.substring(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")


def _spans(wide: Column, kind: str, found: Column) -> Column:
    """All confirmed spans of a kind; found: struct of hits and gaps."""
    hits, gaps = found["hits"], found["gaps"]
    steps = F.transform(gaps, lambda gap, i: F.length(gap) + F.when(i > 0, F.length(F.get(hits, i - 1))).otherwise(F.lit(0)))

    def span(hit: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("hit"))

    def scored(s: Column, wide: Column) -> Column:
        near = F.lower(_cut(wide, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)), s["start"])).rlike(CONTEXT[kind])
        score = F.lit(SCORES[kind]) + F.when(near, F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    placed = F.zip_with(hits, F.slice(_running(steps, lambda a, b: a + b), F.lit(1), F.size(hits)), span)
    valid = F.filter(placed, lambda s: _valid(kind, s["hit"]))
    return _bound(wide, lambda w: F.transform(valid, lambda s: scored(s, w)))


def find_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add `out` (a column of that name is replaced): array of spans by kind, then start. Other columns stay."""
    names = {kind: unused(df.columns, f"__pii_{kind}") for kind in KINDS}
    wide = unused(df.columns, "__pii_wide")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = {
        names[kind]: F.when(
            body.rlike(guard),
            F.struct(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("hits"), F.split(body, pattern, -1).alias("gaps")),
        )
        for kind, (guard, pattern) in KINDS.items()
    }
    some = F.coalesce(*[F.when(F.size(F.col(n)["hits"]) > 0, F.lit(True)) for n in names.values()], F.lit(False))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    parts = [F.when(F.size(F.col(n)["hits"]) > 0, _spans(F.col(wide), k, F.col(n))).otherwise(empty) for k, n in names.items()]
    return df.withColumns(found).withColumn(wide, F.when(some, _wide(body))).withColumn(out, F.concat(*parts)).drop(wide, *names.values())


def redact(df: DataFrame, text: str = "text", spans: str = "pii_spans", threshold: float = 0.0) -> DataFrame:
    """Replace each span that scores at least `threshold` by its kind in angle brackets.

    Spans go by start, longer ones first; one that begins before the end of an earlier one is covered with it.
    """
    ordered, ends, wide = (unused(df.columns, f"__pii_{n}") for n in ("ordered", "ends", "wide"))
    by_start = F.array_sort(
        F.filter(F.col(f"`{spans}`"), lambda s: s["score"] >= threshold),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )
    # ends[i]: where everything before span i is covered up to; the last one: everything.
    upto = F.concat(F.array(F.lit(0)), _running(F.transform(F.col(ordered), lambda s: s["end"]), F.greatest))

    def piece(s: Column, i: Column, w: Column) -> Column:
        before = F.get(F.col(ends), i)
        return F.when(s["start"] >= before, F.concat(_cut(w, before, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))

    done = df.withColumn(ordered, by_start).withColumn(ends, F.when(F.size(ordered) > 0, upto)).withColumn(wide, F.when(F.size(ordered) > 0, _wide(F.col(f"`{text}`"))))
    rest = F.decode(F.substring(F.col(wide), 4 * F.element_at(F.col(ends), -1) + 1, F.octet_length(F.col(wide))), "UTF-32")
    masked = F.concat(F.array_join(_bound(F.col(wide), lambda w: F.transform(F.col(ordered), lambda s, i: piece(s, i, w))), ""), rest)
    return done.withColumn(text, F.when(F.size(ordered) > 0, masked).otherwise(F.col(f"`{text}`"))).drop(ordered, ends, wide)


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

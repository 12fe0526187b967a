r"""Text functions. White space is Unicode's plus the four separator controls, which plain \s would leave out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]+"


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def clean_body(text: Column) -> Column:
    """Without tags, links and mail addresses; white space collapsed."""
    out = F.coalesce(text, F.lit(""))
    # A mail address always starts at the beginning of a run; saying so keeps the scan linear.
    for pattern in (r"<[^>]+>", r"(?U)https?://\S+|www\.\S+", r"(?U)(?<!\S)\S+@\S+\.\S+"):
        out = F.regexp_replace(out, pattern, " ")
    return normalize(out)


def body_lead(text: Column, chars: int = 300) -> Column:
    return F.trim(F.substring(normalize(text), 1, chars))


def body_slice(text: Column, chars: int = 1200) -> Column:
    """Cut before normalising, which spares work on what is cut off."""
    return normalize(F.substring(F.coalesce(text, F.lit("")), 1, chars))


def input_text(title: Column, lead: Column) -> Column:
    return F.concat_ws(" . ", F.nullif(normalize(title), F.lit("")), F.nullif(normalize(lead), F.lit("")))


def count_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(normalize(text), " "), lambda x: x != "")).cast("long")


def title_hash(title: Column, date: Column) -> Column:
    """First 16 hex digits over the trimmed lower-case title and the date."""
    trimmed = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.substring(F.sha2(F.concat(F.lower(trimmed), F.lit("|"), F.coalesce(date, F.lit(""))), 256), 1, 16)


def infer_category(url: Column, table: dict[str, str], default: str) -> Column:
    """The first key, in the table's order, that the url contains."""
    out = None
    for key, value in table.items():
        out = F.when(url.contains(key), value) if out is None else out.when(url.contains(key), value)
    return out.otherwise(default) if out is not None else F.lit(default)


def _without_dots(path: Column, tidy: Column) -> Column:
    """A path with its . and .. segments resolved; where `tidy`, without empty inner segments."""
    parts = F.split(path, "/", -1)
    inner = F.filter(parts, lambda p, i: ~tidy | (i == 0) | (i == F.size(parts) - 1) | (p != ""))
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).when(p == ".", acc).otherwise(F.concat(acc, F.array(p))))
    ends = F.when(path.rlike(r"(^|/)\.\.?$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    out = F.array_join(ends, "/")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Absolute, without fragment; null for script and mail links. `base` resolves relative urls, with . and .. in their paths."""
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    if base is not None:
        plain = F.regexp_replace(base, "#.*$", "")
        root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
        scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
        folder = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*/|/)", 1), F.lit("")), F.lit("/"))
        path, rest = F.regexp_extract(clean, r"^([^?]*)", 1), F.regexp_extract(clean, r"^[^?]*(.*)$", 1)
        rooted = clean.startswith("/")
        clean = (
            F.when(clean.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), clean)
            .when(clean.startswith("//"), F.concat(scheme, clean))
            .when(clean == "", plain)
            .when(clean.startswith("?"), F.concat(F.regexp_replace(plain, r"\?.*$", ""), clean))
            .otherwise(F.concat(root, _without_dots(F.when(rooted, path).otherwise(F.concat(folder, path)), ~rooted), rest))
        )
    return F.when(F.lower(clean).rlike("^(javascript|mailto):") | (clean == ""), F.lit(None).cast("string")).otherwise(clean)


def strip_html(html: Column) -> Column:
    """Visible text, roughly: scripts, styles and tags removed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return normalize(F.regexp_replace(out, r"<[^>]+>", " "))


def first_present(*columns: Column) -> Column:
    """The first that isn't null or blank, normalised."""
    return F.coalesce(*[F.nullif(normalize(c), F.lit("")) for c in columns], F.lit(""))


def normalize_label(label: Column) -> Column:
    """Lower-case label, null if it isn't one of the three."""
    value = F.lower(normalize(label))
    return F.when(value.isin("negative", "neutral", "positive"), value)


# --- language-model answers -----------------------------------------------------------------------------------

ANSWER = "article_id string, label string, confidence double, rationale string"


def salvage_json(text: Column) -> Column:
    """Array of answers from the outermost brackets of a text; a lone object counts as an array of one; else null."""
    listed = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    single = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    from_list = F.when(listed != "", F.from_json(listed, f"array<struct<{ANSWER.replace(' string', ':string').replace(' double', ':double')}>>"))
    from_one = F.when(single != "", F.array(F.from_json(single, ANSWER)))
    return F.coalesce(from_list, from_one)


def answer_status(label: Column, confidence: Column, rationale: Column) -> Column:
    return (
        F.when(normalize_label(label).isNull(), "invalid_label")
        .when(confidence.isNull() | ~confidence.between(0, 1), "invalid_confidence")
        .when(normalize(rationale) == "", "missing_rationale")
        .otherwise("ok")
    )

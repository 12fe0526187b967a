r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example: all turns before it are context and only its reply is under the loss mask.
A conversation's turns after its last assistant turn (all of them, if it has none) close with one example without a
target, so that the output holds every turn.

Template of a turn: <s>[INST]role[/INST]text</s>. Inside roles and texts a backslash goes before every backslash and
every control string, which is reversible: `read_turns` gives back what was formatted.

A conversation is the unit of work and is gathered by its id. Its turns are rendered once; examples are made one at a
time from the array of rendered turns, so no task holds all examples of a conversation at once.

Defined results: null roles and texts count as empty; turns order by turn number (null first), then role and text,
so repeated rows stay and reruns agree; rows with a null conversation id are one conversation; an empty table gives
no examples; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]")
TARGET_ROLE = "assistant"

_READ = r"<s>\[INST\]((?:[^\\\[]++|\\[\s\S]|\[(?!/INST\]))*+)\[/INST\]((?:[^\\<]++|\\[\s\S]|<(?!/s>))*+)</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit("\\" + control))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def format_examples(turns: DataFrame) -> DataFrame:
    """From (conv_id, turn, role, text) to (conv_id, example, formatted, loss_start, loss_end).

    Examples count from 0; the mask is [loss_start, loss_end) in code points, null where an example has no target.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    rendered = lambda t: F.concat(F.lit("<s>[INST]"), escape(t["role"]), F.lit("[/INST]"), escape(t["text"]), F.lit("</s>"))
    talks = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    talks = talks.select(
        "conv_id",
        F.transform("ts", rendered).alias("parts"),
        F.transform("ts", lambda t: F.length(escape(t["text"]))).alias("reply_chars"),
        F.transform("ts", lambda t: t["role"] == TARGET_ROLE).alias("targets"),
    )
    last = F.size("parts") - 1
    at = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("targets", i) | (i == last))
    one = talks.select("conv_id", "parts", "reply_chars", "targets", F.posexplode(at).alias("example", "at"))
    one = one.select(
        "conv_id",
        "example",
        F.array_join(F.slice("parts", F.lit(1), F.col("at") + 1), "").alias("formatted"),
        F.when(F.get("targets", F.col("at")), F.get("reply_chars", F.col("at"))).alias("reply"),
    )
    end = F.when(F.col("reply").isNotNull(), F.length("formatted") - len("</s>"))
    return one.select("conv_id", F.col("example").cast("long").alias("example"), "formatted", (end - F.col("reply")).cast("long").alias("loss_start"), end.cast("long").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """Array of struct(role, text), parsed back from an example's text."""
    roles = F.regexp_extract_all(formatted, F.lit(_READ), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(_READ), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the mask, parsed back; null where there is none."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))

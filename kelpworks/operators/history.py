"""What a message refers to, with the session's earlier messages to fall back on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpworks.functions.text import contains_any, normalize_text
from kelpworks.functions.vocabulary import FOLLOW_UP_THINGS

#: How a post is named, in the text as written and in its normal form; what refers back to one.
NAMED = (r"(?i)/posts/(\d+)", r"(?i)\bLISTING_ID:\s*(\d+)", r"(?i)(?<![\p{L}\p{N}_])(?:căn|can|bất\s*động\s*sản|bat\s*dong\s*san|bđs|bds|post|tin)\s*#?\s*(\d{2,})\b")
NAMED_PLAIN = r"\b(?:can(?: nha| ho)?|nha|bat dong san|bds|post|tin) *#? *(\d{2,})\b"
REFERS_BACK = r"\b(?:can(?: nha| ho)?|nha|ngoi nha|bat dong san|bds|tin|mat bang|lo dat) (?:nay|do|kia)\b"
USER, MODEL = ("user", "human"), ("assistant", "ai")


def named_post(text: Column) -> Column:
    """The id of the post that a text names, or null."""
    found = [F.regexp_extract(F.coalesce(text, F.lit("")), p, 1) for p in NAMED] + [F.regexp_extract(normalize_text(text), NAMED_PLAIN, 1)]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found)).try_cast("bigint")


def refers_back(text: Column) -> Column:
    flat = normalize_text(text)
    return contains_any(flat, FOLLOW_UP_THINGS) | flat.rlike(REFERS_BACK)


def with_history(messages: DataFrame, name: str, entity: Column, session: str = "conv_id", turn: str = "turn", role: str = "role", when: Column | None = None, any_role: bool = False, fallback: Column | None = None) -> DataFrame:
    """messages with column `name`: the entity of the message itself; else, where `when` holds, of the newest earlier message
    of the user that has one; else of the model's (L11), or of anyone's (any_role, L3); else the fallback.

    One running window a session: as-of lookups look at earlier rows only. Messages sort by turn, null first; those of one
    turn by role, so that none of a turn is in the other's past by chance. Null entities name nothing.
    """
    before = Window.partitionBy(session).orderBy(F.col(turn).asc_nulls_first(), role).rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda rows: F.last(F.when(rows, F.col("__own")), ignorenulls=True).over(before)
    by = F.coalesce(F.lower(F.trim(role)), F.lit(""))
    seen = messages.withColumn("__own", entity).withColumns({"__user": newest(by.isin(*USER)), "__other": newest(F.lit(True) if any_role else by.isin(*MODEL))})
    past = F.coalesce("__user", "__other", *([] if fallback is None else [fallback]))
    return seen.withColumn(name, F.coalesce("__own", past if when is None else F.when(when, past))).drop("__own", "__user", "__other")


def posts_in_context(messages: DataFrame, fallback: Column | None = None, text: str = "text", **columns) -> DataFrame:
    """`post_id`, from history only where the message refers back to a post."""
    return with_history(messages, "post_id", named_post(F.col(text)), when=refers_back(F.col(text)), fallback=fallback, **columns)

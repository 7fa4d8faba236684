"""Chat formatting with a grammar round trip, in native column functions only.

The grammar of a formatted conversation::

    conversation = { turn }
    turn         = "<s>" header text "</s>"
    header       = "[INST] "            for the role user
                 | "[role=" role "] "   for any other role
    text of a user turn is followed by " [/INST]"

Texts and roles are first rendered as they are, each turn is parsed again by the
deterministic parser, and the recovered turn is compared with its source.  A turn
that differs is escaped one level further and tried again, until identical:

    0  as it is
    1  the marks of the grammar inside the text are escaped
    2  every "&", "<", "[" and "]" is escaped, which the parser always recovers

The parser reads "&lt;" as "<", "&#91;" as "[", "&#93;" as "]" and then "&amp;" as "&".
A whole conversation is parsed by splitting at "</s>", which no rendered text
holds, so it is linear in its length; it is compared with its source once more, by hashes of the turns.

The loss mask is code-point spans: for each turn where its segment and its text begin and
end in the formatted conversation, and whether the text is under the loss.

Defined cases: null role and null text are empty; a null conv_id is a conversation
of its own; turns are ordered by turn, nulls first, ties by role and text; repeated
rows are repeated turns; an empty table gives no rows; other columns are ignored.
Rows of a long conversation are rendered and checked turn by turn, and its turns are put in order
by a sort that spills; only its own formatted text is brought together, as it is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<s>", "</s>"
USER_OPEN, USER_CLOSE, ROLE_OPEN = "[INST] ", " [/INST]", "[role="
#: What level 1 escapes, longest first, and how.
MARKS = (("[/INST]", "&#91;/INST]"), ("[INST]", "&#91;INST]"), ("[role=", "&#91;role="), ("</s>", "&lt;/s>"), ("<s>", "&lt;s>"))
#: What level 2 escapes, in this order; unescaped in the reverse order.
CHARACTERS = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))


def _replace(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, level: int) -> Column:
    return text if level == 0 else _replace(text, MARKS) if level == 1 else _replace(text, CHARACTERS)


def unescape(text: Column) -> Column:
    return _replace(text, [(new, old) for old, new in reversed(CHARACTERS)])


def render_turn(role: Column, text: Column, level: int) -> Column:
    shown, name = escape(text, level), escape(role, level)
    user = F.concat(F.lit(BEGIN + USER_OPEN), shown, F.lit(USER_CLOSE + END))
    other = F.concat(F.lit(BEGIN + ROLE_OPEN), name, F.lit("] "), shown, F.lit(END))
    return F.when(role == "user", user).otherwise(other)


def parse_turn(turn: Column) -> Column:
    """role and text of one turn without its end mark; null if it isn't in the grammar."""
    body = F.substr(turn, F.lit(len(BEGIN) + 1))
    is_user = F.startswith(body, F.lit(USER_OPEN)) & F.endswith(body, F.lit(USER_CLOSE)) & (F.length(body) >= len(USER_OPEN) + len(USER_CLOSE))
    user_text = F.substr(body, F.lit(len(USER_OPEN) + 1), F.length(body) - (len(USER_OPEN) + len(USER_CLOSE)))
    close = F.instr(body, "] ")
    other_role = F.substr(body, F.lit(len(ROLE_OPEN) + 1), close - (len(ROLE_OPEN) + 1))
    user = F.struct(F.lit("user").alias("role"), unescape(user_text).alias("text"))
    other = F.struct(unescape(other_role).alias("role"), unescape(F.substr(body, close + 2)).alias("text"))
    headed = F.startswith(body, F.lit(ROLE_OPEN)) & (close > len(ROLE_OPEN))
    return F.when(F.startswith(turn, F.lit(BEGIN)) & is_user, user).when(F.startswith(turn, F.lit(BEGIN)) & headed, other)


def parse_conversation(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    pieces = F.split(formatted, END)
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), parse_turn)


def _recovers(rendered: Column, role: Column, text: Column, level: int) -> Column:
    """Whether a rendered turn holds no mark of the grammar but its own, and reads as its source."""
    read = parse_turn(F.substr(rendered, F.lit(1), F.length(rendered) - len(END)))
    clean = F.lit(True)
    for mark, _ in MARKS:
        for part in (role, text):
            clean &= ~F.contains(escape(part, level), F.lit(mark))
    return F.coalesce(clean & (read["role"] == role) & (read["text"] == text), F.lit(False))


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, level, segment and the place of the text in it (head, size) of every row."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    role, text = F.col("role"), F.col("text")
    rows = rows.select("*", *[render_turn(role, text, k).alias(f"r{k}") for k in range(3)])
    level = F.when(_recovers(F.col("r0"), role, text, 0), 0).when(_recovers(F.col("r1"), role, text, 1), 1).when(_recovers(F.col("r2"), role, text, 2), 2)
    rows = rows.withColumn("level", level)
    kept = F.when(F.col("level") == 0, F.col("r0")).when(F.col("level") == 1, F.col("r1")).when(F.col("level") == 2, F.col("r2"))
    segment = F.coalesce(kept, F.raise_error(F.lit("a turn can't be recovered")))
    rows = rows.select("conv_id", "turn", "role", "text", "level", segment.alias("segment"))
    close = F.when(role == "user", len(USER_CLOSE + END)).otherwise(len(END))
    # A role's own marks are escaped, so the header ends at the first mark of its kind.
    head = F.when(role == "user", len(BEGIN + USER_OPEN)).otherwise(F.instr("segment", "] ") + 1)
    return rows.select("*", head.alias("head"), (F.length("segment") - head - close).alias("size"))


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, levels, and spans: of each turn where its segment begins, where its text begins and ends, and whether it is under the loss."""
    rows = format_turns(conversations)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    begin = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = rows.select("conv_id", F.row_number().over(order).alias("nth"), "role", "level", "segment", "head", "size", begin.alias("begin"), F.xxhash64("role", "text").alias("source"))
    start = F.col("begin") + F.col("head")
    span = F.struct("begin", start.alias("start"), (start + F.col("size")).alias("end"), (F.col("role") == loss_role).alias("loss"))
    turn = F.struct("nth", "segment", "level", "source", span.alias("span"))
    # The rows of a conversation are dealt out and in order by now; its formatted text is one value.
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    out = gathered.select("conv_id", F.concat_ws("", F.col("t.segment")).alias("formatted"), F.col("t.level").alias("levels"), F.col("t.span").alias("spans"), F.col("t.source").alias("source"))
    read = F.transform(parse_conversation(F.col("formatted")), lambda x: F.xxhash64(x["role"], x["text"]))
    same = F.coalesce(read == F.col("source"), F.lit(False))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation differs after its round trip")))
    return out.select("conv_id", checked.alias("formatted"), "levels", "spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and the loss texts, read from the formatted text and its spans."""
    parsed = formatted.withColumn("turns", parse_conversation(F.col("formatted")))
    pieces = F.split("formatted", END)
    masked = F.filter(F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("piece"), F.col("spans").alias("span")), lambda x: x["span"]["loss"])

    def covered(x: Column) -> Column:
        at = x["span"]
        return unescape(F.substr(x["piece"], (at["start"] - at["begin"] + 1).cast("int"), (at["end"] - at["start"]).cast("int")))

    return parsed.select("conv_id", "turns", "formatted", F.transform(masked, covered).alias("loss_texts"))

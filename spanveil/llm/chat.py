"""Chat formatting by event-sourced reconstruction. Native DataFrame code only.

A conversation is a log of events (conversation, sequence, turn, kind, role, text). Kinds:
message opens a message, delta appends to the open one, edit replaces its text, regenerate empties it
for the deltas that follow. Events are folded per turn in order of sequence; turns are laid out in
blocks of BLOCK_TURNS that are joined before the blocks of a conversation meet, so a long
conversation is pre-aggregated by many tasks.

Template: a conversation is a run of `<|role|>\n` text `</s>\n`. Inside roles and texts a backslash is
doubled and the strings of CONTROLS are broken by a single backslash, so no control string of this or
other common templates can be forged, and unescape() restores every text exactly. In roles every `<` and
`|` is followed by a backslash, so that none can close or open a mark, wherever it stands.

The loss mask is emitted with the text: for each turn its length in the formatted text, where its own text
begins and ends in that, and whether it is learnt from. Marks of turns and their ends are never learnt.

Cases: null text and null role count as empty; a null kind is a message; a null turn comes after all
others; events that agree in turn and sequence are ordered by kind, role, text, and repeated rows are
repeated messages. A delta, edit or regeneration without a message opens one. An empty log gives no
rows. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
#: Control strings and their broken forms. Fixed values of common chat templates.
CONTROLS = {"<|": "<\\|", "</s>": "<\\/s>", "<s>": "<\\s>", "[INST]": "[\\INST]", "[/INST]": "[\\/INST]", "<<SYS>>": "<\\<SYS>>", "<</SYS>>": "<\\</SYS>>"}
KINDS = ("message", "delta", "edit", "regenerate")
LAST_TURN = 2**62


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, broken in CONTROLS.items():
        out = F.replace(out, F.lit(control), F.lit(broken))
    return out


def escape_role(role: Column) -> Column:
    """Also breaks whatever could be part of a mark."""
    return F.regexp_replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), r"([<|\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def fold(events: Column) -> Column:
    """Sorted events of one turn to messages: array of struct(role, text)."""
    empty = F.array().cast("array<struct<role:string,text:string>>")

    def step(done: Column, e: Column) -> Column:
        last = F.when(F.size(done) > 0, F.element_at(done, -1))
        rest = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        role = F.coalesce(last["role"], e["role"])
        text = F.when(e["kind"] == "delta", F.concat(F.coalesce(last["text"], F.lit("")), e["text"])).when(e["kind"] == "edit", e["text"]).otherwise("")
        fresh = F.array(F.struct(e["role"].alias("role"), e["text"].alias("text")))
        return F.when(e["kind"] == "message", F.concat(done, fresh)).otherwise(F.concat(rest, F.array(F.struct(role.alias("role"), text.alias("text")))))

    return F.aggregate(events, empty, step)


def format_conversations(
    log: DataFrame, conv_col: str = "conv_id", seq_col: str = "seq", turn_col: str = "turn", kind_col: str = "kind", role_col: str = "role", text_col: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row a conversation: conv_col, formatted, pieces (array of struct(role, length, start, end, loss)).

    A piece is a turn in order: its length in formatted, so that places follow by summing, where its escaped text
    starts and ends in it (code points, end exclusive), and whether that text is under the loss mask."""
    no = F.lit("")
    events = log.select(
        F.col(conv_col).alias("_conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(LAST_TURN)).alias("_turn"),
        F.struct(
            F.col(seq_col).cast("long").alias("seq"), F.coalesce(F.col(kind_col), F.lit("message")).alias("kind"), F.coalesce(F.col(role_col), no).alias("role"), F.coalesce(F.col(text_col), no).alias("text")
        ).alias("_e"),
    )
    turns = events.groupBy("_conv", "_turn").agg(F.array_sort(F.collect_list("_e")).alias("_events"))
    messages = turns.select("_conv", "_turn", F.posexplode(fold(F.col("_events"))).alias("_k", "_m"))
    said = messages.select("_conv", "_turn", "_k", F.col("_m.role").alias("role"), F.concat(F.lit("<|"), escape_role(F.col("_m.role")), F.lit("|>\n")).alias("_head"), escape(F.col("_m.text")).alias("_body"))
    start = F.length("_head").cast("long")
    pieces = said.select(
        "_conv", "_turn",
        F.struct("_turn", "_k", F.concat("_head", "_body", F.lit("</s>\n")).alias("s"), (F.col("role") == learn).alias("loss"), "role", start.alias("start"), (start + F.length("_body")).alias("end")).alias("_p"),
    )
    blocks = pieces.groupBy("_conv", F.floor(F.col("_turn") / BLOCK_TURNS).alias("_block")).agg(F.array_sort(F.collect_list("_p")).alias("_ps"))
    blocks = blocks.select(
        "_conv",
        F.struct(
            "_block",
            F.array_join(F.transform("_ps", lambda p: p["s"]), "").alias("s"),
            F.transform("_ps", lambda p: F.struct(p["role"].alias("role"), F.length(p["s"]).cast("long").alias("length"), p["start"].alias("start"), p["end"].alias("end"), p["loss"].alias("loss"))).alias("pieces"),
        ).alias("_b"),
    )
    whole = blocks.groupBy("_conv").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    return whole.select(
        F.col("_conv").alias(conv_col),
        F.array_join(F.transform("_bs", lambda b: b["s"]), "").alias("formatted"),
        F.flatten(F.transform("_bs", lambda b: b["pieces"])).alias("pieces"),
    )


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Parses formatted: conv_col, turns (array of struct(role, text)), learnt (array: the text under the loss mask, unescaped, by turn), formatted_chars.

    Turns come from the formatted text alone, learnt from it and the mask; a mask that doesn't fit the text is an error."""
    parts = F.transform(F.filter(F.split("formatted", r"<\|"), lambda s: s != ""), lambda s: F.concat(F.lit("<|"), s))

    def turn(s: Column) -> Column:
        role = unescape(F.substring(F.substring_index(s, "|>\n", 1), F.lit(3), F.length(s)))
        body = F.substring(s, F.instr(s, "|>\n") + 3, F.length(s))
        return F.struct(role.alias("role"), unescape(F.substring(body, F.lit(1), F.length(body) - 5)).alias("text"))

    def masked(s: Column, p: Column) -> Column:
        fits = F.coalesce(F.length(s) == p["length"], F.lit(False))
        text = unescape(F.substring(s, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")))
        return F.when(~fits, F.raise_error(F.lit("the loss mask doesn't fit the formatted text")).cast("string")).when(p["loss"], text).otherwise("")

    rows = formatted.select(conv_col, parts.alias("_parts"), "pieces", F.length("formatted").cast("long").alias("formatted_chars"))
    return rows.select(conv_col, F.transform("_parts", turn).alias("turns"), F.zip_with("_parts", "pieces", masked).alias("learnt"), "formatted_chars")


def digest_turns(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(conv_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.array_join("learnt", "").alias("_loss"), "formatted_chars").select(
        conv_col, "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"
    )

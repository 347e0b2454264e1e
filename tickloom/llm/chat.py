"""Chat formatting with budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns. A window shows the system
turn, a limited stretch of the turns before its span, and the span; only assistant turns of the span
itself carry loss, so that repeated turns are never trained on twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import word_count

# The marks of the template, and further control strings kept out of texts.
START, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (START, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of new turns in a window, and of turns repeated before them. A token is a word; a turn has one more for its marks.
BUDGET, HISTORY = 512, 128
#: Turns whose tokens are summed in one group.
RUN = 256


def escaped(text: Column) -> Column:
    """``text`` without control strings: a backslash after the first character of each, and before each backslash."""
    inner = "|".join("".join("\\" + c if not c.isalnum() else c for c in control[1:]) for control in CONTROLS if control[0] == "<")
    square = "|".join("".join("\\" + c if not c.isalnum() else c for c in control[1:]) for control in CONTROLS if control[0] == "[")
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    safe = F.regexp_replace(safe, f"<(?={inner})", r"<\\")
    return F.regexp_replace(safe, rf"\[(?={square})", r"[\\")


def unescaped(text: Column) -> Column:
    """The text that ``escaped`` was given: a backslash goes, what follows it stays."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation and window: conv_id, window, formatted, turns, loss.

    turns: array of (role, start, chars, kind) in the order of ``formatted``, in code points, start
    from 0; kind is "system", "history" or "new". loss: array of (start, chars), the texts of new
    assistant turns.

    A span has the turns whose first token falls into the same stretch of ``budget`` tokens, so that
    it exceeds the budget by less than one turn, and a turn longer than it stands whole. The first row
    of a conversation, if of role system, opens every later window too. Up to ``history`` (at most
    ``budget``) tokens of turns right before the span are repeated.

    Rows go by turn, then role and text; null turns come first; equal rows are separate turns. Null
    role and text count as empty. A null conversation id is a conversation. An empty table gives no
    windows. Columns beside the four named are not read. Turn numbers place rows in runs of 256 whose
    sums are added up, so that a very long conversation is not summed in one task as long as its turn
    numbers differ.
    """
    history = min(history, budget)
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumns({"run": F.floor(F.col("turn") / RUN), "tokens": word_count(F.col("text")) + 1})
    in_run = Window.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({
        "into": F.sum("tokens").over(in_run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"), "nth": F.row_number().over(in_run),
    })
    totals = rows.groupBy("conv_id", "run").agg(F.sum("tokens").alias("all"))
    along = Window.partitionBy("conv_id").orderBy(F.col("run").asc_nulls_first())
    starts = totals.select(
        F.col("conv_id").alias("_c"), F.col("run").alias("_r"), F.coalesce(F.sum("all").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        (F.row_number().over(along) == 1).alias("first_run"),
    )
    placed = rows.join(starts, rows["conv_id"].eqNullSafe(starts["_c"]) & rows["run"].eqNullSafe(starts["_r"])).select(
        "conv_id", "role", "text", "tokens", (F.col("base") + F.col("into")).alias("at"), (F.col("first_run") & (F.col("nth") == 1) & (F.col("role") == "system")).alias("opens"),
    ).withColumn("span", F.floor(F.col("at") / budget))
    opening = placed.where("opens").select(F.col("conv_id").alias("_c"), F.struct("at", "role", "text").alias("opening"))
    # each turn is shown in its span, and offered to the next as history
    shown = placed.select(
        "conv_id", F.explode(F.array(F.struct("span", F.lit(True).alias("new")), F.struct((F.col("span") + 1).alias("span"), F.lit(False).alias("new")))).alias("w"),
        F.struct("at", "role", "text").alias("t"),
    ).select("conv_id", F.col("w.span").alias("window"), "w.new", "t")
    by_window = shown.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.when(F.col("new"), F.col("t")))).alias("fresh"), F.sort_array(F.collect_list(F.when(~F.col("new"), F.col("t")))).alias("past"),
    ).where(F.size("fresh") > 0)
    opened = by_window.join(opening, by_window["conv_id"].eqNullSafe(opening["_c"]), "left")
    begin = F.element_at("fresh", 1)["at"]
    recent = F.filter("past", lambda t: (t["at"] >= begin - history) & ~F.coalesce(t["at"] == F.col("opening.at"), F.lit(False)))
    head = F.when(F.col("opening").isNotNull() & (F.col("opening.at") < begin), F.array("opening")).otherwise(F.array().cast("array<struct<at:bigint,role:string,text:string>>"))

    def piece(kind: str):
        def make(t: Column) -> Column:
            before, text = F.concat(F.lit(START), escaped(t["role"]), F.lit(TEXT)), escaped(t["text"])
            return F.struct(t["role"].alias("role"), before.alias("before"), text.alias("body"), F.lit(kind).alias("kind"))

        return make

    pieces = opened.select("conv_id", "window", F.concat(F.transform(head, piece("system")), F.transform(recent, piece("history")), F.transform("fresh", piece("new"))).alias("p"))
    sized = pieces.withColumn("turns", F.transform("p", lambda p: F.struct(p["role"].alias("role"), F.char_length(p["before"]).alias("before"), F.char_length(p["body"]).alias("chars"), p["kind"].alias("kind"))))
    # running place of each turn: the state is the array so far and the length of what it describes
    empty = F.struct(F.array().cast("array<struct<role:string,start:int,chars:int,kind:string>>").alias("turns"), F.lit(0).alias("length"))

    def step(state: Column, t: Column) -> Column:
        start = state["length"] + t["before"]
        one = F.struct(t["role"].alias("role"), start.alias("start"), t["chars"].alias("chars"), t["kind"].alias("kind"))
        return F.struct(F.concat(state["turns"], F.array(one)).alias("turns"), (start + t["chars"] + len(END)).alias("length"))

    laid = sized.select(
        "conv_id", "window", F.array_join(F.transform("p", lambda p: F.concat(p["before"], p["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", empty, step)["turns"].alias("turns"),
    )
    loss = F.transform(F.filter("turns", lambda t: (t["kind"] == "new") & (t["role"] == "assistant")), lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars")))
    return laid.withColumn("loss", loss)


def part_of(text: Column, start: Column, chars: Column) -> Column:
    return F.substring(text, start + 1, chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and loss text of each conversation, from the windows alone.

    conv_id, turns (array of role, text in order), loss (text), formatted_chars. Each window's string
    is cut at its marks; the pieces of kind "new" are the conversation's turns.
    """
    pieces = F.split(F.col("formatted"), F.lit(r"<\|end\|>"), -1)
    cut = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    one = F.transform(
        F.filter(F.zip_with("pieces", "turns", lambda p, t: F.struct(p.alias("p"), t["kind"].alias("kind"))), lambda x: x["kind"] == "new"),
        lambda x: F.struct(
            unescaped(F.substring_index(F.replace(x["p"], F.lit(START), F.lit("")), TEXT, 1)).alias("role"), unescaped(F.substring_index(x["p"], TEXT, -1)).alias("text")
        ),
    )
    trained = F.array_join(F.transform("loss", lambda m: unescaped(part_of(F.col("formatted"), m["start"], m["chars"]))), "")
    read = cut.select("conv_id", "window", one.alias("turns"), trained.alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select(
        "conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.transform("w", lambda x: x["loss"]), "").alias("loss"), "formatted_chars"
    )

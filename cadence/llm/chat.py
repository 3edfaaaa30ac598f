"""Operator 9: transcript parsing by a hidden Markov model, and canonical turn rendering.

A raw transcript is lines of text (conversation, order, line), some with a speaker marker ("User:", "### Assistant",
"[System]"), many without. Each line shows a symbol: the role its marker names (or none) and line features (first after a
break, question mark, length class). Hidden states are (role, turn start or continuation). Transitions and emissions are
counts over labelled conversations with additive smoothing, gathered by one aggregate each (at most states x
symbols rows reach the driver).

Viterbi runs over conversations of any length: lines are cut into chunks of ``CHUNK`` consecutive orders, or of ``CHUNK_LINES`` lines
where a block is longer. Since
the recursion is a product of max-plus matrices, (1) every chunk reduces to a states x states matrix (only for conversations of more than one chunk), (2) the matrices of a
conversation, one small row a chunk, fix the states at its chunk borders, (3) every chunk is decoded alone between
its borders. Chunks of many conversations are decoded side by side in numpy. A conversation that holds a third of all lines is
many chunks in many tasks.

Turns start at decoded start states; their lines lose the marker and are joined by newlines, and ``rendered`` is the canonical
form. Edge cases: NULL or empty text is one empty line (symbol of an unmarked short line); NULL conversation ids form one
conversation; repeated lines stay in order (ties by text); of equally likely
paths any one is taken; an empty table gives no turns; with no
labelled lines, uniform counts are used. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import written
from cadence.session import shuffle_partitions

ROLES = ("system", "user", "assistant")
STATES = len(ROLES) * 2      # role * 2 + (0 start, 1 continuation)
MARKS = len(ROLES) + 1       # the role a marker names, or none
FEATURES = 8                 # first after a break, question mark, long line
SYMBOLS = MARKS * FEATURES
CHUNK = 4096                 # orders per chunk
CHUNK_LINES = 20_000         # lines of one block per chunk
ROWS_PER_GROUP = 200_000
SMOOTH = 0.5
LONG_LINE = 60

# fixed values: speaker markers
MARKER = r"^\s*(?:#{1,4}\s*|\[|<\|?|\*\*)?(system|user|human|assistant|bot|ai)(?:\]|\|?>|\*\*)?\s*(?::|$|(?<=[\]>*]))\s*"
NAMES = {"system": "system", "user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "ai": "assistant"}
TEMPLATE = ("<|", "|>\n", "\n<|end|>")


def marker_role(line: Column) -> Column:
    name = F.lower(F.regexp_extract(line, "(?i)" + MARKER, 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.when(name == "", None).otherwise(name)], F.lit("none"))


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, "(?i)" + MARKER, "")


def symbol(line: Column, first: Column) -> Column:
    """Number of the symbol a line shows."""
    mark = F.array_position(F.array(*[F.lit(r) for r in ROLES]), marker_role(line))  # 0: none
    bits = F.when(first, 4).otherwise(0) + F.when(F.contains(line, F.lit("?")), 2).otherwise(0) + F.when(F.length(line) > LONG_LINE, 1).otherwise(0)
    return (mark * FEATURES + bits).cast("int")


def lines_of(messages: DataFrame, conv: str, order: str, text: str, *carried: str) -> DataFrame:
    """(conv, c, ord, line_no, line) and the carried columns: the lines of every text block; c is conv, never NULL."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    conv_col = F.col(f"`{conv}`")
    return messages.select(conv_col.alias("conv"), F.coalesce(F.concat(F.lit("c"), conv_col.cast("string")), F.lit("n")).alias("c"),
                           F.coalesce(F.col(f"`{order}`").cast("long"), F.lit(0)).alias("ord"), *[F.col(f"`{x}`") for x in carried],
                           F.posexplode(F.split(body, "\n")).alias("line_no", "line"))


def _seen(lines: DataFrame) -> DataFrame:
    return lines.withColumn("sym", symbol(F.col("line"), F.col("line_no") == 0))


def _chunked(seen: DataFrame) -> DataFrame:
    """``chunk``: numbers that rise with (ord, line_no). ``CHUNK`` orders are one, unless a block among them has more than ``CHUNK_LINES`` lines: then each
    order is cut after every ``CHUNK_LINES`` lines."""
    rows = seen.withColumn("_g", F.floor(F.col("ord") / CHUNK))
    long = rows.where(F.col("line_no") == CHUNK_LINES).select("c", "_g").distinct().withColumn("_long", F.lit(True))   # has a line beyond the first CHUNK_LINES
    base = F.col("_g") * (1 << 40)
    own = base + (F.col("ord") - F.col("_g") * CHUNK) * (1 << 24) + F.floor(F.col("line_no") / CHUNK_LINES)
    return rows.join(long, ["c", "_g"], "left").withColumn("chunk", F.when(F.col("_long"), own).otherwise(base)).drop("_g", "_long")


class Model:
    """Log probabilities: enter (states + 1 x states; the last row is the start of a conversation), shows (states x symbols)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, shows: np.ndarray) -> None:
        norm = lambda c: np.log((c + SMOOTH) / (c + SMOOTH).sum(axis=1, keepdims=True))
        self.enter, self.shows = norm(np.vstack([step, start])), norm(shows)
        self.step = self.enter[:STATES]


def learn(labelled: DataFrame) -> Model:
    """Counts from lines (c, ord, line_no, line, role); a block's first line is its turn's start."""
    number = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")) - 1
    rows = _seen(labelled).withColumn("r", number).where("r >= 0")
    shows = np.zeros((STATES, SYMBOLS))
    for x in rows.groupBy((F.col("r") * 2 + (F.col("line_no") > 0).cast("int")).alias("state"), "sym").count().collect():  # states x symbols
        shows[x["state"], x["sym"]] = x["count"]
    start, step = np.zeros(STATES), np.zeros((STATES, STATES))
    # steps inside a block follow from its number of lines; steps between blocks join neighbouring orders
    blocks = rows.groupBy("c", "ord").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r"))
    follow = blocks.select("c", (F.col("ord") - 1).alias("ord"), F.col("r").alias("next"))
    pairs = blocks.join(follow, ["c", "ord"], "left").groupBy("r", "next").agg(
        F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum((F.col("n") > 1).cast("long")).alias("many"))
    for x in pairs.collect():  # roles x (roles + 1)
        a = 2 * x["r"]
        step[a, a + 1] += x["many"]
        step[a + 1, a + 1] += x["n"] - x["c"] - x["many"]
        if x["next"] is not None:
            step[a, 2 * x["next"]] += x["c"] - x["many"]
            step[a + 1, 2 * x["next"]] += x["many"]
    for x in blocks.groupBy("c").agg(F.min_by("r", "ord").alias("r")).groupBy("r").count().collect():  # roles
        start[2 * x["r"]] += x["count"]
    return Model(start, step, shows)


def _sequences(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order, first row and length of each (c, chunk), and the sequences by falling length."""
    pdf = pdf.sort_values(["c", "chunk", "ord", "line_no", "line"], kind="stable").reset_index(drop=True)
    first = np.flatnonzero(pdf[["c", "chunk"]].ne(pdf[["c", "chunk"]].shift()).any(axis=1).to_numpy())
    size = np.diff(np.append(first, len(pdf)))
    return pdf, first, size, np.argsort(-size, kind="stable")


def _live(order: np.ndarray, size: np.ndarray, t: int) -> np.ndarray:
    """Sequences longer than ``t``."""
    return order[:np.searchsorted(-size[order], -t, side="left")]


def _matrices(pdf: pd.DataFrame, model: Model) -> pd.DataFrame:
    """One max-plus matrix per (c, chunk): best score from the state before its first line to the state of its last."""
    pdf, first, size, order = _sequences(pdf)
    sym = pdf["sym"].to_numpy(np.int64)
    best = np.empty((len(first), STATES + 1, STATES))
    for t in range(int(size.max())):
        live = _live(order, size, t)
        shown = model.shows[:, sym[first[live] + t]].T[:, None, :]
        step = model.enter[None] if t == 0 else (best[live][:, :, :, None] + model.step[None, None]).max(axis=2)
        best[live] = step + shown
    head = pdf.iloc[first]
    return pd.DataFrame({"c": head["c"].to_numpy(), "chunk": head["chunk"].to_numpy(), "matrix": [m.tobytes() for m in best]})


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before (``STATES``: the start) and at the end of every chunk of one conversation."""
    pdf = pdf.sort_values("chunk", kind="stable")
    mats = [np.frombuffer(m, np.float64).reshape(STATES + 1, STATES) for m in pdf["matrix"]]
    score, back = mats[0][STATES], []
    for m in mats[1:]:
        value = score[:, None] + m[:STATES]
        back.append(value.argmax(axis=0))
        score = value.max(axis=0)
    leave = [int(score.argmax())]
    for b in reversed(back):
        leave.append(int(b[leave[-1]]))
    leave.reverse()
    return pd.DataFrame({"c": pdf["c"], "chunk": pdf["chunk"], "enter": [STATES, *leave[:-1]], "leave": leave})


def _decode(pdf: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Most likely state of every line between the states at its chunk's borders, and starts so far in the chunk."""
    pdf, first, size, order = _sequences(pdf)
    sym = pdf["sym"].to_numpy(np.int64)
    enter, leave = (pdf[x].to_numpy(np.int64)[first] for x in ("enter", "leave"))
    score = np.empty((len(first), STATES))
    back = np.zeros((len(pdf), STATES), np.int8)
    for t in range(int(size.max())):
        live = _live(order, size, t)
        at = first[live] + t
        shown = model.shows[:, sym[at]].T
        if t == 0:
            score[live] = model.enter[enter[live]] + shown
        else:
            value = score[live][:, :, None] + model.step[None]
            back[at] = value.argmax(axis=1)
            score[live] = value.max(axis=1) + shown
    state = np.empty(len(pdf), np.int64)
    now = np.where(leave < 0, score.argmax(axis=1), leave)
    for t in range(int(size.max()) - 1, -1, -1):
        live = _live(order, size, t)
        at = first[live] + t
        state[at] = now[live]
        now[live] = back[at, now[live]]
    starts = np.cumsum(state % 2 == 0)
    return pdf.assign(state=state, local=starts - np.repeat(starts[first] - (state[first] % 2 == 0), size))[["conv", "c", "ord", "line_no", "line", "chunk", "state", "local"]]


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """lines (conv, c, ord, line_no, line) with their Viterbi state and the turn they belong to."""
    spark = lines.sparkSession
    conv = lines.schema["conv"].dataType.simpleString()
    rows = written(_chunked(_seen(lines)).select("conv", "c", "ord", "line_no", "line", "sym", "chunk"), "op9-lines")
    groups = max(shuffle_partitions(spark), -(-rows.count() // ROWS_PER_GROUP))
    part = F.pmod(F.hash("c", "chunk"), F.lit(groups))
    spread = rows.groupBy("c").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low < high").select("c")
    long = rows.join(spread, "c", "left_semi").select("c", "ord", "line_no", "line", "chunk", "sym", part.alias("part"))
    matrices = long.groupBy("part").applyInPandas(lambda p: _matrices(p, model), "c string, chunk long, matrix binary")
    borders = matrices.groupBy("c").applyInPandas(_borders, "c string, chunk long, enter int, leave int")
    known = rows.join(borders, ["c", "chunk"], "left").select(
        "conv", "c", "ord", "line_no", "line", "sym", "chunk", F.coalesce("enter", F.lit(STATES)).alias("enter"), F.coalesce("leave", F.lit(-1)).alias("leave"), part.alias("part"))
    decoded = written(known.groupBy("part").applyInPandas(
        lambda p: _decode(p, model), f"conv {conv}, c string, ord long, line_no int, line string, chunk long, state int, local long"), "op9-decoded")
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = decoded.groupBy("c", "chunk").agg(F.max("local").alias("n")).select("c", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return decoded.join(offsets, ["c", "chunk"]).select("conv", "c", "ord", "line_no", "line", "state",
                                                        F.greatest(F.col("base") + F.col("local") - 1, F.lit(0)).alias("turn"))


def turns(decoded: DataFrame) -> DataFrame:
    """conv, turn, role, text, n_lines, rendered: one row per recovered turn."""
    clean = F.when(F.col("state") % 2 == 0, without_marker(F.col("line"))).otherwise(F.col("line"))
    rows = decoded.select("conv", "c", "turn", F.struct("ord", "line_no", clean.alias("line"), "state").alias("x"))
    got = rows.groupBy("conv", "c", "turn").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("xs")[0]["state"] / 2) + 1).cast("int"))
    text = F.regexp_replace(F.array_join(F.transform("xs", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    out = got.select("conv", "turn", role.alias("role"), text.alias("text"), F.size("xs").alias("n_lines"))
    return out.withColumn("rendered", F.concat(F.lit(TEMPLATE[0]), "role", F.lit(TEMPLATE[1]), "text", F.lit(TEMPLATE[2])))


# ---- raw transcripts derived from labelled conversations ---------------------------------------------

STYLES = (("System: ", "User: ", "Assistant: "), ("[system] ", "Human: ", "AI: "), ("### System:\n", "### Human:\n", "### Assistant:\n"))


def _number(*parts: str) -> Column:
    return F.conv(F.substring(F.md5(F.encode(F.concat_ws("|", *[F.coalesce(F.col(p).cast("string"), F.lit("null")) if not p.startswith("=") else F.lit(p[1:]) for p in parts]), "UTF-8")), 1, 7), 16, 10).cast("int")


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): two turns in three get a speaker marker in their conversation's style, by md5."""
    style = F.pmod(_number("=style", "conv_id"), F.lit(len(STYLES)))
    role = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce("role", F.lit("")))
    table = F.array(*[F.array(*[F.lit(x) for x in s]) for s in STYLES])
    marker = F.when((role > 0) & (F.pmod(_number("=mark", "conv_id", "turn"), F.lit(3)) != 0),
                    F.element_at(F.element_at(table, (style + 1).cast("int")), F.greatest(role, F.lit(1)).cast("int"))).otherwise("")
    return conversations.select("conv_id", "turn", "role", F.concat(marker, F.coalesce("text", F.lit(""))).alias("text"))


def held_out(conv: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(conv.cast("string"), F.lit("")), "UTF-8")), F.lit(3)) == 1


def recovered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_lines, rendered, held_out: turns recovered from the raw transcripts of all conversations, by
    a model learned from the labelled ones outside the held-out fold."""
    lines = lines_of(raw_transcripts(conversations), "conv_id", "turn", "text", "role")
    model = learn(lines.where(~held_out(F.col("conv"))))
    out = turns(decode(lines, model))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "text", "n_lines", "rendered", held_out(F.col("conv")).alias("held_out"))

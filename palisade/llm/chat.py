"""Chat formatting from an event log: fold deltas, edits and regenerations into final messages, then render them.

An event belongs to a message (conversation, turn, nth) and has a sequence number. Pieces of a message are appended in
sequence; some events begin a new version of it, and some of those also cut off everything that had been said after it:

    kind         text is                      earlier pieces of the message   later messages so far
    delta        the next piece               stay                            stay
    amend        the whole text               go                              stay
    delete       ignored                      go                              stay
    edit         the whole text               go                              go
    regenerate   the first piece, if any      go                              go

The fold needs no loop: a piece lives if no event that begins a version of its message came later, and no event that
cuts off came later on an earlier message, which is a running maximum over the messages of a conversation. A conversation
is cut into blocks of TURNS turns, so one that holds a large part of all rows is folded and rendered by many tasks; only
its finished blocks meet in one row. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGINS, CUTS = ("amend", "delete", "edit", "regenerate"), ("edit", "regenerate")
#: Turns of a conversation that are folded together.
TURNS = 256
SPANS = "array<struct<turn:int,start:bigint,length:bigint,within:bigint>>"
START, SEP, END = "<|im_start|>", "<|im_sep|>\n", "<|im_end|>\n"
#: Control strings of this template and of others: "<" or "[" and one of these. Any "<|" counts. (Fixed values.)
AFTER_ANGLE = (r"\|", "s>", "/s>", "SYS>>", "/SYS>>", "start_of_turn>", "end_of_turn>", "bos>", "eos>", "pad>", "unk>")
AFTER_BRACKET = (r"INST\]", r"/INST\]")


def _each(text: Column, marks: str, put: str) -> Column:
    """`text` with the backslashes inside control strings (matched by `marks`) replaced by `put`."""
    for first, rest in (("<", AFTER_ANGLE), (r"\[", AFTER_BRACKET)):
        text = F.regexp_replace(text, f"({first}){marks}({'|'.join(rest)})", put)
    return text


def escape(text: Column) -> Column:
    """No control string is left: each gets a backslash after its first character, one more if it has some there already.
    Everything else stays as it is."""
    return _each(text, r"(\\*)", r"$1$2\\$3")


def unescape(text: Column) -> Column:
    """The inverse of escape() on its results."""
    return _each(text, r"\\(\\*)", r"$1$2$3")


def _joined(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, turn, nth, role, text), one row a message that is left, from events (conv_id, turn long, nth, seq, kind,
    role, text); seq is of any type that can be ordered, equal ones of a message are taken by kind, role and text.

    An event delivered more than once counts once; kinds that are not listed above are ignored. A null text is empty; the
    role is that of the last living event with one, else empty. A null conversation, turn, nth or seq is a value of its
    own that comes first. Other columns are not carried along. A message whose last version is a delete without later
    pieces is gone, and so is one whose pieces are all cut off; no events give no messages.
    """
    kinds = ("delta", *BEGINS)
    e = events.where(F.col("kind").isin(*kinds)).select("conv_id", F.floor(F.col("turn") / TURNS).alias("block"), "turn", "nth", F.struct("seq").alias("seq"), "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    cut = F.max(F.when(F.col("kind").isin(*CUTS), F.col("seq")))
    # one row a block: what cuts off from an earlier block of the conversation
    blocks = e.groupBy("conv_id", "block").agg(cut.alias("cut"))
    before = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("cut").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))
    before = before.where(F.col("earlier").isNotNull())
    m = e.repartition("conv_id", "block").groupBy("conv_id", "block", "turn", "nth").agg(
        F.max(F.when(F.col("kind").isin(*BEGINS), F.col("seq"))).alias("begun"), cut.alias("cut"), F.sort_array(F.collect_set(F.struct("seq", "kind", "role", "text"))).alias("pieces"))
    m = m.withColumn("cut", F.max("cut").over(W.partitionBy("conv_id", "block").orderBy("turn", "nth")))
    m = m.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    since = F.greatest("begun", "cut", "earlier")
    m = m.withColumn("pieces", F.filter("pieces", lambda p: (since.isNull() | (p["seq"] >= since)) & (p["kind"] != "delete"))).where(F.size("pieces") > 0)
    role = F.element_at(F.filter("pieces", lambda p: p["role"].isNotNull()), -1)["role"]
    role = F.when(F.exists("pieces", lambda p: p["role"].isNotNull()), role).otherwise("")
    return m.select("conv_id", "turn", "nth", role.alias("role"), _joined(F.transform("pieces", lambda p: p["text"])).alias("text"))


def render(messages: DataFrame, loss_roles: Iterable[str] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation. messages: conv_id, turn, nth, role, text.

    Turns stand in the order of turn and nth (nulls first; equal ones by role and text, all of them kept), each between
    the template's marks; control strings inside a role or a text are escaped. A null role or text is empty. `loss` is
    the loss mask: an array of (turn, start, length, within), the place of the turn and the code points of `formatted`
    (and of the turn's own part of it) that hold the text of a turn whose role is in loss_roles. An empty one has length 0.
    A conversation is one string, so it must be below Spark's 2 GB for a cell.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    m = messages.select("conv_id", F.floor(F.col("turn") / TURNS).alias("block"), "turn", "nth", role.alias("role"), escape(text).alias("text"))
    m = m.withColumns({"learned": F.col("role").isin(*loss_roles), "role": escape(F.col("role"))})
    head = F.concat(F.lit(START), "role", F.lit(SEP))
    m = m.withColumns({"part": F.concat(head, "text", F.lit(END)), "within": F.length(head).cast("long")}).repartition("conv_id", "block")
    w = W.partitionBy("conv_id", "block").orderBy("turn", "nth", "role", "text")
    m = m.withColumns({"at": F.row_number().over(w), "before": F.sum(F.length("part").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.length("part")})
    span = F.struct((F.col("at") - 1).alias("turn"), (F.col("before") + F.col("within")).alias("start"), F.length("text").cast("long").alias("length"), "within")
    b = m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"), F.sort_array(F.collect_list(F.when(F.col("learned"), span))).alias("loss"), F.count("*").cast("int").alias("turns"))
    b = b.select("conv_id", "block", _joined(F.transform("parts", lambda p: p["part"])).alias("formatted"), "loss", "turns")
    whole = b.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "formatted", "loss", "turns"))).alias("blocks"))
    zero = F.struct(F.lit(0).alias("turns"), F.lit(0).cast("long").alias("chars"), F.array().cast(SPANS).alias("loss"))
    moved = lambda to, x: F.transform(x["loss"], lambda s: F.struct((s["turn"] + to["turns"]).alias("turn"), (s["start"] + to["chars"]).alias("start"), s["length"].alias("length"), s["within"].alias("within")))
    step = lambda to, x: F.struct((to["turns"] + x["turns"]).alias("turns"), (to["chars"] + F.length(x["formatted"])).alias("chars"), F.concat(to["loss"], moved(to, x)).alias("loss"))
    return whole.select("conv_id", _joined(F.transform("blocks", lambda x: x["formatted"])).alias("formatted"), F.aggregate("blocks", zero, step, lambda x: x["loss"]).alias("loss"))


def parts(formatted: Column) -> Column:
    """The turns of a formatted conversation as they stand there, each without the mark that begins it."""
    return F.filter(F.split(formatted, START.replace("|", r"\|")), lambda p, i: i > 0)


def parse(parts_: Column) -> Column:
    """The turns that parts() gives, read back: array of (role, text)."""
    def turn(p: Column) -> Column:
        at = F.instr(p, F.lit(SEP))
        text = F.substring(p, at + len(SEP), F.length(p) - at - len(SEP) + 1 - len(END))
        return F.struct(unescape(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts_, turn)


def learned(parts_: Column, loss: Column) -> Column:
    """What stands under the loss mask, unescaped: array of texts. parts_: a column of what parts() gives (not the
    expression itself, which would be evaluated once a turn)."""
    return F.transform(loss, lambda s: unescape(F.substring(F.element_at(parts_, s["turn"] + 1), (s["within"] + 1 - len(START)).cast("int"), s["length"].cast("int"))))


def digest(rendered: DataFrame) -> DataFrame:
    """Numbers and SHA-256 digests of what can be read back from render()'s rows."""
    d = rendered.select("conv_id", "loss", parts(F.col("formatted")).alias("parts"), F.length("formatted").cast("long").alias("formatted_chars"))
    d = d.select("conv_id", "formatted_chars", parse(F.col("parts")).alias("turns"), _joined(learned(F.col("parts"), F.col("loss"))).alias("learned"))
    said = _joined(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return d.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                    F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def as_log(conversations: DataFrame, piece: int = 64, pieces: int = 16) -> DataFrame:
    """Events of rows (conv_id, turn, role, text) as a chat service might have logged them; reconstruct() gives the rows
    back. Texts are streamed in pieces of `piece` code points, or longer ones, `pieces` at most. By a hash of the row, a turn is answered by something else
    first and then edited, is written anew from the start, or is amended; rows that are equal in turn are told apart by nth.
    """
    block = F.floor(F.col("turn") / TURNS)
    d = conversations.select("conv_id", block.alias("block"), "turn", "role", F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id", "block")
    d = d.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "block", "turn").orderBy("role", "text")))
    h = F.pmod(F.xxhash64("conv_id", "turn", "nth"), F.lit(8))

    def event(step: int, kind: str, text: Column, turn: Column | None = None, role: Column | None = None) -> Column:
        return F.struct((F.col("turn") if turn is None else turn).alias("turn"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), (F.col("role") if role is None else role).alias("role"), text.alias("text"))

    long = F.greatest(F.lit(piece), F.ceil(F.length("text") / pieces)).cast("int")
    last = F.greatest(F.ceil(F.length("text") / long) - 1, F.lit(0)).cast("int")
    deltas = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.col("turn").alias("turn"), (i + 10).alias("step"), F.lit("delta").alias("kind"), F.col("role").alias("role"), F.substring(F.col("text"), i * long + 1, long).alias("text")))
    first = F.substring("text", 1, 12)
    answered = F.array(event(0, "delta", first), event(1, "delta", F.lit("withdrawn"), F.col("turn") + 1, F.lit("assistant")), event(2, "edit", F.lit("")))
    anew = F.array(event(0, "delta", F.concat(first, F.lit("..."))), event(2, "regenerate", F.lit(None).cast("string")))
    amended = F.array(event(0, "delta", F.lit("draft")), event(1, "delete", F.lit(None).cast("string")), event(2, "amend", F.lit("")))
    none = F.array().cast("array<struct<turn:bigint,step:int,kind:string,role:string,text:string>>")
    log = F.concat(F.when(h == 0, answered).when(h == 1, anew).when(h == 2, amended).otherwise(none), deltas)
    e = d.select("conv_id", F.col("turn").alias("own"), "nth", F.explode(log).alias("e"))
    return e.select("conv_id", "e.turn", "nth", F.struct("own", "nth", "e.step").alias("seq"), "e.kind", "e.role", "e.text")

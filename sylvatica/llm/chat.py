"""Chat formatting in budgeted windows, with DataFrame functions alone.

Prefix sums of turn tokens place every turn of a conversation; spans of turns between multiples of the body
become windows, and a turn that crosses a multiple is a window alone, so no turn of a span is ever cut and no
span of several turns exceeds the body.  A window repeats the system turn (SYSTEM tokens at most: of a longer one
the beginning) and the last turns before its span (HISTORY tokens and HISTORY_TURNS at most, all from the window
before).  The body is what BUDGET leaves when the window's own marks, HISTORY and the conversation's repeated
system turn are taken off, so a window as it is written, marks and escapes included, stays within BUDGET unless
a single turn is longer than the body.  Tokens are an estimate, bytes of the written turn over BYTES_PER_TOKEN.
Repeated turns carry no loss; each assistant turn is under the loss mask once, in the window whose span holds it.

The template is ``<s>`` turns ``</s>``; a turn is ``[ANS role]text[/ANS]`` for the assistant and
``[INST role]text[/INST]`` for any other role.  Inside texts a backslash is doubled and the marks ``<s>``,
``</s>``, ``[INST``, ``[/INST``, ``[ANS`` and ``[/ANS`` get a backslash after their first character, which no
text can hold otherwise, so reading back is exact.  Roles are URL-encoded.

The prefix sums are taken in two steps, within runs of RUN turn numbers and over the runs' totals, so that a
conversation with a large part of all rows is spread over tasks, but for rows that share a turn number; windows are bounded by the
budget.  Only ``conversation_digests``, whose result is a hash of a whole conversation, brings one together.

Defined cases: a null text or role counts as empty; rows are ordered by turn (null first), then role and
text, so repeated rows are turns of their own; rows without a conv_id are one conversation, whose id is
null; an empty text is an empty turn; a turn longer than the body is a window alone, whole however long; the first
system turn is the one repeated; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1536
SYSTEM = 256
HISTORY = 256
HISTORY_TURNS = 2
RUN = 256
#: Bytes of a written turn that make a token.
BYTES_PER_TOKEN = 4
START, END = "<s>", "</s>"
MARKS = r"([\[<])(/?(?:INST|ANS)|/?s>)"
TURN = r"\[(INST|ANS) ([^\]]*)\]([\s\S]*?)\[/\1\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), MARKS, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def tokens(written: Column) -> Column:
    """An estimate that needs no tokenizer: bytes over BYTES_PER_TOKEN, rounded up."""
    return F.ceil(F.octet_length(written) / F.lit(BYTES_PER_TOKEN)).cast("long")


def _kind(role: Column) -> Column:
    return F.when(role == "assistant", "ANS").otherwise("INST")


def _opening(role: Column) -> Column:
    return F.concat(F.lit("["), _kind(role), F.lit(" "), F.url_encode(role), F.lit("]"))


def _closing(role: Column) -> Column:
    return F.concat(F.lit("[/"), _kind(role), F.lit("]"))


def _turn_tokens(role: Column, text: Column) -> Column:
    return tokens(F.concat(_opening(role), escape(text), _closing(role)))


def _cut(role: Column, text: Column, most: int) -> Column:
    """The beginning of ``text`` with which a turn has ``most`` tokens at most; the whole of it if that fits."""
    room = F.greatest(F.lit(0), F.lit(most * BYTES_PER_TOKEN) - F.octet_length(_opening(role)) - F.octet_length(_closing(role)))
    plain = F.left(text, room)  # enough if no character of it takes more than a byte
    return F.when(_turn_tokens(role, text) <= most, text).when(F.octet_length(escape(plain)) <= room, plain).otherwise(F.left(text, F.floor(room / 8).cast("int")))


def _placed(conversations: DataFrame, budget: int, history: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns with ``start`` and ``stop``, the tokens of their conversation before and after them, and the ``body`` of
    its windows; and the turn that each conversation's windows repeat (cid, role, text)."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("cid"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    turns = turns.withColumns({"n": _turn_tokens(F.col("role"), F.col("text")), "run": F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62)))})
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text"))
    system = turns.where(F.col("role") == "system").groupBy("cid").agg(F.min(place).alias("place"))
    system = system.select("cid", F.col("place.role").alias("role"), _cut(F.col("place.role"), F.col("place.text"), most).alias("text"))
    earlier = (Window.unboundedPreceding, -1)
    totals = turns.groupBy("cid", "run").agg(F.sum("n").alias("total"))
    before = Window.partitionBy("cid").orderBy("run").rowsBetween(*earlier)
    offsets = totals.select("cid", "run", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    taken = system.select("cid", _turn_tokens(F.col("role"), F.col("text")).alias("taken"))
    body = F.lit(budget - history - 2) - F.coalesce("taken", F.lit(0))  # two tokens for the marks of the window itself
    offsets = offsets.join(taken, "cid", "left").select("cid", "run", "offset", body.alias("body"))
    within = Window.partitionBy("cid", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(*earlier)
    inner = turns.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    start = F.col("offset") + F.col("inner")
    placed = inner.join(offsets, ["cid", "run"]).select("conv_id", "cid", "role", "text", start.alias("start"), (start + F.col("n")).alias("stop"), "body")
    return placed, system


def _loss_spans(parts: Column) -> Column:
    """(start, length), 1-based in code points, of the new assistant texts of a window."""
    begin = F.struct(F.lit(len(START) + 1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        span = F.struct((state["at"] + part["head"]).cast("int").alias("start"), part["body"].alias("length"))
        spans = F.when(part["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + part["head"] + part["body"] + part["tail"]).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(parts, begin, step, lambda state: state["spans"])


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, system: int = SYSTEM) -> DataFrame:
    """conv_id, window, formatted, loss (spans), n_repeated (turns before the span) and n_new of every window."""
    if budget < history + system + 3:
        raise ValueError("the budget leaves no room for a turn")
    turns, repeated_system = _placed(conversations, budget, history, system)
    bucket = F.floor(F.col("start") / F.col("body"))
    crosses = F.col("stop") > (bucket + 1) * F.col("body")
    turns = turns.withColumn("window", (2 * bucket + crosses.cast("long")).cast("long"))
    span = Window.partitionBy("cid", "window")
    ended = turns.withColumns({"ends": F.max("stop").over(span), "nth": F.row_number().over(span.orderBy(F.col("start").desc()))})
    own = ended.select("conv_id", "cid", "window", F.struct("start", F.lit(True).alias("new"), "ends", "role", "text").alias("item"))
    recent = ended.where((F.col("start") >= F.col("ends") - history) & (F.col("nth") <= history_turns) & (F.col("role") != "system"))
    # the next window begins where this one ends: alone in its bucket's span or as the turn that crosses it
    after = F.floor(F.col("ends") / F.col("body"))
    recent = recent.withColumn("to", F.explode(F.array(2 * after, 2 * after + 1)))
    recent = recent.where(F.col("to") != F.col("window"))
    repeated = recent.select("conv_id", "cid", F.col("to").alias("window"), F.struct("start", F.lit(False).alias("new"), "ends", "role", "text").alias("item"))
    grouped = own.unionByName(repeated).groupBy("conv_id", "cid", "window").agg(
        F.sort_array(F.collect_list("item")).alias("items"), F.min(F.when(F.col("item.new"), F.col("item.start"))).alias("begins")
    )
    grouped = grouped.where(F.col("begins").isNotNull())
    told = F.struct(F.col("role").alias("role"), F.col("text").alias("text"))
    first = turns.where(F.col("role") == "system").groupBy("cid").agg(F.min("start").alias("system_start"))
    joined = grouped.join(repeated_system.select("cid", told.alias("system")).join(first, "cid"), "cid", "left")
    fields = lambda x, new: F.struct(x["role"].alias("role"), x["text"].alias("text"), F.lit(new).alias("new"))
    head = F.when(F.col("system_start") < F.col("begins"), F.array(fields(F.col("system"), False))).otherwise(F.array().cast("array<struct<role:string,text:string,new:boolean>>"))
    past = F.transform(F.filter("items", lambda x: ~x["new"] & (x["ends"] == F.col("begins"))), lambda x: fields(x, False))
    new = F.transform(F.filter("items", lambda x: x["new"]), lambda x: fields(x, True))
    joined = joined.select("conv_id", "window", F.concat(head, past).alias("repeated"), new.alias("own"))

    def render(x: Column) -> Column:
        text, opening, closing = escape(x["text"]), _opening(x["role"]), _closing(x["role"])
        return F.struct(
            F.concat(opening, text, closing).alias("text"), F.char_length(opening).alias("head"), F.char_length(text).alias("body"),
            F.char_length(closing).alias("tail"), (x["new"] & (x["role"] == "assistant")).alias("loss"),
        )

    parts = joined.select("conv_id", "window", F.size("repeated").alias("n_repeated"), F.size("own").alias("n_new"), F.transform(F.concat("repeated", "own"), render).alias("parts"))
    formatted = F.concat(F.lit(START), F.array_join(F.transform("parts", lambda p: p["text"]), ""), F.lit(END))
    return parts.select("conv_id", "window", formatted.alias("formatted"), _loss_spans(F.col("parts")).alias("loss"), "n_repeated", "n_new")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the span's own turns) and loss_texts, from ``formatted`` alone."""
    roles = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(2))
    texts = F.regexp_extract_all("formatted", F.lit(TURN), F.lit(3))
    turns = F.zip_with(roles, texts, lambda r, t: F.struct(F.url_decode(r).alias("role"), unescape(t).alias("text")))
    own = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.size(turns) - F.col("n_repeated"), F.lit(0)))
    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"])))
    return formatted.select("conv_id", "window", own.alias("turns"), loss.alias("loss_texts"), F.char_length("formatted").alias("chars"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turn count, digests of all turns and of all text under
    the loss mask, and the length of all windows.  The digests are of whole conversations, in order."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by_window = back.select("conv_id", "chars", F.struct("window", told.alias("told"), F.array_join("loss_texts", "").alias("loss"), F.size("turns").alias("n")).alias("w"))
    whole = by_window.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("ws", lambda w: w["loss"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + w["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.transform("ws", lambda w: w["told"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.size("ws").alias("n_windows"),
    )

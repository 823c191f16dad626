"""Chat formatting by quotation linking: nested quote levels are parsed, normalised quoted passages are hashed and joined
to the earlier messages that said them, and each conversation is laid out in reply order without its quotes.

A message's lines carry as many quote levels as they have leading ``>`` marks. Runs of lines of one level are a passage:
its lines are joined (so that re-wrapped quotes still match), case and blanks are folded, and it is cut into sentences.
Own text (level 0) gives the sentences that a message can be quoted for; level 1 gives those that it quotes. Deeper levels
are quotes of quotes; they name the reply's ancestors, not its parent, and are used only if level 1 finds nothing.

The parent of a message is the earlier message of its conversation from which it quotes most sentences (the later one of
equals), whoever said them first; without any, the turn before it; the first turn has none. A row a message is returned, numbered depth-first in
reply order, so that a conversation of any length is spread over many tasks; ``formatted`` is its part of the chat text,
and the parts in order of ``position`` are the conversation's.

Defined results. Null conversation or turn: left out of linking, parent and position null. Repeated (conversation, turn)
rows: each is kept; as a parent, the turn counts once. Null text: empty own text. A message of quotes only: empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, numbered

_MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_INTRO = re.compile(r"^.{1,200}\b(wrote|schrieb|a écrit|escribió)\s*:\s*$", re.IGNORECASE)
_SENTENCE = re.compile(r"[^.!?\n]+")
CHUNK = 4096
#: A sentence that more turns of its conversation say is not joined to each of them; see ``_votes``.
HOT = 64


def levels(text: str | None) -> list[tuple[int, str]]:
    """(quote level, line without its marks) of every line; the line that introduces a quote counts as part of it."""
    out: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        out.append((m[1].count(">"), line[m.end() :]) if m else (0, line))
    for k, (level, line) in enumerate(out[:-1]):
        if out[k + 1][0] == level + 1 and _INTRO.match(line):
            out[k] = (level + 1, "")
    return out


def sentences(lines: list[str]) -> list[str]:
    """Sentences of a passage, without case, blanks at the ends, and differences between runs of blanks."""
    return [s for part in _SENTENCE.findall(" ".join(lines).casefold()) if (s := " ".join(part.split()))]


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The own text, and (level, sentence) of the whole message, own ones with level 0."""
    own: list[str] = []
    said: list[tuple[int, str]] = []
    run: list[str] = []
    now = 0
    for level, line in [*levels(text), (-1, "")]:
        if level != now:
            said += [(now, s) for s in sentences(run)]
            run, now = [], level
        run.append(line)
        if level == 0:
            own.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), said


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, said = [], []
        for text in batch.column("text").to_pylist():
            o, ss = passages(text)
            own.append(o)
            said.append([{"level": k, "hash": hashlib.blake2b(s.encode(), digest_size=16).digest()} for k, s in dict.fromkeys(ss)])
        kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.string()), pa.array(said, kind)], names=["row", "own", "said"])


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``row`` (the input's row), conv, turn, reply_to, n_quoted, branch_depth, position, own_text and formatted."""
    scratch = Scratch(messages.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in messages.columns)).alias("row")
    schema = T.StructType([*messages.select(row).schema, *T._parse_datatype_string("own string, said array<struct<level:int,hash:binary>>")])
    parsed = messages.select(row, F.col(f"`{text_col}`").alias("text")).mapInArrow(_parsed, schema)
    parsed = scratch.keep(parsed.select(F.col("row").getField(conv_col).cast("long").alias("conv"), F.col("row").getField(turn_col).cast("long").alias("turn"), F.col("row").getField(role_col).cast("string").alias("role"), "row", "own", "said"))
    known = parsed.filter("conv IS NOT NULL AND turn IS NOT NULL")
    turns = numbered(scratch, known.select("conv", "turn").distinct(), ["conv"], ["turn"], "k")
    if known.filter("exists(said, s -> s.level > 0)").limit(1).count():
        votes = _votes(scratch, known, turns)
        quoted = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "by")).alias("best"))
        quoted = scratch.keep(quoted.select("conv", "turn", F.col("best.by").alias("by"), F.col("best.n").alias("n")))
    else:
        quoted = known.sparkSession.createDataFrame([], "conv long, turn long, by long, n long")
    before = turns.select("conv", (F.col("k") + 1).alias("k"), F.col("turn").alias("previous"))
    replies = turns.join(before, ["conv", "k"], "left").join(quoted, ["conv", "turn"], "left")
    replies = replies.select("conv", "turn", F.coalesce("by", "previous").alias("reply_to"), F.coalesce("n", F.lit(0)).alias("n_quoted"), F.coalesce(F.col("by") != F.col("previous"), F.lit(False)).alias("jumps"))
    replies = scratch.keep(replies.join(turns, ["conv", "turn"]))
    paths = _paths(scratch, replies)
    placed = replies.join(paths, ["conv", "turn"]).select("conv", "turn", "reply_to", "n_quoted", F.concat("path", F.array("turn")).alias("path"))
    placed = numbered(scratch, placed, ["conv"], ["path"], "position").select("conv", "turn", "reply_to", "n_quoted", F.size("path").alias("n_path"), "position")
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "own", F.lit("\n"))
    out = parsed.join(placed, ["conv", "turn"], "left")
    return out.select("row", "conv", "turn", "reply_to", F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.expr("n_path div 2").alias("branch_depth"), "position", F.col("own").alias("own_text"), formatted.alias("formatted"))


def _votes(scratch: Scratch, known: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, turn, level, by, n): earlier turns ``by`` that said n sentences of what ``turn`` quotes at ``level``; of the
    turns with most sentences, the latest is among them.

    Sentences of at most HOT sayers are joined to all of these. Of the others, which may be said by every turn, only the
    different sets that occur in turns are compared with the different sets that are quoted. A turn with a sentence of
    the first kind gets its number from both; of turns without, the latest one with the best set is all that can win.
    """
    each = scratch.keep(known.select("conv", "turn", F.explode("said").alias("s")).select("conv", "turn", "s.level", "s.hash").distinct())
    quotes = each.filter("level > 0")
    own = each.filter("level = 0").join(quotes.select("conv", "hash").distinct(), ["conv", "hash"], "left_semi").select("conv", "hash", F.col("turn").alias("by"))
    sayers = scratch.keep(own.groupBy("conv", "hash").agg((F.count("*") > HOT).alias("hot")))
    own, quotes = scratch.keep(own.join(sayers, ["conv", "hash"])), scratch.keep(quotes.join(sayers, ["conv", "hash"]))
    rare = quotes.filter("NOT hot").join(own.filter("NOT hot").drop("hot"), ["conv", "hash"]).filter("by < turn")
    rare = rare.groupBy("conv", "turn", "level", "by").agg(F.count("*").alias("n"))
    if not sayers.filter("hot").limit(1).count():
        return rare
    said = scratch.keep(own.filter("hot").groupBy("conv", "by").agg(F.array_sort(F.collect_set("hash")).alias("said")))
    asked = scratch.keep(quotes.filter("hot").groupBy("conv", "turn", "level").agg(F.array_sort(F.collect_set("hash")).alias("asked")))
    both = F.when(F.col("said").isNull() | F.col("asked").isNull(), 0).otherwise(F.size(F.array_intersect("said", "asked")))
    rare = rare.join(said, ["conv", "by"], "left").join(asked, ["conv", "turn", "level"], "left").select("conv", "turn", "level", "by", (F.col("n") + both).alias("n"))
    # The different sets, how many sentences two of them share, and from which turn on such a set is there.
    sets = said.groupBy("conv", "said").agg(F.min("by").alias("since")).withColumn("hash", F.explode("said"))
    wanted = asked.select("conv", "asked").distinct().withColumn("hash", F.explode("asked"))
    shared = scratch.keep(wanted.join(sets, ["conv", "hash"]).groupBy("conv", "asked", "said").agg(F.count("*").alias("n"), F.min("since").alias("since")))
    steps = shared.groupBy("conv", "asked", "n").agg(F.min("since").alias("since"))
    most = asked.join(steps, ["conv", "asked"]).filter("since < turn").groupBy("conv", "turn", "level", "asked").agg(F.max("n").alias("n"))
    options = scratch.keep(most.join(shared, ["conv", "asked", "n"]).filter("since < turn").select("conv", "turn", "level", "n", "said"))
    # The latest turn before each asking one that said exactly such a set, in chunks of turns.
    events = said.select("conv", "said", F.col("by").alias("turn"), F.col("by").alias("at"))
    events = events.union(options.select("conv", "said", "turn", F.lit(None).cast("long")).distinct())
    events = scratch.keep(events.join(turns, ["conv", "turn"]).withColumn("chunk", F.expr(f"k div {CHUNK}")))
    chunks = events.groupBy("conv", "said", "chunk").agg(F.max("at").alias("last"))
    chunks = chunks.withColumn("carried", F.max("last").over(Window.partitionBy("conv", "said").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    earlier = Window.partitionBy("conv", "said", "chunk").orderBy("k").rangeBetween(Window.unboundedPreceding, -1)
    latest = events.withColumn("before", F.max("at").over(earlier)).filter("at IS NULL").join(chunks, ["conv", "said", "chunk"])
    latest = latest.select("conv", "said", "turn", F.coalesce("before", "carried").alias("by"))
    hot = options.join(latest, ["conv", "said", "turn"]).groupBy("conv", "turn", "level", "n").agg(F.max("by").alias("by"))
    return rare.unionByName(hot)


def _paths(scratch: Scratch, replies: DataFrame) -> DataFrame:
    """Of each turn, the path of the run it is in: for each branch on the way from the root, the turn that it leaves and its first turn.

    A run is a stretch of turns that each reply to the one before; its head replies to an older turn. Sorting by path, then
    turn, is a depth-first order in which a branch comes right after the message that it answers.
    """
    head = F.when(F.col("jumps") | F.col("reply_to").isNull(), F.col("turn"))
    chunked = replies.select("conv", "turn", "reply_to", "jumps", F.expr(f"k div {CHUNK}").alias("chunk"), head.alias("h"))
    carried = chunked.groupBy("conv", "chunk").agg(F.max("h").alias("last"))
    carried = carried.withColumn("carried", F.max("last").over(Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    inside = Window.partitionBy("conv", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    runs = chunked.join(carried, ["conv", "chunk"]).select("conv", "turn", "reply_to", "jumps", F.coalesce(F.max("h").over(inside), "carried").alias("head"))
    runs = scratch.keep(runs)
    nothing = F.array().cast("array<bigint>")
    branches = runs.filter("jumps").select("conv", F.col("turn").alias("head"), F.col("reply_to").alias("leaves"))
    parents = runs.select("conv", F.col("turn").alias("leaves"), F.col("head").alias("above"))
    # Doubling: each round, a path grows by the path of the branch that it has come to, until that is a conversation's first run.
    paths = scratch.keep(branches.join(parents, ["conv", "leaves"]).select("conv", "head", "above", F.array("leaves", "head").alias("path")))
    while paths.limit(1).count():
        up = paths.select("conv", F.col("head").alias("above"), F.col("above").alias("next"), F.col("path").alias("before"))
        longer = paths.join(up, ["conv", "above"], "left")
        open_ = longer.filter("next IS NOT NULL").limit(1).count()
        paths = scratch.keep(longer.select("conv", "head", F.coalesce("next", "above").alias("above"), F.concat(F.coalesce("before", nothing), "path").alias("path")))
        if not open_:
            break
    return runs.join(paths.select("conv", "head", "path"), ["conv", "head"], "left").select("conv", "turn", F.coalesce("path", nothing).alias("path"))

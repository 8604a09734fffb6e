"""Quotation linking and reply order of conversations, in DataFrame functions only.

A line is quoted at the level of its leading ``>`` marks (blanks may stand between
them).  A passage is a longest run of lines of one level.  Passages and the own text of
messages are normalised (white space to one blank, trimmed, lower-cased) and hashed.

An original offers its whole own text, its paragraphs and its lines as units; per
conversation and hash only the earliest message is kept, by partial aggregation, so a
join finds at most one original per passage however often a line recurs.  A passage
that is no unit as a whole is linked by its lines: the message that most of them come
from, the latest of equals.  Only an earlier turn can be an original.

A message's parent is the original of its outermost linked passage (of the one with
most lines, then the latest).  In reply order a message comes after its parent and its
parent's earlier branches, and branches come by turn.  That order is found without a path
or a thread in one place: the tree is walked round as a list that enters and leaves each
message, every element knows only the next one, and pointer doubling sums what lies
behind each, so rows keep their size and the rounds number the logarithm of the longest
thread.  What is summed is the messages entered (the position) and the levels (the
depth).  Branches and threads are put in order by ``ranked``, which deals them into
ranges, so a message with a third of all replies, or a conversation with a third of all
rows, is many tasks' work.

Defined results.  Null text counts as empty.  A null conversation is a conversation of
its own; a null turn comes first and is never linked.  Rows that repeat a turn are
messages of their own, ordered by their text; equal rows get the same links and
successive positions.  Texts of any length are read whole.  Attribution lines ("... wrote:") directly above a quotation go
with it.  An empty table gives an empty result.  Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.ordering import ranked
from quillstone.sources.workspace import materialise

QUOTED = r"^[ \t]*>"
MARKS = r"^((?:[ \t]*>)+)[ \t]?"
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def own_text(text: Column) -> Column:
    """The text without quoted lines and their attributions, outer blank lines trimmed."""
    lines = F.split(text, "\r?\n")

    def own(line: Column, i: Column) -> Column:
        above = line.rlike(ATTRIBUTION) & F.coalesce(F.try_element_at(lines, (i + 2).cast("int")).rlike(QUOTED), F.lit(False))
        return ~line.rlike(QUOTED) & ~above

    kept = F.array_join(F.filter(lines, own), "\n")
    return F.when(text.rlike(r"(?m)" + QUOTED), F.regexp_replace(kept, r"^\s*\n|\s+$", "")).otherwise(text)


def messages(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, msg (hash that tells messages of one turn apart), own."""
    text = F.coalesce("text", F.lit(""))
    return conversations.select("conv_id", "turn", "role", text.alias("text"), F.sha2(F.concat_ws("\x00", "role", text), 256).alias("msg"), own_text(text).alias("own"))


def passages(quoting: DataFrame) -> DataFrame:
    """Passages of distinct quoting messages: conv_id, turn, msg, level, run, body, lines."""
    lines = quoting.select("conv_id", "turn", "msg", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line")).filter(F.col("line").rlike(QUOTED))
    marks = F.regexp_extract("line", MARKS, 1)
    lines = lines.withColumns({"level": F.length(F.translate(marks, " \t", "")), "body": F.regexp_replace("line", MARKS, "")})
    # Within a level, position less rank is the same along a run of neighbouring lines.
    order = Window.partitionBy("conv_id", "turn", "msg", "level").orderBy("pos")
    runs = lines.withColumn("run", F.col("pos") - F.row_number().over(order))
    grouped = runs.groupBy("conv_id", "turn", "msg", "level", "run").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("x"))
    lines_of = F.col("x.body")
    return grouped.select("conv_id", "turn", "msg", "level", "run", F.sha2(normalise(F.array_join(lines_of, " ")), 256).alias("whole"), F.filter(F.transform(lines_of, normalise), lambda s: s != "").alias("lines")).filter(F.size("lines") > 0)


def earliest_units(originals: DataFrame) -> DataFrame:
    """conv_id, unit (hash), first (turn, msg) of the earliest message that has the unit."""
    parts = F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n"))
    units = originals.filter("turn IS NOT NULL").select("conv_id", "turn", "msg", F.explode(F.array_distinct(F.transform(parts, normalise))).alias("unit")).filter("unit <> ''")
    return units.groupBy("conv_id", F.sha2("unit", 256).alias("unit")).agg(F.min(F.struct("turn", "msg")).alias("first"))


def linked_passages(found: DataFrame, units: DataFrame) -> DataFrame:
    """``found`` with original (turn, msg), null where there is none."""
    units = units.withColumnRenamed("conv_id", "of")
    earlier = F.expr("conv_id <=> of AND first.turn < turn")
    whole = found.join(units, earlier & (F.col("whole") == F.col("unit")), "left").drop("of", "unit").withColumnRenamed("first", "by_whole")
    whole = materialise(whole, "quote-whole")
    passage = ["conv_id", "turn", "msg", "level", "run"]
    lines = whole.filter("by_whole IS NULL").select(*passage, F.explode("lines").alias("line"))
    votes = lines.join(units, earlier & (F.sha2("line", 256) == F.col("unit"))).groupBy(*passage, "first").agg(F.count("*").alias("n"))
    by_lines = votes.groupBy(*passage).agg(F.max(F.struct("n", "first")).alias("best")).select(*[F.col(c).alias(f"p_{c}") for c in passage], F.col("best.first").alias("by_lines"))
    same = F.expr(" AND ".join(f"{c} <=> p_{c}" for c in passage))
    return whole.join(by_lines, same, "left").select(*passage, F.size("lines").alias("n_lines"), F.coalesce("by_whole", "by_lines").alias("original"))


def walk(nodes: DataFrame) -> DataFrame:
    """id, root (id), size (messages from here to the end of the walk), depth.

    ``nodes``: id, parent (id, null for a root), turn, msg, copies.
    """
    children = materialise(ranked(nodes.filter("parent IS NOT NULL"), "parent", ["turn", "msg"], F.lit(1), "rank"), "reply-ranks")
    first = children.filter("rank = 0").select(F.col("parent").alias("of"), F.col("id").alias("first"))
    following = children.select(F.col("parent").alias("of"), (F.col("rank") - 1).alias("after"), F.col("id").alias("following"))
    siblings = children.join(following, F.expr("parent = of AND rank = after"), "left").select(F.col("id").alias("sibling_of"), "following")
    own = nodes.join(first, F.col("id") == F.col("of"), "left").join(siblings, F.col("id") == F.col("sibling_of"), "left")
    enter = F.struct((F.col("id") * 2).alias("el"), F.coalesce(F.col("first") * 2, F.col("id") * 2 + 1).alias("next"), F.col("copies").alias("size"), F.lit(1).alias("level"))
    leave = F.struct((F.col("id") * 2 + 1).alias("el"), F.coalesce(F.col("following") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("size"), F.lit(-1).alias("level"))
    now = materialise(own.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*", F.col("e.el").alias("end")), "reply-walk")
    while not now.filter("next IS NOT NULL").isEmpty():
        ahead = now.select(F.col("el").alias("at"), F.col("next").alias("then"), F.col("size").alias("more"), F.col("level").alias("levels"), F.col("end").alias("last"))
        both = now.join(ahead, F.col("next") == F.col("at"), "left")
        added = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("size", "more"), ("level", "levels"))]
        now = materialise(both.select("el", F.col("then").alias("next"), *added, F.coalesce("last", "end").alias("end")), "reply-walk", replaces=now)
    # From an entrance to the end as many levels are left as were entered before it, and itself.
    return now.filter("el % 2 = 0").select((F.col("el") / 2).cast("long").alias("id"), ((F.col("end") - 1) / 2).cast("long").alias("root"), "size", (-F.col("level")).cast("long").alias("depth"))


def positions(every: DataFrame, reply: DataFrame) -> DataFrame:
    """conv_id, turn, msg of each distinct message, with position (of its first copy),
    depth and parent_turn.  ``reply``: conv_id, turn, msg, parent (turn, msg)."""
    vertices = every.groupBy("conv_id", "turn", "msg").agg(F.count("*").alias("copies"))
    linked = reply.filter("parent IS NOT NULL").select("conv_id", "turn", "msg", "parent")
    ends = linked.select("conv_id", "turn", "msg").union(linked.select("conv_id", "parent.turn", "parent.msg")).distinct()
    same = F.expr("conv_id <=> of AND turn <=> t AND msg = m")
    joined = vertices.join(ends.select(F.col("conv_id").alias("of"), F.col("turn").alias("t"), F.col("msg").alias("m"), F.lit(True).alias("linked")), same, "left").drop("of", "t", "m")
    # Numbers of this table, written before anything reads them.
    vertices = materialise(joined.withColumn("id", F.monotonically_increasing_id()), "messages")
    trees = vertices.filter("linked")
    parents = linked.select(F.col("conv_id").alias("of"), F.col("turn").alias("t"), F.col("msg").alias("m"), "parent")
    above = trees.select(F.col("conv_id").alias("of"), F.col("turn").alias("t"), F.col("msg").alias("m"), F.col("id").alias("parent"))
    nodes = trees.join(parents, same, "left").drop("of", "t", "m").withColumnRenamed("parent", "up")
    nodes = nodes.join(above, F.expr("conv_id <=> of AND up.turn <=> t AND up.msg = m"), "left").select("id", "parent", F.col("up.turn").alias("parent_turn"), "turn", "msg", "copies")
    nodes = materialise(nodes, "reply-nodes")
    walked = materialise(walk(nodes), "reply-order").join(nodes.select("id", "parent", "parent_turn"), "id")
    found = vertices.select("conv_id", "turn", "msg", "copies", "id").join(walked, "id", "left")
    found = materialise(found.withColumns({"root": F.coalesce("root", "id"), "size": F.coalesce("size", "copies"), "depth": F.coalesce("depth", F.lit(0))}), "message-order")
    tops = ranked(found.filter("parent IS NULL").select("conv_id", "turn", "msg", "id", "size"), "conv_id", ["turn", "msg"], F.col("size"), "start")
    tops = tops.select(F.col("id").alias("top"), (F.col("start") + F.col("size")).alias("stop"))
    return found.join(tops, F.col("root") == F.col("top")).select("conv_id", "turn", "msg", (F.col("stop") - F.col("size")).alias("start"), "depth", "parent_turn")


def link_quotations(conversations: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, position, parent_turn, depth, n_passages,
    n_linked, text (without quotations)."""
    every = messages(conversations)
    quoting = materialise(every.filter(F.col("text").rlike(r"(?m)" + QUOTED)).select("conv_id", "turn", "msg", "text").distinct(), "quoting")
    touched = quoting.select(F.col("conv_id").alias("of")).distinct()
    originals = every.join(touched, F.expr("conv_id <=> of"), "left_semi")
    links = materialise(linked_passages(passages(quoting), earliest_units(originals)), "quote-links")
    reply = links.groupBy("conv_id", "turn", "msg").agg(
        F.count("*").alias("n_passages"),
        F.count("original").alias("n_linked"),
        F.max(F.when(F.col("original").isNotNull(), F.struct((-F.col("level")).alias("outer"), "n_lines", F.col("original.turn").alias("turn"), F.col("original.msg").alias("msg")))).alias("best"),
    )
    reply = materialise(reply.withColumn("parent", F.when(F.col("best").isNotNull(), F.struct("best.turn", "best.msg"))), "quote-replies")

    def keyed(facts: DataFrame, *columns: str) -> DataFrame:
        return facts.select(F.col("conv_id").alias("of"), F.col("turn").alias("t"), F.col("msg").alias("m"), *columns)

    same = F.expr("conv_id <=> of AND turn <=> t AND msg = m")
    rows = every.drop("text").join(keyed(positions(every, reply), "start", "depth", "parent_turn"), same).drop("of", "t", "m")
    rows = rows.join(keyed(reply, "n_passages", "n_linked"), same, "left").drop("of", "t", "m")
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn", "msg").orderBy("role")) - 1
    return rows.select(
        "conv_id",
        "turn",
        "role",
        (F.col("start") + copy).alias("position"),
        "parent_turn",
        "depth",
        F.coalesce("n_passages", F.lit(0)).cast("long").alias("n_passages"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("own").alias("text"),
    )

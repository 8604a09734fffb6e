"""Conversation structure repair by error-correcting Earley parsing.

A weighted grammar of roles has productions that keep a turn, give it another role, delete
it or insert an empty one.  A chart set holds the items predicted between two turns; the
scanner moves kept, rerolled and deleted turns to the next set, inserts stay in theirs.
The grammar is right-linear, so every completion waits for the end of the conversation:
the completer runs back over the sets, and each item retains the minimum of (cost, audit).
The audit is compared by its first edit alone, as the grammar leaves an item by an edit in
one way only, so no strings are kept in the chart.

A conversation is dealt into segments, ranges of its turns in order, and no task reads
more than ranges of bounded size.  A first pass completes each segment once for every item
that may follow it, which gives a small matrix of costs; the matrices of a conversation are
composed from its end, and a second pass completes each segment against the true costs
behind it.  Only the hash of a whole conversation is one stream, in bounded memory.

Results for odd input: a null identifier, role or text counts as one space where it is text;
null turns come first, and turns that tie are ordered by role, then text; rows that repeat are
duplicates; a conversation whose rows are all dropped has zeros and an empty audit; texts of
any length are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillstone.llm.rows import as_batch, map_rows
from quillstone.sources.workspace import materialise

#: The weighted role grammar: of each item the edits that lead on, with the role initial
#: they put out and the next item.  An item in ENDS may end the conversation.
ITEMS = ("open", "said", "asked", "answered")
GRAMMAR = {
    "open": (("K", "s", "said"), ("K", "u", "asked"), ("R", "u", "asked"), ("I", "u", "asked"), ("D", "", "open")),
    "said": (("K", "u", "asked"), ("R", "u", "asked"), ("I", "u", "asked"), ("D", "", "said")),
    "asked": (("K", "a", "answered"), ("R", "a", "answered"), ("I", "a", "answered"), ("D", "", "asked")),
    "answered": (("K", "u", "asked"), ("R", "u", "asked"), ("I", "u", "asked"), ("D", "", "answered")),
}
ENDS = ("open", "answered")
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
#: A truncated turn that stays costs this much more.
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
#: Turns of a segment; a power of two.
SEGMENT = 4096

BLANK, DUPLICATE, CUT = "blank", "duplicate", "truncated"
NEXT_TO = ("su", "ua", "au")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the fixed damage by a checksum of (conv_id, turn).

    A dropped row stays with no copies, so that its conversation is not lost.
    """
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Turns with their faults, numbered in order: conv_id, segment, at, turn, role, text, fault, copies.

    Equal rows of one turn are one row with a number of copies, all but the first of which are
    duplicates; whether the first one is follows from the least turn of its role and text.
    """
    turns = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    turns = materialise(turns.withColumn("digest", F.sha2(F.to_binary("text", F.lit("utf-8")), 256)), "turns")
    said = turns.filter("copies > 0").groupBy("conv_id", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first"))
    said = said.filter("n > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    marked = turns.join(said, F.expr("conv_id <=> c AND role = r AND digest = d"), "left")
    again = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    end = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(end == "", BLANK).when(again, DUPLICATE).when(~end.isin(".", "!", "?"), CUT)
    marked = marked.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), F.substring("text", 1, 64).alias("start"))
    marked = materialise(marked, "marked")  # read twice: to find the ranges and to deal the rows
    dealt = marked.repartitionByRange("conv_id", "turn", "role", "start").sortWithinPartitions("conv_id", "turn", "role", "text")
    # A row's number has its range above and its place in it below 2**33.
    dealt = dealt.withColumn("at", F.monotonically_increasing_id())
    segment = F.floor(F.col("at") / SEGMENT).cast("long")
    return materialise(dealt.select("conv_id", segment.alias("segment"), "at", "turn", "role", "text", "fault", "copies"), "in-order")


# Parsing


def expanded(rows: list[tuple]) -> list[tuple[str, str | None, int]]:
    """(role initial, fault, times) of each turn.  Copies after a turn's first are duplicates, of
    blank turns blank; a run of them can only be deleted and is one step, so that no number
    of copies makes a chart long.  An insert among them is never less than one behind them."""
    out = []
    for initial, fault, copies in rows:
        if fault in (BLANK, DUPLICATE):
            out += [(initial, fault, copies)] * (copies > 0)
        else:
            out += [(initial, fault, 1)] * (copies > 0) + [(initial, DUPLICATE, copies - 1)] * (copies > 1)
    return out


def predicted(turns: list[tuple], starts: tuple[str, ...]) -> list[set[str]]:
    """The chart's sets: items reached from ``starts`` before each turn and at the end, inserts followed."""
    sets, now = [], set(starts)
    for k in range(len(turns) + 1):
        agenda = list(now)
        while agenda:
            for edit, _, onward in GRAMMAR[agenda.pop()]:
                if edit == "I" and onward not in now:
                    now.add(onward)
                    agenda.append(onward)
        sets.append(now)
        if k < len(turns):
            now = {onward for item in now for edit, out, onward in GRAMMAR[item] if scanned(edit, out, *turns[k]) is not None}
    return sets


def scanned(edit: str, out: str, initial: str, fault: str | None, times: int) -> int | None:
    """The cost of an edit that reads a turn, or None where it does not apply."""
    if edit == "D":
        return COSTS["D"] * times
    if edit == "I" or fault in (BLANK, DUPLICATE) or (edit == "K" and out != initial):
        return None
    return COSTS[edit] + TRUNCATED * (fault == CUT)


def completed(turns: list[tuple], sets: list[set[str]], behind: dict[str, int]) -> list[dict[str, tuple[int, str, str]]]:
    """For each set and item the least (cost, first edit) to the end, and the item that edit leads to.

    ``behind`` is the cost of what follows the last turn, per item.
    """
    chart: list[dict] = [{}] * (len(turns) + 1)
    after: dict[str, tuple[int, str, str]] = {}
    for k in range(len(turns), -1, -1):
        own = {item: (behind[item], "", item) for item in sets[k]} if k == len(turns) else {}
        for item in sets[k]:
            for edit, out, onward in GRAMMAR[item]:
                if k < len(turns) and (cost := scanned(edit, out, *turns[k])) is not None:
                    own[item] = min(own.get(item, (FAR, "~", "")), (cost + after[onward][0], edit, onward))
        for _ in ITEMS:  # inserts lead to items of the same set; they cost, so the rounds are few
            for item in sets[k]:
                for edit, _, onward in GRAMMAR[item]:
                    if edit == "I" and onward in own:
                        own[item] = min(own.get(item, (FAR, "~", "")), (COSTS["I"] + own[onward][0], edit, onward))
        chart[k] = after = own
    return chart


def followed(turns: list[tuple], chart: list[dict], start: str) -> tuple[str, str]:
    """The audit of the best derivation from an item, and the item it ends at."""
    audit, k, item = [], 0, start
    while True:
        _, edit, onward = chart[k][item]
        if not edit:
            return "".join(audit), item
        audit.append(edit * (turns[k][2] if edit == "D" else 1))
        k, item = k + (edit != "I"), onward


# Segments


def in_segments(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """Rows dealt by segment; in as many tasks as the session shuffles to, as parsing is work that bytes do not tell."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("conv_id", "segment", *columns).repartition(tasks, "conv_id", "segment").sortWithinPartitions("conv_id", "segment", *order)


def by_segment(rows: DataFrame, columns: list[str], out: pa.Schema, work) -> DataFrame:
    """``work(rows)`` for every segment, its rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (conv, segment), own in groupby(each, key=itemgetter(0, 1)):
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "segment": segment} | work([r[3:] for r in own])], schema=out)

    return in_segments(rows, ["at", *columns], ["at"]).mapInArrow(run, from_arrow_schema(out))


LONG, TEXT = pa.int64(), pa.string()
PLACE = [("conv_id", LONG), ("segment", LONG)]
COUNTS = (BLANK, DUPLICATE, CUT, "illegal")
COSTED = pa.schema([*PLACE, ("costs", pa.list_(LONG)), ("first", TEXT), ("last", TEXT), *[(c, LONG) for c in COUNTS]])
BEHIND = pa.schema([*PLACE, ("behind", pa.list_(LONG)), ("cost", LONG), *[(c, LONG) for c in COUNTS]])
AUDITED = pa.schema([*PLACE, ("audits", pa.list_(TEXT)), ("ends", pa.list_(TEXT))])
AUDIT = pa.schema([*PLACE, ("item", TEXT), ("audit", TEXT)])
REPAIRED = pa.schema([*PLACE, ("seq", LONG), ("role", TEXT), ("text", TEXT), ("edit", TEXT)])
#: The segment number of a row that is about a whole conversation.
WHOLE = -1


def costed(rows: list[tuple]) -> dict:
    """A segment's faults, its outer role initials, and its costs from each item to each."""
    turns = expanded(rows)
    sets = predicted(turns, ITEMS)
    firsts = [completed(turns, sets, {i: 0 if i == end else FAR for i in ITEMS})[0] for end in ITEMS]
    costs = [min(FAR, first[start][0]) for start in ITEMS for first in firsts]
    illegal = sum(times - 1 for *_, times in turns) + sum(a[0] + b[0] not in NEXT_TO for a, b in zip(turns, turns[1:], strict=False))
    counts = {c: sum(times for _, fault, times in turns if fault == c) for c in (BLANK, DUPLICATE, CUT)}
    return {"costs": costs, "first": turns[0][0] if turns else None, "last": turns[-1][0] if turns else None, "illegal": illegal} | counts


def composed(conv: int | None, segments: list[dict]) -> Iterator[tuple]:
    """BEHIND rows: the costs behind each segment, from the last back; then the whole conversation."""
    segments = sorted(segments, key=itemgetter("segment"))
    behind, n = [0 if item in ENDS else FAR for item in ITEMS], len(ITEMS)
    for s in reversed(segments):
        yield (conv, s["segment"], behind, *[None] * (1 + len(COUNTS)))
        behind = [min(FAR, min(s["costs"][i * n + j] + behind[j] for j in range(n))) for i in range(n)]
    spoken = [s for s in segments if s["first"] is not None]
    between = sum(a["last"] + b["first"] not in NEXT_TO for a, b in zip(spoken, spoken[1:], strict=False))
    yield (conv, WHOLE, None, behind[ITEMS.index("open")], *[sum(s[c] for s in segments) + between * (c == "illegal") for c in COUNTS])


def audited(rows: list[tuple]) -> dict:
    """A segment's best audit from each item, given the costs behind it, and where it ends."""
    turns = expanded([r[:3] for r in rows])
    behind = dict(zip(ITEMS, rows[0][3], strict=True))
    chart = completed(turns, predicted(turns, ITEMS), behind)
    found = [followed(turns, chart, start) for start in ITEMS]
    return {"audits": [audit for audit, _ in found], "ends": [end for _, end in found]}


def chained(conv: int | None, segments: list[dict]) -> Iterator[tuple]:
    """AUDIT rows: where each segment starts, and its audit; then the whole conversation's."""
    item, whole = "open", []
    for s in sorted(segments, key=itemgetter("segment")):
        i = ITEMS.index(item)
        yield conv, s["segment"], item, s["audits"][i]
        whole.append(s["audits"][i])
        item = s["ends"][i]
    yield conv, WHOLE, None, "".join(whole)


def per_conversation(segments: DataFrame, columns: list[str], row, out: pa.Schema) -> DataFrame:
    """``row`` over each conversation's segments, of which there is one in SEGMENT turns, about."""
    gathered = segments.groupBy("conv_id").agg(F.collect_list(F.struct("segment", *columns)).alias("segments"))
    return map_rows(gathered, ["conv_id", "segments"], row, out)


def repaired_rows(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, segment, seq, role, text, edit: the turns that stay and those put in, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out, size = [], 0
        for row in (made for place, own in groupby(each, key=itemgetter(0, 1)) for made in applied(*place, own)):
            out.append(row)
            size += len(row[4])
            if len(out) >= 1024 or size > 1 << 22:
                yield as_batch(out, REPAIRED)
                out, size = [], 0
        if out:
            yield as_batch(out, REPAIRED)

    first = audits.filter(F.col("segment") != WHOLE).select("conv_id", "segment", F.lit(-1).cast("long").alias("at"), F.col("item").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("long").alias("copies"))
    rows = first.union(turns.select("conv_id", "segment", "at", "role", "text", "copies"))
    return in_segments(rows, ["at", "role", "text", "copies"], ["at"]).mapInArrow(run, from_arrow_schema(REPAIRED))


def applied(conv: int | None, segment: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """A segment's REPAIRED rows; its first row holds the item it starts at and its audit."""
    _, _, _, item, audit, _ = next(rows)
    place, seq = 0, 0

    def put(edit: str, initial: str) -> tuple[str, str]:
        return next((out, onward) for e, out, onward in GRAMMAR[item] if e == edit and (e != "K" or out == initial))

    def inserted() -> Iterator[tuple]:
        nonlocal place, seq, item
        while audit[place : place + 1] == "I":
            out, item = put("I", "")
            yield conv, segment, seq, ROLES[out], "", "I"
            place, seq = place + 1, seq + 1

    for *_, role, text, copies in rows:
        for _ in range(copies):
            yield from inserted()
            edit = audit[place]
            place += 1
            if edit != "D":
                out, item = put(edit, role[:1])
                yield conv, segment, seq, role if edit == "K" else ROLES[out], text, edit
                seq += 1
    yield from inserted()


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repaired turns, one row per conversation) of turns (conv_id, turn, role, text, copies).

    The turns have conv_id, segment, seq (their order), role, text and the edit that made them;
    a conversation has gaps, blank, duplicate, truncated, illegal, cost and audit.
    """
    turns = in_order(rows)
    read = turns.withColumn("initial", F.substring("role", 1, 1))
    segments = materialise(by_segment(read, ["initial", "fault", "copies"], COSTED, costed), "costed")
    behind = materialise(per_conversation(segments, ["costs", "first", "last", *COUNTS], composed, BEHIND), "behind")
    known = behind.filter(F.col("segment") != WHOLE).select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "behind")
    read = read.select("conv_id", "segment", "at", "initial", "fault", "copies").join(known, F.expr("conv_id <=> c AND segment = s"))
    found = by_segment(read, ["initial", "fault", "copies", "behind"], AUDITED, audited)
    audits = materialise(per_conversation(found, ["audits", "ends"], chained, AUDIT), "audits")
    present = turns.filter("copies > 0 AND turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.count("*").alias("n"))
    gaps = present.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # Every conversation has one row in each of the first two; one more shuffle puts them together.
    parts = behind.filter(F.col("segment") == WHOLE).select("conv_id", "cost", *COUNTS)
    parts = parts.unionByName(audits.filter(F.col("segment") == WHOLE).select("conv_id", "audit"), allowMissingColumns=True).unionByName(gaps, allowMissingColumns=True)
    report = parts.groupBy("conv_id").agg(F.coalesce(F.max("gaps"), F.lit(0)).cast("long").alias("gaps"), *[F.max(c).alias(c) for c in (*COUNTS, "cost", "audit")])
    return repaired_rows(turns, audits), report


def conversation_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, sha256 of each conversation's ``role:text`` lines: one stream each, as a hash is read in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for conv, own in groupby(each, key=itemgetter(0)):
            digest = hashlib.sha256()
            for nth, (_, role, text) in enumerate(own):
                digest.update(f"{'\n' if nth else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha256": digest.hexdigest()}], schema=out)

    out = pa.schema([("conv_id", LONG), ("sha256", TEXT)])
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "seq")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, from_arrow_schema(out))


def repair_report(rows: DataFrame) -> DataFrame:
    """The report of ``repair`` with repaired_sha256; of no turns, the hash of the empty string."""
    turns, report = repair(rows)
    hashes = conversation_hashes(turns).withColumnRenamed("conv_id", "c")
    return report.join(hashes, F.expr("conv_id <=> c"), "left").drop("c").withColumn("repaired_sha256", F.coalesce("sha256", F.sha2(F.lit(b""), 256))).drop("sha256")

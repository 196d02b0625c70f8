"""Repair of conversations whose structure is broken, by error-correcting Earley parsing.

A conversation should be ``(s?(ua)+)?`` in the initials of its roles: perhaps a
system message, then pairs of user and assistant.  ``earley`` finds the cheapest
edits; here Spark gets the rows into order, marks their faults, parses blocks of
them and applies the edits.

At scale: rows are put into order by ranges of (conversation, turn, role, text),
so a conversation of any length is spread over tasks, and its rows are known by
their place in that order.  Blocks of 4096 rows are parsed from each of the four
prefixes that a conversation can be in, apart from each other; one pass over the
narrow blocks joins their results.  It holds a few letters for each row of one
conversation, as the audit itself does.  Edits are applied by a join on the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from geoquarry.llm import earley
from geoquarry.llm.words import WHITE
from geoquarry.plans.staging import Staging

#: log2 of the rows of a block.
BLOCK = 12
LEGAL = {"su", "ua", "au"}
#: Edits that a task holds before it passes them on.
AT_ONCE = 50_000
ROLE = {0: "user", 1: "assistant"}


def _said(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(" "))


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32(``conv_id:turn``) % 20 (nulls count as one space).

    0 drops a row, 1 empties its text, 2 removes ``[.!?]`` from it, 3 repeats the
    row, 4 makes its role user; the others stay as they are.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(_said("text"), ".!?", "")).otherwise(_said("text"))
    role = F.when(kind == 4, "user").otherwise(_said("role"))
    kept = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"))
    return kept.drop("copy")


def _ordered(turns: DataFrame, staging: Staging) -> DataFrame:
    """The rows with ``at`` (ascending in order of conversation, turn, role and text), the role's initial, and blank and truncated."""
    bare = F.translate("text", WHITE, "")
    first = F.substring("role", 1, 1)
    rows = turns.select("conv_id", "turn", _said("role").alias("role"), _said("text").alias("text"))
    line = ("conv_id", "turn", "role", "text")
    ranged = rows.withColumn("spread", F.rand(1)).repartitionByRange(*line, "spread").drop("spread").sortWithinPartitions(*line).withColumn("at", F.monotonically_increasing_id())
    return staging.cut(
        ranged.withColumns({"initial": F.when(first.isin("s", "u", "a"), first).otherwise("x"), "blank": bare == "", "truncated": ~F.right(bare, F.lit(1)).isin(".", "!", "?")}),
        "ordered",
    )


def _flagged(ordered: DataFrame) -> DataFrame:
    """at, conv_id, turn, initial, fault (first that holds, or null), token of each row."""
    firsts = ordered.groupBy("conv_id", "role", F.length("text").alias("n"), F.sha2("text", 256).alias("sha")).agg(F.min("at").alias("first_at"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first_at").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    token = F.when(F.col("fault").isin("blank", "duplicate"), earley.GO).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    narrow = ordered.select("at", "conv_id", "turn", "initial", "blank", "truncated")
    met = narrow.join(firsts.select("first_at").hint("merge"), F.col("at") == F.col("first_at"), "left")
    return met.withColumn("fault", fault).select("at", "conv_id", "turn", "initial", "fault", token.alias("token"))


def _edits(blocks: DataFrame) -> DataFrame:
    """conv_id, block, cost, illegal (of the conversation), piece (of the audit), kept [at, place, role, edit] of each block."""
    kind = blocks.schema["conv_id"]
    one = pa.struct([("at", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("edit", pa.string())])
    schema = T.StructType([kind, *T.StructType.fromDDL("block long, cost long, illegal long, piece string, kept array<struct<at: long, place: long, role: string, edit: string>>")])

    def repaired(key, own: list, best: dict) -> Iterator[tuple]:
        """Block rows of one conversation, each with its part of the cheapest way through all."""
        way, state = min((best[s], s) for s in earley.COMPLETE if s in best)
        pieces = []
        for _, _, chosen, _ in reversed(own):
            state, piece = chosen[state]
            pieces.append(piece)
        lead = (len(way[1]) - way[1].count("D")) % 2  # an odd number of messages begins with the system's
        illegal = sum(a + b not in LEGAL for a, b in pairwise("".join(o[3] for o in own)))
        place = 0
        for (block, at, *_), piece in zip(own, reversed(pieces), strict=True):
            kept = []
            for letter in piece:
                if letter != "D":
                    kept.append({"at": at if letter != "I" else -place - 1, "place": place, "role": None if letter == "K" else ROLE[(place - lead) % 2], "edit": letter})
                    place += 1
                at += letter != "I"
            yield key, block, way[0], illegal, piece, kept

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, own, best = None, [], {earley.OPEN: (0, "")}
        for b in batches:
            for conv, block, at, tokens, initials in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own and conv != key:
                    yield from repaired(key, own, best)
                    own, best = [], {earley.OPEN: (0, "")}
                key, ways, chosen = conv, {}, {}
                for state, (cost, audit) in best.items():
                    for to, (more, piece) in earley.parse(tokens, state).items():
                        way = (cost + more, audit + piece)
                        if to not in ways or way < ways[to]:
                            ways[to], chosen[to] = way, (state, piece)
                best = ways
                own.append((block, at, chosen, initials))
        if own:
            yield from repaired(key, own, best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            types = [to_arrow_type(kind.dataType), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(one)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)

        for row in told(batches):
            held.append(row)
            n += 1 + len(row[-1])
            if n > AT_ONCE:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return blocks.select("conv_id", "block", "at", "tokens", "initials").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired messages, and a report of each conversation.

    Messages: conv_id, place (from 0), role, text, edit (K kept, R given another
    role, I inserted empty).  Report: conv_id; gaps (turns missing between the least
    and the largest); rows whose first fault is blank (only white space), duplicate
    (role and text were there before; texts are compared by length and SHA-256) or
    truncated (the end isn't ``[.!?]``); illegal (neighbours whose role initials are
    not su, ua or au); cost and audit of the repair, where D is a deletion.

    Rows are taken by turn, nulls first, ties by role and text; a null role or text
    is one space, null conversations are one.  Keeping costs 0, a change to user
    or assistant 2, an insertion 2, a deletion 3; blank and duplicate rows must go,
    a truncated row that stays adds 1.  Of equally cheap repairs the audit that is
    first in ASCII wins.  A message is known by the first letter of its role, as it
    is.  A conversation all of whose rows go has no messages; an empty table gives
    none and no report; columns other than conv_id, turn, role, text aren't read.
    """
    staging = Staging(turns.sparkSession, "repair")
    ordered = _ordered(turns, staging)
    flagged = staging.cut(_flagged(ordered), "flagged")
    line = F.array_sort(F.collect_list(F.struct("at", "token", "initial")))
    blocks = flagged.groupBy("conv_id", F.shiftright("at", BLOCK).alias("block")).agg(line.alias("line"))
    spelled = lambda field: F.array_join(F.transform("line", lambda x: x[field]), "")
    blocks = blocks.select("conv_id", "block", F.col("line")[0]["at"].alias("at"), spelled("token").alias("tokens"), spelled("initial").alias("initials"))
    edits = staging.cut(_edits(blocks), "edits")
    faults = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = flagged.groupBy("conv_id").agg(gaps.alias("gaps"), *faults)
    pieces = F.array_sort(F.collect_list(F.struct("block", "piece")))
    costs = edits.groupBy("conv_id").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"), F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("audit"))
    report = whole_rows(turns, "conv_id", counts, costs).where(F.col("audit").isNotNull())
    kept = edits.select(F.col("conv_id").alias("conv"), F.inline("kept").alias("at", "place", "new_role", "edit"))
    told = kept.join(ordered.select("at", "role", "text").hint("merge"), "at", "left")
    rows = told.select(F.col("conv").alias("conv_id"), "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")
    return rows, report


def whole_rows(base: DataFrame, key: str, *parts: DataFrame) -> DataFrame:
    """One row for each ``key`` of ``base`` (null is a key), with the columns of ``parts``, which have a row for each key at most; null where they have none."""
    out = base.select(key).distinct()
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy(key).agg(*[F.max(c).alias(c) for c in out.columns if c != key])


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the conversations' ``role:text`` lines in order; lines pass one by one, none are held."""
    kind = rows.schema["conv_id"]
    schema = T.StructType([kind, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, typed = None, None, None
        for b in batches:
            typed, convs, shas = b.column(0).type, [], []
            for conv, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if sha is None or conv != key:
                    if sha is not None:
                        convs.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = conv, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(convs, typed), pa.array(shas, pa.string())], names=schema.names)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], typed), pa.array([sha.hexdigest()], pa.string())], names=schema.names)

    lines = rows.select("conv_id", "place", F.concat("role", F.lit(":"), "text").alias("line")).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return lines.select("conv_id", "line").mapInArrow(run, schema)


def repair_digests(turns: DataFrame) -> DataFrame:
    """The report of the damaged conversations and the SHA-256 of their repaired lines, a row for each conv_id of ``turns``.

    A conversation of which no row is left has zeros, an empty audit and the hash
    of no bytes; so has one whose repair deletes everything, but for its counts.
    """
    rows, report = repair(damage(turns))
    found = whole_rows(turns, "conv_id", report, text_digests(rows))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.withColumns(zero | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))})

"""Conversation structure repair by an auction shortest-path algorithm.

The rows of a conversation, in order of their turns, are a lattice: a node for each gap
between rows and each state of the pattern `(s?(ua)+)?` (nothing yet, after s, after u,
after a), an arc for each edit. Keep costs 0, Rerole 1, Delete 2, Insert 5, and a truncated
row that stays 5 more. Blank and repeated rows can only be deleted, at a cost that no choice
changes, so they stand outside the lattice; their D comes before any I of the same gap.

Nodes have prices, which start at 0. From each node as origin, the last gap first, the auction
extends a path along the arc of least cost plus price, while this equals the price of the
path's end; else that price rises to it and the path contracts by a node. A path ends in the
first node whose price has converged. When all have, a price is the cost of the cheapest way
on, arcs whose cost is the difference of their prices are tight, and only these lie on cheapest
ways; the trace takes the ASCII-least tight arc of each node.

Spark places the rows: equal rows of a conversation are counted first (so a row that repeats
without bound is one row), the rest is dealt by range of (conversation, turn, role, digest), cut
into pieces of PIECE rows, and a piece becomes a string of one byte a row. A conversation's
strings are joined and solved in blocks of BLOCK rows, of which only the prices at the borders
are held; equal blocks are solved once in a task. The texts then move once, sorted, past the
conversation's edits: one running hash is held, no conversation. The audit and the SHA-256 of a
conversation are one string and one stream each by their definition, so at that step one task
holds one byte for each row of a conversation and reads its texts one by one.

Odd rows: null roles, texts and (in the damage's key) conversations and turns are one space;
rows of a null conv_id are one conversation; a role that begins with neither s, u nor a (the
empty one too) can be reroled or deleted only; rows of equal turn go by role and then by the
MD5 of the text; long texts are read whole; repeated rows are duplicates of the first; other
columns are ignored, whatever their names; no rows give none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, staged

#: Costs of the edits, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows in a string that one task builds at once, and in a block that the auction solves at once.
PIECE, BLOCK = 4096, 512
#: States: nothing yet, after s, after u, after a. The user's turn is next in all but `after u`.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: What the end of a conversation costs in each state: nothing, the two or the one that must be inserted, nothing.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
#: Legal neighbours.
LEGAL = frozenset(("su", "ua", "au"))
#: In a signature: rows that must go; others by role initial (o: none that fits), in capitals if truncated.
GONE, OTHER = "x", "o"


def _arcs(row: str, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, state) of the arcs that leave a node before `row`, in the order of their letters."""
    role, more = row.lower(), CUT if row.isupper() else 0
    after = ASSISTANT if state == USER else USER
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, after)]
    if (role == "s" and state == NOTHING) or role == ("a" if state == USER else "u"):
        arcs.append(("K", KEEP + more, 1, SYSTEM if role == "s" else after))
    arcs.append(("R", REROLE + more, 1, after))
    return arcs


_OUT = {c: [_arcs(c, q) for q in range(4)] for c in "suaoSUAO"}


def auction(rows: str, end: tuple[int, ...] = END) -> list[list[int]]:
    """The converged price of each gap and state: the cost of the cheapest way to the end, FAR if there is none.

    end: what it costs to go on behind the last row, by state. Rows that must go are not among `rows`.
    """
    n = len(rows)
    price = [[0] * 4 for _ in range(n)] + [list(end)]
    # behind u and a there is no way back, so nodes that lead to no end are left out
    open_ = [min(end[q:] if q < USER else end[USER:]) < FAR for q in range(4)]
    done = [[not x for x in open_] for _ in range(n)] + [[True] * 4]
    for i in range(n):
        for q in range(4):
            if not open_[q]:
                price[i][q] = FAR
    for at in range(n - 1, -1, -1):
        for state in range(4):
            if done[at][state]:
                continue
            path = [(at, state)]
            while True:
                i, q = path[-1]
                if done[i][q]:
                    for j, r in path:  # all of its arcs are tight
                        done[j][r] = True
                    break
                least, nearest = FAR, None
                for _, cost, taken, r in _OUT[rows[i]][q]:
                    here = cost + price[i + taken][r]
                    if here < least:
                        least, nearest = here, (i + taken, r)
                if price[i][q] < least:
                    price[i][q] = least
                    if nearest is None:
                        done[i][q] = True
                    if len(path) > 1:
                        path.pop()
                    elif nearest is None:
                        break
                else:
                    path.append(nearest)
    return price


@lru_cache(maxsize=1 << 14)
def _entry(rows: str, end: tuple[int, ...]) -> tuple[int, ...]:
    """Prices before the first row of a block."""
    return tuple(auction(rows, end)[0])


@lru_cache(maxsize=1 << 14)
def _traced(rows: str, end: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int]:
    """Of each row of a block the edits that lead over it, with the inserts before it, by the least tight arcs; the state behind."""
    price, out = auction(rows, end), []
    for i, row in enumerate(rows):
        edits = ""
        while True:
            letter, _, taken, after = next(x for x in _OUT[row][state] if x[1] + price[i + x[2]][x[3]] == price[i][state])
            edits, state = edits + letter, after
            if taken:
                break
        out.append(edits)
    return tuple(out), state


def repair(signature: str) -> tuple[str, int]:
    """The audit of a conversation and its cost, from its rows' signature."""
    rows = signature.replace(GONE, "")
    # prices at the borders of blocks, from the end; least 0, so equal blocks meet in the cache
    ends, cost = [END], DELETE * (len(signature) - len(rows))
    starts = range(0, len(rows), BLOCK)
    for at in reversed(starts):
        entry = _entry(rows[at : at + BLOCK], ends[-1])
        low = min(entry)
        cost += low
        ends.append(tuple(x - low for x in entry))
    cost += ends[-1][NOTHING]
    audit, state, done = [], NOTHING, 0
    for at, end in zip(starts, reversed(ends[:-1]), strict=True):
        edits, state = _traced(rows[at : at + BLOCK], end, state)
        for letters in edits:
            here = done
            while signature[here] == GONE:
                here += 1
            audit.append("D" * (here - done) + letters)
            done = here + 1
    return "".join(audit) + "D" * (len(signature) - done) + TAIL[state], cost


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times (1 or 2): the rows that stay, damaged by crc32(`conv_id:turn`) % 20, nulls as one space."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("hit")).where("hit != 0")
    harmed = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return hit.select("conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), harmed.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("times"))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def faults(rows: DataFrame) -> DataFrame:
    """One row for each different row: conv_id, turn, role, digest (of the text), n (how often), kind: blank, duplicate, truncated or null,
    of the first of them (the others are blank or duplicates).
    """
    shown = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(shown == "", "blank").when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    each = rows.select("conv_id", "turn", "role", _digest("text").alias("digest"), kind.alias("kind"), "times")
    different = staged(each.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("times").alias("n"), F.first("kind").alias("kind")), "turns")
    # the first of equal role and text, by a sum for each; joined on the whole key, so no text is a hot key
    first = different.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    first = first.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role", "digest")))
    same = (different["digest"] == first["_digest"]) & (different["role"] == first["_role"]) & different["conv_id"].eqNullSafe(first["_conv_id"]) & different["turn"].eqNullSafe(first["_turn"])
    is_first = F.col("_digest").isNotNull()
    return different.join(first, same, "left").select("conv_id", "turn", "role", "digest", "n", F.when(is_first | (F.col("kind") == "blank"), F.col("kind")).otherwise("duplicate").alias("kind"))


def _illegal(roles: Column) -> Column:
    """How many neighbours in a string of role initials are not legal."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(roles) - 1), lambda i: F.substring(roles, i, F.lit(2)))
    return F.when(F.length(roles) > 1, F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))).otherwise(0).cast("long")


def _signatures(found: DataFrame) -> DataFrame:
    """One row for each conversation with rows: conv_id, signature, and the counts of its faults."""
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    fits = F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER)
    one = F.when(F.col("kind").isin("blank", "duplicate"), GONE).when(F.col("kind") == "truncated", F.upper(fits)).otherwise(fits)
    signs = F.concat(one, F.repeat(F.lit(GONE), (F.col("n") - 1).cast("int")))
    counts = {
        "blank": F.when(F.col("kind") == "blank", F.col("n")).otherwise(0),
        "duplicate": F.when(F.col("kind") == "blank", 0).otherwise(F.col("n") - F.when(F.col("kind") == "duplicate", 0).otherwise(1)),
        "truncated": F.when(F.col("kind") == "truncated", 1).otherwise(0),
    }
    order = ["conv_id", "turn", "role", "digest"]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # a piece: neighbours of one conversation in one partition
    part, block = F.shiftright("at", 33), F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / PIECE)
    run = F.array_sort(F.collect_list(F.struct("at", signs.alias("signs"), F.repeat(initial, F.col("n").cast("int")).alias("roles"))))
    pieces = placed.groupBy("conv_id", part.alias("part"), block.alias("block")).agg(run.alias("run"), *(F.sum(c).alias(k) for k, c in counts.items()))
    roles = F.array_join(F.transform("run", lambda x: x["roles"]), "")
    pieces = pieces.select("conv_id", "part", "block", F.array_join(F.transform("run", lambda x: x["signs"]), "").alias("signs"), roles.alias("roles"), *counts)
    pieces = pieces.select("*", _illegal(F.col("roles")).alias("illegal"), F.concat(F.left("roles", F.lit(1)), F.right("roles", F.lit(1))).alias("ends"))
    whole = F.array_sort(F.collect_list(F.struct("part", "block", "signs", "ends")))
    joined = pieces.groupBy("conv_id").agg(whole.alias("whole"), *(F.sum(c).alias(c) for c in (*counts, "illegal")))
    # neighbours that stand in two pieces
    seams = F.transform(F.sequence(F.lit(1), F.size("whole") - 1), lambda i: F.concat(F.right(F.get("whole", i - 1)["ends"], F.lit(1)), F.left(F.get("whole", i)["ends"], F.lit(1))))
    between = F.when(F.size("whole") > 1, F.size(F.filter(seams, lambda p: ~p.isin(*LEGAL)))).otherwise(0)
    return joined.select("conv_id", F.array_join(F.transform("whole", lambda x: x["signs"]), "").alias("signature"), *counts, (F.col("illegal") + between).alias("illegal"))


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        solved = [repair(x or "") for x in batch.column("signature").to_pylist()]
        kept = [c for c in batch.schema.names if c != "signature"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([x[0] for x in solved], pa.string()), pa.array([x[1] for x in solved], pa.int64())], [*kept, "audit", "cost"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its head (with the audit) first: the heads, each with the hash of its repaired rows."""
    heads: list[dict] = []
    state: dict = {}

    def put(role: str, text: str) -> None:
        state["sha"].update(("\n" if state["any"] else "").encode())
        state["sha"].update(f"{role}:{text}".encode())
        state["any"], state["user"] = True, role[:1] == "u"

    def inserted() -> None:
        while state["edits"][state["at"] : state["at"] + 1] == "I":
            put("assistant" if state["user"] else "user", "")
            state["at"] += 1

    def close() -> None:
        if state:
            inserted()
            heads.append(state["head"] | {"repaired_sha256": state["sha"].hexdigest()})

    names: list[str] = []
    kinds: list[pa.DataType] = []
    for batch in batches:
        if not names:
            names = [c for c in batch.schema.names if c not in ("row", "turn", "role", "digest", "text", "times")]
            kinds = [batch.schema.field(c).type for c in names]
        columns = {c: batch.column(c) for c in batch.schema.names}
        for at in range(0, batch.num_rows, 1024):
            part = {c: x.slice(at, 1024).to_pylist() for c, x in columns.items()}
            for k, row in enumerate(part["row"]):
                if row == 0:
                    close()
                    state = {"head": {c: part[c][k] for c in names}, "sha": hashlib.sha256(), "edits": part["audit"][k], "at": 0, "any": False, "user": False}
                    continue
                for _ in range(part["times"][k]):
                    inserted()
                    edit = state["edits"][state["at"]]
                    state["at"] += 1
                    if edit == "K":
                        put(part["role"][k], part["text"][k])
                    elif edit == "R":
                        put("assistant" if state["user"] else "user", part["text"][k])
            if len(heads) >= 1024:
                yield _as_batch(heads, names, kinds)
                heads.clear()
    close()
    if heads:
        yield _as_batch(heads, names, kinds)


def _as_batch(heads: list[dict], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = [pa.array([h[c] for h in heads], kind) for c, kind in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([h["repaired_sha256"] for h in heads], pa.string())], [*names, "repaired_sha256"])


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conversation that has rows: conv_id, gaps, blank, duplicate, truncated, illegal, audit, cost.

    rows: conv_id, turn, role, text, times.
    """
    found = staged(faults(rows), "faults")
    spread = found.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    signed = _signatures(found).join(spread.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return signed.select("conv_id", "signature", "gaps", "blank", "duplicate", "truncated", "illegal").mapInArrow(_audited, f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, audit string, cost bigint")


def structure(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = damaged(conversations)
    judged = audits(rows)
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    heads = every.join(judged, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(F.col("_id").alias("conv_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"))
    digested = rows.withColumn("digest", _digest("text"))
    both = heads.withColumn("row", F.lit(0)).unionByName(digested.withColumn("row", F.lit(1)), allowMissingColumns=True)
    order = ["conv_id", "row", "turn", "role", "digest"]
    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    out = T.StructType([heads.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return dealt.select(*heads.columns, "row", "turn", "role", "digest", "text", "times").mapInArrow(_hashed, out)

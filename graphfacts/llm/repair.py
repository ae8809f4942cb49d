"""Repair of conversation structure by the auction algorithm for shortest paths.

The edits of a conversation are paths through a lattice of (rows consumed, role state): keep, rerole or delete the next
row, or insert an empty one. All costs are integers. The auction algorithm grows one path from the origin: at its last
node it either extends along the cheapest arc or, if the node's price is too low for that, raises the price and
contracts. When the goal is reached the prices are dual optimal, so every cheapest path consists of tight arcs, and the
least one in ASCII order is traced over tight arcs letter by letter.

A conversation may have any number of rows: blocks of BLOCK consecutive rows are solved on their own, for each role state at
either end, and composed in a tree. A composed table holds sixteen costs and the order of the sixteen paths, never the
paths, so the tree handles a conversation that holds a third of all rows like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphfacts.plans import tables

BLOCK, FAN_IN = 64, 64
SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1

# Role states: nothing yet, after a system row, after a user row, after an assistant row. A conversation may end in the
# first and the last.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
TURN = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled row
NAME = {USER: "u", ASSISTANT: "a"}
CLOSING = ("", "ua", "a", "")  # rows inserted to end well
USEFUL = ({EMPTY}, {EMPTY, SYSTEM}, set(STATES), set(STATES))  # states from which a state can be reached
FITS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
# A row's tag: its initial (s, u, a, any other) and whether it is sound, unfinished or must go.
INITIALS, TAGS = "suax", "abcdefghijkl"

Arcs = list[tuple[str, int, int]]


def lattice(tags: str, goal: int | None) -> tuple[list[Arcs], list[int]]:
    """The arcs ``(code, cost, node)`` of every node ``4 * rows + state``, in the order of their letters, and prices
    to begin with: what the rows ahead cost at least.

    Codes: ``D`` delete, ``u`` and ``a`` insert, ``K`` keep, ``U`` and ``A`` rerole. With a ``goal`` state, insertions
    precede a row, so that no path is a beginning of another one; without, the last rows lead to a final node.
    """
    n, useful = len(tags), USEFUL[goal] if goal is not None else USEFUL[USER]
    final, arcs, least = 4 * n + 4, [], [0]
    for i, tag in enumerate(tags):
        initial, fault = INITIALS[TAGS.index(tag) // 3], TAGS.index(tag) % 3
        must_go, extra = fault == 2, UNFINISHED if fault == 1 else 0
        least.append(DELETE if must_go else extra)
        for state in STATES:
            own: Arcs = []
            if state in useful:
                after, row = TURN[state], 4 * i + 4
                own.append(("D", DELETE, row + state))
                if after in useful:
                    own.append((NAME[after], INSERT, 4 * i + after))
                if not must_go:
                    kept = FITS.get((state, initial))
                    if kept in useful:
                        own.append(("K", extra, row + kept))
                    if after in useful:
                        own.append((NAME[after].upper(), REROLE + extra, row + after))
            arcs.append(own)
    for state in STATES:
        if goal is not None:
            arcs.append([])
        elif CLOSING[state]:
            arcs.append([(NAME[TURN[state]], INSERT, 4 * n + TURN[state])])
        else:
            arcs.append([("", 0, final)])
    arcs.append([])
    ahead = sum(least)
    prices = []
    for cost in least[1:] + [0]:
        prices += [ahead] * 4
        ahead -= cost
    return arcs, prices + [0]


def auction(arcs: list[Arcs], prices: list, origin: int, goal: int) -> None:
    """Raises ``prices`` until a path of tight arcs leads from ``origin`` to ``goal``; the goal can be reached and
    prices start dual feasible: none above an arc's cost plus the price at its head."""
    path = [origin]
    while path[-1] != goal:
        node = path[-1]
        best, to = inf, -1
        for _, cost, head in arcs[node]:
            if cost + prices[head] < best:
                best, to = cost + prices[head], head
        if prices[node] < best:
            prices[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def traced(arcs: list[Arcs], prices: list, origin: int, goal: int) -> tuple[str, ...]:
    """The codes of the tight path whose letters are least; arcs come in the order of their letters."""
    dead: set[int] = set()
    path, codes, tried = [origin], [], [0]
    while path[-1] != goal:
        node = path[-1]
        for k in range(tried[-1], len(arcs[node])):
            code, cost, head = arcs[node][k]
            if prices[node] == cost + prices[head] and head not in dead:
                tried[-1] = k + 1
                path.append(head)
                codes.append(code)
                tried.append(0)
                break
        else:
            dead.add(node)
            path.pop()
            tried.pop()
            codes.pop()
    return tuple(codes)


def by_row(codes: tuple[str, ...], rows: int) -> list[str]:
    """Codes split so that each row has those up to its own letter; the last one has what follows, too."""
    out, now = [], ""
    for code in codes:
        now += code
        if code in "DKUA" and code:
            out.append(now)
            now = ""
    if now:
        out[-1] += now
    assert len(out) == rows
    return out


@lru_cache(1 << 15)
def whole(tags: str) -> tuple[list[str], int]:
    """Codes by row, and cost, of a conversation of one block."""
    arcs, prices = lattice(tags, None)
    final = len(arcs) - 1
    auction(arcs, prices, EMPTY, final)
    return by_row(traced(arcs, prices, EMPTY, final), len(tags)), int(prices[EMPTY])


def letters(codes: tuple[str, ...] | list[str] | str) -> str:
    """The audit: initials of the edits."""
    return "".join(codes).translate(str.maketrans("uaUA", "IIRR"))


@lru_cache(1 << 12)
def crossings(tags: str) -> dict[tuple[int, int], tuple[int, tuple[str, ...]]]:
    """Cost and codes of the best path through a block for every two states at its ends that a path connects."""
    out = {}
    for goal in STATES:
        starts = [s for s in STATES if s in USEFUL[goal]]
        if goal == SYSTEM and not any(INITIALS[TAGS.index(t) // 3] == "s" and TAGS.index(t) % 3 < 2 for t in tags):
            starts = [SYSTEM]
        arcs, prices = lattice(tags, goal)
        for start in starts:
            auction(arcs, prices, start, 4 * len(tags) + goal)
        for start in starts:
            out[start, goal] = int(prices[start]), traced(arcs, prices, start, 4 * len(tags) + goal)
    return out


Table = list[int]  # 16 costs by start and end (-1: no path), then the 16 places of the paths among those of their start


def table_of(tags: str) -> Table:
    found = crossings(tags)
    costs = [found[s, e][0] if (s, e) in found else -1 for s in STATES for e in STATES]
    places = []
    for s in STATES:
        order = sorted((letters(found[s, e][1]), e) for e in STATES if (s, e) in found)
        place = {e: k for k, (_, e) in enumerate(order)}
        places += [place.get(e, -1) for e in STATES]
    return costs + places


def composed(parts: list[Table], start: int) -> list[tuple[int, int, list[int]] | None]:
    """For each end state the best way from ``start`` through consecutive tables: its cost, its place in the order of
    letters, and the state after each table. Ways that part at a table are ordered by it: no path through a table is
    a beginning of another one."""
    now: list[tuple[int, int, list[int]] | None] = [(0, 0, []) if s == start else None for s in STATES]
    for part in parts:
        found = []
        for end in STATES:
            ways = [(now[s][0] + part[4 * s + end], (now[s][1], part[16 + 4 * s + end]), now[s][2] + [end])
                    for s in STATES if now[s] and part[4 * s + end] >= 0]
            found.append(min(ways) if ways else None)
        order = {w[1]: k for k, w in enumerate(sorted((w for w in found if w), key=lambda w: w[1]))}
        now = [w and (w[0], order[w[1]], w[2]) for w in found]
    return now


def joined(parts: list[Table]) -> Table:
    ways = [composed(parts, s) for s in STATES]
    return [w[0] if w else -1 for row in ways for w in row] + [w[1] if w else -1 for row in ways for w in row]


def last_state(top: Table) -> int:
    """Where the best path of a conversation stands before its closing rows."""
    return min((top[e] + INSERT * len(CLOSING[e]), top[16 + e], e) for e in STATES if top[e] >= 0)[2]


# --- tables -----------------------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``: rows as the test of the operator spoils them, by the remainder r of
    ``crc32(conv_id:turn)`` by 20: 0 is dropped, 1 loses its text, 2 its full stops, exclamation and question marks,
    3 is there twice, 4 becomes the user's. A null role or text is one space, so is a null in the hashed text."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(r == 1, F.lit("")).when(r == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(r == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"),
        F.when(r == 0, F.array().cast("array<int>")).when(r == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    ).select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _key(conv_id: Column) -> Column:
    """The conversation, null being one of its own."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def placed(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` as a written table ``(key, turn, role, text, digest, pos)``: ``pos`` counts all rows in the
    order of (conversation, turn, digest), nulls first. Range partitions share out a long conversation."""
    spark = rows.sparkSession
    one = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    keyed = rows.select(_key(F.col("conv_id")).alias("key"), "turn", "role", "text", F.unhex(F.md5(one.cast("binary"))).alias("digest"))
    order = ["key", "turn", "digest"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = tables.materialize(keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = done.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per partition
    bases, so_far = [], 0
    for size in sizes:
        bases.append((size["part"], so_far))
        so_far += size["n"]
    base = spark.createDataFrame(bases, "part long, base long")
    return done.withColumn("part", part).join(F.broadcast(base), "part").select(
        "key", "turn", "role", "text", "digest", (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("pos"))


def marked(rows: DataFrame) -> DataFrame:
    """A written table ``(key, pos, turn, fault, tag)`` of :func:`placed` rows: ``fault`` is the first that holds of ``blank``, ``duplicate`` (role
    and text seen earlier in the conversation) and ``truncated``, else null."""
    again = rows.groupBy("key", "digest").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    end = F.rtrim("text", F.lit(SPACE))
    fault = (F.when(end == "", "blank").when(F.col("pos") > F.col("first"), "duplicate")
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated"))
    kind = F.when(fault.isNull(), 0).when(fault == "truncated", 1).otherwise(2)
    found = F.instr(F.lit(INITIALS[:3]), F.left("role", F.lit(1)))
    initial = F.when((F.length("role") > 0) & (found > 0), found - 1).otherwise(3)
    return tables.materialize(rows.join(again, ["key", "digest"], "left").select(
        "key", "pos", "turn", fault.alias("fault"), F.substring(F.lit(TAGS), initial * 3 + kind + 1, F.lit(1)).alias("tag")))


def _lists(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


TABLE = "key string, node long, table array<int>"
ENDS = "key string, node long, enters int, leaves int"


def _table_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, node, tags in _lists(batches, "key", "node", "tags"):
        yield pa.RecordBatch.from_pydict({"key": key, "node": node, "table": pa.array([table_of(t) for t in tags], pa.list_(pa.int32()))})


def _join_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, node, parts in _lists(batches, "key", "node", "parts"):
        found = [joined([p["table"] for p in own]) for own in parts]
        yield pa.RecordBatch.from_pydict({"key": key, "node": node, "table": pa.array(found, pa.list_(pa.int32()))})


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, node, table in _lists(batches, "key", "node", "table"):
        yield pa.RecordBatch.from_pydict({
            "key": key, "node": node, "enters": pa.array([EMPTY] * len(key), pa.int32()), "leaves": pa.array([last_state(t) for t in table], pa.int32())})


def _share_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, parts, enters, leaves in _lists(batches, "key", "parts", "enters", "leaves"):
        out: dict[str, list] = {"key": [], "node": [], "enters": [], "leaves": []}
        for k, own, first, last in zip(key, parts, enters, leaves):
            after = composed([p["table"] for p in own], first)[last][2]
            for p, a, b in zip(own, [first, *after], after):
                for name, value in zip(out, (k, p["node"], a, b)):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.string() if n == "key" else pa.int64() if n == "node" else pa.int32()) for n, v in out.items()})


CODES = "key string, node long, start long, codes array<string>, audit string, cost long, illegal long"


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of blocks, between the states given, or of whole conversations where none are."""
    for key, node, start, tags, previous, enters, leaves, ends in _lists(batches, "key", "node", "start", "tags", "previous", "enters", "leaves", "ends"):
        codes, audits, costs, illegal = [], [], [], []
        for own, before, first, last, closes in zip(tags, previous, enters, leaves, ends):
            if first is None:
                rows, cost = whole(own)
            else:
                cost, path = crossings(own)[first, last]
                rows = by_row(path, len(own))
                if closes:
                    rows[-1] += CLOSING[last]
                    cost += INSERT * len(CLOSING[last])
            initials = "".join(INITIALS[TAGS.index(t) // 3] for t in (before or "") + own)
            codes.append(rows)
            audits.append(letters(rows))
            costs.append(cost)
            illegal.append(sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1)))
        yield pa.RecordBatch.from_pydict({
            "key": key, "node": node, "start": start, "codes": pa.array(codes, pa.list_(pa.string())), "audit": pa.array(audits, pa.string()),
            "cost": pa.array(costs, pa.int64()), "illegal": pa.array(illegal, pa.int64())})


def _grouped(level: DataFrame) -> DataFrame:
    """At most FAN_IN neighbouring nodes of a conversation in one row."""
    return level.groupBy("key", F.floor(F.col("node") / FAN_IN).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "table"))).alias("parts"))


def block_edits(marks: DataFrame, block: int = BLOCK) -> DataFrame:
    """A written table ``(key, node, start, codes, audit, cost, illegal)`` of the blocks of :func:`marked` conversations: the codes of the
    rows from position ``start`` on, and what they come to."""
    number = F.floor(F.col("pos") / block)
    blocks = marks.groupBy("key", number.alias("number")).agg(
        F.min("pos").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "").alias("tags"))
    blocks = tables.materialize(blocks)
    spans = blocks.groupBy("key").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    blocks = blocks.join(spans, "key").select(
        "key", (F.col("number") - F.col("low")).alias("node"), "start", "tags", (F.col("number") == F.col("high")).alias("ends"), (F.col("high") > F.col("low")).alias("long"))
    nothing = F.lit(None).cast("int")
    short = blocks.filter("not long").select("*", F.lit(None).cast("string").alias("previous"), nothing.alias("enters"), nothing.alias("leaves"))
    long = tables.write(blocks.filter("long"))
    if not long.rows:
        return tables.materialize(short.mapInArrow(_codes, CODES))
    levels = [tables.materialize(long.df.select("key", "node", "tags").mapInArrow(_table_blocks, TABLE))]
    while not levels[-1].filter("node > 0").isEmpty():
        levels.append(tables.materialize(_grouped(levels[-1]).mapInArrow(_join_tables, TABLE)))
    ends = levels[-1].mapInArrow(_choose, ENDS)
    for level in reversed(levels[:-1]):
        ends = tables.materialize(_grouped(level).join(ends, ["key", "node"]).mapInArrow(_share_out, ENDS))
    before = long.df.select("key", (F.col("node") + 1).alias("node"), F.right("tags", F.lit(1)).alias("previous"))
    solved = long.df.join(before, ["key", "node"], "left").join(ends, ["key", "node"]).select(*short.columns)
    return tables.materialize(short.unionByName(solved).mapInArrow(_codes, CODES))


def repaired(rows: DataFrame, edits: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(key, pos, step, role, text)``: the conversations of :func:`placed` rows after their edits, in order of ``pos``, ``step``."""
    first = edits.select("key", "start", "codes", F.floor(F.col("start") / block).alias("number"))
    # within a row's codes, insertions that follow its letter come at the very end of a conversation
    each = rows.select("key", "pos", "role", "text", F.floor(F.col("pos") / block).alias("number")).join(first, ["key", "number"]).select(
        "key", "pos", "role", "text", F.posexplode(F.split(F.element_at("codes", (F.col("pos") - F.col("start")).cast("int") + 1), "")).alias("step", "code"))
    given = F.lower("code")
    return each.filter("code NOT IN ('D', '')").select(
        "key", "pos", "step", F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines as they pass, in bounded memory."""
    own, state = None, hashlib.sha256()
    for keys, roles, texts in _lists(batches, "key", "role", "text"):
        done: list[tuple[str, str]] = []
        for key, role, text in zip(keys, roles, texts):
            if key != own:
                if own is not None:
                    done.append((own, state.hexdigest()))
                own, state = key, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if done:
            yield pa.RecordBatch.from_pydict({"key": [k for k, _ in done], "repaired_sha256": [d for _, d in done]})
    if own is not None:
        yield pa.RecordBatch.from_pydict({"key": [own], "repaired_sha256": [state.hexdigest()]})


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marked rows, edits by block and repaired rows of ``rows(conv_id, turn, role, text)``, none of the last two null.

    Rows stand in the order of their turn, nulls first, ties by the digest of role and text. The repaired roles read
    ``(s?(ua)+)?`` by their initials; a role without one, or with another, is never kept. Other columns are ignored; an
    empty table gives empty results.
    """
    lined = placed(rows)
    marks = marked(lined)
    edits = block_edits(marks, block)
    return marks, edits, repaired(lined, edits, block)


def structure_repair(conversations: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``: one row for every ``conv_id`` of the
    table, after its rows were :func:`damaged` and repaired.

    A null ``conv_id`` is a conversation of its own, null turns come first, a null role or text is one space; rows that
    repeat a turn are ordered by a digest. Conversations without a row left have zeros, an empty audit and the digest of nothing. Other
    columns are ignored; an empty table gives an empty result. The audit and the digest of a conversation are one
    value each, so its blocks' letters meet in one row, and one task reads its repaired lines, as a stream.
    """
    marks, edits, fixed = repair(damaged(conversations))
    fault = lambda name: F.count_if(F.col("fault") == name).alias(name)
    counts = marks.groupBy("key").agg(
        fault("blank"), fault("duplicate"), fault("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    totals = edits.groupBy("key").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    digests = fixed.repartition("key").sortWithinPartitions("key", "pos", "step").select("key", "role", "text").mapInArrow(
        _digests, "key string, repaired_sha256 string")
    every = conversations.select("conv_id", _key(F.col("conv_id")).alias("key")).distinct()
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, "key", "left").join(totals, "key", "left").join(digests, "key", "left").select(
        "conv_id", *[number(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

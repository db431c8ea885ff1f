"""Operator 12: repair of conversations with the cheapest audit of edits.

Rows of a conversation are judged in order (blank, repeated, cut off), and edited at least cost into a system
row or none followed by exchanges of user and assistant: Keep costs 0, Rerole 2, Delete 3, Insert 2, and an undeleted
cut-off row 1 more. Of equally cheap audits (the edits' initials in order) the least by ASCII is taken.

The search runs over row and role state. A state keeps its best prefix as a node linked to the prefix that it extends,
with ancestors at powers of two and a rolling hash of the whole prefix, so prefixes share what they have in common.
Equally dear prefixes compare by the longest common prefix, found by lifting both nodes over ancestors while their hashes
differ; nodes of equal hash that are not the same node are compared edit by edit. A prefix determines the state it leads to, so of
two equally dear prefixes of a state none begins the other, and the lesser one stays the lesser whatever follows.

A conversation is searched in chunks of CHUNK rows: the least costs from each chunk's end come first (a matrix of states a chunk),
then each chunk's audit towards them. So the search holds nodes of one chunk, and of a conversation a letter a row;
texts pass by in order, one at a time. The hash of a repaired conversation is sequential by its definition, so a
conversation's texts pass through one task, streamed from sorted rows.

Defined results: null roles and texts are one space; rows come by turn (nulls first), rows of one turn by role, then by the SHA-256 of their text; the states
see a role's first character, and one other than s, u, a can't be kept; a null id is a conversation of its own;
a conversation without rows has no faults, no edits and the hash of the empty text; an empty table gives an empty one; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .ordered import group_key, numbered

CHUNK = 4096
SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States: nothing yet, after the system row, after a user, after an assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
#: What a user or assistant row may follow, and the state that it leads to.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {("s", START): SYSTEM} | {("u", s): USER for s in (START, SYSTEM, ASSISTANT)} | {("a", USER): ASSISTANT}
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Node:
    """A prefix of edits: the last edit, what stands before it, ancestors 1, 2, 4, ... edits up, a hash of all edits."""

    __slots__ = ("edit", "up", "depth", "hash")

    def __init__(self, edit: str, parent: Node | None):
        self.edit, self.up = edit, []
        self.depth = parent.depth + 1 if parent else 0
        self.hash = (parent.hash * BASE + ord(edit)) % MODULUS if parent else 0
        k = 0
        while parent is not None:
            self.up.append(parent)
            parent = parent.up[k] if k < len(parent.up) else None
            k += 1

    def at(self, depth: int) -> Node:
        node, k = self, 0
        over = self.depth - depth
        while over:
            if over & 1:
                node = node.up[k]
            over >>= 1
            k += 1
        return node

    def text(self) -> str:
        out, node = [], self
        while node.up:
            out.append(node.edit)
            node = node.up[0]
        return "".join(reversed(out))


def _same(x: Node, y: Node) -> bool:
    """Whether two prefixes of one depth are equal: the same node, or equal hashes and, as those may collide, equal edits."""
    if x is y:
        return True
    return x.hash == y.hash and x.text() == y.text()


def less(x: Node, y: Node) -> bool:
    """Whether x's edits come before y's by ASCII: by the edits after their longest common prefix."""
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if _same(a, b):
        return x.depth < y.depth
    for k in range(max(len(a.up), 1) - 1, -1, -1):
        if k < len(a.up) and not _same(a.up[k], b.up[k]):
            a, b = a.up[k], b.up[k]
    return a.edit < b.edit


def _inserted(cost: list, nodes: list | None) -> None:
    """Rows may be inserted before the next one, as far as that is cheaper or as cheap and less."""
    for _ in range(2):
        for s in range(4):
            t = NEXT[s]
            if cost[s] + INSERT <= cost[t] and cost[s] < FAR:
                _offer(cost, nodes, t, cost[s] + INSERT, "I", nodes[s] if nodes else None)


def _offer(cost: list, nodes: list | None, state: int, dear: int, edit: str, parent: Node | None) -> None:
    if nodes is None:
        cost[state] = min(cost[state], dear)
    elif dear <= cost[state]:
        node = Node(edit, parent)
        if dear < cost[state] or nodes[state] is None or less(node, nodes[state]):
            cost[state], nodes[state] = dear, node


def _walk(codes: str, start: int, traced: bool = True) -> tuple[list, list | None]:
    """Least cost from a state to each state over rows, and the least of the cheapest audits. Rows are inserted before rows only."""
    cost = [FAR] * 4
    cost[start] = 0
    nodes: list | None = [None] * 4 if traced else None
    if traced:
        nodes[start] = Node("", None)
    for c in codes:
        _inserted(cost, nodes)
        new, made = [FAR] * 4, [None] * 4 if traced else None
        low = c.lower()
        for s in range(4):
            if cost[s] >= FAR:
                continue
            parent = nodes[s] if traced else None
            _offer(new, made, s, cost[s] + DELETE, "D", parent)
            if c != "x":
                more = cost[s] + CUT_OFF * (c != low)
                if (low, s) in KEPT:
                    _offer(new, made, KEPT[low, s], more + KEEP, "K", parent)
                _offer(new, made, NEXT[s], more + REROLE, "R", parent)
        cost, nodes = new, made
    return cost, nodes


#: Least cost from each state to the end when no row is left, and the edits for it.
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}


@lru_cache(100_000)
def _matrix(codes: str) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(_walk(codes, s, False)[0]) for s in range(4))


@lru_cache(100_000)
def _towards(codes: str, start: int, left: tuple[int, ...]) -> tuple[str, int]:
    """The least of the cheapest audits from a state over a chunk, given what each of its end states still costs; and its end state."""
    cost, nodes = _walk(codes, start)
    best = min(cost[t] + left[t] for t in range(4))
    last = None
    for t in range(4):
        if cost[t] + left[t] == best and (last is None or less(nodes[t], nodes[last])):
            last = t
    return nodes[last].text(), last


def audit(chunks: list[str]) -> tuple[int, list[str], str]:
    """(cost, edits of each chunk, edits after the last row) of a conversation whose rows are given as letters.

    A letter is s, u, a or o (another role), upper case if the row is cut off, or x for a row that must go.
    """
    left = [tuple(ENDS[s][0] for s in range(4))]
    for codes in reversed(chunks):
        m, after = _matrix(codes), left[-1]
        left.append(tuple(min(m[s][t] + after[t] for t in range(4)) for s in range(4)))
    left.reverse()
    state, out = START, []
    for codes, after in zip(chunks, left[1:], strict=True):
        edits, state = _towards(codes, state, after)
        out.append(edits)
    return left[0][START], out, ENDS[state][1]


def _judged(rows: DataFrame) -> DataFrame:
    """rows (g, turn, role, text), numbered, with fault (blank, duplicate, truncated or null), code (a letter for the search) and bad (the pair of initials with the row before is none that may be)."""
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    laid = numbered(rows, "g", [F.col("turn"), F.col("role"), F.col("digest")], "turns")
    first = laid.groupBy("g", "role", "digest").agg(F.min("pos").alias("_pos")).select(F.col("g").alias("_g"), "_pos")
    met = laid.join(first, (F.col("g") == F.col("_g")) & (F.col("pos") == F.col("_pos")), "left")
    last = F.regexp_extract("text", f"([^{SPACE}])[{SPACE}]*\\z", 1)
    fault = F.when(last == "", F.lit("blank")).when(F.col("_pos").isNull(), F.lit("duplicate")).when(~last.isin(".", "!", "?"), F.lit("truncated"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("o"))
    code = F.when(F.col("fault").isin("blank", "duplicate"), F.lit("x")).when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    return met.withColumns({"fault": fault, "initial": initial}).withColumn("code", code).drop("_g", "_pos", "digest")


def _found(batches):
    """(g, chunks of letters) to the edits of each chunk, and those after the last row with the last chunk."""
    for b in batches:
        out = []
        for g, chunks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            cost, edits, after = audit(chunks)
            out += [(g, k, cost, e, after if k == len(chunks) - 1 else "") for k, e in enumerate(edits)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["g", "chunk", "cost", "edits", "after"])


ROLES = {USER: "user", ASSISTANT: "assistant"}


class _Writer:
    """Writes one conversation's repaired rows, as they come, into a hash."""

    def __init__(self):
        self.sha, self.state, self.some = hashlib.sha256(), START, False

    def put(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.some else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.put(ROLES[self.state], "")

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "K":
            self.state = KEPT[role[:1], self.state]
            self.put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.put(ROLES[self.state], text)


def _written(batches):
    """Sorted by g, pos, edits first: the rows with their chunk's edits before them, to (g, repaired_sha256)."""
    now, writer, edits, at, after = None, None, "", 0, ""
    done = []

    def end():
        for _ in after:
            writer.insert()
        done.append((now, writer.sha.hexdigest()))

    for b in batches:
        for g, edits_, after_, role, text in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
            if g != now:
                if writer:
                    end()
                now, writer = g, _Writer()
            if edits_ is not None:
                edits, at, after = edits_, 0, after_
                continue
            while edits[at] == "I":
                writer.insert()
                at += 1
            writer.row(edits[at], role, text)
            at += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["g", "repaired_sha256"])
            done = []
    if writer:
        end()
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["g", "repaired_sha256"])


def repaired(rows: DataFrame, ids: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """For each id of ids (column conv_col): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    common.bounded_batches(spark)
    rows = rows.select(group_key(F.col(conv_col)).alias("g"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    judged = common.stored(_judged(rows), "judged")
    # a chunk's rows, with the initial of the row before each, and of the last row for the next chunk
    chunk = F.floor(F.col("pos") / CHUNK).alias("chunk")
    members = F.sort_array(F.collect_list(F.struct("pos", "code", "initial")))
    parts = judged.groupBy("g", chunk).agg(
        members.alias("m"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    )
    illegal = lambda m: F.size(F.filter(F.sequence(F.lit(1), F.size(m)), lambda k: (k < F.size(m)) & ~F.concat(F.get(m, k - 1)["initial"], F.get(m, k)["initial"]).isin("su", "ua", "au")))
    parts = parts.select("g", "chunk", "low", "high", "blank", "duplicate", "truncated", F.array_join(F.transform("m", lambda x: x["code"]), "").alias("codes"), common.let(F.col("m"), illegal).cast("long").alias("illegal"), F.element_at("m", 1)["initial"].alias("head"), F.element_at("m", -1)["initial"].alias("tail"))
    parts = common.stored(parts, "chunks")
    order = Window.partitionBy("g").orderBy("chunk")  # a row for CHUNK rows
    seam = F.concat(F.lag("tail").over(order), F.col("head"))
    counts = parts.withColumn("illegal", F.col("illegal") + F.when(seam.isNotNull() & ~seam.isin("su", "ua", "au"), 1).otherwise(0))
    counts = counts.groupBy("g").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")], F.min("low").alias("low"), F.max("high").alias("high"))
    turns = judged.where("turn IS NOT NULL").select("g", "turn").distinct().groupBy("g").agg(F.count("*").alias("turns"))
    letters = parts.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("chunk", "codes"))).alias("c")).select("g", F.transform("c", lambda x: x["codes"]).alias("chunks"))
    edits = common.stored(letters.mapInArrow(_found, "g string, chunk long, cost long, edits string, after string"), "edits")
    audits = edits.groupBy("g").agg(F.first("cost").alias("cost"), F.sort_array(F.collect_list(F.struct("chunk", F.concat("edits", "after").alias("e")))).alias("e"))
    audits = audits.select("g", "cost", F.array_join(F.transform("e", lambda x: x["e"]), "").alias("audit"))
    lines = edits.select("g", (F.col("chunk") * CHUNK).alias("pos"), F.lit(0).alias("kind"), "edits", "after", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    lines = lines.unionByName(judged.select("g", "pos", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("edits"), F.lit(None).cast("string").alias("after"), "role", "text"))
    lines = lines.repartition("g").sortWithinPartitions("g", "pos", "kind").select("g", "edits", "after", "role", "text")
    hashes = lines.mapInArrow(_written, "g string, repaired_sha256 string")
    every = ids.select(F.col(conv_col)).distinct().withColumn("_id", group_key(F.col(conv_col)))
    out = every.join(counts.join(turns, "g", "left").join(audits, "g").join(hashes, "g"), F.col("_id") == F.col("g"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return out.select(conv_col, gaps, *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of op12, by crc32 of `conv_id:turn` modulo 20 (a null is one space there): row dropped, text emptied, end marks gone, row repeated, role user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("kind")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return made.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_")).drop("_")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.documents(spark, sf_dir, "conversations")
    return repaired(damaged(rows), rows)

"""Operator 11: a Merkle manifest of a dataset, with proofs by checkpoint and recompute.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a group, in the order of
their ids, make a tree of ARITY children a node, whose last run may be shorter; the roots of the groups, in
the order of the groups (null first, by bytes), make a tree of the same kind, whose root is the manifest's.
Only every STRIDE-th level is written. A proof is extracted from the top down: an aligned subtree of
ARITY ** STRIDE stored nodes makes its missing levels again, emits the siblings of each of its nodes, and
drops the levels; the path above the subtree, got the same way, is appended.

The work of a row is bounded by a subtree, never by a group: places in the order come from ranges
(ordered.numbered), so a source of a third of all rows is spread like the others.

Defined results: a null field is `-` (and so differs from an empty text); ids ascend, null first, and rows
that repeat an id come by their leaves (equal rows in any order: their leaves are equal, their proofs
are those of their places); a row each time for repeated rows; a single leaf is its group's root, and a single group's root the
manifest's (its proof has no siblings: the hash of nothing); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .ordered import group_key, numbered

ARITY = 3
#: Levels from one written level to the next: a subtree between them has ARITY ** STRIDE nodes at most.
STRIDE = 5
BLOCK = ARITY**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(fields: list[Column]) -> Column:
    """The leaf of a row: each field as `-` or length in bytes, colon, value."""
    of = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return sha(F.concat(*map(of, fields)))


def _risen(level: Column) -> Column:
    """The level above: every ARITY nodes become one."""
    last = F.floor((F.size(level) - 1) / ARITY).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: sha(F.array_join(F.slice(level, i * ARITY + 1, F.lit(ARITY)), "")))


def _depth() -> Column:
    """Levels from a written level of n nodes to the next: STRIDE, or as many as one node needs."""
    return reduce(lambda c, k: c.when(F.col("n") <= ARITY**k, F.lit(k)), range(1, STRIDE), F.when(F.col("n") <= 1, F.lit(0))).otherwise(F.lit(STRIDE))


def _blocks(nodes: DataFrame) -> DataFrame:
    """A row for each aligned subtree: g, block, n, members (pos, h and what the nodes carry, by pos), depth."""
    carried = [c for c in nodes.columns if c not in ("g", "n", "pos", "h")]
    members = F.sort_array(F.collect_list(F.struct("pos", "h", *carried))).alias("members")
    return nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.first("n").alias("n"), members).withColumn("depth", _depth())


def _h(members: str = "members") -> Column:
    return F.transform(members, lambda m: m["h"])


def build(leaves: DataFrame) -> list[DataFrame]:
    """The written levels (g, pos, n, h) of each group's tree, from the leaves (which may carry more columns) to the roots, where n is 1 everywhere."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        top = F.aggregate(F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>")), _h(), lambda acc, _: _risen(acc))
        risen = _blocks(levels[-1].select("g", "pos", "n", "h")).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.element_at(top, 1).alias("h"))
        levels.append(common.stored(risen, "merkle-level"))
        most = -(-most // BLOCK)
    return levels


def _within(i: Column, levels: Column) -> Column:
    """The siblings of node i at each level of its subtree, as (left, right)."""

    def at(level: Column, j: Column) -> Column:
        place = F.floor(i / F.pow(F.lit(float(ARITY)), j)).cast("int")
        own = place % ARITY
        first = place - own + 1
        return F.struct(F.array_join(F.slice(level, first, own), "").alias("left"), F.array_join(F.slice(level, first + own + 1, ARITY - 1 - own), "").alias("right"))

    return F.transform(levels, at)


def paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """For each leaf: g, what it carries, path (its siblings at each level, root last), and above's further columns.

    above: (g, pos, path, ...) of the roots. Levels that are not written are made again within each subtree, and dropped.
    """
    for nodes in reversed(levels[:-1]):
        upper = above.withColumnsRenamed({"g": "_g", "pos": "_block", "path": "_path"})
        more = [c for c in upper.columns if c not in ("_g", "_block", "_path")]
        made = F.aggregate(
            F.when(F.col("depth") > 1, F.sequence(F.lit(2), F.col("depth"))).otherwise(F.array().cast("array<int>")),
            F.when(F.col("depth") > 0, F.array(_h())).otherwise(F.array().cast("array<array<string>>")),
            lambda acc, _: F.concat(acc, F.array(_risen(F.element_at(acc, -1)))),
        )
        met = _blocks(nodes).withColumn("made", made).join(upper, (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_block")))
        each = met.select("g", "made", "_path", *more, F.posexplode("members").alias("_i", "_m"))
        carried = [c for c in nodes.columns if c not in ("g", "n", "pos", "h")]
        above = each.select("g", F.col("_m.pos").alias("pos"), *[F.col(f"_m.{c}").alias(c) for c in carried], *[c for c in more if c not in carried], F.concat(_within(F.col("_i"), F.col("made")), "_path").cast(PATH).alias("path"))
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda acc, p: sha(F.concat(p["left"], acc, p["right"])))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, altered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: id, leaf, subroot, root, path, altered_leaf (the leaf with the given columns instead; null where it is the same)."""
    named = [F.col(f"`{c}`") for c in fields]
    leaf = leaf_of(named)
    other = leaf_of([(altered or {}).get(c, x) for c, x in zip(fields, named, strict=True)])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), group_key(F.col(f"`{group_col}`")).alias("g"), leaf.alias("h"), other.alias("t"))
    rows = rows.withColumn("t", F.when(F.col("t") != F.col("h"), F.col("t")))
    leaves = numbered(rows, "g", [F.col("id"), F.col("h")], "merkle-leaves")
    levels = build(leaves)
    spark = docs.sparkSession
    roots = levels[-1] if len(levels) > 1 else leaves.select("g", "pos", "n", "h")
    ordered = numbered(roots.select(F.lit("").alias("g"), F.col("g").alias("of"), "h"), "g", [F.col("of")], "merkle-groups")
    over = build(ordered)
    root = over[-1].select("h").first()
    # from the root down to the groups' roots, and from these to the leaves
    empty = F.array().cast(PATH).alias("path")
    tops = paths([ordered.withColumn("subroot", F.col("h")), *over[1:]], over[-1].select("g", "pos", empty)) if len(over) > 1 else ordered.select("of", F.col("h").alias("subroot"), empty)
    tops = common.stored(tops.select(F.col("of").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot"), "merkle-tops")
    if len(levels) > 1:
        out = paths([leaves.withColumn("leaf", F.col("h")), *levels[1:]], tops)
    else:
        out = leaves.withColumnsRenamed({"h": "leaf", "g": "_own"}).drop("pos").join(tops, F.col("_own") == F.col("g"))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root["h"] if root else None).cast("string").alias("root"), "path", F.col("t").alias("altered_leaf"))


def tampered(doc_id: Column) -> Column:
    """Whether a row is tampered with in op11: 2 divides crc32 of the id as text (a null id counts as the empty text)."""
    return common.crc_mod(doc_id, 2) == 0


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    text = F.when(tampered(F.col("doc_id")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = manifest(docs, altered={"text": text})
    out = found.select("doc_id", "leaf", "subroot", "root", sha(siblings(F.col("path"))).alias("proof_sha256"), folded(F.coalesce("altered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""A manifest of a dataset as a tree of digests, and proofs read from its records.

Leaves are digests of rows, numbered per group. Every 8 consecutive nodes become the digest of
their digests, until one is left: the group's subroot. Subroots, in the groups' order, become
the root in the same way. The store holds records (digest, children), level by level. A leaf is
requested by its rank: the request goes down from the root, reads the record of the digest it
has reached, takes the child that the next digit of the rank names, and keeps the children it
leaves aside. Read backwards, what it kept is the proof.

Requests with the same way down travel as one row until they part, so that the rows of a level
are at most its nodes, and only the last step has a row per leaf.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import settled
from .common import lower_ascii

FANOUT = 8
DIGIT_BITS = 3
SHELF_BITS = 12
"""Records are stored by digest within shelves of 4,096 neighbouring nodes. A digest that many
equal rows share is then kept once per shelf, and no shelf has more requests than nodes."""
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts on end."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return digest(*[encoded(v) for v in values])


@dataclass(frozen=True)
class Tree:
    """A forest of digest trees over numbered leaves.

    `roots` has (group columns, digest, leaves) per tree; `levels` holds, from the lowest up, the
    records (group columns, shelf, digest, children) of each level above the leaves.
    """

    groups: list[str]
    roots: DataFrame
    levels: list[DataFrame]


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame
    """The rows of the leaves with `rank`, their place in their group from 0."""
    group: str
    trees: Tree
    """One tree per group."""
    top: Tree
    """The tree over the subroots, its leaves in `groups`."""
    groups: DataFrame
    """Per group its subroot (`digest`), number of leaves (`leaves`) and rank among the groups."""


def _same(a: str, b: str, columns: list[str]) -> Column:
    match = F.lit(True)
    for c in columns:
        match = match & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return match


def build(leaves: DataFrame, groups: list[str], label: str) -> Tree:
    """Trees over leaves (group columns, rank, digest), each level written as it is made.

    A node knows how many leaves its tree has, and so whether it is the last one. A level
    costs one exchange of its nodes' digests; runs of nodes never exceed 8.
    """
    counts = settled(leaves.groupBy(*groups).agg(F.count("*").alias("leaves")), f"{label}-counts")
    most = counts.agg(F.max("leaves")).first()[0] or 0
    nodes = leaves.alias("n").join(counts.alias("c"), _same("n", "c", groups)).select(
        *[f"n.{g}" for g in groups], F.col("n.rank").alias("at"), "n.digest", "c.leaves"
    )
    nodes = settled(nodes, f"{label}-0")
    roots, levels, covered = nodes.filter("leaves = 1"), [], 1
    while covered < most:
        open_nodes = nodes.filter(F.col("leaves") > covered)
        parents = open_nodes.groupBy(*groups, "leaves", F.shiftright("at", DIGIT_BITS).alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run")
        )
        children = F.col("run.digest").alias("children")
        parents = parents.select(*groups, F.col("parent").alias("at"), children, "leaves")
        nodes = settled(parents.withColumn("digest", digest(F.array_join("children", ""))), f"{label}-{len(levels) + 1}")
        levels.append(nodes.select(*groups, F.shiftright("at", SHELF_BITS).alias("shelf"), "digest", "children"))
        covered *= FANOUT
        done = nodes.filter((F.col("leaves") <= covered) & (F.col("leaves") > covered // FANOUT))
        roots = roots.unionByName(done.drop("children"))
    return Tree(groups, roots.select(*groups, "digest", "leaves"), levels)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "lang", carried: list[Column] = ()) -> Manifest:
    """The trees of all rows, a tree per value of `group` and one over their subroots.

    Leaves ascend by `key` in their group, equal keys by their digests; groups ascend by their
    bytes. Nulls are values of their own and come first. `carried` columns stay with the leaves.
    Texts are hashed where they are read and move no further. An empty table has no trees.
    """
    rows = docs.select(
        F.col(key).alias("key"), F.col(group).cast("string").alias("group"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"), *carried,
    )
    leaves = number_rows(rows, ["group"], [F.col("key"), F.col("digest")], "number")
    leaves = settled(leaves.withColumn("rank", F.col("number") - 1).drop("number"), "manifest-leaves")
    trees = build(leaves.select("group", "rank", "digest"), ["group"], "manifest")
    groups = number_rows(settled(trees.roots, "manifest-subroots"), [], [F.col("group")], "number")
    groups = settled(groups.withColumn("rank", F.col("number") - 1).drop("number"), "manifest-groups")
    return Manifest(leaves, group, trees, build(groups.select("rank", "digest"), [], "manifest-top"), groups)


def _descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request (group columns, rank, more) with its leaf's digest `found` and its `path`.

    `starts` holds (group columns, digest, leaves, path, more) at the roots asked for. A segment
    of the path has the digit taken (`digit`) and the children left aside (`others`), root first.
    """
    groups = tree.groups
    along = [*groups, *[c for c in starts.columns if c not in (*groups, "digest", "path")], "path"]
    asked = [c for c in requests.columns if c not in (*groups, "rank")]
    # the nodes of each level that requests pass, by the prefixes of their ranks
    passed = {0: requests}
    for level in range(1, len(tree.levels) + 1):
        prefix = F.shiftright("rank", DIGIT_BITS if level < 2 else DIGIT_BITS * (level - 1)).alias("rank")
        nodes = passed[min(level - 1, 1)].select(*groups, prefix).distinct()
        passed[level] = settled(nodes, "requests") if level == 1 else nodes
    height = sum((F.col("leaves") > FANOUT**k).cast("int") for k in range(len(tree.levels))) if tree.levels else F.lit(0)
    starts = starts.withColumn("height", height).withColumn("rank", F.lit(0).cast("long"))
    here = starts.limit(0)
    for level in range(len(tree.levels), 0, -1):
        here = here.unionByName(starts.filter(F.col("height") == level))
        records = tree.levels[level - 1].dropDuplicates([*groups, "shelf", "digest"])
        held = (F.shiftright("f.rank", SHELF_BITS) == F.col("r.shelf")) & (F.col("f.digest") == F.col("r.digest"))
        opened = here.alias("f").join(records.alias("r"), _same("f", "r", groups) & held).select(
            *[f"f.{c}" for c in along], F.col("f.rank").alias("node"), "r.children", "f.height"
        )
        digit = F.col("w.rank").bitwiseAND(FANOUT - 1).cast("int")
        below = (F.col("f.node") == F.shiftright("w.rank", DIGIT_BITS)) & (digit < F.size("f.children"))
        here = opened.alias("f").join(passed[level - 1].alias("w"), _same("f", "w", groups) & below)
        segment = F.struct(digit.alias("digit"), F.filter("f.children", lambda _, i: i != digit).alias("others"))
        here = here.select(
            *[f"f.{c}" for c in along[:-1]], F.array_append("f.path", segment).alias("path"), "w.rank",
            F.element_at("f.children", digit + 1).alias("digest"), "f.height", *[f"w.{c}" for c in asked if level == 1],
        )
    alone = starts.filter("height = 0").alias("f").join(requests.alias("w"), _same("f", "w", [*groups, "rank"]))
    columns = [*along, "rank", "digest", *asked]
    alone = alone.select(*[f"f.{c}" for c in along], "w.rank", "f.digest", *[f"w.{c}" for c in asked])
    found = here.select(columns).unionByName(alone) if tree.levels else alone
    return found.withColumnRenamed("digest", "found")


def prove(made: Manifest, requests: DataFrame) -> DataFrame:
    """Proofs of requested leaves: each row of `requests` (group, rank and any more columns) with
    `found` (the leaf's digest in the store), `root`, `subroot` and `proof`.

    A proof lists, from the leaf up to the root, the digit of the node in its run and the digests
    of the run's other nodes. Ranks that the manifest does not have give no row; repeated requests
    are answered each.
    """
    empty = F.expr("CAST(array() AS array<struct<digit:int, others:array<string>>>)").alias("path")
    wanted = requests.select(F.col("group").alias("wanted")).distinct()
    trees = made.groups.join(wanted, F.col("group").eqNullSafe(F.col("wanted")), "left_semi")
    top = made.top.roots.select("digest", "leaves", F.col("digest").alias("root"), empty)
    ways = _descend(made.top, top, trees.select("rank", "group", F.col("leaves").alias("size")))
    starts = ways.select(
        "group", F.col("found").alias("digest"), F.col("size").alias("leaves"), "root", F.col("found").alias("subroot"), "path"
    )
    found = _descend(made.trees, settled(starts, "subroots"), requests)
    return found.withColumn("proof", F.reverse("path")).drop("path", "leaves")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""

    def step(node: Column, segment: Column) -> Column:
        digit, others = segment["digit"], segment["others"]
        left = F.array_join(F.slice(others, F.lit(1), digit), "")
        right = F.array_join(F.filter(others, lambda _, i: i >= digit), "")
        return digest(left, node, right)

    return F.aggregate(proof, leaf, step)


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, from the leaf's run up, each run from left to right."""
    return digest(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), ""))


def verify_documents(docs: DataFrame) -> DataFrame:
    """All documents as leaves, each proven against the root after some were tampered with.

    Gives doc_id, leaf, subroot, root, proof_sha256, folded_root and verified. Where 3 divides the
    CRC-32 of the key, the text is tampered with (A-Z lower-cased) before its leaf is folded with
    the original proof. A null key is never tampered with; null texts stay null. Repeated rows are
    leaves each, in the order of their digests; an empty table gives no rows; extra columns are
    ignored.
    """
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    changed = leaf_digest([lower_ascii(F.col(f)) if f == "text" else F.col(f) for f in FIELDS])
    touched = F.when(F.pmod(crc, F.lit(3)) == 0, changed).alias("touched")
    made = manifest(docs, carried=[touched])
    proven = prove(made, made.leaves.select("group", "rank", "key", "touched"))
    folded = fold(F.coalesce("touched", "found"), F.col("proof"))
    rows = proven.select(
        F.col("key").alias("doc_id"), F.col("found").alias("leaf"), "subroot", "root",
        proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))

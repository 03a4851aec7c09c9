"""Merkle manifest of a dataset, with only every few levels persisted.

Every row is a leaf. Inside a group (source) leaves stand in order of their id, and runs of ``FAN`` nodes become one node of
the next level until one is left, the subroot; the subroots, in order of source, make a tree of their own up to the root.

Only every ``STEP``-th level is written, with the leaves: a node of level k * STEP and its descendants down to the stored level
below are an aligned subtree of at most FAN ** STEP nodes, which is one row. A proof is taken from the top down: for every
stored node the path to the root is known, a subtree's missing interior nodes are made again from its stored nodes, the siblings
on the way are joined to the path, and the interior nodes are let go. A path is as long as the tree is high.

Scale: texts are hashed where they are read and never shuffled. Positions inside a group come from range partitions with
offsets, so a source of any size is spread over tasks; a group of any size is many subtrees of bounded size.

Defined results: a NULL column is ``-``; a NULL source is a group, the first one; a NULL id comes first in its source and is
never tampered with; repeated rows and ids are leaves of their own, in order of their digests; an empty text is ``0:``; an
empty table has no proofs; columns other than the five hashed ones are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import with_rank, with_rank_within
from ..session import durable
from .common import CRC_TABLE, crc32_sql

FAN = 16
STEP = 2
TAMPER_EVERY = 5
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_above(nodes: list[str], size: int, fan: int, step: int) -> list[list[str]]:
    """The levels of one subtree from its stored nodes up: at most ``step`` more, and none above a level that has one node.

    ``size`` is the number of nodes of the whole group at the stored level.
    """
    levels = [nodes]
    while len(levels) <= step and size > 1:
        below = levels[-1]
        levels.append([digest_of(*below[i : i + fan]) for i in range(0, len(below), fan)])
        size = -(-size // fan)
    return levels


def proof_of(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    """Siblings left and right of the node ``at`` and of its ancestors inside the subtree, level by level."""
    path = []
    for level in levels[:-1]:
        low = at - at % fan
        path.append(("".join(level[low:at]), "".join(level[at + 1 : low + fan])))
        at //= fan
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings on its way make."""
    for left, right in path:
        leaf = digest_of(left, leaf, right)
    return leaf


def _value(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[_value(text if c == "text" else F.col(c)) for c in COLUMNS]), 256)


_LEVEL = "grp string, at bigint, digest string, size bigint"
_PATH = "array<struct<left: string, right: string>>"


def _subtrees(nodes: DataFrame, fan: int, step: int) -> DataFrame:
    """``grp, tree, size, nodes``: stored nodes (``grp, at, digest, size``) by aligned subtree, at most fan ** step in a row."""
    tree = F.expr(f"at div {fan**step}").alias("tree")
    held = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda n: n["digest"])
    return nodes.groupBy("grp", tree, "size").agg(held.alias("nodes"))


def stored_levels(leaves: DataFrame, fan: int = FAN, step: int = STEP) -> list[DataFrame]:
    """The levels that are kept, leaves first; the last one has one node in each group (``grp, at, digest, size``)."""

    def top(batches):
        for batch in batches:
            rows = batch.to_pylist()
            tops = [levels_above(r["nodes"], r["size"], fan, step) for r in rows]
            sizes = [r["size"] for r in rows]
            for _ in range(step):
                sizes = [-(-s // fan) for s in sizes]
            columns = [[r["grp"] for r in rows], [r["tree"] for r in rows], [t[-1][0] for t in tops], sizes]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "at", "digest", "size"])

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    kept = [leaves]
    while not kept[-1].filter("size > 1").isEmpty():
        kept.append(durable(_subtrees(kept[-1], fan, step).mapInArrow(top, _LEVEL), "level"))
    return kept


def _joined(trees: DataFrame, paths: DataFrame) -> DataFrame:
    """Subtrees with the path of their top node."""
    above = paths.select(F.col("grp").alias("_grp"), F.col("at").alias("_at"), "path")
    # A path is long and compresses well, so file sizes do not tell whether it may be broadcast.
    return trees.hint("merge").join(above.hint("merge"), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("tree") == F.col("_at"))).drop("_grp", "_at")


def _paths_below(trees: DataFrame, fan: int, step: int) -> DataFrame:
    """``grp, at, path`` of every stored node of the subtrees, which carry the path of their top."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                levels = levels_above(row["nodes"], row["size"], fan, step)
                above = [(p["left"], p["right"]) for p in row["path"]]
                paths = [[{"left": a, "right": b} for a, b in proof_of(levels, i, fan) + above] for i in range(len(row["nodes"]))]
                first = row["tree"] * fan**step
                columns = [[row["grp"]] * len(paths), list(range(first, first + len(paths))), paths]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["grp", "at", "path"])

    kinds = [pa.string(), pa.int64(), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
    return trees.mapInArrow(run, f"grp string, at bigint, path {_PATH}")


def paths_to_top(kept: list[DataFrame], tops: DataFrame, fan: int = FAN, step: int = STEP) -> DataFrame:
    """Paths of the nodes of the second stored level, from those of the groups' tops (``grp, path``), level by level."""
    paths = tops.withColumn("at", F.lit(0).cast("bigint"))
    for level in reversed(kept[1:-1]):
        paths = durable(_paths_below(_joined(_subtrees(level, fan, step), paths), fan, step), "paths")
    return paths


class Manifest:
    """Leaves and stored levels of a dataset: ``leaves`` (with position and size of their source), ``levels``, ``subroots``, ``root``."""

    def __init__(self, docs: DataFrame, fan: int = FAN, step: int = STEP) -> None:
        self.fan, self.step = fan, step
        spoilt = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(TAMPER_EVERY)) == 0
        changed = F.when(spoilt, leaf_digest(F.translate("text", UPPER, LOWER)))
        hashed = docs.select("doc_id", F.col("source").alias("grp"), leaf_digest(F.col("text")).alias("leaf"), changed.alias("changed"))
        placed = with_rank_within(hashed, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")], "at").withColumn("at", F.col("at") - 1)
        placed = durable(placed, "placed")
        sizes = placed.groupBy(F.col("grp").alias("_grp")).agg(F.count("*").alias("size"))
        self.leaves = placed.join(sizes, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")
        self.levels = stored_levels(self.leaves.select("grp", "at", F.col("leaf").alias("digest"), "size"), fan, step)
        # In a tree of one stored level every source has a single leaf.
        self.subroots = durable(self.levels[-1].select("grp", F.col("digest").alias("subroot")), "subroots")
        ranked = with_rank(self.subroots, [F.col("grp").asc_nulls_first()], "at")
        n = self.subroots.count()
        self.order = durable(ranked.select("grp", "subroot", (F.col("at") - 1).alias("at"), F.lit(n).cast("bigint").alias("size")), "order")
        whole = F.lit("").alias("grp")
        self.top_levels = stored_levels(self.order.select(whole, "at", F.col("subroot").alias("digest"), "size"), fan, step)
        found = self.top_levels[-1].select("digest").first()
        self.root = found[0] if found else None

    def group_paths(self) -> DataFrame:
        """``grp, subroot, path``: the way from each subroot to the root."""
        first = F.array().cast(_PATH).alias("path")
        top = self.top_levels[-1].select("grp", first)
        if len(self.top_levels) == 1:
            return self.order.select("grp", "subroot", first)
        paths = paths_to_top(self.top_levels, top, self.fan, self.step)
        below = _paths_below(_joined(_subtrees(self.top_levels[0], self.fan, self.step), paths), self.fan, self.step)
        return self.order.join(below.select("at", "path"), "at").select("grp", "subroot", "path")

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
        fan, step, root = self.fan, self.step, self.root or ""
        groups = durable(self.group_paths(), "groups")
        paths = paths_to_top(self.levels, groups.select("grp", "path"), fan, step)
        kind = dict(self.leaves.dtypes)["doc_id"]
        rows = F.array_sort(F.collect_list(F.struct("at", "doc_id", "leaf", "changed")))
        trees = self.leaves.groupBy("grp", F.expr(f"at div {fan**step}").alias("tree"), "size").agg(rows.alias("rows"))
        named = groups.select(F.col("grp").alias("_grp"), "subroot")
        met = _joined(trees, paths).join(named, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp")

        def run(batches):
            for batch in batches:
                id_type = batch.schema.field("rows").type.value_type.field("doc_id").type
                kinds = [id_type, *[pa.string()] * 5, pa.bool_()]
                for row in batch.to_pylist():
                    leaves = row["rows"]
                    levels = levels_above([n["leaf"] for n in leaves], row["size"], fan, step)
                    above = [(p["left"], p["right"]) for p in row["path"]]
                    out = []
                    for i, n in enumerate(leaves):
                        path = proof_of(levels, i, fan) + above
                        folded = fold(n["changed"] or n["leaf"], path)
                        siblings = digest_of(*[side for sides in path for side in sides])
                        out.append((n["doc_id"], n["leaf"], row["subroot"], root, siblings, folded, folded == root))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        types = [kind, *["string"] * 5, "boolean"]
        return met.mapInArrow(run, ", ".join(f"{name} {type_}" for name, type_ in zip(names, types, strict=True)))


def manifest_digest(docs: DataFrame) -> DataFrame:
    return Manifest(docs).proofs()


def _sql(most: int = 7) -> str:
    """All levels of both trees, unrolled: ``most`` of them hold 16 ** most rows."""
    value = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    steps = [f"""leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from (select row_number() over () as row,
        doc_id, source, {leaf('text')} as leaf, case when {crc32_sql('coalesce(doc_id::varchar, chr(45))')} % {TAMPER_EVERY} = 0 and doc_id is not null
        then {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} end as changed from documents cross join crc_table))""",
        "a0 as (select source as grp, pos, leaf as h from leaves)", "f0 as (select row, source as grp, pos, coalesce(changed, leaf) as h, '' as proof from leaves)"]
    for tree, first in (("a", 1), ("b", 1)):
        walk = "f" if tree == "a" else "g"
        if tree == "b":
            steps += [f"subs as (select grp, h, row_number() over (order by grp nulls first) - 1 as pos from a{most})", "b0 as (select '' as grp, pos, h from subs)",
                f"g0 as (select row, '' as grp, s.pos, f.h, proof from f{most} f join subs s on s.grp is not distinct from f.grp)"]
        for k in range(first, most + 1):
            below, n = f"{tree}{k - 1}", f"{tree}n{k}"
            steps += [
                f"{n} as (select grp, count(*) as n from {below} group by 1)",
                f"""{tree}{k} as (select x.grp, x.pos // {FAN} as pos, case when max(n) > 1 then sha256(string_agg(h, '' order by x.pos)) else max(h) end as h
                    from {below} x join {n} c on c.grp is not distinct from x.grp group by x.grp, x.pos // {FAN})""",
                f"""{walk}{k} as (select f.row, f.grp, f.pos // {FAN} as pos,
                    case when max(n) > 1 then sha256(string_agg(case when x.pos = f.pos then f.h else x.h end, '' order by x.pos)) else max(f.h) end as h,
                    max(f.proof) || coalesce(string_agg(x.h, '' order by x.pos) filter (x.pos <> f.pos), '') as proof
                    from {walk}{k - 1} f join {below} x on x.grp is not distinct from f.grp and x.pos // {FAN} = f.pos // {FAN}
                    join {n} c on c.grp is not distinct from f.grp group by f.row, f.grp, f.pos)""",
            ]
    return f"""with {CRC_TABLE}, {", ".join(steps)}
        select doc_id, leaf, subs.h as subroot, top.h as root, sha256(g.proof) as proof_sha256, g.h as folded_root, g.h = top.h as verified
        from leaves join g{most} g using (row) join subs on subs.grp is not distinct from leaves.source cross join b{most} top"""


SQL = _sql()

"""Merkle manifest of a table, and proofs of its rows by octopus multiproofs.

Rows are leaves; the leaves of a group (a source) form a tree, the groups'
roots form the tree above ("top", tree -1).  Numbering, hashing and building
levels are DataFrame work: rows are dealt by range, so a group that holds a
third of all rows spreads over many tasks, and each level is one aggregate.

Proofs are made per *leaf partition*, up to ``leaves_per_part`` consecutive
leaves.  A partition computes the coordinates of the nodes that its own leaves
do not yield (their minimal union), fetches each once, derives the interiors
its leaves share, and expands every leaf's own proof from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from relaygrid.session import settle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree above the groups' trees.
TOP = -1
_NODE = ("tree", "level", "n", "pos", "digest")


def spelled(value: Column) -> Column:
    """A field as it is hashed: ``-`` if null, else its UTF-8 byte count, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def row_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[spelled(f) for f in fields]), 256)


@dataclass
class Manifest:
    """Numbered leaves, all nodes of all trees, and the root (None for an empty table)."""

    leaves: DataFrame  # id, leaf, claim, g, tree, pos, n
    nodes: DataFrame  # tree, level, n (nodes of that level), pos, digest; without the leaves
    root: str | None
    groups: int
    fan: int


def _numbered(docs: DataFrame, group: str, order: str, fields: Sequence[str], claim: Column, rows_per_part: int) -> tuple[DataFrame, int]:
    """Leaves with their tree, their place in it and their place among all, and the number of trees."""
    parts = max(8, -(-docs.count() // rows_per_part))
    hashed = docs.select(
        F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("id"),
        row_digest([F.col(f"`{f}`") for f in fields]).alias("leaf"), claim.alias("claim"), F.monotonically_increasing_id().alias("nth"),
    )
    # equal rows are told apart by their place in the input, so that they too can be dealt out
    along = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("nth")]
    dealt = hashed.repartitionByRange(parts, *along).sortWithinPartitions(*along)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = settle(dealt.select("grp", "id", "leaf", "claim", F.spark_partition_id().alias("part"), at.alias("at")), "merkle-leaves")

    # one row per part and group
    spans = settle(rows.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first")), "merkle-spans")
    groups = spans.groupBy("grp").agg(F.sum("rows").alias("n"), F.min(F.struct("part", "first")).alias("home"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    homes = groups.groupBy(F.col("home.part").alias("part")).agg(F.count(F.lit(1)).alias("homes"))
    bases = spans.groupBy("part").agg(F.sum("rows").alias("rows")).join(homes, "part", "left").select(
        "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("homes").over(earlier), F.lit(0)).alias("trees"),
    )
    bases = settle(bases, "merkle-bases")
    within = Window.partitionBy("home.part").orderBy("home.first")
    trees = groups.withColumn("nth", F.row_number().over(within) - 1).join(bases, F.col("home.part") == F.col("part")).select(
        F.col("grp").alias("tgrp"), "n", (F.col("trees") + F.col("nth")).alias("tree"),
    )
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        spans.withColumn("shift", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first"))
        .join(trees, F.col("grp").eqNullSafe(F.col("tgrp"))).join(bases.select("part", "base"), "part")
        .select(F.col("part").alias("spart"), F.col("grp").alias("sgrp"), "tree", "n", "shift", "base")
    )
    placed = settle(placed, "merkle-places")
    leaves = rows.join(placed, (F.col("part") == F.col("spart")) & F.col("grp").eqNullSafe(F.col("sgrp"))).select(
        "id", "leaf", "claim", (F.col("base") + F.col("at")).alias("g"), "tree", (F.col("at") + F.col("shift")).alias("pos"), "n",
    )
    count = trees.agg(F.max("tree")).first()[0]
    return settle(leaves, "merkle-numbered"), 0 if count is None else count + 1


def _climb(bottom: DataFrame, fan: int) -> list[DataFrame]:
    """The levels above ``bottom`` (tree, level, n, pos, digest), each written once; a tree ends with its root."""
    levels, below = [], bottom
    most = below.agg(F.max("n")).first()[0] or 0
    while most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda node: node["digest"]), "")
        above = (
            below.where("n > 1").groupBy("tree", "level", "n", F.floor(F.col("pos") / fan).alias("run")).agg(F.sha2(joined, 256).alias("digest"))
            .select("tree", (F.col("level") + 1).alias("level"), F.ceil(F.col("n") / fan).alias("n"), F.col("run").alias("pos"), "digest")
        )
        below = settle(above, "merkle-level")
        levels.append(below)
        most = -(-most // fan)
    return levels


def build(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id", claim: Column | None = None,
    fan: int = 16, rows_per_part: int = 50_000,
) -> Manifest:
    """The manifest of ``docs``: every row a leaf, a tree per ``group``, one root.

    Leaves of a group ascend by ``order`` (nulls first; equal ones by digest);
    groups ascend bytewise, null first.  ``claim`` may give another digest of a
    row, as somebody presents it; :func:`prove` holds it against the root.
    """
    claim = F.lit(None).cast("string") if claim is None else claim
    leaves, count = _numbered(docs, group, order, fields, claim, rows_per_part)
    bottom = leaves.select("tree", F.lit(0).alias("level"), "n", "pos", F.col("leaf").alias("digest")).select(*_NODE)
    inner = _climb(bottom, fan)
    subroots = bottom.where("n = 1")
    for level in inner:
        subroots = subroots.unionByName(level.where("n = 1"))
    top = settle(
        subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), "digest"),
        "merkle-top",
    )
    upper = [top, *_climb(top, fan)]
    last = upper[-1].limit(2).collect()
    nodes = upper[0]
    for level in [*upper[1:], *inner]:
        nodes = nodes.unionByName(level)
    return Manifest(leaves, nodes, last[0]["digest"] if last else None, count, fan)


def missing(known: np.ndarray, n: int, fan: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that leaves ``known`` of a tree of ``n`` need and do not yield: the least set."""
    wanted, level = [], 0
    known = np.unique(known)
    while n > 1:
        runs = np.unique(known // fan)
        members = (runs[:, None] * fan + np.arange(fan)).ravel()
        wanted += [(level, int(p)) for p in np.setdiff1d(members[members < n], known, assume_unique=True)]
        known, n, level = runs, -(-n // fan), level + 1
    return wanted


def _digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


class Branch:
    """What a partition knows of one tree: its own nodes, the fetched ones, and the interiors both yield."""

    def __init__(self, known: dict[int, bytes], n: int, fetched: dict[tuple[int, int], bytes], fan: int):
        self.fan, self.runs, self._tails = fan, [], {}
        level = 0
        while n > 1:
            runs = {}
            for run in sorted({p // fan for p in known}):
                places = range(run * fan, min((run + 1) * fan, n))
                runs[run] = [known.get(p) or fetched[level, p] for p in places]
            self.runs.append(runs)
            known = {run: _digest(b"".join(members)) for run, members in runs.items()}
            n, level = -(-n // fan), level + 1
        self.root = next(iter(known.values()))

    def siblings(self, level: int, place: int) -> tuple[bytes, bytes]:
        members = self.runs[level][place // self.fan]
        own = place % self.fan
        return b"".join(members[:own]), b"".join(members[own + 1 :])

    def proof(self, place: int, level: int = 0) -> bytes:
        """Siblings from ``level`` to the root; what nodes of a run share is put together once."""
        if level == len(self.runs):
            return b""
        above = (level + 1, place // self.fan)
        if above not in self._tails:
            self._tails[above] = self.proof(above[1], above[0])
        return b"".join(self.siblings(level, place)) + self._tails[above]

    def fold(self, place: int, value: bytes) -> bytes:
        """The root that ``value`` at a leaf's place leads to."""
        for level in range(len(self.runs)):
            left, right = self.siblings(level, place)
            value = _digest(left + value + right)
            place //= self.fan
        return value


def _digests(column: pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def prove(manifest: Manifest, id_col: str = "doc_id", wanted: Column | None = None, leaves_per_part: int = 8192) -> DataFrame:
    """Proofs of all leaves, or of the ``wanted`` ones, each folded from its claim (else itself) to a root.

    Columns: ``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified.
    """
    leaves, fan, count = manifest.leaves, manifest.fan, manifest.groups
    kind = leaves.schema["id"].dataType
    out = f"`{id_col}` {kind.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return leaves.sparkSession.createDataFrame([], out)
    block = F.floor(F.col("g") / leaves_per_part).alias("block")
    asked = leaves if wanted is None else leaves.where(wanted)

    def coordinates(table: pa.Table) -> pa.Table:
        trees, places, sizes = (np.asarray(table.column(c)) for c in ("tree", "pos", "n"))
        order = np.argsort(trees, kind="stable")
        held, starts = np.unique(trees[order], return_index=True)
        wanted_nodes = [(TOP, level, p) for level, p in missing(held, count, fan)]
        for tree, mine in zip(held.tolist(), np.split(order, starts[1:]), strict=True):
            wanted_nodes += [(tree, level, p) for level, p in missing(places[mine], int(sizes[mine[0]]), fan)]
        columns = list(zip(*wanted_nodes, strict=True)) or [(), (), ()]
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()] * len(wanted_nodes), type=pa.int64()),
            "tree": pa.array(columns[0], type=pa.int64()), "level": pa.array(columns[1], type=pa.int32()), "pos": pa.array(columns[2], type=pa.int64()),
        })

    needs = asked.select(block, "tree", "pos", "n").groupBy("block").applyInArrow(coordinates, "block long, tree long, level int, pos long")
    needs = settle(needs, "merkle-coordinates")
    nodes = manifest.nodes.select("tree", "level", "pos", "digest").unionByName(
        leaves.select("tree", F.lit(0).alias("level"), "pos", F.col("leaf").alias("digest"))
    )
    fetched = needs.join(nodes, ["tree", "level", "pos"]).select("block", "tree", "level", "pos", "digest")
    root = manifest.root.encode()

    def expand(mine: pa.Table, given: pa.Table) -> pa.Table:
        nodes_of: dict[int, dict] = {}
        for tree, level, pos, digest in zip(*(given.column(c).to_pylist() for c in ("tree", "level", "pos")), _digests(given.column("digest")), strict=True):
            nodes_of.setdefault(tree, {})[level, pos] = digest
        trees, places, sizes = (mine.column(c).to_pylist() for c in ("tree", "pos", "n"))
        own, claims = _digests(mine.column("leaf")), _digests(mine.column("claim"))
        known: dict[int, dict] = {}
        sizes_of = dict(zip(trees, sizes, strict=True))
        for tree, place, digest in zip(trees, places, own, strict=True):
            known.setdefault(tree, {})[place] = digest
        branches = {tree: Branch(held, sizes_of[tree], nodes_of.get(tree, {}), fan) for tree, held in known.items()}
        top = Branch({tree: branch.root for tree, branch in branches.items()}, count, nodes_of.get(TOP, {}), fan)
        tails = {tree: top.proof(tree) for tree in branches}
        proofs, folded = [], []
        for tree, place, leaf, claim in zip(trees, places, own, claims, strict=True):
            branch = branches[tree]
            proofs.append(_digest(branch.proof(place) + tails[tree]).decode())
            folded.append(top.fold(tree, branch.fold(place, claim or leaf)))
        return pa.table({
            id_col: mine.column("id"), "leaf": mine.column("leaf").cast(pa.string()),
            "subroot": pa.array([branches[t].root.decode() for t in trees]), "root": pa.array([root.decode()] * len(trees)),
            "proof_sha256": pa.array(proofs), "folded_root": pa.array([f.decode() for f in folded]), "verified": pa.array([f == root for f in folded]),
        })

    mine = asked.select(block, "id", "leaf", "claim", "tree", "pos", "n").groupBy("block")
    return mine.cogroup(fetched.groupBy("block")).applyInArrow(expand, out)


def lowered(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_tampered(docs: DataFrame, tampered: Column, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Manifest and proofs of ``docs`` where rows marked ``tampered`` present their text with A-Z lower-cased.

    * A row's digest is that of the columns :data:`FIELDS`; further columns take
      no part, whatever their names.  Nulls in any of them have their own
      spelling.  Rows equal in all fields are leaves of their own.
    * Rows without id stand first in their source; rows without source form
      their own tree.  A text without capitals is not changed by tampering.
    * An empty table gives an empty result.
    """
    changed = row_digest([lowered(F.col(text_col)) if f == text_col else F.col(f"`{f}`") for f in FIELDS])
    manifest = build(docs, claim=F.when(tampered, changed), **how)
    return prove(manifest, id_col)

"""Merkle manifest of a table: a tree over each group's rows, a tree over the groups, and a proof for every row.

Proofs come from one octopus multiproof a leaf partition. Leaves are range-sorted by (group, id), so a partition holds a
contiguous range of leaves and, at the level of the groups, a contiguous range of groups. It computes the minimal union
of the node coordinates that its own leaves do not determine (at most two on either side of a level), fetches them once,
derives all shared interiors and expands the proofs of its leaves locally. Nodes to fetch are of two kinds: the largest
subtrees inside one partition, and those that span partitions. The latter are combined from the former in blocks of
3 ** HEIGHT leaves, HEIGHT levels a job. What crosses partitions is logarithmic in a group's size for each partition;
texts are read once, hashed where they lie and never shuffled.

A null value is the leaf's `-`. A null id comes first in its group and a null group first of all; rows of one id are
ordered by their leaf hash, and repeated rows stand beside each other, each with a place and a proof of its own. An
empty or very long text is a text like any other. An empty table gives no rows and has no root. Further columns,
whatever their names, are not read unless listed in `columns`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import stored

ARITY = 3
#: levels that one block of a combining job climbs: 3 ** 9 leaves, some 2 MB of digests
HEIGHT = 9
#: leaves of a range, and the most ranges; the driver sees one summary row of a range
LEAVES, MAX_RANGES = 200_000, 50_000
#: the tree over the groups; trees of groups are numbered from 0 in the groups' order
TOP = -1
PROOF = "array<struct<left:string,right:string>>"
NODE = "tree long, level int, place long, size long, node binary"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values, each with its length in bytes; null is `-`."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give; a proof's step holds the siblings on either side, as hex text."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def depth_of(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while size > 1:
        size, levels = -(-size // ARITY), levels + 1
    return levels


def cover(nodes: list[str], lo: int, size: int) -> Iterator[tuple[int, int, str]]:
    """(level, place, node) of the largest subtrees that the leaves lo, lo + 1, ... of a tree of `size` leaves hold whole."""
    level = 0
    while nodes:
        hi, above = lo + len(nodes), -(-size // ARITY)
        first, last = -(-lo // ARITY), above if hi == size else hi // ARITY
        if size == 1 or last <= first:
            yield from ((level, lo + k, h) for k, h in enumerate(nodes))
            return
        yield from ((level, k, nodes[k - lo]) for k in [*range(lo, first * ARITY), *range(min(last * ARITY, size), hi)])
        nodes = [parent(nodes[k * ARITY - lo : min(k * ARITY + ARITY, size) - lo]) for k in range(first, last)]
        lo, size, level = first, above, level + 1


def missing(lo: int, hi: int, size: int) -> Iterator[tuple[int, int]]:
    """(level, place) of all nodes that the proofs of the leaves lo .. hi - 1 need and the leaves do not determine."""
    level = 0
    while size > 1:
        yield from ((level, k) for k in [*range(lo // ARITY * ARITY, lo), *range(hi, min(-(-hi // ARITY) * ARITY, size))])
        lo, hi, size, level = lo // ARITY, -(-hi // ARITY), -(-size // ARITY), level + 1


class Range:
    """Consecutive leaves of one tree with the fetched nodes beside them: every level, as far as their proofs reach."""

    def __init__(self, nodes: list[str], lo: int, size: int, fetched: dict[tuple[int, int], str]):
        self.levels = []
        level = 0
        while size > 1:
            hi = lo + len(nodes)
            left, end = lo // ARITY * ARITY, min(-(-hi // ARITY) * ARITY, size)
            nodes = [*(fetched[level, k] for k in range(left, lo)), *nodes, *(fetched[level, k] for k in range(hi, end))]
            self.levels.append((left, nodes))
            nodes = [parent(nodes[k : k + ARITY]) for k in range(0, len(nodes), ARITY)]
            lo, size, level = left // ARITY, -(-size // ARITY), level + 1
        self.root = nodes[0]

    def proof(self, place: int) -> list[tuple[str, str]]:
        steps = []
        for left, nodes in self.levels:
            k, start = place - left, (place - left) // ARITY * ARITY
            steps.append(("".join(nodes[start:k]), "".join(nodes[k + 1 : start + ARITY])))
            place //= ARITY
        return steps


class Shape:
    """Where a range's leaves lie: its first group's number and place, the sizes of its first and last group, all groups."""

    def __init__(self, group: int, lo: int, first: int, last: int, groups: int):
        self.group, self.lo, self.first, self.last, self.groups = group, lo, first, last, groups

    def runs(self, ends: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
        """(tree, from, to, place of the first leaf, size of the tree) for every group; ends: where the groups end in the range."""
        start = 0
        for k, end in enumerate(ends):
            lo = self.lo if k == 0 else 0
            size = self.first if k == 0 else self.last if k == len(ends) - 1 else end - start
            yield self.group + k, start, end, lo, size
            start = end


def shapes_of(summary: list[dict]) -> dict[int, Shape]:
    """The ranges' shapes from one row a range: its number, groups, first and last group and their rows."""
    sizes: dict[int, int] = {}
    placed, group, before, last = [], -1, 0, None
    for r in sorted(summary, key=lambda r: r["range"]):
        same = r["first"] == last
        group, lo = (group, before) if same else (group + 1, 0)
        final = group + r["groups"] - 1
        placed.append((r["range"], group, lo, final))
        sizes[group] = sizes.get(group, 0) + r["n_first"]
        if final > group:
            sizes[final] = r["n_last"]
        group, last, before = final, r["last"], (lo + r["n_first"] if final == group else r["n_last"])
    return {p: Shape(g, lo, sizes[g], sizes[final], group + 1) for p, g, lo, final in placed}


def sorted_leaves(docs: DataFrame, id_col: str, group_col: str, columns: tuple[str, ...], claim: Column | None) -> DataFrame:
    """(_id, _group, _leaf, _claim, _range, _pos): leaves in ranges by group and id; _claim is null where nothing is claimed."""
    hashed = F.unhex(leaf_digest([docs[c] for c in columns]))
    leaves = stored(docs.select(docs[id_col].alias("_id"), docs[group_col].alias("_group"), hashed.alias("_leaf"), (F.lit(None).cast("binary") if claim is None else F.unhex(claim)).alias("_claim"), F.monotonically_increasing_id().alias("_row")))
    sc = docs.sparkSession.sparkContext
    ranges = max(sc.defaultParallelism, min(MAX_RANGES, -(-leaves.count() // LEAVES)))
    # the row's number splits a key that many equal rows share
    ordered = leaves.repartitionByRange(ranges, "_group", "_id", "_leaf", "_row").sortWithinPartitions("_group", "_id", "_leaf", "_row")
    at = F.monotonically_increasing_id()
    ordered = ordered.select("_id", "_group", "_leaf", "_claim", at.alias("_at"))
    return stored(ordered.select("_id", "_group", "_leaf", "_claim", F.shiftright("_at", 33).alias("_range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")))


def summary_of(leaves: DataFrame) -> list[dict]:
    """One row a range, at most MAX_RANGES of them."""
    name = F.coalesce(F.sha2("_group", 256), F.lit("")) if isinstance(leaves.schema["_group"].dataType, T.StringType) else F.coalesce(F.col("_group").cast("string"), F.lit("-"))
    runs = leaves.groupBy("_range", "_group").agg(F.count("*").alias("n"), F.min("_pos").alias("pos"))
    run = F.struct("pos", "n", name.alias("name"))
    rows = runs.groupBy(F.col("_range").alias("range")).agg(F.count("*").alias("groups"), F.min(run).alias("a"), F.max(run).alias("b"))
    return rows.select("range", "groups", F.col("a.name").alias("first"), F.col("a.n").alias("n_first"), F.col("b.name").alias("last"), F.col("b.n").alias("n_last")).toArrow().to_pylist()


def group_ends(groups: list) -> list[int]:
    """Where runs of equal values end."""
    return [k + 1 for k in range(len(groups)) if k + 1 == len(groups) or groups[k + 1] != groups[k]]


def whole_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(range, rows) for batches sorted by their column `range`."""
    held, current = [], None
    for batch in batches:
        numbers = batch.column("range").to_numpy()
        start = 0
        while start < len(numbers):
            if numbers[start] != current:
                if held:
                    yield current, pa.Table.from_batches(held)
                held, current = [], int(numbers[start])
            end = int(numbers.searchsorted(current, side="right"))
            held.append(batch.slice(start, end - start))
            start = end
    if held:
        yield current, pa.Table.from_batches(held)


def covers_and_needs(leaves: DataFrame, ranges: int, shapes) -> DataFrame:
    """Nodes that a range holds whole, and (node null) the coordinates that its proofs miss."""
    rows = leaves.select(F.col("_range").alias("range"), "_pos", "_group", "_leaf").repartition(ranges, "range").sortWithinPartitions("range", "_pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in whole_ranges(batches):
            shape, out, roots, whole_from = shapes.value[number], [], [], None
            ends = group_ends(table.column("_group").to_pylist())
            nodes = [h.hex() for h in table.column("_leaf").to_pylist()]
            for tree, a, b, lo, size in shape.runs(ends):
                if b - a == size:
                    (*_, root), = cover(nodes[a:b], 0, size)
                    whole_from = tree if whole_from is None else whole_from
                    roots.append(root)
                else:
                    out += [(tree, level, place, size, h) for level, place, h in cover(nodes[a:b], lo, size)]
                    out += [(tree, level, place, size, None) for level, place in missing(lo, lo + b - a, size)]
            if roots:
                out += [(TOP, level, place, shape.groups, h) for level, place, h in cover(roots, whole_from, shape.groups)]
            out += [(TOP, level, place, shape.groups, None) for level, place in missing(shape.group, shape.group + len(ends), shape.groups)]
            yield node_batch([(number, *r) for r in out])

    return rows.mapInArrow(run, "range long, " + NODE)


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    values = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
    return pa.RecordBatch.from_arrays([*values, pa.array([h and bytes.fromhex(h) for h in columns[5]], pa.binary())], names=["range", "tree", "level", "place", "size", "node"])


def combine_block(table: pa.Table, top: int) -> list[tuple[int, int, int, int, str]]:
    """The parents, up to level `top`, that the nodes of one block of one tree determine."""
    tree, size = table.column("tree")[0].as_py(), table.column("size")[0].as_py()
    at: dict[int, dict[int, str]] = {}
    for level, place, node in zip(*(table.column(c).to_pylist() for c in ("level", "place", "node")), strict=True):
        at.setdefault(level, {})[place] = node.hex()
    out = []
    for level in range(min(at), top):
        width = -(-size // ARITY**level)
        if width <= 1:
            break
        here = at.get(level, {})
        for above in {k // ARITY for k in here}:
            run = [here.get(k) for k in range(above * ARITY, min(above * ARITY + ARITY, width))]
            if None not in run:
                h = parent(run)
                at.setdefault(level + 1, {})[above] = h
                out.append((tree, level + 1, above, size, h))
    return out


def combiner(top: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: pa.Table.from_batches([node_batch([(0, *r) for r in combine_block(table, top)])]).drop_columns("range")


def combined(nodes: DataFrame, depth: int) -> DataFrame:
    """The given nodes with all that span several of them, HEIGHT levels a job."""
    for top in range(HEIGHT, depth + HEIGHT, HEIGHT):
        block = F.expr(f"place div CAST(pow({ARITY}, {top} - level) AS BIGINT)")
        todo = nodes.filter((F.col("level") >= top - HEIGHT) & (F.col("level") < top)).withColumn("block", block)

        nodes = stored(nodes.unionByName(todo.groupBy("tree", "block").applyInArrow(combiner(top), NODE)))
    return nodes


def prove(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, claim: Column | None = None) -> DataFrame:
    """(_id, _group, leaf, claim, subroot, root, proof) of every row.

    leaf is the digest of `columns`. claim is the given digest of what is held against the manifest, null if none is. A
    proof's step holds the siblings left and right of the node on the way to the root, through the group's own root.
    """
    leaves = sorted_leaves(docs, id_col, group_col, columns, claim)
    sc = docs.sparkSession.sparkContext
    shapes = shapes_of(summary_of(leaves))
    ranges = max(1, len(shapes))
    shared = sc.broadcast(shapes)
    both = stored(covers_and_needs(leaves, ranges, shared))
    held = both.filter("node is not null").drop("range")
    of_groups = combined(held.filter(F.col("tree") != TOP), depth_of(max((max(s.first, s.last) for s in shapes.values()), default=0)))
    n_groups = next(iter(shapes.values())).groups if shapes else 0
    # the roots of groups that span ranges join those found inside a range
    spanning = of_groups.filter(F.pow(F.lit(float(ARITY)), F.col("level")) >= F.col("size")).select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("place"), F.lit(n_groups).cast("long").alias("size"), "node")
    of_top = combined(held.filter(F.col("tree") == TOP).unionByName(spanning), depth_of(n_groups))
    nodes = of_groups.unionByName(of_top).drop("size")
    fetched = both.filter("node is null").select("range", "tree", "level", "place").join(nodes, ["tree", "level", "place"])
    return expanded(leaves, fetched, ranges, shared)


def expanded(leaves: DataFrame, fetched: DataFrame, ranges: int, shapes) -> DataFrame:
    """Every leaf's proof, made in its range from the range's leaves and the nodes fetched for it."""
    null = F.lit(None)
    one = leaves.select(F.col("_range").alias("range"), F.lit(1).alias("kind"), "_pos", "_id", "_group", "_leaf", "_claim", null.cast("long").alias("tree"), null.cast("int").alias("level"), null.cast("long").alias("place"), null.cast("binary").alias("node"))
    two = fetched.select("range", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("_pos"), null.cast(leaves.schema["_id"].dataType).alias("_id"), null.cast(leaves.schema["_group"].dataType).alias("_group"), null.cast("binary").alias("_leaf"), null.cast("binary").alias("_claim"), "tree", "level", "place", "node")
    rows = one.unionByName(two).repartition(ranges, "range").sortWithinPartitions("range", "kind", "_pos")
    kind = T.StructType([T.StructField("_id", leaves.schema["_id"].dataType), T.StructField("_group", leaves.schema["_group"].dataType), *(T.StructField(c, T.StringType()) for c in ("leaf", "claim", "subroot", "root")), T.StructField("proof", T._parse_datatype_string(PROOF))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, table in whole_ranges(batches):
            shape = shapes.value[number]
            n = sum(k == 0 for k in table.column("kind").to_pylist())
            near: dict[int, dict[tuple[int, int], str]] = {}
            got = table.slice(0, n)
            for tree, level, place, node in zip(*(got.column(c).to_pylist() for c in ("tree", "level", "place", "node")), strict=True):
                near.setdefault(tree, {})[level, place] = node.hex()
            mine = table.slice(n).combine_chunks()
            nodes = [h.hex() for h in mine.column("_leaf").to_pylist()]
            runs = list(shape.runs(group_ends(mine.column("_group").to_pylist())))
            trees = [Range(nodes[a:b], lo, size, near.get(tree, {})) for tree, a, b, lo, size in runs]
            top = Range([t.root for t in trees], shape.group, shape.groups, near.get(TOP, {}))
            for own, (tree, a, b, lo, _) in zip(trees, runs, strict=True):
                upper = top.proof(tree)
                for start in range(a, b, 2048):
                    end = min(start + 2048, b)
                    part = mine.slice(start, end - start)
                    proofs = [own.proof(lo + k - a) + upper for k in range(start, end)]
                    claims = [c and c.hex() for c in part.column("_claim").to_pylist()]
                    yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in ("_id", "_group")), pa.array(nodes[start:end]), pa.array(claims, pa.string()), pa.array([own.root] * (end - start)), pa.array([top.root] * (end - start)), proof_array(proofs)], names=kind.names)

    return rows.mapInArrow(run, kind)


def proof_array(proofs: list[list[tuple[str, str]]]) -> pa.Array:
    offsets = [0]
    for p in proofs:
        offsets.append(offsets[-1] + len(p))
    sides = [pa.array([s[k] for p in proofs for s in p], pa.string()) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(sides, names=["left", "right"]))


def tampered(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its line ends, where 2 divides the checksum of the id; null elsewhere (null id: untouched)."""
    touched = F.crc32(docs["doc_id"].cast("string")) % 2 == 0
    changed = [F.replace(docs[c], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in COLUMNS]
    return F.when(touched, leaf_digest(changed))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: every row's proof, held against its tampered version."""
    out = prove(docs, claim=tampered(docs))
    folded = out.select(F.col("_id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.coalesce("claim", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in COLUMNS[:4]) + " || coalesce(strlen({t}) || ':' || {t}, '-'))"

SQL = rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_LEAF.format(t="text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
        lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) & 1 = 1
      THEN {_LEAF.format(t="replace(text, chr(10), '')")} END AS claim
  FROM documents),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    row_number() OVER () AS r FROM rows),
grp AS (
  SELECT tree, 0 AS lvl, place, leaf AS h FROM numbered
  UNION ALL
  SELECT tree, max(lvl) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM grp) WHERE n > 1 GROUP BY tree, place // 3),
grp_root AS (SELECT tree, max(lvl) AS depth, arg_max(h, lvl) AS subroot FROM grp GROUP BY tree),
top AS (
  SELECT 0 AS lvl, tree AS place, subroot AS h FROM grp_root
  UNION ALL
  SELECT max(lvl) + 1, place // 3, sha256(string_agg(h, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER () AS n FROM top) WHERE n > 1 GROUP BY place // 3),
top_root AS (SELECT max(lvl) AS depth, arg_max(h, lvl) AS root FROM top),
nodes AS (
  SELECT g.tree, g.lvl, g.place, g.h FROM grp g JOIN grp_root USING (tree) WHERE g.lvl < depth
  UNION ALL
  SELECT -1, lvl, place, h FROM top, top_root WHERE lvl < depth),
path AS (
  SELECT n.r, s.lvl AS step, s.tree, s.lvl, n.place // CAST(pow(3, s.lvl) AS BIGINT) AS place
  FROM numbered n JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE tree >= 0) s USING (tree)
  UNION ALL
  SELECT n.r, g.depth + s.lvl, -1, s.lvl, n.tree // CAST(pow(3, s.lvl) AS BIGINT)
  FROM numbered n JOIN grp_root g USING (tree), (SELECT DISTINCT lvl FROM nodes WHERE tree = -1) s),
steps AS (
  SELECT p.r, p.step,
    coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place < p.place), '') AS l,
    coalesce(string_agg(n.h, '' ORDER BY n.place) FILTER (n.place > p.place), '') AS rt
  FROM path p JOIN nodes n ON n.tree = p.tree AND n.lvl = p.lvl AND n.place // 3 = p.place // 3
  GROUP BY p.r, p.step),
proofs AS (
  SELECT r, list(l ORDER BY step) AS ls, list(rt ORDER BY step) AS rs, sha256(string_agg(l || rt, '' ORDER BY step)) AS p
  FROM steps GROUP BY r),
folded AS (
  SELECT n.r, 0 AS step, coalesce(n.claim, n.leaf) AS h, ls, rs FROM numbered n LEFT JOIN proofs USING (r)
  UNION ALL
  SELECT r, step + 1, sha256(ls[step + 1] || h || rs[step + 1]), ls, rs FROM folded WHERE step < len(ls))
SELECT n.doc_id, n.leaf, g.subroot, t.root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.root AS verified
FROM numbered n JOIN grp_root g USING (tree) CROSS JOIN top_root t LEFT JOIN proofs p USING (r)
JOIN (SELECT r, arg_max(h, step) AS h FROM folded GROUP BY r) f USING (r)
"""

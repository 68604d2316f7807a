"""Merkle data set manifest (13) by lag and lead windows, with DataFrame functions only.

Every record is a leaf; leaves of a group in their order, and then the groups' subroots, are hashed upwards in runs of FAN. Records are
numbered by a range partitioning and the sizes of its parts, so no window is wider than a block of SPAN records of one group. In a
block the rows of first children stand for their level's nodes: lag and lead at fixed offsets of FAN**level rows, masked by the slot in
the run and the run's length, give a node's siblings, and a run's first row hashes the parent. What a block ends in is a
node of the next tier, a table SPAN times smaller, which is treated alike; siblings above the block come back by one join on (group, block).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN, LEVELS = 8, 3
SPAN = FAN**LEVELS  # rows of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it is hashed: UTF-8 byte count, colon, value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(*[field(v) for v in values])


def numbered(table: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """A stored table with pos, each row's place in its group from 0, and n, the group's rows. Rows that are equal in `order` are dealt out too."""
    dealt = table.withColumn("deal", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(group, *order, "deal").sortWithinPartitions(group, *order, "deal").drop("deal")
    placed = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "manifest-placed").withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    runs = runs.select(group, "part", "first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy(group)).alias("n"))
    runs = stored(runs, "manifest-runs")
    return placed.join(runs, [group, "part"]).withColumn("pos", F.col("at") - F.col("first") + F.col("base")).drop("at", "part", "first", "base")


def climb(nodes: DataFrame) -> DataFrame:
    """nodes(grp, pos, n, node, ...) with block, before_l and after_l (digests of the siblings of the row's ancestor at level l, left and
    right of it), many_l (whether that level has more than one node), and top on the first row of each block: the node that the block ends in."""
    w = Window.partitionBy("grp", "block").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumn("block", F.expr(f"pos div {SPAN}")).withColumn("up_0", F.col("node"))
    for level in range(LEVELS):
        step, up = FAN**level, F.col(f"up_{level}")
        count = F.expr(f"(n + {step - 1}) div {step}")
        slot, run = F.expr(f"(pos div {step}) % {FAN}"), F.least(F.lit(FAN), count - F.expr(f"pos div {step * FAN}") * FAN)
        before = [F.when(slot >= k, F.lag(up, step * k).over(w)) for k in range(FAN - 1, 0, -1)]
        after = [F.when(slot + k < run, F.lead(up, step * k).over(w)) for k in range(1, FAN)]
        first = F.expr(f"pos % {step} = 0")
        out = out.withColumns({f"many_{level}": count > 1, f"b_{level}": F.when(first, F.concat_ws("", *before)), f"a_{level}": F.when(first, F.concat_ws("", *after))})
        parent = F.when(F.col(f"many_{level}"), digest(up, F.col(f"a_{level}"))).otherwise(up)
        out = out.withColumns({
            f"up_{level + 1}": F.when(F.expr(f"pos % {step * FAN} = 0"), parent),
            f"before_{level}": F.last(f"b_{level}", ignorenulls=True).over(so_far), f"after_{level}": F.last(f"a_{level}", ignorenulls=True).over(so_far),
        })
    return out.withColumn("top", F.col(f"up_{LEVELS}")).drop(*[f"{c}_{k}" for k in range(LEVELS) for c in "ab"], *[f"up_{k}" for k in range(LEVELS + 1)])


def own_path() -> Column:
    """Siblings inside the block, level by level."""
    levels = [F.when(F.col(f"many_{k}"), F.struct(F.col(f"before_{k}").alias("before"), F.col(f"after_{k}").alias("after"))) for k in range(LEVELS)]
    return F.array_compact(F.array(*levels)).cast(PATH)


def tops(climbed: DataFrame) -> DataFrame:
    """The next tier's nodes."""
    rows = climbed.filter(F.col("top").isNotNull())
    return stored(rows.select("grp", F.col("block").alias("pos"), F.expr(f"(n + {SPAN - 1}) div {SPAN}").alias("n"), F.col("top").alias("node")), "manifest-tier")


def ascend(nodes: DataFrame) -> DataFrame:
    """grp, pos, path (siblings up to the group's root) and root of nodes(grp, pos, n, node)."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("grp", "pos", F.array().cast(PATH).alias("path"), F.col("node").alias("root"))
    climbed = climb(nodes)
    above = ascend(tops(climbed)).withColumnRenamed("pos", "block")
    return climbed.join(above, ["grp", "block"]).select("grp", "pos", F.concat(own_path(), "path").alias("path"), "root")


def manifest(leaves: DataFrame) -> DataFrame:
    """A stored table of leaves(grp, key, node, ...) with path, subroot and root.

    grp (a string, not null) and key order the leaves, rows equal in both by node; path lists the digests before and after the row's
    ancestors, from its own run up to the root."""
    climbed = climb(numbered(leaves, "grp", ["key", "node"]))
    blocks = stored(ascend(tops(climbed)).withColumnRenamed("root", "subroot"), "manifest-blocks")
    groups = stored(blocks.filter("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("node")), "manifest-groups")
    ranked = stored(numbered(groups, "grp", ["key"]), "manifest-ranked")
    roots = ranked.join(ascend(ranked.select("grp", "pos", "n", "node")), ["grp", "pos"]).select(F.col("key").alias("grp"), F.col("path").alias("over"), "root")
    above = stored(blocks.join(roots, "grp").select("grp", F.col("pos").alias("block"), F.concat("path", "over").alias("above"), "subroot", "root"), "manifest-above")
    names = [c for c in leaves.columns if c not in ("grp", "key")]
    return climbed.join(above, ["grp", "block"]).select(*names, F.concat(own_path(), "above").alias("path"), "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, x: digest(x["before"], node, x["after"]))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def tamper_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest of documents, checked against rows of which every
    third, by CRC-32 of doc_id, has its text's A-Z lower-cased.

    Null fields are hashed as `-`. Rows without lang are a group, the first; rows without doc_id come first in theirs and are not
    tampered with. Rows that share a doc_id are ordered by their leaves; equal rows are leaves of their own. A group of one leaf is its own
    subroot. Texts of any length are hashed whole, an empty table gives no rows, other columns are ignored, whatever their names."""
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    fields = [F.col(c) for c in FIELDS]
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in FIELDS]
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-")).alias("grp"), F.col("doc_id").cast("long").alias("key"),
        leaf_of(fields).alias("node"), F.when(picked, leaf_of(changed)).alias("seen"), F.col("doc_id").cast("long").alias("doc_id"),
    )
    out = manifest(stored(leaves, "manifest-leaves")).withColumn("folded_root", folded(F.coalesce("seen", "node"), F.col("path")))
    return out.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# -- SQL


def _sql_field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _sql_tree(name: str, group: str, levels: int) -> str:
    """CTEs name_0 .. name_levels of nodes(group, pos, d) and name_p_0 .. of the siblings b, a of each."""
    out = []
    for k in range(levels):
        out += [
            f"{name}_p_{k} AS (SELECT {group}, pos, c > 1 AS many, coalesce(list_aggregate(ds[1 : pos % 8], 'string_agg', ''), '') AS b, coalesce(list_aggregate(ds[pos % 8 + 2 : 8], 'string_agg', ''), '') AS a"
            f" FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS c, list(d) OVER (PARTITION BY {group}, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ds FROM {name}_{k}))",
            f"{name}_{k + 1} AS (SELECT {group}, pos // 8 AS pos, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS c FROM {name}_{k}) GROUP BY {group}, pos // 8)",
        ]
    return ",\n".join(out)


def _sql_fold(x: str, levels: list[str]) -> str:
    return reduce(lambda node, p: f"CASE WHEN {p}.many THEN sha256({p}.b || {node} || {p}.a) ELSE {node} END", levels, x)


def sql(levels: int = 6, group_levels: int = 2) -> str:
    """The same rows in DuckDB's SQL, for groups of at most 8**levels leaves and at most 8**group_levels groups."""
    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR z IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"""
    leaf = lambda text: f"sha256({' || '.join(_sql_field(c if c != 'text' else text) for c in FIELDS)})"
    steps = [(f"x{k}", f"l_p_{k}", f"coalesce(x{k}.grp = s.grp, false) AND x{k}.pos = s.pos // {8**k}") for k in range(levels)]
    over = [(f"y{k}", f"g_p_{k}", f"y{k}.pos = g.pos // {8**k}") for k in range(group_levels)]
    joins = " ".join(f"JOIN {t} {a} ON {on}" for a, t, on in steps) + " JOIN g_0 g ON g.grp = s.grp " + " ".join(f"JOIN {t} {a} ON {on}" for a, t, on in over)
    names = [a for a, _, _ in (*steps, *over)]
    siblings = " || ".join(f"CASE WHEN {a}.many THEN {a}.b || {a}.a ELSE '' END" for a in names)
    return f"""WITH s0 AS (SELECT doc_id, coalesce('=' || lang, '-') AS grp, {leaf('text')} AS d, CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen FROM documents),
        s AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM s0),
        l_0 AS (SELECT grp, pos, d FROM s), {_sql_tree('l', 'grp', levels)},
        g_0 AS (SELECT grp, 0 AS everything, row_number() OVER (ORDER BY grp) - 1 AS pos, d FROM l_{levels}), {_sql_tree('g', 'everything', group_levels)},
        f AS (SELECT s.doc_id, s.d AS leaf, g.d AS subroot, r.d AS root, sha256({siblings}) AS proof_sha256, {_sql_fold('coalesce(s.seen, s.d)', names)} AS folded_root FROM s {joins} CROSS JOIN g_{group_levels} r)
        SELECT *, folded_root = root AS verified FROM f"""

"""Merkle manifest of a dataset: a tree of three-way digests over each group's ordered rows, and one over the groups.

Nodes become ordered arrays of at most 243 (a block of five levels); sequence, transform, slice and aggregate collapse a
block to one node, and the nodes of all blocks are the rows of the next pass. Proofs come back the same way: each pass
hands its blocks what stands above them. A group of any size is many blocks, and no task holds more than its blocks.

Defined results: a null value is `-` in a leaf; rows of a null group are a group of their own, the first; null ids come
before others, rows of one id are ordered by their leaves, and repeated rows are leaves each; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut, read, release

#: Nodes that one parent digests, and levels that one block collapses.
FAN = 3
LEVELS = 5
BLOCK = FAN**LEVELS

#: Digests of the levels of a block, lowest first; the last run of a level may be short.
TOWER = f"""aggregate(
  filter(sequence(1, {LEVELS}), k -> k <= levels),
  array(transform(items, x -> x.node)),
  (tower, k) -> concat(tower, array(transform(
    sequence(0, (size(element_at(tower, -1)) - 1) div {FAN}),
    r -> sha2(array_join(slice(element_at(tower, -1), {FAN} * r + 1, {FAN}), ''), 256)))))"""

#: The siblings to the left and right of node i of a block, level by level.
STEPS = f"""transform(sequence(0, size(tower) - 1), k -> struct(
  k as level, int(i div int(pow({FAN}, k))) as at))"""
PATH = f"""transform(filter({STEPS}, s -> s.level < size(tower) - 1), s -> struct(
  array_join(slice(tower[s.level], s.at - s.at % {FAN} + 1, s.at % {FAN}), '') as left,
  array_join(slice(tower[s.level], s.at + 2, {FAN - 1} - s.at % {FAN}), '') as right))"""

NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(node: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, node, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes(grp, ...) with the place of each in its group, from 0, and the group's total.

    Rows are sorted over all tasks by ranges, so a large group lies in many; a place is the row's place in its task less
    that of the group's first row there, plus what earlier tasks hold of the group.
    """
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    at = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND(F.lit((1 << 33) - 1))))
    spans = ranged.groupBy("grp", "part").agg(F.min("place").alias("low"), F.count("*").alias("n"))
    here = Window.partitionBy("grp")
    before = F.sum("n").over(here.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("shift"), F.sum("n").over(here).alias("total"))
    out = ranged.join(spans, ["grp", "part"]).withColumn("place", F.col("place") + F.col("shift")).drop("part", "shift")
    out._newsloom_reads = (ranged,)
    return out


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Blocks of nodes(grp, place, total, node, ...): their items in order, and the digests of each level."""
    item = F.struct("place", "node", *carried)
    levels = reduce(lambda so_far, k: F.when(F.col("total") <= FAN**k, k).otherwise(so_far), reversed(range(LEVELS)), F.lit(LEVELS))
    out = nodes.groupBy("grp", F.expr(f"place div {BLOCK}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(item)).alias("items"))
    out = cut(out.withColumn("levels", levels).withColumn("tower", F.expr(TOWER)).drop("levels"))
    release(*getattr(nodes, "_newsloom_reads", ()))
    return out


def climb(nodes: DataFrame, *carried: str) -> list[DataFrame]:
    """Blocks of every pass up to the one in which each group has come down to one block."""
    passes = [blocks(nodes, *carried)]
    while True:
        up = passes[-1].where(F.col("total") > BLOCK).select("grp", F.col("block").alias("place"), F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("total"), top().alias("node"))
        if up.isEmpty():
            return passes
        passes.append(blocks(up))


def top() -> Column:
    return F.expr("element_at(tower, -1)[0]")


def tops(passes: list[DataFrame]) -> DataFrame:
    """(grp, node): the one node that remains of each group."""
    return reduce(DataFrame.unionByName, [p.where(F.col("total") <= BLOCK).select("grp", top().alias("node")) for p in passes])


def below(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest blocks, each with the path from its top up: above(grp, path, ...) has the path over each group's node."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    paths = None
    for p in reversed(passes):
        done = p.where(F.col("total") <= BLOCK).join(above, "grp")
        if paths is not None:
            done = done.unionByName(p.where(F.col("total") > BLOCK).join(paths, ["grp", "block"]))
        if p is passes[0]:
            return done
        numbered = F.expr(f"transform(sequence(0, size(items) - 1), i -> struct(items[i].place as block, concat({PATH}, path) as path))")
        paths = done.select("grp", *more, F.inline(numbered))
    raise ValueError("no passes")


def manifest(rows: DataFrame, *carried: str) -> DataFrame:
    """rows(grp string, id, node, carried...) -> id, leaf, carried..., subroot, root, proof (left and right siblings by level).

    grp is null for the group without a name. id and the carried columns may have any types that can be ordered.
    """
    named = F.when(F.col("grp").isNull(), "").otherwise(F.concat(F.lit("="), "grp"))  # null first, then bytewise
    leaves = cut(rows.select(named.alias("grp"), "id", "node", *carried, F.monotonically_increasing_id().alias("row")))
    lower = climb(placed(leaves, "id", "node", "row"), "id", *carried)
    release(leaves)
    subroots = cut(tops(lower).select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "node"))
    upper = climb(placed(subroots, "name"), "name")
    root = tops(upper).first()
    # the root of the groups' tree is one row, the only thing that the driver is given
    whole = upper[0].sparkSession.createDataFrame([(0, root.node)] if root else [], "grp int, root string").select("grp", F.expr(NO_PATH).alias("path"), "root")
    numbered = F.expr(f"transform(sequence(0, size(items) - 1), i -> struct(items[i].name as grp, items[i].node as subroot, concat({PATH}, path) as path))")
    named = cut(below(upper, whole).select("root", F.inline(numbered)))
    release(subroots, *upper)
    items = ", ".join(f"items[i].{c} as {c}" for c in ("id", "node", *carried))
    numbered = F.expr(f"transform(sequence(0, size(items) - 1), i -> struct({items}, concat({PATH}, path) as proof))")
    return below(lower, named).select("subroot", "root", F.inline(numbered)).withColumnRenamed("node", "leaf")


def op11(spark, sf_dir: str) -> DataFrame:
    """Manifest of documents by source, with each proof checked against a leaf that may be tampered with."""
    d = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(tampered & F.col("text").contains("\n"), leaf(*head, F.replace("text", F.lit("\n"), F.lit(""))))
    rows = d.select(F.col("source").alias("grp"), F.col("doc_id").alias("id"), leaf(*head, F.col("text")).alias("node"), changed.alias("forged"))
    out = manifest(rows, "forged").withColumn("folded_root", fold(F.coalesce("forged", "leaf"), F.col("proof")))
    return out.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END
    || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
    || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head, text,
    -- crc32, a bit at a time: a byte is mixed in, then eight steps follow
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1 = 1 AS tampered
  FROM documents),
l AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN tampered THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS forged FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM l),
tree AS (
  SELECT source, 0 AS level, place, leaf AS node, count(*) OVER (PARTITION BY source) AS total FROM p
  UNION ALL
  SELECT source, level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM tree WHERE total > 1 GROUP BY source, level, place // 3),
s AS (SELECT source, level AS height, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM tree WHERE total = 1),
crown AS (
  SELECT 0 AS level, rank AS place, subroot AS node, count(*) OVER () AS total FROM s
  UNION ALL
  SELECT level + 1, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(total) + 2) // 3 FROM crown WHERE total > 1 GROUP BY level, place // 3),
runs AS (SELECT source, level, place // 3 AS run, list(node ORDER BY place) AS nodes FROM tree WHERE total > 1 GROUP BY ALL),
crowns AS (SELECT level, place // 3 AS run, list(node ORDER BY place) AS nodes FROM crown WHERE total > 1 GROUP BY ALL),
steps AS (
  SELECT p.doc_id, p.source, p.place AS leaf_place, p.leaf, p.forged, r.level, p.place // (3 ** r.level)::BIGINT % 3 AS side, r.nodes FROM p JOIN runs r
    ON r.source IS NOT DISTINCT FROM p.source AND r.run = p.place // (3 ** (r.level + 1))::BIGINT
  UNION ALL
  SELECT p.doc_id, p.source, p.place, p.leaf, p.forged, s.height + c.level, s.rank // (3 ** c.level)::BIGINT % 3, c.nodes FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source
    JOIN crowns c ON c.run = s.rank // (3 ** (c.level + 1))::BIGINT),
paths AS (
  SELECT source, leaf_place, list({l: array_to_string(list_slice(nodes, 1, side), ''), r: array_to_string(list_slice(nodes, side + 2, 3), '')} ORDER BY level) AS path FROM steps GROUP BY ALL),
walk AS (
  SELECT p.source, p.place, coalesce(p.forged, p.leaf) AS node, coalesce(path, []) AS path, 1 AS k
  FROM p LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM p.source AND leaf_place = p.place
  UNION ALL
  SELECT source, place, sha256(path[k].l || node || path[k].r), path, k + 1 FROM walk WHERE k <= len(path))
SELECT p.doc_id, p.leaf, s.subroot, (SELECT node FROM crown WHERE total = 1) AS root,
  sha256(array_to_string(list_transform(w.path, lambda x: x.l || x.r), '')) AS proof_sha256, w.node AS folded_root, w.node = (SELECT node FROM crown WHERE total = 1) AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source
JOIN walk w ON w.source IS NOT DISTINCT FROM p.source AND w.place = p.place AND w.k = len(w.path) + 1
"""

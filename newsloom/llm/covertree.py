"""Embedding near-duplicates by cover trees traversed in pairs.

Vectors are scaled to length one, where cosine >= c means a distance of at most t = sqrt(2 - 2c). Equal vectors of
a label become one point with a weight. A label is a cell, and a cell with more than `cell_rows` points is split, level by
level, into the points nearest to each of its centres, which are a bounded sample of it: the upper levels of the tree. A
pair of points of two cells is sought in the lower-numbered one: a point of the other is sent there as a guest unless the
cell's covering radius, or the plane half way between the centres, rules a partner out; guests of a cell that is split go on
to all cells where that holds. Within a cell a cover tree of nested levels with halving radii is traversed against itself: a
pair of nodes is dropped where their centres are further apart than t plus both covering radii, taken as a whole where even
the furthest members link, and expanded otherwise; leaves are compared directly. A node whose next level would
hold very many nodes stays a leaf.

A pass splits at most `PASS_CELLS` cells by `PASS_CENTRES` centres in all, and passes go on until no cell is too large, so
cells keep their size at any number of points. A cell that splitting does not thin out, as its points lie within little more
than t of each other, stays as it is and is searched by one task, which takes near nodes as a whole.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and any vector whose
label is null, links with nothing; vectors of different length do not link; repeated rows link with each other and
give a row each; a null id never becomes a component id unless all of the group are null; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import components, cut, local_components, read, release

COSINE = 0.98
#: Points of a cell; of a pass: cells that are split, their centres, bytes of the sample that the driver holds.
CELL_ROWS, PASS_CELLS, PASS_CENTRES, SAMPLE_BYTES = 4096, 1024, 4096, 32 << 20
#: Times its rows that a cell may become by splitting, and share of them that one part may keep.
GROWTH, REST = 5, 0.9
#: Points that make a leaf at once; points that tell whether a level can part more, and the share of the others that a
#: child must then cover on average: a level takes so many distances a point at most, however many points there are.
LEAF, PROBE, COVERED = 48, 64, 1 / 24
#: Distances from points to centres that are held at once.
HELD = 2_000_000
SLACK = 1e-7


class Node:
    __slots__ = ("centre", "members", "radius", "kids")

    def __init__(self, centre, members, radius, kids=None):
        self.centre, self.members, self.radius, self.kids = centre, members, radius, kids


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def grow(x: np.ndarray, members: np.ndarray, level: float = 2.0) -> Node:
    """The cover tree of members: the children of a node of level r are at least r / 2 apart, each covers r / 2."""
    top = Node(members[0], members, float(distances(x[members], x[members[:1]]).max()))
    todo = [(top, level)]
    while todo:
        node, r = todo.pop()
        if len(node.members) <= LEAF or node.radius <= 1e-6:
            continue
        while r > 2 * node.radius:
            r /= 2
        some = x[node.members[:: max(1, len(node.members) // PROBE)]]
        if (distances(some, some) <= r / 2).sum() - len(some) < COVERED * len(some) * (len(some) - 1):
            continue
        node.kids, rest = [], node.members
        while len(rest):
            d = distances(x[rest], x[rest[:1]])[:, 0]
            d[0] = 0.0
            own = d <= r / 2
            kid = Node(rest[0], rest[own], float(d[own].max()))
            node.kids.append(kid)
            todo.append((kid, r / 2))
            rest = rest[~own]
    return top


class Links:
    """Exact threshold pairs among points, as weighted counts and edges that span what is linked."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.w, self.cosine, self.t = x, weight, cosine, float(np.sqrt(2 - 2 * cosine))
        self.count = np.zeros(len(x), np.int64)
        self.i, self.j = [], []

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool):
        for k in range(0, len(a), 1024):
            rows = a[k : k + 1024]
            for j in range(k if same else 0, len(b), 4096):
                part = b[j : j + 4096]
                hit = self.x[rows] @ self.x[part].T >= self.cosine
                if same:  # each pair once: of the square only what is right of the diagonal
                    hit &= np.arange(j, j + len(part))[None, :] > np.arange(k, k + len(rows))[:, None]
                r, c = np.nonzero(hit)
                if len(r):
                    np.add.at(self.count, rows[r], self.w[part[c]])
                    np.add.at(self.count, part[c], self.w[rows[r]])
                    self._span(rows, part, r, c)

    def _span(self, rows, b, r, c):
        """Edges from each linked point to the first of its component."""
        n = len(rows) + len(b)
        label = local_components(n, r, c + len(rows))
        both = np.concatenate([rows, b])
        moved = np.flatnonzero(label != np.arange(n))
        self.i.append(both[moved])
        self.j.append(both[label[moved]])

    def whole(self, a: np.ndarray, b: np.ndarray, same: bool):
        if same:
            self.count[a] += self.w[a].sum() - self.w[a]
        else:
            self.count[a] += self.w[b].sum()
            self.count[b] += self.w[a].sum()
            self.i.append(b)
            self.j.append(np.full(len(b), a[0]))
        self.i.append(a)
        self.j.append(np.full(len(a), b[0]))

    def _leaves(self, node: Node, others: list[Node]) -> list:
        """Compares a leaf with all other leaves at once; returns the pairs that are left to traverse."""
        flat = [o for o in others if o is not node and o.kids is None] if node.kids is None else []
        if flat:
            members = np.concatenate([o.members for o in flat])
            for k in range(0, len(members), 4096):
                self.compare(node.members, members[k : k + 4096], False)
            others = [o for o in others if o is node or o.kids is not None]
        return [(node, o) for o in others]

    def traverse(self, one: Node, two: Node):
        todo = [(one, two)]
        while todo:
            a, b = todo.pop()
            same = a is b
            d = 0.0 if same else float(distances(self.x[a.centre][None], self.x[b.centre][None])[0, 0])
            if d - a.radius - b.radius > self.t + SLACK:
                continue
            if d + a.radius + b.radius < self.t - SLACK:
                self.whole(a.members, b.members, same)
            elif a.kids is None and b.kids is None:
                self.compare(a.members, b.members, same)
            elif same:
                c, r = np.array([k.centre for k in a.kids]), np.array([k.radius for k in a.kids])
                for k in range(0, len(c), 1024):
                    near = distances(self.x[c[k : k + 1024]], self.x[c]) - r[k : k + 1024, None] - r[None, :] <= self.t + SLACK
                    for i, row in enumerate(near, k):
                        row[:i] = False
                        todo += self._leaves(a.kids[i], [a.kids[j] for j in np.flatnonzero(row)])
            else:
                if a.kids is None or b.kids is not None and b.radius > a.radius:
                    a, b = b, a
                c, r = np.array([k.centre for k in a.kids]), np.array([k.radius for k in a.kids])
                near = distances(self.x[c], self.x[[b.centre]])[:, 0] - r - b.radius <= self.t + SLACK
                todo += self._leaves(b, [a.kids[i] for i in np.flatnonzero(near)])

    def edges(self):
        if not self.i:
            return np.zeros(0, int), np.zeros(0, int)
        i, j = np.concatenate(self.i), np.concatenate(self.j)
        label = local_components(len(self.x), i, j)
        moved = np.flatnonzero(label != np.arange(len(self.x)))
        return moved, label[moved]


def stack(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def join_cell(cosine: float):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        table = table.sort_by("guest")
        x = stack(table.column("embedding"), table.column("dim")[0].as_py())
        cid, guest = table.column("cid").to_numpy(), table.column("guest").to_numpy(zero_copy_only=False)
        found = Links(x, table.column("m").to_numpy(), cosine)
        home, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        if len(home):
            tree = grow(x, home)
            found.traverse(tree, tree)
            if len(guests):
                found.traverse(tree, grow(x, guests))
        i, j = found.edges()
        linked = np.flatnonzero(found.count)
        none = np.full(len(linked), -1)
        return pa.table({"src": np.concatenate([cid[i], cid[linked]]), "dst": np.concatenate([cid[j], none]), "n": np.concatenate([np.zeros(len(i), np.int64), found.count[linked]])}, schema=schema)

    return run


KEY = ["label", "dim", "cell"]


def runs(keys: list, centres: dict):
    """(key, rows of that key) for keys with centres, so few rows at a time that their distances fit in memory."""
    rows: dict[tuple, list] = {}
    for k, key in enumerate(keys):
        rows.setdefault(key, []).append(k)
    for key in rows.keys() & centres.keys():
        at, step = np.array(rows[key]), max(1, HELD // len(centres[key]))
        for k in range(0, len(at), step):
            yield key, at[k : k + step]


def keys_of(batch) -> list:
    return list(zip(*(batch.column(k).to_pylist() for k in KEY)))


def deal_home(centres):
    """Adds the number of the nearest centre and the distance to it."""

    def run(batches):
        for b in batches:
            near, dist = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for key, at in runs(keys_of(b), centres):
                d = distances(stack(b.column("embedding").take(pa.array(at)), key[1]), centres[key])
                near[at] = d.argmin(axis=1)
                dist[at] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(dist)], [*b.schema.names, "near", "dist"])

    return run


def deal_guests(centres, first, radius, t):
    """Every point of a split cell at home in its part, if it is at home in the cell, and as a guest in each part where a
    partner may be: a lower one for a point at home, any for a guest."""

    def run(batches):
        for b in batches:
            near, dist, guest = (b.column(n).to_numpy(zero_copy_only=False) for n in ("near", "dist", "guest"))
            take, where, guests = [], [], []
            for key, at in runs(keys_of(b), centres):
                c = centres[key]
                d = distances(stack(b.column("embedding").take(pa.array(at)), key[1]), c)
                apart = distances(c[near[at]], c)
                plane = (d * d - (dist[at] ** 2)[:, None]) <= 2 * (t + SLACK) * apart + SLACK
                go = plane & (d <= radius[key][None, :] + t + SLACK) & (guest[at][:, None] | (np.arange(len(c))[None, :] < near[at][:, None]))
                home = at[~guest[at]]
                i, k = np.nonzero(go)
                take += [home, at[i]]
                where += [first[key] + near[home], first[key] + k]
                guests += [np.zeros(len(home), bool), np.ones(len(i), bool)]
            idx = np.concatenate([np.zeros(0, np.int64), *take])
            rows = b.take(pa.array(idx))
            cols = [rows.column(n) for n in ("cid", "label", "dim", "m")]
            cols += [pa.array(np.concatenate([np.zeros(0, np.int64), *where])), pa.array(np.concatenate([np.zeros(0, bool), *guests])), rows.column("embedding"), rows.column("cell")]
            for k in range(0, len(idx), 4096):
                yield pa.RecordBatch.from_arrays([c.slice(k, 4096) for c in cols], ["cid", "label", "dim", "m", "cell", "guest", "embedding", "from"])

    return run


def pick_centres(live: DataFrame, big: DataFrame, cell_rows: int) -> dict:
    """{key: centres} for the largest cells of big(label, dim, cell, n); None for one that its sample cannot part."""
    spark = live.sparkSession
    picks = big.orderBy(F.desc("n"), *KEY).limit(PASS_CELLS).collect()
    most = max(2, min(PASS_CENTRES, SAMPLE_BYTES // (16 * max(r.dim for r in picks))))
    share = max(1.0, sum(max(2.0, 4 * r.n / cell_rows) for r in picks) / most)
    # the smaller cells wait for the next pass rather than take less than two centres
    want = {(r.label, r.dim, r.cell): max(2, int(4 * r.n / cell_rows / share)) for r in picks[: most // 2]}
    names = [(*key, int(-(2**63) + 2**64 * min(0.999, (2.0 * want[key] + 16) / r.n))) for key, r in zip(want, picks)]
    names = spark.createDataFrame(names, "label string, dim int, cell long, below long")
    sample = live.where("not guest").join(F.broadcast(names), KEY).where(F.xxhash64("cid") < F.col("below"))
    got = sample.select(*KEY, F.xxhash64("cid").alias("h"), "embedding").collect()  # about twice the centres, so about SAMPLE_BYTES
    got.sort(key=lambda r: r.h)
    of: dict[tuple, list] = {key: [] for key in want}
    for r in got:
        of[r.label, r.dim, r.cell].append(r.embedding)
    centres = {}
    for key, k in want.items():
        x = np.array(of[key][:k], np.float64)
        centres[key] = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) > 1 else None
    return centres


def cells(points: DataFrame, t: float, cell_rows: int) -> tuple[DataFrame, list]:
    """(cid, label, dim, m, cell, guest, embedding): points(cid, label, dim, m, embedding) dealt to cells; and tables that it reads."""
    spark = points.sparkSession
    columns = ["cid", "label", "dim", "m", "cell", "guest", "embedding"]
    live = points.withColumns({"cell": F.lit(0).cast("long"), "guest": F.lit(False)}).select(*columns)
    done, tables, number = [], [], 1
    while True:
        big = cut(live.where("not guest").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows))
        if big.isEmpty():
            done.append(live)
            break
        names = "label string, dim int, cell long"
        found = pick_centres(live, big, cell_rows)
        picked = spark.createDataFrame([*found], names)
        centres, first = {k: c for k, c in found.items() if c is not None}, {}
        for k, c in centres.items():
            first[k], number = number, number + len(c)
        shared = spark.sparkContext.broadcast(centres)  # bounded by SAMPLE_BYTES
        part = live.join(F.broadcast(picked), KEY, "left_semi").select(*columns)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in part.schema.fields)
        near = cut(part.mapInArrow(lambda it, shared=shared: deal_home(shared.value)(it), f"{kinds}, near long, dist double"))
        radius = {k: np.zeros(len(c)) for k, c in found.items() if c is not None}
        for r in near.where("not guest").groupBy(*KEY, "near").agg(F.max("dist").alias("r")).collect():  # a number for each centre
            if (r.label, r.dim, r.cell) in radius:
                radius[r.label, r.dim, r.cell][r.near] = r.r
        dealt = cut(near.mapInArrow(lambda it, shared=shared, first=first, radius=radius: deal_guests(shared.value, first, radius, t)(it), f"{kinds}, from long"))
        # what splitting does not thin out stays whole
        before = {(r.label, r.dim, r.cell): r for r in near.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("guest")).cast("long")).alias("home")).collect()}
        after = dealt.groupBy("label", "dim", F.col("from"), "cell").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("guest")).cast("long")).alias("home"))
        after = after.groupBy("label", "dim", "from").agg(F.sum("n").alias("n"), F.max("home").alias("home")).collect()
        after = {(r.label, r.dim, r["from"]): r for r in after}
        whole = [k for k in found if k not in centres or after[k].n > GROWTH * before[k].n or after[k].home > REST * before[k].home]
        done.append(live.join(big, KEY, "left_anti").select(*columns))
        tables += [live, big, near, dealt]
        if whole:
            stay = F.broadcast(spark.createDataFrame(whole, names))
            done.append(near.join(stay, KEY, "left_semi").select(*columns))
            dealt = dealt.join(stay.withColumnRenamed("cell", "from"), ["label", "dim", "from"], "left_anti")
        waiting = live.join(big.select(*KEY), KEY, "left_semi").join(F.broadcast(picked), KEY, "left_anti")
        live = cut(dealt.select(*columns).unionByName(waiting.select(*columns)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out, [*tables, live, big]


def near_duplicates(df: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component): other vectors linked directly, smallest id reachable."""
    t = float(np.sqrt(2 - 2 * cosine))
    vector = F.col("vector")
    # single precision stays single, all else is read as double
    kind = "float" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    usable = F.coalesce(F.col("label").isNotNull() & vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("embedding", F.when(usable, vector)).drop("vector")
    # vectors meet again by 128 bits of hash, not as a whole
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = rows.where("embedding is not null").groupBy("label", "h1", "h2", "embedding").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("low"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "h1", "h2", F.size("embedding").alias("dim"), "m", "low", "embedding"))
    dealt, tables = cells(classes.select("cid", "label", "dim", "m", "embedding"), t, cell_rows)
    found = cut(dealt.groupBy(*KEY).applyInArrow(join_cell(cosine), "src long, dst long, n long"))
    counts = found.where("dst < 0").groupBy(F.col("src").alias("cid")).agg(F.sum("n").alias("n"))
    groups = components(found.where("dst >= 0").select("src", "dst"))
    label = groups.toDF("cid", "root")
    known = classes.select("cid", "label", "h1", "h2", "m", "low").join(label, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    known = known.join(counts, "cid", "left").select("label", "h1", "h2", "low", "root", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    known = cut(known)
    release(*tables, classes, found, groups)
    low = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(low, "root").select("label", "h1", "h2", "n_links", "component")
    keyed = rows.where("embedding is not null").select("id", "label", "h1", "h2")
    linked = keyed.join(known, ["label", "h1", "h2"]).select("id", "n_links", "component")
    alone = rows.where("embedding is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return linked.unionByName(alone)


def op2(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
       least(v.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) AS component_id,
       least(v.vec_id, coalesce((SELECT min(r.b) FROM reach r WHERE r.a = v.vec_id), v.vec_id)) = v.vec_id AS kept
FROM v
"""

"""Operator 9: embedding near-dedup by E8 lattice hashing.

Equal vectors of a label are one class.  In each of several tables a class is
projected at random to some blocks of eight dimensions, each decoded to the
nearest point of the E8 lattice; the points together are its home cell.  It also
probes neighbouring cells: those that differ by one of the 240 shortest vectors
in one block, or two, and to which its projection leans most.  Vectors meet in a
cell that is home to one of them.

A random pair meets less and less often the more blocks a cell has, a near pair
too, so that more tables are needed.  :data:`STEPS` takes the blocks from the
rows of the largest label, which keeps the candidates of a vector few at every
size; the chance that a near pair meets follows from its cosine alone, as the
projections are Gaussian, so the tables of each step hold the recall for all
data and dimensions.

Meetings are verified by cosine in double precision; a pair that meets several
times counts at its first meeting only, so links can be summed where they are
found and no table of pairs is made.  Vectors are sent only to cells that two
classes share, and large cells are dealt out as pairs of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.blocks import NULL_ID, mix
from larkspur.llm.components import components
from larkspur.llm.hot import join_index
from larkspur.llm.scratch import Scratch

COSINE = 0.93
#: Vectors of the largest label up to which a step holds; blocks per cell, scale of the projection, probes and tables: recall 0.99 at COSINE.
STEPS = ((50_000, 2, 0.55, 3, 12), (500_000, 3, 0.5, 4, 20), (5_000_000, 3, 0.55, 4, 29), (1 << 62, 4, 0.45, 4, 32))
SEED = 11
#: Members of a cell that one task compares at once; numbers of a matrix of vectors that it multiplies at once.
PART, NUMBERS = 256, 1 << 22
#: Members from which on a cell is compared as one matrix product.
DENSE = 24


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        v = np.array([0.5 if bits >> i & 1 else -0.5 for i in range(8)])
        if (v < 0).sum() % 2 == 0:
            out.append(v)
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and if odd re-round the worst coordinate."""
    f = np.round(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    if len(odd):
        d = x[odd] - f[odd]
        worst = np.abs(d).argmax(axis=1)
        f[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 united with D8 + 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


class Tables:
    """Home and probe keys of unit vectors, the same in every process."""

    def __init__(self, dim: int, blocks: int, scale: float, probes: int, tables: int):
        rng = np.random.default_rng(SEED)
        self.blocks, self.probes, self.near = blocks, probes, neighbours()
        self.matrices = rng.standard_normal((tables, blocks, dim, 8)) * scale
        # a cell's hash is linear in its coordinates, so a move adds a number of its own
        self.factors = rng.integers(0, 1 << 63, (tables, blocks, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.moves = (self._whole(self.near)[None, None] * self.factors[:, :, None, :]).sum(axis=3)

    @staticmethod
    def _whole(points: np.ndarray) -> np.ndarray:
        return np.round(points * 2).astype(np.int64).astype(np.uint64)

    def keys(self, unit: np.ndarray, label: np.ndarray) -> np.ndarray:
        """(vector, table, 1 + probes): home first."""
        n, top = len(unit), min(self.probes, 240)
        out = np.empty((n, len(self.matrices), 1 + self.probes), np.uint64)
        for t, matrices in enumerate(self.matrices):
            total = np.zeros(n, np.uint64)
            cost, step = [], []
            for k, m in enumerate(matrices):
                x = unit @ m
                home = nearest_e8(x)
                total += (self._whole(home) * self.factors[t, k]).sum(axis=1)
                lean = (x - home) @ self.near.T
                for _ in range(top):
                    best = lean.argmax(axis=1)
                    at = (np.arange(n), best)
                    cost.append(1 - lean[at])  # half of what the squared distance grows by
                    step.append(self.moves[t, k][best])
                    lean[at] = -np.inf
            for a in range(self.blocks):
                for b in range(a):
                    for i in range(min(2, top)):
                        for j in range(min(2, top)):
                            cost.append(cost[a * top + i] + cost[b * top + j])
                            step.append(step[a * top + i] + step[b * top + j])
            own = mix(label.astype(np.uint64) * np.uint64(64) + np.uint64(t))
            out[:, t, 0] = mix(total + own)
            if top:
                cheapest = np.argsort(np.array(cost), axis=0)[: self.probes]
                out[:, t, 1:] = mix((total + own)[None] + np.take_along_axis(np.array(step), cheapest, axis=0)).T
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places, matrix) of list vectors without nulls."""
    dims = vectors.value_lengths().to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, vectors.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place joined to each place by the pairs and by what root says already."""
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


class Meetings:
    """Pairs of rows of cells that link and have their first meeting there."""

    def __init__(self, rows: dict[str, np.ndarray], unit: np.ndarray, place: np.ndarray, tables: Tables, cosine: float):
        """rows: sorted by cell; unit: distinct vectors, of which row i has unit[place[i]]."""
        self.rows, self.unit, self.place, self.tables, self.cosine = rows, unit, place, tables, cosine
        self.keys = np.empty((len(unit), len(tables.matrices), 1 + tables.probes), np.uint64)
        self.known = np.zeros(len(unit), bool)

    def _keys(self, place: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Keys are made again for vectors that link with something, and only for those."""
        at, first = np.unique(place, return_index=True)
        new = ~self.known[at]
        self.keys[at[new]] = self.tables.keys(self.unit[at[new]], label[first[new]])
        self.known[at] = True
        return self.keys[place]

    def _first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = self._keys(self.place[np.concatenate([x, y])], self.rows["label"][np.concatenate([x, y])])
        ka, kb = both[: len(x)], both[len(x) :]
        ab = (ka[:, :, :1] == kb).any(axis=2)  # home of x, met by y
        ba = (kb[:, :, :1] == ka).any(axis=2)
        table, at, far = np.argmax(ab | ba, axis=1), np.arange(len(x)), np.uint64(0xFFFFFFFFFFFFFFFF)
        return np.minimum(np.where(ab[at, table], ka[at, table, 0], far), np.where(ba[at, table], kb[at, table, 0], far)) == self.rows["key"][x]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        start, size = np.unique(self.rows["cell"], return_index=True, return_counts=True)[1:]
        for a, n in zip(start[size >= DENSE].tolist(), size[size >= DENSE].tolist(), strict=True):
            yield self._dense(np.arange(a, a + n))
        yield from self._sparse(np.repeat(start + size, size), np.repeat(size < DENSE, size))

    def _dense(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows x, which are one cell."""
        rows, unit = self.rows, self.unit[self.place[x]]
        each = lambda c: (rows[c][x][:, None], rows[c][x][None, :])
        near = np.triu(unit @ unit.T >= self.cosine, 1)
        near &= np.logical_or(*each("home")) & np.equal(*each("label")) & np.not_equal(*each("id"))
        if rows["p"][x[0]] != rows["q"][x[0]]:
            near &= np.not_equal(*each("part"))
        some = near.any(axis=0) | near.any(axis=1)
        x, near = x[some], near[np.ix_(some, some)]
        if not len(x):
            return x, x
        keys, here = self._keys(self.place[x], rows["label"][x]), rows["key"][x[0]]
        table = int(np.flatnonzero((keys[0] == here).any(axis=1))[0])

        def met(t: int) -> np.ndarray:  # [i, j]: j has the home of i
            home, out = keys[:, t, :1], np.zeros(near.shape, bool)
            for p in range(keys.shape[2]):
                out |= home == keys[None, :, t, p]
            return out

        for t in range(table):
            m = met(t)
            near &= ~(m | m.T)
            if not near.any():
                return x[:0], x[:0]
        m, home, far = met(table), keys[:, table, 0], np.uint64(0xFFFFFFFFFFFFFFFF)
        near &= np.minimum(np.where(m, home[:, None], far), np.where(m.T, home[None, :], far)) == here
        i, j = np.nonzero(near)
        return x[i], x[j]

    def _sparse(self, end: np.ndarray, few: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that few marks; end: where the cell of each row ends."""
        rows, at_once = self.rows, max(1, NUMBERS // max(1, self.unit.shape[1]))
        for d in range(1, DENSE):
            i = np.flatnonzero(few & (np.arange(len(end)) + d < end))
            if not len(i):
                break
            j = i + d
            ok = (rows["home"][i] | rows["home"][j]) & (rows["label"][i] == rows["label"][j]) & ((rows["p"][i] == rows["q"][i]) | (rows["part"][i] != rows["part"][j])) & (rows["id"][i] != rows["id"][j])
            i, j = i[ok], j[ok]
            for s in range(0, len(i), at_once):
                x, y = i[s : s + at_once], j[s : s + at_once]
                hit = np.einsum("ij,ij->i", self.unit[self.place[x]], self.unit[self.place[y]]) >= self.cosine
                if hit.any():
                    x, y = x[hit], y[hit]
                    here = self._first(x, y)
                    yield x[here], y[here]


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, steps: tuple[tuple[int, int, float, int, int], ...] = STEPS) -> DataFrame:
    """vec_id, n_links, component_id, kept per row.

    Defined results: a null label, and a vector that is null, empty, zero or
    has a null or non-finite component, links with nothing; vectors of
    different dimension never link; rows that repeat an id and a vector count
    as separate vectors of one class; a null id comes after all others;
    other columns, whatever their names, are ignored; an empty table gives an
    empty one.  Rows that repeat an id, or have none, link by their own
    vectors; a component is named by its smallest id.
    """
    own = Scratch(rows.sparkSession, "lattice")
    read = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (F.col(vec_col) if dict(rows.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")).alias("vec"), F.col(label_col).cast("long").alias("label"))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    marked = read.withColumn("ok", F.coalesce(good, F.lit(False)))
    class_key = F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vec").cast("array<string>")), 256)
    keyed = marked.withColumn("class", F.when(F.col("ok"), class_key))
    # a class goes by a number of its own: ids may repeat
    classes = keyed.where("ok").groupBy("class").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"), F.first("label").alias("label"))
    classes = own.save(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    figures = next(s[1:] for s in steps if largest <= s[0])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, Tables] = {}
        for batch in batches:
            ids, label = batch["id"].to_numpy(), batch["label"].to_numpy()
            for dim, at, vec in _by_dim(batch["vec"]):
                t = built.setdefault(dim, Tables(dim, *figures))
                for s in range(0, len(at), 2000):
                    x = at[s : s + 2000]
                    k = t.keys(_unit(vec[s : s + 2000]), label[x])
                    home = np.zeros(k.shape, bool)
                    home[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(ids[x], k.shape[1] * k.shape[2])), pa.array(home.reshape(-1))], ["key", "id", "home"])

    cells = own.save(classes.select("id", "label", "vec").mapInArrow(spread, "key long, id long, home boolean"), "cells")
    crowded = cells.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home").select("key", "n", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    crowded = own.save(crowded, "crowded")
    held = join_index(cells, crowded, "key", "n", cells.count(), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("p", F.least("part", "other")).withColumn("q", F.greatest("part", "other"))
    full = dealt.join(classes.select("id", "label", "copies", "vec"), "id").select("key", "id", "home", "part", "p", "q", "label", "copies", "vec")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[int, Tables] = {}

        def work(t: pa.Table) -> pa.RecordBatch:
            col = {c: t[c].to_numpy() for c in ("id", "part", "p", "q", "label", "copies")}
            col["home"] = np.array(t["home"].to_pylist(), bool)
            col["key"] = t["key"].to_numpy().view(np.uint64)
            out_id, out_links, out_root = [], [], []
            ids, first, place = np.unique(col["id"], return_index=True, return_inverse=True)
            for dim, at, vec in _by_dim(t["vec"].combine_chunks().take(pa.array(first))):
                x = np.flatnonzero(np.isin(place, at))
                own_rows = {c: v[x] for c, v in col.items()}
                cell = np.stack([own_rows["key"], own_rows["p"].astype(np.uint64), own_rows["q"].astype(np.uint64)], axis=1)
                own_rows["cell"] = np.cumsum(np.concatenate([[0], (cell[1:] != cell[:-1]).any(axis=1)]))
                among = np.searchsorted(at, place[x])
                met = Meetings(own_rows, _unit(vec), among, built.setdefault(dim, Tables(dim, *figures)), cosine)
                links, root = np.zeros(len(at), np.int64), np.arange(len(at))
                for a, b in met.pairs():
                    if len(a):
                        x, y = among[np.concatenate([a, b])], own_rows["copies"][np.concatenate([b, a])]
                        links += np.bincount(x, weights=y, minlength=len(at)).astype(np.int64)
                        root = _roots(root, among[a], among[b])
                some = np.flatnonzero(links)
                out_id.append(ids[at[some]])
                out_links.append(links[some])
                out_root.append(ids[at[root[some]]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (out_id, out_links, out_root)], ["id", "links", "root"])

        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            last = [t[c][t.num_rows - 1].as_py() for c in ("key", "p", "q")] if t.num_rows else None
            if last is None:
                continue
            whole = (t["key"].to_numpy() == last[0]) & (t["p"].to_numpy() == last[1]) & (t["q"].to_numpy() == last[2])
            cut = int(np.argmax(whole))  # the last cell may go on in the next batch
            if cut:
                yield work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield work(rest)

    # each cell part pair in one task, many of them in a task
    sorted_cells = full.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")
    found = own.save(sorted_cells.mapInArrow(compare, "id long, links long, root long"), "found")
    own.drop("cells", "crowded")
    comp = components(found.select("id", "root"), own, "joined")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    rooted = comp.unionByName(comp.select(F.col("root").alias("v"), "root").distinct())
    lows = rooted.join(classes.select(F.col("id").alias("v"), "low"), "v").groupBy("root").agg(F.min("low").alias("comp"))
    told = rooted.join(lows, "root").select(F.col("v").alias("id"), "comp")
    per_class = classes.select("class", "id", "low", "copies").join(links, "id", "left").join(told, "id", "left").select("class", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "low").alias("comp"))
    per_class = own.save(per_class, "figures")
    done = join_index(keyed.select("id", "class"), per_class, "class", "copies", rows.count(), "id", "left")
    component = F.coalesce("comp", "id")
    result = own.save(done.select("id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"), component.alias("component")), "result")
    own.drop("classes", "found", "figures")
    clean = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return result.select(clean("id").alias("vec_id"), "n_links", clean("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def op9_lattice_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 9 on all of ``embeddings``; nulls, repeated rows and other columns as :func:`near_vectors` says."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS c FROM l GROUP BY a),
r AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.root = l.a),
m AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id)
SELECT m.vec_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""

"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors are one class; vectors of different lengths never link. Classes are dealt into blocks of bounded size
around pivots (a bounded sample, PIVOTS at most for each of the LENGTHS most frequent lengths); block pairs whose pivots
lie too far apart for any link, by the triangle inequality of angles, are skipped. Every other pair of blocks is
multiplied in tiles: unit vectors are quantised to int8 with one scale a block, and each vector keeps the exact length e
of its rounding error. With products P = s_a s_b <q_a, q_b>,

    |cos - P| <= e_a + e_b + e_a e_b,

so only pairs with P + that bound >= threshold are computed again, in double precision. Only codes and error lengths are
sent for the first product; it names the vectors that stand in a possible pair, and those alone are fetched whole. (The
int8 codes are multiplied as float32, in slices of at most 1024 dimensions, where all sums are exact integers.) A task
returns link counts and a spanning forest of its links, never the links of a dense group one by one. Vectors are first
scaled by a power of two, so components may be as large or small as doubles are.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing (n_links 0,
component_id their own id, kept); a null id counts as the largest one; rows that repeat an id are vectors of their own;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from gridlake.llm.common import NULL_ID, connected_components, cut

THRESHOLD = 0.95
BLOCK = 4096
TILE = 1024
PIVOTS = 256
#: Lengths that get pivots; of any other length all pairs of blocks are multiplied.
LENGTHS = 4
#: For rounding in double precision.
SLACK = 1e-9
EXACT_DIMS = 1024


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """int8 codes of the unit vectors, their common scale, and the length of each vector's rounding error."""
    u = unit(x)
    scale = float(np.abs(u).max()) / 127 or 1.0
    q = np.rint(u / scale)
    return q.astype(np.int8), scale, np.linalg.norm(u - scale * q, axis=1) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes."""
    if a.shape[1] <= EXACT_DIMS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    return sum((a[:, i : i + EXACT_DIMS].astype(np.float32) @ b[:, i : i + EXACT_DIMS].astype(np.float32).T).astype(np.float64) for i in range(0, a.shape[1], EXACT_DIMS))


def possible(a, b, threshold: float):
    """Tiles of two blocks (dicts of q, scale, err) that hold pairs which may reach the threshold: where the tile begins, and the pairs in it."""
    for i in range(0, len(a["q"]), TILE):
        for j in range(0, len(b["q"]), TILE):
            ea, eb = a["err"][i : i + TILE], b["err"][j : j + TILE]
            s = a["scale"] * b["scale"]
            p = products(a["q"][i : i + TILE], b["q"][j : j + TILE])
            low = (threshold - ea.max() - eb.max() - ea.max() * eb.max()) / s
            y, x = np.divmod(np.flatnonzero(p.ravel() >= low - 1), p.shape[1])
            near = p[y, x].astype(np.float64) * s + ea[y] + eb[x] + ea[y] * eb[x] >= threshold - SLACK
            if near.any():
                yield i, j, y[near], x[near]


def tile_links(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks (dicts of q, scale, err, x) whose cosine is at least threshold."""
    left, right = [], []
    for i, j, y, x in possible(a, b, threshold):
        va, vb = scaled(a["x"][i : i + TILE]), scaled(b["x"][j : j + TILE])
        na, nb = np.linalg.norm(va, axis=1), np.linalg.norm(vb, axis=1)
        if len(y) > len(va) * len(vb) // 50:  # most are near: the whole tile at once
            dot = (va @ vb.T)[y, x]
        else:
            dot = np.concatenate([np.einsum("ij,ij->i", va[y[k : k + 65536]], vb[x[k : k + 65536]]) for k in range(0, len(y), 65536)])
        ok = dot / (na[y] * nb[x]) >= threshold
        left.append(i + y[ok])
        right.append(j + x[ok])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.withColumn("good", F.coalesce(F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False)))
    ident = F.coalesce("vec_id", F.lit(NULL_ID))
    rows = rows.select("vec_id", F.when(F.col("good"), F.col("v")).alias("v"))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min(ident).alias("id"), F.count("*").alias("n")).select("v", "id", "n", F.xxhash64("v").alias("h"), F.size("v").alias("dim")))
    lengths = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()}
    small = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    real = "<f4" if small else "<f8"  # floats are kept as floats: nothing is lost

    links = edges = None
    if lengths:
        pivots = {}
        for dim, n in lengths.items():
            got = classes.where(F.col("dim") == dim).orderBy("h", "id").limit(max(1, min(PIVOTS, n // block))).collect()  # PIVOTS rows at most
            pivots[dim] = unit(np.array([r.v for r in got]))

        def nearest(batches):
            for b in batches:
                cell, angle = np.zeros(b.num_rows, np.int64), np.full(b.num_rows, np.pi)
                of = b.column("dim").to_numpy()
                for dim, known in pivots.items():
                    at = np.flatnonzero(of == dim)
                    if len(at):
                        x = np.array(b.column("v").take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
                        c = np.clip(unit(x) @ known.T, -1, 1)
                        cell[at], angle[at] = c.argmax(1), np.arccos(c.max(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle)], [*b.schema.names, "cell", "angle"])

        placed = classes.mapInArrow(nearest, "v array<double>, id long, n long, h long, dim int, cell long, angle double")
        cells = placed.groupBy("dim", "cell").agg(F.max("angle").alias("angle"), F.ceil(F.count("*") / block).alias("salts"))
        around = {(r.dim, r.cell): r.angle for r in cells.where(F.col("dim").isin(*pivots)).select("dim", "cell", "angle").collect()}  # PIVOTS rows a length at most
        reach = float(np.arccos(threshold)) + 1e-6
        near = [
            (int(dim), int(c), int(d)) for (dim, c), angle in around.items() for (e, d), other in around.items()
            if e == dim and c <= d and np.arccos(np.clip(pivots[dim][c] @ pivots[dim][d], -1, 1)) <= angle + other + reach]

        def quantised(key, table):
            dim, cell, salt = (k.as_py() for k in key)
            x = np.array(table.column("v").combine_chunks().flatten(), np.float64).reshape(table.num_rows, dim)
            q, scale, err = quantise(x)
            one = lambda a, t: pa.array([a.astype(t).tobytes()], pa.binary())
            return pa.table([pa.array([dim], pa.int32()), pa.array([cell]), pa.array([salt], pa.int64()), *(one(table.column(c).to_numpy(), "<i8") for c in ("id", "h", "n")), one(q, np.int8), pa.array([scale]), one(err, "<f8"), one(x, real)],
                            ["dim", "cell", "salt", "id", "h", "n", "q", "scale", "err", "x"])

        schema = "dim int, cell long, salt long, id binary, h binary, n binary, q binary, scale double, err binary, x binary"
        dealt = placed.join(cells.select("dim", "cell", "salts"), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("h", F.lit(5)), F.col("salts")))
        blocks = cut(dealt.groupBy("dim", "cell", "salt").applyInArrow(quantised, schema)).withColumn("block", F.struct("dim", "cell", "salt"))
        spark = vectors.sparkSession
        names = blocks.select("dim", "cell", "block")
        cell_pairs = spark.createDataFrame(near, "dim int, c long, d long").union(
            names.where(~F.col("dim").isin(*pivots)).select("dim", F.lit(0).cast("long"), F.lit(0).cast("long")).distinct())
        pairs = (
            cell_pairs.join(names.select("dim", F.col("cell").alias("c"), F.col("block").alias("a")), ["dim", "c"]).join(names.select("dim", F.col("cell").alias("d"), F.col("block").alias("b")), ["dim", "d"])
            .where("c < d or a <= b").select("a", "b"))
        sides = pairs.select(F.struct("a", "b").alias("pair"), F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))

        def load(r, whole=True):
            dim = r["block"]["dim"]
            out = {"q": np.frombuffer(r["q"], np.int8).reshape(-1, dim), "err": np.frombuffer(r["err"], "<f8"), "scale": r["scale"]}
            if whole:
                out |= {"x": np.frombuffer(r["x"], real).reshape(-1, dim)} | {c: np.frombuffer(r[c], "<i8") for c in ("id", "h", "n")}
            return out

        def two_of(table, whole):
            at = sorted(table.to_pylist(), key=lambda r: (r["block"]["cell"], r["block"]["salt"]))
            return at, [load(r, whole) for r in at]

        sent = pa.schema([("pair", pa.struct([(x, pa.struct([("dim", pa.int32()), ("cell", pa.int64()), ("salt", pa.int64())])) for x in "ab"])), ("block", pa.struct([("dim", pa.int32()), ("cell", pa.int64()), ("salt", pa.int64())])), ("at", pa.binary())])

        def screen(key, table):
            """Of two blocks' codes: the places of vectors that stand in a possible pair."""
            rows_, two = two_of(table, False)
            seen = [np.zeros(len(x["q"]), bool) for x in two]
            for i, j, y, x in possible(two[0], two[-1], threshold):
                if len(two) == 1:
                    y, x = y[i + y != j + x], x[i + y != j + x]
                seen[0][i + y] = True
                seen[-1][j + x] = True
            out = [{"pair": r["pair"], "block": r["block"], "at": np.flatnonzero(s).astype("<u4").tobytes()} for r, s in zip(rows_, seen) if s.any()]
            return pa.Table.from_pylist(out, sent)

        def pick(batches):
            """Of a block, the vectors at some places."""
            for b in batches:
                out = []
                for r in b.to_pylist():
                    dim, at = r["block"]["dim"], np.frombuffer(r["at"], "<u4")
                    cut_ = lambda c, t, w=1: np.frombuffer(r[c], t).reshape(-1, w)[at].tobytes()  # noqa: B023, E731
                    out.append((r["pair"], r["block"], *(cut_(c, "<i8") for c in ("id", "h", "n")), cut_("q", np.int8, dim), r["scale"], cut_("err", "<f8"), cut_("x", real, dim)))
                if out:
                    types = [sent.field("pair").type, sent.field("block").type, *[pa.binary()] * 4, pa.float64(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["pair", "block", "id", "h", "n", "q", "scale", "err", "x"])

        def multiply(key, table):
            _, two = two_of(table, True)
            a, b = two[0], two[-1]
            i, j = tile_links(a, b, threshold)
            if len(two) == 1:
                i, j = i[i != j], j[i != j]  # both directions are there; a class's own copies are counted apart
                counts = np.bincount(i, a["n"][j], len(a["id"])).astype(np.int64)
                ids, h = a["id"], a["h"]
            else:
                counts = np.concatenate([np.bincount(i, b["n"][j], len(a["id"])), np.bincount(j, a["n"][i], len(b["id"]))]).astype(np.int64)
                ids, h = np.concatenate([a["id"], b["id"]]), np.concatenate([a["h"], b["h"]])
                j = j + len(a["id"])
            root = forest(i, j, len(ids))
            hit = np.flatnonzero(counts)
            return pa.table([pa.array(c) for c in (ids[hit], h[hit], counts[hit], ids[root[hit]], h[root[hit]])], ["id", "h", "links", "r_id", "r_h"])

        place = "struct<dim:int,cell:bigint,salt:bigint>"
        asked = blocks.select("block", "q", "scale", "err").join(sides, "block").groupBy("pair").applyInArrow(screen, f"pair struct<a:{place},b:{place}>, block {place}, at binary")
        fetched = asked.join(blocks, "block").select("pair", "block", "at", "id", "h", "n", "q", "scale", "err", "x").mapInArrow(
            pick, f"pair struct<a:{place},b:{place}>, block {place}, id binary, h binary, n binary, q binary, scale double, err binary, x binary")
        found = cut(fetched.groupBy("pair").applyInArrow(multiply, "id long, h long, links long, r_id long, r_h long"))
        links = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
        node = lambda i, h: F.struct(F.col(i).alias("id"), F.col(h).alias("h"))
        edges = found.where("id <> r_id or h <> r_h").select(node("id", "h").alias("a"), node("r_id", "r_h").alias("b"))

    if links is None:
        out = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    else:
        label = connected_components(edges).select(F.col("node.id").alias("id"), F.col("node.h").alias("h"), F.col("component.id").alias("c"))
        known = classes.join(links, ["id", "h"], "left").join(label, ["id", "h"], "left").select(
            "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("c", "id").alias("c"))
        out = rows.join(known, "v", "left").select(
            "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("c") < NULL_ID, F.col("c")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: The same in SQL, for finite vectors of one length.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp"""

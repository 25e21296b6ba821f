"""Merkle manifest of a dataset: a root digest, and for every document the proof that it lies under it.

H is the lower-case hex SHA-256 of its inputs end to end, digests as hex text. A document is a leaf: H of its fields, each
`-` if null, else its UTF-8 byte count, `:` and the value. The leaves of one tree (one value of the tree column) ascend by
id; while several nodes remain, every ARITY consecutive ones (the last run may have fewer, even one) become their H. What
remains is the tree's subroot. Subroots, by the tree's name (null first), are the leaves of the upper tree, whose remainder
is the root.

Method: fractal traversal. A block is an aligned run of ARITY**LEVELS nodes. It keeps a stack of existing subtrees of
HEIGHT levels, one above the other, which hold the siblings of the node at hand, and for each a desired subtree, the next
one, which grows by one leaf with every path that goes out and takes over when the node at hand leaves the existing one. So
paths come out in order, from a few hundred digests in memory. Blocks are independent: their roots are the nodes of the
next blocks up, and so on until one node is left, and each block's own upper path is appended to the paths it emits.

How it runs: places come from a range sort of the leaves' digests (texts never leave the scan) and counts of its partitions.
Every block is one group of at most 4096 digests. A tree's share of the rows doesn't matter, nor do repeated rows: ties of
id and digest are sorted by where they were read.

Defined results: a null id sorts first and is never tampered with; rows of one id go by digest; rows equal in all fields are
leaves of their own with equal digests and different proofs; a null tree is a tree of its own, other than an empty name; other
columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridlake.llm.common import cut, shuffle_parts

ARITY = 8
#: Levels of a block, and of one of its stacked subtrees.
LEVELS = 4
HEIGHT = 2
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

Path = list[tuple[bytes, bytes]]  # what stands left and right of the node, level by level


def H(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(n: int) -> int:
    """Levels from n nodes to one."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


class Subtree:
    """The nodes at levels base to base + levels - 1 above a range of leaves, made leaf by leaf."""

    def __init__(self, leaves: list[bytes], start: int, base: int, levels: int):
        self.leaves, self.at, self.base, self.top = leaves, start, base, base + levels
        self.start, self.end = start, min(start + ARITY**self.top, len(leaves))
        self.open: list[list[bytes]] = [[] for _ in range(self.top)]
        self.nodes: list[list[bytes]] = [[] for _ in range(levels)]

    def _push(self, level: int, digest: bytes) -> None:
        while True:
            self.open[level].append(digest)
            if level >= self.base:
                self.nodes[level - self.base].append(digest)
            if len(self.open[level]) < ARITY:
                return
            digest, self.open[level] = H(b"".join(self.open[level])) if level + 1 < self.top else b"", []
            level += 1
            if level == self.top:
                return

    def grow(self) -> None:
        if self.at < self.end:
            self._push(0, self.leaves[self.at])
            self.at += 1
            if self.at == self.end:
                for level in range(self.top - 1):  # the last, shorter runs
                    if self.open[level]:
                        last, self.open[level] = H(b"".join(self.open[level])), []
                        self._push(level + 1, last)

    def whole(self) -> Subtree:
        while self.at < self.end:
            self.grow()
        return self

    def siblings(self, leaf: int, level: int) -> tuple[bytes, bytes]:
        nodes, q = self.nodes[level - self.base], (leaf - self.start) // ARITY**level
        run = q - q % ARITY
        return b"".join(nodes[run:q]), b"".join(nodes[q + 1 : run + ARITY])


def traverse(leaves: list[bytes], levels: int):
    """The path of every leaf of a block, in order."""
    bands = [(b, min(HEIGHT, levels - b)) for b in range(0, levels, HEIGHT)]
    existing = [Subtree(leaves, 0, b, h).whole() for b, h in bands]
    desired = [Subtree(leaves, s.end, s.base, s.top - s.base) for s in existing]
    for i in range(len(leaves)):
        for k, s in enumerate(existing):
            if i == s.end:
                existing[k] = desired[k].whole()
                desired[k] = Subtree(leaves, existing[k].end, *bands[k])
        yield [s.siblings(i, level) for s in existing for level in range(s.base, s.top)]
        for s in desired:
            s.grow()


def fold(digest: bytes, path: Path) -> bytes:
    for left, right in path:
        digest = H(left + digest + right)
    return digest


def encoded(path: Path) -> bytes:
    return b"".join(bytes([len(a) // 64, len(b) // 64]) + a + b for a, b in path)


def decoded(data: bytes) -> Path:
    path, i = [], 0
    while i < len(data):
        mid = i + 2 + 64 * data[i]
        end = mid + 64 * data[i + 1]
        path.append((data[i + 2 : mid], data[mid:end]))
        i = end
    return path


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with pos, their place in their tree by `order`, and n, the tree's rows."""
    parts = shuffle_parts(rows.sparkSession)
    keys = ["tree", *order, "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("tie").withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows).withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy("tree", "part").agg(F.count("*").alias("m"), F.min("row").alias("first"))  # a row or so a partition
    whole = Window.partitionBy("tree")
    before = F.sum("m").over(whole.orderBy("part")) - F.col("m")
    counts = counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("m").over(whole).alias("n"))
    return rows.join(counts, ["tree", "part"]).withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _in_order(t: pa.Table) -> tuple[pa.Table, list[bytes], int]:
    """A block by place, its digests, the levels that it climbs."""
    t = t.sort_by("pos")
    return t, [x.encode() for x in t.column("digest").to_pylist()], min(LEVELS, height(t.column("n")[0].as_py()))


def _block_root(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
    _, nodes, levels = _in_order(t)
    for _ in range(levels):
        nodes = [H(b"".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
    n = -(-t.column("n")[0].as_py() // BLOCK)
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "digest": [nodes[0].decode()]})


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, pos, n, digest, ...) and the tables of block roots above them; the last has one row a tree."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        low = out[-1].select("tree", "pos", "n", "digest", _block())
        out.append(cut(low.groupBy("tree", "block").applyInArrow(_block_root, "tree string, pos long, n long, digest string")))
        most = -(-most // BLOCK)
    return out


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK).cast("long").alias("block")


def _groups(df: DataFrame):
    """Blocks, with columns of their own: both sides of a cogroup may come from one frame."""
    return df.select(*(F.col(c).alias(c) for c in df.columns)).groupBy("tree", "block")


def _appended(left: pa.Table, right: pa.Table) -> pa.Table:
    """Block and its upper path: the whole path of each node, and what the upper row says else."""
    t, nodes, levels = _in_order(left)
    upper = right.to_pylist()[0]
    paths = [encoded(p) + upper["path"] for p in traverse(nodes, levels)]
    same = {c: pa.array([upper[c]] * len(nodes), pa.string()) for c in ("subroot", "root")}
    return pa.table({"tree": t.column("tree"), "name": t.column("name"), "pos": t.column("pos"), "digest": t.column("digest"), "path": pa.array(paths, pa.binary()), **same})


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The upper path of every block of levels[0]: (tree, block, path, subroot, root). tops: the same for whole trees, block 0."""
    for nodes in reversed(levels[1:-1]):
        own = nodes.select("tree", F.lit(None).cast("string").alias("name"), "pos", "n", "digest", _block())
        tops = own.groupBy("tree", "block").cogroup(_groups(tops)).applyInArrow(
            _appended, "tree string, name string, pos long, digest string, path binary, subroot string, root string").select(
            "tree", F.col("pos").alias("block"), "path", "subroot", "root")
    return tops


def _upper(subroots: DataFrame) -> DataFrame:
    """(tree, block 0, path, subroot, root) of each tree: the path from its subroot to the root."""
    nodes = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "name")
    levels = _levels(nodes)
    tops = levels[-1].select("tree", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    own = nodes.select("tree", "name", "pos", "n", "digest", _block())
    return own.groupBy("tree", "block").cogroup(_groups(_down(levels, tops))).applyInArrow(
        _appended, "tree string, name string, pos long, digest string, path binary, subroot string, root string").select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root")


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(left: pa.Table, right: pa.Table, siblings: bool) -> pa.Table:
    t, nodes, levels = _in_order(left)
    upper = right.to_pylist()[0]
    above, root = decoded(upper["path"]), upper["root"].encode()
    rest = b"".join(a + b for a, b in above)
    proofs, folded, all_ = [], [], []
    for digest, other, path in zip(nodes, t.column("other").to_pylist(), traverse(nodes, levels)):
        proofs.append(H(b"".join(a + b for a, b in path) + rest).decode())
        folded.append(fold(fold(other.encode() if other else digest, path), above).decode())
        if siblings:
            all_.append([{"at": len(a) // 64, "digests": [(a + b)[i : i + 64].decode() for i in range(0, len(a + b), 64)]} for a, b in path + above])
    n = len(nodes)
    out = {"doc_id": t.column("doc_id"), "leaf": t.column("digest"), "subroot": [upper["subroot"]] * n, "root": [upper["root"]] * n, "proof_sha256": proofs,
           "folded_root": folded, "verified": [f.encode() == root for f in folded]}
    if siblings:
        out |= {"tree": [x[1:] or None if x else None for x in t.column("tree").to_pylist()], "pos": t.column("pos"),
                "siblings": pa.array(all_, pa.list_(pa.struct([("at", pa.int32()), ("digests", pa.list_(pa.string()))])))}
    return pa.table(out)


def leaf(*fields: Column) -> Column:
    """The digest of a document's fields."""
    one = (F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields)
    return F.sha2(F.concat(*one), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", fields: tuple[str, ...] = FIELDS, other: Column | None = None, siblings: bool = False) -> DataFrame:
    """The proof of every row: doc_id, leaf, subroot, root, proof_sha256 (H of the siblings), folded_root and verified.

    other: a digest to fold in the leaf's stead where it isn't null, for instance of a copy of the row found elsewhere;
    verified then tells whether that is what the manifest was made of. siblings adds tree (null for the null and the empty
    name), pos and siblings: for each level the node's place in its run and the digests beside it.
    """
    tree = F.when(F.col(tree_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    rows = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf(*(F.col(c) for c in fields)).alias("digest"),
                       (F.lit(None).cast("string") if other is None else other).alias("other"))
    nodes = _placed(cut(rows), "doc_id", "digest")  # written, so that the range sort's sample doesn't read the texts again
    levels = _levels(nodes)
    if len(levels) == 1:  # lone leaves, or nothing
        tops = _upper(nodes.select("tree", "digest"))
    else:
        tops = _down(levels, _upper(levels[-1].select("tree", "digest")))
    schema = _PROOFS + (", tree string, pos long, siblings array<struct<at int, digests array<string>>>" if siblings else "")
    return nodes.withColumn("block", _block()).groupBy("tree", "block").cogroup(_groups(tops)).applyInArrow(lambda a, b: _proved(a, b, siblings), schema)


def lowered(docs_text: Column) -> Column:
    return F.translate(docs_text, UPPER, UPPER.lower())


def tampered(id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest of a row whose text's A-Z are lower-cased where 3 divides crc32 of the id; null elsewhere."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return F.when(hit, leaf(*(lowered(F.col(c)) if c == text_col else F.col(c) for c in fields)))


def crc_of_nibbles(sql: str) -> str:
    """DuckDB SQL for the crc32 of a list of half bytes, the lower half of a byte first."""
    table = []
    for x in range(16):
        for _ in range(4):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        table.append(x)
    step = f"xor(a >> 4, list_extract({table}::bigint[], (xor(a, b) & 15) + 1))"
    return f"xor(list_reduce([4294967295::bigint] || {sql}, lambda a, b: {step}), 4294967295)"


def crc_of(sql: str) -> str:
    """DuckDB SQL for the crc32 of ASCII text."""
    return crc_of_nibbles(f"flatten(list_transform(string_split({sql}, ''), lambda c: [ascii(c)::bigint & 15, ascii(c)::bigint >> 4]))")


def _field(sql: str) -> str:
    return f"coalesce(strlen({sql}::varchar)::varchar || ':' || {sql}::varchar, '-')"


def oracle() -> str:
    low = f"translate(text, '{UPPER}', '{UPPER.lower()}')"
    one, two = (" || ".join(_field(t if f == "text" else f) for f in FIELDS) for t in ("text", low))
    return f"""
with recursive leaves as (
  select coalesce('=' || lang, '') as tree, doc_id, sha256({one}) as leaf,
    case when {crc_of('doc_id::varchar')} % 3 = 0 then sha256({two}) end as other from documents),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos from leaves),
up as (
  select tree, 0 as level, pos, leaf as digest, count(*) over (partition by tree) as n from placed
  union all
  select tree, level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from up where n > 1 group by tree, level, pos // 8, n),
subs as (select tree, digest as subroot, level as top from up where n = 1),
high as (
  select 0 as level, row_number() over (order by tree) - 1 as pos, subroot as digest, count(*) over () as n from subs
  union all
  select level + 1, pos // 8, sha256(string_agg(digest, '' order by pos)), (n + 7) // 8 from high where n > 1 group by level, pos // 8, n),
whole as (select digest as root from high where n = 1),
trees as (select tree, subroot, top, row_number() over (order by tree) - 1 as place from subs),
sides as (
  select p.tree, p.pos, u.level, string_agg(u.digest, '' order by u.pos) filter (u.pos < p.pos // pow(8, u.level)::bigint) as lefts,
    string_agg(u.digest, '' order by u.pos) filter (u.pos > p.pos // pow(8, u.level)::bigint) as rights
  from placed p join trees t on t.tree = p.tree join up u on u.tree = p.tree and u.level < t.top and u.pos // 8 = p.pos // pow(8, u.level + 1)::bigint
  group by p.tree, p.pos, u.level
  union all
  select p.tree, p.pos, t.top + h.level, string_agg(h.digest, '' order by h.pos) filter (h.pos < t.place // pow(8, h.level)::bigint),
    string_agg(h.digest, '' order by h.pos) filter (h.pos > t.place // pow(8, h.level)::bigint)
  from placed p join trees t on t.tree = p.tree join high h on h.n > 1 and h.pos // 8 = t.place // pow(8, h.level + 1)::bigint
  group by p.tree, p.pos, t.top, h.level),
folded as (
  select tree, pos, 0 as level, coalesce(other, leaf) as digest from placed
  union all
  select f.tree, f.pos, f.level + 1, sha256(coalesce(s.lefts, '') || f.digest || coalesce(s.rights, ''))
  from folded f join sides s on s.tree = f.tree and s.pos = f.pos and s.level = f.level),
ends as (select tree, pos, arg_max(digest, level) as folded_root from folded group by tree, pos),
proofs as (select tree, pos, sha256(string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' order by level)) as proof_sha256 from sides group by tree, pos)
select p.doc_id, p.leaf, t.subroot, w.root, coalesce(q.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = w.root as verified
from placed p join trees t on t.tree = p.tree cross join whole w join ends e on e.tree = p.tree and e.pos = p.pos
left join proofs q on q.tree = p.tree and q.pos = p.pos"""

"""The query catalogue over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.operators.axis import KEY, NAME, ORD, Axis, Categories, with_positions
from gridlake.operators.blocks import Blocks
from gridlake.operators.collection import Collection
from gridlake.operators.concat import concat, concat_axis
from gridlake.operators.element import Aligned, Matrix, Pairs, from_rows, to_rows
from gridlake.operators.grid import Grid
from gridlake.operators.index import Ranges, Taken
from gridlake.operators.merge import merge_maps
from gridlake.operators.stream import BatchStream
from gridlake.plans.refs import A
from gridlake.session import materialise, override
from gridlake.sources import store, text, zarr
from gridlake.streaming.ingest import append_grids

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f
    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder on storage that all executors share."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        materialise(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


# Fixtures
def sales(spark: SparkSession, d: str, once: bool = False) -> Grid:
    """Orders x parts. X: quantity; layers: price in cents and the number of lines. once: lines are summed once for all of them and written, for who reads them often."""
    line = table(spark, d, "lineitem")
    sums = {None: F.sum("l_quantity"), "price": F.round(F.sum("l_extendedprice") * 100).cast("long"), "n": F.count(F.lit(1))}
    by_cell = line.groupBy(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v"))
    if once:
        cells = materialise(by_cell.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums.values()))))
        layers = {k: Matrix(cells.select("o", "v", F.col(f"s{i}").alias("value"))) for i, k in enumerate(sums)}
    else:
        layers = {k: Matrix(by_cell.agg(c.alias("value"))) for k, c in sums.items()}
    return Grid(Axis.of(table(spark, d, "orders"), "o_orderkey"), Axis.of(table(spark, d, "part"), "p_partkey"), layers)


def regional(spark: SparkSession, d: str) -> dict[str, Grid]:
    """One grid per region of the supplier: the orders and parts of its lines, quantities."""
    line = table(spark, d, "lineitem")
    home = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    sold = materialise(line.join(home, "l_suppkey").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("v"), "l_quantity", "n_regionkey"))  # joined once for all grids and axes
    out = {}
    for r in range(5):
        mine = sold.where(F.col("n_regionkey") == r)
        axis = lambda c: Axis(mine.select(F.col(c).alias(KEY)).distinct().withColumn(NAME, F.col(KEY).cast("string")))  # noqa: E731, B023
        out[str(r)] = Grid(axis("o"), axis("v"), {None: Matrix(mine.groupBy("o", "v").agg(F.sum("l_quantity").alias("value")))})
    return out


def activity(spark: SparkSession, d: str) -> Grid:
    """Users x event types: events with value over 200."""
    e = table(spark, d, "events")
    hot = e.where("value > 200").groupBy(F.col("user_id").alias("o"), F.col("event_type").alias("v")).agg(F.count(F.lit(1)).alias("value"))
    return Grid(Axis.of(e.select("user_id").distinct(), "user_id"), Axis.of(e.select("event_type").distinct(), "event_type"), {None: Matrix(hot)})


def vectors(spark: SparkSession, d: str) -> Grid:
    v = table(spark, d, "embeddings")
    obs = Axis.of(v.select("vec_id", "label"), "vec_id")
    graph = v.select(F.col("vec_id").alias("i"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("j")).join(v.select(F.col("vec_id").alias("j")), "j", "left_semi")
    return Grid(obs, Axis.of_names(spark, [str(i) for i in range(64)]), {None: from_rows(v, "vec_id", "embedding")}, {"emb": Aligned.of(v, "vec_id", F.col("embedding").cast("array<double>"), 64)},
                obsp_={"near": Pairs.of(graph, "i", "j", (F.col("j") - F.col("i")).cast("double"))})


def customers(spark: SparkSession, d: str) -> Axis:
    c = table(spark, d, "customer")
    return Axis.of(c, "c_custkey", columns=["c_mktsegment", "c_acctbal"], categories={"c_mktsegment": Categories(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))})


SALES = "(SELECT l_orderkey AS o, l_partkey AS v, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"
REGIONAL = """(SELECT n_regionkey AS r, l_orderkey AS o, l_partkey AS v, sum(l_quantity) AS value FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3)"""


# Selection
@query(f"SELECT o, v, value FROM {SALES} WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def subset_mask_obs(spark, d):
    return sales(spark, d)[F.col("o_orderstatus") == "F"].X.df


@query(f"SELECT o, v, value FROM {SALES} WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND v IN (SELECT p_partkey FROM part WHERE p_size <= 5)")
def subset_two_axis(spark, d):
    return sales(spark, d)[F.col("o_orderstatus") == "F", F.col("p_size") <= 5].X.df


@query(f"SELECT o, v, value FROM {SALES} WHERE o IN (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i < 100)")
def subset_slice_pos(spark, d):
    return sales(spark, d)[:100].X.df


@query("""WITH p AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT 'step' AS kind, (i - 10) // 7 AS pos, k AS key FROM p WHERE i >= 10 AND i < 500 AND (i - 10) % 7 = 0
UNION ALL SELECT 'back', (n - 1 - i) // 3, k FROM p WHERE (n - 1 - i) % 3 = 0""")
def subset_slice_step(spark, d):
    g = sales(spark, d)
    a, b = g[10:500:7].obs.positions(), g[::-3].obs.rows
    return a.select(F.lit("step").alias("kind"), F.col("_ord").alias("pos"), F.col(KEY).alias("key")).union(b.select(F.lit("back"), KEY, F.col("_from")))


@query("SELECT c_custkey AS key, c_acctbal FROM customer WHERE c_custkey BETWEEN 100 AND 140")
def subset_label_slice(spark, d):
    return customers(spark, d).select(slice("100", "140")).rows.select(F.col(KEY).alias("key"), "c_acctbal")


@query(f"""WITH p AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
t AS (SELECT * FROM (VALUES (0, 5), (1, 3), (2, 3), (3, 10), (4, 0)) AS x(pos, i))
SELECT t.pos::BIGINT AS o, v, value FROM t JOIN p USING (i) JOIN {SALES} s ON s.o = p.k""")
def subset_take_dups(spark, d):
    return sales(spark, d)[[5, 3, 3, 10, 0]].X.df


@query(f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
q AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS j FROM p WHERE i % 2 = 1 AND i < 10000 AND o_orderstatus = 'O')
SELECT x.pos::BIGINT AS o, v, value FROM (VALUES (0, 7), (1, 2), (2, 7)) AS x(pos, j) JOIN q USING (j) JOIN {SALES} s ON s.o = q.k""")
def view_of_view(spark, d):
    return sales(spark, d)[1::2][:5000][F.col("o_orderstatus") == "O"][[7, 2, 7]].X.df


@query("""WITH e AS (SELECT vec_id AS i, vec_id + s AS j, s::DOUBLE AS value FROM embeddings, (VALUES (1), (7)) AS x(s))
SELECT i, j, value FROM e WHERE i IN (SELECT vec_id FROM embeddings WHERE label = 3) AND j IN (SELECT vec_id FROM embeddings WHERE label = 3)""")
def subset_pairwise(spark, d):
    return vectors(spark, d)[F.col("label") == 3].obsp["near"].df


@query(f"""SELECT 'raw' AS part, count(*) AS cells, sum(value) AS total FROM {SALES} WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'view', count(*), sum(value) FROM {SALES} WHERE o IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND v IN (SELECT p_partkey FROM part WHERE p_size > 40)""")
def raw_var_subset(spark, d):
    g = sales(spark, d).with_raw()[F.col("o_orderstatus") == "P", F.col("p_size") > 40]
    total = lambda m, n: m.df.agg(F.count("*").alias("cells"), F.sum("value").alias("total")).select(F.lit(n).alias("part"), "cells", "total")
    return total(g.raw.x, "raw").union(total(g.X, "view"))


@query("SELECT DISTINCT c_mktsegment AS category FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def unused_categories(spark, d):
    c = customers(spark, d)
    g = Grid(c, c).__getitem__((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") != "BUILDING")).unused_categories_removed()
    return spark.createDataFrame([(x,) for x in g.obs.categories["c_mktsegment"].values], "category string")


@query("SELECT o_orderkey AS key, CAST(o_orderkey AS VARCHAR) AS name, 'order ' || o_orderkey AS label FROM orders")
def names_replaced(spark, d):
    o = table(spark, d, "orders")
    g = Grid(Axis.of(o, "o_orderkey", columns=[]), customers(spark, d))
    new = g.with_names("obs", o.select("o_orderkey", F.concat(F.lit("order "), "o_orderkey").alias("l")), "o_orderkey", "l")
    return new.obs.rows.select(F.col(KEY).alias("key"), F.col(KEY).cast("string").alias("name"), F.col(NAME).alias("label"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at_ FROM orders)
SELECT o_orderkey AS key FROM p WHERE (at_ % 10 < 3 OR at_ < 100) AND NOT at_ BETWEEN 40 AND 49""")
def ranges_of_rows(spark, d):
    """A set of positions as runs: three of ten, and the first hundred, without ten of them."""
    a = Axis.of(table(spark, d, "orders"), "o_orderkey")
    n = a.count()
    some = Ranges.of(*((i, min(i + 3, n)) for i in range(0, n, 10)), (0, 100)) & Ranges.of((40, 50)).beside(n)
    return Grid(a, a)[some].obs.rows.select(F.col(KEY).alias("key"))


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS at_, count(*) OVER () AS n FROM orders), q AS (SELECT o_orderkey, (at_ - 5) // 2 AS s, (n - 5 + 1) // 2 AS m FROM p WHERE at_ >= 5 AND (at_ - 5) % 2 = 0),
t AS (SELECT i AS new, (i * 7919) % m AS s FROM q, range(0, 3000) r(i) WHERE q.s = (i * 7919) % m) SELECT new - 10 AS place, o_orderkey AS key FROM t JOIN q USING (s) WHERE new >= 10 AND new < 2900""")
def slice_of_take_of_slice(spark, d):
    """Every other row, of these a frame of positions with repeats, of that a slice."""
    a = Axis.of(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    half = Grid(a, a)[5::2]
    m = half.n_obs
    drawn = Taken.of(spark.range(3000), "id", (F.col("id") * 7919) % m)
    got = half[drawn][10:2900].obs
    return got.rows.select((F.col(KEY) - 10).alias("place"), F.col(NAME).cast("long").alias("key"))


# Concatenation
@query(f"""WITH x AS {REGIONAL}, c AS (SELECT v FROM (SELECT DISTINCT r, v FROM x) GROUP BY v HAVING count(*) = 5)
SELECT r::INTEGER AS src, o, v, value FROM x WHERE v IN (SELECT v FROM c)""")
def concat_inner_obs(spark, d):
    return concat(regional(spark, d)).X.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"SELECT r::INTEGER AS src, o, CAST(v AS VARCHAR) AS v, value FROM {REGIONAL}")
def concat_outer_obs(spark, d):
    return concat(regional(spark, d), join="outer").X.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"""WITH x AS {REGIONAL}, v AS (SELECT DISTINCT v FROM x), rv AS (SELECT DISTINCT r, v FROM x), ro AS (SELECT DISTINCT r, o FROM x),
gone AS (SELECT r, (SELECT count(*) FROM v) - count(*) AS n FROM rv GROUP BY r), rows AS (SELECT r, count(*) AS n FROM ro GROUP BY r)
SELECT r::INTEGER AS src, (SELECT count(*) FROM x WHERE x.r = rows.r) AS cells, rows.n * gone.n AS filled FROM rows JOIN gone USING (r)""")
def concat_outer_fill(spark, d):
    """Cells and fills of each input, counted without making the fills: these are as many as rows times absent columns."""
    m = concat(regional(spark, d), join="outer", fill_value=-1.0).X.tally(F.col("o.src").alias("src"))
    n = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0))
    return m.groupBy("src").agg(n(F.col("value") != -1).alias("cells"), n(F.col("value") == -1).alias("filled"))


@query("""SELECT CAST(c_custkey AS VARCHAR) || '-cust' AS name, 'cust' AS batch FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || '-supp', 'supp' FROM supplier""")
def concat_label_keys(spark, d):
    a, b = customers(spark, d), Axis.of(table(spark, d, "supplier"), "s_suppkey")
    return concat_axis([a, b], "inner", "batch", ["cust", "supp"], "-").rows.select(F.col(NAME).alias("name"), "batch")


def people(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    return [Axis.of(c.select("c_custkey", F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")), "c_custkey"),
            Axis.of(s.select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("company")), "s_suppkey")]


@query("SELECT CAST(c_custkey AS VARCHAR) AS name, c_acctbal AS acctbal, c_nationkey AS nation FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal, s_nationkey FROM supplier")
def concat_annot_inner(spark, d):
    return concat_axis(people(spark, d), "inner", None, ["a", "b"], None).rows.withColumnRenamed(NAME, "name").drop(KEY)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS name, c_acctbal AS acctbal, c_nationkey AS nation, c_mktsegment AS segment, NULL AS company FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_acctbal, s_nationkey, NULL, s_name FROM supplier""")
def concat_annot_outer(spark, d):
    return concat_axis(people(spark, d), "outer", None, ["a", "b"], None).rows.withColumnRenamed(NAME, "name").drop(KEY)


@query("SELECT CAST(c_custkey AS VARCHAR) AS name, c_acctbal > 0 AS solvent FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL FROM supplier")
def concat_bool_promotion(spark, d):
    c = Axis.of(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("solvent")), "c_custkey")
    s = Axis.of(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    return concat_axis([c, s], "outer", None, ["0", "1"], None).rows.select(F.col(NAME).alias("name"), "solvent")


@query(f"""SELECT o, 0 AS src, v, value FROM {SALES}
UNION ALL SELECT l_orderkey, 1, l_partkey, count(*)::DOUBLE FROM lineitem GROUP BY 1, 3""")
def concat_var_axis(spark, d):
    g = sales(spark, d)
    other = Grid(g.obs, g.var, {None: Matrix(g.elements["n"].df.withColumn("value", F.col("value").cast("double")))})
    m = concat([Grid(g.obs, g.var, {None: g.elements[None]}), other], axis="var").X.df
    return m.select("o", F.col("v.src").alias("src"), F.col("v.key").alias("v"), "value")


def halves(spark, d):
    g = vectors(spark, d)
    short = Aligned(g.obsm_["emb"].df.withColumn("value", F.slice("value", 1, 32)), 32)
    return [Grid(g.obs, g.var, {}, {"emb": g.obsm_["emb"]}), Grid(g.obs, g.var, {}, {"emb": short})]


def _sizes(g):
    return g.obsm_["emb"].df.select(F.col("_key.src").alias("src"), F.col("_key.key").alias("vec_id"), F.size("value").alias("width"), F.get("value", 31).alias("x31"), F.coalesce(F.get("value", 32), F.lit(-9.0)).alias("x32"))


@query("""SELECT 0 AS src, vec_id, 64 AS width, embedding[32]::DOUBLE AS x31, embedding[33]::DOUBLE AS x32 FROM embeddings
UNION ALL SELECT 1, vec_id, 64, embedding[32]::DOUBLE, 'NaN'::DOUBLE FROM embeddings""")
def concat_obsm_pad(spark, d):
    return _sizes(concat(halves(spark, d), join="outer"))


@query("""SELECT s AS src, vec_id, 32 AS width, embedding[32]::DOUBLE AS x31, -9.0::DOUBLE AS x32 FROM embeddings, (VALUES (0), (1)) AS t(s)""")
def concat_obsm_trunc(spark, d):
    return _sizes(concat(halves(spark, d), join="inner"))


@query("""WITH e AS (SELECT vec_id AS i, vec_id + s AS j, s::DOUBLE AS value FROM embeddings, (VALUES (1), (7)) AS x(s) WHERE vec_id + s IN (SELECT vec_id FROM embeddings))
SELECT b AS src, i, j, value FROM e, (VALUES (0), (1)) AS t(b)""")
def concat_pairwise(spark, d):
    g = vectors(spark, d)
    p = concat([g, g], pairwise=True).obsp_["near"].df
    return p.select(F.col("i.src").alias("src"), F.col("i.key").alias("i"), F.col("j.key").alias("j"), "value")


def annotated(spark, d):
    """Three grids over one set of parts: brand is the same, size differs in the second, price is only in the first, type is missing in the third."""
    p = table(spark, d, "part")
    one = lambda df: Grid(Axis.of(spark.range(1), "id"), Axis.of(df, "p_partkey"), {})
    return [one(p.select("p_partkey", "p_brand", "p_size", "p_retailprice", "p_type")), one(p.select("p_partkey", "p_brand", (F.col("p_size") + 1).alias("p_size"), "p_type")), one(p.select("p_partkey", "p_brand", "p_size"))]


def _merged(rule, columns):
    select = " UNION ALL ".join(f"SELECT '{c}' AS col, p_partkey AS v, CAST({c} AS VARCHAR) AS value FROM part" for c in columns)

    def run(spark, d):
        var = concat(annotated(spark, d), merge=rule).var
        parts = [var.rows.select(F.lit(c).alias("col"), F.col(KEY).alias("v"), F.col(c).cast("string").alias("value")) for c in var.columns]
        return reduce(DataFrame.union, parts)

    query(select, f"merge_{rule}")(run)


_merged("same", ["p_brand"])
_merged("unique", ["p_brand", "p_retailprice", "p_type"])
_merged("first", ["p_brand", "p_size", "p_retailprice", "p_type"])
_merged("only", ["p_retailprice"])

_N = "(SELECT count(*) FROM {})".format


@query(f"""SELECT 'same' AS rule, 'by.nation=' || {_N('nation')} || ';n=' || {_N('region')} AS merged
UNION ALL SELECT 'unique', 'by.nation=' || {_N('nation')} || ';more=' || {_N('part')} || ';n=' || {_N('region')}
UNION ALL SELECT 'first', 'by.nation=' || {_N('nation')} || ';by.who=' || {_N('supplier')} || ';more=' || {_N('part')} || ';n=' || {_N('region')}
UNION ALL SELECT 'only', 'more=' || {_N('part')}""")
def merge_uns(spark, d):
    n = {t: table(spark, d, t).count() for t in ("region", "nation", "supplier", "customer", "part")}
    maps = [{"n": n["region"], "by": {"nation": n["nation"], "who": n["supplier"]}}, {"n": n["region"], "by": {"nation": n["nation"], "who": n["customer"]}, "more": n["part"]},
            {"n": n["region"], "by": {"nation": n["nation"]}}]
    flat = lambda m, p="": [x for k, v in sorted(m.items()) for x in (flat(v, f"{p}{k}.") if isinstance(v, dict) else [f"{p}{k}={v}"])]
    return spark.createDataFrame([(r, ";".join(flat(merge_maps(maps, r)))) for r in ("same", "unique", "first", "only")], "rule string, merged string")


@query("SELECT p_partkey AS v, p_size + 1 AS size, p_brand || '/' || p_brand AS brand FROM part")
def merge_callable(spark, d):
    """A rule of one's own: the larger size, both brands."""
    rule = lambda maps: {"size": F.greatest(*(m["p_size"] for m in maps)), "brand": F.concat_ws("/", maps[0]["p_brand"], maps[1]["p_brand"])}
    return concat(annotated(spark, d)[:2], merge=rule).var.rows.select(F.col(KEY).alias("v"), "size", "brand")


def embedding_blocks(spark, d) -> list[Grid]:
    """Two dense grids of embeddings as blocks: places 0 to 39 of even ids, 20 to 63 of odd ones."""
    e = table(spark, d, "embeddings")
    out = []
    for odd, (a, z) in enumerate(((0, 40), (20, 64))):
        mine = e.where(F.col("vec_id") % 2 == odd)
        rows = mine.select("vec_id", F.slice("embedding", a + 1, z - a).cast("array<double>").alias("row"))
        var = Axis(spark.createDataFrame([(i, f"e{i:02}") for i in range(a, z)], f"{KEY} long, {NAME} string"))
        out.append(Grid(Axis.of(mine.select("vec_id"), "vec_id"), var, {None: Blocks.of_rows(rows, "vec_id", "row", list(range(a, z)))}))
    return out


PLACES = "(SELECT vec_id, i - 1 AS p, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"


@query(f"""SELECT (vec_id % 2)::INTEGER AS src, vec_id AS o, format('e{{:02d}}', p) AS v, CASE WHEN vec_id % 2 = 0 AND p < 40 OR vec_id % 2 = 1 AND p >= 20 THEN value END AS value FROM {PLACES}""")
def concat_outer_blocks(spark, d):
    """Dense inputs over different columns, as blocks: a union of rewritten arrays. What an input lacks is NaN, shown as null."""
    m = concat(embedding_blocks(spark, d), join="outer").X
    return m.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", F.when(~F.isnan("value"), F.col("value")).alias("value"))


@query(f"""SELECT (vec_id % 2)::INTEGER AS src, count(*) AS cells, round(sum(round(value, 6)), 3) AS total FROM {PLACES} WHERE p BETWEEN 20 AND 39 GROUP BY 1""")
def concat_inner_blocks(spark, d):
    m = concat(embedding_blocks(spark, d)).X
    return m.df.groupBy(F.col("o.src").alias("src")).agg(F.count("*").alias("cells"), F.round(F.sum(F.round("value", 6)), 3).alias("total"))


@query("""WITH x AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)
SELECT place // 300 AS chunk, min(place) AS start, max(place) + 1 AS end_, count(*) AS n, min(vec_id) AS first_key, arg_min(embedding[1]::DOUBLE, place) AS first_value, arg_max(embedding[64]::DOUBLE, place) AS last_value FROM x GROUP BY 1""")
def blocks_chunked(spark, d):
    """Chunks of 300 rows of a dense matrix, from blocks of another size."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("row"))
    b = Blocks.of_rows(rows, "vec_id", "row", list(range(64)), per_block=64 * 77).chunked(300)
    return b.select("chunk", "start", F.col("end").alias("end_"), F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).alias("first_key"), F.element_at("values", 1).alias("first_value"), F.element_at("values", -1).alias("last_value"))


@query("""WITH x AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id DESC) - 1 AS place FROM embeddings WHERE vec_id % 3 = 0)
SELECT place AS key, embedding[8]::DOUBLE AS a, embedding[3]::DOUBLE AS b, -1.0::DOUBLE AS c FROM x""")
def blocks_taken(spark, d):
    """Every third row in reverse order, two columns in another order and a new one."""
    e = table(spark, d, "embeddings")
    m = Blocks.of_rows(e.select("vec_id", F.col("embedding").cast("array<double>").alias("row")), "vec_id", "row", list(range(64)))
    want = with_positions(e.where("vec_id % 3 = 0").select(F.col("vec_id").alias(KEY), (-F.col("vec_id")).alias("_by")), "_by").select(F.col(ORD).alias("_new"), KEY)
    got = m.taken(want).reindexed([7, 2, 99], -1.0)
    return got.rows().select(F.col(KEY).alias("key"), F.get("_row", F.lit(0)).alias("a"), F.get("_row", F.lit(1)).alias("b"), F.get("_row", F.lit(2)).alias("c"))


@query("SELECT count(*) AS n, sum(value) AS total FROM " + REGIONAL + " WHERE r = 2")
def label_filter_pruning(spark, d):
    g = concat(regional(spark, d), join="outer", label="region")
    return g[F.col("region") == "2"].X.df.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"SELECT r::INTEGER AS src, o, CAST(v AS VARCHAR) AS v, value FROM {REGIONAL} WHERE o % 7 = 3")
def filter_own_src(spark, d):
    """A concatenation's rows by a column of their own that is called src."""
    g = concat(regional(spark, d), join="outer", label="region").with_column("obs", "src", F.col(f"{KEY}.key") % 7)
    return g[F.col("src") == 3].X.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"SELECT r::INTEGER AS src, o, CAST(v AS VARCHAR) AS v, value FROM {REGIONAL} WHERE o % 2 = 1 AND r <> 4")
def filter_replaced_label(spark, d):
    """The label column, first as the concatenation made it, then with other values."""
    g = concat(regional(spark, d), join="outer", label="region")[F.col("region") != "4"].with_column("obs", "region", (F.col(f"{KEY}.key") % 2).cast("string"))
    return g[F.col("region") == "1"].X.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"SELECT r::INTEGER AS src, o, CAST(v AS VARCHAR) AS v, value FROM {REGIONAL} WHERE r IN (2, 3)")
def filter_renamed_label(spark, d):
    """The label column after its categories were renamed, beside one that kept its name."""
    g = concat(regional(spark, d), join="outer", label="region").categories_renamed("obs", "region", {"2": "two"})
    return g[F.col("region").isin("two", "3")].X.df.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"SELECT r::INTEGER AS src, o, CAST(v AS VARCHAR) AS v, value FROM {REGIONAL} WHERE r <> 1")
def filter_random(spark, d):
    """Two random halves of a concatenation, which make the whole."""
    g = concat(regional(spark, d), join="outer", label="region")[F.col("region") != "1"]
    low = F.rand(11) < 0.5
    both = g[low].X.df.unionByName(g[~low].X.df)
    return both.select(F.col("o.src").alias("src"), F.col("o.key").alias("o"), "v", "value")


@query(f"""WITH p AS (SELECT o_orderkey AS o, row_number() OVER (ORDER BY o_orderkey) - 1 AS at_ FROM orders)
SELECT at_ // 500 AS batch, count(*) AS cells, sum(value) AS total, min(at_ % 500) AS first_place FROM {SALES} JOIN p USING (o) WHERE at_ // 500 >= 2 GROUP BY 1""")
def batch_stream(spark, d):
    """Batches of 500 orders, dealt to files once; what a cursor at the third batch has before it."""
    g = sales(spark, d)
    c = Collection(Grid(g.obs, g.var, {None: g.elements[None]}))
    s = BatchStream.resume(spark, {**BatchStream.write(c, scratch(spark), 500).cursor(), "next": 2})
    cells = spark.read.parquet(s.path).where(F.col("batch") >= s.next)
    return cells.groupBy("batch").agg(F.count("*").alias("cells"), F.sum("value").alias("total"), F.min("place").alias("first_place"))


@query("""WITH x AS (SELECT l_orderkey AS o, l_suppkey % 2 AS src, l_partkey % 3 AS bag, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price FROM lineitem WHERE l_orderkey % 4 = 1)
SELECT src::INTEGER AS src, o, bag, count(*) AS n, sum(part)::BIGINT AS parts, sum(CASE WHEN src = 0 THEN qty END) AS qty, round(sum(CASE WHEN src = 1 THEN price END), 2) AS price FROM x GROUP BY 1, 2, 3""")
def ragged_nested(spark, d):
    """Lists of lists of structs: an order's lines in bags, of two inputs with other fields, concatenated and cut to a quarter of the orders."""
    line = table(spark, d, "lineitem")

    def one(src, *fields):
        mine = line.where(F.col("l_suppkey") % 2 == src)
        item = F.struct((F.col("l_partkey") % 3).alias("bag"), F.struct(F.col("l_partkey").alias("part"), *fields).alias("line"))
        kept = mine.groupBy("l_orderkey").agg(F.collect_list(item).alias("all"))
        bags = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda b: F.transform(F.filter("all", lambda x: x["bag"] == b), lambda x: x["line"]))
        return Grid(Axis.of(kept.select("l_orderkey"), "l_orderkey"), Axis.of_names(spark, ["x"]), {}, {"bags": Aligned(kept.select(F.col("l_orderkey").alias(KEY), bags.alias("value")))})

    g = concat([one(0, F.col("l_quantity").alias("qty")), one(1, F.col("l_extendedprice").alias("price"))], join="outer")
    lines = g[F.col(f"{KEY}.key") % 4 == 1].obsm["bags"].df.select(KEY, F.posexplode("value").alias("bag", "lines")).select(KEY, "bag", F.explode("lines").alias("x"))
    return lines.groupBy(F.col(f"{KEY}.src").alias("src"), F.col(f"{KEY}.key").alias("o"), F.col("bag").cast("long").alias("bag")).agg(
        F.count("*").alias("n"), F.sum("x.part").alias("parts"), F.sum("x.qty").alias("qty"), F.round(F.sum("x.price"), 2).alias("price"))


# Reshape and references
@query("SELECT l_partkey AS o, count(DISTINCT l_orderkey) AS cells FROM lineitem GROUP BY 1")
def transpose_cells(spark, d):
    return sales(spark, d).T.X.df.groupBy("o").agg(F.count("*").alias("cells"))


TYPES = "SELECT DISTINCT event_type FROM events"


@query("""SELECT user_id, count(*) FILTER (value > 200 AND event_type = 'click') AS click, count(*) FILTER (value > 200 AND event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def to_df_pivot(spark, d):
    return activity(spark, d).to_df(names=["click", "purchase"]).select(F.col(KEY).alias("user_id"), "click", "purchase")


@query("SELECT vec_id, embedding[1]::DOUBLE AS emb1, embedding[2]::DOUBLE AS emb2, embedding[63]::DOUBLE AS emb63, embedding[64]::DOUBLE AS emb64 FROM embeddings")
def obsm_to_df(spark, d):
    g = vectors(spark, d)
    return g.obsm["emb"].to_df("emb", g.obs).select(F.col(KEY).alias("vec_id"), "emb1", "emb2", "emb63", "emb64")


@query(f"SELECT o_orderkey AS key, coalesce(value, 0) AS value FROM orders LEFT JOIN (SELECT * FROM {SALES} WHERE v = 17) ON o = o_orderkey")
def obs_vector(spark, d):
    return sales(spark, d).vector("obs", "17").select(F.col(KEY).alias("key"), "value")


@query(f"SELECT p_partkey AS key, coalesce(value, 0) AS value FROM part LEFT JOIN (SELECT * FROM {SALES} WHERE o = 7) ON v = p_partkey")
def var_vector(spark, d):
    return sales(spark, d).vector("var", "7").select(F.col(KEY).alias("key"), "value")


@query("""SELECT s_suppkey AS key, n_name || CASE WHEN i > 0 THEN '-' || i ELSE '' END AS name
FROM (SELECT s_suppkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS i FROM supplier JOIN nation ON n_nationkey = s_nationkey)""")
def make_unique(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a = Axis.of(s.select("s_suppkey", "n_name"), "s_suppkey", "n_name")
    return Grid(a, a).names_made_unique("obs").obs.rows.select(F.col(KEY).alias("key"), F.col(NAME).alias("name"))


@query("""SELECT c_custkey AS key, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'MACHINERY' THEN 'machines' ELSE c_mktsegment END AS segment FROM customer""")
def rename_categories(spark, d):
    c = customers(spark, d)
    g = Grid(c, c).categories_renamed("obs", "c_mktsegment", {"BUILDING": "construction", "MACHINERY": "machines"})
    return g.obs.rows.select(F.col(KEY).alias("key"), F.col("c_mktsegment").alias("segment"))


@query("""SELECT 'p_brand' AS col, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS categories FROM part
UNION ALL SELECT 'p_type', string_agg(DISTINCT p_type, ',' ORDER BY p_type) FROM part
UNION ALL SELECT 'p_name', string_agg(DISTINCT p_name, ',' ORDER BY p_name) FROM part HAVING count(DISTINCT p_name) < count(*)""")
def strings_to_categoricals(spark, d):
    a = Axis.of(table(spark, d, "part"), "p_partkey")
    got = Grid(a, a).strings_categorised().obs.categories
    return spark.createDataFrame([(c, ",".join(sorted(v.values))) for c, v in got.items()], "col string, categories string")


@query("""SELECT v AS value, row_number() OVER (ORDER BY substr(v, 4)::BIGINT) - 1 AS code FROM (SELECT DISTINCT source AS v FROM documents WHERE lang = 'fr' OR doc_id % 11 = 3)""")
def category_tables(spark, d):
    """Categories kept as tables: of two selections, concatenated, in natural order."""
    a = Axis.of(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    with override(local_categories=3):
        g = Grid(a, Axis.of_names(spark, ["x"])).strings_categorised()
    return concat([g[F.col("lang") == "fr"], g[F.col(KEY) % 11 == 3]]).obs.categories["source"].coded()


@query("SELECT vec_id AS key, label AS value FROM embeddings")
def ref_obs_column(spark, d):
    return vectors(spark, d)[A.resolve("obs.label")].select(F.col(KEY).alias("key"), "value")


@query("SELECT vec_id AS key, embedding[4]::DOUBLE AS value FROM embeddings")
def ref_obsm_dim(spark, d):
    return vectors(spark, d)[A.from_json(["obsm", "emb", 3])].select(F.col(KEY).alias("key"), "value")


@query("""SELECT vec_id AS key, CASE vec_id - 10 WHEN 1 THEN 1.0 WHEN 7 THEN 7.0 ELSE 0.0 END::DOUBLE AS value FROM embeddings""")
def ref_graph_row(spark, d):
    return vectors(spark, d)[A.resolve("obsp.near[10,:]")].select(F.col(KEY).alias("key"), "value")


@query("SELECT o_orderkey AS key, coalesce(n, 0)::BIGINT AS value FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey = 99 GROUP BY 1) ON l_orderkey = o_orderkey")
def ref_layer_column(spark, d):
    return sales(spark, d)[A.resolve("layers.n[:,99]")].select(F.col(KEY).alias("key"), "value")


_SAME = f"""NOT EXISTS (SELECT 1 FROM {SALES} a FULL JOIN ({{}}) b ON a.o = b.o AND a.v = b.v WHERE coalesce(a.value, 0) <> coalesce(b.value, 0))""".format


@query(f"""SELECT {_SAME(f"SELECT o, v, value FROM {SALES} UNION ALL SELECT o_orderkey, -1, 0.0 FROM orders")} AS with_zeros,
  {_SAME(f"SELECT o, v, CASE WHEN o = (SELECT min(l_orderkey) FROM lineitem) THEN value + 1 ELSE value END AS value FROM {SALES}")} AS with_change""")
def sparse_equal(spark, d):
    a = sales(spark, d).X
    zeros = Matrix(a.df.union(table(spark, d, "orders").select(F.col("o_orderkey"), F.lit(-1).cast("long"), F.lit(0.0))))
    least = table(spark, d, "lineitem").agg(F.min("l_orderkey")).first()[0]
    changed = Matrix(a.df.withColumn("value", F.when(F.col("o") == least, F.col("value") + 1).otherwise(F.col("value"))))
    return spark.createDataFrame([(a.same_as(zeros), a.same_as(changed))], "with_zeros boolean, with_change boolean")


@query("SELECT c_custkey AS o, 0::BIGINT AS v, c_acctbal AS value FROM customer UNION ALL SELECT c_custkey, 1, c_nationkey::DOUBLE FROM customer")
def frame_to_grid(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    return Grid.from_frame(c, "c_custkey").X.df


# Sources, sinks and the element store
@query("""SELECT CAST(user_id AS VARCHAR) AS name, event_type AS v, (count(*) FILTER (value > 200))::DOUBLE AS value FROM events GROUP BY 1, 2""")
def text_roundtrip(spark, d):
    path = scratch(spark)
    g = activity(spark, d)
    store.write_csvs(g, path)
    types = [r[0] for r in g.var.rows.select(NAME).collect()]
    lines = spark.read.option("header", True).csv(f"{path}/X")
    lines.select(F.concat_ws(",", "_name", *types).alias("value")).write.text(f"{path}/plain")
    back = text.read_csv(spark, f"{path}/plain", first_column_names=True)
    name = F.create_map(*(F.lit(x) for i, t in enumerate(types) for x in (i, t)))
    cells = back.X.df.join(back.obs.rows.select(F.col(KEY).alias("o"), F.col(NAME).alias("name")), "o")
    return cells.select("name", name[F.col("v").cast("int")].alias("v"), "value")


@query("SELECT CAST(user_id AS VARCHAR) AS o, event_type AS v, sum(value > 200)::DOUBLE AS value FROM events GROUP BY 1, 2")
def umi_long(spark, d):
    path = scratch(spark)
    e = table(spark, d, "events").select(F.col("event_type").alias("gene"), F.col("user_id").alias("cell"), F.when(F.col("value") > 200, 1.0).otherwise(0.0).alias("count"))
    e.write.option("sep", "\t").option("header", True).csv(path)
    return text.read_umi(spark, path).X.df


@query("SELECT (o_orderkey - 1) AS o, (p - 1)::BIGINT AS v, value FROM (SELECT l_orderkey AS o_orderkey, l_partkey AS p, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)")
def matrix_market(spark, d):
    path = scratch(spark)
    g = sales(spark, d)
    top = g.X.df.agg(F.max("o"), F.max("v"), F.count("*")).first()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{top[0]} {top[1]} {top[2]}",)], "value string").coalesce(1)
    head.union(g.X.df.select(F.concat_ws(" ", "o", "v", "value").alias("value"))).write.text(path)  # the head is the first part file
    return text.read_mtx(spark, path).X.df


@query("SELECT o_orderkey AS key, o_orderstatus, o_orderpriority, CAST(round(sum(l_extendedprice) * 100) AS BIGINT) AS price, l_partkey AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' GROUP BY 1, 2, 3, 5")
def element_store_partial(spark, d):
    path = scratch(spark)
    store.write(sales(spark, d), path)
    g = store.read(spark, path, elements=["layers/price"], obs_columns=["o_orderstatus", "o_orderpriority"], obs=F.col("o_orderstatus") == "P")
    return g.layer("price").df.join(g.obs.rows, F.col("o") == F.col(KEY)).select(F.col("o").alias("key"), "o_orderstatus", "o_orderpriority", F.col("value").alias("price"), "v")


@query(f"""WITH p AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders), q AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS v FROM part)
SELECT p.o, q.v, x.value, n_name.o_orderstatus AS status FROM {SALES} x JOIN p ON p.k = x.o JOIN q ON q.k = x.v JOIN orders n_name ON n_name.o_orderkey = x.o WHERE p.o BETWEEN 100 AND 4000""")
def zarr_rows(spark, d):
    """A chunked store of orders x parts: written, and a range of its rows read with their annotation."""
    path = scratch(spark)
    g = sales(spark, d)
    zarr.write_zarr(Grid(g.obs, g.var, {None: g.elements[None]}), path, chunk=2048)
    h = zarr.read_zarr(spark, path)
    cells = h.X.df.where("o BETWEEN 100 AND 4000")
    return cells.join(h.obs.df.select(F.col(KEY).alias("o"), F.col("o_orderstatus").alias("status")), "o").select("o", "v", "value", "status")


@query("""SELECT vec_id, embedding[1]::DOUBLE AS emb1, embedding[64]::DOUBLE AS emb64, label FROM embeddings""")
def zarr_dense(spark, d):
    """Dense arrays in chunks of rows: embeddings, written and read back as arrays; positions follow the ids."""
    path = scratch(spark)
    g = vectors(spark, d)
    zarr.write_zarr(Grid(g.obs, g.var, {}, {"emb": g.obsm_["emb"]}), path, chunk=8192)
    h = zarr.read_zarr(spark, path)
    rows = h.obs.df.join(h.obsm["emb"].df, KEY)
    return rows.select(F.col(NAME).cast("long").alias("vec_id"), F.get("value", F.lit(0)).cast("double").alias("emb1"), F.get("value", F.lit(63)).cast("double").alias("emb64"), "label")


@query(f"""SELECT o, v, value, o_orderpriority AS priority FROM {SALES} JOIN orders ON o_orderkey = o WHERE o BETWEEN 200 AND 900 OR o % 1000 = 7""")
def store_rows(spark, d):
    """Rows of a stored grid by key: a run of them, and points; only files whose zones they meet are opened."""
    path = scratch(spark)
    g = sales(spark, d)
    store.write(Grid(g.obs, g.var, {None: g.elements[None]}), path)
    most = g.obs.df.agg(F.max(KEY)).first()[0]
    points = store.Keys.of([k for k in range(7, most + 1, 1000) if not 200 <= k <= 900])
    parts = [store.read(spark, path, elements=["X"], keys=k) for k in (store.Keys.between(200, 900), points)]
    both = [p.X.df.join(p.obs.df.select(F.col(KEY).alias("o"), F.col("o_orderpriority").alias("priority")), "o").select("o", "v", "value", "priority") for p in parts]
    return both[0].unionByName(both[1])


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS since, count(*) AS n FROM orders GROUP BY 1")
def store_versions(spark, d):
    """A stored grid before and after an append, both read at the end."""
    path = scratch(spark)
    g = sales(spark, d)
    even = F.col(KEY) % 2 == 0
    store.write(Grid(g.obs, g.var, {None: g.elements[None]})[even], path)
    store.append(path, Grid(g.obs, g.var, {None: g.elements[None]})[~even])
    before, after = (store.read(spark, path, version=v).obs.df.select(KEY) for v in (1, 2))
    seen = after.join(before.withColumn("_old", F.lit(True)), KEY, "left")
    return seen.groupBy(F.when(F.col("_old"), "old").otherwise("new").alias("since")).agg(F.count("*").alias("n"))


@query(f"""SELECT o, v, value, o_orderstatus AS status, CASE WHEN o % 4 = 0 THEN 1 ELSE 2 END AS since FROM {SALES} JOIN orders ON o_orderkey = o""")
def stream_of_grids(spark, d):
    """A stored quarter of the orders, and a stream of the others with their lines, each batch a version; which had an order first."""
    path = scratch(spark)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("lines"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")

    def grid_of(rows, var):
        cells = rows.select(F.col("o_orderkey").alias("o"), F.explode("lines").alias("l")).groupBy("o", F.col("l.l_partkey").alias("v")).agg(F.sum("l.l_quantity").alias("value"))
        return Grid(Axis.of(rows.select("o_orderkey", "o_orderstatus"), "o_orderkey"), var, {None: Matrix(cells)})

    first = F.col("o_orderkey") % 4 == 0
    store.write(grid_of(orders.where(first), Axis.of(table(spark, d, "part"), "p_partkey")), f"{path}/grid")
    orders.where(~first).write.parquet(f"{path}/rows")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 8).parquet(f"{path}/rows")
    append_grids(stream, f"{path}/grid", f"{path}/log", grid_of).awaitTermination()
    g = store.read(spark, f"{path}/grid")
    old = store.read(spark, f"{path}/grid", version=1).obs.df.select(F.col(KEY).alias("o"), F.lit(1).alias("since"))
    return (g.X.df.join(g.obs.df.select(F.col(KEY).alias("o"), F.col("o_orderstatus").alias("status")), "o").join(old, "o", "left")
            .select("o", "v", "value", "status", F.coalesce("since", F.lit(2)).alias("since")))


@query(f"""SELECT (vec_id % 2)::INTEGER AS src, count(*) AS cells, count(CASE WHEN vec_id % 2 = 0 AND p < 40 OR vec_id % 2 = 1 AND p >= 20 THEN 1 END) AS filled,
round(sum(CASE WHEN vec_id % 2 = 0 AND p < 40 OR vec_id % 2 = 1 AND p >= 20 THEN round(value, 6) END), 3) AS total FROM {PLACES} GROUP BY 1""")
def concat_on_disk_dense(spark, d):
    """Stored dense grids concatenated into a new store, one of them in the long form."""
    path = scratch(spark)
    one, two = embedding_blocks(spark, d)
    store.write(one, f"{path}/a")
    store.write(Grid(two.obs, two.var, {None: two.elements[None].matrix()}), f"{path}/b")
    store.concat_on_disk(spark, [f"{path}/a", f"{path}/b"], f"{path}/both", join="outer")
    m = store.read(spark, f"{path}/both").X.df.where("NOT isnan(value)")
    every = store.read(spark, f"{path}/both").X.df.groupBy(F.col("o.src").alias("src")).agg(F.count("*").alias("cells"))
    return every.join(m.groupBy(F.col("o.src").alias("src")).agg(F.count("*").alias("filled"), F.round(F.sum(F.round("value", 6)), 3).alias("total")), "src")


@query("SELECT c_custkey AS key, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_acctbal > 0")
def structs_both_ways(spark, d):
    """Columns as structs and back, through an annotation of a collection without matrices."""
    from gridlake.functions.names import as_structs, from_structs

    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    packed = as_structs(c, ["c_mktsegment", "c_acctbal"], "both")
    a = Axis.of(packed, "c_custkey")
    col = Collection(Grid(a, Axis.of_names(spark, ["x"]), {None: Matrix(packed.select(F.col("c_custkey").alias("o"), F.lit(0).cast("long").alias("v"), F.lit(1.0).alias("value")))}))
    g = col[F.col("both.c_acctbal") > 0].to_grid(x=False, layers=False)
    return from_structs(g.obs.rows.select(F.col(KEY).alias("key"), "both"), "both").withColumnsRenamed({"c_mktsegment": "segment", "c_acctbal": "balance"})


@query("SELECT count(*) AS n_obs, (SELECT count(*) FROM " + SALES + ") AS cells, (SELECT sum(value) FROM " + SALES + ") AS total FROM orders")
def append_rows(spark, d):
    path = scratch(spark)
    g = sales(spark, d)
    one = F.col("o_orderkey") % 2 == 0
    store.write(Grid(g.obs, g.var, {None: g.elements[None]})[one], path)
    store.append(path, Grid(g.obs, g.var, {None: g.elements[None]})[~one])
    back = store.read(spark, path)
    return back.X.df.agg(F.count("*").alias("cells"), F.sum("value").alias("total")).select(F.lit(back.n_obs).cast("long").alias("n_obs"), "cells", "total")


@query("SELECT vec_id AS o, (i - 1)::BIGINT AS v, e::FLOAT AS value FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, 65)) AS i FROM embeddings) WHERE e <> 0")
def dense_to_sparse(spark, d):
    return from_rows(table(spark, d, "embeddings"), "vec_id", "embedding", sparse=True).df


@query("""SELECT user_id AS key, list_transform(['click', 'purchase'], lambda t: (len(list_filter(list(event_type) FILTER (value > 200), lambda x: x = t)))::DOUBLE)[1] AS first, count(*) FILTER (value > 200 AND event_type = 'purchase')::DOUBLE AS second FROM events GROUP BY 1""".replace(
    "list_transform(['click', 'purchase'], lambda t: (len(list_filter(list(event_type) FILTER (value > 200), lambda x: x = t)))::DOUBLE)[1]", "count(*) FILTER (value > 200 AND event_type = 'click')::DOUBLE"))
def sparse_to_dense(spark, d):
    g = activity(spark, d)
    place = F.when(F.col("v") == "click", 0).when(F.col("v") == "purchase", 1)
    m = Matrix(g.X.df.select("o", place.cast("long").alias("v"), "value").where("v is not null"))
    return to_rows(m, g.obs, 2).select(F.col(KEY).alias("key"), F.get("values", 0).alias("first"), F.get("values", 1).alias("second"))


# Ragged arrays, alignment, collections
@query("""SELECT b AS src, conv_id, count(*) AS turns, min(turn) AS first_turn, max(length(text))::INTEGER AS longest FROM conversations, (VALUES (0), (1)) AS t(b) GROUP BY 1, 2""")
def ragged_concat(spark, d):
    c = table(spark, d, "conversations")
    rag = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    g = Grid(Axis.of(c.select("conv_id").distinct(), "conv_id"), Axis.of_names(spark, ["x"]), {}, {"turns": Aligned.of(rag, "conv_id", "turns")})
    a = concat([g, g]).obsm_["turns"].df
    return a.select(F.col("_key.src").alias("src"), F.col("_key.key").alias("conv_id"), F.size("value").cast("long").alias("turns"), F.get("value", 0)["turn"].alias("first_turn"),
                    F.array_max(F.transform("value", lambda t: F.length(t["text"]))).alias("longest"))


@query("""WITH x AS (SELECT 0 AS src, c_custkey AS k FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier UNION ALL SELECT 2, p_partkey FROM part)
SELECT batch, count(*) AS size, min(src) AS first_src FROM (SELECT src, (row_number() OVER (ORDER BY src, k) - 1) // 64 AS batch FROM x) GROUP BY 1""")
def collection_batches(spark, d):
    var = Axis.of_names(spark, ["x"])
    gs = [Grid(Axis.of(table(spark, d, t).select(k), k), var) for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return Collection.of(gs).batches(64).groupBy("batch").agg(F.count("*").alias("size"), F.min("_key.src").alias("first_src"))


@query(f"""WITH p AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT (i // 6000) * 6000 AS start, least((i // 6000 + 1) * 6000, any_value(n)) AS "end", count(*) AS nnz FROM p JOIN {SALES} ON o = k GROUP BY i // 6000""")
def chunked_x(spark, d):
    return sales(spark, d).chunked(6000).groupBy("start", "end").agg(F.count("*").alias("nnz"))


@query("SELECT 0 AS src, c_custkey AS key, c_nationkey::DOUBLE AS x FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier")
def harmonize_dtypes(spark, d):
    var = Axis.of_names(spark, ["x"])
    a = Grid(Axis.of(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("x")), "c_custkey"), var)
    b = Grid(Axis.of(table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x")), "s_suppkey"), var)
    rows = Collection.of([a, b]).grid.obs.rows
    return rows.select(F.col("_key.src").alias("src"), F.col("_key.key").alias("key"), "x")


@query("SELECT d.doc_id AS key, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def labels_left_align(spark, d):
    docs = Axis.of(table(spark, d, "documents"), "doc_id", columns=["lang", "source"])
    g = Grid(docs, Axis.of_names(spark, ["x"])).with_annotation("obs", table(spark, d, "labels"), "doc_id")
    return g.obs.rows.select(F.col(KEY).alias("key"), "lang", "source", "quality", "toxic")


@query("SELECT o_orderkey AS key, o_orderpriority FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def subset_by_frame(spark, d):
    keys = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return sales(spark, d)[keys].obs.rows.select(F.col(KEY).alias("key"), "o_orderpriority")


_DRAWN = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)".format


@query(f"""WITH p AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
t AS (SELECT {_DRAWN("'1:' || k")} AS x FROM range(least(1000, (SELECT count(*) FROM orders))) AS r(k))
SELECT o_orderkey AS key, o_orderstatus FROM t JOIN p ON t.x % p.n = p.i""")
def sample_rows(spark, d):
    rows = sales(spark, d).sample_rows(1000, replace_=True, seed=1).obs.rows
    return rows.select(F.col("_from").alias("key"), "o_orderstatus")


@query(f"""SELECT o_orderkey AS key, o_orderstatus FROM orders ORDER BY {_DRAWN("'2:{\"_key\":' || o_orderkey || '}'")}, o_orderkey LIMIT 1000""")
def sample_rows_once(spark, d):
    return sales(spark, d).sample_rows(1000, replace_=False, seed=2).obs.rows.select(F.col(KEY).alias("key"), "o_orderstatus")


@query(f"""WITH p AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY {_DRAWN("'3:{\"_key\":' || o_orderkey || '}'")}, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT key, i // 256 AS batch FROM p WHERE i // 256 < n // 256""")
def shuffled_batches(spark, d):
    g = sales(spark, d)
    return Collection(g).batches(256, shuffle=True, drop_last=True, seed=3).select(F.col(KEY).alias("key"), "batch")


@query(f"""SELECT r::INTEGER AS src, o, v, value, r::VARCHAR AS region FROM {REGIONAL} WHERE r IN (1, 3)""")
def concat_on_disk(spark, d):
    """Two stored grids become a third, which is read back."""
    path = scratch(spark)
    parts = {k: g for k, g in regional(spark, d).items() if k in ("1", "3")}
    for k, g in parts.items():
        store.write(g, f"{path}/{k}")
    store.concat_on_disk(spark, {k: f"{path}/{k}" for k in parts}, f"{path}/both", join="outer", label="region")
    g = store.read(spark, f"{path}/both")
    return g.X.df.join(g.obs.rows.select(F.col(KEY).alias("o"), "region"), "o").select(
        F.col("region").cast("int").alias("src"), F.col("o.key").alias("o"), F.col("v").cast("long").alias("v"), "value", "region")


@query("""SELECT b.part, count(*) AS n, sum(b.x) AS total FROM (
  SELECT 'obs' AS part, o_custkey::DOUBLE AS x FROM orders UNION ALL SELECT 'X', value FROM (SELECT sum(l_quantity) AS value FROM lineitem GROUP BY l_orderkey, l_partkey)
  UNION ALL SELECT 'price', round(sum(l_extendedprice) * 100) FROM lineitem GROUP BY l_orderkey, l_partkey UNION ALL SELECT 'm', o_custkey::DOUBLE FROM orders) b GROUP BY 1""")
def append_every_element(spark, d):
    """A store of half the rows, and the other half appended: axis, layers, aligned array and raw all grow."""
    path = scratch(spark)
    g = sales(spark, d, once=True)
    g = g.with_element("obsm", "m", Aligned.of(table(spark, d, "orders"), "o_orderkey", F.array(F.col("o_custkey").cast("double")), 1)).with_raw()
    one = F.col("o_orderkey") % 2 == 0
    store.write(g[one], path)
    store.append(path, g[~one])
    back = store.read(spark, path)
    assert back.raw.x.same_as(g.raw.x)
    total = lambda df, c, n: df.agg(F.count("*").alias("n"), F.sum(F.col(c).cast("double")).alias("total")).select(F.lit(n).alias("part"), "n", "total")
    return total(back.obs.df, "o_custkey", "obs").union(total(back.X.df, "value", "X")).union(total(back.layer("price").df, "value", "price")).union(total(back.obsm["m"].column(0), "value", "m"))


@query("""SELECT t.i AS pos, t.name, coalesce(c_acctbal, -1.0) AS acctbal, CASE WHEN c_custkey IS NULL THEN 'none' ELSE c_mktsegment END AS segment
FROM (VALUES (0, '7'), (1, 'nobody'), (2, '3'), (3, '100')) AS t(i, name) LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = t.name""")
def reindexed_axis(spark, d):
    a = customers(spark, d).reindexed(["7", "nobody", "3", "100"], {"c_acctbal": -1.0, "c_mktsegment": "none"})
    return a.rows.select(F.col(KEY).cast("int").alias("pos"), F.col(NAME).alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))


@query(f"SELECT o, v, value FROM {SALES} WHERE o IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05)")
def subset_sparse_mask(spark, d):
    """A mask that is itself a sparse matrix of one column."""
    mask = Matrix(table(spark, d, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o"), F.lit(0).cast("long").alias("v"), F.lit(True).alias("value")).distinct())
    return sales(spark, d)[mask].X.df


@query(f"SELECT o_orderkey AS key, coalesce(value, 0) AS value FROM orders LEFT JOIN (SELECT * FROM {SALES} WHERE v = 17) ON o = o_orderkey WHERE o_orderstatus = 'F'")
def raw_vector(spark, d):
    g = sales(spark, d).with_raw()[F.col("o_orderstatus") == "F", F.col("p_size") > 40]
    return g.raw.vector(g.obs, "17").select(F.col(KEY).alias("key"), "value")


@query("""SELECT b AS src, conv_id, count(*) AS turns, count(CASE WHEN b = 0 THEN role END) AS roles FROM conversations, (VALUES (0), (1)) AS t(b) GROUP BY 1, 2""")
def ragged_fields(spark, d):
    """Ragged arrays with different fields: outer keeps all of them, null where one lacks it."""
    c = table(spark, d, "conversations")
    var = Axis.of_names(spark, ["x"])
    one = lambda *f: Grid(Axis.of(c.select("conv_id").distinct(), "conv_id"), var, {}, {"t": Aligned.of(c.groupBy("conv_id").agg(F.collect_list(F.struct(*f)).alias("t")), "conv_id", "t")})
    a = concat([one("turn", "role"), one("turn")], join="outer").obsm_["t"].df
    return a.select(F.col("_key.src").alias("src"), F.col("_key.key").alias("conv_id"), F.size("value").cast("long").alias("turns"), F.size(F.filter("value", lambda t: t["role"].isNotNull())).cast("long").alias("roles"))

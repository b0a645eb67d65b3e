"""Expression operators, combinators, sources, scalars and sweeps as queries over the star tables, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import scratch
from tributary.functions import scalars as S
from tributary.functions import text as X
from tributary.functions import values as V
from tributary.functions.hashing import HASH_LEN, hash_text
from tributary.operators import sweep
from tributary.plans import transforms as T
from tributary.sources import datasets, files
from tributary.sources.tables import table

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f
    return add


# --- expressions


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, l_extendedprice / (1 + l_tax) AS gross, 100 - l_quantity AS rest, 2 * l_quantity + 1 AS twice, l_linenumber / 2.0::DOUBLE AS half FROM lineitem")
def expr_arith(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_quantity").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.multiply(c("l_extendedprice"), 1 - c("l_discount")).alias("net"), V.divide(c("l_extendedprice"), 1 + c("l_tax")).alias("gross"),
        (100 - c("l_quantity")).alias("rest"), V.add(2 * c("l_quantity"), 1).alias("twice"), V.divide(c("l_linenumber"), 2).alias("half"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity = 10 AS eq, l_quantity <> 10 AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity > 10 AS gt, l_quantity >= 10 AS ge,
CASE WHEN l_linenumber - 1 <> 0 THEN l_suppkey ELSE l_linenumber - 1 END AS and_value, CASE WHEN l_linenumber - 1 <> 0 THEN l_linenumber - 1 ELSE l_suppkey END AS or_value, l_quantity < 10 AND l_tax > 0.04 AS both, l_quantity < 10 OR l_tax > 0.04 AS any FROM lineitem""")
def expr_compare_bool(spark: SparkSession, d: str) -> DataFrame:
    q, a, b = F.col("l_quantity"), (F.col("l_linenumber") - 1).cast("bigint"), F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (q == 10).alias("eq"), (q != 10).alias("ne"), (q < 10).alias("lt"), (q <= 10).alias("le"), (q > 10).alias("gt"), (q >= 10).alias("ge"),
        V.and_(a, b, "number").alias("and_value"), V.or_(a, b, "number").alias("or_value"), ((q < 10) & (F.col("l_tax") > 0.04)).alias("both"), ((q < 10) | (F.col("l_tax") > 0.04)).alias("any"))


@query("SELECT vec_id, embedding[1] AS first, embedding[-1] AS last, embedding[1:4] AS head, embedding[64] AS item63, len(embedding[61:64]) AS n_tail, [x for x, i in embedding[1:8] if i % 2 = 1] AS odd FROM embeddings")
def expr_item_slice(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        "vec_id", V.item(e, 0).alias("first"), V.item(e, -1).alias("last"), V.slice_(e, 0, 4).alias("head"), V.item(e, 63).alias("item63"),
        F.size(V.slice_(e, -4, 1000)).cast("bigint").alias("n_tail"), V.slice_(e, 0, 8, 2).alias("odd"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def expr_attribute(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k bigint").alias("p"), F.col("event_type").alias("kind")).alias("s"))
    return s.select("event_id", V.attribute(V.attribute(F.col("s"), "p"), "k").alias("k"), V.attribute(F.col("s"), "kind").alias("kind"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS label, repeat(p_brand, 2) AS twice, len([p_size, p_size + 1, 7]) AS n FROM part")
def expr_join_repeat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", V.add(V.add(F.col("p_brand"), "/", "string"), F.col("p_type"), "string").alias("label"), V.multiply(F.col("p_brand"), 2, "string").alias("twice"),
        F.size(V.add(F.array("p_size", F.col("p_size") + 1), F.array(F.lit(7)), "array")).cast("bigint").alias("n"))


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price FROM orders")
def expr_unpack(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")).alias("pair"))
    return V.unpack(s, "pair")


# --- combinators


@query("SELECT p_partkey, CAST((p_size + 1) * 2 AS BIGINT) AS value FROM part")
def map_fused(spark: SparkSession, d: str) -> DataFrame:
    f = T.compose(lambda c: c * 2, lambda c: (c + 1).cast("bigint"))
    return T.map_(f, table(spark, d, "part", "p_partkey", "p_size"), "p_size").select("p_partkey", "value")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_tax AS total FROM lineitem")
def starmap_add(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.array(F.struct(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.starmap(lambda a, b: a + b, pairs, ["a", "b"])[0].alias("total"))


@query("SELECT o_custkey, count(*) AS n_items, CAST(sum(l_linenumber) AS BIGINT) AS sum_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def flatten_lists(spark: SparkSession, d: str) -> DataFrame:
    per_order = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("items"))
    o = table(spark, d, "orders", "o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    flat = o.groupBy("o_custkey").agg(F.collect_list("items").alias("lists")).select("o_custkey", T.flatten(F.col("lists")).alias("items"))
    return flat.select("o_custkey", F.size("items").cast("bigint").alias("n_items"), T.reduce_(lambda a, x: a + x, F.col("items"), F.lit(0).cast("bigint")).alias("sum_items"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) t GROUP BY word")
def flat_map_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(T.flat_map(lambda x: F.split(x, " "), F.array("p_name"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, 10 AS n, round(list_sum(list_transform(range(1, 11), lambda i: CAST(embedding[i] AS DOUBLE) * embedding[i + 10])), 6) AS dot FROM embeddings")
def zip_shortest(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    z = table(spark, d, "embeddings").select("vec_id", F.slice(e, 1, 10).cast("array<double>").alias("a"), F.slice(e, 11, 20).cast("array<double>").alias("b"))
    z = z.select("vec_id", T.zip_(F.col("a"), F.col("b")).alias("z"))
    return z.select("vec_id", F.size("z").alias("n"), F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x["a"] * x["b"]), 6).alias("dot"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size FROM orders")
def cond_multi(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", T.cond(p > 200000, F.lit("large"), p > 100000, F.lit("medium"), F.lit("small")).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1.0 ELSE value / (event_id % 3) END AS ratio FROM events")
def catch_div(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.divide(F.col("value"), F.col("event_id") % 3, caught=-1.0).alias("ratio"))


@query("SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE event_id % 3 = 0) AS n_errors FROM events GROUP BY event_type")
def catch_all_errors(spark: SparkSession, d: str) -> DataFrame:
    attempt = F.try_divide(F.col("value"), F.col("event_id") % 3)
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(attempt.isNull()).alias("n_errors"))


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 = 0")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    _, bad = T.split_errors(table(spark, d, "events"), F.try_divide(F.col("value"), F.col("event_id") % 3), "ratio")
    return bad.select("event_id", "event_type")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0")
def catch_plan(spark: SparkSession, d: str) -> DataFrame:
    """A query over a missing table is replaced by the recovery."""
    return T.catch(lambda: table(spark, d, "no_such_table"), Exception, lambda e: table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0"))


@query("SELECT event_id, 'b' AS x, 'c' AS y FROM events")
def merge_maps(spark: SparkSession, d: str) -> DataFrame:
    m = T.merge_maps(F.create_map(F.lit("x"), F.lit("a"), F.lit("y"), F.lit("c")), F.create_map(F.lit("x"), F.lit("b")))
    return table(spark, d, "events", "event_id").select("event_id", m["x"].alias("x"), m["y"].alias("y"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM events")
def context_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", T.context_column(F.col("props"), "k", F.lit("none")).alias("k"), T.context_column(F.col("props"), "a.b", F.lit("none")).alias("missing"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS score FROM customer")
def eval_sql(spark: SparkSession, d: str) -> DataFrame:
    return T.eval_expr(table(spark, d, "customer", "c_custkey", "c_acctbal"), "balance * 2 + 1", "score", balance=F.col("c_acctbal")).select("c_custkey", "score")


@query("SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def partial_compose(spark: SparkSession, d: str) -> DataFrame:
    @T.transform(namespace="demo", version="1")
    def with_region(region: DataFrame, nation: DataFrame) -> DataFrame:
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    return with_region.partial(table(spark, d, "region"))(table(spark, d, "nation"))


@query("SELECT 'a' AS source, count(*) AS n FROM orders UNION ALL SELECT 'b', count(*) FROM customer")
def fork_join(spark: SparkSession, d: str) -> DataFrame:
    a, b = (T.fork(spark, lambda t=t: table(spark, d, t).count()) for t in ("orders", "customer"))
    return spark.createDataFrame([("a", T.join(a)), ("b", T.join(b))], "source string, n bigint")


# --- SQL, UDFs, sources and sinks


@query("SELECT p_brand, max(length(p_name)) AS longest FROM part GROUP BY p_brand")
def sql_view(spark: SparkSession, d: str) -> DataFrame:
    return datasets.sql_query(table(spark, d, "part"), "SELECT p_brand, CAST(max(length(p_name)) AS BIGINT) AS longest FROM dataset GROUP BY p_brand")


@query("SELECT p_partkey, p_retailprice * 1.1::DOUBLE AS price FROM part")
def udf_column(spark: SparkSession, d: str) -> DataFrame:
    def raised(x: pd.Series) -> pd.Series:
        return x * 1.1
    return table(spark, d, "part", "p_partkey", "p_retailprice").select("p_partkey", T.udf(raised, "double")(F.col("p_retailprice")).alias("price"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL")
def partitioned_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ds = datasets.Dataset(spark, scratch.new_path(spark, "roundtrip")).save(table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"), ["l_returnflag"])
    return ds.read(validate=True).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def _roundtrip(fmt: str):
    def f(spark: SparkSession, d: str) -> DataFrame:
        src = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal")
        ds = datasets.from_data(spark, src, scratch.new_path(spark, fmt), fmt)
        return ds.read(schema=src.schema).select("c_custkey", "c_name", "c_acctbal")
    f.__name__ = f"roundtrip_{fmt}"
    return f


for _fmt in ("csv", "json", "orc", "parquet"):
    query("SELECT c_custkey, c_name, c_acctbal FROM customer")(_roundtrip(_fmt))


@query("SELECT n_name AS line FROM nation")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch.new_path(spark, "lines")
    table(spark, d, "nation").select("n_name").write.text(path)
    return files.lines(spark, path).withColumnRenamed("value", "line")


@query("SELECT 2 AS n_files, true AS same_hash, true AS copied, 'blob' AS blob")
def file_identity(spark: SparkSession, d: str) -> DataFrame:
    root = scratch.new_path(spark, "files")
    for n in ("a", "b"):
        files.write_text(spark, f"{root}/x/{n}.txt", n)
    files.copy(spark, f"{root}/x", f"{root}/y")
    ids = files.content_identities(spark, f"{root}/x", "*.txt")
    same = files.set_hash(ids).first()[0] == files.set_hash(files.content_identities(spark, f"{root}/y", "*.txt")).first()[0]
    store = files.BlobStore(spark, f"{root}/store")
    blob = store.get(store.put(b"blob"))
    return spark.createDataFrame([(ids.count(), same, files.exists(spark, f"{root}/y/a.txt"), blob.decode())], "n_files bigint, same_hash boolean, copied boolean, blob string")


# --- texts


@query(r"SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(trim(text, E' '), '[ \t\n\x0B\f\r]+')) AS word FROM documents) t WHERE word <> '' GROUP BY word")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return X.count_words(table(spark, d, "documents", "text"), "text")


@query("SELECT word, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(p_name, ' ')), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) AS word FROM part) t GROUP BY word")
def clean_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(X.clean_word(F.col("w")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_PAGE = "'https://h' || (p_partkey % 7) || '.org/d/p.html'"


@query(f"""SELECT p_partkey, 'https://h' || (p_partkey % 7) || '.org' AS base, 'https://h' || (p_partkey % 7) || '.org/x/' || p_partkey AS absolute,
'https://h' || (p_partkey % 7) || '.org/d/y' || p_partkey AS relative, 'http://o.net/z' AS other, 2 AS n_links FROM (SELECT *, {_PAGE} AS page FROM part) t""")
def url_clean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    page = F.concat(F.lit("https://h"), (F.col("p_partkey") % 7).cast("string"), F.lit(".org/d/p.html"))
    html = F.concat(F.lit('<p><a class="c" href="/x/'), k, F.lit("?q=1\">t</a> <A HREF='y"), k, F.lit("#f'>u</A>"))
    found = table(spark, d, "part", "p_partkey").select("p_partkey", page.alias("page"), X.links(html).alias("links"))
    return found.select(
        "p_partkey", X.base_url(F.col("page")).alias("base"), X.clean_url(F.col("links")[0], F.col("page")).alias("absolute"), X.clean_url(F.col("links")[1], F.col("page")).alias("relative"),
        X.clean_url(F.lit("http://o.net/z?a#b"), F.col("page")).alias("other"), F.size("links").alias("n_links"))


@query("""SELECT 's' || (p_partkey // 4) AS sample, count(*) FILTER (WHERE p_partkey % 2 = 0) AS n_first, count(*) FILTER (WHERE p_partkey % 2 = 1) AS n_second FROM part GROUP BY 1""")
def read_pairs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.concat(F.lit("s"), F.floor(k / 4).cast("string"), F.lit("_R"), (k % 2 + 1).cast("string"), F.lit("."), k.cast("string"), F.lit(".fastq"))
    g = X.group_read_pairs(table(spark, d, "part", "p_partkey").select(name.alias("file")), "file")
    n = lambda r: F.coalesce(F.size(F.try_element_at("reads", F.lit(r))), F.lit(0)).cast("bigint")
    return g.select("sample", n("1").alias("n_first"), n("2").alias("n_second"))


@query("SELECT DISTINCT p_type AS color FROM part")
def distinct_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("color")).distinct()


@query("SELECT p_type AS color, count(*) AS n FROM part GROUP BY p_type")
def count_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("color")).agg(F.count(F.lit(1)).alias("n"))


# --- sweeps


_REGIONS = "SELECT CAST(o_orderkey AS BIGINT) AS s, CAST(o_orderkey + 1 + o_custkey % 50 AS BIGINT) AS e, CAST(1 + o_orderkey % 3 AS BIGINT) AS depth FROM orders"
_MERGED = f"""WITH r AS ({_REGIONS}), d AS (SELECT pos, sum(x) AS x FROM (SELECT s AS pos, depth AS x FROM r UNION ALL SELECT e, -depth FROM r) t GROUP BY pos),
m AS (SELECT pos AS start, lead(pos) OVER (ORDER BY pos) AS "end", CAST(sum(x) OVER (ORDER BY pos) AS BIGINT) AS depth FROM d)"""


def _regions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.cast("bigint").alias("s"), (k + 1 + F.col("o_custkey") % 50).cast("bigint").alias("e"), (1 + k % 3).cast("bigint").alias("depth"))


@query(_MERGED + ' SELECT start, "end", depth FROM m WHERE "end" IS NOT NULL')
def region_merge(spark: SparkSession, d: str) -> DataFrame:
    return sweep.merge_regions(_regions(spark, d), "s", "e", "depth")


@query("SELECT pos, CAST(sum(n) AS BIGINT) AS count FROM (SELECT l_partkey AS pos, l_linenumber AS n FROM lineitem UNION ALL SELECT p_partkey, p_size FROM part) t GROUP BY pos")
def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").select(F.col("l_partkey").alias("pos"), F.col("l_linenumber").cast("bigint").alias("count"))
    b = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_size").cast("bigint").alias("count"))
    return sweep.merge_counts(a, b)


@query(_MERGED + """, p AS (SELECT p_partkey AS pos, CAST(sum(p_size) AS BIGINT) AS num FROM part GROUP BY 1)
SELECT p.pos, num, m.depth AS denom, round(num / m.depth, 9) AS freq FROM p ASOF JOIN (SELECT * FROM m WHERE "end" IS NOT NULL) m ON p.pos >= m.start""")
def asof_point_region(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "part").groupBy(F.col("p_partkey").alias("pos")).agg(F.sum("p_size").alias("count"))
    out = sweep.allele_freq(points, sweep.merge_regions(_regions(spark, d), "s", "e", "depth"))
    return out.withColumn("freq", F.round("freq", 9))


@query("SELECT event_id, ts, coalesce(o.o_totalprice, -1) AS price FROM events ASOF LEFT JOIN (SELECT o_orderdate + INTERVAL 26 YEAR AS at, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) o ON ts >= o.at")
def asof_price(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "orders").select((F.col("o_orderdate") + F.expr("INTERVAL 26 YEAR")).alias("at"), F.col("o_totalprice").alias("price"))
    return sweep.as_of(table(spark, d, "events", "event_id", "ts"), marks, "ts", "at", "price").select("event_id", "ts", F.coalesce("price", F.lit(-1.0)).alias("price"))


@query("SELECT o_orderdate AS day, CAST(sum(n) OVER (ORDER BY o_orderdate) AS BIGINT) AS total FROM (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1) t")
def prefix_totals(spark: SparkSession, d: str) -> DataFrame:
    per_day = table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return sweep.prefix_sum(per_day, "day", "n", "total")


# --- scalars


#: Texts of tag values with their kinds and formatted forms (fixed values).
TAG_TEXTS = ["", "10", "-3", "2.5", "1e3", "true", "false", "null", "word", "two words", "a,b", "[1, 2]", '{"b": 1, "a": 2}', '"10"', "10x"]
_TAG_SQL = ", ".join("('" + x + "')" for x in TAG_TEXTS)


@query(f"""SELECT v AS text, CASE WHEN v = '' THEN 'null' WHEN regexp_matches(v, '^[\\[{{"]') THEN 'json' WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'int'
WHEN regexp_matches(v, '^[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' WHEN v = 'null' THEN 'null' WHEN v IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM (VALUES {_TAG_SQL}) t(v)""")
def parse_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in TAG_TEXTS], "text string").select("text", S.tag_value_kind(F.col("text")).alias("kind"))


@query("SELECT event_id, event_type AS key, json_extract_string(props, '$.k') AS value FROM events")
def tag_key_value(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("event_type", F.lit("="), F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", S.parse_tag(text).alias("t")).select("event_id", "t.key", "t.value")


@query("""SELECT name, namespace, hash, CASE WHEN length(name) > 8 THEN substr(name, 1, 5) || '...' ELSE name END AS short, CASE WHEN namespace <> '' THEN namespace || '.' || name ELSE name END AS fullname,
substr(hash, 1, 8) AS id8, CASE WHEN namespace <> '' THEN namespace ELSE '' END AS split_namespace, strftime(recorded_at, '%Y-%m-%d %H:%M:%S') AS at FROM task""")
def task_names(spark: SparkSession, d: str) -> DataFrame:
    full = S.fullname(F.col("namespace"), F.col("name"))
    return table(spark, d, "task").select(
        "name", "namespace", "hash", S.trim_string(F.col("name"), 8).alias("short"), full.alias("fullname"), S.short_id(F.col("hash")).alias("id8"),
        S.split_fullname(full)["namespace"].alias("split_namespace"), S.format_timestamp(F.col("recorded_at")).alias("at"))


@query("""SELECT rec_id, (x // 3600000000) || ':' || lpad(CAST((x // 60000000) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((x // 1000000) % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((x % 1000000) // 10000 AS VARCHAR), 2, '0') AS took
FROM (SELECT rec_id, ((epoch_us(end_time) - epoch_us(start_time)) % 86400000000 + 86400000000) % 86400000000 AS x FROM job WHERE end_time IS NOT NULL AND start_time IS NOT NULL) t""")
def durations(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "job", "rec_id", "start_time", "end_time").where("end_time is not null and start_time is not null")
    return j.select("rec_id", S.format_duration(F.expr("timestampdiff(MICROSECOND, start_time, end_time)")).alias("took"))


@query("SELECT p_partkey, CAST(greatest(1, pow(2, ceil(log2(p_size)) - 1)) AS BIGINT) AS mid, p_size % 2 = 0 AS flag FROM part")
def midpoints(spark: SparkSession, d: str) -> DataFrame:
    flag = S.to_bool(F.when(F.col("p_size") % 2 == 0, "TRUE").otherwise("False"))
    return table(spark, d, "part", "p_partkey", "p_size").select("p_partkey", S.midpoint(F.col("p_size")).alias("mid"), flag.alias("flag"))


@query()
def identities(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part", "p_partkey", "p_name")
    return x.select("p_partkey", hash_text(F.col("p_name")).alias("hash")).where(F.length("hash") == HASH_LEN)


QUERIES = Q

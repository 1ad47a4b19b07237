"""The order tables read as a graph: suppliers are files, parts symbols, orders commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import history

SYMBOL, COMMIT, DOC = 1_000_000_000, 2_000_000_000, 3_000_000_000
#: Co-changes of suppliers: the default confidence would leave none.
COCHANGE = {"max_files": 6, "min_support": 3, "min_confidence": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("nation_"), "s_nationkey", F.lit("/"), F.when(F.col("s_suppkey") % 7 == 0, "test/").otherwise(""), F.lit("supplier_"), "s_suppkey", F.lit(".ts"))
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    none = F.lit(None)
    return rows.select(
        F.col("s_suppkey").alias("id"), F.col("n_regionkey").cast("long").alias("repo_id"), F.lit("file").alias("kind"), none.cast("string").alias("subkind"),
        F.concat(F.lit("supplier_"), "s_suppkey", F.lit(".ts")).alias("name"), none.cast("string").alias("qualified_name"), path.alias("file_path"),
        none.cast("int").alias("start_line"), none.cast("int").alias("end_line"), F.lit("typescript").alias("language"), none.cast("string").alias("signature"),
        none.cast("string").alias("doc"), F.lit(False).alias("exported"), none.cast("string").alias("meta"), F.col("s_suppkey").alias("ord"),
    )


def symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("home"))
    files = file_nodes(spark, sf_dir).select(F.col("id").alias("home"), "repo_id", "file_path")
    words = F.split("p_name", " ")
    camel = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100))
    name = F.concat(camel(words[0]), camel(words[1]), "p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("class", "function", "method", "interface", "constant")])
    id_ = (F.col("p_partkey") + SYMBOL).alias("id")
    rows = table(spark, sf_dir, "part").join(home, F.col("p_partkey") == F.col("l_partkey")).join(files, "home")
    return rows.select(
        id_, "repo_id", F.lit("symbol").alias("kind"), kinds[F.col("p_size") % 5].alias("subkind"), name.alias("name"), F.concat("p_brand", F.lit("."), name).alias("qualified_name"), "file_path",
        F.col("p_size").alias("start_line"), (F.col("p_size") + F.col("p_partkey") % 30).cast("int").alias("end_line"), F.lit("typescript").alias("language"), F.lit(None).cast("string").alias("signature"),
        F.concat("p_type", F.lit(" "), "p_name").alias("doc"), (F.col("p_partkey") % 2 == 0).alias("exported"), F.lit(None).cast("string").alias("meta"), id_.alias("ord"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, sha, subject, ord): conventional subjects with a scope, but for status P."""
    scope = F.concat(F.lower(F.regexp_replace(F.substring("o_orderpriority", 3, 20), " ", "-")), F.lit("-"), F.col("o_custkey") % 50)
    subject = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("chore: order "), "o_orderkey")).otherwise(F.concat(F.when(F.col("o_orderstatus") == "O", "feat(").otherwise("Fix("), scope, F.lit("): order "), "o_orderkey"))
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") + COMMIT).alias("id"), F.md5(F.col("o_orderkey").cast("string")).alias("sha"), subject.alias("subject"), F.col("o_orderkey").alias("ord"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_nodes(spark, sf_dir).unionByName(symbol_nodes(spark, sf_dir))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("file")).distinct()


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part calls those on the next line of an order."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = line.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), (F.col("l_partkey") + SYMBOL).alias("src"))
    b = line.select("l_orderkey", "l_linenumber", (F.col("l_partkey") + SYMBOL).alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src <> dst").select("src", "dst").distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, kind, weight): contains, calls and co_change."""
    home = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("src"))
    inner = home.select("src", (F.col("l_partkey") + SYMBOL).alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("weight"))
    calls = call_edges(spark, sf_dir).select("src", "dst", F.lit("calls").alias("kind"), F.lit(1.0).alias("weight"))
    pairs = history.mine_cochanges(changes(spark, sf_dir), **COCHANGE, max_pairs=None)
    together = pairs.select(F.col("file_a").alias("src"), F.col("file_b").alias("dst"), F.lit("co_change").alias("kind"), F.col("confidence").alias("weight"))
    return inner.unionByName(calls).unionByName(together)


#: The same tables in SQL, for the checks.
SQL = f"""
with files as (
  select s_suppkey as id, cast(n_regionkey as bigint) as repo_id, 'file' as kind, cast(null as varchar) as subkind, 'supplier_' || s_suppkey || '.ts' as name,
    cast(null as varchar) as qualified_name, 'nation_' || s_nationkey || '/' || case when s_suppkey % 7 = 0 then 'test/' else '' end || 'supplier_' || s_suppkey || '.ts' as file_path,
    cast(null as integer) as start_line, cast(null as integer) as end_line, 'typescript' as language, cast(null as varchar) as doc, false as exported, s_suppkey as ord
  from supplier join nation on s_nationkey = n_nationkey
), homes as (
  select l_partkey, min(l_suppkey) as home from lineitem group by 1
), named as (
  select *, upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || p_partkey as name from part
), symbols as (
  select p_partkey + {SYMBOL} as id, f.repo_id, 'symbol' as kind, case p_size % 5 when 0 then 'class' when 1 then 'function' when 2 then 'method' when 3 then 'interface' else 'constant' end as subkind,
    p.name, p_brand || '.' || p.name as qualified_name, f.file_path, p_size as start_line, cast(p_size + p_partkey % 30 as integer) as end_line, 'typescript' as language,
    p_type || ' ' || p_name as doc, p_partkey % 2 = 0 as exported, p_partkey + {SYMBOL} as ord
  from named p join homes on p_partkey = l_partkey join files f on f.id = home
), nodes as (
  select * from files union all select * from symbols
), calls as (
  select distinct a.l_partkey + {SYMBOL} as src, b.l_partkey + {SYMBOL} as dst from lineitem a join lineitem b
  on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 where a.l_partkey <> b.l_partkey
), changes as (
  select distinct l_orderkey as commit_id, l_suppkey as file from lineitem
), narrow as (
  select * from changes where commit_id in (select commit_id from changes group by 1 having count(*) <= 6)
), times as (
  select file, count(*) as n from narrow group by 1
), pairs as (
  select a.file as file_a, b.file as file_b, count(*) as support from narrow a join narrow b on a.commit_id = b.commit_id and a.file < b.file group by 1, 2 having count(*) >= 3
), cochange as (
  select file_a, file_b, support, support / least(ta.n, tb.n) as confidence from pairs join times ta on ta.file = file_a join times tb on tb.file = file_b where support / least(ta.n, tb.n) >= 0.05
), edges as (
  select home as src, l_partkey + {SYMBOL} as dst, 'contains' as kind, cast(1.0 as double) as weight from homes
  union all select src, dst, 'calls', cast(1.0 as double) from calls
  union all select file_a, file_b, 'co_change', confidence from cochange
), commits as (
  select o_orderkey + {COMMIT} as id, md5(cast(o_orderkey as varchar)) as sha, o_orderkey as ord,
    case when o_orderstatus = 'P' then 'chore: order ' || o_orderkey
    else case when o_orderstatus = 'O' then 'feat(' else 'Fix(' end || lower(replace(substr(o_orderpriority, 3), ' ', '-')) || '-' || (o_custkey % 50) || '): order ' || o_orderkey end as subject
  from orders
)
"""

"""Scalar, array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.catalog import query, table
from weir.functions import python


@query(r"""SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, CAST(length(c_name) AS INT) AS len, substr(c_name, 2, 5) AS part, reverse(c_name) AS rev,
lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, replace(c_mktsegment, 'A', '_') AS replaced, concat_ws('-', c_mktsegment, c_name) AS joined,
split_part(c_name, '#', 2) AS tail, regexp_replace(c_name, '[0-9]+', 'N') AS masked, c_name LIKE '%9%' AS has_nine, starts_with(c_mktsegment, 'B') AS b, md5(c_name) AS digest,
trim('  ' || c_mktsegment || ' ') AS trimmed, CAST(levenshtein(c_mktsegment, 'BUILDING') AS INT) AS edits FROM customer""")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(name).alias("up"), F.lower(name).alias("low"), F.length(name).alias("len"), F.substring(name, 2, 5).alias("part"), F.reverse(name).alias("rev"),
        F.lpad(key.cast("string"), 8, "0").alias("padded"), F.replace(seg, F.lit("A"), F.lit("_")).alias("replaced"), F.concat_ws("-", seg, name).alias("joined"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("tail"), F.regexp_replace(name, "[0-9]+", "N").alias("masked"), name.like("%9%").alias("has_nine"), seg.startswith("B").alias("b"), F.md5(name.cast("binary")).alias("digest"),
        F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("trimmed"), F.levenshtein(seg, F.lit("BUILDING")).alias("edits"),
    )


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q,
CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(o_orderdate AS DATE) AS day_, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_, last_day(o_orderdate) AS month_end,
CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS since, strftime(o_orderdate, '%Y/%m/%d') AS text_ FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    day = at.cast("date")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(at).alias("y"), F.month(at).alias("m"), F.dayofmonth(at).alias("d"), F.quarter(at).alias("q"), F.dayofyear(at).alias("doy"), day.alias("day_"),
        F.trunc(day, "month").alias("month_"), F.last_day(day).alias("month_end"), F.date_diff(day, F.lit("1995-01-01").cast("date")).alias("since"), F.date_format(at, "yyyy/MM/dd").alias("text_"),
    )


@query("""SELECT p_partkey, round(sqrt(p_retailprice), 9) AS root, round(ln(p_retailprice), 9) AS log_, round(exp(p_size / 50.0), 9) AS e, CAST(floor(p_retailprice) AS BIGINT) AS low,
CAST(ceil(p_retailprice) AS BIGINT) AS high, abs(p_size - 25) AS dist, CAST(p_partkey % 7 AS BIGINT) AS rest, greatest(p_size, 10) AS g, least(p_size, 10) AS l,
CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class_, coalesce(nullif(p_size, 7), -1) AS no_seven FROM part""")
def maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.sqrt(price), 9).alias("root"), F.round(F.ln(price), 9).alias("log_"), F.round(F.exp(size / 50.0), 9).alias("e"), F.floor(price).alias("low"), F.ceil(price).alias("high"),
        F.abs(size - 25).alias("dist"), (F.col("p_partkey") % 7).alias("rest"), F.greatest(size, F.lit(10)).alias("g"), F.least(size, F.lit(10)).alias("l"),
        F.when(size < 10, "small").when(size < 30, "medium").otherwise("large").alias("class_"), F.coalesce(F.nullif(size, F.lit(7)), F.lit(-1)).alias("no_seven"),
    )


@query("""SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS top, CAST(len([x for x in embedding if x > 0]) AS INT) AS positive,
round(CAST(embedding[1] AS DOUBLE), 6) AS first_, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]), 6) AS norm2 FROM embeddings""")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).alias("n"), F.round(F.array_max(v).cast("double"), 6).alias("top"), F.size(F.filter(v, lambda x: x > 0)).alias("positive"),
        F.round(F.try_element_at(v, F.lit(1)).cast("double"), 6).alias("first_"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 6).alias("norm2"),
    )


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none_, event_type || '=' || CAST(user_id AS VARCHAR) AS tag FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.col("event_type"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.get_json_object("props", "$.none").alias("none_"), F.concat_ws("=", F.map_keys(tags)[0], F.map_values(tags)[0]).alias("tag"))


@query("""SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) > 12 GROUP BY 1, 2""")
def exploded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.filter(F.length("word") > 12).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS turned FROM part")
def python_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", python.words_reversed("p_name").alias("turned"))


@query("SELECT l_orderkey, round(exp(avg(ln(l_extendedprice))), 4) AS middle FROM lineitem GROUP BY 1")
def python_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python.geometric_means(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "middle").withColumn("middle", F.round("middle", 4))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def python_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("json_pairs", python.JsonPairs)
    return spark.sql("SELECT event_id, p.key, p.value FROM {events} AS e, LATERAL json_pairs(e.props) AS p", events=table(spark, sf_dir, "events"))

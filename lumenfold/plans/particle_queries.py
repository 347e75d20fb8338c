"""Queries on the particle table and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import strings
from lumenfold.operators import particles as ops
from lumenfold.plans.registry import register
from lumenfold.sources.tables import ORDER, particles, table

PARTICLES = """particles AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_suppkey AS micrograph,
  l_returnflag || l_linestatus AS group_name, l_linenumber AS class_no, 1 - l_discount AS pmax, l_tax FROM lineitem)"""
KEYS = ", ".join(ORDER)


@register("class_stats", f"""WITH {PARTICLES}, k AS (SELECT max(class_no) AS k FROM particles)
SELECT s.class_no, count(p.class_no) AS n FROM (SELECT unnest(generate_series(1, (SELECT CAST(k AS BIGINT) FROM k))) AS class_no) s
LEFT JOIN particles p ON p.class_no = s.class_no GROUP BY s.class_no""")
def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_counts(particles(spark, sf_dir))


@register("class_size_histogram", """WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT s.k, coalesce(c.n, 0) AS n FROM (SELECT unnest(generate_series(1, (SELECT max(l_partkey) FROM lineitem))) AS k) s LEFT JOIN c ON c.l_partkey = s.k)
SELECT least(n // 10, 10) AS size_bin, count(*) AS classes FROM k GROUP BY 1""")
def class_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.size_histogram(ops.class_counts(table(spark, sf_dir, "lineitem"), "l_partkey"))


@register("filter_by_class", f"""WITH {PARTICLES} SELECT {KEYS}, round(pmax, 6) AS pmax FROM particles WHERE class_no = 3""")
def filter_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(spark, sf_dir).where("class_no = 3").select(*ORDER, F.round("pmax", 6).alias("pmax"))


@register("clean_empty_classes", """SELECT l_suppkey * 3 AS class_no, dense_rank() OVER (ORDER BY l_suppkey * 3) AS new_class, count(*) AS n FROM lineitem GROUP BY l_suppkey * 3""")
def clean_empty_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.relabel_classes(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("class_no")))


@register("group_numbering", f"""WITH {PARTICLES}, r AS (SELECT group_name, row_number() OVER (ORDER BY micrograph, {KEYS}) AS o FROM particles),
f AS (SELECT group_name, min(o) AS o FROM r GROUP BY 1) SELECT group_name, row_number() OVER (ORDER BY o) AS group_no FROM f""")
def group_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.number_by_first(particles(spark, sf_dir), "group_name", ["micrograph", *ORDER], "group_no")


@register("group_fallback_to_micrograph", f"""WITH {PARTICLES}, one AS (SELECT 'all' AS group_name, micrograph FROM particles),
f AS (SELECT count(DISTINCT group_name) = 1 AND count(DISTINCT micrograph) > 1 AS fall FROM one)
SELECT CASE WHEN (SELECT fall FROM f) THEN CAST(micrograph AS VARCHAR) ELSE group_name END AS group_name, count(*) AS n FROM one GROUP BY 1""")
def group_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = particles(spark, sf_dir).withColumn("group_name", F.lit("all"))
    return ops.group_or_micrograph(one).groupBy("group_name").agg(F.count("*").alias("n"))


@register("group_particle_counts", f"""WITH {PARTICLES} SELECT group_name, count(*) AS n, count(DISTINCT micrograph) AS micrographs FROM particles GROUP BY 1""")
def group_particle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(spark, sf_dir).groupBy("group_name").agg(F.count("*").alias("n"), F.countDistinct("micrograph").alias("micrographs"))


@register("equal_partition", """SELECT block, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
FROM (SELECT event_id, ntile(7) OVER (ORDER BY event_id) AS block FROM events) GROUP BY block""")
def equal_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ops.split_equally(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 7)
    return dealt.groupBy("block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@register("pool_partition", """WITH o AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 50 AS pool FROM events),
b AS (SELECT pool, ntile(6) OVER (ORDER BY pool) AS block FROM (SELECT DISTINCT pool FROM o))
SELECT block, count(*) AS n, min(event_id) AS first_event FROM o JOIN b USING (pool) GROUP BY block""")
def pool_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ops.split_equally(table(spark, sf_dir, "events").select("event_id"), ["event_id"], 6, pool=50)
    return dealt.groupBy("block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@register("seed_classes", """SELECT block AS class_no, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM (SELECT vec_id, ntile(10) OVER (ORDER BY vec_id) AS block FROM embeddings) GROUP BY 1""")
def seed_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ops.split_equally(table(spark, sf_dir, "embeddings").select("vec_id"), ["vec_id"], 10)
    return dealt.groupBy(F.col("block").alias("class_no")).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


DRAW = "(l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7)"


@register("random_halves_hash", f"""SELECT {KEYS}, {DRAW} % 2 + 1 AS random_subset FROM lineitem""")
def random_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.halves(table(spark, sf_dir, "lineitem").select(*ORDER), F.expr(DRAW)).select(*ORDER, "random_subset")


@register("half_counts", f"""SELECT CASE WHEN l_linenumber IN (1, 2) THEN l_linenumber ELSE {DRAW} % 2 + 1 END::BIGINT AS random_subset, count(*) AS n FROM lineitem GROUP BY 1""")
def half_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.halves(table(spark, sf_dir, "lineitem"), F.expr(DRAW), kept="l_linenumber")
    return kept.groupBy("random_subset").agg(F.count("*").alias("n"))


@register("present_columns", """SELECT name, present FROM (
  SELECT min(class_no) <> max(class_no) OR min(class_no) <> 0 AS class_no, min(pmax) <> max(pmax) OR min(pmax) <> 0 AS pmax,
    min(z) <> max(z) OR min(z) <> 0 AS z, min(one) <> max(one) OR min(one) <> 1 AS one
  FROM (SELECT l_linenumber AS class_no, 1 - l_discount AS pmax, 0.0 AS z, 1.0 AS one FROM lineitem))
UNPIVOT (present FOR name IN (class_no, pmax, z, one))""")
def present_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = particles(spark, sf_dir).select("class_no", "pmax", F.lit(0.0).alias("z"), F.lit(1.0).alias("one"))
    return ops.present_columns(rows, {"class_no": 0, "pmax": 0.0, "z": 0.0, "one": 1.0})


@register("select_restack", f"""WITH {PARTICLES} SELECT {KEYS}, row_number() OVER (PARTITION BY class_no ORDER BY {KEYS}) AS new_index,
  lpad(CAST(row_number() OVER (PARTITION BY class_no ORDER BY {KEYS}) AS VARCHAR), 7, '0') || '@class' || class_no || '.mrcs' AS new_name FROM particles""")
def select_restack(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = particles(spark, sf_dir)
    return ops.restack(chosen, "class_no", ORDER).select(*ORDER, "new_index", "new_name")


@register("metaname_parse", """SELECT p_partkey, CAST(p_partkey % 1000 AS BIGINT) AS idx, p_brand || '.mrcs' AS stack FROM part""")
def metaname_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat(lpad(cast(p_partkey % 1000 as string), 7, '0'), '@', p_brand, '.mrcs')").alias("name"))
    return named.select("p_partkey", strings.name_index(F.col("name")).alias("idx"), strings.name_stack(F.col("name")).alias("stack"))


@register("numpad", """SELECT l_partkey, lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') AS short, lpad(CAST(l_partkey % 10000000 AS VARCHAR), 7, '0') AS long FROM (SELECT DISTINCT l_partkey FROM lineitem)""")
def numpad(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "lineitem").select("l_partkey").distinct()
    return keys.select("l_partkey", strings.padded(F.col("l_partkey"), 3).alias("short"), strings.padded(F.col("l_partkey"), 7).alias("long"))


@register("path_suffix", """WITH p AS (SELECT p_partkey, 'run/' || p_brand || '/it' || p_size || CASE p_partkey % 4 WHEN 0 THEN '.star' WHEN 1 THEN '.mrcs' WHEN 2 THEN '.dat' ELSE '.mrc' END AS path FROM part)
SELECT p_partkey, regexp_replace(path, '\\.(star|mrcs|dat|mrc)$', '') AS base, regexp_extract(path, '[^/]*$') AS file, regexp_replace(path, '[^/]*$', '') AS dir, regexp_extract(path, '[^.]*$') AS suffix FROM p""")
def path_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('run/', p_brand, '/it', p_size, case p_partkey % 4 when 0 then '.star' when 1 then '.mrcs' when 2 then '.dat' else '.mrc' end)")
    named = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    p = F.col("path")
    return named.select("p_partkey", strings.without_suffix(p).alias("base"), strings.file_name(p).alias("file"), strings.directory(p).alias("dir"), strings.suffix(p).alias("suffix"))


@register("iteration_of_name", """SELECT DISTINCT p_size, CAST(p_size AS INTEGER) AS iteration FROM part""")
def iteration_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "part").select("p_size", F.expr("concat('out_it', lpad(cast(p_size as string), 3, '0'), '_data.star')").alias("name"))
    return named.select("p_size", strings.iteration_of(F.col("name")).alias("iteration")).distinct()


@register("number_format_class", """SELECT p_partkey, CASE WHEN v <> 0 AND abs(v) < 1e-3 OR abs(v) > 1e5 THEN 'scientific' ELSE 'fixed' END AS kind, 12 AS width
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_retailprice * 1e3 WHEN 1 THEN p_retailprice / 1e7 WHEN 2 THEN 0.0 ELSE p_retailprice END AS v FROM part)""")
def number_format_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.expr("case p_partkey % 4 when 0 then p_retailprice * 1e3 when 1 then p_retailprice / 1e7 when 2 then 0d else p_retailprice end")
    text = strings.number_text(v)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(text.contains("e"), "scientific").otherwise("fixed").alias("kind"), F.char_length(text).alias("width"))


@register("fine_class_plan", """WITH c AS (SELECT l_suppkey AS class_no, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT class_no, n, CASE WHEN n < 20 THEN 1 ELSE n // 10 + 2 END AS fine FROM c)
SELECT class_no, n, fine::BIGINT AS fine, coalesce(sum(fine) OVER (ORDER BY class_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM f""")
def fine_class_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("class_no")).agg(F.count("*").alias("n"))
    return ops.fine_class_plan(counts)


MASS = """m AS (SELECT user_id, event_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) AS running,
  sum(value) OVER (PARTITION BY user_id) AS total FROM events),
t AS (SELECT user_id, coalesce(max(value) FILTER (WHERE running > 0.9 * total), min(value)) AS threshold FROM m GROUP BY 1)"""


@register("top_mass_threshold", f"WITH {MASS} SELECT user_id, round(threshold, 6) AS threshold FROM t")
def top_mass_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.significant_counts(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 0.9)
    return found.select("user_id", F.round("threshold", 6).alias("threshold"))


@register("nr_significant", f"WITH {MASS} SELECT user_id, count(*) FILTER (WHERE value >= threshold) AS nr_significant FROM m JOIN t USING (user_id) GROUP BY 1")
def nr_significant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.significant_counts(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 0.9).select("user_id", "nr_significant")


@register("significant_rows", f"WITH {MASS} SELECT user_id, event_id FROM m JOIN t USING (user_id) WHERE value >= threshold")
def significant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.mass_threshold(table(spark, sf_dir, "events"), "user_id", "value", "event_id", 0.9).where("value >= threshold").select("user_id", "event_id")


@register("significance_semijoin", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_size <= 10)""")
def significance_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf_dir, "lineitem").join(coarse, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("orientation_significance", """SELECT l_suppkey AS direction, bool_or(l_discount > 0.09 AND l_quantity > 45) AS significant FROM lineitem GROUP BY 1""")
def orientation_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("direction")).agg(F.bool_or(F.expr("l_discount > 0.09 and l_quantity > 45")).alias("significant"))


@register("hidden_variable_change", f"""WITH a AS (SELECT {KEYS}, l_tax, l_discount, l_linenumber AS c FROM lineitem)
SELECT round(sum(d) / count(*), 6) AS mean_offset_change, round(sum(r) / count(*), 6) AS mean_angle_change, count(*) FILTER (WHERE changed) AS classes_changed FROM (
  SELECT sqrt(power(l_tax - l_discount, 2)) AS d, abs(l_quantity - l_linenumber) AS r, l_linenumber <> l_linenumber % 5 AS changed FROM a)""")
def hidden_variable_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "lineitem").withColumn("inner_id", F.struct(*ORDER))
    both = old.select("inner_id", F.col("l_tax").alias("x_old"), F.col("l_quantity").alias("psi_old"), F.col("l_linenumber").alias("c_old"))
    # keys may repeat: rows of one key are paired by their place
    new = old.select("inner_id", F.col("l_discount").alias("x_new"), F.col("l_linenumber").alias("psi_new"), F.expr("l_linenumber % 5").alias("c_new"))
    left = both.withColumn("k", F.row_number().over(Window.partitionBy("inner_id").orderBy("x_old")))
    right = new.withColumn("k", F.row_number().over(Window.partitionBy("inner_id").orderBy("x_new")))
    met = left.join(right, ["inner_id", "k"])
    return met.agg(
        F.round(F.sum(F.abs(F.col("x_old") - F.col("x_new"))) / F.count("*"), 6).alias("mean_offset_change"),
        F.round(F.sum(F.abs(F.col("psi_old") - F.col("psi_new"))) / F.count("*"), 6).alias("mean_angle_change"),
        F.count(F.when(F.col("c_old") != F.col("c_new"), 1)).alias("classes_changed"),
    )


@register("viewer_sort_by_count", """SELECT class_no, n, row_number() OVER (ORDER BY n DESC, class_no) AS place FROM (SELECT l_suppkey AS class_no, count(*) AS n FROM lineitem GROUP BY 1)""")
def viewer_sort_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("class_no")).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "class_no")).cast("long"))


@register("viewer_page", """SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events) WHERE place > 60 AND place <= 80""")
def viewer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_pages(table(spark, sf_dir, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")], 3, 20).select("event_id", "place")


@register("images_by_prob", f"""WITH {PARTICLES} SELECT class_no, {KEYS}, place FROM (SELECT *, row_number() OVER (PARTITION BY class_no ORDER BY pmax DESC, {KEYS}) AS place FROM particles) WHERE place <= 25""")
def images_by_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = Window.partitionBy("class_no").orderBy(F.desc("pmax"), *ORDER)
    return particles(spark, sf_dir).withColumn("place", F.row_number().over(best).cast("long")).where("place <= 25").select("class_no", *ORDER, "place")


@register("viewer_class_images", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 8000)""")
def viewer_class_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").join(chosen, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("append_tables", """SELECT source, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT 'c' AS source, c_custkey AS id FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier) GROUP BY 1""")
def append_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lit("c").alias("source"), F.col("c_custkey").alias("id"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("source"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s).groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@register("fine_search_concat", """WITH c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT k, CASE WHEN n < 20 THEN 1 ELSE n // 10 + 2 END AS fine FROM c),
o AS (SELECT k, fine, coalesce(sum(fine) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM f)
SELECT (off + l_orderkey % fine + 1)::BIGINT AS class_no, count(*) AS n FROM lineitem JOIN o ON l_suppkey = k GROUP BY 1""")
def fine_search_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("class_no"))
    plan = ops.fine_class_plan(rows.groupBy("class_no").agg(F.count("*").alias("n"))).select("class_no", "fine", "offset")
    found = rows.join(plan, "class_no").select(F.expr("offset + l_orderkey % fine + 1").alias("class_no"))
    return found.groupBy("class_no").agg(F.count("*").alias("n"))


@register("consistency_check", """SELECT count(DISTINCT n_chars > 0) = 1 AS consistent, min(n_chars) > 0 AS positive FROM documents""")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "documents").agg(F.countDistinct(F.col("n_chars") > 0).alias("k"), F.min("n_chars").alias("least"))
    return kinds.select((F.col("k") == 1).alias("consistent"), (F.col("least") > 0).alias("positive"))


@register("prune_dead_classes", """WITH c AS (SELECT l_suppkey AS k, sum(CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END) AS w FROM lineitem GROUP BY 1) SELECT k, w::BIGINT AS w FROM c WHERE w > 0""")
def prune_dead_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum((F.col("l_discount") > 0.095).cast("long")).alias("w"))
    return weights.where("w > 0")


@register("scale_sanity", """SELECT s_suppkey, CASE WHEN s < 0.001 THEN 0.001 ELSE round(s, 6) END AS scale FROM (SELECT s_suppkey, s_acctbal / 5000 AS s FROM supplier)""")
def scale_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.col("s_acctbal") / 5000
    checked = F.when(scale > 10000, F.raise_error(F.lit("scale correction out of range")).cast("double")).when(scale < 0.001, F.lit(0.001)).otherwise(F.round(scale, 6))
    return table(spark, sf_dir, "supplier").select("s_suppkey", checked.alias("scale"))


@register("group_noise_join", f"""WITH {PARTICLES}, s AS (SELECT group_name, avg(l_tax) AS sigma2 FROM particles GROUP BY 1)
SELECT p.group_name, class_no, round(sum(pmax / sigma2), 4) AS weight FROM particles p JOIN s ON p.group_name = s.group_name GROUP BY ALL""")
def group_noise_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = particles(spark, sf_dir)
    noise = rows.groupBy("group_name").agg(F.avg("l_tax").alias("sigma2"))
    # one row a group: small beside the particles, and left to the optimiser to broadcast
    return rows.join(noise, "group_name").groupBy("group_name", "class_no").agg(F.round(F.sum(F.col("pmax") / F.col("sigma2")), 4).alias("weight"))


@register("coarse_children", """SELECT l_suppkey * 4 + c AS fine, count(*) AS n FROM lineitem, (SELECT unnest(range(4)) AS c) WHERE l_discount > 0.08 GROUP BY 1""")
def coarse_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    # counts are made before points are expanded into their children
    return kept.select(F.explode(F.expr("transform(sequence(0, 3), c -> l_suppkey * 4 + c)")).alias("fine"), "n")


@register("mask_difference", """SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS first_only FROM (SELECT value > 100 AS a, event_type = 'click' AS b FROM events)""")
def mask_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("value") > 100, F.col("event_type") == "click"
    return table(spark, sf_dir, "events").agg(F.count(F.when(a & b, 1)).alias("both"), F.count(F.when(a & ~b, 1)).alias("first_only"))


@register("star_row_count", """SELECT count(*) AS n FROM part WHERE contains(p_brand || '.mrcs', '.mrcs')""")
def star_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.concat("p_brand", F.lit(".mrcs")).contains(".mrcs")).agg(F.count("*").alias("n"))

"""Registered queries over the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canon
from .operators.neighbors import neighbors as neighbors_of
from .operators.project import Project
from .operators.schema import ProjectSchema
from .operators.stores import array_stats
from .operators.sync import job_plan
from .plans.fields import TypedFields
from .plans.filters import compile_filter
from .sources.paths import duplicate_paths, parse_columns, template_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return add


def orders(spark, d) -> Project:
    """Orders as jobs: attributes are the state point."""
    return Project.of_table(spark.read.parquet(f"{d}/orders.parquet"), {"cust": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice", "priority": "o_orderpriority"}, job_id="o_orderkey")


def parts(spark, d) -> Project:
    return Project.of_table(spark.read.parquet(f"{d}/part.parquet"), {"name": "p_name", "brand": "p_brand", "type": "p_type", "size": "p_size", "price": "p_retailprice"}, job_id="p_partkey")


def texts(spark, d) -> Project:
    """Documents with their labels as job documents, which most lack."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    return Project.of_table(docs.join(labels, "doc_id", "left"), {"lang": "lang", "source": "source", "n_chars": "n_chars"}, {"quality": "quality", "toxic": "toxic"}, job_id="doc_id")


def events(spark, d) -> Project:
    e = spark.read.parquet(f"{d}/events.parquet")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return Project.of_table(e, {"user": "user_id", "event_type": "event_type", "value": "value"}, {"k": "k"}, job_id="event_id")


def points(spark, d) -> DataFrame:
    """The different state points (brand, size, type) of parts, with canonical JSON and id."""
    ps = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_size", "p_type").distinct()
    return ps.withColumn("sp_json", canon.typed_json(p_brand=F.col("p_brand"), p_size=F.col("p_size"), p_type=F.col("p_type"))).withColumn("job_id", F.md5("sp_json"))


PS = """ps AS (SELECT *, md5(sp_json) AS job_id FROM (SELECT DISTINCT p_brand, p_size, p_type,
 '{"p_brand": "' || p_brand || '", "p_size": ' || p_size || ', "p_type": "' || p_type || '"}' AS sp_json FROM part))"""
TEXTS = "texts AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
EVENTS = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def ids(project: Project, filter, name: str = "job_id") -> DataFrame:
    return project.find_jobs(filter).df.select(F.col("job_id").alias(name))


@registered("SELECT count(*) AS n_jobs FROM orders")
def scan_count(spark, d):
    return orders(spark, d).jobs.agg(F.count("*").alias("n_jobs"))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderpriority = '1-URGENT'")
def find_eq(spark, d):
    return ids(orders(spark, d), {"priority": "1-URGENT"})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
def find_eq_multi(spark, d):
    return ids(orders(spark, d), {"priority": "1-URGENT", "status": "F"})


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE p_size = 10")
def find_intfloat_eq(spark, d):
    return ids(parts(spark, d), {"size": 10.0})


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id FROM texts WHERE quality <> 1")
def find_ne_missing(spark, d):
    return ids(texts(spark, d), {"doc.quality.$ne": 1})


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id FROM texts WHERE NOT coalesce(quality = 1, false)")
def find_not_missing(spark, d):
    return ids(texts(spark, d), {"$not": {"doc.quality": 1}})


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id FROM texts WHERE quality IS NOT NULL")
def find_exists(spark, d):
    return ids(texts(spark, d), {"doc.quality.$exists": True})


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id FROM texts WHERE quality IS NULL")
def find_not_exists(spark, d):
    return ids(texts(spark, d), {"doc.quality.$exists": False})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_totalprice > 1000 AND o_totalprice <= 150000 AND o_custkey >= 10 AND o_custkey < 700")
def find_range(spark, d):
    return ids(orders(spark, d), {"price": {"$gt": 1000, "$lte": 150000}, "cust": {"$gte": 10, "$lt": 700}})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def find_in(spark, d):
    return ids(orders(spark, d), {"priority": {"$in": ["1-URGENT", "2-HIGH"]}})


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id FROM texts WHERE quality NOT IN (1)")
def find_nin(spark, d):
    return ids(texts(spark, d), {"doc.quality.$nin": [1, "x"]})


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE regexp_matches(p_name, '[aeiou]{2}')")
def find_regex(spark, d):
    return ids(parts(spark, d), {"name.$regex": "[aeiou]{2}"})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE abs(o_totalprice - 100000) <= greatest(0.01 * greatest(abs(o_totalprice), 100000), 0)")
def find_near(spark, d):
    return ids(orders(spark, d), {"price.$near": [100000, 0.01]})


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE (p_size < 5 OR p_brand = 'Brand#12') AND NOT (p_retailprice >= 1500)")
def find_and_or_not(spark, d):
    return ids(parts(spark, d), {"$and": [{"$or": [{"size.$lt": 5}, {"brand": "Brand#12"}]}, {"$not": {"price.$gte": 1500}}]})


@registered(f"WITH {EVENTS} SELECT CAST(event_id AS VARCHAR) AS job_id FROM ev WHERE event_type = 'click' AND k < 5")
def find_doc_json(spark, d):
    return ids(events(spark, d), {"event_type": "click", "doc.k.$lt": 5})


#: Values of several types by event number, as JSON text; some events have no such key.
MIXED = "CASE event_id % 7 WHEN 0 THEN '{\"v\": 1}' WHEN 1 THEN '{\"v\": 1.0}' WHEN 2 THEN '{\"v\": \"1\"}' WHEN 3 THEN '{\"v\": true}' WHEN 4 THEN '{\"v\": null}' WHEN 5 THEN '{\"v\": [1, 2]}' ELSE '{}' END"


def mixed(spark, d) -> Project:
    e = spark.read.parquet(f"{d}/events.parquet")
    return Project.of_canonical(e.select(F.col("event_id").cast("string").alias("job_id"), F.expr(MIXED).alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 IN (0, 3)")
def find_type(spark, d):
    return ids(mixed(spark, d), {"v.$type": "int"})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 IN (0, 1, 3)")
def find_variant_eq(spark, d):
    return ids(mixed(spark, d), {"v": 1})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 IN (2, 4, 5)")
def find_variant_ne(spark, d):
    return ids(mixed(spark, d), {"v.$ne": 1})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 = 5")
def find_variant_list(spark, d):
    return ids(mixed(spark, d), {"v": [1.0, 2]})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 = 4")
def find_variant_null(spark, d):
    return ids(mixed(spark, d), {"v": None})


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE p_size % 7 = 3")
def find_where(spark, d):
    return ids(parts(spark, d), {"size.$where": lambda v: v % 7 == 3})


@registered(f"WITH {PS} SELECT p_brand, p_size, p_type, job_id FROM ps")
def job_id(spark, d):
    return points(spark, d).select("p_brand", "p_size", "p_type", "job_id")


@registered(f"WITH {PS} SELECT CAST(coalesce(max(k), -1) + 1 AS INTEGER) AS n FROM (SELECT k, left(job_id, k) AS head FROM ps, (SELECT unnest(range(0, 31))::INTEGER AS k) GROUP BY ALL HAVING count(*) > 1)")
def min_len_unique_id(spark, d):
    return Project.of_table(points(spark, d), ["p_brand"]).id_lengths()


@registered("SELECT o_orderpriority AS priority, count(*) AS n_jobs, CAST(min(o_orderkey) AS VARCHAR) AS first_job FROM orders GROUP BY 1")
def groupby_one(spark, d):
    g = orders(spark, d).groupby("priority")
    return g.agg(F.count("*").alias("n_jobs"), F.min("o_orderkey").cast("string").alias("first_job")).withColumnRenamed("sp.priority", "priority")


@registered(f"WITH {TEXTS} SELECT lang, quality, count(*) AS n_jobs FROM texts WHERE quality IS NOT NULL GROUP BY 1, 2")
def groupby_multi(spark, d):
    return texts(spark, d).groupby(["doc.quality", "lang"]).counts().withColumnsRenamed({"sp.lang": "lang", "doc.quality": "quality"})


@registered(f"WITH {TEXTS} SELECT coalesce(quality, -1) AS quality, count(*) AS n_jobs FROM texts GROUP BY 1")
def groupby_default(spark, d):
    return texts(spark, d).groupby("doc.quality", default=-1).counts().withColumnRenamed("doc.quality", "quality")


@registered("SELECT CASE event_id % 7 WHEN 2 THEN 'str' WHEN 4 THEN 'NoneType' WHEN 5 THEN 'tuple' ELSE 'number' END AS kind, count(*) AS n_jobs FROM events WHERE event_id % 7 <> 6 GROUP BY 1")
def groupby_variant(spark, d):
    return mixed(spark, d).groupby("v").counts().select(F.col("`sp.v`.kind").alias("kind"), "n_jobs")


@registered(f"WITH {TEXTS} SELECT CAST(doc_id AS VARCHAR) AS job_id, lang AS \"sp.lang\", quality AS \"doc.quality\" FROM texts WHERE n_chars > 1000 AND (lang IS NOT NULL OR quality IS NOT NULL)")
def to_dataframe_flat(spark, d):
    return texts(spark, d).find_jobs({"n_chars.$gt": 1000}).to_dataframe(usecols=["sp.lang", "doc.quality"], flatten=True)


def pointed(spark, d, filter=None) -> Project:
    """The different state points of parts, with a key that is the same in all, as a project."""
    p = points(spark, d)
    sp = canon.typed_json(const=F.lit(1), p_brand=F.col("p_brand"), p_size=F.col("p_size"), p_type=F.col("p_type"))
    p = p.where(filter) if filter else p
    return Project.of_canonical(p.select("job_id", sp.alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))


def per_key(schema: ProjectSchema) -> DataFrame:
    return schema.values.groupBy("path").agg(F.count_distinct("same").alias("n_values"), F.sum("n_jobs").alias("n_jobs"))


SCHEMA_SQL = " UNION ALL ".join(f"SELECT '{c}' AS path, count(DISTINCT {c}) AS n_values, CAST(count({c}) AS BIGINT) AS n_jobs FROM c" for c in ("p_brand", "p_size", "p_type", "const"))


@registered(f"WITH {PS}, c AS (SELECT *, 1 AS const FROM ps) {SCHEMA_SQL}")
def schema_detect(spark, d):
    return per_key(ProjectSchema.detect(pointed(spark, d).leaves()))


@registered(f"WITH {PS}, c AS (SELECT *, 1 AS const FROM ps) SELECT * FROM ({SCHEMA_SQL}) WHERE path <> 'const'")
def schema_exclude_const(spark, d):
    return per_key(ProjectSchema.detect(pointed(spark, d).leaves(), exclude_const=True))


@registered(f"""WITH {PS}, v AS (SELECT DISTINCT path, value, low FROM (SELECT 'p_brand' AS path, p_brand AS value, p_brand < 'Brand#13' AS low FROM ps UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), p_brand < 'Brand#13' FROM ps UNION ALL SELECT 'p_type', p_type, p_brand < 'Brand#13' FROM ps))
SELECT DISTINCT path FROM (SELECT path, value FROM v EXCEPT SELECT path, value FROM v WHERE low)""")
def schema_difference(spark, d):
    every, some = (ProjectSchema.detect(pointed(spark, d, f).leaves()) for f in (None, "p_brand < 'Brand#13'"))
    return every.difference(some)


STACKED = """st AS (SELECT job_id, 'p_brand' AS path, p_brand AS value, md5(p_size || '|' || p_type) AS rest FROM ps
 UNION ALL SELECT job_id, 'p_size', lpad(CAST(p_size AS VARCHAR), 4, '0'), md5(p_brand || '|' || p_type) FROM ps UNION ALL SELECT job_id, 'p_type', p_type, md5(p_brand || '|' || p_size) FROM ps)"""


@registered(f"""WITH {PS}, t AS (SELECT job_id, 'p_brand' AS path, '"' || p_brand || '"' AS value FROM ps UNION ALL SELECT job_id, 'p_size', CAST(p_size AS VARCHAR) FROM ps UNION ALL SELECT job_id, 'p_type', '"' || p_type || '"' FROM ps UNION ALL SELECT job_id, 'const', '1' FROM ps)
SELECT job_id, path, value FROM t WHERE (path, value) NOT IN (SELECT path, value FROM t GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM ps))""")
def diff_jobs(spark, d):
    from .operators.diff import diff_leaves

    return diff_leaves(pointed(spark, d).leaves()).withColumnRenamed("json", "value")


@registered(f"WITH {PS}, {STACKED} SELECT job_id, path, lag(job_id) OVER w AS prev_job_id, lead(job_id) OVER w AS next_job_id FROM st WINDOW w AS (PARTITION BY path, rest ORDER BY value)")
def neighbors(spark, d):
    return neighbors_of(pointed(spark, d).leaves()).select("job_id", "path", "prev_job_id", "next_job_id")


@registered(f"WITH {PS}, {STACKED} SELECT path, count(lag_id) AS n_prev, count(lead_id) AS n_next FROM (SELECT path, lag(job_id) OVER w AS lag_id, lead(job_id) OVER w AS lead_id FROM st WINDOW w AS (PARTITION BY path, rest ORDER BY value)) GROUP BY 1")
def neighbors_multi_key(spark, d):
    n = neighbors_of(pointed(spark, d).leaves())
    return n.groupBy("path").agg(F.count("prev_job_id").alias("n_prev"), F.count("next_job_id").alias("n_next"))


@registered("""WITH p AS (SELECT *, md5('{"brand": "' || p_brand || '", "both": "' || p_brand || p_type || '", "type": "' || p_type || '"}') AS job_id FROM (SELECT DISTINCT p_brand, p_type FROM part))
SELECT job_id, 'brand' AS path, lag(job_id) OVER w AS prev_job_id, lead(job_id) OVER w AS next_job_id FROM p WINDOW w AS (PARTITION BY p_type ORDER BY p_brand)
UNION ALL SELECT job_id, 'type', lag(job_id) OVER w, lead(job_id) OVER w FROM p WINDOW w AS (PARTITION BY p_brand ORDER BY p_type)""")
def neighbors_ignore(spark, d):
    """One key depends on the two others; without it they have neighbours."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_brand", "p_type").distinct()
    # the id is taken of the keys in this order in the SQL too
    sp = canon.typed_json(brand=F.col("p_brand"), both=F.concat("p_brand", "p_type"), type=F.col("p_type"))
    jobs = Project.of_canonical(p.select(F.md5(F.concat(F.lit('{"brand": "'), "p_brand", F.lit('", "both": "'), "p_brand", "p_type", F.lit('", "type": "'), "p_type", F.lit('"}'))).alias("job_id"), sp.alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))
    return neighbors_of(jobs.leaves(), ignore=["both"]).select("job_id", "path", "prev_job_id", "next_job_id")


def sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two overlapping projects of orders, the price in the document; finished orders cost more in the second."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    changed = F.when(F.col("o_orderstatus") == "F", F.col("cents") + 1).otherwise(F.col("cents"))
    jobs = lambda x: x.select(F.col("o_orderkey").cast("string").alias("job_id"), canon.typed_json(key=F.col("o_orderkey")).alias("sp_json"), canon.typed_json(price=F.col("cents")).alias("doc_json"))
    return jobs(o.where("o_orderstatus <> 'P'")), jobs(o.where("o_orderpriority <> '1-URGENT'").withColumn("cents", changed))


SIDES = """o AS (SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
a AS (SELECT job_id, cents FROM o WHERE o_orderstatus <> 'P'),
b AS (SELECT job_id, CASE WHEN o_orderstatus = 'F' THEN cents + 1 ELSE cents END AS cents FROM o WHERE o_orderpriority <> '1-URGENT')"""


@registered(f"WITH {SIDES} SELECT coalesce(a.job_id, b.job_id) AS job_id, CASE WHEN b.job_id IS NULL THEN 'clone' WHEN a.job_id IS NULL THEN 'keep' ELSE 'merge' END AS action FROM a FULL JOIN b ON a.job_id = b.job_id")
def sync_plan(spark, d):
    return job_plan(*sides(spark, d)).select("job_id", "action")


@registered(f"WITH {SIDES} SELECT coalesce(a.job_id, b.job_id) AS job_id, '{{\"price\": ' || coalesce(a.cents, b.cents) || '}}' AS doc_json FROM a FULL JOIN b ON a.job_id = b.job_id")
def sync_merge_update(spark, d):
    from .operators.sync import DocSync, sync_projects

    a, b = (Project.of_canonical(x) for x in sides(spark, d))
    return sync_projects(a, b, DocSync.UPDATE, check_schema=False).jobs.select("job_id", "doc_json")


@registered(f"WITH {SIDES} SELECT a.job_id FROM a JOIN b ON a.job_id = b.job_id WHERE a.cents <> b.cents")
def sync_conflicts(spark, d):
    from .operators.sync import DocSync, document_plan

    return document_plan(*sides(spark, d), DocSync.ByKey()).where("conflict").select("job_id")


PATH = "brand/{brand}/size/{size}"


def part_paths(spark, d) -> DataFrame:
    p = parts(spark, d)
    return p.jobs.select("job_id", template_path(PATH, {k.removeprefix("sp."): c for k, c in p.fields.columns.items()}).alias("path"))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id, 'brand/' || p_brand || '/size/' || p_size AS path FROM part")
def path_template(spark, d):
    return part_paths(spark, d)


@registered("SELECT 'brand/' || p_brand || '/size/' || p_size AS path, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def path_duplicates(spark, d):
    return duplicate_paths(part_paths(spark, d))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_custkey AS cust, o_orderstatus AS status FROM orders")
def schema_path_parse(spark, d):
    o = orders(spark, d).jobs.select("job_id", template_path("c/{cust}/s/{status}", {"cust": "o_custkey", "status": "o_orderstatus"}).alias("path"))
    return o.select("job_id", *(c.alias(k) for k, c in parse_columns("c/{cust:int}/s/{status}", F.col("path")).items()))


@registered(f"WITH {PS}, n AS (SELECT *, row_number() OVER (ORDER BY job_id) AS r FROM ps), x AS (SELECT sp_json, CASE WHEN left(job_id, 1) = 'a' THEN 'b' || substr(job_id, 2) ELSE job_id END AS job_id FROM n) SELECT job_id FROM x WHERE md5(sp_json) <> job_id")
def integrity_check(spark, d):
    ps = points(spark, d).select(F.when(F.left("job_id", F.lit(1)) == "a", F.concat(F.lit("b"), F.substring("job_id", 2, 31))).otherwise(F.col("job_id")).alias("job_id"), "sp_json", F.lit(None).cast("string").alias("doc_json"))
    return Project.of_canonical(ps).corrupted()


@registered("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total, list_min(embedding) AS least, list_max(embedding) AS greatest FROM embeddings")
def store_array_stats(spark, d):
    return array_stats(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding").withColumn("total", F.round("total", 4))


@registered(f"WITH {SIDES} SELECT job_id, 'added' AS change FROM a WHERE job_id NOT IN (SELECT job_id FROM b) UNION ALL SELECT job_id, 'removed' FROM b WHERE job_id NOT IN (SELECT job_id FROM a)")
def cache_delta(spark, d):
    from .sources.workspace import index_delta

    return index_delta(*sides(spark, d))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE NOT (p_brand = 'Brand#12' OR p_size IN (1, 2, 3))")
def remove_jobs(spark, d):
    return parts(spark, d).remove({"$or": [{"brand": "Brand#12"}, {"size.$in": [1, 2, 3]}]}).jobs.select("job_id")


@registered("SELECT count(*) AS num_files, CAST(sum(length(html)) AS BIGINT) AS volume FROM pages WHERE NOT starts_with(url, 'https')")
def sync_transfer_stats(spark, d):
    from .operators.sync import file_plan, transfer_stats

    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string").alias("job_id"), F.col("url").alias("path"), F.lit("2020-01-01").cast("timestamp").alias("mtime"), F.length("html").cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content"))
    return transfer_stats(file_plan(pages, pages.where("path like 'https%'")))


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderkey = 7")
def find_id(spark, d):
    return ids(orders(spark, d), {"_id": "7"})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE instr('FO', o_orderstatus) > 0")
def find_in_text(spark, d):
    return ids(orders(spark, d), {"status.$in": "FO"})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_totalprice < 5000 OR o_totalprice >= 400000 OR (o_orderpriority > '3' AND o_orderpriority <= '4')")
def find_order(spark, d):
    return ids(orders(spark, d), {"$or": [{"price.$lt": 5000}, {"price.$gte": 400000}, {"priority": {"$gt": "3", "$lte": "4"}}]})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 = 6")
def find_variant_missing(spark, d):
    return ids(mixed(spark, d), {"v.$exists": False})


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 7 IN (2, 5)")
def find_variant_where(spark, d):
    return ids(mixed(spark, d), {"v.$where": lambda v: isinstance(v, (str, list))})


@registered("SELECT CAST(o_orderkey AS VARCHAR) AS job_id FROM orders ORDER BY 1 LIMIT 20 OFFSET 30")
def slice_jobs(spark, d):
    return orders(spark, d).find_jobs().slice_ids(30, 50)


@registered("SELECT job_id, distance FROM (SELECT CAST(p_partkey AS VARCHAR) AS job_id, CAST(levenshtein(CAST(p_partkey AS VARCHAR), '1234') AS INTEGER) AS distance FROM part) ORDER BY distance, job_id LIMIT 3")
def suggest_ids(spark, d):
    return parts(spark, d).suggestions("1234")


@registered("SELECT CASE WHEN event_id % 7 = 6 THEN '\"none\"' ELSE '\"some\"' END AS key, count(*) AS n_jobs FROM events GROUP BY 1")
def groupby_callable(spark, d):
    return mixed(spark, d).groupby(lambda sp, doc: "some" if "v" in sp else "none").counts()


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id, count(*) AS n_jobs FROM part GROUP BY 1")
def groupby_none(spark, d):
    return parts(spark, d).groupby().counts()


@registered("SELECT CAST(event_id AS VARCHAR) AS job_id, 'v' AS path, CASE event_id % 7 WHEN 0 THEN 'int' WHEN 1 THEN 'float' WHEN 2 THEN 'str' WHEN 3 THEN 'bool' WHEN 4 THEN 'NoneType' ELSE 'tuple' END AS type, CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN '\"1\"' WHEN 3 THEN 'true' WHEN 4 THEN 'null' ELSE '[1, 2]' END AS json FROM events WHERE event_id % 7 <> 6")
def flatten_leaves(spark, d):
    return mixed(spark, d).leaves().select("job_id", "path", "type", "json")


@registered("SELECT v, n FROM (SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS n FROM orders) WHERE place <= 3 OR place > n - 2")
def schema_ranges(spark, d):
    p = spark.read.parquet(f"{d}/orders.parquet")
    jobs = Project.of_canonical(p.select(F.col("o_orderkey").cast("string").alias("job_id"), canon.typed_json(key=F.col("o_orderkey")).alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))
    return ProjectSchema.detect(jobs.leaves()).ranges().select(F.col("json").cast("bigint").alias("v"), "n")


def tagged(spark, d) -> Project:
    """Orders as jobs with exact JSON: the name only in some, a document in every other."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 5).alias("region"), F.col("o_orderpriority").alias("name"))
    sp = F.when(F.col("key") % 10 != 0, canon.typed_json(key=F.col("key"), region=F.col("region"))).otherwise(canon.typed_json(key=F.col("key"), name=F.col("name"), region=F.col("region")))
    return Project.of_canonical(o.select(F.md5(sp).alias("job_id"), sp.alias("sp_json"), F.when(F.col("key") % 2 == 0, canon.typed_json(region=F.col("region"))).alias("doc_json")))


TAGGED = """sm AS (SELECT *, md5(sp_json) AS job_id, CASE WHEN key % 2 = 0 THEN '{"region": ' || region || '}' END AS doc_json FROM (SELECT *, CASE WHEN key % 10 <> 0
 THEN '{"key": ' || key || ', "region": ' || region || '}' ELSE '{"key": ' || key || ', "name": "' || name || '", "region": ' || region || '}' END AS sp_json
 FROM (SELECT o_orderkey AS key, o_orderkey % 5 AS region, o_orderpriority AS name FROM orders)))"""


@registered(f"WITH {TAGGED} SELECT job_id, CASE WHEN key % 10 <> 0 THEN '' ELSE 'name/' || name || '/' END || 'region/' || region || '/key/' || key AS path FROM sm")
def automatic_path(spark, d):
    from .sources.paths import PATH_COLUMNS, automatic_paths

    return automatic_paths(tagged(spark, d).leaves(columns=PATH_COLUMNS)).select("job_id", "path")


@registered("SELECT 'a/' || p_brand || '/b/' || p_size AS path FROM part WHERE p_size > 25 GROUP BY 1")
def path_nested(spark, d):
    from .sources.paths import nested_paths

    p = spark.read.parquet(f"{d}/part.parquet")
    return nested_paths(p.select(F.concat_ws("/", F.lit("a"), "p_brand", F.when(F.col("p_size") > 25, F.concat(F.lit("b/"), F.col("p_size")))).alias("path")).distinct().union(p.select(F.concat_ws("/", F.lit("a"), "p_brand").alias("path")).distinct()).distinct())


@registered("SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'obsolete' WHEN a.t <> b.t THEN 'update' ELSE 'keep' END AS action FROM (SELECT 'x/' || p_partkey AS p, p_brand AS t FROM part WHERE p_size < 40) a FULL JOIN (SELECT 'x/' || p_partkey AS p, CASE WHEN p_retailprice > 1500 THEN 'z' ELSE p_brand END AS t FROM part WHERE p_size > 10) b ON a.p = b.p")
def view_changes(spark, d):
    from .operators.views import view_plan

    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("x/"), F.col("p_partkey")).alias("path"), F.col("p_brand").alias("target"), "p_size", "p_retailprice")
    return view_plan(p.where("p_size < 40"), p.where("p_size > 10").withColumn("target", F.when(F.col("p_retailprice") > 1500, "z").otherwise(F.col("target")))).select("path", "action")


@registered(f"WITH {TAGGED} SELECT md5(replace(sp_json, '}}', ', \"tag\": 1}}')) AS job_id FROM sm WHERE region = 1 UNION ALL SELECT job_id FROM sm WHERE region <> 1")
def update_statepoints(spark, d):
    return tagged(spark, d).update_statepoints({"tag": 1}, {"region": 1}).jobs.select("job_id")


@registered(f"WITH {TAGGED} SELECT job_id, CASE WHEN region = 1 AND doc_json IS NULL THEN '{{\"tag\": 1}}' WHEN region = 1 THEN replace(doc_json, '}}', ', \"tag\": 1}}') ELSE doc_json END AS doc_json FROM sm")
def update_documents(spark, d):
    return tagged(spark, d).update_documents({"tag": 1}, {"region": 1}).jobs.select("job_id", "doc_json")


@registered(f"WITH {TAGGED} SELECT job_id FROM sm WHERE region <> 4")
def insert_missing(spark, d):
    """Regions 2 and 3 into 0, 1 and 2: some jobs are there already, some are not."""
    p = tagged(spark, d)
    a, b = (Project(p.find_jobs(f).df, p.fields) for f in ({"region.$lt": 3}, {"region": {"$gte": 2, "$lt": 4}}))
    return a.insert(b).jobs.select("job_id")


@registered(f"WITH {TAGGED} SELECT job_id, sp_json FROM sm")
def repair_from_index(spark, d):
    p = tagged(spark, d)
    broken = p._plain().withColumn("sp_json", F.when(F.try_variant_get(F.try_parse_json("sp_json"), "$.key", "int") % 3 == 0, "{").otherwise(F.col("sp_json")))
    return Project.of_canonical(broken).repair(p.jobs).jobs.select("job_id", "sp_json")


@registered(f"WITH {TAGGED} SELECT job_id, 'region' AS path, CASE WHEN key % 4 = 0 THEN '9' ELSE CAST(region AS VARCHAR) END AS json, key % 4 = 0 AND region <> 9 AS conflict FROM sm WHERE doc_json IS NOT NULL")
def sync_documents(spark, d):
    from .operators.sync import DocSync, document_plan

    p = tagged(spark, d)._plain()
    key = F.try_variant_get(F.try_parse_json("sp_json"), "$.key", "int")
    other = p.withColumn("doc_json", F.when(key % 4 == 0, '{"region": 9}').otherwise(F.col("doc_json")))
    return document_plan(p, other, DocSync.ByKey()).select("job_id", "path", "json", "conflict")


#: For each remainder of the key: the source's document, the destination's, and what they come to key by key (dst stays for equal values) and by whole keys.
MERGES = (
    ('{"n": {"a": 3}}', '{"n": {"a": 1, "b": 2}, "k": 1}', None, '{"k": 1, "n": {"a": 3}}'),
    ('{"v": 1.0, "l": [1.0]}', '{"v": 1, "l": [1]}', '{"l": [1], "v": 1}', '{"l": [1.0], "v": 1.0}'),
    ("{}", '{"k": 1}', '{"k": 1}', '{"k": 1}'),
    ('{"n": {"x": 1}, "m": {}}', '{"n": {}, "m": {"y": [2]}}', '{"m": {"y": [2]}, "n": {"x": 1}}', '{"m": {}, "n": {"x": 1}}'),
    ('{"n": {"a": {"b": 1}}}', '{"n": {"a": {"c": null}}}', '{"n": {"a": {"b": 1, "c": null}}}', '{"n": {"a": {"b": 1}}}'),
    ('{"a": "s"}', None, '{"a": "s"}', '{"a": "s"}'),
    (None, '{"a": true}', '{"a": true}', '{"a": true}'),
)


def merge_sides(spark, d):
    """Two projects over all orders with the documents of MERGES."""
    key = F.col("o_orderkey") % len(MERGES)
    text = lambda k: F.element_at(F.array(*(F.lit(m[k]).cast("string") for m in MERGES)), (key + 1).cast("int"))
    o = spark.read.parquet(f"{d}/orders.parquet").select(canon.typed_json(key=F.col("o_orderkey")).alias("sp_json"), text(0).alias("src"), text(1).alias("dst"))
    return (Project.of_canonical(o.select(F.md5("sp_json").alias("job_id"), "sp_json", F.col(c).alias("doc_json"))) for c in ("src", "dst"))


def merge_sql(k: int) -> str:
    cases = " ".join(f"WHEN {i} THEN " + ("NULL" if m[k] is None else f"'{m[k]}'") for i, m in enumerate(MERGES))
    return f"SELECT md5('{{\"key\": ' || o_orderkey || '}}') AS job_id, CASE o_orderkey % {len(MERGES)} {cases} END AS doc_json FROM orders"


@registered(merge_sql(3))
def sync_nested_update(spark, d):
    """Keys of the source's documents replace those of the destination's as a whole."""
    from .operators.sync import DocSync, sync_projects

    return sync_projects(*merge_sides(spark, d), DocSync.UPDATE, check_schema=False).jobs.select("job_id", "doc_json")


@registered(f"SELECT * FROM ({merge_sql(2)}) WHERE doc_json IS NOT NULL UNION ALL SELECT md5('{{\"key\": ' || o_orderkey || '}}'), '{{\"k\": 1, \"n\": {{\"a\": 1, \"b\": 2}}}}' FROM orders WHERE o_orderkey % {len(MERGES)} = 0")
def sync_nested_by_key(spark, d):
    """Mappings merge one within the other; equal numbers are no difference, differences keep the destination's value."""
    from .operators.sync import DocSync, sync_projects

    return sync_projects(*merge_sides(spark, d), DocSync.ByKey("none of them"), check_schema=False).jobs.select("job_id", "doc_json")


REKEY = """WITH RECURSIVE o AS (SELECT DISTINCT o_orderkey AS k FROM orders),
m AS (SELECT k AS j, CASE k % 10 WHEN 0 THEN k + 1 WHEN 1 THEN k - 1 WHEN 2 THEN k + 1 WHEN 3 THEN k + 1 WHEN 4 THEN -k WHEN 5 THEN k + 1 WHEN 7 THEN -(k // 20) - 1000000000 END AS t FROM o WHERE k % 10 IN (0, 1, 2, 3, 4, 5, 7)),
c AS (SELECT m.j, m.t, count(*) OVER (PARTITION BY m.t) > 1 OR (h.k IS NOT NULL AND l.j IS NULL) AS clash, h.k IS NOT NULL AS held FROM m LEFT JOIN o h ON h.k = m.t LEFT JOIN m l ON l.j = m.t),
g AS (SELECT j, t FROM c WHERE NOT clash),
w AS (SELECT j, t AS e, 1 AS n FROM g UNION ALL SELECT w.j, g.t, n + 1 FROM w JOIN g ON g.j = w.e WHERE w.e <> w.j AND n < 20)
SELECT CAST(j AS VARCHAR) AS job_id, CAST(t AS VARCHAR) AS new_id, CASE WHEN clash THEN 'clash' WHEN j IN (SELECT j FROM w WHERE e = j) THEN 'cycle' WHEN held THEN 'chain' ELSE 'free' END AS kind FROM c"""


@registered(REKEY)
def rekey_plan(spark, d):
    """New ids for seven tenths of all orders: pairs that swap, chains of three, ids that others keep, ids that two want."""
    from .operators.rekey import rekey_plan

    k = F.col("k")
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k")).distinct()
    new = F.when(k % 10 == 0, k + 1).when(k % 10 == 1, k - 1).when((k % 10).isin(2, 3, 5), k + 1).when(k % 10 == 4, -k).when(k % 10 == 7, -F.floor(k / 20) - 1000000000)
    text = o.select(k.cast("string").alias("job_id"), new.cast("string").alias("new_id"))
    return rekey_plan(text, text.where("new_id is not null"))


@registered("SELECT md5(sp) AS job_id, sp AS sp_json, doc AS doc_json FROM (SELECT '{\"key\": ' || c_custkey || ', \"nation\": ' || c_nationkey || '}' AS sp, CASE WHEN c_custkey % 3 = 0 THEN '{\"n\": ' || c_custkey || '}' END AS doc FROM customer)")
def archive_round_trip(spark, d):
    """All customers as jobs into a zip that tasks pack, and back from it."""
    from .functions.leaves import working_folder
    from .sources.archives import export_to, import_from

    c = spark.read.parquet(f"{d}/customer.parquet").select(canon.typed_json(key=F.col("c_custkey"), nation=F.col("c_nationkey")).alias("sp_json"), F.when(F.col("c_custkey") % 3 == 0, canon.typed_json(n=F.col("c_custkey"))).alias("doc_json"))
    target = f"{working_folder(spark)}.zip"
    export_to(Project.of_canonical(c.select(F.md5("sp_json").alias("job_id"), "sp_json", "doc_json")), target, "nation/{nation}/{key}")
    return import_from(spark, target).jobs.select("job_id", "sp_json", "doc_json")


@registered("SELECT CAST(vec_id AS VARCHAR) AS key, CASE WHEN label = 3 THEN [vec_id::DOUBLE, 0.5] ELSE embedding::DOUBLE[] END AS value FROM embeddings WHERE label <> 5 OR label IS NULL")
def store_of_arrays(spark, d):
    """All vectors into a store; those of one label are written anew by a second commit; the store, compacted, is read as a table."""
    from .operators.stores import Store

    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label <> 5 or label is null").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("value"), "label", "vec_id")
    s = Store(spark)
    s.write_arrays(e.select("key", "value"))
    s.write_arrays(e.where("label = 3").select("key", F.array(F.col("vec_id").cast("double"), F.lit(0.5)).alias("value")))
    s.compact()
    return s.arrays()


@registered("SELECT CAST(page_id AS VARCHAR) AS job_id, CASE WHEN NOT starts_with(url, 'https') OR length(html) > 3000 THEN 'copy' ELSE 'keep' END AS action FROM pages")
def sync_files(spark, d):
    from .operators.sync import FileSync, file_plan

    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string").alias("job_id"), F.col("url").alias("path"), F.lit("2020-01-02").cast("timestamp").alias("mtime"), F.length("html").cast("bigint").alias("length"), F.encode("html", "UTF-8").alias("content"))
    old = pages.where("path like 'https%'").withColumns({"content": F.when(F.col("length") > 3000, F.encode(F.lit("old"), "UTF-8")).otherwise(F.col("content")), "mtime": F.lit("2020-01-01").cast("timestamp")})
    return file_plan(pages, old, FileSync.update(), deep=True).select("job_id", "action")


@registered(f"WITH {TAGGED} SELECT job_id, CASE WHEN region = 1 THEN '{{}}' ELSE doc_json END AS doc_json FROM sm")
def clear_documents(spark, d):
    return tagged(spark, d).clear({"region": 1}).jobs.select("job_id", "doc_json")


@registered(f"WITH {TAGGED} SELECT job_id, CASE WHEN region IN (1, 2) THEN 'other' ELSE 'here' END AS side FROM sm")
def move_jobs(spark, d):
    p = tagged(spark, d)
    here, there = (Project(p.find_jobs(f).df, p.fields) for f in ({"region.$ne": 2}, {"region": 2}))
    rest, other = here.move({"region": 1}, there)
    return rest.jobs.select("job_id", F.lit("here").alias("side")).union(other.jobs.select("job_id", F.lit("other").alias("side")))


@registered(f"WITH {TAGGED} SELECT job_id FROM sm WHERE region = 0 AND key % 10 = 0")
def find_tokens(spark, d):
    """A filter as typed: a key and a value, a key that must exist."""
    from .plans.filters import from_tokens

    return ids(tagged(spark, d), from_tokens(["region", "0", "name"]))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS job_id FROM part WHERE regexp_matches(p_name, '^\\w+\\s\\w+$')")
def find_regex_python(spark, d):
    """A pattern that Java may read in another way runs as Python's, Arrow batch by batch."""
    return ids(parts(spark, d), {"name.$regex": r"^\w+\s\w+$"})


def big(spark, d, typed: bool) -> Project:
    """Integers that doubles do not tell apart: 2**53 to 2**53 + 2, and 2**60 and 2**60 + 1."""
    v = F.when(F.col("event_id") % 5 < 3, F.lit(1 << 53) + F.col("event_id") % 5).otherwise(F.lit(1 << 60) + F.col("event_id") % 5 - 3)
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("job_id"), v.alias("v"))
    return Project.of_table(e, ["v"]) if typed else Project.of_canonical(e.select("job_id", canon.typed_json(v=F.col("v")).alias("sp_json"), F.lit(None).cast("string").alias("doc_json")))


BIG_CASES = {"eq": ({"v": 1 << 53}, "0"), "gt": ({"v.$gt": 1 << 53}, "1, 2, 3, 4"), "in": ({"v.$in": [1 << 53, (1 << 60) + 1]}, "0, 4"), "lte": ({"v.$lte": 1 << 60}, "0, 1, 2, 3"), "ne": ({"v.$ne": 1 << 60}, "0, 1, 2, 4")}
BIG_SQL = " UNION ALL ".join(f"SELECT '{k}' AS filter, CAST(event_id AS VARCHAR) AS job_id FROM events WHERE event_id % 5 IN ({v})" for k, (_, v) in BIG_CASES.items())


def every_big_case(p: Project) -> DataFrame:
    found = [ids(p, f).select(F.lit(k).alias("filter"), "job_id") for k, (f, _) in BIG_CASES.items()]
    return reduce(DataFrame.union, found)


@registered(BIG_SQL)
def find_big_integers(spark, d):
    return every_big_case(big(spark, d, typed=True))


@registered(BIG_SQL)
def find_variant_big_integers(spark, d):
    return every_big_case(big(spark, d, typed=False))


@registered("SELECT CAST(CASE WHEN event_id % 5 < 3 THEN 9007199254740992 + event_id % 5 ELSE 1152921504606846976 + event_id % 5 - 3 END AS VARCHAR) AS v, count(*) AS n_jobs FROM events GROUP BY 1")
def groupby_variant_big(spark, d):
    return big(spark, d, typed=False).groupby("v").counts().select(F.col("`sp.v`.text").alias("v"), "n_jobs")


@registered(f"WITH {TAGGED} SELECT p.path, CAST(p.job_id AS VARCHAR) AS job_id FROM (SELECT job_id, 'r' || region || '/k' || key AS path FROM sm) p")
def export_paths_callable(spark, d):
    from .sources.archives import export_paths

    return export_paths(tagged(spark, d), lambda i, sp: f"r{sp['region']}/k{sp['key']}").select("path", "job_id")


LINES = {c.removeprefix("l_"): c for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")}


@registered("SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS job_id FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 AND l_discount >= 0.04 AND l_discount <= 0.06 AND l_tax < 0.05 AND l_quantity IN (10, 20, 30) AND l_orderkey > 5 AND l_partkey > 5 AND l_suppkey > 1 AND l_extendedprice > 100")
def find_rich(spark, d):
    """One condition on each of ten keys."""
    p = Project.of_table(spark.read.parquet(f"{d}/lineitem.parquet"), LINES, job_id=F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    f = {"returnflag": "R", "linestatus": "F", "linenumber": 1, "discount": {"$gte": 0.04, "$lte": 0.06}, "tax.$lt": 0.05, "quantity.$in": [10, 20, 30], "orderkey.$gt": 5, "partkey.$gt": 5, "suppkey.$gt": 1, "extendedprice.$gt": 100}
    return ids(p, f)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Events of one type whose document has k below 5: filter columns are pruned and pushed to the scan."""
    e = spark.read.parquet(f"{d}/events.parquet").withColumns({"job_id": F.col("event_id").cast("string"), "k": F.get_json_object("props", "$.k").cast("bigint")})
    return e.where(compile_filter({"event_type": "click", "doc.k.$lt": 5}, TypedFields({"sp.event_type": "event_type", "doc.k": "k"}, e.schema), sure=False)).select("job_id", "event_type", "k")

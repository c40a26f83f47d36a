"""The given parquet tables, and the record views that the operators work on.

Each view reads whole tables.  The views whose text is plain SQL are kept in ``VIEW_SQL`` so that
the oracle can build them from the same definition; the others need ordered work and are written
as DataFrame functions here and, independently, as SQL in the plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.ordered import dense_position


# Given schemas, so that no job is needed to read file footers first.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# The response texts of the vote log, one per flag or parse outcome.
YES_TEXT = "Yes, this contract contains the requested clause in section four of it"
NO_TEXT = "No, the clause is absent from this contract after reading all sections"
SHORT_TEXT = "No."
BOTH_TEXT = "Yes, see the notice section where the clause is set out in full"
HEDGE_TEXT = "Yes, maybe the clause is there but the wording in part two is vague"
OPEN_TEXT = "The requested clause could be in part two but I am still reading this"

# name -> (tables it reads, SQL in the subset shared by both engines)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "contracts": (
        ("documents", "labels"),
        """SELECT d.doc_id AS id, d.text AS text, d.n_chars AS text_length, l.quality AS quality,
                  l.toxic AS toxic
           FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    ),
    "vote_log": (
        ("events",),
        f"""SELECT user_id AS contract_id,
                  CASE WHEN event_id % 2 = 0 THEN 'quality' ELSE 'toxic' END AS clause_category,
                  event_id AS seq,
                  CASE WHEN event_type IN ('signup', 'click')
                            THEN CASE WHEN user_id % 3 = 0 THEN '{NO_TEXT}' ELSE '{YES_TEXT}' END
                       WHEN event_type = 'view'
                            THEN CASE WHEN user_id % 3 = 0 THEN '{YES_TEXT}' ELSE '{NO_TEXT}' END
                       WHEN event_type = 'purchase' AND value < 10 THEN '{SHORT_TEXT}'
                       WHEN event_type = 'purchase' THEN '{BOTH_TEXT}'
                       WHEN value < 10 THEN repeat('yes ', 800)
                       WHEN value < 40 THEN '{HEDGE_TEXT}'
                       ELSE '{OPEN_TEXT}' END AS response,
                  event_type = 'error' AND value >= 100 AS failed
           FROM {{events}}""",
    ),
    "media_files": (
        ("part",),
        """SELECT p_partkey AS media_id,
                  '/data/collected/' || lower(p_type) || '/'
                  || CASE WHEN p_partkey % 50 = 0 THEN '.' ELSE '' END || cast(p_partkey AS string)
                  || CASE p_partkey % 8 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png'
                       WHEN 3 THEN '.webp' WHEN 4 THEN '.gif' WHEN 5 THEN '.mp4' WHEN 6 THEN '.mov'
                       ELSE '.txt' END AS path,
                  cast(round(p_retailprice * 100) AS bigint) AS length,
                  256 + p_size * 32 AS width,
                  256 + cast(p_partkey % 40 AS int) * 32 AS height
           FROM {part}""",
    ),
    "captions": (
        ("documents",),
        "SELECT cast(doc_id AS string) AS stem, text AS caption FROM {documents}",
    ),
    "sidecar_json": (
        ("events",),
        """SELECT cast(event_id AS string) AS stem,
                  CASE WHEN event_id % 17 = 0 THEN '{bad'
                       WHEN event_type = 'view' THEN props
                       WHEN event_type = 'error' THEN '[1, 2]'
                       ELSE '{"title": "' || event_type || '", "author": "u' || cast(user_id AS string)
                            || '", "score": ' || cast(user_id AS string) || '}' END AS json
           FROM {events}""",
    ),
    # captions and sidecars beside the files, and others of the same names in another folder
    "folder_captions": (
        ("documents", "part"),
        """SELECT '/data/collected/' || lower(p_type) || '/' || cast(doc_id AS string) AS base, text AS caption
           FROM {documents} JOIN {part} ON p_partkey = doc_id
           UNION ALL
           SELECT '/data/collected/other/' || cast(doc_id AS string), 'other ' || text FROM {documents}""",
    ),
    "folder_sidecars": (
        ("events", "part"),
        """SELECT '/data/collected/' || lower(p_type) || '/' || cast(event_id AS string) AS base,
                  CASE WHEN event_type = 'view' THEN '{bad' WHEN event_type = 'error' THEN '[1, 2]'
                       ELSE '{"title": "' || event_type || '", "score": ' || cast(user_id AS string) || '}' END AS json
           FROM {events} JOIN {part} ON p_partkey = event_id
           UNION ALL
           SELECT '/data/collected/other/' || cast(event_id AS string), '{"title": "other"}' FROM {events}""",
    ),
    "collections": (
        ("supplier", "nation"),
        """SELECT 'col-s' || cast(s_suppkey AS string) AS id, 'collection' AS type, s_name AS name,
                  '/data/n' || cast(s_nationkey AS string) || '/s' || cast(s_suppkey AS string)
                      AS output_dir,
                  cast(s_suppkey AS bigint) AS seq
           FROM {supplier} WHERE s_acctbal >= 3000
           UNION ALL
           SELECT 'col-n' || cast(n_nationkey AS string), 'collection', n_name,
                  '/data/n' || cast(n_nationkey AS string), cast(n_nationkey AS bigint)
           FROM {nation} WHERE n_regionkey <> 4""",
    ),
    "annotations": (
        ("lineitem", "supplier"),
        """SELECT 'ann-' || cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string)
                      || '-' || cast(l_partkey AS string) || '-' || cast(l_suppkey AS string) AS id,
                  'annotation' AS type, l_returnflag AS name,
                  '/data/n' || cast(s_nationkey AS string) || '/s' || cast(s_suppkey AS string)
                      || '/p' || cast(l_partkey AS string) AS input_dir,
                  CASE WHEN l_linestatus = 'F' AND l_returnflag = 'A'
                       THEN 'col-s' || cast(l_suppkey AS string) END AS parent_collection_id
           FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    ),
    "runs": (
        ("customer",),
        """SELECT md5(cast(c_custkey AS string)) AS run_hash, c_name AS name,
                  CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS experiment,
                  c_custkey AS seq,
                  timestamp '2024-01-01 00:00:00' + c_custkey * interval '1' hour AS created_at,
                  cast(1 + c_custkey % 20 AS int) AS epochs,
                  CASE c_custkey % 3 WHEN 0 THEN 0.0001e0 WHEN 1 THEN 0.0002e0 ELSE 0.0005e0 END
                      AS learning_rate,
                  cast(4 * (1 + c_custkey % 8) AS int) AS lora_rank
           FROM {customer}""",
    ),
    "objects": (
        ("part",),
        """SELECT 'datasets/' || p_brand || '/' || cast(p_partkey AS string) AS key,
                  cast(p_size AS bigint) AS size, md5(p_name) AS etag
           FROM {part}""",
    ),
    "objects_remote": (
        ("part", "supplier"),
        """SELECT 'datasets/' || p_brand || '/' || cast(p_partkey AS string) AS key,
                  cast(p_size + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS bigint) AS size,
                  md5(p_type) AS etag
           FROM {part} WHERE p_size > 5
           UNION ALL
           SELECT 'datasets/old/' || cast(s_suppkey AS string), cast(1 AS bigint), md5(s_name)
           FROM {supplier}""",
    ),
    "papers": (
        ("documents",),
        """SELECT doc_id AS id, text AS title, source AS authors, 2015 + cast(doc_id % 10 AS int) AS year,
                  CASE WHEN lang = 'de' THEN '' ELSE 'On ' || lang || ' texts of ' || source || '.' END AS abstract,
                  CASE WHEN lang = 'en' THEN '' ELSE '10.1/' || cast(doc_id AS string) END AS doi,
                  '["' || lang || '", "' || source || '"]' AS tags
           FROM {documents}""",
    ),
    "pred_ref": (
        ("documents",),
        """SELECT doc_id AS pos, text AS prediction,
                  replace(replace(text, ',', ''), ' the ', ' a ') AS reference
           FROM {documents}""",
    ),
    "detections": (
        ("lineitem",),
        """SELECT l_orderkey AS image_id, l_linenumber AS cls, l_discount * 10 AS conf
           FROM {lineitem}""",
    ),
    "verdicts": (
        ("orders",),
        """SELECT o_orderkey AS item_id, o_orderstatus AS truth,
                  CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 400000 THEN 'O'
                       ELSE 'X' END AS predicted
           FROM {orders}""",
    ),
    "commits": (
        ("supplier",),
        """SELECT md5(cast(s_suppkey AS string)) AS commit_hash, s_name AS message,
                  'branch-' || cast(s_nationkey AS string) AS branch
           FROM {supplier}""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A record view by name."""
    if name in _BUILT:
        return _BUILT[name](spark, sf_dir)
    reads, text = VIEW_SQL[name]
    frames = {}
    for read in reads:
        frames[read] = table(spark, sf_dir, read)
        text = text.replace("{" + read + "}", f"__{read}")
        frames[read].createOrReplaceTempView(f"__{read}")
    return spark.sql(text)


def vote_log_of(events: DataFrame) -> DataFrame:
    """The vote log of an event table or stream."""
    spark = events.sparkSession
    name = "__event_stream" if events.isStreaming else "__events"
    events.createOrReplaceTempView(name)
    return spark.sql(VIEW_SQL["vote_log"][1].replace("{events}", name))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric series of the runs: the n-th event of a kind by a user is step n."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    steps = dense_position(events, ["user_id", "event_type"], "event_id", "step", costly=True)
    return steps.select(
        F.md5(F.col("user_id").cast("string")).alias("run_hash"),
        F.col("event_type").alias("name"),
        "step",
        F.col("event_id").alias("tracked"),
        "value",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered model versions: the parts of a brand in key order are its versions."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    numbered = dense_position(part, ["p_brand"], "p_partkey", "number")
    return numbered.select(
        F.col("p_brand").alias("name"),
        F.concat(F.lit("v"), F.col("number")).alias("version"),
        "number",
        F.col("p_partkey").alias("seq"),
        F.md5(F.col("p_partkey").cast("string")).alias("run_hash"),
        F.when(F.col("p_partkey") % 4 == 0, "development")
        .when(F.col("p_partkey") % 4 == 1, "staging")
        .when(F.col("p_partkey") % 4 == 2, "production")
        .otherwise("archived")
        .alias("stage"),
        F.col("p_size").cast("long").alias("size_bytes"),
    )


_BUILT = {"run_metrics": run_metrics, "registry": registry}

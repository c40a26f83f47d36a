"""Queries that render notes."""

from pyspark.sql import functions as F

from tallyloom.operators import notes, provenance, review, runs
from tallyloom.plans.catalog import query, r6
from tallyloom.plans.runs import EXP, as_of
from tallyloom.plans.voting import VIEWS, judged, judged_ctes

DAY = "2024-03-01"


def hashed(rows):
    return rows.select("filename", F.md5("content").alias("content_md5"))


@query(
    "model_notes",
    f"""SELECT regexp_replace(lower(name), '[^a-z0-9_-]', '-', 'g') || '-' || version || '.md' AS filename,
      md5('---\ntype: model-registry\nmodel_id: "' || name || '"\nversion: "' || version || '"\nimage_digest: "sha256:'
      || run_hash || '"\ncreated: "{DAY}"\nstage: ' || stage || '\nrun_id: "' || substr(run_hash, 1, 8)
      || '"\ntags: []\n---\n\n# Model: ' || name || '\n\n## Registry Info\n- **Image:** registry.local/' || name || ':'
      || version || '\n- **Digest:** sha256:' || run_hash || '\n- **Run:** [[experiments/runs/'
      || substr(run_hash, 1, 8) || ']]\n') AS content_md5 FROM registry""",
    ("registry",),
)
def model_notes(t):
    versions = t.registry.withColumn("digest", F.concat(F.lit("sha256:"), "run_hash"))
    return hashed(notes.model_notes(versions, "registry.local", DAY))


@query(
    "paper_stubs",
    """SELECT page_id || '.md' AS filename, md5('---\ntype: paper\ntitle: "' || page_id
      || '"\nauthors: []\nyear:\nurl:\npdf: "[[papers/pdfs/' || page_id || '.pdf]]"\ntags: []\n---\n\n# '
      || page_id || '\n') AS content_md5 FROM pages""",
)
def paper_stubs(t):
    stem = F.col("page_id").cast("string")
    return hashed(notes.paper_stubs(t.pages, stem, F.concat(stem, F.lit(".pdf"))))


@query(
    "dataset_notes",
    f"""SELECT stem || '.md' AS filename, md5('---\ntype: dataset\ndataset_id: "' || stem || '"\ncreated: "{DAY}"'
      || '\nversion: "1.0"\nmanifest: "[[datasets/manifests/' || stem || '.json]]"\ntags: []\n---\n\n# Dataset: '
      || stem || '\n\n## Statistics\n' || CASE WHEN NOT json_valid(json)
           THEN '| Stat | Value |\n|------|-------|\n| Samples | |\n| Classes | |'
           ELSE '| Key | Value |\n|-----|-------|\n' || CASE WHEN json_type(json) = 'ARRAY'
             THEN '| samples | ' || json_array_length(json) || ' |'
             ELSE array_to_string(list_transform(list_sort(json_keys(json)),
                    lambda k: '| ' || k || ' | ' || json_extract_string(json, '$.' || k) || ' |'), '\n') END END
      || '\n') AS content_md5 FROM sidecar_json""",
    ("sidecar_json",),
)
def dataset_notes(t):
    readable = F.try_parse_json("json").isNotNull()
    numbers = F.when(readable, provenance.manifest_numbers(F.when(readable, F.col("json"))))
    return hashed(notes.dataset_notes(t.sidecar_json, F.col("stem"), numbers, DAY))


@query(
    "manifest_notes",
    """SELECT type || 's/' || id || '.md' AS filename, md5('---\nid: "' || id || '"\ntype: "' || type || '"\nname: "'
      || name || '"\noutput_dir: "' || output_dir || '"\ncounts: {"files":' || n || '}\n'
      || CASE WHEN parent IS NULL THEN 'links: {"collection": null}'
              ELSE 'parent_collection_id: "' || parent || '"\nlinks: {"collection": "[[collections/' || parent || ']]"}'
         END || '\n---\n# ' || name || '\n\n**Type:** ' || type || '\n**Output:** ' || output_dir
      || '\n\n## Counts\n{"files":' || n || '}\n') AS content_md5
    FROM (SELECT id, type, name, output_dir, length(name) AS n, NULL AS parent FROM collections
          UNION ALL SELECT id, type, name, input_dir, length(name), parent_collection_id FROM annotations)""",
    ("collections", "annotations"),
)
def manifest_notes(t):
    ann = t.annotations.withColumnRenamed("input_dir", "output_dir")
    rows = t.collections.drop("seq").unionByName(ann, allowMissingColumns=True)
    counts = F.to_json(F.struct(F.char_length("name").alias("files")))
    return hashed(notes.manifest_notes(rows.withColumn("counts", counts)))


@query(
    "index_note",
    f"""SELECT 'experiments-index.md' AS filename, md5('---\ntype: index\ntags: [experiments]\n---\n\n# Experiments Index'
      || '\n\n## Recent Experiments\n\n' || string_agg('- [[' || name || ']]\n', '' ORDER BY name DESC)
      || '\n## Statistics\n\n- **Total Experiments:** ' || (SELECT count(*) FROM runs) || '\n') AS content_md5
    FROM (SELECT strftime(created_at, '%Y%m%d') || '-' || {EXP} || '-' || substr(run_hash, 1, 8) AS name FROM runs
          ORDER BY name DESC LIMIT 20)""",
    ("runs",),
)
def index_note(t):
    names = runs.run_filenames(t.runs, as_of()).select(F.regexp_replace("export_name", r"\.md$", "").alias("name"))
    return hashed(notes.index_note(runs.experiment_index(names)))


@query(
    "numeric_metrics",
    """SELECT stem, k AS key, round(json_extract_string(json, '$.' || k)::double, 6) AS value
       FROM (SELECT stem, json, unnest(json_keys(json)) AS k FROM sidecar_json
             WHERE json_valid(json) AND json_type(json) = 'OBJECT')
       WHERE json_type(json_extract(json, '$.' || k)) IN ('UBIGINT', 'BIGINT', 'DOUBLE')""",
    ("sidecar_json",),
)
def numeric_metrics(t):
    return r6(runs.numeric_entries(t.sidecar_json, "stem", "json"))


@query(
    "optimal_thresholds",
    """SELECT contract_id, min(k) AS k FROM (
         SELECT contract_id, k, pow(1 / (1 + pow((1 - p) / p, k)), 2) AS p_full FROM (
           SELECT contract_id, count(*) FILTER (correct) / count(*) AS p FROM judged GROUP BY 1),
           (VALUES (1), (2), (3), (5), (7)) v(k) WHERE p > 0)
       WHERE p_full >= 0.9 GROUP BY 1""",
    VIEWS,
    judged_ctes(1, 1),
)
def optimal_thresholds(t):
    rates = judged(t, 1, 1).groupBy("contract_id").agg(
        (F.count_if("correct") / F.count("*")).alias("p"), F.lit(2).alias("s"), F.lit(1.0).alias("v")
    )
    return review.best_threshold(review.scaling_laws(rates, (1, 2, 3, 5, 7), (0.9,)), ["contract_id"])

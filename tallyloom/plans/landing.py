"""Queries that land and curate records: texts, media, sidecars, tasks, work lists."""

from pyspark.sql import functions as F

from tallyloom.functions import paths as px
from tallyloom.functions import text as tx
from tallyloom.operators import landing, media, sampling
from tallyloom.plans.catalog import query, r6
from tallyloom.sources import readers, sinks
from tallyloom.session import shared_dir


def ext_list(extensions) -> str:
    return "(" + ", ".join(f"'{e}'" for e in extensions) + ")"


NAME = "regexp_extract(path, '[^/]*$')"
SUFFIX = f"lower(regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1))"
BASE = "regexp_replace(path, '([^/])\\.[^./]+$', '\\1')"
STEM = f"regexp_replace({NAME}, '^(.+)\\.[^.]+$', '\\1')"


# -- texts ---------------------------------------------------------------------------------------


@query(
    "land_texts",
    """SELECT id, text_length, source, md5(text) AS text_md5
       FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, length(text) AS text_length, source, text
             FROM documents) WHERE text IS NOT NULL""",
)
def land_texts(t):
    return landing.land_text(t.documents, "doc_id").select(
        "id", "text_length", "source", F.md5("text").alias("text_md5")
    )


@query(
    "land_first_texts",
    """SELECT id, doc_id, text_length FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id,
         nullif(text, '') AS text, length(text) AS text_length FROM documents)
       WHERE id < 100 AND text IS NOT NULL""",
)
def land_first_texts(t):
    docs = t.documents.withColumn("text", F.nullif("text", F.lit("")))
    return landing.land_text(docs, "doc_id", limit=100).select("id", "doc_id", "text_length")


@query(
    "contracts_head",
    "SELECT id, text_length, quality, toxic FROM contracts ORDER BY id LIMIT 100",
    ("contracts",),
)
def contracts_head(t):
    return landing.head(t.contracts.drop("text"), ["id"], 100)


@query("text_lengths", "SELECT doc_id, length(text) AS text_length FROM documents")
def text_lengths(t):
    return t.documents.select("doc_id", F.char_length("text").alias("text_length"))


@query("max_length_filter", "SELECT doc_id, n_chars FROM documents WHERE length(text) <= 8000")
def max_length_filter(t):
    return t.documents.where(F.char_length("text") <= 8000).select("doc_id", "n_chars")


@query(
    "clause_tasks",
    """SELECT id AS contract_id, c.clause_category,
              cast(CASE c.clause_category WHEN 'quality' THEN quality ELSE toxic END AS string) AS label,
              CASE WHEN coalesce(CASE c.clause_category WHEN 'quality' THEN quality ELSE toxic END, 0) <> 0
                   THEN 'YES' ELSE 'NO' END AS truth,
              'clause_identification' AS task_type, 3 AS voting_threshold
       FROM contracts, (VALUES ('quality'), ('toxic')) c(clause_category)""",
    ("contracts",),
)
def clause_tasks(t):
    return landing.clause_tasks(t.contracts)


@query("decomposition_size", "SELECT 2 * count(*) AS total_tasks FROM contracts", ("contracts",))
def decomposition_size(t):
    return landing.clause_tasks(t.contracts).agg(F.count("*").alias("total_tasks"))


@query(
    "truthiness",
    """SELECT id, coalesce(quality, 0) <> 0 AS number_true, text <> '' AS text_true,
              coalesce(toxic = 1, false) AS flag_true FROM contracts""",
    ("contracts",),
)
def truthiness(t):
    rows = t.contracts.withColumn("flag", F.col("toxic") == 1)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(
        "id",
        tx.truthy(F.col("quality"), kinds["quality"]).alias("number_true"),
        tx.truthy(F.col("text"), kinds["text"]).alias("text_true"),
        tx.truthy(F.col("flag"), kinds["flag"]).alias("flag_true"),
    )


_STATS_SQL = """SELECT count(*) AS total_samples,
      array_to_string(list_filter([CASE WHEN bool_or(coalesce(quality, 0) <> 0) THEN 'quality' END,
        CASE WHEN bool_or(coalesce(toxic, 0) <> 0) THEN 'toxic' END], lambda x: x IS NOT NULL), ',')
          AS clause_categories,
      cast(sum(text_length) AS bigint) AS total_text_length,
      round(sum(text_length) / greatest(count(*), 1), 6) AS avg_text_length FROM contracts"""


@query("collection_stats", _STATS_SQL, ("contracts",))
def collection_stats(t):
    stats = landing.collection_stats(t.contracts)
    return r6(stats.withColumn("clause_categories", F.array_join("clause_categories", ",")))


@query("collection_summary_file", _STATS_SQL, ("contracts",))
def collection_summary_file(t):
    """The summary document, written as JSON and read back."""
    path = sinks.json_lines(landing.collection_stats(t.contracts), shared_dir(t.spark, "summary"))
    schema = (
        "total_samples long, clause_categories array<string>, total_text_length long, avg_text_length double"
    )
    back = readers.json_lines(t.spark, path, schema)
    return r6(back.withColumn("clause_categories", F.array_join("clause_categories", ",")))


@query(
    "collection_documents",
    """SELECT 'metadata' AS document, '{"dataset":"contracts","split":"train","download_date":"2025-01-31T00:00:00","total_samples":'
              || count(*) || ',"clause_categories":["quality","toxic"],"num_categories":2,"avg_text_length":'
              || cast(cast(round(sum(text_length) / greatest(count(*), 1), 2) AS decimal(18,2)) AS string)
              || ',"output_file":"contracts/train.jsonl"}' AS content FROM contracts
       UNION ALL SELECT 'tasks', '{"voting_threshold":3,"granularity":"clause","total_tasks":' || 2 * count(*)
              || ',"created_at":"2025-01-31T00:00:00"}' FROM contracts""",
    ("contracts",),
)
def collection_documents(t):
    """The metadata of a collection and the configuration of its tasks as whole JSON documents, read back."""
    as_of = F.lit("2025-01-31 00:00:00").cast("timestamp")
    metadata = landing.collection_metadata(t.contracts, "contracts", "train", as_of, "contracts/train.jsonl")
    config = landing.task_config(landing.clause_tasks(t.contracts), 3, "clause", as_of)
    parts = []
    for name, document in (("metadata", metadata), ("tasks", config)):
        path = sinks.json_lines(document, shared_dir(t.spark, name))
        back = t.spark.read.schema("content string").text(path)
        parts.append(back.select(F.lit(name).alias("document"), "content"))
    return parts[0].unionByName(parts[1])


@query(
    "contracts_json_lines",
    "SELECT id, md5(text) AS text_md5, text_length, quality, toxic FROM contracts",
    ("contracts",),
)
def contracts_json_lines(t):
    """Contracts written as JSON lines and read back; nulls and other scripts survive."""
    path = sinks.json_lines(t.contracts, shared_dir(t.spark, "contracts"))
    back = readers.json_lines(t.spark, path, "id long, text string, text_length long, quality int, toxic int")
    return back.select("id", F.md5("text").alias("text_md5"), "text_length", "quality", "toxic")


@query(
    "seeded_sample",
    "SELECT doc_id, source FROM documents ORDER BY md5(cast(doc_id AS string) || ':42'), doc_id LIMIT 100",
)
def seeded_sample(t):
    return sampling.shuffled_sample(t.documents.select("doc_id", "source"), "doc_id", 100)


@query(
    "train_validation_split",
    """SELECT doc_id, CASE WHEN ('0x' || substr(md5(cast(doc_id AS string) || ':42'), 1, 8))::bigint % 100 < 90
                           THEN 'train' ELSE 'validation' END AS split FROM documents""",
)
def train_validation_split(t):
    return sampling.train_split(t.documents.select("doc_id"), "doc_id")


@query(
    "stratified_sample",
    """SELECT doc_id, quality, toxic FROM (SELECT *, row_number() OVER (PARTITION BY quality * 2 + toxic
         ORDER BY md5(cast(doc_id AS string) || ':42'), doc_id) AS nth FROM labels) WHERE nth <= 20""",
)
def stratified_sample(t):
    rows = t.labels.withColumn("stratum", F.col("quality") * 2 + F.col("toxic"))
    return sampling.stratified_sample(rows, "doc_id", "stratum", 20).drop("stratum")


@query(
    "text_windows",
    """SELECT doc_id, w AS "window", length(substr(text, cast(w * 3500 + 1 AS bigint), 4000)) AS chars,
              md5(substr(text, cast(w * 3500 + 1 AS bigint), 4000)) AS window_md5
       FROM (SELECT doc_id, text,
               unnest(range(0, cast(floor(greatest(length(text) - 501, 0) / 3500) AS bigint) + 1)) AS w
             FROM documents)""",
)
def text_windows(t):
    cut = sampling.text_windows(t.documents.select("doc_id", "text"), "text", 4000, 500)
    return cut.select(
        "doc_id", "window", F.char_length("window_text").alias("chars"), F.md5("window_text").alias("window_md5")
    )


# -- media ---------------------------------------------------------------------------------------


@query(
    "land_media",
    """SELECT media_id, path, length FROM (SELECT *, CASE WHEN width >= 512 THEN path END AS image
       FROM media_files) WHERE image IS NOT NULL ORDER BY media_id LIMIT 200""",
    ("media_files",),
)
def land_media(t):
    files = t.media_files.withColumn("image", F.when(F.col("width") >= 512, F.col("path")))
    return landing.land_media(files, "media_id", "image", 200).select("media_id", "path", "length")


@query(
    "landing_counts",
    """SELECT count(*) AS total, count(*) FILTER (width >= 512) AS kept,
              count(*) FILTER (width < 512) AS skipped FROM media_files""",
    ("media_files",),
)
def landing_counts(t):
    return landing.landing_counts(
        t.media_files.withColumn("image", F.when(F.col("width") >= 512, F.col("path"))), "image"
    )


@query(
    "scan_images",
    f"SELECT path, length FROM media_files WHERE {SUFFIX} IN {ext_list(px.IMAGE_EXTENSIONS)}",
    ("media_files",),
)
def scan_images(t):
    return media.select_media(t.media_files, px.IMAGE_EXTENSIONS).select("path", "length")


_SETS = {
    "image": px.IMAGE_EXTENSIONS,
    "video": px.VIDEO_EXTENSIONS,
    "dataset": px.DATASET_EXTENSIONS,
    "pair": px.PAIR_EXTENSIONS,
}


@query(
    "files_by_extension_set",
    " UNION ALL ".join(
        f"SELECT '{n}' AS extension_set, count(*) FILTER ({SUFFIX} IN {ext_list(e)}) AS n FROM media_files"
        for n, e in _SETS.items()
    ),
    ("media_files",),
)
def files_by_extension_set(t):
    counts = [
        F.struct(F.lit(n).alias("extension_set"), F.count_if(px.has_extension(F.col("path"), e)).alias("n"))
        for n, e in _SETS.items()
    ]
    return t.media_files.agg(F.array(*counts).alias("c")).select(F.inline("c"))


@query(
    "media_type_filter",
    "SELECT media_id FROM media_files WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('jpg', 'png')",
    ("media_files",),
)
def media_type_filter(t):
    return t.media_files.where(px.has_extension(F.col("path"), (".jpg", ".png"))).select("media_id")


_KIND = f"""CASE WHEN {SUFFIX} IN {ext_list(px.COLLECTED_IMAGE_EXTENSIONS)} THEN 'image'
                 WHEN {SUFFIX} IN {ext_list(px.COLLECTED_VIDEO_EXTENSIONS)} THEN 'video' ELSE 'other' END"""


@query("media_kinds", f"SELECT media_id, {_KIND} AS kind FROM media_files", ("media_files",))
def media_kinds(t):
    return t.media_files.select("media_id", px.media_kind(F.col("path")).alias("kind"))


@query(
    "visible_files",
    f"SELECT media_id FROM media_files WHERE NOT starts_with({NAME}, '.')",
    ("media_files",),
)
def visible_files(t):
    return t.media_files.where(~px.is_hidden(F.col("path"))).select("media_id")


@query(
    "path_parts",
    f"""SELECT media_id, {NAME} AS filename, {STEM} AS stem,
               regexp_extract({NAME}, '^.+(\\.[^.]+)$', 1) AS suffix,
               split_part(path, '/', -2) AS source_dir FROM media_files""",
    ("media_files",),
)
def path_parts(t):
    return media.path_parts(t.media_files).select("media_id", "filename", "stem", "suffix", "source_dir")


@query(
    "image_names",
    "SELECT media_id, lpad(cast(media_id AS string), 8, '0') || '.png' AS filename FROM media_files",
    ("media_files",),
)
def image_names(t):
    return t.media_files.select("media_id", F.format_string("%08d.png", "media_id").alias("filename"))


@query(
    "metadata_without_payload",
    """SELECT media_id, '{"media_id":' || media_id || ',"length":' || length || ',"width":' || width
              || ',"height":' || height || '}' AS metadata FROM media_files""",
    ("media_files",),
)
def metadata_without_payload(t):
    return t.media_files.select("media_id", F.to_json(F.struct(*t.media_files.drop("path").columns)).alias("metadata"))


@query(
    "media_counts",
    f"""SELECT split_part(path, '/', -2) AS source, count(*) FILTER ({_KIND} = 'image') AS images,
               count(*) FILTER ({_KIND} = 'video') AS videos, count(*) FILTER ({_KIND} = 'other') AS other
        FROM media_files GROUP BY 1""",
    ("media_files",),
)
def media_counts(t):
    return media.media_counts(t.media_files, px.parent_name(F.col("path")))


@query(
    "media_totals",
    f"""SELECT count(*) FILTER ({_KIND} = 'image') AS images, count(*) FILTER ({_KIND} = 'video') AS videos
        FROM media_files""",
    ("media_files",),
)
def media_totals(t):
    per_source = media.media_counts(t.media_files, px.parent_name(F.col("path")))
    return per_source.agg(F.sum("images").alias("images"), F.sum("videos").alias("videos"))


_DATASET = f"{SUFFIX} IN {ext_list(px.DATASET_EXTENSIONS)} AND NOT starts_with({NAME}, '.')"


@query(
    "samples_per_source",
    f"SELECT split_part(path, '/', -2) AS source_dir, count(*) AS n FROM media_files WHERE {_DATASET} GROUP BY 1",
    ("media_files",),
)
def samples_per_source(t):
    images = media.select_media(t.media_files, px.DATASET_EXTENSIONS, hidden=False)
    return media.path_parts(images).groupBy("source_dir").agg(F.count("*").alias("n"))


@query(
    "images_with_captions",
    f"""SELECT media_id, stem, md5(caption) AS caption_md5 FROM (SELECT *, {STEM} AS stem FROM media_files
          WHERE {_DATASET}) m LEFT JOIN (SELECT base, trim(caption, ' ') AS caption FROM folder_captions) c
          ON c.base = {BASE}""",
    ("media_files", "folder_captions", "folder_sidecars"),
)
def images_with_captions(t):
    samples = media.visual_samples(t.media_files, t.folder_captions, t.folder_sidecars)
    return samples.select("media_id", "stem", F.md5("caption").alias("caption_md5"))


@query(
    "training_pairs",
    f"""SELECT media_id, length(trim(caption, ' ')) AS caption_chars FROM (SELECT *, {BASE} AS base
          FROM media_files WHERE {SUFFIX} IN {ext_list(px.PAIR_EXTENSIONS)}) JOIN folder_captions USING (base)""",
    ("media_files", "folder_captions"),
)
def training_pairs(t):
    pairs = media.training_pairs(t.media_files, t.folder_captions)
    return pairs.select("media_id", F.char_length("caption").alias("caption_chars"))


_OBJECT = "CASE WHEN json_valid(json) THEN json_type(json) END"
_SIDE = """coalesce(json_extract_string(json, '$.title'), '') AS title,
           coalesce(json_extract_string(json, '$.author'), '') AS author,
           coalesce(json_extract_string(json, '$.subreddit'), '') AS subreddit,
           coalesce(json_extract_string(json, '$.url'), '') AS url,
           coalesce(try_cast(json_extract_string(json, '$.score') AS bigint), 0) AS score"""


@query(
    "sidecar_fields",
    f"""SELECT stem, {_SIDE} FROM (SELECT stem, CASE WHEN json_valid(json) THEN json ELSE '{{}}' END AS json
        FROM sidecar_json)""",
    ("sidecar_json",),
)
def sidecar_fields(t):
    return t.sidecar_json.select("stem", *[c.alias(n) for n, c in media.sidecar_fields(F.col("json")).items()])


@query(
    "readable_sidecars",
    f"SELECT stem, coalesce({_OBJECT} = 'OBJECT', false) AS readable FROM sidecar_json",
    ("sidecar_json",),
)
def readable_sidecars(t):
    return t.sidecar_json.select("stem", media.readable(F.col("json")).alias("readable"))


@query(
    "metrics_json_check",
    f"""SELECT coalesce({_OBJECT}, 'unreadable') = 'OBJECT' AS valid, count(*) AS n FROM sidecar_json
        GROUP BY 1""",
    ("sidecar_json",),
)
def metrics_json_check(t):
    valid = media.readable(F.col("json"))
    return t.sidecar_json.groupBy(valid.alias("valid")).agg(F.count("*").alias("n"))


@query(
    "images_with_sidecars",
    f"""SELECT media_id, m.title, m.score FROM (SELECT *, {BASE} AS base FROM media_files WHERE {_DATASET})
        LEFT JOIN (SELECT base, {_SIDE} FROM folder_sidecars WHERE {_OBJECT} = 'OBJECT') m USING (base)""",
    ("media_files", "folder_captions", "folder_sidecars"),
)
def images_with_sidecars(t):
    return media.visual_samples(t.media_files, t.folder_captions, t.folder_sidecars).select("media_id", "title", "score")


@query(
    "caption_outcomes",
    """SELECT count(*) AS processed, count(*) FILTER (length(caption) >= 100) AS successful,
              count(*) FILTER (length(caption) < 100) AS failed FROM captions""",
    ("captions",),
)
def caption_outcomes(t):
    results = t.captions.withColumn("error", F.when(F.char_length("caption") < 100, F.lit("too short")))
    return media.processing_counts(results)


@query(
    "styled_captions",
    "SELECT stem, md5('sketch style, ' || caption) AS caption_md5 FROM captions",
    ("captions",),
)
def styled_captions(t):
    styled = F.concat(F.lit("sketch style, "), "caption")
    return t.captions.select("stem", F.md5(styled).alias("caption_md5"))


@query(
    "min_resolution",
    """SELECT media_id, width, height, round(width / height, 6) AS aspect_ratio FROM media_files
       WHERE least(width, height) >= 512""",
    ("media_files",),
)
def min_resolution(t):
    return r6(media.min_resolution(t.media_files, 512).select("media_id", "width", "height", "aspect_ratio"))


_PATTERNS = ("stripes", "noise", "checker")


@query(
    "work_grid",
    """SELECT media_id, pattern, n * 3 + p AS sample_index, 42 + n * 3 + p AS seed,
              least(height // 2 - 50, height - 100) AS top, least(width // 2 - 32, width - 64) AS "left"
       FROM (SELECT *, row_number() OVER (ORDER BY media_id) - 1 AS n FROM media_files),
            (VALUES (0, 'stripes'), (1, 'noise'), (2, 'checker')) v(p, pattern)""",
    ("media_files",),
)
def work_grid(t):
    grid = media.work_grid(t.media_files, "media_id", _PATTERNS, (100, 64), 42)
    return grid.select("media_id", "pattern", "sample_index", "seed", "top", "left")


@query(
    "prompt_work_list",
    """SELECT doc_id, n AS index, 42 + n AS seed, printf('generated_%04d.png', n) AS output_name
       FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)""",
)
def prompt_work_list(t):
    return media.prompt_work_list(t.documents.select("doc_id"), "doc_id", 42).select(
        "doc_id", "index", "seed", "output_name"
    )


@query(
    "resolve_models",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'blip-base' WHEN 'fr' THEN 'git-base' WHEN 'de' THEN 'vit-gpt2'
                ELSE 'unknown-model' END AS model_name,
              CASE lang WHEN 'en' THEN 'Salesforce/blip-image-captioning-base' WHEN 'fr' THEN 'microsoft/git-base'
                WHEN 'de' THEN 'nlpconnect/vit-gpt2-image-captioning' END AS model_id,
              lang <> 'es' AS known FROM documents""",
)
def resolve_models(t):
    asked = F.when(F.col("lang") == "en", "blip").when(F.col("lang") == "fr", "git").when(
        F.col("lang") == "de", "vit-gpt2"
    ).otherwise("unknown-model")
    rows = t.documents.select("doc_id", asked.alias("model"))
    return media.resolve_models(rows, "model").select("doc_id", "model_name", "model_id", "known")


@query(
    "source_addresses",
    """SELECT doc_id, 'https://reddit.com/r/' || lang || '/top?t=week' AS first,
              'https://reddit.com/r/' || source || '/top?t=week' AS second FROM documents""",
)
def source_addresses(t):
    spec = media.source_spec(F.concat("lang", F.lit(" , "), "source"), "top", "week")
    return t.documents.select("doc_id", spec[0].alias("first"), spec[1].alias("second"))


@query("url_source_dirs", "SELECT page_id, 'url_' || substr(md5(url), 1, 8) AS dir FROM pages")
def url_source_dirs(t):
    return t.pages.select("page_id", media.url_source_dir(F.col("url")).alias("dir"))


@query(
    "annotation_tasks",
    """SELECT '{"data":{"image":"' || path || '"},"predictions":[]}' AS task FROM media_files""",
    ("media_files",),
)
def annotation_tasks(t):
    return media.annotation_tasks(t.media_files).select(F.to_json(F.struct("data", "predictions")).alias("task"))


@query(
    "annotation_import_count",
    f"""SELECT cast(sum(CASE WHEN {_OBJECT} = 'ARRAY' THEN json_array_length(json) ELSE 0 END) AS bigint)
          AS annotations FROM sidecar_json""",
    ("sidecar_json",),
)
def annotation_import_count(t):
    return readers.count_annotations(t.sidecar_json, "json")


@query(
    "prediction_lists",
    """SELECT doc_id, i - 1 AS pos, [lang, source][i] AS prediction FROM documents, (VALUES (1), (2)) v(i)""",
)
def prediction_lists(t):
    values = F.array("lang", "source")
    json = F.when(F.col("lang") == "en", F.to_json(values)).otherwise(F.to_json(F.struct(values.alias("predictions"))))
    parsed = readers.list_items(json, "predictions")
    return t.documents.select("doc_id", F.posexplode(parsed).alias("pos", "prediction"))


@query(
    "media_union",
    f"""SELECT path, 'image' AS source, width, NULL AS caption FROM media_files
          WHERE {SUFFIX} IN {ext_list(px.IMAGE_EXTENSIONS)}
        UNION ALL SELECT stem, 'caption', NULL, md5(caption) FROM captions""",
    ("media_files", "captions"),
)
def media_union(t):
    images = media.select_media(t.media_files, px.IMAGE_EXTENSIONS).select("path", F.lit("image").alias("source"), "width")
    texts = t.captions.select(F.col("stem").alias("path"), F.lit("caption").alias("source"), F.md5("caption").alias("caption"))
    return images.unionByName(texts, allowMissingColumns=True)


@query(
    "caption_files",
    """SELECT 'txt' AS form, stem || '.txt' AS filename, md5(caption) AS content_md5 FROM captions
       UNION ALL SELECT 'jsonl txt', stem || '.txt', md5(caption) FROM captions
       UNION ALL SELECT 'jsonl', stem || '.png', md5(caption) FROM captions
       UNION ALL SELECT 'json', stem || '.caption.json', md5(stem || '.png' || caption || 'null') FROM captions""",
    ("captions",),
)
def caption_files(t):
    """Caption results written in all forms, and read back."""
    results = t.captions.select(
        F.concat("stem", F.lit(".png")).alias("filename"), "caption", F.lit(None).cast("string").alias("error")
    )
    parts = []
    for form in ("txt", "jsonl", "json"):
        path = sinks.captions(results, shared_dir(t.spark, "captions"), form)
        rows = t.spark.read.schema("filename string, content string").parquet(f"{path}/sidecars")
        if form == "json":
            node = F.from_json("content", "filename string, caption string, error string")
            text = F.concat(node["filename"], node["caption"], F.coalesce(node["error"], F.lit("null")))
            rows = rows.withColumn("content", text)
        parts.append(rows.select(F.lit("jsonl txt" if form == "jsonl" else form).alias("form"), "filename", F.md5("content").alias("content_md5")))
        if form == "jsonl":
            lines = readers.json_lines(t.spark, f"{path}/lines", "filename string, caption string, error string")
            parts.append(lines.select(F.lit("jsonl").alias("form"), "filename", F.md5("caption").alias("content_md5")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "replaced_dataset",
    f"SELECT media_id FROM media_files WHERE {SUFFIX} IN {ext_list(px.PAIR_EXTENSIONS)}",
    ("media_files",),
)
def replaced_dataset(t):
    """A data set written twice under one name; the second content stays."""
    path = shared_dir(t.spark, "dataset")
    sinks.replace_dataset(t.media_files.select("media_id"), path)
    sinks.replace_dataset(media.select_media(t.media_files, px.PAIR_EXTENSIONS).select("media_id"), path)
    return t.spark.read.schema("media_id long").parquet(path)

"""Queries over manifests, the model registry, object listings and the paper library."""

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import objects, papers, provenance, registry
from tallyloom.plans.catalog import Tables, query
from tallyloom.session import shared_dir
from tallyloom.sources import sinks

SLUG = "trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_-]', '-', 'g'), '-')"

# -- manifests -----------------------------------------------------------------------------------


@query("slugs", f"SELECT doc_id, md5({SLUG.format('text')}) AS slug_md5 FROM documents")
def slugs(t):
    return t.documents.select("doc_id", F.md5(tx.slug(F.col("text"))).alias("slug_md5"))


@query(
    "manifest_ids",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, 'col-' || strftime(l_shipdate, '%Y%m%d-%H%M%S') || '-'
          || coalesce(nullif({SLUG.format("CASE WHEN l_returnflag = 'R' THEN '--' ELSE l_returnflag END")}, ''),
                      'collection') AS manifest_id FROM lineitem""",
)
def manifest_ids(t):
    name = F.when(F.col("l_returnflag") == "R", "--").otherwise(F.col("l_returnflag"))
    made = provenance.manifest_id("collection", F.col("l_shipdate"), name)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", made.alias("manifest_id"))


def manifest_texts(t: Tables):
    """Manifests as JSON text; those of annotations without a name cannot be read."""
    col = t.collections.select(F.to_json(F.struct("id", "type", "name", "output_dir")).alias("json"))
    ann = t.annotations.select(
        F.when(F.col("name") == "R", F.lit("{bad")).otherwise(F.to_json(F.struct("id", "type", "name"))).alias("json")
    )
    return col.unionByName(ann)


@query(
    "manifests_by_type",
    """SELECT 'collection' AS type, count(*) AS n FROM collections
       UNION ALL SELECT 'annotation', count(*) FILTER (name <> 'R') FROM annotations""",
    ("collections", "annotations"),
)
def manifests_by_type(t):
    parsed = manifest_texts(t).select(F.try_parse_json("json").alias("v")).where(F.col("v").isNotNull())
    return parsed.groupBy(F.try_variant_get("v", "$.type", "string").alias("type")).agg(F.count("*").alias("n"))


@query(
    "manifest_numbers",
    """SELECT stem, k AS key, CASE WHEN json_type(json) = 'ARRAY' THEN cast(json_array_length(json) AS string)
                ELSE json_extract_string(json, '$.' || k) END AS value
       FROM (SELECT stem, json, unnest(CASE WHEN json_type(json) = 'ARRAY' THEN ['samples']
                                            ELSE json_keys(json) END) AS k
             FROM sidecar_json WHERE json_valid(json))""",
    ("sidecar_json",),
)
def manifest_numbers(t):
    readable = t.sidecar_json.where(F.try_parse_json("json").isNotNull())
    pairs = provenance.manifest_numbers(F.col("json"))
    return readable.select("stem", F.inline(pairs)).withColumnRenamed("text", "value")


@query(
    "flat_config",
    """SELECT run_hash, unnest(['train.epochs', 'train.learning_rate', 'lora.rank', 'name']) AS name,
              unnest([cast(epochs AS string), CASE WHEN learning_rate = 0.0001e0 THEN '1.0E-4'
                        WHEN learning_rate = 0.0002e0 THEN '2.0E-4' ELSE '5.0E-4' END,
                      cast(lora_rank AS string), name]) AS value FROM runs""",
    ("runs",),
)
def flat_config(t):
    nested = F.struct(
        F.struct("epochs", "learning_rate").alias("train"),
        F.struct(F.col("lora_rank").alias("rank"), F.array(F.lit(1)).alias("targets")).alias("lora"),
        "name",
    )
    rows = t.runs.select("run_hash", F.to_json(nested).alias("config"))
    return provenance.flatten_config(rows, "run_hash", "config")


_NEAREST = """steps AS (SELECT id, list_aggregate(parts[1:d], 'string_agg', '/') AS p, d
    FROM (SELECT id, parts, unnest(range(1, len(parts) + 1)) AS d
          FROM (SELECT id, string_split(input_dir, '/') AS parts FROM annotations))),
  nearest AS (SELECT s.id, max_by(c.id, s.d) AS nearest_id FROM steps s JOIN collections c ON c.output_dir = s.p
              GROUP BY 1)"""


@query(
    "nearest_collection",
    "SELECT a.id, n.nearest_id AS nearest_collection_id FROM annotations a LEFT JOIN nearest n USING (id)",
    ("collections", "annotations"),
    _NEAREST,
)
def nearest_collection(t):
    found = provenance.nearest_collection(t.annotations, t.collections)
    return found.select("id", "nearest_collection_id")


@query(
    "linked_annotations",
    """SELECT a.id, coalesce(a.parent_collection_id, n.nearest_id) AS collection_id, c.name AS collection_name
       FROM annotations a LEFT JOIN nearest n USING (id)
       LEFT JOIN collections c ON c.id = coalesce(a.parent_collection_id, n.nearest_id)""",
    ("collections", "annotations"),
    _NEAREST,
)
def linked_annotations(t):
    return provenance.link_annotations(t.annotations, t.collections).select("id", "collection_id", "collection_name")


def whole_manifests(t: Tables):
    """Collections and annotations as the rows of their manifests."""
    code = F.struct(F.lit("main").alias("branch"), F.md5("id").alias("commit"), F.lit(False).alias("dirty"))
    day = F.lit("2025-01-31T00:00:00")
    collections = t.collections.select(
        "id", "type", "name", "output_dir", day.alias("created_at"), code.alias("git"),
        F.struct(F.lit("folder").alias("kind"), F.col("output_dir").alias("path")).alias("source"),
        F.struct((F.col("seq") % 97).alias("images"), (F.col("seq") % 7).alias("skipped")).alias("counts"),
        F.struct(F.struct((F.col("seq") % 100).alias("limit"), "name").alias("collect")).alias("config"),
    )
    annotations = t.annotations.select(
        "id", "type", "name", "parent_collection_id", "input_dir", F.concat("input_dir", F.lit("/captions")).alias("output_dir"),
        day.alias("created_at"), code.alias("git"),
        F.struct(F.lit("blip-base").alias("model"), F.col("name").alias("style")).alias("params"),
        F.struct(F.length("id").alias("captioned"), F.lit(0).alias("failed")).alias("counts"),
    )
    return collections, annotations


_GIT = """'{"branch":"main","commit":"' || md5(id) || '","dirty":false}'"""
_MANIFESTS = f"""manifests AS (
    SELECT id, type, name, CAST(NULL AS string) AS parent_collection_id, CAST(NULL AS string) AS input_dir, output_dir,
           '{{"kind":"folder","path":"' || output_dir || '"}}' AS source, CAST(NULL AS string) AS params,
           '{{"images":' || seq % 97 || ',"skipped":' || seq % 7 || '}}' AS counts, {_GIT} AS git,
           '{{"collect":{{"limit":' || seq % 100 || ',"name":"' || name || '"}}}}' AS config FROM collections
    UNION ALL
    SELECT id, type, name, parent_collection_id, input_dir, input_dir || '/captions', NULL,
           '{{"model":"blip-base","style":"' || name || '"}}', '{{"captioned":' || length(id) || ',"failed":0}}', {_GIT}, NULL FROM annotations)"""


@query(
    "manifest_table",
    "SELECT *, '2025-01-31T00:00:00' AS created_at FROM manifests",
    ("collections", "annotations"),
    _MANIFESTS,
)
def manifest_table(t):
    """Whole manifests appended to one table in two steps, and read back."""
    path = shared_dir(t.spark, "manifests")
    for rows in whole_manifests(t):
        sinks.append_manifests(rows, path)
    back = t.spark.read.schema(sinks.MANIFEST).parquet(path)
    return back.withColumns({c: F.to_json(c) for c in sinks.NESTED})


@query(
    "manifest_sidecars",
    """SELECT output_dir || '/collection_manifest.json' AS path, md5('{"id":"' || id || '","type":"collection","name":"' || name
              || '","created_at":"2025-01-31T00:00:00","source":' || source || ',"output_dir":"' || output_dir || '","counts":'
              || counts || ',"git":' || git || ',"config":' || config || '}') AS content_md5 FROM manifests WHERE type = 'collection'
       UNION ALL SELECT output_dir || '/annotation_manifest.json', md5('{"id":"' || id || '","type":"annotation","name":"' || name
              || '","created_at":"2025-01-31T00:00:00","parent_collection_id":' || coalesce('"' || parent_collection_id || '"', 'null')
              || ',"input_dir":"' || input_dir || '","output_dir":"' || output_dir || '","params":' || params || ',"counts":' || counts
              || ',"git":' || git || ',"config":null}') FROM manifests WHERE type = 'annotation'""",
    ("collections", "annotations"),
    _MANIFESTS,
)
def manifest_sidecars(t):
    """The JSON document of every manifest, as it stands beside the data."""
    path, copy = shared_dir(t.spark, "manifests"), shared_dir(t.spark, "sidecars")
    for rows in whole_manifests(t):
        sinks.append_manifests(rows, path, copy)
    back = t.spark.read.schema("path string, content string").parquet(copy)
    return back.select("path", F.md5("content").alias("content_md5"))


@query(
    "web_urls",
    """SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'https://code.example.com/team/' || lower(c_mktsegment)
                ELSE 'https://git.example.org/t/digit' END AS url FROM customer""",
)
def web_urls(t):
    remote = F.when(
        F.col("c_nationkey") % 2 == 0,
        F.concat(F.lit("git@code.example.com:team/"), F.lower("c_mktsegment"), F.lit(".git")),
    ).otherwise(F.lit("https://git.example.org/t/digit.git"))
    return t.customer.select("c_custkey", tx.web_url(remote).alias("url"))


@query(
    "commit_links",
    """SELECT commit_hash, 'https://code.example.com/team/app/commit/' || commit_hash AS commit_url,
              'https://code.example.com/team/app/compare/main...' || commit_hash AS compare_url FROM commits""",
    ("commits",),
)
def commit_links(t):
    base = tx.web_url(F.lit("git@code.example.com:team/app.git"))
    return t.commits.select(
        "commit_hash",
        F.concat(base, F.lit("/commit/"), "commit_hash").alias("commit_url"),
        F.concat(base, F.lit("/compare/main..."), "commit_hash").alias("compare_url"),
    )


_CODE = """coded AS (SELECT run_hash, md5(cast(seq AS string)) AS git_hash,
           CASE WHEN experiment = 'BUILDING' THEN 'abc123' END AS stored_commit FROM runs)"""


@query(
    "code_state",
    """SELECT run_hash, coalesce(stored_commit, c.commit_hash, 'HEAD') AS "commit",
              CASE WHEN stored_commit IS NULL AND c.commit_hash IS NULL THEN 'current state' END AS note
       FROM coded LEFT JOIN commits c ON c.commit_hash = git_hash""",
    ("runs", "commits"),
    _CODE,
)
def code_state(t):
    runs = t.runs.select(
        "run_hash",
        F.md5(F.col("seq").cast("string")).alias("git_hash"),
        F.when(F.col("experiment") == "BUILDING", "abc123").alias("stored_commit"),
    )
    return provenance.code_state(runs, t.commits, "HEAD", "current state").select("run_hash", "commit", "note")


# -- registry ------------------------------------------------------------------------------------

R = ("registry",)


@query("version_numbers", "SELECT name, seq, version FROM registry", R)
def version_numbers(t):
    entries = t.part.select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("seq"))
    return registry.number_versions(entries).select("name", "seq", "version")


@query(
    "model_info",
    """SELECT name, max_by(version, seq) AS latest_version, count(*) AS n_versions, min(seq) AS created_seq,
              max(seq) AS updated_seq FROM registry GROUP BY 1""",
    R,
)
def model_info(t):
    return registry.model_info(t.registry)


@query("version_list", "SELECT name, number, version, stage FROM registry", R)
def version_list(t):
    return t.registry.select("name", "number", "version", "stage")


_REQUESTS = """requests AS (SELECT l_orderkey * 100 + l_linenumber AS request_id,
    CASE WHEN l_linestatus = 'F' THEN 'Brand#' || (l_suppkey % 30) ELSE p_brand END AS name,
    CASE WHEN l_returnflag = 'A' THEN 'latest' ELSE 'v' || cast(l_quantity AS int) END AS version,
    l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(
    "resolved_versions",
    """SELECT q.request_id, q.name, r.version, r.stage FROM requests q
       LEFT JOIN (SELECT name, max_by(version, seq) AS latest FROM registry GROUP BY 1) i USING (name)
       LEFT JOIN registry r ON r.name = q.name
            AND r.version = CASE WHEN q.version = 'latest' THEN i.latest ELSE q.version END""",
    R,
    _REQUESTS,
)
def resolved_versions(t):
    joined = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    requests = joined.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("request_id"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit("Brand#"), F.col("l_suppkey") % 30))
        .otherwise(F.col("p_brand"))
        .alias("name"),
        F.when(F.col("l_returnflag") == "A", "latest")
        .otherwise(F.concat(F.lit("v"), F.col("l_quantity").cast("int")))
        .alias("version"),
    )
    return registry.resolve_version(t.registry, requests)


@query(
    "deleted_versions",
    """SELECT name, max_by(version, seq) AS latest_version, count(*) AS n_versions
       FROM registry WHERE stage <> 'archived' GROUP BY 1""",
    R,
)
def deleted_versions(t):
    left = registry.delete_versions(t.registry, t.registry.where(F.col("stage") == "archived"))
    return registry.model_info(left).select("name", "latest_version", "n_versions")


@query(
    "current_stages",
    """SELECT r.name, r.version, coalesce(e.stage, r.stage) AS stage FROM registry r LEFT JOIN
         (SELECT l_partkey AS seq, max_by(CASE l_returnflag WHEN 'A' THEN 'staging' WHEN 'N' THEN 'production'
                   ELSE 'archived' END, l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey) AS stage
          FROM lineitem GROUP BY 1) e USING (seq)""",
    R,
)
def current_stages(t):
    versions = t.registry
    events = t.lineitem.select(
        F.col("l_partkey").alias("seq"),
        F.when(F.col("l_returnflag") == "A", "staging")
        .when(F.col("l_returnflag") == "N", "production")
        .otherwise("archived")
        .alias("stage"),
        (F.col("l_orderkey") * 100000 + F.col("l_linenumber") * 10000 + F.col("l_suppkey")).alias("at"),
    ).join(versions.select("seq", "name", "version"), "seq")
    return registry.current_stage(versions, events).select("name", "version", "stage")


@query(
    "merged_registry",
    """SELECT name, version, bool_or(l) AS in_local, bool_or(r) AS in_remote FROM
         (SELECT name, version, true AS l, false AS r FROM registry WHERE stage <> 'archived'
          UNION ALL SELECT name, version, false, true FROM registry WHERE size_bytes > 10) GROUP BY ALL""",
    R,
)
def merged_registry(t):
    local = t.registry.where(F.col("stage") != "archived")
    return registry.merge_indexes(local, t.registry.where(F.col("size_bytes") > 10))


@query(
    "runs_with_models",
    """SELECT run_hash, u.name AS run_name, r.name, r.version, r.stage FROM runs u JOIN registry r
       USING (run_hash)""",
    ("runs", "registry"),
)
def runs_with_models(t):
    return registry.runs_with_models(t.runs, t.registry).select("run_hash", "run_name", "name", "version", "stage")


@query(
    "artifact_sizes",
    """SELECT regexp_extract(key, '^datasets/([^/]+)/', 1) AS model, cast(sum(size) AS bigint) AS size_bytes,
              count(*) AS files FROM objects GROUP BY 1""",
    ("objects",),
)
def artifact_sizes(t):
    return registry.artifact_sizes(t.objects, F.regexp_extract("key", "^datasets/([^/]+)/", 1))


def conversation_files(t: Tables):
    """Each conversation as an artifact whose files are its turns."""
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("artifact"),
        F.format_string("%06d", "turn").alias("path"),
        F.col("text").alias("content"),
    )


@query(
    "artifact_checksums",
    """SELECT cast(conv_id AS string) AS artifact,
              substr(sha256(string_agg(text, '' ORDER BY turn)), 1, 16) AS checksum
       FROM conversations GROUP BY 1""",
)
def artifact_checksums(t):
    return registry.artifact_checksums(conversation_files(t))


_BUCKET = """leaf AS (SELECT cast(conv_id AS string) AS artifact, lpad(cast(turn AS string), 6, '0') AS path,
                  md5(lpad(cast(turn AS string), 6, '0')) AS h, sha256(text) AS d FROM conversations),
  l4 AS (SELECT artifact, substr(h, 1, 4) AS h4, sha256(string_agg(d, '' ORDER BY path)) AS d FROM leaf GROUP BY ALL),
  l2 AS (SELECT artifact, substr(h4, 1, 2) AS h2, sha256(string_agg(d, '' ORDER BY h4)) AS d FROM l4 GROUP BY ALL)"""


@query(
    "artifact_tree_checksums",
    "SELECT artifact, substr(sha256(string_agg(d, '' ORDER BY h2)), 1, 16) AS tree_checksum FROM l2 GROUP BY 1",
    (),
    _BUCKET,
)
def artifact_tree_checksums(t):
    return registry.artifact_tree_checksums(conversation_files(t))


@query(
    "image_identifiers",
    """SELECT p_partkey, regexp_full_match(lower(p_name), '[a-z0-9][a-z0-9._/-]{0,127}') AS valid_name,
              regexp_full_match(p_brand, '[A-Za-z0-9_][A-Za-z0-9_.-]{0,127}') AS valid_tag FROM part""",
)
def image_identifiers(t):
    return t.part.select(
        "p_partkey",
        tx.valid_image_part(F.lower("p_name")).alias("valid_name"),
        tx.valid_tag(F.col("p_brand")).alias("valid_tag"),
    )


@query(
    "lineage_chain",
    """SELECT a.id AS annotation_id, coalesce(a.parent_collection_id, n.nearest_id) AS collection_id,
              u.run_hash, r.name AS model, r.version
       FROM annotations a LEFT JOIN nearest n USING (id)
       LEFT JOIN runs u ON u.run_hash = md5(split_part(split_part(a.input_dir, '/p', 2), '/', 1))
       LEFT JOIN registry r ON r.run_hash = u.run_hash""",
    ("collections", "annotations", "runs", "registry"),
    _NEAREST,
)
def lineage_chain(t):
    linked = provenance.link_annotations(t.annotations, t.collections).withColumn(
        "run_hash", F.md5(F.regexp_extract("input_dir", r"/p(\d+)$", 1))
    )
    return provenance.lineage(linked, t.runs, t.registry)


@query(
    "version_ancestors",
    """SELECT c.name, c.version, p.version AS ancestor, c.number - p.number AS hops FROM registry c
       JOIN registry p ON p.name = c.name AND p.number < c.number""",
    R,
)
def version_ancestors(t):
    """Each version follows the one before it; all pairs of a version and one before it."""
    parent = F.when(F.col("number") > 1, F.concat(F.lit("v"), F.col("number") - 1))
    links = t.registry.select("name", "version", "number", parent.alias("parent_version"))
    return provenance.version_ancestors(links, "number")


@query(
    "version_tree",
    """SELECT name, version, parent_version, root, depth, first,
              first + (SELECT count(*) FROM numbered b WHERE b.name = a.name AND starts_with(b.path, a.path)) - 1 AS last
       FROM numbered a""",
    R,
    """steps AS (SELECT name, version, number, unnest(range(0, 63)) AS d FROM registry),
       paths AS (SELECT name, version, number, string_agg(lpad(cast((number + 4) >> d AS string), 9, '0'), '/' ORDER BY d DESC) AS path,
                        min((number + 4) >> d) AS top, count(*) - 1 AS depth
                 FROM steps WHERE (number + 4) >> d > 4 GROUP BY ALL),
       numbered AS (SELECT name, version, CASE WHEN depth > 0 THEN 'v' || ((number + 4 >> 1) - 4) END AS parent_version,
                           'v' || (top - 4) AS root, depth, path, row_number() OVER (PARTITION BY name ORDER BY path) AS first FROM paths)""",
)
def version_tree(t):
    """Versions 1 to 5 are roots; every other one was made from the one of half its number (plus 4)."""
    parent = F.shiftright(F.col("number") + 4, 1) - 4
    links = t.registry.select("name", "version", "number", F.when(parent > 0, F.concat(F.lit("v"), parent)).alias("parent_version"))
    return provenance.version_intervals(links, "number")


# -- objects -------------------------------------------------------------------------------------


@query(
    "object_listing",
    "SELECT key, size FROM objects WHERE starts_with(key, 'datasets/Brand#1')",
    ("objects",),
)
def object_listing(t):
    return objects.list_prefix(t.objects, "datasets/Brand#1").select("key", "size")


@query(
    "prefix_counts",
    "SELECT count(*) AS n FROM objects WHERE starts_with(key, 'datasets/Brand#1')",
    ("objects",),
)
def prefix_counts(t):
    return objects.list_prefix(t.objects, "datasets/Brand#1").agg(F.count("*").alias("n"))


@query(
    "object_lookup",
    """SELECT l.key, r.size, r.size IS NOT NULL AS "exists" FROM objects l LEFT JOIN objects_remote r USING (key)""",
    ("objects", "objects_remote"),
)
def object_lookup(t):
    return objects.look_up(t.objects_remote, t.objects).select("key", "size", "exists")


@query(
    "sync_uploads",
    """SELECT l.key, l.size, CASE WHEN r.key IS NULL THEN 'missing' ELSE 'size differs' END AS cause
       FROM objects l LEFT JOIN objects_remote r USING (key) WHERE r.key IS NULL OR r.size <> l.size""",
    ("objects", "objects_remote"),
)
def sync_uploads(t):
    return objects.to_upload(t.objects, t.objects_remote).select("key", "size", "cause")


@query(
    "sync_deletes",
    "SELECT key, size FROM objects_remote WHERE key NOT IN (SELECT key FROM objects)",
    ("objects", "objects_remote"),
)
def sync_deletes(t):
    return objects.to_delete(t.objects, t.objects_remote).select("key", "size")


@query(
    "key_mapping",
    """SELECT key, 'backup/' || key AS remote_key, '/tmp/data/' || substr(key, 10) AS local_path FROM objects""",
    ("objects",),
)
def key_mapping(t):
    return t.objects.select(
        "key",
        objects.remote_key("backup", F.col("key")).alias("remote_key"),
        objects.local_path("datasets", F.col("key"), "/tmp/data").alias("local_path"),
    )


# -- papers --------------------------------------------------------------------------------------

P = ("papers",)


@query("paper_search", "SELECT id, year FROM papers WHERE contains(lower(title), 'tion')", P)
def paper_search(t):
    return papers.search(t.papers, "TION").select("id", "year")


@query("paper_search_count", "SELECT count(*) AS n FROM papers WHERE contains(lower(title), 'the')", P)
def paper_search_count(t):
    return papers.search(t.papers, "the").agg(F.count("*").alias("n"))


@query(
    "paper_note_names",
    f"SELECT id, year || '-' || substr({SLUG.format('title')}, 1, 50) || '-' || id || '.md' AS filename FROM papers",
    P,
)
def paper_note_names(t):
    return t.papers.select("id", papers.note_name(F.col("year"), F.col("title"), F.col("id")).alias("filename"))


@query(
    "paper_tags",
    """SELECT id, unnest(CAST(CASE WHEN doi = '' THEN 'null' ELSE tags END AS JSON)::VARCHAR[]) AS tag
       FROM papers""",
    P,
)
def paper_tags(t):
    given = F.when(F.col("doi") == "", F.lit("no list")).otherwise(F.col("tags"))
    return t.papers.select("id", F.explode(papers.tag_list(given)).alias("tag"))


@query(
    "paper_notes",
    f"""SELECT year || '-' || substr({SLUG.format('title')}, 1, 50) || '-' || id || '.md' AS filename, md5(
        '---\ntype: paper\ntitle: "' || title || '"\nauthors: "' || authors || '"\nyear: ' || year
        || '\ndoi: "' || doi || '"\nstatus: unread\ntags:\n  - paper\n  - auto-generated\n  - '
        || json_extract_string(tags, '$[0]') || '\n  - ' || json_extract_string(tags, '$[1]')
        || '\n---\n\n# ' || title || '\n\n**Authors:** ' || authors || '\n**Year:** ' || year || '\n'
        || CASE WHEN doi <> '' THEN '**DOI:** [' || doi || '](https://doi.org/' || doi || ')' ELSE '' END
        || '\n\n## Abstract\n\n' || CASE WHEN abstract = '' THEN '{papers.NO_ABSTRACT}' ELSE abstract END || '\n')
        AS content_md5 FROM papers""",
    P,
)
def paper_notes(t):
    return papers.notes(t.papers).select("filename", F.md5("content").alias("content_md5"))


@query(
    "paper_bibtex",
    """SELECT id, md5('@article{paper' || id || ',\n  title = {' || title || '},\n  author = {' || authors
              || '},\n  year = {' || year || '}\n}') AS bibtex_md5 FROM papers""",
    P,
)
def paper_bibtex(t):
    return papers.bibtex(t.papers).select("id", F.md5("bibtex").alias("bibtex_md5"))


@query(
    "paper_markdown",
    "SELECT id, md5('## ' || title || '\n\n' || authors || ' (' || year || ')') AS markdown_md5 FROM papers",
    P,
)
def paper_markdown(t):
    return papers.markdown(t.papers).select("id", F.md5("markdown").alias("markdown_md5"))


@query(
    "paper_year_counts",
    """SELECT coalesce(cast(year AS string), 'all') AS year, count(*) AS n FROM papers GROUP BY ROLLUP (papers.year)""",
    P,
)
def paper_year_counts(t):
    counts = papers.year_counts(t.papers)
    return counts.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("all")))


@query(
    "paper_upserts",
    """SELECT id, year FROM papers WHERE authors NOT IN ('src1', 'src2')
       UNION ALL SELECT id, year + 1 FROM papers WHERE authors IN ('src1', 'src2')
       UNION ALL SELECT 1000000000 + item_id, 2025 FROM benchmark""",
    P,
)
def paper_upserts(t):
    base = t.papers.select("id", "year")
    changed = t.papers.where(F.col("authors").isin("src1", "src2")).select("id", (F.col("year") + 1).alias("year"))
    added = t.benchmark.select((F.col("item_id") + 1000000000).alias("id"), F.lit(2025).alias("year"))
    return papers.upsert(base, changed.unionByName(added))


@query(
    "paper_deletes",
    "SELECT id, year FROM papers WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    P,
)
def paper_deletes(t):
    gone = t.labels.where(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return papers.delete(t.papers.select("id", "year"), gone)

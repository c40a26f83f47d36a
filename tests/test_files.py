import hashlib
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import paths as px
from tallyloom.functions import text as tx
from tallyloom.operators import landing, media, papers, provenance, registry, sampling, scoring
from tallyloom.session import shared_dir
from tallyloom.sources import readers, sinks


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in {
        "a.JPG": b"1234", "b.png": b"12", ".hidden.jpg": b"1", "c.txt": b"  a caption \n", "sub/d.webp": b"123",
        "a.json": b'{"title": "T", "score": 7}', "bad.json": b"{oops", "sub/list.json": b'["x", "y"]',
    }.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_media_folder(spark, folder):
    found = readers.media_folder(spark, folder, px.IMAGE_EXTENSIONS)
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in found.collect()} == {
        "a.JPG": 4, "b.png": 2, ".hidden.jpg": 1, "d.webp": 3,
    } or found.count() == 3  # some file systems hide dot files
    assert readers.media_folder(spark, folder, (".webp",), recursive=False).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0]


def test_sidecars(spark, folder):
    captions = {r["stem"]: r["caption"] for r in readers.caption_sidecars(spark, folder).collect()}
    assert captions["c"].strip() == "a caption"
    sidecars = readers.json_sidecars(spark, folder)
    assert sidecars.where(F.col("value").isNull()).select("stem").collect()[0][0] == "bad"
    fields = sidecars.where("stem = 'a'").select(*[c.alias(n) for n, c in media.sidecar_fields(F.col("json")).items()]).first()
    assert (fields["title"], fields["author"], fields["score"]) == ("T", "", 7)


def test_sidecars_of_two_folders(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.png").write_bytes(b"1")
        (tmp_path / name / "x.txt").write_text(f"caption {name}")
    (tmp_path / "two" / "x.json").write_text('{"title": "T"}')
    files = readers.media_folder(spark, str(tmp_path), px.IMAGE_EXTENSIONS)
    captions = readers.caption_sidecars(spark, str(tmp_path))
    samples = media.visual_samples(files, captions, readers.json_sidecars(spark, str(tmp_path)))
    got = {r["source_dir"]: (r["caption"], r["title"]) for r in samples.collect()}
    assert got == {"one": ("caption one", None), "two": ("caption two", "T")}
    assert media.training_pairs(files, captions).count() == 2


def test_object_folder(spark, folder):
    keys = {r["key"]: r["size"] for r in readers.object_folder(spark, folder).collect()}
    assert keys["sub/d.webp"] == 3


def test_text_lists(spark, tmp_path):
    (tmp_path / "bare").mkdir()
    (tmp_path / "keyed").mkdir()
    (tmp_path / "bare" / "r.json").write_text(json.dumps(["a", "é"]))
    (tmp_path / "keyed" / "p.json").write_text(json.dumps({"predictions": ["x", "y", "z"]}))
    bare = readers.text_list(spark, str(tmp_path / "bare"), "references").orderBy("pos").collect()
    assert [tuple(r) for r in bare] == [(0, "a"), (1, "é")]
    assert readers.text_list(spark, str(tmp_path / "keyed"), "predictions").count() == 3
    assert readers.annotation_count(spark, str(tmp_path / "bare")).first()["annotations"] == 2


def test_manifest_files_and_nearest(spark, tmp_path):
    for name, body in {
        "one": {"id": "col-1", "type": "collection", "name": "n", "output_dir": "/d"},
        "two": {"id": "col-2", "type": "collection", "name": "n", "output_dir": "/d/x"},
    }.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    (tmp_path / "broken.json").write_text("{")
    found = readers.manifests(spark, str(tmp_path)).withColumn("seq", F.lit(1))
    assert found.count() == 2
    schema = "id string, name string, output_dir string, seq int"
    nullid = spark.createDataFrame([(None, None, "/d/x/null", 1)], schema)
    homes = found.select("id", "name", "output_dir", "seq").unionByName(nullid)
    ann = spark.createDataFrame(
        [("a", "/d/x/y/z"), ("b", "/d/w"), ("c", "/other"), ("d", "/d/x"), ("e", "/d/x/null/deep"), ("f", "/")],
        "id string, input_dir string",
    )
    got = {r["id"]: r["nearest_collection_id"] for r in provenance.nearest_collection(ann, homes).collect()}
    assert got == {"a": "col-2", "b": "col-1", "c": None, "d": "col-2", "e": None, "f": None}


def test_flat_config(spark):
    df = spark.createDataFrame([("r", '{"a": {"b": 1, "c": {"d": "x"}}, "e": [1], "f": null, "g": true}')], "k string, j string")
    got = {r["name"]: r["value"] for r in provenance.flatten_config(df, "k", "j", 3).collect()}
    assert got == {"a.b": "1", "a.c.d": "x", "g": "true"}
    with pytest.raises(Exception, match="deeper"):
        provenance.flatten_config(df, "k", "j", 2).collect()


def test_json_lines_keep_nulls_and_scripts(spark):
    df = spark.createDataFrame([(1, "é 漢字", None)], "id int, text string, label string")
    path = sinks.json_lines(df, shared_dir(spark, "t"))
    line = spark.read.text(path).first()[0]
    assert json.loads(line) == {"id": 1, "text": "é 漢字", "label": None} and "漢字" in line


def test_notes_are_not_replaced(spark):
    path = shared_dir(spark, "t")
    schema = "filename string, content string"
    sinks.notes(spark.createDataFrame([("a.md", "old")], schema), path)
    sinks.notes(spark.createDataFrame([("a.md", "new"), ("b.md", "b")], schema), path)
    assert {r["filename"]: r["content"] for r in spark.read.parquet(path).collect()} == {"a.md": "old", "b.md": "b"}


def test_checksums(spark):
    rows = [(f"m{i % 3}", f"p{j:03}", f"c{i}-{j}".encode()) for i in range(3) for j in range(50)]
    df = spark.createDataFrame(rows, "artifact string, path string, content binary").repartition(4)
    got = {r["artifact"]: r["checksum"] for r in registry.artifact_checksums(df).collect()}
    for a in ("m0", "m1", "m2"):
        body = b"".join(c for n, p, c in sorted(rows) if n == a)
        assert got[a] == hashlib.sha256(body).hexdigest()[:16]
    tree = {r["artifact"]: r["tree_checksum"] for r in registry.artifact_tree_checksums(df).collect()}
    again = {r["artifact"]: r["tree_checksum"] for r in registry.artifact_tree_checksums(df.repartition(7)).collect()}
    assert tree == again and len(set(tree.values())) == 3


def test_explicit_versions_count(spark):
    df = spark.createDataFrame([("m", 1, None), ("m", 2, "beta"), ("m", 3, None)], "name string, seq long, version string")
    got = {r["seq"]: r["version"] for r in registry.number_versions(df).collect()}
    assert got == {1: "v1", 2: "beta", 3: "v3"}


def test_landing_numbers_missing_texts(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"t{i}") for i in range(20, 30)], "k long, text string")
    got = [(r["id"], r["k"]) for r in landing.land_text(df, "k", limit=5).orderBy("id").collect()]
    assert got == [(0, 20), (2, 22), (3, 23)]
    assert landing.land_text(df, "k", limit=-1).count() == 7
    assert landing.land_media(df, "k", "text", 5).count() == 5
    assert landing.land_media(df, "k", "text", -1).count() == 7


def test_truthiness(spark):
    df = spark.createDataFrame(
        [(0, "", False, [], {}), (2, "x", True, ["a"], {"k": "v"}), (None, None, None, None, None)],
        "i int, s string, b boolean, a array<string>, m map<string,string>",
    )
    cols = [tx.yes_no(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    assert [tuple(r) for r in df.select(*cols).collect()] == [("NO",) * 5, ("YES",) * 5, ("NO",) * 5]


def test_empty_collection_is_an_error(spark):
    empty = spark.createDataFrame([], "id long, text string, text_length long, quality int")
    with pytest.raises(Exception, match="no samples"):
        landing.collection_stats(empty).collect()


@pytest.mark.parametrize("given,slug", [("Ab c", "ab-c"), ("--x--", "x"), ("é_1!", "é_1"), ("!!", ""), ("a  b", "a--b")])
def test_slug(spark, given, slug):
    assert spark.createDataFrame([(given,)], "t string").select(tx.slug(F.col("t"))).first()[0] == slug


def test_urls_and_durations(spark):
    urls = {
        "git@host.org:u/repo.git": "https://host.org/u/repo", "https://host.org/u/digit.git": "https://host.org/u/digit",
        "https://host.org/u/r": "https://host.org/u/r",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r[0]: r[1] for r in df.select("u", tx.web_url(F.col("u"))).collect()} == urls
    times = spark.createDataFrame([("7d",), ("24H",), ("30m",)], "t string")
    assert [r[0] for r in times.select(tx.duration_seconds(F.col("t"))).collect()] == [604800, 86400, 1800]
    with pytest.raises(Exception, match="unknown duration"):
        spark.createDataFrame([("5w",)], "t string").select(tx.duration_seconds(F.col("t"))).collect()


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/.x",), ("/a/b/c.tar.gz",), ("/a/noext",), ("/a/.h.jpg",)], "path string")
    p = F.col("path")
    bases = [r[0] for r in df.select(px.base(p)).collect()]
    assert bases == ["/a/b/.x", "/a/b/c.tar", "/a/noext", "/a/.h"]
    got = [tuple(r) for r in df.select(px.stem(p), px.suffix(p), px.parent_name(p), px.is_hidden(p)).collect()]
    assert got == [(".x", "", "b", True), ("c.tar", ".gz", "b", False), ("noext", "", "a", False), (".h", ".jpg", "a", True)]


def test_windows_cover_the_text(spark):
    texts = ["", "a" * 5, "b" * 10, "c" * 11, "d" * 28]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = sampling.text_windows(df, "t", 10, 3).orderBy("i", "window").collect()
    for i, text in enumerate(texts):
        parts = [r["window_text"] for r in rows if r["i"] == i]
        assert "".join([parts[0], *[q[3:] for q in parts[1:]]]) == text and all(len(q) <= 10 for q in parts)
    with pytest.raises(ValueError):
        sampling.text_windows(df, "t", 3, 3)


def test_sample_ignores_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one = {r["k"] for r in sampling.shuffled_sample(df.repartition(1), "k", 50).collect()}
    assert one == {r["k"] for r in sampling.shuffled_sample(df.repartition(9), "k", 50).collect()}


def test_upsert_and_tags(spark):
    base = spark.createDataFrame([(1, 2000), (2, 2001)], "id int, year int")
    got = papers.upsert(base, spark.createDataFrame([(2, 1999), (3, 2003)], "id int, year int"))
    assert sorted(map(tuple, got.collect())) == [(1, 2000), (2, 1999), (3, 2003)]
    tags = spark.createDataFrame([('["a"]',), ("oops",), (None,)], "t string")
    assert [list(r[0]) for r in tags.select(papers.tag_list(F.col("t"))).collect()] == [["a"], [], []]


def test_bad_row_gives_an_error_row(spark):
    def load():
        return lambda items: [10 // int(n) for n in items]

    df = spark.createDataFrame([(1, "5"), (2, "0"), (3, "x")], "id long, v string")
    got = {r["id"]: (r["result"], r["error"] is None) for r in scoring.score_rows(df, "id", "v", load).collect()}
    assert got == {1: ("2", True), 2: (None, False), 3: (None, False)}


def test_bad_rows_are_found_by_halving():
    calls = []

    def model(items):
        calls.append(len(items))
        if any(i % 500 == 7 for i in items):
            raise ValueError("bad row")
        return [i + 1 for i in items]

    got = scoring.halved(model, list(range(1024)))
    assert got == [(None, "bad row") if i % 500 == 7 else (str(i + 1), None) for i in range(1024)]
    assert calls[0] == 1024 and len(calls) < 3 * 2 * 11
    assert scoring.halved(lambda items: items[:-1], [1, 2]) == [(None, "0 results for 1 rows")] * 2


def test_answers_stop_after_the_decision(spark):
    def load():
        def answer(contract, category, turn):
            if contract == 9:
                raise RuntimeError("down")
            return "Yes this contract holds the wanted clause in part four of it"

        return answer

    tasks = spark.createDataFrame([(1, "a"), (9, "a")], "contract_id long, clause_category string")
    log, states = scoring.answer_until_decided(tasks, load, shared_dir(spark, "t"), k=2, block=3)
    assert log.where("contract_id = 1").count() == 3 and log.where("contract_id = 9").count() == 3
    assert {r["contract_id"]: (r["state"], r["yes"]) for r in states.collect()} == {1: ("decided", 2), 9: ("broken", 0)}


def test_answers_that_never_vote_end(spark):
    def load():
        return lambda contract, category, turn: "Maybe." if contract == 1 or turn < 9 else "Yes" + " and no" * (turn % 2) + " the clause is in the second part of it"

    tasks = spark.createDataFrame([(1, "a"), (2, "a")], "contract_id long, clause_category string")
    log, states = scoring.answer_until_decided(tasks, load, shared_dir(spark, "t"), k=3, max_votes=5, block=4, max_asked=12)
    assert {r["contract_id"]: (r["state"], r["yes"], r["asked"]) for r in states.collect()} == {1: ("no valid answer", 0, 12), 2: ("out of votes", 2, 12)}
    assert log.count() == 24


def test_shared_dir_follows_the_session():
    class Fake:
        def __init__(self, base, master):
            self.conf = {"spark.checkpoint.dir": base}
            self.sparkContext = SimpleNamespace(master=master)

    assert shared_dir(Fake("hdfs://x/shared/", "yarn"), "x").startswith("hdfs://x/shared/x-")
    assert "/x-" in shared_dir(Fake(None, "local[2]"), "x")
    with pytest.raises(ValueError):
        shared_dir(Fake(None, "yarn"), "x")


def test_sidecar_texts_need_no_variants(spark):
    """Structs of plain values are written as they are, with the text that their variants have; others by variants."""
    rows = spark.range(3).select(
        F.col("id").cast("string").alias("id"), F.lit("annotation").alias("type"), F.lit('a"\u00e9\n/\U0001f600').alias("name"),
        F.struct(F.lit("x").alias("zeta"), F.when(F.col("id") > 0, F.col("id")).alias("Alpha"),
                 F.when(F.col("id") > 1, F.struct(F.lit(True).alias("b"), F.lit("\u2028\\").alias("a"))).alias("mid")).alias("git"),
        F.when(F.col("id") > 0, F.struct(F.lit(2).alias("k"), F.lit(None).cast("string").alias("j"))).alias("params"),
        F.struct((F.col("id") / 3).alias("share"), F.array(F.lit(1)).alias("list")).alias("counts"),
    )
    text = sinks.manifest_text("annotation").alias("t")
    got, want = (sinks.manifests(rows, text_only=only).select(text) for only in (True, False))
    kinds = dict(sinks.manifests(rows, text_only=True).dtypes)
    assert kinds["git"].startswith("struct") and kinds["params"].startswith("struct") and kinds["counts"] == "variant"
    assert sorted(r.t for r in got.collect()) == sorted(r.t for r in want.collect())

"""Queries that score texts, classes, timings, data quality and embeddings."""

import hashlib

from pyspark.sql import functions as F

from tallyloom.operators import classify, landing, overlap, quality, review, scoring, similarity, timing, voting
from tallyloom.plans.catalog import Tables, query, r6
from tallyloom.plans.oracle_parts import NOT_BLANK, TASKS, vote_ctes
from tallyloom.plans.voting import judged, judged_ctes, reviewed_tasks
from tallyloom.session import shared_dir
from tallyloom.sources import readers, sinks

PR = ("pred_ref",)

# -- texts against references --------------------------------------------------------------------


@query(
    "aligned_pairs",
    """SELECT doc_id AS pos, length(d.text) AS prediction_chars, length(b.text) AS reference_chars,
              (SELECT count(*) FROM documents) AS "count"
       FROM documents d JOIN benchmark b ON b.item_id = d.doc_id""",
)
def aligned_pairs(t):
    predictions = t.documents.select(F.col("doc_id").alias("pos"), F.col("text").alias("prediction"))
    references = t.benchmark.select(F.col("item_id").alias("pos"), F.col("text").alias("reference"))
    count = predictions.agg(F.count("*")).scalar()
    return overlap.align(predictions, references).select(
        "pos",
        F.char_length("prediction").alias("prediction_chars"),
        F.char_length("reference").alias("reference_chars"),
        count.alias("count"),
    )


def _grams(n: int) -> str:
    shifted = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, n))
    gram = "w" if n == 1 else f"concat_ws(' ', w, {shifted})"
    last = "w" if n == 1 else f"lead(w, {n - 1}) OVER o"
    return f"""SELECT pos, side, {n} AS n, gram, count(*) AS c FROM (SELECT pos, side, {gram} AS gram, {last} AS z
        FROM toks WINDOW o AS (PARTITION BY pos, side ORDER BY i)) WHERE z IS NOT NULL GROUP BY ALL"""


def _overlap_ctes(tokens: str, max_n: int) -> str:
    """Token, n-gram and clipped overlap tables for both sides of pred_ref."""
    return f"""toks AS (SELECT pos, side, unnest(t) AS w, unnest(range(len(t))) AS i FROM (
      SELECT pos, 'p' AS side, {tokens.replace("TEXT", "prediction")} AS t FROM pred_ref
      UNION ALL SELECT pos, 'r', {tokens.replace("TEXT", "reference")} FROM pred_ref)),
    grams AS ({" UNION ALL ".join(_grams(n) for n in range(1, max_n + 1))}),
    shared AS (SELECT pos, n, sum(least(a.c, b.c)) AS o FROM grams a JOIN grams b USING (pos, n, gram)
               WHERE a.side = 'p' AND b.side = 'r' GROUP BY ALL),
    sizes AS (SELECT pos, n, coalesce(sum(c) FILTER (side = 'p'), 0) AS p,
                     coalesce(sum(c) FILTER (side = 'r'), 0) AS r FROM grams GROUP BY ALL),
    counted AS (SELECT pos, n, p, r, coalesce(o, 0) AS o FROM sizes LEFT JOIN shared USING (pos, n))"""


_BLEU_TOKENS = f"regexp_extract_all(lower(TEXT), '{NOT_BLANK}')"
_ROUGE_TOKENS = "regexp_extract_all(lower(TEXT), '[a-z0-9]+')"


def _at(n: int, col: str) -> str:
    return f"coalesce(max({col}) FILTER (n = {n}), 0)"


_BLEU_CTES = (
    _overlap_ctes(_BLEU_TOKENS, 4)
    + f""", bleu AS (SELECT pos, CASE WHEN {_at(1, "o")} = 0 THEN 0 ELSE
      CASE WHEN {_at(1, "p")} > {_at(1, "r")} THEN 1 ELSE exp(1 - {_at(1, "r")} / {_at(1, "p")}) END
      * exp({" + ".join(f"ln(CASE WHEN {_at(n, 'o')} = 0 THEN 0.1e0 ELSE {_at(n, 'o')} END / greatest({_at(n, 'p')}, 1)) / 4" for n in range(1, 5))})
      END AS bleu FROM counted GROUP BY 1)"""
)


@query(
    "ngram_overlaps",
    """SELECT pos, n, cast(coalesce(p, 0) AS bigint) AS p, cast(coalesce(r, 0) AS bigint) AS r,
              cast(coalesce(o, 0) AS bigint) AS overlap
       FROM (SELECT pos, n FROM pred_ref, (VALUES (1), (2), (3), (4)) v(n)) LEFT JOIN counted USING (pos, n)""",
    PR,
    _overlap_ctes(_BLEU_TOKENS, 4),
)
def ngram_overlaps(t):
    tokens = t.pred_ref.select(
        "pos",
        overlap.bleu_tokens(F.col("prediction")).alias("p"),
        overlap.bleu_tokens(F.col("reference")).alias("r"),
    )
    return overlap.ngram_overlap(tokens, 4)


@query("bleu_scores", "SELECT pos, round(bleu, 6) AS bleu FROM bleu", PR, _BLEU_CTES)
def bleu_scores(t):
    return r6(overlap.bleu_scores(t.pred_ref))


@query(
    "bleu_summary",
    """SELECT round(avg(bleu), 6) AS bleu_mean, round(stddev_pop(bleu), 6) AS bleu_std,
              round(min(bleu), 6) AS bleu_min, round(max(bleu), 6) AS bleu_max FROM bleu""",
    PR,
    _BLEU_CTES,
)
def bleu_summary(t):
    return r6(overlap.bleu(t.pred_ref))


def _f(n: int) -> str:
    p, r, o = (_at(n, c) for c in ("p", "r", "o"))
    return f"round(CASE WHEN {o} > 0 THEN 2 * ({o} / {p}) * ({o} / {r}) / ({o} / {p} + {o} / {r}) ELSE 0 END, 6)"


@query(
    "rouge_unstemmed",
    f"SELECT pos, {_f(1)} AS rouge1, {_f(2)} AS rouge2 FROM pred_ref LEFT JOIN counted USING (pos) GROUP BY 1",
    PR,
    _overlap_ctes(_ROUGE_TOKENS, 2),
)
def rouge_unstemmed(t):
    return r6(overlap.rouge_scores(t.pred_ref, stemmed=False, longest=False))


@query("word_stems")
def word_stems(t):
    """The words of the references with the stems that the scores count."""
    return overlap.word_stems(t.pred_ref, "reference")


@query("rouge_scores")
def rouge_scores(t):
    return r6(overlap.rouge_scores(t.pred_ref))


@query("rouge_summary")
def rouge_summary(t):
    return r6(overlap.rouge(t.pred_ref))


@query("caption_metrics")
def caption_metrics(t):
    return r6(overlap.caption_metrics(t.pred_ref, t.pred_ref))


@query(
    "metrics_report_file",
    """SELECT 'captioner' AS model, round(avg(bleu), 6) AS bleu_mean, round(stddev_pop(bleu), 6) AS bleu_std,
              round(min(bleu), 6) AS bleu_min, round(max(bleu), 6) AS bleu_max FROM bleu""",
    PR,
    _BLEU_CTES,
)
def metrics_report_file(t):
    """The text scores written as one JSON report and read back."""
    scores = overlap.bleu(t.pred_ref).select(F.lit("captioner").alias("model"), F.struct("*").alias("metrics"))
    path = sinks.json_lines(scores, shared_dir(t.spark, "report"))
    schema = "model string, metrics struct<bleu_mean:double,bleu_std:double,bleu_min:double,bleu_max:double>"
    return r6(readers.json_lines(t.spark, path, schema).select("model", "metrics.*"))


# -- classification ------------------------------------------------------------------------------

V = ("verdicts",)
_CLASS = """lab AS (SELECT truth AS label FROM verdicts UNION SELECT predicted FROM verdicts),
  sums AS (SELECT label, (SELECT count(*) FROM verdicts WHERE truth = label AND predicted = label) AS tp,
    (SELECT count(*) FROM verdicts WHERE truth = label) AS support,
    (SELECT count(*) FROM verdicts WHERE predicted = label) AS said FROM lab),
  cls AS (SELECT *, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
    coalesce(2 * tp / nullif(said + support, 0), 0) AS f1 FROM sums)"""


@query(
    "classification_summary",
    """SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
              round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM cls""",
    V,
    _CLASS,
)
def classification_summary(t):
    return r6(classify.summary(t.verdicts))


@query(
    "confusion_pairs",
    """SELECT *, cast(sum(n) OVER (PARTITION BY truth) AS bigint) AS truth_total,
              cast(sum(n) OVER (PARTITION BY predicted) AS bigint) AS predicted_total
       FROM (SELECT truth, predicted, count(*) AS n FROM verdicts GROUP BY ALL)""",
    V,
)
def confusion_pairs(t):
    return classify.confusion_pairs(t.verdicts)


@query(
    "confusion_matrix",
    """SELECT a.label AS truth, b.label AS predicted,
              (SELECT count(*) FROM verdicts WHERE truth = a.label AND predicted = b.label) AS n
       FROM lab a, lab b""",
    V,
    _CLASS,
)
def confusion_matrix(t):
    return classify.confusion_matrix(t.verdicts)


@query(
    "classification_report",
    """SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
              support FROM cls
       UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
              cast(sum(support) AS bigint) FROM cls
       UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
              round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
              cast(sum(support) AS bigint) FROM cls
       UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6),
              round(sum(tp) / sum(support), 6), cast(sum(support) AS bigint) FROM cls""",
    V,
    _CLASS,
)
def classification_report(t):
    return r6(classify.report(t.verdicts))


@query(
    "class_distribution",
    """SELECT o_orderpriority, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 6) AS percent
       FROM orders GROUP BY 1""",
)
def class_distribution(t):
    return r6(classify.class_distribution(t.orders, "o_orderpriority"))


@query(
    "roc_auc",
    """SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc,
              cast(sum(pos) AS bigint) AS positives, cast(sum(neg) AS bigint) AS negatives
       FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS below
             FROM (SELECT l_discount * l_quantity AS s, count(*) FILTER (l_returnflag = 'A') AS pos,
                          count(*) FILTER (l_returnflag <> 'A') AS neg FROM lineitem GROUP BY 1))""",
)
def roc_auc(t):
    scored = t.lineitem.select(
        (F.col("l_returnflag") == "A").alias("hit"), (F.col("l_discount") * F.col("l_quantity")).alias("score")
    )
    return r6(classify.roc_auc(scored, "hit", "score"))


# -- timings and distributions -------------------------------------------------------------------


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, round(min(value), 6) AS min,
              round(max(value), 6) AS max,
              round(list_sort(list(value))[cast(floor(count(*) * 0.5e0) AS int) + 1], 6) AS p50,
              round(list_sort(list(value))[cast(floor(count(*) * 0.95e0) AS int) + 1], 6) AS p95,
              round(list_sort(list(value))[cast(floor(count(*) * 0.99e0) AS int) + 1], 6) AS p99
       FROM events GROUP BY 1""",
)
def latency_percentiles(t):
    return r6(timing.latency(t.events, ["event_type"], "value"))


@query(
    "throughput",
    """SELECT event_type, samples, round(elapsed, 6) AS elapsed, round(samples / elapsed, 6) AS throughput FROM (
         SELECT event_type, count(*) AS samples,
                (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed
         FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events)
         WHERE nth > 10 GROUP BY 1)""",
)
def throughput(t):
    log = t.events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return r6(timing.throughput(log, ["event_type"], "event_id", "ts"))


_DESCRIBE = """count({0}) AS n, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std,
    round(min({0}), 6) AS min, round(quantile_cont({0}, 0.25), 6) AS p25, round(quantile_cont({0}, 0.5), 6) AS p50,
    round(quantile_cont({0}, 0.75), 6) AS p75, round(max({0}), 6) AS max"""


@query(
    "describe_sizes",
    f"SELECT {_DESCRIBE.format('cast(length AS double)')} FROM media_files",
    ("media_files",),
)
def describe_sizes(t):
    return r6(timing.describe(t.media_files.select(F.col("length").cast("double").alias("v")), [], "v"))


@query(
    "describe_prices",
    f"SELECT o_orderpriority, {_DESCRIBE.format('o_totalprice')} FROM orders GROUP BY 1",
)
def describe_prices(t):
    return r6(timing.describe(t.orders, ["o_orderpriority"], "o_totalprice"))


@query(
    "value_histogram",
    """SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_low, coalesce(n, 0) AS n
       FROM (SELECT unnest(range(20))::int AS bin, lo, hi FROM (SELECT min(value) AS lo, max(value) AS hi FROM events))
       LEFT JOIN (SELECT least(floor((value - lo) / (hi - lo) * 20), 19)::int AS bin, count(*) AS n
                  FROM events, (SELECT min(value) AS lo, max(value) AS hi FROM events) GROUP BY 1) USING (bin)""",
)
def value_histogram(t):
    return r6(timing.histogram(t.events, "value"))


@query(
    "logged_distributions",
    """SELECT vec_id, least(floor((v - lo) / (hi - lo) * 20), 19)::int AS bin, count(*) AS n
       FROM (SELECT vec_id, unnest(embedding)::double AS v, list_min(embedding)::double AS lo,
                    list_max(embedding)::double AS hi FROM embeddings) GROUP BY ALL""",
)
def logged_distributions(t):
    return timing.logged_distribution(t.embeddings, ["vec_id"], "embedding")


@query(
    "availability",
    """SELECT event_type AS category, count(*) FILTER (value < 100) AS healthy, count(*) AS total FROM events
       GROUP BY 1""",
)
def availability(t):
    return timing.availability(t.events.withColumnRenamed("event_type", "category"), "category", F.col("value") < 100)


@query("dataset_catalogue", "SELECT source, count(*) AS samples FROM documents GROUP BY 1")
def dataset_catalogue(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("samples"))


@query(
    "dataset_cards",
    """SELECT source, md5('# Dataset: ' || source || '\n\n**Samples:** ' || count(*)
              || '\n\n## Fields\n\n- `doc_id`\n- `text`\n- `lang`\n- `source`\n- `n_chars`') AS card_md5
       FROM documents GROUP BY 1""",
)
def dataset_cards(t):
    return landing.dataset_cards(t.documents, "source").select("source", F.md5("content").alias("card_md5"))


# -- quality -------------------------------------------------------------------------------------

_SUITE = (
    (quality.COLUMN_EXISTS, "id"),
    (quality.NOT_NULL, "id"),
    (quality.NOT_NULL, "quality"),
    (quality.COLUMN_EXISTS, "missing"),
    (quality.NOT_NULL, "missing"),
)


@query(
    "expectation_results",
    """SELECT 'contract_suite' AS suite, e.expectation, e."column", e.bad AS unexpected,
              round(e.bad / (SELECT count(*) FROM contracts), 6) AS fraction, e.bad = 0 AS passed
       FROM (SELECT 'expect_column_to_exist' AS expectation, 'id' AS "column", 0 AS bad
             UNION ALL SELECT 'expect_column_values_to_not_be_null', 'id', count(*) FILTER (id IS NULL) FROM contracts
             UNION ALL SELECT 'expect_column_values_to_not_be_null', 'quality',
                              count(*) FILTER (quality IS NULL) FROM contracts
             UNION ALL SELECT 'expect_column_to_exist', 'missing', count(*) FROM contracts
             UNION ALL SELECT 'expect_column_values_to_not_be_null', 'missing', count(*) FROM contracts) e""",
    ("contracts",),
)
def expectation_results(t):
    return r6(quality.run_suite(t.contracts, "contract_suite", _SUITE))


@query(
    "duplicate_texts",
    "SELECT md5(text) AS content_hash, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_texts(t):
    return quality.duplicate_groups(t.documents, F.col("text"))


@query(
    "curation_checks",
    """SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR trim(text, ' ') = '' OR contains(text, chr(65533)))
                AS corrupted,
              (SELECT cast(coalesce(sum(n - 1), 0) AS bigint) FROM (SELECT count(*) AS n FROM documents GROUP BY md5(text)))
                AS duplicates,
              (SELECT round(min(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM documents GROUP BY lang))
                AS smallest_share,
              (SELECT min(n) / sum(n) FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) >= 0.1 AS balanced
       FROM documents""",
)
def curation_checks(t):
    return r6(quality.curation_checks(t.documents, "text", "lang", 0.1))


# -- embeddings ----------------------------------------------------------------------------------


def label_prompts(t: Tables) -> list[tuple]:
    """One prompt vector per label: its first embedding.  There are as many as classes."""
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    return similarity.prompt_list(first, "label", "vector")


_SIMS = """prompts AS (SELECT label AS prompt, min_by(embedding, vec_id)::double[] AS p FROM embeddings GROUP BY 1),
  sims AS (SELECT vec_id, label, prompt, list_inner_product(e, p) / sqrt(list_inner_product(e, e))
             / sqrt(list_inner_product(p, p)) AS cos
           FROM (SELECT vec_id, label, embedding::double[] AS e FROM embeddings), prompts),
  probs AS (SELECT vec_id, label, prompt, exp(100 * (cos - max(cos) OVER w)) / sum(exp(100 * (cos - m))) OVER w AS p
            FROM (SELECT *, max(cos) OVER (PARTITION BY vec_id) AS m FROM sims) WINDOW w AS (PARTITION BY vec_id))"""


@query(
    "normalised_vectors",
    """SELECT vec_id, i - 1 AS dim, round(e[i] / sqrt(list_inner_product(e, e)), 6) AS x
       FROM (SELECT vec_id, embedding::double[] AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def normalised_vectors(t):
    unit = similarity.l2_normalise(F.col("embedding"))
    return r6(t.embeddings.select("vec_id", F.posexplode(unit).alias("dim", "x")))


@query("prompt_similarities", "SELECT vec_id, prompt, round(100 * cos, 6) AS similarity FROM sims", (), _SIMS)
def prompt_similarities(t):
    return r6(similarity.similarities(t.embeddings.drop("label"), "embedding", label_prompts(t)))


@query(
    "best_prompts",
    "SELECT vec_id, arg_max(prompt, cos) AS prompt, round(max(cos), 6) AS cosine FROM sims GROUP BY 1",
    (),
    _SIMS,
)
def best_prompts(t):
    return r6(similarity.best_prompt(t.embeddings.drop("label"), "embedding", label_prompts(t)))


@query(
    "best_of_many_prompts",
    """WITH unit AS (SELECT vec_id, list_transform(embedding, lambda x: x / sqrt(list_sum(list_transform(embedding, lambda y: y * y)))) AS u FROM embeddings)
       SELECT a.vec_id, round(max(list_dot_product(a.u, b.u)), 6) AS cosine FROM unit a, unit b WHERE b.vec_id % 100 = 0 GROUP BY 1""",
)
def best_of_many_prompts(t):
    """Every hundredth embedding as a prompt, in blocks; the names of equally close prompts are not compared."""
    rows = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    prompts = rows.where(F.col("vec_id") % 100 == 0)
    return r6(similarity.best_of_many(rows, "vec_id", "v", prompts, "vec_id", "v").select("vec_id", "cosine"))


@query(
    "style_score",
    """SELECT round(-100 * avg(c), 6) AS style_loss, round(greatest(0, least(1, (avg(c) + 1) / 2)), 6) AS style_score
       FROM (SELECT max(cos) AS c FROM sims GROUP BY vec_id)""",
    (),
    _SIMS,
)
def style_score(t):
    return r6(similarity.style_score(t.embeddings, "embedding", label_prompts(t)))


@query(
    "zero_shot_classes",
    """SELECT vec_id, label, arg_max(prompt, p) AS predicted, round(max(p), 6) AS confidence FROM probs
       GROUP BY ALL""",
    (),
    _SIMS,
)
def zero_shot_classes(t):
    probs = similarity.class_probabilities(t.embeddings, "embedding", label_prompts(t))
    return r6(probs.select("vec_id", "label", "predicted", F.array_max("probabilities").alias("confidence")))


@query(
    "prediction_entropy",
    """SELECT round(avg(h), 6) AS mean_entropy, round(avg(t), 6) AS mean_target FROM (
         SELECT vec_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h, max(p) FILTER (prompt = 0) AS t
         FROM probs GROUP BY 1)""",
    (),
    _SIMS,
)
def prediction_entropy(t):
    probs = similarity.class_probabilities(t.embeddings, "embedding", label_prompts(t))
    return r6(
        probs.agg(
            F.avg(similarity.entropy(F.col("probabilities"))).alias("mean_entropy"),
            F.avg(F.col("probabilities")[0]).alias("mean_target"),
        )
    )


@query(
    "zero_shot_report",
    """SELECT round(avg((label = predicted)::int), 6) AS accuracy, count(*) AS n
       FROM (SELECT vec_id, label, arg_max(prompt, p) AS predicted FROM probs GROUP BY ALL)""",
    (),
    _SIMS,
)
def zero_shot_report(t):
    probs = similarity.class_probabilities(t.embeddings, "embedding", label_prompts(t))
    pairs = probs.select(F.col("label").alias("truth"), "predicted")
    accuracy = classify.summary(pairs).select("accuracy")
    return r6(accuracy.withColumn("n", pairs.agg(F.count("*")).scalar()))


@query(
    "evasion_scores",
    """SELECT o_orderkey AS image_id, round(coalesce(c, 0), 6) AS evasion FROM orders LEFT JOIN
         (SELECT image_id, sum(conf) AS c FROM detections WHERE cls = 1 GROUP BY 1) ON image_id = o_orderkey""",
    ("detections",),
)
def evasion_scores(t):
    images = t.orders.select(F.col("o_orderkey").alias("image_id"))
    return r6(similarity.evasion_score(images, t.detections, 1))


@query(
    "combined_scores",
    """SELECT s.vec_id AS image_id, round(coalesce(c, 0) * style / (1 + suspicion), 6) AS score
       FROM (SELECT vec_id, greatest(0, least(1, (max(cos) + 1) / 2)) AS style,
                    1 - greatest(0, least(1, (min(cos) + 1) / 2)) AS suspicion FROM sims GROUP BY 1) s
       LEFT JOIN (SELECT image_id, sum(conf) AS c FROM detections WHERE cls = 1 GROUP BY 1) d ON d.image_id = s.vec_id""",
    ("detections",),
    _SIMS,
)
def combined_scores(t):
    cosines = similarity.cosine_to(F.col("embedding"), label_prompts(t))
    images = t.embeddings.select(F.col("vec_id").alias("image_id"), cosines.alias("cos"))
    scored = similarity.evasion_score(images, t.detections, 1)
    style = similarity.unit_score(F.array_max("cos"))
    suspicion = 1 - similarity.unit_score(F.array_min("cos"))
    return r6(scored.select("image_id", similarity.combined_score(F.col("evasion"), style, suspicion).alias("score")))


@query(
    "embedding_moments",
    """WITH wide AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings)
       SELECT cast(i AS int) AS i, -1 AS j, round(avg(x), 9) AS value FROM wide GROUP BY ALL
       UNION ALL SELECT cast(a.i AS int), cast(b.i AS int), round(covar_samp(a.x, b.x), 9) FROM wide a
       JOIN wide b ON b.vec_id = a.vec_id AND b.i <= a.i GROUP BY ALL""",
)
def embedding_moments(t):
    """Means (j = -1) and covariances of the embeddings' components."""
    means, covariances = similarity.moments(t.embeddings, "embedding")
    rows = means.select("i", F.lit(-1).alias("j"), F.col("mean").alias("value"))
    return r6(rows.unionByName(covariances.select("i", "j", F.col("covariance").alias("value"))), 9)


@query("frechet_distance")
def frechet_distance(t):
    left = t.embeddings.where(F.col("label") < 5)
    return r6(similarity.frechet_distance(left, t.embeddings.where(F.col("label") >= 5), "embedding"), 4)


# -- user models ---------------------------------------------------------------------------------


def _load_scorer():
    def score(texts: list) -> list:
        if any(text.strip() == "" or "|" in text for text in texts):
            raise ValueError("not prose")
        return [len(text.split()) for text in texts]

    return score


@query(
    "scored_rows",
    f"""SELECT doc_id, CASE WHEN contains(text, '|') THEN NULL
                 ELSE cast(len(regexp_extract_all(text, '{NOT_BLANK}')) AS string) END AS result,
               CASE WHEN contains(text, '|') THEN 'not prose' END AS error FROM documents""",
)
def scored_rows(t):
    return scoring.score_rows(t.documents, "doc_id", "text", _load_scorer)


def _load_responder():
    def answer(contract: int, category: str, turn: int) -> str:
        digest = hashlib.md5(f"{contract}:{category}:{turn}".encode()).digest()
        if digest[0] < 40:
            return "Maybe."
        if digest[0] < 150:
            return "Yes, the clause is stated in the second part of this long contract text"
        return "No, the clause is absent from this contract after reading all its sections"

    return answer


_ASKED = """vote_log AS (SELECT contract_id, clause_category, seq, CASE WHEN byte < 40 THEN 'Maybe.'
        WHEN byte < 150 THEN 'Yes, the clause is stated in the second part of this long contract text'
        ELSE 'No, the clause is absent from this contract after reading all its sections' END AS response
    FROM (SELECT *, cast('0x' || substr(md5(contract_id || ':' || clause_category || ':' || seq), 1, 2) AS int) AS byte
          FROM (SELECT contract_id, clause_category, unnest(range(1, 201)) AS seq FROM tasks)))"""


@query(
    "answered_tasks",
    """SELECT contract_id, clause_category, answer, total_votes, converged,
              CASE WHEN converged THEN 'decided' ELSE 'out of votes' END AS state FROM decided""",
    ("contracts",),
    ", ".join([TASKS, _ASKED, vote_ctes(3, 20)]),
)
def answered_tasks(t):
    """Tasks answered in blocks until decided, then voted on."""
    tasks = reviewed_tasks(t)
    log, states = scoring.answer_until_decided(tasks, _load_responder, shared_dir(t.spark, "answers"), block=10)
    decided = voting.vote(tasks, log, failed="failed").join(states.select(*voting.TASK, "state"), list(voting.TASK))
    return decided.select("contract_id", "clause_category", "answer", "total_votes", "converged", "state")


_DOCUMENT = """parts AS (SELECT *, clause_category || '=' || truth || '/' || answer || '/' || correct || '/' || yes_votes || '/'
        || no_votes || '/' || total_votes || '/' || converged AS line FROM judged),
    results AS (SELECT cast(contract_id AS string) AS part, count(*) FILTER (NOT correct) || ' ' || string_agg(line, ',' ORDER BY clause_category) AS content
                FROM parts GROUP BY contract_id),
    whole AS (SELECT count(DISTINCT contract_id) AS contracts, count(*) AS clauses, count(*) FILTER (correct) AS correct,
                     avg(total_votes) FILTER (converged) AS votes, sum(responses) AS responses, sum(red_flagged) AS flagged,
                     sum(discarded) AS discarded FROM judged),
    faultless AS (SELECT count(*) AS n FROM (SELECT contract_id FROM judged GROUP BY 1 HAVING bool_and(correct)))"""


@query(
    "experiment_document",
    """SELECT part, content FROM results
       UNION ALL SELECT 'config', '3 all sampled-log'
       UNION ALL SELECT 'metrics', round(correct / clauses, 4) || ' ' || round(n / contracts, 4) || ' ' || contracts || ' ' || clauses
              || ' ' || correct || ' ' || round(votes, 4) FROM whole, faultless
       UNION ALL SELECT 'voter_stats', responses || ' ' || flagged || ' ' || discarded FROM whole""",
    ("contracts", "vote_log"),
    ", ".join([judged_ctes(3), _DOCUMENT]),
)
def experiment_document(t):
    """An experiment's whole result as JSON, written and read back: its contracts line by line, then the document's head."""
    votes = judged(t)
    clause = (
        "struct<clause_category:string,ground_truth:string,prediction:string,correct:boolean,"
        "votes:map<string,bigint>,total_votes:bigint,converged:boolean>"
    )
    path = sinks.json_lines(review.contract_results(votes), shared_dir(t.spark, "results"))
    back = readers.json_lines(t.spark, path, f"contract_id long, clauses array<{clause}>, errors long")

    def shown(c):
        cast = [c["correct"], F.coalesce(c["votes"]["YES"], F.lit(0)), F.coalesce(c["votes"]["NO"], F.lit(0)), c["total_votes"], c["converged"]]
        return F.concat(c["clause_category"], F.lit("="), F.concat_ws("/", c["ground_truth"], c["prediction"], *[x.cast("string") for x in cast]))

    content = F.concat_ws(" ", F.col("errors").cast("string"), F.array_join(F.transform("clauses", shown), ","))
    lines = back.select(F.col("contract_id").cast("string").alias("part"), content.alias("content"))
    head = sinks.json_lines(review.experiment_head(votes, 3, "all", "sampled-log"), shared_dir(t.spark, "results"))
    schema = (
        "config struct<k:int,sample_size:string,model:string>, metrics struct<accuracy:double,zero_error_rate:double,"
        "total_contracts:bigint,total_clauses:bigint,correct_clauses:bigint,avg_votes_per_decision:double>,"
        " voter_stats struct<total_responses:bigint,red_flagged:bigint,discarded:bigint>"
    )
    read = readers.json_lines(t.spark, head, schema)

    def fields(name):
        return F.concat_ws(" ", *[
            (F.round(f"{name}.{f.name}", 4) if f.dataType.simpleString() == "double" else F.col(f"{name}.{f.name}")).cast("string")
            for f in read.schema[name].dataType.fields
        ])

    heads = F.array(*[F.struct(F.lit(name).alias("part"), fields(name).alias("content")) for name in read.columns])
    return lines.unionByName(read.select(F.inline(heads)))

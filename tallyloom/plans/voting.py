"""Queries over the vote log: answer rules, votes, review scores."""

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import landing, review, voting
from tallyloom.plans.catalog import Tables, query, r6
from tallyloom.plans.oracle_parts import JUDGED, TASKS, read_sql, vote_ctes

TASK = list(voting.TASK)


def reviewed_tasks(t: Tables):
    """The clause tasks of all contracts, also of those without any response."""
    return landing.clause_tasks(t.contracts.drop("text"), carry=["text_length"])


def judged(t: Tables, k: int = 3, max_votes: int = voting.MAX_VOTES, failed: str | None = None):
    return review.judge(voting.vote(reviewed_tasks(t), t.vote_log, k, max_votes, failed=failed))


def judged_ctes(k: int, max_votes: int = 20, failed: str = "false") -> str:
    return ", ".join([vote_ctes(k, max_votes, failed), TASKS, JUDGED])


VIEWS = ("contracts", "vote_log")
VOTE_COLUMNS = (
    "contract_id, clause_category, answer, yes_votes, no_votes, total_votes, converged, responses,"
    " red_flagged, discarded"
)


@query(
    "response_flags",
    f"SELECT seq, reason, answer FROM ({read_sql('vote_log')})",
    ("vote_log",),
)
def response_flags(t):
    return voting.read_responses(t.vote_log).select("seq", "reason", "answer")


@query(
    "conversation_flags",
    f"""SELECT conv_id, turn, reason, answer
        FROM ({read_sql("(SELECT conv_id, turn, text AS response FROM conversations)")})""",
)
def conversation_flags(t):
    said = t.conversations.select("conv_id", "turn", F.col("text").alias("response"))
    return voting.read_responses(said).select("conv_id", "turn", "reason", "answer")


@query(
    "document_answers",
    f"""SELECT doc_id, reason IS NOT NULL AS flagged, answer
        FROM ({read_sql("(SELECT doc_id, text AS response FROM documents)")})""",
)
def document_answers(t):
    read = voting.read_responses(t.documents.select("doc_id", F.col("text").alias("response")))
    return read.select("doc_id", F.col("reason").isNotNull().alias("flagged"), "answer")


@query(
    "flag_histogram",
    f"""SELECT regexp_replace(coalesce(reason, 'kept'), ' \\(.*$', '') AS reason, count(*) AS n
        FROM ({read_sql('vote_log')}) GROUP BY 1""",
    ("vote_log",),
)
def flag_histogram(t):
    return review.flag_histogram(voting.read_responses(t.vote_log))


def _vote_query(name, k, max_votes, failed=None):
    sql = f"SELECT {VOTE_COLUMNS} FROM judged"

    @query(name, sql, VIEWS, judged_ctes(k, max_votes, failed or "false"))
    def run(t):
        return judged(t, k, max_votes, failed).select(*[c.strip() for c in VOTE_COLUMNS.split(",")])


_vote_query("vote_ahead_by_3", 3, 20)
_vote_query("vote_ahead_by_5", 5, 20)
_vote_query("vote_ahead_by_1", 1, 20)
_vote_query("vote_single_response", 1, 1)
_vote_query("vote_small_cap", 6, 4)
_vote_query("vote_until_failure", 3, 20, "failed")


@query(
    "vote_all_contracts",
    f"""SELECT t.contract_id, t.clause_category, coalesce(d.answer, 'NO') AS answer,
               coalesce(d.converged, false) AS converged, coalesce(d.responses, 0) AS responses
        FROM tasks t LEFT JOIN decided d USING (contract_id, clause_category)""",
    VIEWS,
    ", ".join([vote_ctes(3, 20), TASKS]),
)
def vote_all_contracts(t):
    tasks = landing.clause_tasks(t.contracts.drop("text"))
    return voting.vote(tasks, t.vote_log).select(*TASK, "answer", "converged", "responses")


@query(
    "vote_counts",
    """SELECT contract_id, clause_category, yes_votes, no_votes,
              (yes_votes > 0)::int + (no_votes > 0)::int AS answers FROM judged""",
    VIEWS,
    judged_ctes(3),
)
def vote_counts(t):
    done = judged(t)
    votes = F.col("votes")
    return done.withColumn("votes", voting.vote_counts(done)).select(
        *TASK,
        F.coalesce(votes["YES"], F.lit(0)).alias("yes_votes"),
        F.coalesce(votes["NO"], F.lit(0)).alias("no_votes"),
        F.size("votes").alias("answers"),
    )


@query(
    "sampling_temperatures",
    """SELECT d.seq, CASE WHEN f.first_seq IS NULL OR d.seq <= f.first_seq THEN 0.0e0 ELSE 0.1e0 END
                     AS temperature
       FROM drawn d JOIN (SELECT contract_id, clause_category,
                                 min(seq) FILTER (answer IS NOT NULL) AS first_seq
                          FROM drawn GROUP BY ALL) f USING (contract_id, clause_category)""",
    ("vote_log",),
    vote_ctes(3, 20),
)
def sampling_temperatures(t):
    return voting.sampling_temperature(voting.drawn_responses(t.vote_log)).select("seq", "temperature")


@query(
    "clause_correctness",
    "SELECT contract_id, clause_category, truth, answer, correct FROM judged",
    VIEWS,
    judged_ctes(3),
)
def clause_correctness(t):
    return judged(t).select(*TASK, "truth", "answer", "correct")


_ACCURACY = """count(*) FILTER (correct) AS correct, count(*) AS total,
               round(count(*) FILTER (correct) / count(*), 6) AS accuracy"""


@query("baseline_success_rate", f"SELECT {_ACCURACY} FROM judged", VIEWS, judged_ctes(1, 1))
def baseline_success_rate(t):
    return r6(review.accuracy_by(judged(t, 1, 1)))


@query(
    "category_accuracy",
    f"SELECT clause_category, {_ACCURACY} FROM judged GROUP BY 1",
    VIEWS,
    judged_ctes(1, 1),
)
def category_accuracy(t):
    return r6(review.accuracy_by(judged(t, 1, 1), ["clause_category"]))


@query(
    "contract_results",
    """SELECT contract_id, count(*) FILTER (NOT correct) AS errors,
              count(*) FILTER (NOT correct) = 0 AS zero_errors,
              string_agg(clause_category || ':' || truth || ':' || answer || ':' || total_votes, ','
                         ORDER BY clause_category) AS clauses
       FROM judged GROUP BY 1""",
    VIEWS,
    judged_ctes(3),
)
def contract_results(t):
    def line(c):
        return F.concat_ws(":", c["clause_category"], c["ground_truth"], c["prediction"], c["total_votes"].cast("string"))

    results = review.contract_results(judged(t))
    return results.withColumn("clauses", F.array_join(F.transform("clauses", line), ","))


def _experiment_sql(k):
    return f"""SELECT count(*) AS total_contracts, cast(sum(clauses) AS bigint) AS total_clauses,
      cast(sum(right_) AS bigint) AS correct_clauses, round(sum(right_) / sum(clauses), 6) AS accuracy,
      count(*) FILTER (right_ = clauses) AS zero_error_contracts,
      round(count(*) FILTER (right_ = clauses) / count(*), 6) AS zero_error_rate,
      cast(sum(conv) AS bigint) AS converged,
      round(coalesce(sum(votes) / nullif(sum(conv), 0), {k}), 6) AS avg_votes_per_decision,
      round(sum(clauses) * coalesce(sum(votes) / nullif(sum(conv), 0), {k}) * 0.03e0, 6)
          AS total_cost_estimate,
      cast(sum(responses) AS bigint) AS total_responses, cast(sum(red_flagged) AS bigint) AS red_flagged,
      cast(sum(discarded) AS bigint) AS discarded
    FROM (SELECT contract_id, count(*) AS clauses, count(*) FILTER (correct) AS right_,
                 count(*) FILTER (converged) AS conv, sum(total_votes) FILTER (converged) AS votes,
                 sum(responses) AS responses, sum(red_flagged) AS red_flagged,
                 sum(discarded) AS discarded FROM judged GROUP BY 1)"""


def _experiment_query(k):
    @query(f"experiment_k{k}", _experiment_sql(k), VIEWS, judged_ctes(k))
    def run(t):
        return experiment(t, k)


def experiment(t, k: int = 3):
    return r6(review.experiment_metrics(judged(t, k), k))


for _k in (3, 5):
    _experiment_query(_k)


@query(
    "voter_statistics",
    """SELECT cast(sum(responses) AS bigint) AS total_responses,
              cast(sum(red_flagged) AS bigint) AS red_flagged,
              cast(sum(discarded) AS bigint) AS discarded FROM judged""",
    VIEWS,
    judged_ctes(3),
)
def voter_statistics(t):
    return review.voter_statistics(judged(t))


@query(
    "clause_confusion",
    """SELECT *, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fp_rate,
              round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fn_rate,
              round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
       FROM (SELECT clause_category,
               count(*) FILTER (answer = 'YES' AND truth = 'YES') AS tp,
               count(*) FILTER (answer = 'YES' AND truth = 'NO') AS fp,
               count(*) FILTER (answer = 'NO' AND truth = 'YES') AS fn,
               count(*) FILTER (answer = 'NO' AND truth = 'NO') AS tn FROM judged GROUP BY 1)""",
    VIEWS,
    judged_ctes(3),
)
def clause_confusion(t):
    return r6(review.clause_confusion(judged(t)))


@query(
    "error_by_length",
    """SELECT CASE WHEN text_length < 2000 THEN 'short' WHEN text_length <= 5000 THEN 'medium'
                   ELSE 'long' END AS band, count(*) FILTER (NOT correct) AS errors, count(*) AS total,
              round(count(*) FILTER (NOT correct) / count(*), 6) AS error_rate
       FROM judged GROUP BY 1""",
    VIEWS,
    judged_ctes(3),
)
def error_by_length(t):
    done = judged(t).withColumn("band", review.length_band(F.col("text_length")))
    wrong = F.count_if(~F.col("correct"))
    return r6(
        done.groupBy("band").agg(
            wrong.alias("errors"), F.count("*").alias("total"), (wrong / F.count("*")).alias("error_rate")
        )
    )


_KS, _TARGETS = (1, 2, 3, 5, 7), (0.9, 0.95)


@query(
    "scaling_laws",
    """SELECT clause_category, k, target, p, s, v, p_sub, round(pow(p_sub_raw, s), 6) AS p_full, k_min,
              relative_cost
       FROM (SELECT clause_category, k, target, round(p, 6) AS p, s, round(v, 6) AS v,
               CASE WHEN p <= 0 THEN 0 ELSE 1 / (1 + pow((1 - p) / p, k)) END AS p_sub_raw,
               round(CASE WHEN p <= 0 THEN 0 ELSE 1 / (1 + pow((1 - p) / p, k)) END, 6) AS p_sub,
               CASE WHEN p > 0.5 AND p < 1
                    THEN cast(ceil(ln(pow(target, -1.0e0 / s) - 1) / ln((1 - p) / p)) AS bigint)
                    WHEN p >= 1 THEN 1 END AS k_min,
               round(CASE WHEN p > 0.5 AND v > 0 THEN s * ln(s) / (v * (2 * p - 1)) END, 6) AS relative_cost
             FROM (SELECT clause_category, count(*) FILTER (correct) / count(*) AS p,
                     2 AS s, 1 - sum(red_flagged) / sum(responses) AS v FROM judged GROUP BY 1),
                  (VALUES (1), (2), (3), (5), (7)) a(k), (VALUES (0.9e0), (0.95e0)) b(target))""",
    VIEWS,
    judged_ctes(1, 1),
)
def scaling_laws(t):
    rates = judged(t, 1, 1).groupBy("clause_category").agg(
        (F.count_if("correct") / F.count("*")).alias("p"),
        F.lit(2).alias("s"),
        (1 - F.sum("red_flagged") / F.sum("responses")).alias("v"),
    )
    return r6(review.scaling_laws(rates, _KS, _TARGETS))


@query(
    "clause_prompts",
    """SELECT id AS contract_id, clause_category, length(p) AS prompt_chars, md5(p) AS prompt_md5
       FROM (SELECT id, clause_category, 'Given this contract text, does it contain a '
               || clause_category || ' clause?\n\nContract:\n' || text
               || '\n\nInstructions:\n- Answer YES or NO\n- Provide a brief explanation citing specific'
               || ' contract text\n- Be concise (under 200 words)\n\nAnswer:' AS p
             FROM contracts, (VALUES ('quality'), ('toxic')) c(clause_category))""",
    ("contracts",),
)
def clause_prompts(t):
    prompt = lambda category: tx.clause_prompt(F.col("text"), category)
    made = {"prompt_chars": lambda c: F.char_length(prompt(c)), "prompt_md5": lambda c: F.md5(prompt(c))}
    return landing.clause_tasks(t.contracts, derive=made).select(*TASK, *made)

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import ordered, review, voting
from tallyloom.plans import voting as plans
from tallyloom.plans.catalog import Tables

YES = "Yes this contract holds the wanted clause in part four of it"
NAY = "No the wanted clause is absent from every part of this text"
TEXTS = {
    "Y": YES,
    "N": NAY,
    "?": "Yes see the notice part where the wanted clause is set out",  # says both
    "m": "There is a clause in here but it sits deep within the long text",  # no answer
    "u": "Yes it is maybe stated in the second part of the long contract",  # hedged
    "s": "No.",
    "l": "yes " * 800,
    "E": None,  # a failed call
}
SCHEMA = "contract_id long, clause_category string, seq long, response string, failed boolean"


def replay(codes, k, max_votes):
    """Walk through one log step by step."""
    votes, seen, flagged, discarded, drawn, converged = {}, [], 0, 0, 0, False
    for code in codes:
        if sum(votes.values()) >= max_votes or code == "E":
            break
        drawn += 1
        if code in "musl":
            flagged += 1
            discarded += 1
            continue
        if code == "?":
            discarded += 1
            continue
        answer = "YES" if code == "Y" else "NO"
        votes[answer] = votes.get(answer, 0) + 1
        seen.append(answer)
        best = max(votes.values())
        second = sorted(votes.values())[-2] if len(votes) > 1 else 0
        if best - second >= k:
            converged = True
            break
    yes, no = votes.get("YES", 0), votes.get("NO", 0)
    answer = "YES" if yes > no else "NO" if no > yes else (seen[0] if seen else "NO")
    return answer, yes, no, yes + no, converged, drawn, flagged, discarded


def random_logs(n, seed):
    rng = random.Random(seed)
    logs = {}
    for i in range(n):
        alphabet = rng.choice(["YN", "YN?musl", "YYYN?m", "musl", "YNE", "Y", "?m"])
        logs[(i, rng.choice("ab"))] = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
    return logs


def frames(spark, logs, gaps=1):
    rows = [
        (c, cat, gaps * i, TEXTS[code], code == "E")
        for (c, cat), codes in logs.items()
        for i, code in enumerate(codes)
    ]
    random.Random(1).shuffle(rows)
    tasks = spark.createDataFrame(list(logs), "contract_id long, clause_category string")
    return tasks, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k,max_votes,chunk", [(1, 1, 1 << 20), (3, 20, 4), (2, 5, 7), (6, 4, 1 << 20), (3, 20, 1)])
def test_vote_equals_replay(spark, monkeypatch, k, max_votes, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    logs = random_logs(120, seed=k * 100 + max_votes)
    tasks, log = frames(spark, logs, gaps=3)
    rows = voting.vote(tasks, log, k, max_votes, failed="failed").collect()
    assert len(rows) == len(logs)
    for r in rows:
        got = (
            r["answer"], r["yes_votes"], r["no_votes"], r["total_votes"], r["converged"],
            r["responses"], r["red_flagged"], r["discarded"],
        )
        codes = logs[(r["contract_id"], r["clause_category"])]
        assert got == replay(codes, k, max_votes), codes


def test_hot_task(spark, monkeypatch):
    """One task with most of the rows, cut into many chunks."""
    monkeypatch.setattr(ordered, "CHUNK", 100)
    logs = {(0, "a"): "m" * 2000 + "YNYNYN" + "?" * 500 + "YYY" + "N" * 50, (1, "a"): "NNN", (2, "b"): ""}
    tasks, log = frames(spark, logs)
    rows = {(r["contract_id"], r["clause_category"]): r for r in voting.vote(tasks, log, 3, 20).collect()}
    assert rows[(0, "a")]["responses"] == 2509 and rows[(0, "a")]["answer"] == "YES"
    assert rows[(1, "a")]["converged"] and rows[(1, "a")]["answer"] == "NO"
    assert rows[(2, "b")]["answer"] == "NO" and not rows[(2, "b")]["converged"]


def test_drawn_and_temperature(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 3)
    logs = random_logs(60, seed=5)
    _, log = frames(spark, logs)
    drawn = voting.sampling_temperature(voting.drawn_responses(log, 3, 20, failed="failed")).collect()
    got = {}
    for r in drawn:
        got.setdefault((r["contract_id"], r["clause_category"]), {})[r["seq"]] = r["temperature"]
    for task, codes in logs.items():
        n = replay(codes, 3, 20)[5]
        first = next((i for i, c in enumerate(codes[:n]) if c in "YN"), n)
        assert got.get(task, {}) == {i: 0.0 if i <= first else 0.1 for i in range(n)}, codes


def test_null_group_is_a_group(spark):
    rows = [(c, "a", i, YES, False) for i in range(4) for c in (None, 0, 7)] + [(None, None, 9, YES, False)]
    decided = voting.decide(spark.createDataFrame(rows, SCHEMA)).collect()
    votes = {(r["contract_id"], r["clause_category"]): r["yes_votes"] for r in decided}
    assert votes == {(None, "a"): 3, (0, "a"): 3, (7, "a"): 3, (None, None): 1}


@pytest.fixture(scope="module")
def given_log(spark):
    """All tasks of the contracts with their truth, and the codes of their responses in order."""
    tables = Tables(spark, "/root/testdata/sf0.01")
    truth = {(r["contract_id"], r["clause_category"]): r["truth"] for r in plans.reviewed_tasks(tables).collect()}
    codes = {task: "" for task in truth}
    read = voting.read_responses(tables.vote_log).select("contract_id", "clause_category", "seq", "reason", "answer")
    for r in sorted(read.collect(), key=lambda r: r["seq"]):
        if (task := (r["contract_id"], r["clause_category"])) in codes:
            codes[task] += "m" if r["reason"] else {"YES": "Y", "NO": "N", None: "?"}[r["answer"]]
    return tables, truth, codes


@pytest.mark.parametrize("k,max_votes", [(1, 1), (3, 20), (5, 20)])
def test_known_numbers(given_log, k, max_votes):
    tables, truth, codes = given_log
    results = {task: replay(codes[task], k, max_votes) for task in truth}
    right = {task: r[0] == truth[task] for task, r in results.items()}
    contracts = {c for c, _ in truth}
    wrong = {c for (c, _), ok in right.items() if not ok}
    votes = [r[3] for r in results.values() if r[4]]
    row = review.experiment_metrics(plans.judged(tables, k, max_votes), k).first()
    assert (row["total_contracts"], row["total_clauses"]) == (len(contracts), len(truth))
    assert (row["correct_clauses"], row["zero_error_contracts"]) == (sum(right.values()), len(contracts - wrong))
    assert (row["converged"], row["total_responses"]) == (len(votes), sum(r[5] for r in results.values()))
    assert row["avg_votes_per_decision"] == pytest.approx(sum(votes) / len(votes))
    assert (row["red_flagged"], row["discarded"]) == tuple(sum(r[i] for r in results.values()) for i in (6, 7))


def flag_by_hand(text):
    n = len(text.split())
    if n > 750:
        return f"too_long ({n} words)"
    if "YES" not in text.upper() and "NO" not in text.upper():
        return "missing_answer"
    for marker in tx.UNCERTAINTY_MARKERS:
        if marker in text.lower():
            return f"uncertainty ({marker})"
    return "too_short" if n < 10 else None


def test_flag_rules(spark):
    blanks = [" ", " ", " ", "\t", "\n", "\x1c", "\x1f", "\x85", "　", "\r\n", "  "]
    texts = ["", " ", "yes", "YES no", YES, "maybe yes unclear", "it could be, yes", "KNOWN unto all " * 4]
    rng = random.Random(3)
    for n in (1, 8, 9, 10, 11, 749, 750, 751, 900):
        for _ in range(4):
            words = [rng.choice(["yes", "a", "clause", "no"]) for _ in range(n)]
            texts.append(rng.choice(["", " "]) + rng.choice(blanks).join(words) + rng.choice(["", "\n"]))
            texts.append("".join(w + rng.choice(blanks) for w in words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    read = voting.read_responses(df).withColumn("n", tx.word_count(F.col("response"))).collect()
    for r in read:
        assert r["n"] == len(texts[r["i"]].split()), repr(texts[r["i"]][:80])
        assert r["reason"] == flag_by_hand(texts[r["i"]]), repr(texts[r["i"]][:80])


def test_answers(spark):
    cases = {
        "YES": "YES", "it contains one": "YES", "not found": None, "found": "YES", "absent": "NO", "no": "NO",
        "notice": "NO", "known": "NO", "not present": None, "does not contain": "NO", "": None, "clause": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["a"] for r in df.select("t", tx.parse_answer(F.upper("t")).alias("a")).collect()}
    assert got == cases


def test_experiment_on_nothing(spark):
    tasks = spark.createDataFrame([], "contract_id long, clause_category string, truth string")
    log = spark.createDataFrame([], SCHEMA)
    row = review.experiment_metrics(review.judge(voting.vote(tasks, log)), 3).first()
    assert row["accuracy"] == 0 and row["avg_votes_per_decision"] == 3.0 and row["total_contracts"] == 0


def test_long_logs_are_sorted_by_more_tasks(spark, monkeypatch):
    """A task of a vote has no more responses than the limit, whatever the session's number of partitions."""
    tasks, log = frames(spark, random_logs(60, seed=4))
    want = sorted(map(tuple, voting.decide(log, failed="failed").collect()), key=str)
    given, usual = [], voting.prefix_scan
    monkeypatch.setattr(voting, "RESPONSES_AT_ONCE", 8)
    monkeypatch.setattr(voting, "prefix_scan", lambda *a, **k: given.append(k.get("parts")) or usual(*a, **k))
    got = sorted(map(tuple, voting.decide(log, failed="failed").collect()), key=str)
    assert got == want and given == [-(-log.count() // 8)] and given[0] > int(spark.conf.get("spark.sql.shuffle.partitions"))

"""SQL fragments used by several oracles."""

from tallyloom.functions.text import UNCERTAINTY_MARKERS

NOT_BLANK = (
    r"[^\s\x{A0}\x0b\x1c-\x1f\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def read_sql(source: str, max_words: int = 750, failed: str = "false") -> str:
    """A subquery that adds reason and answer to a relation with a response."""
    markers = "\n".join(
        f"WHEN contains(lower(response), {quoted(m)}) THEN {quoted('uncertainty (' + m + ')')}"
        for m in UNCERTAINTY_MARKERS
    )
    return f"""SELECT *, CASE WHEN {failed} OR reason IS NOT NULL THEN NULL
            WHEN regexp_matches(upper(response), 'YES|CONTAINS|PRESENT|FOUND')
                 AND NOT regexp_matches(upper(response), 'NO|ABSENT') THEN 'YES'
            WHEN regexp_matches(upper(response), 'NO|ABSENT')
                 AND NOT regexp_matches(upper(response), 'YES|CONTAINS|PRESENT|FOUND') THEN 'NO' END AS answer
        FROM (SELECT *, CASE WHEN {failed} THEN NULL
                WHEN nwords > {max_words} THEN 'too_long (' || nwords || ' words)'
                WHEN NOT (contains(upper(response), 'YES') OR contains(upper(response), 'NO'))
                     THEN 'missing_answer'
                {markers}
                WHEN nwords < 10 THEN 'too_short' END AS reason
              FROM (SELECT *, len(regexp_extract_all(response, '{NOT_BLANK}')) AS nwords FROM {source}))"""


def vote_ctes(k: int, max_votes: int, failed: str = "false") -> str:
    """read_log, ends, drawn and decided: the vote over vote_log as window SQL."""
    task = "contract_id, clause_category"
    return f"""read_log AS ({read_sql("vote_log", failed=failed)}),
    failures AS (SELECT {task}, min(seq) AS fail FROM read_log WHERE {failed} GROUP BY ALL),
    upto AS (SELECT r.* FROM read_log r LEFT JOIN failures f USING ({task})
             WHERE f.fail IS NULL OR r.seq < f.fail),
    running AS (SELECT *, sum(CASE answer WHEN 'YES' THEN 1 WHEN 'NO' THEN -1 ELSE 0 END) OVER w AS lead,
                       count(answer) OVER w AS nv
                FROM upto WINDOW w AS (PARTITION BY {task} ORDER BY seq
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    ends AS (SELECT {task},
                    min(seq) FILTER (answer IS NOT NULL AND nv <= {max_votes} AND abs(lead) >= {k}) AS stop,
                    min(seq) FILTER (answer IS NOT NULL AND nv = {max_votes}) AS cap
             FROM running GROUP BY ALL),
    drawn AS (SELECT r.*, e.stop, e.cap FROM running r JOIN ends e USING ({task})
              WHERE r.seq <= coalesce(least(e.stop, e.cap), 9223372036854775807)),
    decided AS (SELECT {task},
                  count(*) FILTER (answer = 'YES') AS yes_votes, count(*) FILTER (answer = 'NO') AS no_votes,
                  count(answer) AS total_votes, max(stop) IS NOT NULL AS converged,
                  count(*) AS responses, count(reason) AS red_flagged,
                  count(*) FILTER (answer IS NULL) AS discarded,
                  CASE WHEN yes_votes > no_votes THEN 'YES' WHEN no_votes > yes_votes THEN 'NO'
                       ELSE coalesce(min_by(answer, seq) FILTER (answer IS NOT NULL), 'NO') END AS answer
                FROM drawn GROUP BY ALL)"""


TASKS = """tasks AS (SELECT id AS contract_id, u.clause_category, u.truth, text_length
    FROM contracts, (VALUES ('quality'), ('toxic')) c(clause_category),
    LATERAL (SELECT c.clause_category,
             CASE WHEN coalesce(CASE c.clause_category WHEN 'quality' THEN quality ELSE toxic END, 0) <> 0
                  THEN 'YES' ELSE 'NO' END AS truth) u)"""

JUDGED = """judged AS (SELECT t.contract_id, t.clause_category, t.truth, t.text_length,
        coalesce(d.answer, 'NO') AS answer, coalesce(d.yes_votes, 0) AS yes_votes,
        coalesce(d.no_votes, 0) AS no_votes, coalesce(d.total_votes, 0) AS total_votes,
        coalesce(d.converged, false) AS converged, coalesce(d.responses, 0) AS responses,
        coalesce(d.red_flagged, 0) AS red_flagged, coalesce(d.discarded, 0) AS discarded,
        coalesce(d.answer, 'NO') = t.truth AS correct
    FROM tasks t LEFT JOIN decided d USING (contract_id, clause_category))"""

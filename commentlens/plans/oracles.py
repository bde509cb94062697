"""The same queries in plain SQL, for an independent engine to run on the same tables."""

from __future__ import annotations

from commentlens import constants as C

B, CR, N = C.BELIEVES, C.CRITICIZES, C.NEUTRAL


def _stance(number: str) -> str:
    return f"CASE {number} WHEN 0 THEN '{B}' WHEN 1 THEN '{CR}' WHEN 2 THEN '{N}' END"


COMMENTS = """
comments AS (
  SELECT event_type AS post_id, event_id AS ord, user_id AS author,
         CAST(floor(value) AS BIGINT) AS reactions, user_id % 7 AS sub_comments, ts
  FROM events)
"""

SCORED = f"""
scored AS (
  SELECT lang AS post_id, doc_id AS ord,
         text || CASE WHEN doc_id % 5 = 0 THEN ' ?' ELSE '' END
              || CASE WHEN doc_id % 7 = 0 THEN ' 😂' ELSE '' END
              || CASE WHEN doc_id % 11 = 0 THEN ' !' ELSE '' END AS content,
         {_stance('doc_id % 3')} AS stance,
         CAST(doc_id * 37 % 1000 AS DOUBLE) / 1000.0 AS confidence,
         CAST(doc_id * 91 % 1000 AS DOUBLE) / 1000.0 AS sarcasm_score,
         CASE WHEN doc_id % 2 = 0 THEN 'irony' ELSE 'non_irony' END AS sarcasm_label
  FROM documents)
"""

EXPLANATION = f"""
CASE
  WHEN sarcasm_score > 0.7 AND confidence < 0.5 THEN
    CASE stance WHEN '{CR}' THEN '{C.SARCASTIC_CRITICISM}'
                WHEN '{B}' THEN '{C.IRONIC_ENDORSEMENT}'
                WHEN '{N}' THEN '{C.AMBIGUOUS_TONE}' END
  WHEN contains(content, '?') AND sarcasm_score > 0.6 THEN '{C.SARCASTIC_QUESTION}'
  WHEN regexp_matches(content, '[{C.CUE_EMOJI}]') AND sarcasm_score > 0.6 THEN '{C.SARCASTIC_EMOJI}'
  WHEN regexp_matches(lower(content), 'not|no|never|fake|hoax') AND confidence < 0.6 THEN '{C.SKEPTICAL}'
  WHEN contains(content, '!') AND sarcasm_score < 0.4 THEN '{C.STRONG_EMOTION}'
  ELSE '{C.NEEDS_REVIEW}'
END
"""

UNCERTAIN = f"""
uncertain AS (SELECT *, {EXPLANATION} AS explanation FROM scored WHERE confidence < 0.6)
"""

ANNOTATED = f"""
files AS (
  SELECT lang AS post_id, doc_id, text AS content, {_stance('doc_id % 3')} AS stance,
         CASE WHEN toxic = 1 THEN '{CR}' WHEN quality = 1 THEN '{N}'
              WHEN quality IS NOT NULL THEN '{B}' END AS validation,
         quality IS NOT NULL AS labelled,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord
  FROM documents LEFT JOIN labels USING (doc_id)),
annotated AS (SELECT * FROM files WHERE labelled)
"""

CONFUSION = """
confusion AS (SELECT stance AS predicted, validation AS actual, count(*) AS n
              FROM annotated GROUP BY stance, validation)
"""


def _minutes(start: str, end: str) -> str:
    return f"(date_diff('microsecond', {start}, {end}) / 6e7::DOUBLE)"


def _days(start: str, end: str) -> str:
    return f"(date_diff('microsecond', {start}, {end}) / 8.64e10::DOUBLE)"


POSTS = f"""
second_events AS (
  SELECT post_id, ts AS second_event FROM (
    SELECT post_id, ts, row_number() OVER (PARTITION BY post_id ORDER BY ts) AS nth FROM comments)
  WHERE nth = 2),
facts AS (
  SELECT post_id, min(ts) AS first_event, max(ts) AS last_event,
         arg_min(reactions + sub_comments, ord) AS views,
         count(DISTINCT author) + max(CASE WHEN author IS NULL THEN 1 ELSE 0 END) AS unique_authors
  FROM comments GROUP BY post_id),
posts AS (
  SELECT post_id, first_event, last_event,
         {_minutes('first_event', 'second_event')} AS min_spread,
         {_minutes('first_event', 'last_event')} AS max_spread,
         views, unique_authors, {_days('first_event', 'last_event')} AS cls
  FROM facts LEFT JOIN second_events USING (post_id))
"""

POST_ROW = """
SELECT post_id, first_event, last_event, min_spread AS min_spread_time_minutes,
       max_spread AS max_spread_time_minutes, CAST(views AS BIGINT) AS views,
       CAST(unique_authors AS BIGINT) AS unique_authors, cls AS cls_days,
       CASE WHEN cls > 0 THEN views / cls END AS growth_rate
FROM posts
"""


def _overall(shortest: str, factor: int) -> str:
    return f"""
SELECT first_event, last_event, shortest AS min_spread_time_minutes,
       longest AS max_spread_time_minutes, CAST({factor} * views AS BIGINT) AS views,
       CAST(authors AS BIGINT) AS unique_authors, cls AS cls_days,
       CASE WHEN cls > 0 THEN {factor} * views / cls END AS growth_rate
FROM (SELECT min(first_event) AS first_event, max(last_event) AS last_event,
             {shortest} AS shortest, max(max_spread) AS longest, sum(views) AS views,
             (SELECT count(DISTINCT author) FROM comments) AS authors,
             {_days('min(first_event)', 'max(last_event)')} AS cls
      FROM posts)
"""


def _impact(polarity: str) -> str:
    return f"""
timed AS (SELECT s.*, c.reactions, c.sub_comments, c.ts FROM scored s JOIN comments c USING (ord)),
largest AS (SELECT post_id, max(reactions) AS top_reactions, max(sub_comments) AS top_sub
            FROM timed GROUP BY post_id),
normalised AS (
  SELECT t.*, t.reactions / (l.top_reactions + 1e-6) AS reactions_norm,
         t.sub_comments / (l.top_sub + 1e-6) AS sub_comments_norm, {polarity} AS polarity
  FROM timed t JOIN largest l USING (post_id)),
weighted AS (SELECT *, 0.5 * reactions_norm + 0.5 * sub_comments_norm AS impact FROM normalised),
impacts AS (
  SELECT *, 0.0::DOUBLE + impact * polarity * (1 - sarcasm_score * 0.5) AS adjusted_impact,
         CAST(ts AS DATE) AS date
  FROM weighted)
"""


FULL_POLARITY = f"CASE stance WHEN '{B}' THEN 1 WHEN '{CR}' THEN -1 WHEN '{N}' THEN 0 END"
SHORT_POLARITY = "CASE stance WHEN 'believes' THEN 1 WHEN 'criticizes' THEN -1 WHEN 'neutral' THEN 0 END"
IMPACT = _impact(FULL_POLARITY)
IMPACT_COMPAT = _impact(SHORT_POLARITY)

SUMMARY = """
SELECT post_id, n_comments, round(total, 6) AS impact_index,
       CASE WHEN total > 0 THEN 'strengthening' WHEN total < 0 THEN 'weakening' ELSE 'balanced' END
         AS direction
FROM (SELECT post_id, count(*) AS n_comments, coalesce(sum(adjusted_impact), 0.0) AS total
      FROM impacts GROUP BY post_id)
"""


def _top(order: str) -> str:
    return f"""
SELECT post_id, CAST(place AS INTEGER) AS place, ord, substr(content, 1, 150) || '...' AS content, stance, reactions, sub_comments,
       sarcasm_score, round(adjusted_impact, 6) AS adjusted_impact
FROM (SELECT *, row_number() OVER (PARTITION BY post_id
                                   ORDER BY adjusted_impact {order} NULLS LAST, ord) AS place FROM impacts)
WHERE place <= 10
"""


def _box(by: str) -> str:
    return f"""
, boxes AS (
  SELECT {by}, count(*) AS n, min(adjusted_impact) AS lowest, max(adjusted_impact) AS highest,
         quantile_cont(adjusted_impact, 0.25) AS q1, quantile_cont(adjusted_impact, 0.5) AS median,
         quantile_cont(adjusted_impact, 0.75) AS q3
  FROM impacts WHERE adjusted_impact IS NOT NULL GROUP BY {by}),
placed AS (
  SELECT b.*, adjusted_impact,
         adjusted_impact BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS beside
  FROM impacts JOIN boxes b USING ({by}) WHERE adjusted_impact IS NOT NULL)
SELECT {by}, n, round(lowest, 6) AS lowest, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(highest, 6) AS highest,
       round(min(adjusted_impact) FILTER (beside), 6) AS lower_fence,
       round(max(adjusted_impact) FILTER (beside), 6) AS upper_fence,
       count(*) FILTER (NOT beside) AS n_outliers
FROM placed GROUP BY {by}, n, lowest, q1, median, q3, highest
"""


def _sarcasm(other_score: str) -> str:
    return f"""
WITH {SCORED}, asked AS (
  SELECT post_id, ord, 'detect sarcasm: ' || substr(content, 1, 512) AS prompt FROM scored WHERE confidence < 0.6),
answered AS (
  SELECT post_id, ord, length(prompt) AS size,
         length(replace(prompt, 'a', '')) < length(replace(prompt, 'e', '')) AS ironic,
         0.5::DOUBLE + (length(prompt) % 50) / 100.0::DOUBLE AS score
  FROM asked)
SELECT post_id, ord,
       CASE WHEN size % 13 = 0 THEN 'error' WHEN ironic THEN 'irony' ELSE 'non_irony' END AS sarcasm_label,
       round(CASE WHEN size % 13 = 0 THEN 0.0 WHEN ironic THEN score ELSE {other_score} END, 6) AS sarcasm_score
FROM answered
"""


TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"

VOCABULARY = f"""
words AS (SELECT unnest({TOKENS}) AS token FROM documents),
counted AS (SELECT token, count(*) AS n FROM words GROUP BY token),
vocabulary AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
  FROM counted)
"""


NAIVE_BAYES = f"""
tw AS (SELECT validation AS label, unnest({TOKENS.replace('text', 'content')}) AS term FROM annotated),
top AS (SELECT term FROM tw GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
counts AS (
  SELECT term, count(*) FILTER (label = '{B}') AS b, count(*) FILTER (label = '{CR}') AS c, count(*) FILTER (label = '{N}') AS n
  FROM tw JOIN top USING (term) GROUP BY term),
totals AS (SELECT sum(b) AS tb, sum(c) AS tc, sum(n) AS tn, count(*) AS v FROM counts),
priors AS (
  SELECT count(*) AS rows, count(*) FILTER (validation = '{B}') AS pb, count(*) FILTER (validation = '{CR}') AS pc,
    count(*) FILTER (validation = '{N}') AS pn FROM annotated)
"""
NAIVE_BAYES_STANCE = f"""
WITH {SCORED}, {ANNOTATED}, {NAIVE_BAYES},
sw AS (SELECT ord, unnest({TOKENS.replace('text', 'content')}) AS term FROM scored),
sums AS (
  SELECT ord, sum(ln((b + 1) / (tb + v))) AS b, sum(ln((c + 1) / (tc + v))) AS c, sum(ln((n + 1) / (tn + v))) AS n
  FROM sw JOIN counts USING (term), totals GROUP BY ord),
logs AS (
  SELECT post_id, scored.ord, content, coalesce(b, 0) + ln((pb + 1) / (rows + 3)) AS b, coalesce(c, 0) + ln((pc + 1) / (rows + 3)) AS c,
    coalesce(n, 0) + ln((pn + 1) / (rows + 3)) AS n
  FROM scored LEFT JOIN sums ON scored.ord = sums.ord, priors),
powers AS (
  SELECT *, exp(b - greatest(b, c, n)) AS eb, exp(c - greatest(b, c, n)) AS ec, exp(n - greatest(b, c, n)) AS en FROM logs)
SELECT post_id, ord,
  CASE WHEN trim(content) = '' THEN '{N}' WHEN b >= c AND b >= n THEN '{B}' WHEN c >= n THEN '{CR}' ELSE '{N}' END AS stance,
  CASE WHEN trim(content) = '' THEN 0.0 ELSE round(greatest(eb, ec, en) / (eb + ec + en), 6) END AS confidence
FROM powers"""

SUBWORD_ROUNDS, SUBWORD_PAIRS = 6, 48
_NEIGHBOURS = "unnest(list_transform(range(1, len(s)), lambda i: {{'a': s[i], 'b': s[i + 1]}}))".replace("{{", "{").replace("}}", "}")
_JOINED = (
    "list_filter(list_transform(range(1, len(s) + 1), lambda i:"
    " CASE WHEN i > 1 AND list_contains(m, s[i - 1] || '|' || s[i]) THEN NULL"
    " WHEN i < len(s) AND list_contains(m, s[i] || '|' || s[i + 1]) THEN s[i] || s[i + 1] ELSE s[i] END), lambda x: x IS NOT NULL)"
)


def _best_pairs(source: str, by: str) -> str:
    """Pairs of each round, in order, that overlap no better one; words of no count, which only labels have, add nothing."""
    return f"""
  SELECT {by} a, b, c, row_number() OVER (PARTITION BY {by} 1 ORDER BY k) AS k FROM (
    SELECT r.*, (SELECT min(k) FROM r q WHERE q.a = r.b {'AND q.round = r.round' if by else ''}) AS x,
      (SELECT min(k) FROM r q WHERE q.b = r.a {'AND q.round = r.round' if by else ''}) AS y
    FROM r) WHERE c >= 2 AND (x IS NULL OR k < x) AND (y IS NULL OR k < y)
  QUALIFY row_number() OVER (PARTITION BY {by} 1 ORDER BY k) <= {SUBWORD_PAIRS}"""


def _ranked_pairs(source: str, by: str) -> str:
    return f"""r AS (
    SELECT *, row_number() OVER (PARTITION BY {by} 1 ORDER BY c DESC, a, b) AS k FROM (
      SELECT {by} x.a AS a, x.b AS b, sum(n)::BIGINT AS c FROM (SELECT {by} n, {_NEIGHBOURS} AS x FROM {source}) GROUP BY ALL))"""


SUBWORDS = f"""
words AS (SELECT unnest({TOKENS}) AS token FROM documents),
counted AS (SELECT token AS word, count(*) AS n FROM words GROUP BY token),
seen AS (
  SELECT * FROM counted
  UNION ALL SELECT w, 0 FROM (SELECT unnest(regexp_extract_all('{B} {CR} {N}', '[a-z]+')) AS w) WHERE w NOT IN (SELECT word FROM counted) GROUP BY w),
learned AS (
  SELECT 0 AS round, word, n, list_transform(range(1, length(word) + 1), lambda i: CASE WHEN i = 1 THEN '▁' ELSE '' END || word[i]) AS s FROM seen
  UNION ALL
  SELECT round + 1, word, n, {_JOINED}
  FROM learned, (
    WITH {_ranked_pairs('learned', '')} SELECT coalesce(list(a || '|' || b), []) AS m FROM ({_best_pairs('learned', '')}))
  WHERE round < {SUBWORD_ROUNDS}),
taken AS (WITH {_ranked_pairs(f'(SELECT * FROM learned WHERE round < {SUBWORD_ROUNDS})', 'round,')} {_best_pairs('', 'round,')}),
every AS (
  SELECT token, n, 0 AS round, row_number() OVER (ORDER BY n DESC, token) AS k FROM (
    SELECT token, sum(n)::BIGINT AS n FROM (SELECT unnest(s) AS token, n FROM learned WHERE round = 0 AND n > 0) GROUP BY token)
  UNION ALL SELECT a || b, c, round + 1, k FROM taken),
subwords AS (
  SELECT token, n, round, row_number() OVER (ORDER BY round, k) + 3 AS token_id
  FROM every QUALIFY row_number() OVER (PARTITION BY token ORDER BY round, k) = 1),
spelled AS (
  SELECT word, list(coalesce(token_id, 3) ORDER BY place) AS ids FROM (
    SELECT word, unnest(s) AS token, generate_subscripts(s, 1) AS place FROM learned WHERE round = {SUBWORD_ROUNDS})
  LEFT JOIN subwords USING (token) GROUP BY word)
"""


def _subword_ids(text: str, source: str, name: str) -> str:
    return f"""
spread_{name} AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM (SELECT doc_id, {TOKENS.replace('text', text)}[1:126] AS w FROM {source})),
ids_{name} AS (SELECT doc_id, flatten(list(ids ORDER BY place)) AS {name} FROM spread_{name} JOIN spelled USING (word) GROUP BY doc_id)"""


def _padded(ids: str, length: int) -> str:
    return f"""
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda x: 1)), ' ') AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range({length} - len(ids)), lambda x: 0)), ' ') AS attention_mask
FROM ({ids})"""


def _logit(multiplier: int) -> str:
    return f"(doc_id * {multiplier} % 11 - 5) / 2.0::DOUBLE"


def _log_softmax(names: list[str], temperature: float) -> list[str]:
    total = " + ".join(f"exp({n} / {temperature})" for n in names)
    return [f"({n} / {temperature} - ln({total}))" for n in names]


_T, _S = ["t0", "t1", "t2"], ["s0", "s1", "s2"]
_KL = " + ".join(
    f"exp({t}) * ({t} - {s})" for t, s in zip(_log_softmax(_T, 2.0), _log_softmax(_S, 2.0))
)
_CE = "-CASE doc_id % 3 " + " ".join(
    f"WHEN {i} THEN {s}" for i, s in enumerate(_log_softmax(_S, 1.0))
) + " END"

_SCORES = [f"CAST(doc_id * {m} % 5 AS DOUBLE) / 4.0" for m in (7, 3, 1)]


ORACLES: dict[str, str] = {
    "post_metrics": f"WITH {COMMENTS}, {POSTS} {POST_ROW}",
    "post_metrics_overall": f"WITH {COMMENTS}, {POSTS} {_overall('min(min_spread)', 1)}",
    "post_metrics_overall_compat": f"""
WITH {COMMENTS}, {POSTS} {_overall("max(CASE WHEN post_id = 'view' THEN min_spread END)", 2)}""",
    "metrics_report": f"""
WITH {COMMENTS}, {POSTS} {POST_ROW}
UNION ALL BY NAME SELECT 'aggregated' AS post_id, * FROM ({_overall('min(min_spread)', 1)})""",
    "authors_by_sketch": f"""
WITH {COMMENTS} SELECT post_id, count(DISTINCT author) + max(CAST(author IS NULL AS INT)) AS unique_authors FROM comments GROUP BY post_id
UNION ALL SELECT 'aggregated', count(DISTINCT author) + max(CAST(author IS NULL AS INT)) FROM comments""",
    "authors_shared": f"""
WITH {COMMENTS}, largest AS (SELECT post_id AS other FROM comments GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
known AS (SELECT DISTINCT author FROM comments JOIN largest ON post_id = other WHERE author IS NOT NULL)
SELECT c.post_id, other, count(DISTINCT k.author) AS shared_authors
FROM comments c CROSS JOIN largest LEFT JOIN known k USING (author) GROUP BY 1, 2""",
    "hourly_counts": f"""
WITH {COMMENTS} SELECT post_id, date_trunc('hour', ts) AS hour, count(*) AS n
FROM comments WHERE ts IS NOT NULL GROUP BY 1, 2""",
    "hourly_curve": f"""
WITH {COMMENTS}, hourly AS (
  SELECT post_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM comments WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT post_id, hour,
       date_diff('second', min(hour) OVER p, hour) / 3600.0::DOUBLE AS hours_since_first,
       n / CAST(max(n) OVER p AS DOUBLE) AS relative_n
FROM hourly WINDOW p AS (PARTITION BY post_id)""",
    "event_timeline": f"""
WITH {COMMENTS}, starts AS (SELECT post_id, min(ts) AS first_event FROM comments GROUP BY post_id)
SELECT post_id, ord, ts, {_minutes('first_event', 'ts')} AS offset_minutes
FROM comments JOIN starts USING (post_id) WHERE ts IS NOT NULL ORDER BY post_id, ts, ord""",
    "comment_time_parse": f"""
WITH {COMMENTS}
SELECT post_id, ord,
       CASE WHEN ord % 11 = 0 THEN 'n/a' WHEN ord % 5 = 0 THEN strftime(ts, '%m/%d/%y %H:%M')
            ELSE strftime(ts, '%m/%d/%Y %I:%M:%S %p') END AS comment_at,
       CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 5 = 0 THEN date_trunc('minute', ts)
            ELSE date_trunc('second', ts) END AS ts,
       CASE WHEN ord % 11 = 0 OR ord % 5 = 0 THEN NULL
            ELSE strptime(strftime(ts, '%m/%d/%Y %I:%M:%S'), '%m/%d/%Y %H:%M:%S') END AS ts_compat
FROM comments""",
    "row_ordinals": """
SELECT event_type AS post_id, event_id,
       row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS ord FROM events""",
    "distinct_authors": "SELECT DISTINCT user_id AS author FROM events",
    "stance_distribution": f"""
WITH {SCORED}, numbered AS (
  SELECT post_id, stance, row_number() OVER (PARTITION BY post_id ORDER BY ord) - 1 AS place FROM scored),
counted AS (SELECT post_id, stance, count(*) AS n FROM numbered WHERE place >= 1 GROUP BY post_id, stance)
SELECT post_id, stance, n,
       round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY post_id), 2) AS percentage
FROM counted ORDER BY post_id, n DESC, stance""",
    "stance_term_weights": f"""
WITH {ANNOTATED}, {NAIVE_BAYES}
SELECT term, round(ln((b + 1) / (tb + v)), 6) AS believes, round(ln((c + 1) / (tc + v)), 6) AS criticizes, round(ln((n + 1) / (tn + v)), 6) AS neutral
FROM counts, totals
UNION ALL SELECT '', round(ln((pb + 1) / (rows + 3)), 6), round(ln((pc + 1) / (rows + 3)), 6), round(ln((pn + 1) / (rows + 3)), 6) FROM priors""",
    "stance_scored": NAIVE_BAYES_STANCE,
    "stance_by_terms": NAIVE_BAYES_STANCE,
    "top_stance": f"""
WITH points AS (SELECT doc_id AS ord, {_SCORES[0]} AS b, {_SCORES[1]} AS c, {_SCORES[2]} AS n FROM documents)
SELECT ord,
       CASE WHEN b >= c AND b >= n THEN '{B}' WHEN c >= n THEN '{CR}' ELSE '{N}' END AS stance,
       greatest(b, c, n) AS confidence,
       CASE WHEN b >= 0.5 THEN '{B}' WHEN c >= 0.5 THEN '{CR}' WHEN n >= 0.5 THEN '{N}' END AS first_likely
FROM points""",
    "text_cues": f"""
WITH {SCORED}
SELECT post_id, ord, regexp_matches(content, '[{C.CUE_EMOJI}]') AS has_emoji,
       contains(content, '"') OR contains(content, '''') AS has_quotes,
       contains(content, '!') AS has_exclamation,
       regexp_matches(lower(content), 'not|no|never|fake|hoax') AS has_negation,
       contains(content, '?') AS has_question,
       regexp_matches(lower(content),
         '(^|[^\\p{{L}}\\p{{N}}_])(not|no|never|fake|hoax)([^\\p{{L}}\\p{{N}}_]|$)') AS has_negation_word,
       content IS NULL OR trim(content) = '' AS blank
FROM scored""",
    "explained": f"WITH {SCORED} SELECT post_id, ord, stance, {EXPLANATION} AS explanation FROM scored",
    "uncertain": f"WITH {SCORED}, {UNCERTAIN} SELECT * FROM uncertain",
    "suspects": f"""
WITH {SCORED}, {UNCERTAIN} SELECT * FROM uncertain WHERE sarcasm_score > 0.7
ORDER BY post_id, sarcasm_score DESC, ord""",
    "suspect_table": f"""
WITH {SCORED}, {UNCERTAIN}
SELECT post_id, ord, content, stance, confidence, sarcasm_score, explanation
FROM uncertain WHERE sarcasm_score > 0.7 ORDER BY post_id, confidence, ord""",
    "triage_counts": f"""
WITH {SCORED}
SELECT post_id, count(*) AS total, count(*) FILTER (confidence < 0.6) AS uncertain,
       count(*) FILTER (confidence < 0.6 AND sarcasm_score > 0.7) AS suspect
FROM scored GROUP BY post_id""",
    "sarcasm_counts": f"""
WITH {SCORED}, {UNCERTAIN} SELECT post_id, sarcasm_label, count(*) AS n FROM uncertain GROUP BY 1, 2""",
    "stance_sarcasm_crosstab": f"""
WITH {SCORED}, {UNCERTAIN}
SELECT post_id, stance, count(*) FILTER (sarcasm_label = 'irony' AND ord % 13 > 0) AS irony,
       count(*) FILTER (sarcasm_label = 'non_irony' AND ord % 13 > 0) AS non_irony, count(*) FILTER (ord % 13 = 0) AS other
FROM uncertain GROUP BY post_id, stance""",
    "triage_scatter": f"""
WITH {SCORED}, {UNCERTAIN}
SELECT post_id, ord, stance, confidence, sarcasm_score, sarcasm_label, content, explanation,
       sarcasm_score > 0.7 AS above_sarcasm, confidence < 0.6 AS below_confidence,
       sarcasm_score > 0.7 AND confidence < 0.6 AS is_suspect
FROM uncertain""",
    "sarcasm_scored": _sarcasm("1.0 - score"),
    "sarcasm_scored_compat": _sarcasm("score"),
    "impact_rows": f"""
WITH {COMMENTS}, {SCORED}, {IMPACT}
SELECT post_id, ord, stance, polarity, CAST(date AS VARCHAR) AS date, round(reactions_norm, 6) AS reactions_norm,
       round(sub_comments_norm, 6) AS sub_comments_norm, round(impact, 6) AS impact,
       round(adjusted_impact, 6) AS adjusted_impact
FROM impacts""",
    "comments_by_time": f"""
WITH {COMMENTS}, {SCORED}
SELECT s.post_id, ord, c.ts, s.stance FROM scored s JOIN comments c USING (ord)
ORDER BY s.post_id, c.ts NULLS LAST, ord""",
    "impact_daily": f"""
WITH {COMMENTS}, {SCORED}, {IMPACT}, days AS (
  SELECT post_id, date, coalesce(sum(adjusted_impact), 0.0) AS total
  FROM impacts WHERE date IS NOT NULL GROUP BY post_id, date)
SELECT post_id, CAST(date AS VARCHAR) AS date, round(total, 6) AS adjusted_impact,
       round(sum(total) OVER (PARTITION BY post_id ORDER BY date ROWS UNBOUNDED PRECEDING), 6)
         AS cumulative_impact
FROM days""",
    "impact_by_stance": f"""
WITH {COMMENTS}, {SCORED}, {IMPACT}
SELECT post_id, stance, round(avg(adjusted_impact), 6) AS mean_adjusted_impact
FROM impacts GROUP BY post_id, stance""",
    "impact_total": f"""
WITH {COMMENTS}, {SCORED}, {IMPACT}
SELECT post_id, round(coalesce(sum(adjusted_impact), 0.0), 6) AS impact_index FROM impacts GROUP BY post_id""",
    "impact_summary": f"WITH {COMMENTS}, {SCORED}, {IMPACT} {SUMMARY}",
    "impact_summary_compat": f"WITH {COMMENTS}, {SCORED}, {IMPACT_COMPAT} {SUMMARY}",
    "impact_top": f"WITH {COMMENTS}, {SCORED}, {IMPACT} {_top('DESC')}",
    "impact_top_weakening": f"WITH {COMMENTS}, {SCORED}, {IMPACT} {_top('ASC')}",
    "impact_box": f"WITH {COMMENTS}, {SCORED}, {IMPACT} {_box('post_id, stance')}",
    "impact_box_by_stance": f"WITH {COMMENTS}, {SCORED}, {IMPACT} {_box('stance')}",
    "impact_scatter": f"""
WITH {COMMENTS}, {SCORED}, {IMPACT}
SELECT post_id, ord, stance, sarcasm_score, round(adjusted_impact, 6) AS adjusted_impact, content FROM impacts""",
    "confusion": f"WITH {ANNOTATED}, {CONFUSION} SELECT predicted, actual, n FROM confusion",
    "confusion_wide": f"""
WITH {ANNOTATED}
SELECT stance AS predicted, count(*) FILTER (validation = '{B}') AS actual_believes,
       count(*) FILTER (validation = '{CR}') AS actual_criticizes,
       count(*) FILTER (validation = '{N}') AS actual_neutral, count(*) FILTER (validation IS NULL) AS actual_other
FROM files GROUP BY stance""",
    "annotation_metrics": f"""
WITH {ANNOTATED}, cells AS (
  SELECT CAST(count(*) FILTER (stance = '{B}' AND validation = '{B}') AS DOUBLE) AS pp,
         CAST(count(*) FILTER (stance = '{B}' AND validation = '{CR}') AS DOUBLE) AS pn,
         CAST(count(*) FILTER (stance = '{CR}' AND validation = '{B}') AS DOUBLE) AS np,
         CAST(count(*) FILTER (stance = '{CR}' AND validation = '{CR}') AS DOUBLE) AS nn,
         CAST(count(*) FILTER (stance = validation) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS total
  FROM annotated)
SELECT round(pn / (pn + pp), 6) AS false_negative_rate, round(np / (np + nn), 6) AS false_positive_rate,
       round((pp + nn) / total, 6) AS accuracy, round(pp / (pp + np), 6) AS precision,
       round(pp / (pp + pn), 6) AS recall,
       round(2 * (pp / (pp + np)) * (pp / (pp + pn)) / (pp / (pp + np) + pp / (pp + pn)), 6) AS f1,
       round(np / (np + pp), 6) AS textbook_false_negative_rate,
       round(pn / (pn + nn), 6) AS textbook_false_positive_rate,
       round(hits / total, 6) AS textbook_accuracy, round(pp / (pp + pn), 6) AS textbook_precision,
       round(pp / (pp + np), 6) AS textbook_recall
FROM cells""",
    "class_report": f"""
WITH {ANNOTATED}, names AS (SELECT stance AS label FROM annotated UNION SELECT validation FROM annotated),
sums AS (
  SELECT label, count(*) FILTER (stance = label AND validation = label) AS hit,
         count(*) FILTER (stance = label) AS said, count(*) FILTER (validation = label) AS support
  FROM names, annotated GROUP BY label),
ratios AS (
  SELECT label, hit, support, CASE WHEN said > 0 THEN hit / said::DOUBLE ELSE 0.0 END AS p,
         CASE WHEN support > 0 THEN hit / support::DOUBLE ELSE 0.0 END AS r FROM sums),
classes AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM ratios)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM classes
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support)::DOUBLE, 6), CAST(sum(support) AS BIGINT) FROM classes
UNION ALL
SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM classes
UNION ALL
SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6),
       round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM classes""",
    "validation_values": f"WITH {ANNOTATED} SELECT DISTINCT validation FROM files WHERE ord < 40",
    "missing_validation": f"""
WITH {ANNOTATED} SELECT post_id, ord, stance, content FROM files WHERE ord < 40 AND validation IS NULL""",
    "gold_labels": f"""
WITH {ANNOTATED} SELECT content AS text, validation AS stance FROM files WHERE ord < 40""",
    "training_set_a": f"""
WITH {ANNOTATED}, overridden AS (
  SELECT post_id, ord, content AS text, CASE WHEN ord < 40 THEN validation ELSE stance END AS stance FROM files)
SELECT post_id, ord, text, stance,
       CAST(CASE stance WHEN '{B}' THEN 0 WHEN '{N}' THEN 1 WHEN '{CR}' THEN 2 END AS INTEGER) AS labels
FROM overridden WHERE text IS NOT NULL AND stance IS NOT NULL""",
    "training_set_b": f"""
WITH {ANNOTATED}
SELECT doc_id, content AS text,
       CAST(CASE validation WHEN '{B}' THEN 0 WHEN '{CR}' THEN 1 WHEN '{N}' THEN 2 END AS INTEGER) AS label
FROM files WHERE content IS NOT NULL AND validation IS NOT NULL""",
    "training_parts": f"""
WITH {ANNOTATED}
SELECT doc_id, validation AS stance FROM annotated UNION ALL SELECT doc_id, stance FROM annotated""",
    "split_counts": f"""
WITH {ANNOTATED}, drawn AS (
  SELECT validation, CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) AS draw FROM annotated)
SELECT CASE WHEN draw < round(0.8 * 4294967296) THEN 'train' ELSE 'test' END AS split, validation, count(*) AS n
FROM drawn GROUP BY 1, 2""",
    "exact_splits": f"""
WITH {ANNOTATED}, placed AS (
  SELECT doc_id, validation, count(*) OVER () AS n, count(*) OVER (PARTITION BY validation) AS m,
    row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 15) AS BIGINT)) AS r,
    row_number() OVER (PARTITION BY validation ORDER BY CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT)) AS s
  FROM annotated)
SELECT doc_id, validation, CASE WHEN r <= floor(round(0.8 * n, 6) + 0.5) THEN 'train' ELSE 'test' END AS overall,
  CASE WHEN s <= floor(round(0.9 * m, 6) + 0.5) THEN 'train' ELSE 'test' END AS within_label
FROM placed""",
    "vocabulary": f"WITH {VOCABULARY} SELECT token, n, CAST(token_id AS INTEGER) AS token_id FROM vocabulary",
    "text_term_weights": f"""
WITH {ANNOTATED},
split AS (SELECT doc_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM annotated),
terms AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM split),
top AS (SELECT term FROM terms GROUP BY term ORDER BY count(*) DESC, term LIMIT 5000),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms JOIN top USING (term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (
  SELECT doc_id, term, tf * (ln(((SELECT count(*) FROM annotated) + 1) / (df + 1)) + 1) AS x FROM tf JOIN df USING (term))
SELECT doc_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""",
    "text_model_certificate": f"""
WITH {ANNOTATED},
train AS (
  SELECT doc_id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM annotated
  WHERE CAST('0x' || substr(md5('42:' || doc_id), 1, 8) AS BIGINT) < round(0.8 * 4294967296)),
terms AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM train)
SELECT (SELECT count(*) FROM train) AS n_rows, (SELECT least(5000, count(DISTINCT term)) FROM terms) AS n_terms, true AS at_optimum""",
    "fixed_length_encoding": f"""
WITH {VOCABULARY},
cut AS (SELECT doc_id, {TOKENS}[1:126] AS ws FROM documents),
spread AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) AS place FROM cut),
found AS (
  SELECT doc_id, list(coalesce(token_id, 3) ORDER BY place) AS ids
  FROM spread LEFT JOIN vocabulary USING (token) GROUP BY doc_id),
marked AS (
  SELECT doc_id, list_concat(list_concat([0], coalesce(ids, [])), [2]) AS ids
  FROM documents LEFT JOIN found USING (doc_id))
SELECT doc_id,
       array_to_string(list_concat(ids, list_transform(range(128 - len(ids)), lambda x: 1)), ' ') AS input_ids,
       array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(128 - len(ids)), lambda x: 0)), ' ')
         AS attention_mask
FROM marked""",
    "subword_vocabulary": f"""
WITH RECURSIVE {SUBWORDS} SELECT token, n, CAST(round AS INTEGER) AS round, CAST(token_id AS INTEGER) AS token_id FROM subwords""",
    "subword_encoding": f"""
WITH RECURSIVE {SUBWORDS}, {_subword_ids('text', 'documents', 'a')}
{_padded("SELECT doc_id, list_concat(list_concat([0], coalesce(a, [])[1:126]), [2]) AS ids FROM documents LEFT JOIN ids_a USING (doc_id)", 128)}""",
    "subword_pair_encoding": f"""
WITH RECURSIVE {ANNOTATED}, {SUBWORDS}, {_subword_ids('content', 'annotated', 'a')}, {_subword_ids('validation', 'annotated', 'b')},
both_ids AS (
  SELECT doc_id, coalesce(a, [])[1:60] AS a, coalesce(b, [])[1:60] AS b
  FROM annotated LEFT JOIN ids_a USING (doc_id) LEFT JOIN ids_b USING (doc_id)),
cut_b AS (SELECT doc_id, a, b[1:greatest(60 - len(a), 30)] AS b FROM both_ids),
cut_both AS (SELECT doc_id, a[1:60 - len(b)] AS a, b FROM cut_b)
{_padded("SELECT doc_id, flatten([[0], a, [2, 2], b, [2]]) AS ids FROM cut_both", 64)}""",
    "model_agreement": f"""
WITH logits AS (
  SELECT doc_id, {_logit(3)} AS t0, {_logit(5)} AS t1, {_logit(7)} AS t2,
         {_logit(2)} AS s0, {_logit(6)} AS s1, {_logit(10)} AS s2 FROM labels),
losses AS (SELECT {_CE} AS ce, 4.0 * ({_KL}) AS kl FROM logits)
SELECT count(*) AS n, round(avg(ce), 6) AS cross_entropy, round(avg(kl), 6) AS kl_divergence,
       round(avg(0.5 * ce + 0.5 * kl), 6) AS loss
FROM losses""",
}

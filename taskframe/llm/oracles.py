"""SQL that must give the rows of the queries that SQL can express."""

from __future__ import annotations

from taskframe.llm import quality_rules

TOP_K_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    WHERE q.vec_id % 50 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def quality_rules_sql() -> str:
    rules = quality_rules.RULES
    steps = " UNION ALL ".join(
        f"SELECT lang, n, '{r.name}' AS rule, {i} AS step, CAST({c} AS DOUBLE) AS cutoff, "
        f"sum(CAST({r.part} / greatest({r.whole}, 1) > {c} AS INT)) AS k FROM sized GROUP BY ALL"
        for r in rules for i, c in enumerate(r.cutoffs))
    chosen = ", ".join(f"min(cutoff) FILTER (rule = '{r.name}') AS max_{r.name}" for r in rules)
    failed = " OR ".join(
        f"coalesce({r.part} / greatest({r.whole}, 1) > max_{r.name}, false)" for r in rules)
    alpha, level = quality_rules.ALPHA / len(rules), quality_rules.DELTA / len(rules)
    return rf"""
WITH split AS (
    SELECT doc_id, row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT row, i, words[i:i + 4] AS w
    FROM split, unnest(range(1, len(words) - 3)) AS t(i) WHERE len(words) >= 5),
again AS (
    SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, w) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT row, count(DISTINCT i + k) AS n FROM again, unnest(range(5)) AS t(k) GROUP BY row),
counted AS (
    SELECT doc_id, lang, len(words) AS n_words,
           coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(covered.n, 0) AS n_repeat_words,
           length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper, len(lines) AS n_lines
    FROM split LEFT JOIN covered USING (row)),
based AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
good AS (
    SELECT * FROM based WHERE NOT base_failed AND doc_id IN (
        SELECT doc_id FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL
        GROUP BY doc_id HAVING min(quality) = 1)),
sized AS (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM good),
tried AS ({steps}),
tested AS (
    SELECT lang, rule, step, cutoff,
           CASE WHEN k > n * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:
               exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                   + j * ln({alpha}) + (n - j) * ln(1 - {alpha})))) END AS p
    FROM tried),
passed AS (
    SELECT *, p <= {level} / (SELECT count(DISTINCT lang) FROM good) AS ok FROM tested),
safe AS (
    SELECT * FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY step) AS upto FROM passed)
    WHERE upto),
chosen AS (SELECT lang, {chosen} FROM safe GROUP BY lang)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT ({failed}) AS kept
FROM based LEFT JOIN chosen USING (lang)
"""

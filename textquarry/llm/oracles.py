"""DuckDB SQL for the operators' queries."""

from __future__ import annotations

#: Whole-table SQL: all windows of all documents joined with all windows of all items.
OP6 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS r
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bi AS (
  SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM bi),
hits AS (
  SELECT r, i, m, item
  FROM (SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens WHERE len(w) >= m)) x
  JOIN bi USING (m, g)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

def op2() -> str:
    """The base counts by windows over exploded words, the ratios from the same table of thresholds."""
    from textquarry.llm.quality_rules import RULES, STOP_WORDS

    stops = ", ".join("'" + x + "'" for x in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        out = " OR ".join([f"{r.measure} < {r.low!r}"] * (r.low is not None) + [f"{r.measure} > {r.high!r}"] * (r.high is not None))
        tests.append(f"(n_words >= {r.words} AND ({out}))")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM rep GROUP BY r),
c AS (SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
        len(regexp_extract_all(text, '[|]')) AS n_bars, len(regexp_extract_all(text, '!')) AS n_exclamations,
        len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '\p{{Ll}}')) AS n_lower,
        len(list_distinct(list_transform(w, lambda x: lower(x)))) AS n_distinct, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words,
        len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis_lines
      FROM w LEFT JOIN cov USING (r)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_share,
        coalesce(n_bars / nullif(n_words, 0), 0) AS bar_share, coalesce(n_upper / nullif(n_upper + n_lower, 0), 0) AS upper_share,
        coalesce(n_exclamations / nullif(n_words, 0), 0) AS exclamation_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
        CASE WHEN n_words > 0 THEN 1 - n_distinct / n_words ELSE 0 END AS max_word_share, coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_share,
        coalesce(n_bullet_lines / nullif(n_lines, 0), 0) AS bullet_line_share, coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) AS ellipsis_line_share FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR {" OR ".join(tests)}) AS kept
FROM m
"""



def op11(rounds: int = 5) -> str:
    """Lloyd's rounds one after the other, every vector against every centroid."""
    fine = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(embedding) = 64"
    sql = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE {fine}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) - 1 AS c, e AS p FROM v QUALIFY c < 40),
i AS (SELECT unnest(range(1, 65)) AS i)"""
    nearest = "SELECT r, min(list_sum(list_transform(range(1, 65), lambda i: (e[i] - p[i]) * (e[i] - p[i]))) * 64 + c) AS m FROM v, c{n} GROUP BY r"
    for n in range(rounds):
        sql += f""",
a{n} AS MATERIALIZED ({nearest.format(n=n)}),
s{n} AS (SELECT CAST(m % 64 AS BIGINT) AS c, i, sum(e[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), i GROUP BY 1, 2),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m{n}.p, c{n}.p) AS p FROM c{n} LEFT JOIN m{n} USING (c))"""
    return sql + f""",
a AS MATERIALIZED ({nearest.format(n=rounds)}),
f AS (SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, CAST(m // 64 AS BIGINT) AS distance FROM a JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(p, ',')) AS centroid_sha256
FROM f JOIN c{rounds} ON c = cluster
"""


#: All windows of all documents; the first of each word sequence is its smallest (doc_id, start).
OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (SELECT r, i FROM (SELECT r, i, rank() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 20)) AS p FROM later)),
words AS (SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS t, count(*) AS n FROM words ANTI JOIN gone ON gone.r = words.r AND gone.p = words.p GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Every document's score for every item, from whole term counts.
OP13 = r"""
WITH lowered AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM lowered WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY 1, 2),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, totals GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 75 + ((75 * n * docs) // all_terms) AS m FROM d, totals),
q AS (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT k, item_id, term, count(*) AS times FROM q GROUP BY 1, 2, 3),
scored AS (SELECT k, item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN m USING (r) GROUP BY 1, 2, 3, 4)
SELECT item_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES: dict[str, str] = {"op2_quality_rules": op2(), "op6_decontamination": OP6, "op11_centroids": op11(), "op12_substring_dedup": OP12, "op13_ranked_search": OP13}

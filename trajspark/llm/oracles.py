"""SQL (DuckDB) of the queries that SQL can express."""

from trajspark.llm.url_filter import LISTED, RULES



def _level(above: str, here: str, weight: str, source: str, out: str) -> str:
    """One level of budgeting: ``source`` has the leaves with ``room`` and ``target``."""
    family = f"PARTITION BY {above}" if above else ""
    return f"""
{out}n AS (SELECT {here}, CAST(sum(room) AS HUGEINT) AS room, min(target) AS given, CAST(any_value({weight}) AS HUGEINT) AS w
  FROM {source} GROUP BY {here}),
{out}f AS (SELECT *, room * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= (given - coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS saturated
  FROM {out}n WINDOW o AS ({family} ORDER BY CAST(room AS DOUBLE) / w, {here.split(", ")[-1]})),
{out}s AS (SELECT {here}, CASE WHEN saturated THEN room
    ELSE (given - coalesce(sum(CASE WHEN saturated THEN room END) OVER ({family}), 0)) * w
      // sum(CASE WHEN NOT saturated THEN w END) OVER ({family}) END AS target FROM {out}f),
{out} AS (SELECT l.* EXCLUDE (target), s.target FROM {source} l JOIN {out}s s USING ({here}))"""


def mixing_sql(docs: str, percent: int, epochs: int, seed: int) -> str:
    """The mixture as a list of WITH tables that ends in ``mixed`` (doc_id, domain, lang, source, t, epoch, k)."""
    return (
        rf"""
b AS (SELECT *, coalesce(CAST(TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 3 AS VARCHAR), '') AS k0,
    coalesce(lang, '') AS k1, coalesce(source, '') AS k2,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda w: w <> '')) AS t FROM {docs}),
l AS (SELECT k0, k1, k2, sum(t) AS tokens, sum(t) * {epochs} AS room FROM b GROUP BY ALL),
l0 AS (SELECT *, (SELECT least(sum(tokens) * {percent} // 100, sum(tokens) * {epochs}) FROM l) AS target FROM l),"""
        + _level("", "k0", "1", "l0", "l1")
        + ","
        + _level("k0", "k0, k1", "CASE k1 WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "l1", "l2")
        + ","
        + _level("k0, k1", "k0, k1, k2", "CASE k2 WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 ELSE 1 END", "l2", "l3")
        + rf""",
p AS (SELECT *, CASE WHEN tokens > 0 THEN target // tokens ELSE 0 END AS whole FROM l3),
q AS (SELECT b.*, whole, target - whole * tokens AS rest,
    CAST('0x' || substr(md5('{seed}:' || whole || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM b JOIN p USING (k0, k1, k2)),
c AS (SELECT *, sum(t) OVER (PARTITION BY k0, k1, k2 ORDER BY h, doc_id, t ROWS UNBOUNDED PRECEDING) AS upto FROM q),
mixed AS (SELECT *, CAST(unnest(range(0, CAST(whole + CASE WHEN whole < {epochs} AND upto <= rest THEN 1 ELSE 0 END AS BIGINT))) AS INTEGER) AS epoch FROM c)"""
    )


_ENTRIES = ", ".join(
    [f"('{e}', '{v}', true)" for e, v in RULES] + [f"('{e}', '{v}', false)" for e, v in LISTED]
)

SQL = {
    "op5_url_filter": f"WITH e(entry, verdict, is_rule) AS (VALUES {_ENTRIES}),"
    + r"""
x AS (SELECT *, split_part(entry, '/', 1) AS eh, substr(entry, strpos(entry, '/')) AS ep FROM e),
a AS (SELECT row_number() OVER () AS r, page_id,
  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT r, is_rule, max_by(entry, length(entry) * 1000 + length(eh)) AS entry, max_by(verdict, length(entry) * 1000 + length(eh)) AS verdict
  FROM p JOIN x ON (host = eh OR ends_with(host, '.' || eh)) AND starts_with(path, ep) GROUP BY ALL)
SELECT page_id, host, path, u.entry AS rule, coalesce(u.verdict, l.verdict, 'allow') AS verdict
FROM p LEFT JOIN (FROM f WHERE is_rule) u USING (r) LEFT JOIN (FROM f WHERE NOT is_rule) l USING (r)
""",
    "op10_mixing": "WITH "
    + mixing_sql("documents", 60, 2, 11)
    + " SELECT doc_id, lang, source, CAST(t AS BIGINT) AS n_tokens, epoch FROM mixed",
    "op13_hard_negatives": """
WITH u AS (SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM u a JOIN u b ON a.vec_id % 50 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same AND vec_id <> anchor_id QUALIFY place <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
""",
    "op2_quality": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c
  FROM (SELECT r, i, list_slice(words, i, i + 4) AS gram
        FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM s WHERE len(words) >= 5))),
p AS (
  SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(words, lambda w: NOT regexp_matches(w, '[A-Za-z\x{80}-\x{10FFFF}]'))) AS letterless,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^[\x20\x09]*[-*\x{2022}]\x20'))) AS bullets,
    len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '(\.\.\.|\x{2026})$'))) AS ellipses
  FROM s LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > n_words
    OR 10 * n_dup_lines > 3 * n_lines
    OR 10 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > 3 * word_chars
    OR 10 * letterless > 3 * n_words OR 10 * bullets > 9 * n_lines OR 10 * ellipses > 3 * n_lines) AS kept
FROM f
""",
}

"""SQL of the clusterings and profiles: greedy joins, exchanges and moving centres as recursive tables.

Distances between rows of the correlation matrix are ``(u_i - u_j)' G (u_i - u_j)`` for the
unit vectors ``u`` of the clones and ``G`` the sum of ``u u'``.
"""

from __future__ import annotations

from trajspark.schema import N_CLUSTERS

# unit vectors ``u0``, ``u1`` ... of the clones with defined correlations
UNITS = {
    "pearson": (
        4,
        """centred AS (
  SELECT clone_id, timepoint // 3 AS d, z - avg(z) OVER (PARTITION BY clone_id) AS x FROM scaled
  WHERE clone_id IN (SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) > min(z)))""",
    ),
    "kendall": (
        6,
        """centred AS (
  SELECT a.clone_id, row_number() OVER (PARTITION BY a.clone_id ORDER BY a.timepoint, b.timepoint) - 1 AS d,
    CAST(sign(b.z - a.z) AS DOUBLE) AS x
  FROM scaled a JOIN scaled b ON a.clone_id = b.clone_id AND a.timepoint < b.timepoint
  WHERE a.clone_id IN (SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) > min(z)))""",
    ),
}


def columns(width: int, pattern: str, joint: str = ", ") -> str:
    return joint.join(pattern.format(d=d) for d in range(width))


def form(width: int, left: str, right: str, matrix: str) -> str:
    """``left' matrix right`` of two rows of columns."""
    return " + ".join(
        f"({left.format(d=a)}) * ({right.format(d=b)}) * {matrix}{min(a, b)}_{max(a, b)}" for a in range(width) for b in range(width)
    )


def sums(width: int, name: str, weight: str) -> str:
    return ", ".join(f"sum({weight} * u{a} * u{b}) AS {name}{a}_{b}" for a in range(width) for b in range(a, width))


def units(correlation: str) -> tuple[int, str]:
    """Different vectors ``p`` with their number ``w`` and place ``i``, and the clones' places."""
    width, centred = UNITS[correlation]
    wide = columns(width, "max(CASE WHEN d = {d} THEN x / length END) AS u{d}")
    each = columns(width, "u{d}")
    return width, f"""{centred},
lengths AS (SELECT clone_id, sqrt(sum(x * x)) AS length FROM centred GROUP BY clone_id),
un AS (SELECT clone_id, {wide} FROM centred JOIN lengths USING (clone_id) GROUP BY clone_id),
p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) AS i FROM (
  SELECT {each}, count(*) AS w, min(clone_id) AS first FROM un GROUP BY {each})),
member AS (SELECT un.clone_id, p.i FROM un JOIN p USING ({each}))"""


def correlation_rows(width: int) -> str:
    return f"g AS MATERIALIZED (SELECT {sums(width, 'g', 'w')}, sum(w) AS n FROM p)"


def standardised_rows(width: int) -> str:
    """As ``g``, with every column of the matrix divided by its deviation."""
    covariance = ", ".join(
        f"sum(w * u{a} * u{b}) / sum(w) - sum(w * u{a}) * sum(w * u{b}) / sum(w) / sum(w) AS s{a}_{b}"
        for a in range(width)
        for b in range(a, width)
    )
    variance = form(width, "u{d}", "u{d}", "s")
    return f"""s AS MATERIALIZED (SELECT {covariance}, {columns(width, 'sum(w * u{d}) / sum(w) AS m{d}')} FROM p),
prec AS MATERIALIZED (SELECT p.*, CASE WHEN {variance} > 1e-12 THEN 1 / ({variance}) ELSE 0 END AS r FROM p, s),
g AS MATERIALIZED (SELECT {sums(width, 'g', 'w * r')}, sum(w) AS n FROM prec)"""


def ward_steps(width: int, clusters: int = N_CLUSTERS) -> str:
    """``cut``: place and cluster of every vector; a cluster is named by its first place."""
    gap = form(width, "a.u{d} - b.u{d}", "a.u{d} - b.u{d}", "g.g")
    means = columns(width, "sum(p.w * u{d}) / sum(p.w) AS u{d}")
    return f"""steps(step, i, c) AS (
  SELECT 0, i, i FROM p
  UNION ALL
  SELECT step + 1, i, CASE WHEN c = best.b THEN best.a ELSE c END FROM steps, (
    WITH centre AS MATERIALIZED (SELECT c, sum(p.w) AS w, {means} FROM steps JOIN p USING (i) GROUP BY c)
    SELECT a.c AS a, b.c AS b FROM centre a JOIN centre b ON a.c < b.c, g
    WHERE (SELECT count(*) FROM centre) > {clusters}
    ORDER BY round(2 * a.w * b.w / (a.w + b.w) * ({gap}) / g.n, 9), a.c, b.c LIMIT 1) best),
cut AS (SELECT i, c FROM steps WHERE step = (SELECT max(step) FROM steps))"""


def medoid_steps(width: int, clusters: int = N_CLUSTERS) -> str:
    """``held``: places of the medoids; ``cut``: every vector's place, medoid and distance."""
    gap = form(width, "a.u{d} - b.u{d}", "a.u{d} - b.u{d}", "g.g")
    return f"""far AS MATERIALIZED (SELECT a.i, b.i AS j, a.w, sqrt(greatest({gap}, 0)) AS d FROM p a, p b, g),
tries(step, held, cost) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST('Infinity' AS DOUBLE)
  UNION ALL
  SELECT * FROM (
    WITH m AS (SELECT unnest(held) AS m, generate_subscripts(held, 1) AS place FROM tries),
    near AS MATERIALIZED (
      SELECT p.i, coalesce(min(d), CAST('Infinity' AS DOUBLE)) AS n1, arg_min(m, d) AS owner,
        coalesce(list_sort(list(d) FILTER (d IS NOT NULL))[2], CAST('Infinity' AS DOUBLE)) AS n2
      FROM p LEFT JOIN (SELECT far.i, d, m FROM far JOIN m ON far.j = m.m) x ON x.i = p.i GROUP BY p.i),
    offers AS (
      SELECT len(held) + 1 AS place, j, sum(w * least(n1, d)) AS c FROM tries, far JOIN near USING (i)
      WHERE len(held) < least({clusters}, (SELECT count(*) FROM p)) AND j NOT IN (SELECT m FROM m) GROUP BY ALL
      UNION ALL
      SELECT place, j, sum(w * CASE WHEN owner = m THEN least(n2, d) ELSE least(n1, d) END) FROM tries, far JOIN near USING (i), m
      WHERE len(held) = {clusters} AND j NOT IN (SELECT m FROM m) GROUP BY place, m, j),
    best AS (SELECT * FROM offers ORDER BY round(c, 9), place, j LIMIT 1)
    SELECT step + 1 AS step, list_concat(list_append(held[:place - 1], j), held[place + 1:]) AS held, c AS cost
    FROM tries, best WHERE place > len(held) OR c < cost - 1e-9 * greatest(1, cost))),
held AS (SELECT unnest(held) AS m, generate_subscripts(held, 1) AS place FROM tries WHERE step = (SELECT max(step) FROM tries)),
cut AS (
  SELECT i, arg_min(m, (round(d, 9), place)) AS c, min(d) AS d FROM far JOIN held ON j = m GROUP BY i)"""


def consolidated(width: int, passes: int) -> str:
    """Centres moved ``passes`` times, and ``cut`` with the order of the centres on the first axis."""
    gap = form(width, "p.u{d} - t.u{d}", "p.u{d} - t.u{d}", "g.g")
    nearest = f"SELECT p.i, arg_min(t.c, {gap}) AS c FROM p, {{}} t, g GROUP BY p.i"
    applied = [f"({' + '.join(f's.s{min(a, b)}_{max(a, b)} * x{b}' for b in range(width))})" for a in range(width)]
    turned = [f"({' + '.join(f'g.g{min(a, b)}_{max(a, b)} * {applied[b]}' for b in range(width))})" for a in range(width)]
    length = " + ".join(f"y{a} * y{a}" for a in range(width))
    score = " + ".join(f"(t.u{a} - s.m{a}) * x{a}" for a in range(width))
    loading = " + ".join(f"u{a} * {applied[a]}" for a in range(width))
    means = columns(width, "sum(p.w * p.u{d}) / sum(p.w) AS u{d}")
    return f"""moves(pass, c, {columns(width, 'u{d}')}) AS (
  SELECT 0, c, {means} FROM cut JOIN p USING (i) GROUP BY c
  UNION ALL
  SELECT t.pass + 1, t.c, {columns(width, 'coalesce(m.u{d}, t.u{d})')} FROM moves t LEFT JOIN (
    SELECT near.c, {means} FROM ({nearest.format('moves')}) near JOIN p USING (i) GROUP BY near.c) m ON m.c = t.c
  WHERE t.pass < {passes}),
final AS MATERIALIZED (SELECT * FROM moves WHERE pass = {passes}),
axis(step, {columns(width, 'x{d}')}) AS (
  SELECT 0, {columns(width, 'CAST(1 + {d} / 10 AS DOUBLE)')}
  UNION ALL
  SELECT step + 1, {columns(width, 'y{d} / sqrt(' + length + ')')} FROM (
    SELECT step, {', '.join(f'{turned[a]} AS y{a}' for a in range(width))} FROM axis, s, g) WHERE step < 300),
sign AS (SELECT CASE WHEN sum(w * sqrt(r) * ({loading})) < 0 THEN -1 ELSE 1 END AS way FROM prec, axis, s WHERE step = 300),
numbered AS (
  SELECT t.c, row_number() OVER (ORDER BY way * ({score})) AS number FROM final t, axis, s, sign WHERE step = 300),
nearest AS ({nearest.format('final')})"""


def _labels(method: str, correlation: str = "pearson") -> str:
    width, found = units(correlation)
    if method == "hcpc":
        parts = [found, standardised_rows(width), ward_steps(width), consolidated(width, 10)]
        return ",\n".join([*parts, "named AS (SELECT i, number FROM nearest JOIN numbered USING (c))"])
    cut = ward_steps(width) if method == "hclust" else medoid_steps(width)
    number = "named AS (SELECT i, dense_rank() OVER (ORDER BY first) AS number FROM (SELECT i, min(i) OVER (PARTITION BY c) AS first FROM cut))"
    return ",\n".join([found, correlation_rows(width), cut, number])


def profile_sql(labelled: str, least: float) -> dict[str, str]:
    """SQL of the queries on clones that share or nearly share a vector."""

    def pairs(correlation: str) -> str:
        width, found = units(correlation)
        product = columns(width, "a.u{d} * b.u{d}", " + ")
        return f"""WITH {labelled},
{found}
SELECT clone_id, other_id, clones, others, round(cor, 6) AS cor FROM (
  SELECT a.first AS clone_id, b.first AS other_id, a.w AS clones, b.w AS others, {product} AS cor
  FROM p a JOIN p b ON a.first < b.first) WHERE abs(cor) >= {least}"""

    return {
        "corr_pairs": pairs("pearson"),
        "corr_pairs_kendall": pairs("kendall"),
        "corr_profile_members": f"""WITH {labelled},
{units('pearson')[1]}
SELECT clone_id, first AS profile FROM member JOIN p USING (i)""",
    }


def clustering_sql(labelled: str, custom_order: list[int]) -> dict[str, str]:
    """SQL of the clustering queries; ``labelled`` are the tables that end in ``scaled`` shares."""
    plain = "SELECT clone_id, 'Traj ' || number AS k FROM member JOIN named USING (i)"
    position = " ".join(f"WHEN {c} THEN {place}" for place, c in enumerate(custom_order, 1))
    moved = f"SELECT clone_id, 'Traj ' || CASE number {position} END AS k FROM member JOIN named USING (i)"
    medoids = """SELECT 'Traj ' || number AS k, m.first AS medoid, count(*) AS n, round(sum(d), 6) AS distance
FROM member JOIN named USING (i) JOIN cut USING (i) JOIN p m ON m.i = cut.c GROUP BY ALL"""
    width, _ = units("pearson")
    inner = form(width, "p.u{d} - t.u{d}", "p.u{d} - t.u{d}", "g.g")
    means = columns(width, "sum(p.w * u{d}) / sum(p.w) AS u{d}")
    loss = f"""SELECT CAST(n AS BIGINT) AS clones, CAST(0 AS DOUBLE) AS lost, round(
  (SELECT sum(p.w * ({inner})) FROM p JOIN cut USING (i) JOIN (SELECT c, {means} FROM cut JOIN p USING (i) GROUP BY c) t USING (c), g)
  / (SELECT sum(p.w * ({inner})) FROM p, (SELECT {means} FROM p) t, g), 6) AS within FROM g"""

    def sql(method: str, correlation: str = "pearson", select: str = plain) -> str:
        return f"WITH RECURSIVE {labelled},\n{_labels(method, correlation)}\n{select}"

    return {
        "traj_hclust": sql("hclust"),
        "traj_hclust_kendall": sql("hclust", "kendall"),
        "traj_hclust_custom": sql("hclust", select=moved),
        "traj_pam": sql("pam"),
        "traj_pam_custom": sql("pam", select=moved),
        "traj_hcpc": sql("hcpc"),
        "traj_medoids": sql("pam", select=medoids),
        "traj_ward_loss": sql("hclust", select=loss),
    }

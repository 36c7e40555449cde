"""SQL texts that give the results of ``trajspark.plans.catalog`` on the same tables.

Written from the meaning of each operator with joins and windows over long tables, not
from the Spark plans. The texts share common table expressions.
"""

from __future__ import annotations

from trajspark.plans import catalog as q
from trajspark.plans.clusterings import clustering_sql, profile_sql

TIMES = "(VALUES (0), (3), (6), (9))"


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def r(expression: str, name: str | None = None) -> str:
    """Six decimal places, without a negative zero."""
    rounded = f"round(CAST({expression} AS DOUBLE), 6)"
    text = f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END"
    return f"{text} AS {name or expression}"


CELLS = """cells AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER)) AS barcode,
    concat_ws('-', l_orderkey, l_linenumber) AS short_barcode,
    n_name AS patient_alias, r_name AS treatment,
    CASE n_nationkey % 5 WHEN 0 THEN 'CR' WHEN 1 THEN 'PR' WHEN 2 THEN 'SD' WHEN 3 THEN 'PD' END AS response,
    CASE WHEN year(l_shipdate) = 1995 THEN 'Baseline'
      ELSE 'Follow Up ' || CAST(year(l_shipdate) - 1995 AS VARCHAR) END AS timepoint_label,
    CAST((year(l_shipdate) - 1995) * 3 AS INTEGER) AS timepoint,
    nullif(p_brand, 'Brand#13') AS tra, nullif(p_type, 'PROMO') AS trb, p_brand AS trb_aa,
    l_returnflag || l_linestatus AS ctype,
    CAST(greatest(CAST(l_quantity AS INTEGER) - 47, 0) AS INTEGER) AS mki67,
    l_discount >= 0.09 AS flagged
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

ALL_BASE = f"""{CELLS},
tps(timepoint) AS {TIMES},
all_base AS (
  SELECT *, patient_alias || ':' || tra || ':' || trb AS clone_id FROM cells
  WHERE timepoint IN (SELECT timepoint FROM tps) AND tra IS NOT NULL AND trb IS NOT NULL)"""

BASE = f"""{ALL_BASE},
base AS (SELECT * FROM all_base)"""

# all cells of all weeks; the clone is null where a chain is missing
WHOLE = f"""{CELLS},
base AS (SELECT *, patient_alias || ':' || tra || ':' || trb AS clone_id FROM cells),
tps AS (SELECT DISTINCT timepoint FROM (SELECT timepoint FROM base UNION ALL FROM {TIMES} t(timepoint)))"""

# cells of samples with enough cells; the others are missing samples
FLOOR_BASE = f"""{ALL_BASE},
base AS (
  SELECT b.* FROM all_base b JOIN (
    SELECT patient_alias, timepoint FROM all_base GROUP BY patient_alias, timepoint
    HAVING count(*) >= {q.FLOOR}) s USING (patient_alias, timepoint))"""

STATS = """clones AS (SELECT DISTINCT patient_alias, treatment, response, trb_aa, clone_id FROM base),
counts AS (SELECT clone_id, timepoint, count(*) AS n FROM base GROUP BY clone_id, timepoint),
totals AS (
  SELECT patient_alias, treatment, timepoint, count(*) AS n_tcells_tp FROM base
  GROUP BY patient_alias, treatment, timepoint),
filled AS (
  SELECT c.*, t.timepoint, s.n_tcells_tp,
    CASE WHEN s.n_tcells_tp IS NOT NULL THEN coalesce(k.n, 0) END AS n
  FROM clones c CROSS JOIN tps t
    LEFT JOIN totals s ON s.patient_alias = c.patient_alias AND s.treatment = c.treatment
      AND s.timepoint = t.timepoint
    LEFT JOIN counts k ON k.clone_id = c.clone_id AND k.timepoint = t.timepoint),
shares AS (SELECT *, CAST(n AS DOUBLE) / n_tcells_tp * 100 AS perc FROM filled),
stats AS (
  SELECT *, max(n) OVER w AS n_max, min(n) OVER w AS n_min, max(n) OVER w - min(n) OVER w AS range,
    max(perc) OVER w - min(perc) OVER w AS range_perc
  FROM shares WINDOW w AS (PARTITION BY clone_id)),
stepped AS (SELECT *, lag(perc) OVER (PARTITION BY clone_id ORDER BY timepoint) AS prev FROM stats),
dyn AS (
  SELECT *,
    CASE WHEN prev IS NULL OR perc IS NULL OR (prev = 0 AND perc = 0) THEN 1.0
      WHEN prev = 0 THEN CAST('Infinity' AS DOUBLE) ELSE perc / prev END AS delta_fc,
    coalesce(perc - prev, 0.0) AS delta_c, (perc + prev) / 2 AS avg_freq
  FROM stepped),
extremes AS (
  SELECT *, max(perc) OVER w AS high, min(perc) OVER w AS low
  FROM stats WINDOW w AS (PARTITION BY clone_id)),
peaks AS (
  SELECT clone_id, min(CASE WHEN perc = high THEN timepoint END) AS timepoint_max,
    min(CASE WHEN perc = low THEN timepoint END) AS timepoint_min
  FROM extremes GROUP BY clone_id),
dynamic AS (
  SELECT DISTINCT d.clone_id FROM dyn d JOIN peaks p ON p.clone_id = d.clone_id
  WHERE (d.delta_fc > 2 AND d.delta_c > 0.25 AND p.timepoint_max <> 0)
    OR (d.delta_fc < 0.5 AND d.delta_c < -0.25 AND p.timepoint_max = 0))"""

LABELS = """mat AS (
  SELECT s.clone_id, s.timepoint, coalesce(s.perc, 0.0) AS x
  FROM stats s JOIN dynamic d ON d.clone_id = s.clone_id WHERE s.n_max >= 5),
scaled AS (
  SELECT clone_id, timepoint,
    (x - avg(x) OVER (PARTITION BY timepoint)) / stddev_samp(x) OVER (PARTITION BY timepoint) AS z
  FROM mat),
tops AS (SELECT *, max(z) OVER (PARTITION BY clone_id) AS top FROM scaled),
labels AS (
  SELECT clone_id, 'Traj ' || CAST(min(timepoint) // 3 + 1 AS VARCHAR) AS k FROM tops
  WHERE z = top GROUP BY clone_id),
stats_k AS (
  SELECT s.*, coalesce(l.k, 'Other') AS k, CAST(substr(l.k, 6) AS INTEGER) AS kn
  FROM stats s LEFT JOIN labels l ON l.clone_id = s.clone_id),
clones_k AS (
  SELECT DISTINCT patient_alias, treatment, response, trb_aa, clone_id, n_max, k, kn FROM stats_k),
stacked AS (
  SELECT *, row_number() OVER (ORDER BY kn, n_max, clone_id) AS clone_ord,
    row_number() OVER (PARTITION BY k ORDER BY n_max, clone_id) AS clone_rank
  FROM clones_k WHERE k <> 'Other')"""

LABELLED = f"""{BASE},
{STATS},
{LABELS}"""

ALLOWLIST = """allowed AS (
  SELECT DISTINCT n_name AS patient_alias, p_brand AS trb_aa
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey WHERE p_size >= 45)"""


def over(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


FOLD_CHANGE = (
    r("CASE WHEN delta_fc < CAST('Infinity' AS DOUBLE) THEN delta_fc END", "delta_fc")
    + ", delta_fc = CAST('Infinity' AS DOUBLE) AS from_zero"
)
WIDE = ", ".join(r(f"max(CASE WHEN timepoint = {t} THEN x END)", f"t{t}") for t in (0, 3, 6, 9))

SOURCES = {
    "expr_gene_lookup": over(CELLS, "SELECT barcode, ctype AS metaclusters_exh, mki67 FROM cells"),
    "stats_csv_roundtrip": over(
        f"{BASE},\n{STATS}",
        f"SELECT patient_alias, treatment, clone_id, timepoint, n, n_max, {r('perc')}, {r('delta_c')}, {FOLD_CHANGE} FROM dyn",
    ),
    "cells_reread": over(
        f"{CELLS},\n{ALLOWLIST}",
        """SELECT patient_alias, trb_aa AS "TRB_chain_cdr3", timepoint_label, response, count(*) AS n
FROM cells JOIN allowed USING (patient_alias, trb_aa) GROUP BY ALL""",
    ),
    "stage_roundtrip": over(
        f"{BASE},\n{STATS}", f"SELECT clone_id, timepoint, n, {r('perc')}, {r('delta_c')} FROM dyn"
    ),
    "observed_timepoints": over(
        WHOLE, "SELECT timepoint, count(*) AS n, row_number() OVER (ORDER BY timepoint) AS place FROM base GROUP BY timepoint"
    ),
    "run_summary": over(
        LABELLED,
        """SELECT 'cells' AS measure, count(*) AS value FROM base
UNION ALL SELECT 'cells_with_clone', count(clone_id) FROM base
UNION ALL SELECT 'cells_labelled', count(*) FROM base WHERE clone_id IN (SELECT clone_id FROM labels)
UNION ALL SELECT 'clones', count(*) FROM clones
UNION ALL SELECT 'clones_labelled', count(*) FROM labels
UNION ALL SELECT 'clones_selected', count(DISTINCT clone_id) FROM mat
UNION ALL SELECT 'clones_undefined', count(*) FROM (
  SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) = min(z))""",
    ),
}

CLEANING = {
    "timepoint_recode": over(
        CELLS,
        """SELECT timepoint_label, CAST(timepoint AS VARCHAR) AS timepoint, count(*) AS n
FROM cells GROUP BY timepoint_label, timepoint""",
    ),
    "exclude_subjects": over(
        CELLS,
        f"""SELECT patient_alias, count(*) AS n FROM cells
WHERE patient_alias NOT IN ({listed(q.DROPPED_PATIENTS)}) GROUP BY patient_alias""",
    ),
    "timepoint_subset": over(
        CELLS,
        """SELECT patient_alias, timepoint, CAST(timepoint // 3 AS INTEGER) AS tp_idx, count(*) AS n
FROM cells WHERE timepoint IN (0, 3, 6, 9) GROUP BY patient_alias, timepoint""",
    ),
    "paired_chain_filter": over(
        CELLS,
        """SELECT tra || trb || patient_alias AS tcr_name, count(*) AS n FROM cells
WHERE tra IS NOT NULL AND trb IS NOT NULL GROUP BY tra || trb || patient_alias""",
    ),
    "sample_counts": over(
        WHOLE,
        """SELECT p.patient_alias, t.timepoint, count(b.barcode) AS n
FROM (SELECT DISTINCT patient_alias FROM base) p CROSS JOIN tps t
  LEFT JOIN base b ON b.patient_alias = p.patient_alias AND b.timepoint = t.timepoint
GROUP BY p.patient_alias, t.timepoint""",
    ),
    "sample_qc": over(
        BASE,
        f"""SELECT patient_alias, treatment, timepoint, count(*) AS n FROM base
WHERE patient_alias IN (SELECT patient_alias FROM base WHERE treatment = '{q.EXEMPT}')
  OR patient_alias NOT IN (
    SELECT p.patient_alias FROM (SELECT DISTINCT patient_alias FROM base) p CROSS JOIN tps t
      LEFT JOIN base b ON b.patient_alias = p.patient_alias AND b.timepoint = t.timepoint
    GROUP BY p.patient_alias, t.timepoint HAVING count(b.barcode) < {q.FLOOR})
GROUP BY patient_alias, treatment, timepoint""",
    ),
    "treatment_counts": over(
        WHOLE,
        """SELECT p.patient_alias, r_name AS treatment, count(b.barcode) AS n
FROM (SELECT DISTINCT patient_alias FROM base) p CROSS JOIN region
  LEFT JOIN base b ON b.patient_alias = p.patient_alias AND b.treatment = r_name
GROUP BY p.patient_alias, r_name""",
    ),
    "contingency3": over(
        WHOLE,
        """SELECT p.patient_alias, t.timepoint, r_name AS treatment, count(b.barcode) AS n
FROM (SELECT DISTINCT patient_alias FROM base) p CROSS JOIN tps t CROSS JOIN region
  LEFT JOIN base b ON b.patient_alias = p.patient_alias AND b.treatment = r_name AND b.timepoint = t.timepoint
GROUP BY p.patient_alias, t.timepoint, r_name""",
    ),
}

KEYED = f"""{CELLS},
keyed AS (SELECT short_barcode AS barcode, patient_alias || ':' || tra || ':' || trb AS clone_id FROM cells)"""

CLONES = {
    "clone_assign": over(WHOLE, "SELECT barcode, patient_alias, timepoint, clone_id FROM base"),
    "clone_key_nt": over(KEYED, "SELECT clone_id, count(*) AS n FROM keyed GROUP BY clone_id"),
    "clone_key_aa": over(
        CELLS,
        """SELECT clone_id, count(*) AS n FROM (
  SELECT CASE WHEN position('0' IN trb_aa) = 0 THEN patient_alias || ':' || trb_aa END AS clone_id FROM cells)
GROUP BY clone_id""",
    ),
    "clone_assign_aa": over(
        f"""{CELLS},
keyed AS (
  SELECT short_barcode AS barcode,
    CASE WHEN position('0' IN trb_aa) = 0 THEN patient_alias || ':' || trb_aa END AS clone_id FROM cells)""",
        """SELECT k.barcode, j.clone_id, count(*) AS n FROM keyed k LEFT JOIN (
  SELECT barcode, string_agg(clone_id, '|' ORDER BY clone_id) AS clone_id
  FROM (SELECT DISTINCT barcode, clone_id FROM keyed WHERE clone_id IS NOT NULL) GROUP BY barcode) j
  ON j.barcode = k.barcode
GROUP BY k.barcode, j.clone_id""",
    ),
    "receptor_columns_dropped": over(
        CELLS,
        "SELECT barcode, patient_alias, timepoint_label, treatment, response, ctype AS metaclusters_exh FROM cells",
    ),
    "ambiguous_count": over(
        KEYED, "SELECT count(*) - count(DISTINCT barcode) AS n_ambiguous FROM keyed WHERE clone_id IS NOT NULL"
    ),
    "ambiguity_combine": over(
        KEYED,
        """SELECT k.barcode, j.clone_id, count(*) AS n FROM keyed k LEFT JOIN (
  SELECT barcode, string_agg(clone_id, '|' ORDER BY clone_id) AS clone_id
  FROM (SELECT DISTINCT barcode, clone_id FROM keyed WHERE clone_id IS NOT NULL) GROUP BY barcode) j
  ON j.barcode = k.barcode
GROUP BY k.barcode, j.clone_id""",
    ),
    "ambiguity_drop": over(
        KEYED,
        """SELECT barcode, clone_id, count(*) AS n FROM (
  SELECT barcode, CASE WHEN count(clone_id) OVER (PARTITION BY barcode) <= 1 THEN clone_id END AS clone_id FROM keyed)
GROUP BY barcode, clone_id""",
    ),
}

ABUNDANCE = {
    "min_sample_cells": over(
        WHOLE,
        f"SELECT patient_alias, timepoint, count(*) AS n FROM base GROUP BY patient_alias, timepoint HAVING count(*) >= {q.FLOOR}",
    ),
    "downsample_fixed": over(
        WHOLE,
        f"""SELECT barcode, patient_alias, timepoint, clone_id FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_alias, timepoint ORDER BY md5(barcode || '|{q.SEED}')) AS place
  FROM base) WHERE place <= {q.SAMPLE_SIZE}""",
    ),
    "downsample_to_min": over(
        WHOLE,
        f"""SELECT barcode, treatment, timepoint, clone_id FROM (
  SELECT *, row_number() OVER (PARTITION BY timepoint, treatment ORDER BY md5(barcode || '|{q.SEED}')) AS place
  FROM base) WHERE place <= (
  SELECT min(n) FROM (SELECT count(*) AS n FROM base GROUP BY timepoint, treatment))""",
    ),
    "clone_counts": over(
        WHOLE,
        """SELECT patient_alias, timepoint, treatment, clone_id, response, trb_aa AS "TRB_chain_cdr3", count(*) AS n
FROM base WHERE clone_id IS NOT NULL GROUP BY patient_alias, timepoint, treatment, clone_id, response, trb_aa""",
    ),
    "clone_counts_complete": over(
        f"{BASE},\n{STATS}", "SELECT patient_alias, treatment, clone_id, timepoint, n FROM stats"
    ),
    "zero_fill_missing_sample": over(
        f"{FLOOR_BASE},\n{STATS}",
        f"SELECT patient_alias, treatment, clone_id, timepoint, n, n_tcells_tp, {r('perc')} FROM stats",
    ),
    "clone_perc": over(
        f"{BASE},\n{STATS}",
        f"SELECT patient_alias, treatment, clone_id, timepoint, n, n_tcells_tp, {r('perc')} FROM stats",
    ),
    "clone_size_stats": over(
        f"{FLOOR_BASE},\n{STATS}",
        f"""SELECT DISTINCT patient_alias, treatment, response, trb_aa AS "TRB_chain_cdr3", clone_id,
  n_max, n_min, range, {r('range_perc')} FROM stats""",
    ),
    "stats_with_label": over(LABELLED, "SELECT clone_id, timepoint, n, k FROM stats_k"),
}

CHANGE = {
    "delta_fc": over(f"{BASE},\n{STATS}", f"SELECT clone_id, timepoint, {FOLD_CHANGE} FROM dyn"),
    "delta_c": over(f"{BASE},\n{STATS}", f"SELECT clone_id, timepoint, {r('delta_c')} FROM dyn"),
    "avg_freq": over(f"{FLOOR_BASE},\n{STATS}", f"SELECT clone_id, timepoint, {r('avg_freq')} FROM dyn"),
    "perc_min_max": over(
        f"{FLOOR_BASE},\n{STATS}",
        f"""SELECT clone_id, {r('CASE WHEN count(perc) = count(*) THEN min(perc) END', 'min_perc')},
  {r('CASE WHEN count(perc) = count(*) THEN max(perc) END', 'max_perc')} FROM stats GROUP BY clone_id""",
    ),
    "peak_trough_timepoint": over(
        f"{FLOOR_BASE},\n{STATS}", "SELECT clone_id, timepoint_max, timepoint_min FROM peaks"
    ),
    "delta_extremes": over(
        f"{FLOOR_BASE},\n{STATS}",
        f"""SELECT clone_id, {r('delta_fc_min')}, {r('delta_c_max')}, {r('delta_c_min')},
  {r("CASE WHEN delta_fc_max < CAST('Infinity' AS DOUBLE) THEN delta_fc_max END", 'delta_fc_max')},
  delta_fc_max = CAST('Infinity' AS DOUBLE) AS from_zero FROM (
  SELECT clone_id, min(delta_fc) AS delta_fc_min, max(delta_fc) AS delta_fc_max, max(delta_c) AS delta_c_max,
    min(delta_c) AS delta_c_min FROM dyn GROUP BY clone_id)""",
    ),
}

SELECTION = {
    "dynamic_clones": over(
        f"{BASE},\n{STATS}",
        """SELECT DISTINCT patient_alias, clone_id, n_max FROM stats
WHERE clone_id IN (SELECT clone_id FROM dynamic)""",
    ),
    "flagged_clones": over(
        f"{BASE},\n{STATS}",
        """SELECT DISTINCT patient_alias, clone_id, n_max FROM stats
WHERE clone_id IN (SELECT clone_id FROM base WHERE flagged)""",
    ),
    "exempt_clones": over(
        f"{BASE},\n{STATS}",
        """SELECT DISTINCT patient_alias, clone_id, n_max, trb_aa = 'Brand#5' AS exempt FROM stats
WHERE n_max >= 5 OR trb_aa = 'Brand#5'""",
    ),
    "allowlist_semi": over(
        f"{BASE},\n{STATS},\n{ALLOWLIST}",
        """SELECT DISTINCT s.patient_alias, s.clone_id, s.n_max, s.trb_aa AS "TRB_chain_cdr3"
FROM stats s JOIN allowed a ON a.patient_alias = s.patient_alias AND a.trb_aa = s.trb_aa""",
    ),
    "min_clone_size": over(
        f"{BASE},\n{STATS}", "SELECT DISTINCT patient_alias, clone_id, n_max FROM stats WHERE n_max >= 5"
    ),
    "outlier_clones": over(
        f"""{LABELLED},
sizeable AS (SELECT clone_id, perc FROM stats WHERE perc > 0.25 AND n_max >= 5),
cutoff AS (SELECT avg(perc) + 2.5 * stddev_samp(perc) AS most FROM sizeable),
ordinary AS (
  SELECT clone_id FROM sizeable CROSS JOIN cutoff GROUP BY clone_id HAVING bool_and(perc < most))""",
        """SELECT patient_alias, clone_id,
  CASE WHEN clone_id IN (SELECT clone_id FROM ordinary) THEN k ELSE 'Other' END AS k FROM clones_k""",
    ),
}

# correlation of every two clones, the long way round
PAIRS = {
    "pearson": """varying AS (SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) > min(z)),
z AS (SELECT * FROM scaled WHERE clone_id IN (SELECT clone_id FROM varying)),
pairs AS (
  SELECT a.clone_id AS i, b.clone_id AS j, corr(a.z, b.z) AS c
  FROM z a JOIN z b ON a.timepoint = b.timepoint GROUP BY a.clone_id, b.clone_id)""",
    "spearman": """varying AS (SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) > min(z)),
z AS (
  SELECT clone_id, timepoint, rank() OVER (PARTITION BY clone_id ORDER BY z)
    + (count(*) OVER (PARTITION BY clone_id, z) - 1) / 2.0 AS z
  FROM scaled WHERE clone_id IN (SELECT clone_id FROM varying)),
pairs AS (
  SELECT a.clone_id AS i, b.clone_id AS j, corr(CAST(a.z AS DOUBLE), CAST(b.z AS DOUBLE)) AS c
  FROM z a JOIN z b ON a.timepoint = b.timepoint GROUP BY a.clone_id, b.clone_id)""",
    "kendall": """varying AS (SELECT clone_id FROM scaled GROUP BY clone_id HAVING max(z) > min(z)),
signs AS (
  SELECT a.clone_id, a.timepoint AS t1, b.timepoint AS t2, CAST(sign(b.z - a.z) AS DOUBLE) AS s
  FROM scaled a JOIN scaled b ON a.clone_id = b.clone_id AND a.timepoint < b.timepoint
  WHERE a.clone_id IN (SELECT clone_id FROM varying)),
untied AS (SELECT clone_id, sqrt(sum(s * s)) AS w FROM signs GROUP BY clone_id),
concordance AS (
  SELECT a.clone_id AS i, b.clone_id AS j, sum(a.s * b.s) AS s
  FROM signs a JOIN signs b ON a.t1 = b.t1 AND a.t2 = b.t2 GROUP BY a.clone_id, b.clone_id),
pairs AS (
  SELECT i, j, s / (a.w * b.w) AS c
  FROM concordance JOIN untied a ON a.clone_id = i JOIN untied b ON b.clone_id = j)""",
}


def mean_correlation(method: str) -> str:
    return over(
        f"{LABELLED},\n{PAIRS[method]}",
        f"""SELECT i AS clone_id, l.k, {r('avg(c)', 'mean_cor')}
FROM pairs JOIN labels l ON l.clone_id = j GROUP BY i, l.k""",
    )


VECTORS = {
    "clone_matrix": over(LABELLED, f"SELECT clone_id, {WIDE} FROM mat GROUP BY clone_id"),
    "complete_clones": over(
        f"{FLOOR_BASE},\n{STATS}",
        f"""SELECT clone_id, {WIDE} FROM (SELECT clone_id, timepoint, perc AS x FROM stats)
GROUP BY clone_id HAVING count(x) = count(*)""",
    ),
    "scaled_matrix": over(
        LABELLED, f"SELECT clone_id, {WIDE} FROM (SELECT clone_id, timepoint, z AS x FROM scaled) GROUP BY clone_id"
    ),
    "corr_pearson": mean_correlation("pearson"),
    "corr_spearman": mean_correlation("spearman"),
    "corr_kendall": mean_correlation("kendall"),
    "corr_anchor_rows": over(
        f"""{LABELLED},
{PAIRS['pearson']},
anchors AS (
  SELECT clone_id FROM (
    SELECT clone_id, row_number() OVER (PARTITION BY k ORDER BY n_max DESC, clone_id DESC) AS place
    FROM clones_k WHERE k <> 'Other') WHERE place = 1)""",
        f"SELECT i AS clone_id, j AS anchor_id, {r('c', 'cor')} FROM pairs WHERE j IN (SELECT clone_id FROM anchors)",
    ),
    "corr_row_distance": over(
        f"""{LABELLED},
{PAIRS['pearson']},
centre AS (SELECT j, avg(c) AS m FROM pairs GROUP BY j),
lengths AS (SELECT i, sum(c * c) AS q, sum(c * m) AS p FROM pairs JOIN centre USING (j) GROUP BY i)""",
        f"SELECT i AS clone_id, {r('q - 2 * p + avg(q) OVER ()', 'mean_sq_dist')} FROM lengths",
    ),
    "corr_block_means": over(
        f"{LABELLED},\n{PAIRS['pearson']}",
        f"""SELECT a.k, b.k AS k_other, {r('avg(c)', 'mean_cor')}
FROM pairs JOIN labels a ON a.clone_id = i JOIN labels b ON b.clone_id = j GROUP BY a.k, b.k""",
    ),
}

RELABEL = " ".join(f"WHEN 'Traj {old}' THEN 'Traj {new}'" for new, old in enumerate(q.CUSTOM_ORDER, 1))

# samples of equal size, and clones on the allow-list only
SAMPLED_LABELS = f"""{FLOOR_BASE.replace(",\nbase AS (", ",\nenough AS (")},
base AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY patient_alias, timepoint ORDER BY md5(barcode || '|{q.SEED}')) AS place
    FROM enough) WHERE place <= {q.FLOOR}),
{STATS},
{ALLOWLIST},
{LABELS.replace("s.n_max >= 5", "s.n_max >= 2 AND (s.patient_alias, s.trb_aa) IN (SELECT patient_alias, trb_aa FROM allowed)")}"""

TRAJECTORIES = {
    "traj_sampled": over(SAMPLED_LABELS, "SELECT clone_id, k FROM labels"),
    "heatmap_rows": over(LABELLED, "SELECT clone_id, k, row_number() OVER (ORDER BY k, clone_id) AS row FROM labels"),
    "traj_absolute": over(LABELLED, "SELECT clone_id, k FROM labels"),
    "traj_relabel": over(LABELLED, f"SELECT clone_id, CASE k {RELABEL} ELSE k END AS k FROM labels"),
    "label_cells": over(
        LABELLED,
        """SELECT barcode, b.clone_id, coalesce(l.k, 'Other') AS k
FROM base b LEFT JOIN labels l ON l.clone_id = b.clone_id""",
    ),
    "label_stats": over(LABELLED, f"SELECT patient_alias, clone_id, timepoint, n, {r('perc')}, k FROM stats_k"),
    "traj_sizes": over(LABELLED, "SELECT k, count(*) AS n FROM labels GROUP BY k"),
}

AREA_ROWS = f"""{LABELLED},
area AS (
  SELECT s.*, o.clone_ord, row_number() OVER (PARTITION BY s.k ORDER BY s.n_max, s.clone_id, s.timepoint) AS rank_cl
  FROM stats_k s JOIN stacked o ON o.clone_id = s.clone_id)"""


def shares(keys: str, where: str = "TRUE", value: str = "sum(perc)", ctes: str = AREA_ROWS) -> str:
    return over(
        ctes,
        f"SELECT timepoint, {keys}, {r(value, 'perc')} FROM area WHERE perc IS NOT NULL AND {where} GROUP BY timepoint, {keys}",
    )


AREA = {
    "rank_in_traj": over(AREA_ROWS, "SELECT k, clone_id, timepoint, n_max, rank_cl FROM area"),
    "rank_by_column": over(
        f"""{AREA_ROWS},
ordered AS (
  SELECT clone_id, row_number() OVER (ORDER BY response NULLS LAST, clone_ord) AS place FROM stacked)""",
        """SELECT response, a.clone_id, timepoint,
  row_number() OVER (PARTITION BY response, a.clone_id ORDER BY n_max, timepoint) AS rank_cl, place AS clone_ord
FROM area a JOIN ordered o ON o.clone_id = a.clone_id""",
    ),
    "cumsum_labels": over(
        f"""{AREA_ROWS},
summed AS (
  SELECT *, sum(perc) OVER (PARTITION BY k ORDER BY rank_cl ROWS UNBOUNDED PRECEDING) AS csum
  FROM area WHERE perc IS NOT NULL)""",
        f"SELECT k, clone_id, timepoint, {r('perc')}, {r('csum')} FROM summed WHERE timepoint = 3",
    ),
    "area_base": over(
        AREA_ROWS,
        f"""SELECT patient_alias, treatment, k, clone_id, timepoint, {r('perc')}, rank_cl, clone_ord
FROM area WHERE perc IS NOT NULL""",
    ),
    "exclude_last_traj": over(
        LABELLED,
        """SELECT clone_id, k FROM clones_k WHERE kn IS NULL OR kn < (SELECT max(kn) FROM clones_k)""",
    ),
    "area_by_patient": shares("patient_alias, treatment, k"),
    "area_by_patient_mean": shares("patient_alias, treatment, k", value="avg(perc)"),
    "area_normalized": over(
        f"""{AREA_ROWS},
patients AS (SELECT treatment, count(DISTINCT patient_alias) AS npatients FROM area GROUP BY treatment),
summed AS (
  SELECT timepoint, patient_alias, treatment, k, sum(perc) AS perc FROM area
  WHERE perc IS NOT NULL AND k IN ({listed(q.SELECTED)}) GROUP BY timepoint, patient_alias, treatment, k)""",
        f"""SELECT timepoint, patient_alias, treatment, k, npatients,
  {r('perc / npatients * (SELECT min(npatients) FROM patients)', 'perc')}
FROM summed JOIN patients USING (treatment)""",
    ),
    "area_selected": shares("k", f"k IN ({listed(q.SELECTED)}) AND kn < (SELECT max(kn) FROM clones_k)"),
    "area_filtered": shares(
        "patient_alias, response, k", f"response IS NOT NULL AND patient_alias IN ({listed(q.SOME_PATIENTS)})"
    ),
    "area_tcr": over(
        AREA_ROWS,
        f"""SELECT timepoint, patient_alias, k, trb_aa AS "TRB_chain_cdr3", {r('sum(perc)', 'perc')} FROM area
WHERE perc IS NOT NULL AND patient_alias = '{q.ONE_PATIENT}' AND trb_aa IN ({listed(q.SOME_TRB)})
GROUP BY timepoint, patient_alias, k, trb_aa""",
    ),
    "area_allowlist": shares(
        "treatment, k",
        "EXISTS (SELECT 1 FROM allowed w WHERE w.patient_alias = area.patient_alias AND w.trb_aa = area.trb_aa)",
        ctes=f"{AREA_ROWS},\n{ALLOWLIST}",
    ),
    "area_by_treatment": shares("treatment, k"),
    "area_by_response": over(
        f"""{AREA_ROWS},
grouped AS (
  SELECT timepoint, k, perc, CASE WHEN response IN ('CR', 'PR') THEN 'R' ELSE 'NR' END AS response
  FROM area WHERE perc IS NOT NULL AND response IS NOT NULL)""",
        f"SELECT timepoint, response, k, {r('sum(perc)', 'perc')} FROM grouped GROUP BY timepoint, response, k",
    ),
    "patient_order": over(
        LABELLED,
        """SELECT patient_alias, treatment, row_number() OVER (ORDER BY treatment, patient_alias) AS patient_ord
FROM (SELECT DISTINCT patient_alias, treatment FROM clones_k WHERE k <> 'Other')""",
    ),
}

CELLS_K = f"""{LABELLED},
cells_k AS (
  SELECT b.*, coalesce(l.k, 'Other') AS k FROM base b LEFT JOIN labels l ON l.clone_id = b.clone_id)"""
NOT_LAST = "k = 'Other' OR k <> (SELECT 'Traj ' || CAST(max(kn) AS VARCHAR) FROM clones_k)"

SAMPLED = f"""barcode IN (SELECT barcode FROM (
  SELECT barcode, row_number() OVER (PARTITION BY timepoint, treatment ORDER BY md5(barcode || '|{q.SEED}')) AS place
  FROM cells_k) WHERE place <= (
    SELECT min(n) FROM (SELECT count(*) AS n FROM cells_k GROUP BY timepoint, treatment)))"""


def cycling(keys: str) -> str:
    return over(
        CELLS_K,
        f"""SELECT {keys}, k, ctype AS metaclusters_exh, count(*) AS num,
  count(*) FILTER (WHERE mki67 > 0) AS cycling_count,
  {r('least(100.0 * count(*) FILTER (WHERE mki67 > 0) / count(*), 10)', 'cycling')}
FROM cells_k WHERE k <> 'Other' GROUP BY {keys}, k, ctype""",
    )


def composition_ctes(seen: str = "TRUE", shaped: str = "TRUE") -> str:
    """Completed grid of patient, timepoint, trajectory and type with percentages.

    ``seen`` limits the cells as a whole, ``shaped`` the labelled cells that span the grid.
    """
    return f"""{CELLS_K},
seen AS (SELECT * FROM cells_k WHERE {seen}),
samples AS (
  SELECT patient_alias, timepoint, count(*) AS n_sample FROM seen GROUP BY patient_alias, timepoint),
found AS (
  SELECT treatment, patient_alias, timepoint, k, ctype, count(*) AS n_cells,
    count(*) FILTER (WHERE mki67 > 0) AS n_cycling
  FROM seen WHERE k <> 'Other' AND {shaped} GROUP BY treatment, patient_alias, timepoint, k, ctype),
grid AS (
  SELECT p.treatment, p.patient_alias, t.timepoint, a.k, c.ctype,
    coalesce(f.n_cells, 0) AS n_cells, coalesce(f.n_cycling, 0) AS n_cycling,
    coalesce(CAST(f.n_cells AS DOUBLE) / s.n_sample * 100, 0) AS n
  FROM (SELECT DISTINCT treatment, patient_alias FROM found) p CROSS JOIN tps t
    CROSS JOIN (SELECT DISTINCT k FROM found) a CROSS JOIN (SELECT DISTINCT ctype FROM found) c
    LEFT JOIN found f ON f.patient_alias = p.patient_alias AND f.timepoint = t.timepoint
      AND f.k = a.k AND f.ctype = c.ctype
    LEFT JOIN samples s ON s.patient_alias = p.patient_alias AND s.timepoint = t.timepoint),
based AS (
  SELECT g.*, b.n AS n0 FROM grid g JOIN grid b ON b.patient_alias = g.patient_alias AND b.k = g.k
    AND b.ctype = g.ctype AND b.timepoint = 0)"""


DELTA = {"abs": "n", "delta": "n - n0", "fc": "log2((n + 2) / (n0 + 2))"}


def averaged(keys: str, mode: str, where: str = "TRUE", seen: str = "TRUE") -> str:
    """CTEs up to ``report``: mean over patients."""
    return f"""{composition_ctes(seen)},
report AS (
  SELECT timepoint, {keys}k, ctype AS metaclusters_exh,
    CASE WHEN sum(n_cells) > 0 THEN least(100.0 * sum(n_cycling) / sum(n_cells), 10) END AS cycling,
    avg({DELTA[mode]}) AS delta
  FROM based WHERE {where} GROUP BY timepoint, {keys}k, ctype)"""


def report(keys: str, mode: str, where: str = "TRUE", seen: str = "TRUE", final: str = "TRUE") -> str:
    return over(
        averaged(keys, mode, where, seen),
        f"SELECT timepoint, {keys}k, metaclusters_exh, {r('cycling')}, {r('delta')} FROM report WHERE {final}",
    )


def patient_report(mode: str, shaped: str, final: str = "TRUE") -> str:
    return over(
        composition_ctes(shaped=shaped),
        f"""SELECT timepoint, treatment, patient_alias, k, ctype AS metaclusters_exh, {r('n')},
  {r('CASE WHEN n_cells > 0 THEN least(100.0 * n_cycling / n_cells, 10) END', 'cycling')},
  {r(DELTA[mode], 'delta')}
FROM based WHERE {final}""",
    )


SHOWN = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in q.PUBLISHED_TREATMENTS.items())

COMPOSITION = {
    "cycling_pct": cycling("timepoint"),
    "cycling_pct_treatment": cycling("timepoint, treatment"),
    "cycling_pct_patient": cycling("timepoint, treatment, patient_alias"),
    "ctype_freq": over(
        CELLS_K,
        f"""SELECT timepoint, treatment, patient_alias, k, clone_id, ctype AS metaclusters_exh,
  {r('CAST(count(*) AS DOUBLE) / min(n_sample)', 'freq')}
FROM (SELECT *, count(*) OVER (PARTITION BY timepoint, treatment, patient_alias) AS n_sample FROM cells_k)
WHERE k <> 'Other' GROUP BY timepoint, treatment, patient_alias, k, clone_id, ctype""",
    ),
    "treatment_labels": over(
        f"{WHOLE},\nnamed AS (SELECT CASE treatment {SHOWN} ELSE treatment END AS treatment FROM base)",
        """SELECT treatment, CASE treatment WHEN 'aPD1' THEN '(prior ipi)' || chr(10) || 'aPD-1'
  WHEN 'aPD-1 (naive)' THEN chr(10) || 'aPD-1' WHEN 'aCTLA-4' THEN chr(10) || 'aCTLA-4'
  WHEN 'Combination' THEN chr(10) || 'Combination' ELSE treatment END AS display, count(*) AS n
FROM named GROUP BY treatment""",
    ),
    "ctype_complete": over(
        composition_ctes(),
        f"SELECT patient_alias, timepoint, k, ctype AS metaclusters_exh, n_cells, {r('n', 'share')} FROM grid",
    ),
    "ctype_complete_nested": over(
        composition_ctes(),
        f"SELECT treatment, patient_alias, timepoint, k, ctype AS metaclusters_exh, n_cells, {r('n', 'share')} FROM grid",
    ),
    "ctype_abs": report("", "abs"),
    "ctype_delta": report("", "delta"),
    "ctype_log2fc": report("", "fc", seen=NOT_LAST),
    "ctype_treatment": report("treatment, ", "delta"),
    "ctype_treatment_fc": report("treatment, ", "fc", where=f"k IN ({listed(q.SELECTED)})"),
    "ctype_equalized": report("treatment, ", "delta", seen=SAMPLED),
    "ctype_treatment_patient": patient_report(
        "fc",
        f"k IN ({listed(q.SELECTED)}) AND treatment IN ({listed(q.SOME_TREATMENTS)})",
        f"ctype IN ({listed(q.SOME_TYPES)})",
    ),
    "ctype_filtered": report(
        "treatment, ", "delta", final=f"metaclusters_exh <> 'NO' AND k IN ({listed(q.SELECTED)})"
    ),
    "ctype_topn": over(
        f"""{averaged('treatment, ', 'delta')},
weights AS (
  SELECT metaclusters_exh, rank() OVER (ORDER BY sum(abs(delta)) DESC) AS place FROM report GROUP BY metaclusters_exh)""",
        f"""SELECT timepoint, treatment, k, metaclusters_exh, {r('cycling')}, {r('delta')} FROM report
WHERE metaclusters_exh IN (SELECT metaclusters_exh FROM weights WHERE place <= 2)""",
    ),
    "ctype_exclude_cell": patient_report(
        "abs", f"NOT (patient_alias = '{q.ONE_PATIENT}' AND k = 'Traj 1' AND ctype = 'NO')"
    ),
    "ctype_peak_label": over(
        f"""{averaged('treatment, ', 'delta')},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY treatment, k, metaclusters_exh ORDER BY abs(delta) DESC, timepoint) AS place
  FROM report)""",
        f"""SELECT timepoint, treatment, k, metaclusters_exh, {r('cycling')}, {r('delta')} FROM placed
WHERE place = 1 AND delta > 0.5""",
    ),
}


def oracle_sql() -> dict[str, str]:
    parts = (SOURCES, CLEANING, CLONES, ABUNDANCE, CHANGE, SELECTION, VECTORS, TRAJECTORIES, AREA, COMPOSITION)
    return {name: text for part in parts for name, text in part.items()} | clustering_sql(LABELLED, q.WARD_ORDER) | profile_sql(LABELLED, q.MIN_ABS_COR)

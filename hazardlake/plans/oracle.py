"""The same results in plain SQL, for checking the registered queries against another engine."""

COHORT = """
follow AS (
  SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS time,
         arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority
  FROM orders GROUP BY o_custkey),
cohort AS (
  SELECT CAST(c_custkey AS VARCHAR) AS sample_id, time, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS event,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'LUSC' ELSE 'LUAD' END AS subtype
  FROM customer JOIN follow ON c_custkey = o_custkey WHERE time > 1)"""

CLINICAL = """
clinical AS (
  SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_acctbal AS acctbal, n_name AS nation, r_name AS region,
         c_mktsegment AS segment, priority AS stage
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN follow ON c_custkey = o_custkey)"""

DENSE = """
dense AS (
  SELECT CAST(vec_id AS VARCHAR) AS sample_id, printf('E%02d', i - 1) AS feature_id,
         CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings
        WHERE vec_id IN (SELECT c_custkey FROM customer)))"""

LINES = """
lines AS (
  SELECT CAST(o_custkey AS VARCHAR) AS sample_id, o_orderpriority, lineitem.*
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

BRAND = LINES + """,
bought AS (SELECT sample_id, p_brand AS feature_id, sum(l_quantity) AS value
           FROM lines JOIN part ON l_partkey = p_partkey GROUP BY ALL),
brand AS (
  SELECT c.sample_id, f.feature_id, coalesce(b.value, 0.0) AS value
  FROM cohort c CROSS JOIN (SELECT DISTINCT feature_id FROM bought) f
  LEFT JOIN bought b ON b.sample_id = c.sample_id AND b.feature_id = f.feature_id)"""

DISCOUNT_ONLY = """
means AS (SELECT sample_id, o_orderpriority || '|' || l_returnflag AS feature_id, avg(l_discount) AS value
          FROM lines GROUP BY ALL),
discount AS (
  SELECT c.sample_id, f.feature_id, m.value
  FROM cohort c CROSS JOIN (SELECT DISTINCT feature_id FROM means) f
  LEFT JOIN means m ON m.sample_id = c.sample_id AND m.feature_id = f.feature_id)"""

DISCOUNT = LINES + "," + DISCOUNT_ONLY

ACTIVITY = """
activity AS (SELECT CAST(user_id AS VARCHAR) AS sample_id, event_type AS feature_id, avg(value) AS value
             FROM events GROUP BY ALL)"""

FOLDS = """
folds AS (SELECT *, ntile(5) OVER (PARTITION BY subtype ORDER BY md5(sample_id || '|3')) AS fold FROM cohort)"""

ROLES = FOLDS + """,
roles AS (SELECT *, CASE WHEN cv = fold THEN 'test' ELSE 'train' END AS role
          FROM folds CROSS JOIN (SELECT unnest(range(1, 6)) AS cv))"""


SPECIMENS = """
specimens AS (
  SELECT printf('CUST-%014d-%010d', c_custkey, o_orderkey) AS sample_id, c_name AS patient,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'NT' ELSE 'TP' END AS sample_type, c_mktsegment AS subtype, n_name AS stage,
         ['TX', 'T1', 'T2', 'T3', 'T4'][o_orderkey % 5 + 1] AS t, ['NX', 'N0', 'N1'][o_orderkey % 3 + 1] AS n,
         ['M0', 'MX', 'M1', 'M0'][o_orderkey % 4 + 1] AS m,
         ['not reported', 'yes', 'no', 'no', 'no', 'yes', 'no'][o_orderkey % 7 + 1] AS prior_malignancy,
         ['Not Reported', 'No'][o_orderkey % 2 + 1] AS synchronous_malignancy,
         ['male', 'female', 'male', 'male', 'female', 'female'][o_orderkey % 6 + 1] AS gender,
         CAST(c_custkey % 60 + 30 AS BIGINT) AS age_at_index,
         CAST(nullif(o_orderkey % 11, 0) AS DOUBLE) AS pack_years_smoked, CAST(nullif(o_orderkey % 9, 0) AS DOUBLE) AS dim_short,
         CAST(nullif(o_orderkey % 10, 0) AS DOUBLE) AS dim_mid, CAST(nullif(o_orderkey % 13, 0) AS DOUBLE) AS dim_long,
         CASE WHEN o_orderstatus = 'F' THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') END AS days_to_death,
         CASE WHEN o_orderkey % 8 <> 3 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') + 1 END AS days_to_last_follow_up,
         CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN 'Alive' END AS vital_status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ELIGIBLE = """
eligible AS (SELECT printf('CUST-%014d', c_custkey) AS sample_id,
                    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'LUSC' ELSE 'LUAD' END AS subtype
             FROM customer WHERE c_acctbal >= 0)"""


def screen(source, keys):
    """Score test per feature: risk-set sums over days, features centred on their mean."""
    k = ", ".join(keys)
    return f"""
centred AS (SELECT *, value - avg(value) OVER (PARTITION BY {k}) AS x FROM {source}),
cells AS (SELECT {k}, time, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx,
                 CAST(sum(event) AS DOUBLE) AS d, sum(event * x) AS dx FROM centred GROUP BY {k}, time),
risk AS (SELECT {k}, d, dx, sum(n) OVER w AS n, sum(sx) OVER w AS s1, sum(sxx) OVER w AS s2 FROM cells
         WINDOW w AS (PARTITION BY {k} ORDER BY time DESC)),
score AS (SELECT {k}, sum(dx - d * s1 / n) AS u, sum(d * (s2 / n - (s1 / n) * (s1 / n))) AS v
          FROM risk GROUP BY {k})"""


def concordance(source, keys):
    on = "".join(f" AND i.{k} = j.{k}" for k in keys)
    out = "".join(f"i.{k}, " for k in keys)
    return f"""
pairs AS (SELECT {out}i.score AS a, j.score AS b FROM {source} i JOIN {source} j
          ON i.event = 1 AND (j.time > i.time OR (j.time = i.time AND j.event = 0)){on})
SELECT {', '.join([*keys, ''])}sum(CASE WHEN a > b THEN 1 ELSE 0 END)::BIGINT AS concordant,
       sum(CASE WHEN a = b THEN 1 ELSE 0 END)::BIGINT AS tied, count(*) AS comparable,
       round((sum(CASE WHEN a > b THEN 1.0::DOUBLE ELSE 0 END) + 0.5::DOUBLE * sum(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END))
             / count(*), 6) AS cindex
FROM pairs {'GROUP BY ' + ', '.join(keys) if keys else ''}"""


PREDICTOR = """
predictor AS (SELECT sample_id, sum(value * ((CAST(substr(feature_id, 2, 2) AS DOUBLE) - 31.5) / 100.0::DOUBLE)) AS score
              FROM dense GROUP BY sample_id)"""

GROUPS = """
groups AS (SELECT *, CASE WHEN subtype = 'LUSC' THEN 'BadPrognosis' ELSE 'GoodPrognosis' END AS grp FROM cohort)"""


def anova_totals(source, groups):
    return f"""
cells AS (SELECT feature_id, grp, CAST(count(*) AS DOUBLE) AS n, avg(value) AS mean,
                 count(*) * var_pop(value) AS within
          FROM {source} JOIN {groups} USING (sample_id) GROUP BY feature_id, grp),
dev AS (SELECT *, mean - sum(n * mean) OVER (PARTITION BY feature_id) / sum(n) OVER (PARTITION BY feature_id) AS dev
        FROM cells),
total AS (SELECT feature_id, count(*) - 1 AS df, CAST(sum(n) AS BIGINT) - count(*) AS df_resid,
                 sum(n * dev * dev) AS sum_sq, sum(within) AS ssw FROM dev GROUP BY feature_id)"""


def anova(source, groups, digits=6):
    return anova_totals(source, groups) + f"""
SELECT feature_id, df, df_resid, round(sum_sq, {digits}) AS sum_sq, round(sum_sq / df, {digits}) AS mean_sq,
       round((sum_sq / df) / (ssw / df_resid), {digits}) AS f_value FROM total"""


#: Upper tail of chi-square with one degree of freedom, and of F with one and four above any number below, as
#: series of positive terms or in closed form; ``y`` is half the statistic, ``u`` is df1 * f / df2.
CHI2_ONE = """CASE WHEN y <= 0 THEN 1 WHEN y > 40 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 300),
    lambda n: exp((n + 0.5) * ln(y) - y - lgamma(n + 1.5)))) END"""
F_ONE = """CASE WHEN u <= 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 5000),
    lambda n: exp(lgamma(df_resid / 2.0 + n + 0.5) - lgamma(df_resid / 2.0) - lgamma(n + 1.5)
                  + (n + 0.5) * ln(u / (1 + u)) - df_resid / 2.0 * ln(1 + u)))) END"""
F_FOUR = "pow(1 + u, -df_resid / 2.0) * (1 + df_resid / 2.0 * u / (1 + u))"


def determinant(cells):
    """SQL text of the determinant of a square of SQL texts, by its first row."""
    if len(cells) == 1:
        return cells[0][0]
    minor = lambda j: determinant([row[:j] + row[j + 1:] for row in cells[1:]])
    return "(" + " ".join(f"{'+-'[j % 2]} {c} * {minor(j)}" for j, c in enumerate(cells[0])) + ")"


GENES = """
first_part AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
               WHERE rn = 1),
genes AS (SELECT p_brand AS feature_id, p_type AS gene FROM first_part WHERE p_size >= 10)"""

RESULTS = """
results AS (
  SELECT CAST(year(o_orderdate) % 5 + 1 AS INT) AS fold,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'Meth-Clin-LNC' WHEN '2-HIGH' THEN 'Gene-LNC-Clin-miRNA'
           WHEN '3-MEDIUM' THEN 'Gene Expression' WHEN '4-NOT SPECIFIED' THEN 'Multimodal (Early)'
           WHEN '5-LOW' THEN 'LNC RNAs' END AS data_types,
         CASE o_orderstatus WHEN 'F' THEN 'One AE' WHEN 'O' THEN 'Feature Selection' WHEN 'P' THEN 'PCA' END AS reduction,
         avg(o_totalprice % 1000.0::DOUBLE) / 1000.0::DOUBLE AS cindex,
         avg(o_totalprice % 700.0::DOUBLE) / 700.0::DOUBLE AS cindex_a,
         avg(o_totalprice % 300.0::DOUBLE) / 300.0::DOUBLE AS cindex_b
  FROM orders GROUP BY ALL)"""


def summary(source="results", digits=6):
    se = "stddev_samp({0}) / sqrt(CAST(count({0}) AS DOUBLE))"
    return f"""
named AS (SELECT * REPLACE (CASE WHEN data_types = 'Gene Expression' THEN 'mRNA' ELSE data_types END AS data_types)
          FROM {source}),
summary AS (
  SELECT data_types, reduction, 'LUSC' AS subtype, round(avg(cindex_a), {digits}) AS cindex,
         round({se.format('cindex_a')}, 6) AS se FROM named GROUP BY ALL
  UNION ALL
  SELECT data_types, reduction, 'LUAD', round(avg(cindex_b), {digits}), round({se.format('cindex_b')}, 6)
  FROM named GROUP BY ALL)"""


P_VALUES = """
pv AS (SELECT p_partkey, p_type, CAST(p_size AS DOUBLE) / 51.0::DOUBLE * ((p_partkey % 97) + 1) / 98.0::DOUBLE AS p FROM part)"""


def bh(keys=()):
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    cols = "".join(f"{k}, " for k in keys)
    return f"""
ranked AS (SELECT *, rank() OVER ({part}ORDER BY p) + count(*) OVER ({part[:-1] + ', ' if keys else 'PARTITION BY '}p) - 1 AS r,
                  count(*) OVER ({part}) AS m FROM pv)
SELECT p_partkey, {cols}round(least(1.0::DOUBLE, min(p * m / r) OVER ({part}ORDER BY p DESC, p_partkey
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS padj FROM ranked"""


def with_(*parts):
    return "WITH " + ",".join(parts)


def combos():
    from hazardlake.operators.sampling import early_combos, late_combos
    rows = [(kind, "-".join(c), m) for kind, cs in (("late", late_combos()), ("early", early_combos()))
            for c in cs for m in c]
    return ", ".join(f"('{k}', '{c}', '{m}')" for k, c, m in rows)


def oracles():
    q = {}
    q["cohort"] = with_(COHORT) + " SELECT sample_id, CAST(time AS BIGINT) AS time, CAST(event AS BIGINT) AS event, subtype FROM cohort"
    q["km_by_group"] = with_(COHORT) + """,
    days AS (SELECT subtype, time, count(*) AS c, sum(event) AS d FROM cohort GROUP BY ALL),
    risk AS (SELECT subtype, time, CAST(d AS DOUBLE) AS d, CAST(sum(c) OVER (PARTITION BY subtype ORDER BY time DESC) AS DOUBLE) AS n
             FROM days),
    cum AS (SELECT *, sum(CASE WHEN d < n THEN ln(1 - d / n) ELSE 0 END) OVER w AS ls,
                   sum(CASE WHEN d < n THEN d / (n * (n - d)) ELSE 0 END) OVER w AS g,
                   max(CASE WHEN d >= n THEN 1 ELSE 0 END) OVER w AS dead
            FROM risk WINDOW w AS (PARTITION BY subtype ORDER BY time))
    SELECT subtype, CAST(time AS BIGINT) AS time, CAST(n AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event,
           CASE WHEN dead = 1 THEN 0.0::DOUBLE ELSE round(exp(ls), 6) END AS survival,
           CASE WHEN dead = 0 THEN round(exp(ls) * exp(-1.959963984540054::DOUBLE * sqrt(g)), 6) END AS lower,
           CASE WHEN dead = 0 THEN round(least(1.0::DOUBLE, exp(ls) * exp(1.959963984540054::DOUBLE * sqrt(g))), 6) END AS upper
    FROM cum"""
    q["logrank_by_group"] = with_(COHORT) + """,
    d AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d FROM cohort GROUP BY time HAVING sum(event) > 0),
    t AS (SELECT d.time, d.d, CAST(count(*) AS DOUBLE) AS n,
                 CAST(sum(CASE WHEN subtype = 'LUSC' THEN 1 ELSE 0 END) AS DOUBLE) AS n1
          FROM d JOIN cohort c ON c.time >= d.time GROUP BY d.time, d.d)
    SELECT round(pow((SELECT sum(event) FROM cohort WHERE subtype = 'LUSC') - sum(d * n1 / n), 2)
           / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (n1 / n) * (1 - n1 / n) ELSE 0 END), 6) AS chi2 FROM t"""
    q["logrank_components"] = with_(COHORT, CLINICAL) + """,
    x AS (SELECT time, event, segment FROM cohort JOIN clinical USING (sample_id)),
    d AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d, CAST(NULL AS DOUBLE) AS z FROM x GROUP BY time HAVING sum(event) > 0),
    n AS (SELECT d.time, d.d, s.segment, CAST(sum(CASE WHEN x.segment = s.segment THEN 1 ELSE 0 END) AS DOUBLE) AS ng,
                 CAST(count(*) AS DOUBLE) AS n
          FROM d CROSS JOIN (SELECT DISTINCT segment FROM x) s JOIN x ON x.time >= d.time GROUP BY ALL)
    SELECT a.segment AS g, b.segment AS h, CAST((SELECT sum(event) FROM x WHERE x.segment = a.segment) AS BIGINT) AS observed,
           round(sum(a.d * a.ng / a.n), 6) AS expected,
           round(sum(CASE WHEN a.n > 1 THEN a.d * (a.n - a.d) / (a.n - 1) ELSE 0 END * a.ng / a.n
                 * (CASE WHEN a.segment = b.segment THEN 1 ELSE 0 END - b.ng / b.n)), 6) AS v
    FROM n a JOIN n b ON a.time = b.time GROUP BY a.segment, b.segment"""
    z, v = [f"z{i}" for i in range(4)], [[f"v{i}{j}" for j in range(4)] for i in range(4)]
    bordered = [row + [z[i]] for i, row in enumerate(v)] + [[*z, "0.0::DOUBLE"]]
    cell = "max(CASE WHEN g = {0} AND h = {1} THEN {2} END)"
    q["logrank_p_value"] = with_(COHORT, CLINICAL) + f""",
    x AS (SELECT time, event, segment, dense_rank() OVER (ORDER BY segment) - 1 AS g FROM cohort JOIN clinical USING (sample_id)),
    d AS (SELECT time, CAST(sum(event) AS DOUBLE) AS d FROM x GROUP BY time HAVING sum(event) > 0),
    n AS (SELECT d.time, d.d, s.g, CAST(sum(CASE WHEN x.g = s.g THEN 1 ELSE 0 END) AS DOUBLE) AS ng, CAST(count(*) AS DOUBLE) AS n
          FROM d CROSS JOIN (SELECT DISTINCT g FROM x) s JOIN x ON x.time >= d.time GROUP BY ALL),
    parts AS (SELECT a.g, b.g AS h, (SELECT sum(event) FROM x WHERE x.g = a.g) - sum(a.d * a.ng / a.n) AS z,
                     sum(CASE WHEN a.n > 1 THEN a.d * (a.n - a.d) / (a.n - 1) ELSE 0 END * a.ng / a.n
                         * (CASE WHEN a.g = b.g THEN 1 ELSE 0 END - b.ng / b.n)) AS v
              FROM n a JOIN n b ON a.time = b.time GROUP BY a.g, b.g),
    wide AS (SELECT {', '.join([cell.format(i, i, 'z') + f' AS z{i}' for i in range(4)]
                               + [cell.format(i, j, 'v') + f' AS v{i}{j}' for i in range(4) for j in range(4)])} FROM parts),
    c AS (SELECT -{determinant(bordered)} / {determinant(v)} AS chi2 FROM wide)
    SELECT round(chi2, 6) AS chi2, 4::INTEGER AS df, round(exp(-chi2 / 2) * (1 + chi2 / 2), 9) AS p FROM c"""
    q["cox_screen_p"] = with_(COHORT, DENSE, "src AS (SELECT * FROM dense JOIN cohort USING (sample_id))",
                              screen("src", ["feature_id"])) + f"""
    SELECT feature_id, round({CHI2_ONE}, 9) AS p FROM (SELECT feature_id, u * u / v / 2 AS y FROM score)"""
    q["cox_screen"] = with_(COHORT, DENSE, "src AS (SELECT * FROM dense JOIN cohort USING (sample_id))",
                            screen("src", ["feature_id"])) + """
    SELECT feature_id, round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chi2 FROM score"""
    src = "src AS (SELECT * FROM dense JOIN roles USING (sample_id) WHERE role = 'train')"
    q["cox_screen_topn_per_fold"] = with_(COHORT, DENSE, ROLES, src, screen("src", ["cv", "feature_id"])) + """
    SELECT cv, feature_id, round(chi2, 6) AS chi2 FROM (
      SELECT *, row_number() OVER (PARTITION BY cv ORDER BY chi2 DESC, feature_id) AS rn
      FROM (SELECT cv, feature_id, u * u / v AS chi2 FROM score)) WHERE rn <= 10"""
    one = "src AS (SELECT * FROM dense JOIN roles USING (sample_id) WHERE role = 'train' AND subtype = 'LUSC')"
    q["cox_screen_one_subtype"] = with_(COHORT, DENSE, ROLES, one, screen("src", ["cv", "feature_id"])) + """
    SELECT cv, feature_id, round(u * u / v, 6) AS chi2 FROM score"""
    q["linear_predictor"] = with_(DENSE, PREDICTOR) + " SELECT sample_id, round(score, 6) AS score FROM predictor"
    q["concordance_by_subtype"] = with_(COHORT, DENSE, PREDICTOR, """
    src AS (SELECT subtype, time, event, round(score, 9) AS score FROM predictor JOIN cohort USING (sample_id))""",
                                        concordance("src", ["subtype"]))
    q["concordance_all"] = with_(COHORT, CLINICAL, """
    src AS (SELECT time, event, floor(acctbal / 500) AS score FROM cohort JOIN clinical USING (sample_id))""",
                                 concordance("src", []))

    q["null_sentinels"] = with_(COHORT, CLINICAL) + """
    SELECT nullif(stage, '4-NOT SPECIFIED') AS stage, count(*) AS n FROM clinical GROUP BY 1"""
    q["null_rare"] = """SELECT CASE WHEN c >= 30 THEN p_name END AS p_name, count(*) AS n
    FROM (SELECT p_name, count(*) OVER (PARTITION BY p_name) AS c FROM part) GROUP BY 1"""
    code = "CASE WHEN {0} IS NOT NULL THEN dense_rank() OVER (ORDER BY {0} NULLS LAST) END AS {0}"
    q["label_encode"] = with_(COHORT, CLINICAL) + f"""
    SELECT sample_id, {code.format('nation')}, {code.format('region')}, {code.format('stage')}
    FROM (SELECT * REPLACE (nullif(stage, '4-NOT SPECIFIED') AS stage) FROM clinical)"""
    q["recode_groups"] = """SELECT CASE o_orderstatus WHEN 'F' THEN 'Dead' WHEN 'O' THEN 'Alive' ELSE o_orderstatus END AS status,
    'run-' || o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL"""
    q["survival_time"] = with_(COHORT) + """
    SELECT CAST(o_custkey AS VARCHAR) AS sample_id, CASE WHEN status = 'F' THEN time ELSE time + 1 END AS time,
           CAST(CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS BIGINT) AS event FROM follow"""
    q["five_year_groups"] = with_(COHORT) + """
    SELECT sample_id, CAST(time AS BIGINT) AS time, subtype || ' - ' || CASE WHEN time > 1825 THEN 'Alive' ELSE 'Dead' END AS group_label
    FROM cohort WHERE time > 1825 OR (event = 1 AND time < 1825)"""
    q["volume_product"] = """SELECT p_partkey, round(CAST(p_size AS DOUBLE) * CAST(nullif(p_size % 7, 0) AS DOUBLE) * p_retailprice, 6) AS volume FROM part"""
    rank = "CASE WHEN {0} IS NOT NULL THEN dense_rank() OVER (ORDER BY {0} NULLS LAST) END AS {0}"
    coded = ("stage", "prior_malignancy", "n", "m", "t", "gender", "synchronous_malignancy", "subtype")
    q["build_cohort"] = with_(SPECIMENS, ELIGIBLE) + f""",
    known AS (SELECT * REPLACE (nullif(prior_malignancy, 'not reported') AS prior_malignancy,
                                nullif(synchronous_malignancy, 'Not Reported') AS synchronous_malignancy, nullif(n, 'NX') AS n,
                                nullif(m, 'MX') AS m, nullif(t, 'TX') AS t) FROM specimens),
    codes AS (SELECT * REPLACE ({', '.join(rank.format(c) for c in coded)}) FROM known),
    rows AS (SELECT c.sample_id AS specimen, e.sample_id, e.subtype, c.subtype AS subtype_code, patient, stage, t, n, m, prior_malignancy,
                    synchronous_malignancy, gender, age_at_index, pack_years_smoked, dim_short * dim_mid * dim_long AS volume,
                    coalesce(days_to_death, days_to_last_follow_up) AS time,
                    CAST(CASE WHEN vital_status = 'Dead' THEN 1 WHEN vital_status IS NOT NULL THEN 0 END AS BIGINT) AS event
             FROM codes c JOIN eligible e ON substr(c.sample_id, 1, 19) = e.sample_id WHERE sample_type = 'TP')
    SELECT * FROM rows WHERE time > 1 QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY specimen) = 1"""
    q["methylation_flow"] = with_(COHORT, ELIGIBLE) + """,
    probes AS (
      SELECT printf('CUST-%014d', o_custkey) AS sample_id, o_orderkey,
             (CASE WHEN l_returnflag = 'R' THEN 'rs' ELSE 'cg' END) || '-' || l_linenumber || '-' || l_returnflag AS feature_id, l_linenumber AS line,
             CASE WHEN o_orderkey % 9 <> 4 THEN avg(l_discount * 5 + l_tax) END AS value
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, l_returnflag, l_linenumber),
    one AS (SELECT * FROM probes WHERE sample_id IN (SELECT sample_id FROM eligible)
            QUALIFY row_number() OVER (PARTITION BY sample_id, feature_id ORDER BY o_orderkey) = 1),
    plain AS (SELECT * FROM one WHERE feature_id NOT LIKE 'rs%'),
    dense_ AS (SELECT * FROM plain WHERE feature_id IN (
                 SELECT feature_id FROM plain GROUP BY feature_id
                 HAVING (SELECT count(DISTINCT sample_id) FROM plain) - count(value) < 0.6 * (SELECT count(DISTINCT sample_id) FROM plain))),
    full_ AS (SELECT * FROM dense_ WHERE sample_id IN (
                SELECT sample_id FROM dense_ GROUP BY sample_id
                HAVING (SELECT count(DISTINCT feature_id) FROM dense_) - count(value) < 0.6 * (SELECT count(DISTINCT feature_id) FROM dense_))),
    island AS (SELECT * FROM full_ WHERE line <> 2),
    best AS (SELECT feature_id FROM island GROUP BY feature_id ORDER BY var_samp(value) DESC NULLS LAST, feature_id LIMIT 8)
    SELECT 'methylation' AS modality, sample_id, feature_id, round(value, 6) AS value FROM island
    WHERE feature_id IN (SELECT feature_id FROM best)
      AND sample_id IN (SELECT printf('CUST-%014d', CAST(sample_id AS BIGINT)) FROM cohort)"""
    q["text_round_trip"] = with_(SPECIMENS) + " SELECT * FROM specimens"

    q["barcode_substring"] = "SELECT substr(c_name, 1, 15) AS barcode, count(*) AS n FROM customer GROUP BY 1"
    q["split_nth"] = r"""SELECT page_id, regexp_extract(url, '^[^/]*/[^/]*/[^/]*/(.*)$', 1) AS part FROM pages"""
    q["regex_strip"] = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS first FROM pages"
    q["cast_numeric"] = """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS a,
    TRY_CAST(o_orderstatus AS DOUBLE) AS b FROM orders"""
    q["round_half_even"] = """SELECT l_suppkey, round_even(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 8.0::DOUBLE, 2) AS v,
    round(sqrt(CAST(abs(count(*) - 100) AS DOUBLE)), 6) AS root FROM lineitem GROUP BY l_suppkey"""
    q["first_per_key"] = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn
      FROM lineitem) WHERE rn = 1"""
    q["first_column_per_name"] = with_(LINES) + """
    SELECT sample_id, feature_id, value FROM (
      SELECT sample_id, l_returnflag AS feature_id, l_quantity AS value, row_number() OVER (
        PARTITION BY sample_id, l_returnflag ORDER BY l_orderkey, l_linenumber, l_quantity) AS rn FROM lines) WHERE rn = 1"""
    q["symmetric_difference"] = """
    WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'),
         b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    (SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)"""
    q["first_match_lookup"] = """
    SELECT b.p_brand, s.p_partkey, s.p_name FROM (SELECT DISTINCT p_brand FROM part) b
    LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) s
    ON s.p_brand = b.p_brand AND s.rn = 1"""
    q["subtype_crosstab"] = with_(COHORT, CLINICAL) + """
    SELECT subtype, region, count(*) AS n FROM cohort JOIN clinical USING (sample_id) GROUP BY ALL"""
    q["set_operations"] = """
    WITH a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS sample_id FROM orders),
         b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS sample_id FROM events)
    SELECT sample_id, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
    UNION ALL SELECT sample_id, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
    q["union_fill"] = """SELECT s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
    UNION ALL SELECT c_name, NULL, c_mktsegment FROM customer"""
    q["stratified_folds"] = with_(COHORT, FOLDS) + " SELECT sample_id, subtype, fold FROM folds"
    q["fold_roles"] = with_(COHORT, ROLES) + """
    SELECT cv, role, subtype, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM roles
    WHERE role = 'test' OR subtype = 'LUAD' GROUP BY cv, role, subtype"""

    q["zero_filter"] = with_(COHORT, BRAND) + """
    SELECT feature_id, round(sum(value), 6) AS total FROM brand GROUP BY feature_id
    HAVING sum(CASE WHEN value = 0 THEN 1 ELSE 0 END) < 0.2 * (SELECT count(*) FROM cohort)"""
    q["missing_feature_filter"] = with_(COHORT, DISCOUNT) + """
    SELECT feature_id, count(value) AS n FROM discount GROUP BY feature_id
    HAVING count(*) - count(value) < 0.23 * (SELECT count(*) FROM cohort)"""
    q["missing_sample_filter"] = with_(COHORT, DISCOUNT) + """
    SELECT sample_id, count(value) AS n FROM discount GROUP BY sample_id HAVING count(*) - count(value) < 0.2 * count(*)"""
    q["top_variance"] = with_(COHORT, BRAND) + """
    SELECT feature_id, round(var_samp(value), 6) AS var FROM brand GROUP BY feature_id
    ORDER BY var_samp(value) DESC, feature_id LIMIT 10"""
    q["annotation_filter"] = with_(COHORT, BRAND, GENES) + """
    SELECT feature_id, round(avg(value), 6) AS mean FROM brand
    WHERE feature_id IN (SELECT p_brand FROM first_part WHERE p_type = 'PROMO') GROUP BY feature_id"""
    q["feature_split"] = with_(COHORT, BRAND) + """
    SELECT CASE WHEN feature_id IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 25) THEN 'listed' ELSE 'other' END AS side,
           feature_id, round(sum(value), 6) AS total FROM brand GROUP BY ALL"""
    q["prefix_select"] = with_(COHORT, BRAND) + """
    SELECT feature_id, round(sum(value), 6) AS total FROM brand
    WHERE feature_id LIKE 'Brand#1%' AND feature_id NOT LIKE '%9%' GROUP BY feature_id"""
    q["zscore_by_role"] = with_(COHORT, DENSE, ROLES) + """
    SELECT cv, role, sample_id, feature_id,
           round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) AS value
    FROM dense JOIN roles USING (sample_id) WINDOW w AS (PARTITION BY cv, role, feature_id)"""
    q["zscore_train_reference"] = with_(COHORT, BRAND, ROLES) + """,
    x AS (SELECT * FROM brand JOIN roles USING (sample_id)),
    s AS (SELECT cv, feature_id, avg(value) AS m, stddev_samp(value) AS sd FROM x WHERE role = 'train' GROUP BY ALL),
    z AS (SELECT cv, role, feature_id, (value - m) / sd AS z FROM x JOIN s USING (cv, feature_id))
    SELECT cv, role, feature_id, round(avg(z), 6) + 0.0::DOUBLE AS mean, round(stddev_samp(z), 6) AS sd FROM z GROUP BY ALL"""
    q["median_impute_by_role"] = with_(COHORT, DISCOUNT, FOLDS) + """
    SELECT fold, sample_id, feature_id, round(coalesce(value, median(value) OVER (PARTITION BY fold, feature_id)), 6) AS value
    FROM discount JOIN folds USING (sample_id)"""
    q["complete_features"] = with_(DENSE, ACTIVITY) + """
    SELECT modality, feature_id, count(*) AS n FROM (
      SELECT 'dense' AS modality, * FROM dense UNION ALL SELECT 'activity', * FROM activity)
    GROUP BY ALL HAVING count(value) = (SELECT count(DISTINCT sample_id) FROM dense)"""

    q["corrupt_zeros"] = with_(DENSE) + """
    SELECT sample_id, feature_id, round(CASE WHEN row_number() OVER (
             PARTITION BY feature_id ORDER BY md5('dense|' || feature_id || '|' || sample_id || '|5'))
             <= floor(0.3 * count(*) OVER (PARTITION BY feature_id)) THEN 0.0 ELSE value END, 6) AS value FROM dense"""
    q["corrupt_gaussian"] = with_(DENSE) + """,
    h AS (SELECT *, md5('dense|' || feature_id || '|' || sample_id || '|5') AS h FROM dense),
    u AS (SELECT *, (CAST('0x' || substr(h, 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS a,
                 (CAST('0x' || substr(h, 9, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS b FROM h)
    SELECT sample_id, feature_id, round(value + 0.5::DOUBLE * sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) AS value FROM u"""

    q["unpivot_modality"] = """
    SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, 'tax' AS feature_id, round(avg(l_tax), 6) AS value FROM lineitem GROUP BY l_suppkey
    UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 'discount', round(avg(l_discount), 6) FROM lineitem GROUP BY l_suppkey"""
    q["pivot_modality"] = with_(ACTIVITY) + " SELECT sample_id" + "".join(
        f", round(max(CASE WHEN feature_id = '{k}' THEN value END), 6) AS \"{k}\""
        for k in ("click", "error", "purchase", "signup", "view")) + " FROM activity GROUP BY sample_id"
    q["feature_dictionary"] = """
    WITH f AS (SELECT DISTINCT 'brand' AS modality, p_brand AS feature_id, 'Gene Expression' AS label FROM part
               UNION ALL SELECT DISTINCT 'activity', event_type, 'miRNA' FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY modality ORDER BY feature_id) AS pos,
                 count(*) OVER (PARTITION BY modality) AS p FROM f)
    SELECT modality, feature_id, pos, p, label || pos AS short_name FROM r"""
    q["assemble_explode"] = with_(COHORT, DISCOUNT) + " SELECT sample_id, feature_id, round(value, 6) AS value FROM discount"
    union = """
    rows_ AS (SELECT 'brand' AS modality, * FROM brand UNION ALL SELECT 'activity', * FROM activity
              UNION ALL SELECT 'dense', * FROM dense)"""
    q["join_modalities"] = with_(COHORT, BRAND, ACTIVITY, DENSE, union) + """
    SELECT sample_id, modality, count(value) AS n, round(sum(value), 6) AS total FROM rows_ WHERE sample_id IN (
      SELECT sample_id FROM rows_ GROUP BY sample_id HAVING count(DISTINCT modality) = 3) GROUP BY ALL"""
    q["common_features"] = with_(COHORT, ACTIVITY) + """
    SELECT sample_id, subtype, feature_id, round(value, 6) AS value FROM activity JOIN cohort USING (sample_id)
    WHERE feature_id NOT IN ('view', 'click')"""
    q["attach_outcome"] = with_(COHORT, CLINICAL, ACTIVITY) + """
    SELECT sample_id, feature_id, round(value, 6) AS value, CAST(time AS BIGINT) AS time, CAST(event AS BIGINT) AS event, region
    FROM activity JOIN cohort USING (sample_id) JOIN clinical USING (sample_id)"""
    q["combo_grid"] = with_(COHORT, CLINICAL, BRAND, DISCOUNT_ONLY, ACTIVITY, DENSE) + f""",
    rows_ AS (SELECT 'LNC' AS modality, * FROM discount UNION ALL SELECT 'miRNA', * FROM activity
              UNION ALL SELECT 'Gene', * FROM brand UNION ALL SELECT 'Meth', * FROM dense
              UNION ALL SELECT 'Clin', sample_id, 'acctbal', acctbal FROM clinical),
    combos(integration, combo, modality) AS (VALUES {combos()})
    SELECT integration, combo, count(value) AS n, count(DISTINCT modality || '/' || feature_id) AS features
    FROM rows_ JOIN combos USING (modality) GROUP BY integration, combo"""

    beta = "CASE WHEN {0} > 0 AND {0} < 1 THEN log2({0} / (1 - {0})) END"
    q["beta_to_m"] = with_(COHORT, DISCOUNT) + f"""
    SELECT sample_id, feature_id, round({beta.format('b')}, 6) AS value FROM (SELECT *, value * 10.0::DOUBLE AS b FROM discount)"""
    q["collapse_to_gene"] = with_(COHORT, BRAND, GENES) + """
    SELECT sample_id, gene AS feature_id, round(avg(value), 6) AS value FROM brand JOIN genes USING (feature_id) GROUP BY ALL"""
    q["methylation_by_gene"] = with_(COHORT, BRAND, GENES) + f""",
    m AS (SELECT sample_id, feature_id, {beta.format('b')} AS value
          FROM (SELECT *, (value + 1.0::DOUBLE) / 400.0::DOUBLE AS b FROM brand)),
    ok AS (SELECT feature_id FROM m GROUP BY feature_id HAVING count(value) = count(*))
    SELECT sample_id, gene AS feature_id, round(avg(value), 6) AS value
    FROM m JOIN ok USING (feature_id) JOIN genes USING (feature_id) GROUP BY ALL"""
    q["two_groups"] = with_(COHORT, GROUPS) + """
    SELECT grp, count(*) AS n, CAST(sum(event) AS BIGINT) AS events FROM groups GROUP BY grp"""
    q["anova_by_feature"] = with_(COHORT, DENSE, GROUPS, anova("dense", "groups"))
    q["anova_many_groups"] = with_(COHORT, CLINICAL, BRAND, "g AS (SELECT sample_id, region AS grp FROM clinical)",
                                   anova("brand", "g", 4))
    q["anova_p_values"] = with_(COHORT, CLINICAL, BRAND, "g AS (SELECT sample_id, region AS grp FROM clinical)",
                                anova_totals("brand", "g")) + f"""
    SELECT feature_id, df, df_resid, round({F_FOUR}, 9) AS p FROM (SELECT *, sum_sq / ssw AS u FROM total)"""
    q["differential_methylation"] = with_(COHORT, DENSE, GROUPS, anova_totals("dense", "groups")) + f""",
    m AS (SELECT feature_id, avg(CASE WHEN grp = 'BadPrognosis' THEN value END)
                 - avg(CASE WHEN grp = 'GoodPrognosis' THEN value END) AS d
          FROM dense JOIN groups USING (sample_id) GROUP BY feature_id),
    tested AS (SELECT *, {F_ONE} AS p FROM (SELECT *, sum_sq / ssw AS u FROM total)),
    ranked AS (SELECT *, row_number() OVER (ORDER BY p, feature_id) AS r, count(*) OVER () AS n FROM tested)
    SELECT feature_id, round(d, 6) AS mean_difference, df, df_resid, round(sum_sq, 6) AS sum_sq,
           round(sum_sq / df, 6) AS mean_sq, round((sum_sq / df) / (ssw / df_resid), 6) AS f_value, round(p, 9) AS p,
           round(least(1.0::DOUBLE, min(p * n / r) OVER (ORDER BY r DESC)), 9) AS padj
    FROM ranked JOIN m USING (feature_id)"""
    q["mean_difference"] = with_(COHORT, DENSE, GROUPS) + """,
    m AS (SELECT feature_id, avg(CASE WHEN grp = 'BadPrognosis' THEN value END)
                 - avg(CASE WHEN grp = 'GoodPrognosis' THEN value END) AS d
          FROM dense JOIN groups USING (sample_id) GROUP BY feature_id)
    SELECT feature_id, round(d, 6) AS mean_difference, round(abs(d), 6) AS abs_difference FROM m"""
    q["bh_adjust"] = with_(P_VALUES, bh())
    q["bh_adjust_by_type"] = with_(P_VALUES, bh(["p_type"]))
    q["volcano_label"] = """
    WITH x AS (SELECT c_custkey, c_acctbal / 5000.0::DOUBLE - 1 AS lfc,
                      nullif(CAST(c_custkey % 20 AS DOUBLE) / 100.0::DOUBLE, 0.1::DOUBLE) AS padj FROM customer)
    SELECT c_custkey, CASE WHEN lfc > 0.58 AND padj < 0.05 THEN 'UP' WHEN lfc < -0.58 AND padj < 0.05 THEN 'DOWN'
           ELSE 'NO' END AS diffexpressed, round(-log10(padj + 0.001::DOUBLE), 6) AS neg_log10_p FROM x"""
    q["raw_expression"] = with_(COHORT) + """,
    spec AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 19, '0') AS sample_id, o_orderkey, p_brand AS feature_id, sum(l_quantity) AS value
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    first_one AS (SELECT sample_id, min(o_orderkey) AS o_orderkey FROM spec GROUP BY sample_id),
    padded AS (SELECT lpad(sample_id, 19, '0') AS sample_id, subtype, event FROM cohort),
    grid AS (SELECT f.sample_id, b.feature_id, coalesce(s.value, 0.0) AS value
             FROM first_one f JOIN padded c ON c.sample_id = f.sample_id AND c.subtype = 'LUSC'
             CROSS JOIN (SELECT DISTINCT feature_id FROM spec) b
             LEFT JOIN spec s ON s.sample_id = f.sample_id AND s.o_orderkey = f.o_orderkey AND s.feature_id = b.feature_id
             WHERE b.feature_id NOT IN (SELECT p_brand FROM part GROUP BY p_brand HAVING avg(p_size) > 26)),
    kept AS (SELECT feature_id FROM grid GROUP BY feature_id
             HAVING count(*) FILTER (value = 0) < 0.85 * (SELECT count(DISTINCT sample_id) FROM grid))
    SELECT 'mRNA' AS modality, sample_id, feature_id, value FROM grid
    WHERE feature_id IN (SELECT feature_id FROM kept) AND sample_id IN (SELECT sample_id FROM padded WHERE event = 0)"""
    q["size_factors"] = """
    WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS sample_id, p_brand, count(*) AS k
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    g AS (SELECT p_brand, avg(ln(k)) AS g FROM c GROUP BY p_brand HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM c))
    SELECT sample_id, round(exp(median(ln(k) - g)), 6) AS size_factor FROM c JOIN g USING (p_brand) GROUP BY sample_id"""

    se = "stddev_samp({0}) / sqrt(CAST(count({0}) AS DOUBLE))"
    q["results_mean_se"] = with_(RESULTS) + " SELECT data_types, reduction" + "".join(
        f", round(avg({c}), 6) AS {c}, round({se.format(c)}, 6) AS se_{c}"
        for c in ("cindex", "cindex_a", "cindex_b")) + " FROM results GROUP BY ALL"
    q["results_unpivot"] = with_(RESULTS, summary()) + " SELECT * FROM summary"
    canon = """canon AS (SELECT * REPLACE (CASE data_types WHEN 'Meth-Clin-LNC' THEN 'Meth-LNC-Clin'
      WHEN 'Gene-LNC-Clin-miRNA' THEN 'Gene-LNC-miRNA-Clin' ELSE data_types END AS data_types) FROM results)"""
    q["canonical_combo"] = with_(RESULTS, canon, summary("canon", 2)) + " SELECT * FROM summary"
    q["report_comparisons"] = with_(RESULTS, summary()) + """,
    o AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY cindex, data_types, reduction) AS place FROM summary),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY cindex DESC, data_types, reduction) AS rn
                            FROM o WHERE data_types LIKE '%-%' OR data_types LIKE 'Multimodal%') WHERE rn <= 3)
    SELECT CASE WHEN data_types = 'Multimodal (Early)' THEN 'Multimodal' ELSE data_types END AS data_types,
           reduction, subtype, cindex, se, place, 'individual' AS kind FROM o
    WHERE data_types IN ('Clinical', 'miRNA', 'mRNA', 'Methylation', 'LNC RNAs', 'Multimodal (Early)')
    UNION ALL SELECT data_types, reduction, subtype, cindex, se, place, 'two_omics' FROM o
    WHERE data_types IN ('mRNA', 'LNC RNAs')
    UNION ALL SELECT data_types, reduction, subtype, cindex, se, place, 'best' FROM best
    UNION ALL SELECT data_types, reduction, subtype, cindex, se, place, 'containing' FROM o
    WHERE data_types = 'LNC RNAs' OR (reduction = 'One AE' AND data_types IN ('Meth-Clin-LNC', 'Gene-LNC-Clin-miRNA'))
    UNION ALL SELECT data_types, reduction, subtype, cindex, se, place, 'integration' FROM o
    WHERE data_types = 'Multimodal (Early)'"""
    q["report_reductions"] = with_(RESULTS, summary()) + """
    SELECT *, reduction AS dimensionality_reduction,
           CAST(CASE reduction WHEN 'PCA' THEN 1 WHEN 'Feature Selection' THEN 2 ELSE 3 END AS BIGINT) AS method_order
    FROM summary WHERE data_types = 'Multimodal (Early)'"""

    q["silhouette"] = with_(DENSE) + """,
    v AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(label AS BIGINT) AS cluster, CAST(embedding AS DOUBLE[]) AS x
          FROM embeddings WHERE vec_id IN (SELECT c_custkey FROM customer)),
    d AS (SELECT a.sample_id, a.cluster, b.cluster AS other, sum(pow(list_distance(a.x, b.x), 2)) AS s,
                 count(*) - max(CASE WHEN a.cluster = b.cluster THEN 1 ELSE 0 END) AS n
          FROM v a JOIN v b ON true GROUP BY ALL),
    m AS (SELECT sample_id, cluster, max(CASE WHEN cluster = other THEN s / nullif(n, 0) END) AS a,
                 min(CASE WHEN cluster <> other THEN s / n END) AS b FROM d GROUP BY ALL)
    SELECT sample_id, cluster, round(coalesce((b - a) / greatest(a, b), 0), 6) AS silhouette FROM m"""
    q["clinical_modality"] = with_(COHORT, CLINICAL, ROLES) + f""",
    codes AS (SELECT sample_id, acctbal, {code.format('nation')}, {code.format('region')}, {code.format('segment')},
                     {code.format('stage')}
              FROM (SELECT * REPLACE (nullif(stage, '4-NOT SPECIFIED') AS stage) FROM clinical)),
    long AS (""" + " UNION ALL ".join(
        f"SELECT sample_id, '{c}' AS feature_id, CAST({c} AS DOUBLE) AS value FROM codes"
        for c in ("acctbal", "nation", "region", "segment", "stage")) + """),
    z AS (SELECT cv, role, sample_id, feature_id, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z
          FROM long JOIN roles USING (sample_id) WINDOW w AS (PARTITION BY cv, role, feature_id))
    SELECT cv, role, sample_id, feature_id,
           round(coalesce(z, median(z) OVER (PARTITION BY cv, role, feature_id), 0), 6) AS value FROM z"""
    return q

"""Target inspection, feature audit, splits and preparation."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colonnade.operators import audit, catalog, features, split, suitability
from colonnade.operators import target as targets
from colonnade.plans.prepare import prepare
from workload.explore import profile_sql
from workload.profile import summary_sql
from workload.registry import LABELLED, hash_sql, labelled, pct, query, table, union_all

PART = [
    ("p_partkey", "int", "bigint"), ("p_name", "text", "string"), ("p_brand", "text", "string"),
    ("p_type", "text", "string"), ("p_size", "int", "int"), ("p_retailprice", "real", "double"),
    ("size_copy", "int", "int"), ("price_copy", "real", "double"), ("one", "int", "int"),
]
PART_SQL = "(SELECT *, p_size AS size_copy, p_retailprice AS price_copy, 1 AS one FROM part)"
PART_SUMMARY = f"({summary_sql(PART, PART_SQL)})"


def parts(spark, sf):
    return table(spark, sf, "part").withColumns({
        "size_copy": F.col("p_size"), "price_copy": F.col("p_retailprice"), "one": F.lit(1)})


def facts_sql(t: str, source: str, decimals: str) -> str:
    return f"""SELECT '{t}' AS target, count(*) AS total_count, count({t}) AS valid_count, count(*) - count({t}) AS missing_count,
  {pct(f'count(*) - count({t})', 'count(*)')} AS missing_percentage, count(DISTINCT {t}) AS unique_count,
  {decimals} AS has_decimals, count(DISTINCT {t})::DOUBLE / count({t}) > 0.95 AND count({t}) > 50 AS id_warning,
  CASE WHEN count({t}) < 10 THEN 'fewer than 10 observations' WHEN count(DISTINCT {t}) <= 1 THEN 'constant' END AS problem
FROM {source}"""


_TARGETS = [("quality", LABELLED, "false"), ("p_size", "part", "false"),
            ("p_retailprice", "part", "bool_or(p_retailprice <> round(p_retailprice))"), ("o_orderstatus", "orders", "false"),
            ("one", PART_SQL, "false"), ("p_partkey", "part", "false")]


def _target_frames(spark, sf):
    return [("quality", labelled(spark, sf), "boolean"), ("p_size", table(spark, sf, "part"), "integer"),
            ("p_retailprice", table(spark, sf, "part"), "float"), ("o_orderstatus", table(spark, sf, "orders"), "categorical"),
            ("one", parts(spark, sf), "boolean"), ("p_partkey", table(spark, sf, "part"), "integer")]


def _stack(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("tgt1_target_checks", union_all([facts_sql(*t) for t in _TARGETS]))
def tgt1(spark, sf):
    return _stack([targets.target_facts(df, t) for t, df, _ in _target_frames(spark, sf)])


_KIND = {"quality": "boolean", "p_size": "integer", "p_retailprice": "float", "o_orderstatus": "categorical",
         "one": "boolean", "p_partkey": "integer"}


def _problem_sql(t, source, decimals):
    number = _KIND[t] in ("integer", "float")
    rest = ("""CASE WHEN has_decimals OR unique_count > 30 THEN {0} WHEN unique_count BETWEEN 3 AND 20 THEN {1} ELSE {2} END"""
            if number else "CASE WHEN unique_count <= 100 THEN {0} ELSE {1} END")
    kinds = ("'regression'", "'ambiguous'", "'regression'") if number else ("'multiclass_classification'", "'ambiguous'")
    sure = ("'high'", "'medium'", "'medium'") if number else ("'high'", "'low'")
    return f"""SELECT target, unique_count, CASE WHEN unique_count = 2 THEN 'binary_classification' ELSE {rest.format(*kinds)} END
  AS problem_type, CASE WHEN unique_count = 2 THEN 'high' ELSE {rest.format(*sure)} END AS confidence
FROM ({facts_sql(t, source, decimals)})"""


@query("tgt2_problem_type", union_all([_problem_sql(*t) for t in _TARGETS]))
def tgt2(spark, sf):
    return _stack([
        targets.with_problem_type(targets.target_facts(df, t), kind).select("target", "unique_count", "problem_type", "confidence")
        for t, df, kind in _target_frames(spark, sf)])


def balance_sql(t: str, source: str) -> str:
    return f"""SELECT class_label, n, percentage, min(percentage) OVER () AS minority_percentage,
  min(percentage) OVER () < 15 AS is_imbalanced FROM (
  SELECT {t}::VARCHAR AS class_label, count(*) AS n, round(count(*)::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100.0::DOUBLE, 2)
    AS percentage FROM {source} WHERE {t} IS NOT NULL GROUP BY 1)"""


@query("tgt3_class_balance", balance_sql("quality", LABELLED))
def tgt3(spark, sf):
    return targets.class_balance(labelled(spark, sf), "quality")


@query("tgt4_regression_target_profile", f"""SELECT p."column", mean, median, std, min, max, q1, q3, iqr,
  (SELECT count(*) FROM documents, (SELECT quantile_cont(n_chars::DOUBLE, 0.25) AS a, quantile_cont(n_chars::DOUBLE, 0.75) AS b
    FROM documents) WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)) AS extreme_count
FROM ({profile_sql(['n_chars'], 'documents')}) p""")
def tgt4(spark, sf):
    return targets.regression_target_profile(table(spark, sf, "documents"), "n_chars")


_FLAGS = """concat_ws(',', CASE WHEN unique_count <= 1 THEN 'constant_column' END,
  CASE WHEN unique_count > 50 AND unique_count::DOUBLE / row_count >= 0.95 THEN 'potential_id' END,
  CASE WHEN missing_percentage >= 70 THEN 'excessive_missingness' END,
  CASE WHEN inferred_dtype = 'text' THEN 'free_form_text' END,
  CASE WHEN inferred_dtype = 'categorical' AND unique_count > 50 THEN 'high_cardinality_categorical' END{copies})"""
_COPIES = """, CASE WHEN "column" IN ('size_copy', 'price_copy') THEN 'duplicate_feature' END"""
_AUDIT = f"""SELECT position, "column", inferred_dtype, flags,
  CASE WHEN contains(flags, 'constant_column') OR contains(flags, 'duplicate_feature') THEN 'flagged_exclude'
    WHEN flags <> '' THEN 'review_recommended' ELSE 'included' END AS status,
  CASE WHEN flags <> '' THEN 'exclude' ELSE 'include' END AS recommended_action
FROM (SELECT *, {_FLAGS.format(copies=_COPIES)} AS flags FROM {PART_SUMMARY} WHERE "column" <> 'p_size')"""


@query("aud1_feature_audit", _AUDIT)
def aud1(spark, sf):
    a = audit.feature_audit(parts(spark, sf), "p_size")
    return a.select("position", "column", "inferred_dtype", F.array_join("flags", ",").alias("flags"), "status",
                    "recommended_action")


@query("aud2_feature_flags", f"""SELECT "column", {_FLAGS.format(copies='')} AS flags FROM {PART_SUMMARY}""")
def aud2(spark, sf):
    flagged = audit.audit_flags(catalog.column_summary(parts(spark, sf)))
    return flagged.select("column", F.array_join("flags", ",").alias("flags"))


_OTHERS = [c for c, *_ in PART if c != "p_size"]


@query("aud3_target_copies", union_all([
    f"""SELECT '{c}' AS "column", {f'bool_and({c} IS NOT DISTINCT FROM p_size)' if c in ('size_copy', 'one') else 'bool_and(false)'} AS is_copy
FROM {PART_SQL}""" for c in _OTHERS]))
def aud3(spark, sf):
    return audit.target_copies(parts(spark, sf), "p_size")


@query("aud4_identical_columns", union_all([
    f"""SELECT '{b}' AS "column", '{a}' AS first_column FROM {PART_SQL} HAVING bool_and({a} IS NOT DISTINCT FROM {b})"""
    for a, b in (("p_size", "size_copy"), ("p_retailprice", "price_copy"), ("p_size", "one"), ("p_brand", "p_type"))]))
def aud4(spark, sf):
    return audit.identical_columns(parts(spark, sf))


@query("aud5_audit_totals", f"""SELECT count(*) AS total_candidates,
  count(*) FILTER (WHERE recommended_action = 'include') AS included_count,
  count(*) FILTER (WHERE recommended_action = 'exclude') AS excluded_count,
  count(*) FILTER (WHERE status = 'review_recommended') AS review_count FROM ({_AUDIT})""")
def aud5(spark, sf):
    return audit.audit_totals(audit.feature_audit(parts(spark, sf), "p_size"))


@query("sui1_training_suitability", f"""WITH c AS (SELECT quality, count(*) AS n FROM {LABELLED} WHERE quality IS NOT NULL GROUP BY 1),
f AS (SELECT sum(n) AS valid, count(*) AS classes, min(n) AS small, max(n) AS large FROM c)
SELECT 'blocking' AS severity, 'target_in_features' AS code, 'quality' AS detail
UNION ALL SELECT 'blocking', 'features_missing', 'quality_score'
UNION ALL SELECT 'warning', 'resembles_target', 'quality_score'
UNION ALL SELECT 'blocking', 'too_few_rows', valid::VARCHAR FROM f WHERE valid < 10
UNION ALL SELECT 'warning', 'small_table', valid::VARCHAR FROM f WHERE valid >= 10 AND valid < 100
UNION ALL SELECT 'warning', 'class_imbalance', round(large::DOUBLE / small, 1)::VARCHAR FROM f WHERE large::DOUBLE / small > 4""")
def sui1(spark, sf):
    return suitability.training_suitability(
        labelled(spark, sf), "quality", "binary_classification", ["lang", "source", "n_chars", "quality", "quality_score"])


def hold_out_sql(rows: str, share: float, salt: str, stratified: bool, key: str = "o_orderkey", cls: str = "o_orderstatus") -> str:
    """Rows of `rows` with `held`, by ranking every row: a plain statement of what the split must give."""
    label = cls if stratified else "'all'"
    return f"""(WITH t AS (SELECT *, {label}::VARCHAR AS cls_, {hash_sql(key, salt)} AS h_ FROM {rows}),
c AS (SELECT cls_, count(*) AS n FROM t GROUP BY 1),
a AS (SELECT cls_, n, sum(n) OVER () AS total, sum(n) OVER () - ceil({share}::DOUBLE * sum(n) OVER ()) AS keep FROM c),
b AS (SELECT cls_, n, keep, keep::DOUBLE * n / total AS exact FROM a),
k AS (SELECT cls_, n - (floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, cls_)
  <= keep - sum(floor(exact)) OVER () THEN 1 ELSE 0 END) AS held_n FROM b),
r AS (SELECT t.*, row_number() OVER (PARTITION BY cls_ ORDER BY h_) AS rn_ FROM t)
SELECT r.* EXCLUDE (cls_, h_, rn_), rn_ <= held_n AS held FROM r JOIN k USING (cls_))"""


def folds_sql(stratified: bool, source: str = "orders", **names) -> str:
    """Three folds: test, then a fifth of the rest as validation."""
    first = hold_out_sql(source, 0.2, "42", stratified, **names)
    rest = hold_out_sql(f"(SELECT * EXCLUDE (held) FROM {first} WHERE NOT held)", 0.2, "42-validation", stratified, **names)
    return f"""(SELECT * EXCLUDE (held), 'test' AS fold FROM {first} WHERE held
UNION ALL SELECT * EXCLUDE (held), CASE WHEN held THEN 'validation' ELSE 'train' END AS fold FROM {rest})"""


def _two(stratified: bool) -> str:
    return f"""SELECT o_orderkey, CASE WHEN held THEN 'test' ELSE 'train' END AS fold
FROM {hold_out_sql('orders', 0.2, '42', stratified)}"""


@query("spl1_random_split", _two(False))
def spl1(spark, sf):
    return split.train_test_split(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"], "regression")[0].select(
        "o_orderkey", "fold")


@query("spl2_stratified_split", _two(True))
def spl2(spark, sf):
    return split.train_test_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)[0].select(
        "o_orderkey", "fold")


@query("spl2_stratified_split_labels", f"""SELECT doc_id, CASE WHEN held THEN 'test' ELSE 'train' END AS fold
FROM {hold_out_sql('labels', 0.25, '7', True, key='doc_id', cls='quality')}""")
def spl2_labels(spark, sf):
    return split.train_test_split(labelled(spark, sf), "quality", ["doc_id"], targets.BINARY, 0.25, 7)[0].select("doc_id", "fold")


@query("spl3_disjointness", "SELECT 0::BIGINT AS shared, count(*) AS rows FROM orders")
def spl3(spark, sf):
    tagged, _ = split.train_test_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)
    sides = [tagged.filter(F.col("fold") == f) for f in ("train", "test")]
    shared = split.overlap(*sides, ["o_orderkey"]).agg(F.count("*").alias("shared"))
    return catalog.one_row(shared, tagged.agg(F.count("*").alias("rows")))


@query("spl4_split_report", f"""SELECT fold, o_orderstatus AS class_label, count(*) AS n,
  (sum(count(*)) OVER (PARTITION BY fold))::BIGINT AS fold_rows,
  round((sum(count(*)) OVER (PARTITION BY fold))::DOUBLE / (sum(count(*)) OVER ())::DOUBLE * 100.0::DOUBLE, 2) AS fold_percentage,
  'Stratified Shuffle Split' AS strategy
FROM (SELECT *, CASE WHEN held THEN 'test' ELSE 'train' END AS fold FROM {hold_out_sql('orders', 0.2, '42', True)}) GROUP BY 1, 2""")
def spl4(spark, sf):
    tagged, strategy = split.train_test_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)
    return split.split_report(tagged, strategy, "o_orderstatus", True)


@query("spl5_three_way_split", f"SELECT o_orderkey, fold FROM {folds_sql(True)}")
def spl5(spark, sf):
    return split.three_way_split(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)[0].select(
        "o_orderkey", "fold")


@query("pre1_active_features", f"""SELECT 'audit' AS choice, "column" FROM ({_AUDIT}) WHERE status <> 'flagged_exclude'
UNION ALL SELECT 'selected', "column" FROM ({_AUDIT}) WHERE "column" IN ('p_brand', 'p_type')
UNION ALL SELECT 'excluded', "column" FROM ({_AUDIT}) WHERE "column" NOT IN ('p_brand', 'p_type')""")
def pre1(spark, sf):
    a = audit.feature_audit(parts(spark, sf), "p_size")
    ways = {"audit": {}, "selected": {"selected": ["p_brand", "p_type", "p_size"]}, "excluded": {"excluded": ["p_brand", "p_type"]}}
    return _stack([audit.active_features(a, "p_size", **k).select(F.lit(w).alias("choice"), "column") for w, k in ways.items()])


# Orders with gaps: half-year dates, price bands and an empty priority for low ones.
GAP_ORDERS = """(SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority,
  CASE WHEN month(o_orderdate) > 2 THEN o_orderdate END AS day FROM orders)"""


def gap_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus",
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        F.when(F.month("o_orderdate") > 2, F.col("o_orderdate")).alias("day"))


def gap_folds(spark, sf):
    return split.three_way_split(gap_orders(spark, sf), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)[0]


GAP_FOLDS = folds_sql(True, GAP_ORDERS)


@query("pre2_column_routing", """SELECT 'day' AS "column", 'dates' AS path UNION ALL SELECT 'price', 'numeric'
UNION ALL SELECT 'priority', 'categorical'""")
def pre2(spark, sf):
    train = gap_folds(spark, sf).filter("fold = 'train'").select("price", "priority", "day")
    return features.routing_table(spark, features.route(catalog.column_types(train), train.columns))


@query("pre3_datetime_parts", f"""WITH f AS {GAP_FOLDS},
m AS (SELECT floor(quantile_cont(year(day)::DOUBLE, 0.5))::INTEGER AS y, floor(quantile_cont(month(day)::DOUBLE, 0.5))::INTEGER AS mo,
  floor(quantile_cont(day(day)::DOUBLE, 0.5))::INTEGER AS d, floor(quantile_cont((isodow(day) - 1)::DOUBLE, 0.5))::INTEGER AS w
  FROM f WHERE fold = 'train')
SELECT o_orderkey, coalesce(year(day), y)::INTEGER AS day_year, coalesce(month(day), mo)::INTEGER AS day_month,
  coalesce(day(day), d)::INTEGER AS day_day, coalesce(isodow(day) - 1, w)::INTEGER AS day_dayofweek FROM f, m""")
def pre3(spark, sf):
    f = gap_folds(spark, sf)
    model = features.DateParts(columns=["day"]).fit(f.filter("fold = 'train'"))
    return model.transform(f).select("o_orderkey", "day_year", "day_month", "day_day", "day_dayofweek")


def _fills_sql(aggregate: str) -> str:
    return f"SELECT 'price' AS \"column\", round({aggregate}, 4) AS fill FROM {GAP_FOLDS} WHERE fold = 'train'"


@query("pre4_numeric_imputation", f"""SELECT 'median' AS imputation, * FROM ({_fills_sql('quantile_cont(price, 0.5)')})
UNION ALL SELECT 'mean', * FROM ({_fills_sql('avg(price)')})
UNION ALL SELECT 'most_frequent', 'price', (SELECT round(price, 4) FROM {GAP_FOLDS} WHERE fold = 'train' AND price IS NOT NULL
  GROUP BY price ORDER BY count(*) DESC, price LIMIT 1)""")
def pre4(spark, sf):
    train = gap_folds(spark, sf).filter("fold = 'train'")
    out = []
    for how in ("median", "mean", "most_frequent"):
        model = features.NumberPrep(columns=["price"], imputation=how, scaling="none").fit(train)
        out.append(model.table(spark).select(F.lit(how).alias("imputation"), "column", F.round("fill", 4).alias("fill")))
    return _stack(out)


@query("pre5_standard_scaling", f"""WITH f AS {GAP_FOLDS}, m AS (SELECT quantile_cont(price, 0.5) AS fill FROM f WHERE fold = 'train'),
s AS (SELECT avg(coalesce(price, fill)) AS mu, stddev_pop(coalesce(price, fill)) AS sd FROM f, m WHERE fold = 'train')
SELECT o_orderkey, round((coalesce(price, fill) - mu) / sd, 4) AS price FROM f, m, s""")
def pre5(spark, sf):
    f = gap_folds(spark, sf)
    model = features.NumberPrep(columns=["price"]).fit(f.filter("fold = 'train'"))
    return model.transform(f).select("o_orderkey", F.round("price", 4).alias("price"))


@query("pre6_categorical_imputation", f"""WITH f AS {GAP_FOLDS}, m AS (SELECT priority AS fill FROM f WHERE fold = 'train'
  AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(priority, fill) AS most_frequent, coalesce(priority, '__MISSING__') AS constant FROM f, m""")
def pre6(spark, sf):
    f = gap_folds(spark, sf).withColumn("constant", F.col("priority"))
    train = f.filter("fold = 'train'")
    a = features.CategoryFill(columns=["priority"]).fit(train)
    b = features.CategoryFill(columns=["constant"], imputation="constant").fit(train)
    return b.transform(a.transform(f)).select("o_orderkey", F.col("priority").alias("most_frequent"), "constant")


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("pre7_one_hot_encoding", f"""SELECT o_orderkey, {', '.join(
    f'''CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END::BIGINT AS "o_orderpriority_{v}"''' for v in _LEVELS)} FROM orders""")
def pre7(spark, sf):
    done = prepare(table(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS, selected=["o_orderpriority"])
    values = vector_to_array("features")
    return done.transformed().select("o_orderkey", *[
        values[i].cast("long").alias(f) for i, (f, _) in enumerate(done.lineage)])


def _prepared(spark, sf):
    return prepare(gap_orders(spark, sf), "o_orderstatus", ["o_orderkey"], targets.MULTICLASS)


@query("pre8_assembled_transform", f"""WITH f AS {GAP_FOLDS}, m AS (SELECT quantile_cont(price, 0.5) AS fill FROM f WHERE fold = 'train'),
s AS (SELECT avg(coalesce(price, fill)) AS mu, stddev_pop(coalesce(price, fill)) AS sd FROM f, m WHERE fold = 'train'),
p AS (SELECT priority AS lvl FROM f WHERE fold = 'train' AND priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, fold, round((coalesce(price, fill) - mu) / sd, 4) AS price,
  {', '.join(f"CASE WHEN coalesce(priority, lvl) = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS p{i}" for i, v in enumerate(_LEVELS[:4]))}
FROM f, m, s, p""")
def pre8(spark, sf):
    done = _prepared(spark, sf)
    at = {f: i for i, (f, _) in enumerate(done.lineage)}
    v = vector_to_array("features")
    return done.transformed().select("o_orderkey", "fold", F.round(v[at["price"]], 4).alias("price"), *[
        v[at[f"priority_{level}"]].alias(f"p{i}") for i, level in enumerate(_LEVELS[:4])])


@query("pre9_feature_lineage", """SELECT (row_number() OVER () - 1)::BIGINT AS position, f AS feature, o AS original_feature FROM (VALUES
  ('price', 'price'), ('day_year', 'day'), ('day_month', 'day'), ('day_day', 'day'), ('day_dayofweek', 'day'),
  ('priority_1-URGENT', 'priority'), ('priority_2-HIGH', 'priority'), ('priority_3-MEDIUM', 'priority'),
  ('priority_4-NOT SPECIFIED', 'priority')) t(f, o)""")
def pre9(spark, sf):
    return features.lineage_table(spark, _prepared(spark, sf).lineage)


@query("pre10_preparation_report", f"""SELECT 3::BIGINT AS original_features, 3::BIGINT AS selected_features,
  0::BIGINT AS excluded_features, 9::BIGINT AS final_features, 5::BIGINT AS numeric_features, 1::BIGINT AS categorical_features,
  4::BIGINT AS datetime_features, 4::BIGINT AS one_hot_features, count(*) FILTER (WHERE fold = 'train') AS train_rows,
  count(*) FILTER (WHERE fold = 'validation') AS validation_rows, count(*) FILTER (WHERE fold = 'test') AS test_rows,
  'Stratified Shuffle Split' AS strategy FROM {GAP_FOLDS}""")
def pre10(spark, sf):
    return _prepared(spark, sf).report()


@query("pre11_feature_preview")
def pre11(spark, sf):
    return _prepared(spark, sf).preview()

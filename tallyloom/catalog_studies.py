"""Registered queries of studies and reports over the given tables; see ``catalog``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyloom.catalog import query, rounded
from tallyloom.functions import numeric
from tallyloom.functions.numeric import CONFIGS
from tallyloom.operators import effects, scoring, search, summaries
from tallyloom.plans import grid, inputs, retrieval


def _pairs(i: int) -> list[tuple[str, str]]:
    return [(c, f"{c[:i]}1{c[i + 1 :]}") for c in CONFIGS if c[i] == "0"]


# --- effects ---------------------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT query, count(*)::DOUBLE AS weight FROM qrels WHERE grade > 0 GROUP BY 1), a AS (SELECT "
    + ", ".join(f"sum(c{c} * weight) / sum(weight) AS c{c}" for c in CONFIGS)
    + " FROM wide JOIN n USING (query)), b AS (SELECT c111 - c000 AS delta, (SELECT stddev_pop(x) FROM (SELECT unnest(["
    + ", ".join(f"c{c}" for c in CONFIGS)
    + "]) AS x)) AS spread FROM a) SELECT round(delta, 6) AS delta, round(spread, 6) AS spread, round(CASE WHEN spread > 1e-12 THEN delta / spread END, 6) AS margin FROM b"
)
def weighted_effect(spark, d):
    """The paired effect with queries weighed by their judged documents."""
    weights = inputs.qrels(spark, d).where("grade > 0").groupBy("query").agg(F.count("*").cast("double").alias("weight"))
    return rounded(effects.weighted_effect(effects.wide(retrieval.outcomes(spark, d)).join(weights, "query")), "delta", "spread", "margin")


@query(
    "WITH m AS (SELECT " + ", ".join(f"sum(c{c}::DECIMAL(28, 12)) AS m{c}" for c in CONFIGS) + " FROM wide) SELECT ("
    + " + ".join("(" + " OR ".join(f"m{a} != m{b}" for a, b in _pairs(i)) + ")::INT" for i in range(3)) + ")::INT AS responsive_switches FROM m"
)
def responsive_on_average(spark, d):
    return effects.responsive_on_average(effects.wide(retrieval.outcomes(spark, d)))


@query("""WITH v AS (SELECT l_returnflag || l_linestatus AS cell, var_pop(round(l_discount, 2)) * CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS variance FROM lineitem GROUP BY 1, l_returnflag),
    f AS (SELECT quantile_cont(variance, 0.5) FILTER (variance > 0) / 20 AS floor FROM v), a AS (SELECT cell, 1 / greatest(variance, floor) AS w FROM v, f), b AS (SELECT cell, least(w, quantile_cont(w, 0.5) OVER () * 20) AS c FROM a)
    SELECT cell, round(c / avg(c) OVER (), 6) AS weight FROM b""")
def precision_weights_with_zeros(spark, d):
    """Precision weights where some variances are 0."""
    rows = inputs.table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("cell"), "l_returnflag").agg(F.var_pop(F.round("l_discount", 2)).alias("v"))
    rows = rows.select("cell", (F.col("v") * F.when(F.col("l_returnflag") == "A", 0).otherwise(1)).alias("variance"))
    return effects.precision_weights(rows).select("cell", F.round("weight", 6).alias("weight"))


@query("""WITH r AS (SELECT o_totalprice AS target, avg(o_totalprice) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS estimate, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS baseline FROM orders),
    a AS (SELECT count(*) AS n, 1 - avg((estimate - target) ** 2) / var_pop(target) AS r2, 1 - avg((baseline - target) ** 2) / var_pop(target) AS baseline_r2 FROM r)
    SELECT n, round(r2, 6) AS r2, round(baseline_r2, 6) AS baseline_r2, round(r2 - baseline_r2, 6) AS gain FROM a""")
def incremental_r2(spark, d):
    """What means by two keys explain beyond those by one."""
    orders = inputs.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("target"))
    one = orders.groupBy("o_orderpriority").agg(F.avg("target").alias("baseline"))
    two = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("target").alias("estimate"))
    return rounded(summaries.incremental_r2(orders.join(one, "o_orderpriority").join(two, ["o_orderpriority", "o_orderstatus"]), "estimate", "baseline", "target"), "r2", "baseline_r2", "gain")


#: A frozen model of prices by size, of fixed parameters, so that SQL can apply it.
MODEL = {"features": ["p_size"], "mean": np.array([25.0]), "scale": np.array([14.0]), "coefficients": np.array([30.0]), "intercept": 1400.0}


@query("""WITH r AS (SELECT 1400 + 30 * (p_size - 25) / 14e0 AS estimate, p_retailprice AS target FROM part WHERE p_brand <> 'Brand#11'), k AS (SELECT *, rank() OVER (ORDER BY estimate) + (count(*) OVER (PARTITION BY estimate) - 1) / 2e0 AS rk FROM r)
    SELECT count(*) AS n, round(avg(abs(estimate - target)), 6) AS mae, round(sqrt(avg((estimate - target) ** 2)), 6) AS rmse, round(1 - avg((estimate - target) ** 2) / var_pop(target), 6) AS r2, NULL::DOUBLE AS auc FROM k""")
def transfer_metrics(spark, d):
    """A frozen model judged on rows of other groups than it was fitted on; all targets are positive, so there is no AUC."""
    rows = summaries.listed(inputs.table(spark, d, "part"), "p_brand", exclude=["Brand#11"])
    return rounded(summaries.transfer(rows, MODEL, MODEL["features"], "p_retailprice"), "mae", "rmse", "r2")


# --- baselines -------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT query, p.item, sum(ln(1 + (n_items - df + 0.5e0) / (df + 0.5e0)) * value / (value + 1.5e0 * (0.25e0 + 0.75e0 * length / avg_length))) AS score
    FROM qt JOIN post p USING (feature) JOIN fs USING (feature) JOIN items i ON i.item = p.item, coll GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS rank FROM s)
    SELECT query, item, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def lexical_baseline_top10(spark, d):
    """The lexical baseline with its own formula: k1 of 1.5, b of 0.75, and saturation without the factor k1 + 1."""
    asked = scoring.small(inputs.query_features(spark, d).select("query", "feature"))
    c = inputs.collection(spark, d).select("n_items", "avg_length")
    rows = inputs.postings(spark, d).join(asked, "feature").join(inputs.feature_rows(spark, d).select("feature", "df"), "feature").join(inputs.item_rows(spark, d).select("item", "length"), "item").crossJoin(F.broadcast(c))
    relative = numeric.relative_length(F.col("length"), F.col("avg_length"))
    scored = rows.groupBy("query", "item").agg(F.sum(numeric.smoothed_idf(F.col("n_items"), F.col("df")) * F.col("value") / (F.col("value") + 1.5 * relative)).alias("score"))
    return rounded(search.top_k(scored, 10, ("query",)), "score").select("query", "item", "rank", "score")


# --- tables of results -----------------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE source IN ('src1', 'src2', 'src3') AND lang NOT IN ('de')")
def list_filter(spark, d):
    rows = inputs.table(spark, d, "documents").select("doc_id", "source", "lang")
    return summaries.listed(summaries.listed(rows, "source", include=["src1", "src2", "src3"]), "lang", exclude=["de"])


@query("""SELECT doc_id, CASE WHEN n_chars < 100 THEN 'long_enough' WHEN quality IS NULL THEN 'labelled' WHEN quality = 0 OR toxic = 1 THEN 'good' END AS excluded_by
    FROM documents LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)""")
def eligible_rows(spark, d):
    labels = inputs.table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = inputs.table(spark, d, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    rules = {"long_enough": F.col("n_chars") >= 100, "labelled": F.col("quality").isNotNull(), "good": (F.col("quality") == 1) & (F.col("toxic") == 0)}
    return summaries.eligible(rows, rules).select("doc_id", "excluded_by")


@query("""WITH c AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL)
    SELECT priority, year::INT AS year, a.n AS value_a, b.n AS value_b, b.n - a.n AS difference FROM c a JOIN c b USING (priority, year) WHERE a.status = 'F' AND b.status = 'O'""")
def paired_cells(spark, d):
    cells = inputs.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return summaries.paired(cells, ["priority", "year"], "status", "F", "O", "n")


@query("SELECT l_partkey AS part FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_members(spark, d):
    return summaries.common(inputs.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), "l_returnflag"), "part", "l_returnflag")


@query("""SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS mean, quantile_cont(n_chars::DOUBLE, 0.5) AS median, min(n_chars) AS low, max(n_chars) AS high, round(quantile_cont(n_chars::DOUBLE, 0.05), 6) AS p5, round(quantile_cont(n_chars::DOUBLE, 0.95), 6) AS p95
    FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_summary(spark, d):
    return rounded(summaries.summary(inputs.table(spark, d, "documents"), "n_chars", ["lang"]), "mean", "p5", "p95")


@query("""SELECT c_mktsegment AS segment, coalesce(o_orderstatus, 'missing') AS status, count(*) AS cells FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def status_counts(spark, d):
    planned = inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("segment"))
    results = inputs.table(spark, d, "orders").select(F.col("o_custkey").alias("cell"), F.col("o_orderstatus").alias("status"))
    return summaries.status_counts(results, planned, "cell", ["segment"])


@query("SELECT l_shipmode_ AS flag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_, * FROM lineitem) GROUP BY 1")
def weighted_mean(spark, d):
    rows = inputs.table(spark, d, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus"))
    return rounded(summaries.weighted_mean(rows, "l_discount", "l_quantity", ["flag"]), "weighted_mean")


@query("""WITH n AS (SELECT p_partkey, replace(p_type, ' ', '_') || '__c' || (p_size * 128)::VARCHAR || '__b' || (p_size * 16)::VARCHAR || CASE WHEN p_partkey % 3 = 2 THEN '' ELSE '__sink' || (p_partkey % 3)::VARCHAR END AS name FROM part)
    SELECT p_partkey, CASE WHEN ok THEN split_part(name, '__c', 1) END AS task, CASE WHEN ok THEN regexp_extract(name, '__c(\\d+)__b', 1)::INT END AS context, CASE WHEN ok THEN regexp_extract(name, '__b(\\d+)__sink', 1)::INT END AS budget,
    CASE WHEN ok THEN name LIKE '%1' END AS sink FROM (SELECT *, name LIKE '%__sink_' AS ok FROM n)""")
def row_names(spark, d):
    part = inputs.table(spark, d, "part")
    sink = F.when(F.col("p_partkey") % 3 == 2, "").otherwise(F.concat(F.lit("__sink"), (F.col("p_partkey") % 3).cast("string")))
    name = F.concat(F.translate("p_type", " ", "_"), F.lit("__c"), (F.col("p_size") * 128).cast("string"), F.lit("__b"), (F.col("p_size") * 16).cast("string"), sink)
    return summaries.row_names(part.select("p_partkey", name.alias("name")), "name").drop("name")


_GRID = {
    "datasets": {"a": {"role": "fit", "corpus_id": "c1"}, "b": {"role": "evaluate", "corpus_id": "c2"}, "c": {"role": "evaluate", "corpus_id": "c3"}, "d": {"role": "evaluate", "corpus_id": "c4", "enabled": False}},
    "bases": [{"name": "identity"}, {"name": "random"}, {"name": "shared", "secondary": True}],
    "budgets": [{"name": "small", "primary": True}, {"name": "large"}, {"name": "b-only", "primary": True, "collections": ["b"]}],
    "experiments": {"robustness_collections": ["b"], "parameter_collections": ["c"], "control_collections": ["b", "c"], "stochastic_bases": ["random"]},
}


@query("""WITH base AS (SELECT unnest(['b', 'c']) AS collection), k AS (SELECT * FROM (VALUES ('identity', false), ('random', false), ('shared', true)) t(basis, secondary)), g AS (SELECT unnest(['pooled', 'token']) AS granularity),
    u AS (SELECT * FROM (VALUES ('small', true, NULL), ('large', false, NULL), ('b-only', true, 'b')) t(budget, is_primary, only_for)),
    f AS (SELECT * FROM (VALUES ('primary', ['b', 'c']), ('sparsity', ['b', 'c']), ('robustness', ['b']), ('parameters', ['c']), ('controls', ['b', 'c']), ('shared_sae', ['b', 'c'])) t(family, chosen)),
    x AS (SELECT family, collection, basis, granularity, budget, unnest(CASE WHEN family = 'robustness' THEN [1, 2] ELSE [0] END) AS seed FROM f, base, k, g, u
      WHERE list_contains(chosen, collection) AND secondary = (family = 'shared_sae') AND (family <> 'robustness' OR basis = 'random') AND (is_primary OR family = 'sparsity') AND (only_for IS NULL OR only_for = collection)),
    y AS (SELECT *, unnest(CASE WHEN family = 'parameters' THEN [0.6, 1.2, 2.4]::DOUBLE[] ELSE [1.2]::DOUBLE[] END) AS k1 FROM x), z AS (SELECT *, unnest(CASE WHEN family = 'parameters' THEN [0, 0.5, 0.75]::DOUBLE[] ELSE [0.75]::DOUBLE[] END) AS b FROM y)
    SELECT family, collection, basis, granularity, seed::BIGINT AS seed, budget, k1, b, CASE WHEN family = 'controls' THEN 'shuffled_idf' END AS control FROM z""")
def grid_families(spark, d):
    cells = [(f, c["collection"], c["basis"], c["granularity"], c["seed"], c["budget"], float(c["k1"]), float(c["b"]), c["control"]) for f in grid.FAMILIES for c in grid.family(_GRID, f)]
    return spark.createDataFrame(cells, "family string, collection string, basis string, granularity string, seed bigint, budget string, k1 double, b double, control string")


@query("SELECT label::BIGINT AS feature, (label % 5)::BIGINT AS coordinate, CASE WHEN label < 5 THEN 'positive' ELSE 'negative' END AS sign FROM (SELECT DISTINCT label FROM embeddings)")
def feature_metadata(spark, d):
    features = inputs.table(spark, d, "embeddings").select(F.col("label").cast("long").alias("feature")).distinct()
    return summaries.feature_metadata(features, "identity", 10)


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: greatest(x::DOUBLE, 0) + ln(1 + exp(-abs(x::DOUBLE))))), 6) AS total FROM embeddings")
def softplus_total(spark, d):
    rows = inputs.table(spark, d, "embeddings")
    return rows.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda x: numeric.softplus(x.cast("double"))), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("""WITH r AS (SELECT c_nationkey AS unit, month(o_orderdate) - 1 AS page, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS rate FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
    n AS (SELECT *, unit % 12 AS needle, row_number() OVER (PARTITION BY unit ORDER BY rate DESC, page) AS place FROM r)
    SELECT unit, count(*) AS pages, max(needle) AS needle_page, max(CASE WHEN page = needle THEN place END) AS needle_rank, round(max(CASE WHEN page = needle THEN rate END), 6) AS needle_rate, round(arg_min(rate, page), 6) AS sink_rate,
    round(arg_max(rate, page), 6) AS last_page_rate, round(quantile_cont(rate, 0.5), 6) AS median_rate FROM n GROUP BY 1 HAVING max(CASE WHEN page = needle THEN 1 END) = 1""")
def needle_page_rates(spark, d):
    """Months as pages, nations as units: the page of interest among all by its rate."""
    orders = inputs.table(spark, d, "orders").join(inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("unit")), "o_custkey")
    rates = orders.groupBy("unit", (F.month("o_orderdate") - 1).alias("page")).agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("rate"))
    needles = inputs.table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), (F.col("n_nationkey") % 12).alias("needle"))
    return rounded(summaries.needle_rates(rates, needles), "needle_rate", "sink_rate", "last_page_rate", "median_rate")


@query("""WITH l AS (SELECT label AS unit, vec_id AS position, sum(x * c) AS logit FROM dims JOIN embeddings USING (vec_id) JOIN cent ON cent.expert = label AND cent.d = dims.d GROUP BY 1, 2),
    p AS (SELECT unit, position, exp(logit - max(logit) OVER (PARTITION BY unit)) AS e FROM l), share AS (SELECT *, e / sum(e) OVER (PARTITION BY unit) AS p FROM p)
    SELECT unit, d::INT AS d, round(sum(p * x), 6) AS value FROM share JOIN dims ON dims.vec_id = position GROUP BY 1, 2""")
def sparse_attention_output(spark, d):
    """Attention of each label's mean vector over the vectors of that label: the selected positions alone."""
    dims = inputs.table(spark, d, "embeddings").select(F.col("label").alias("unit"), F.col("vec_id").alias("position"), F.posexplode("embedding").alias("d", "x")).withColumn("value", F.col("x").cast("double"))
    centers = dims.groupBy("unit", "d").agg(F.avg("value").alias("c"))
    logits = dims.join(scoring.small(centers), ["unit", "d"]).groupBy("unit", "position").agg(F.sum(F.col("value") * F.col("c")).alias("logit"))
    return rounded(summaries.attention_output(logits, dims.select("position", "d", "value")), "value")

"""One query per operator over the given tables, each reading whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskloom.functions import columns as C
from riskloom.operators import (
    encode, evaluate, forest, impute, models, outliers, profile, ranking, relation, smote, split, stored, summary, transform,
)
from riskloom.plans import feature_selection, presets, training
from riskloom.session import fresh_path, write_out
from riskloom.sources import csv_source, model_store, sample

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# The line items under the canonical measurement names.
CANONICAL = dict(zip(LINE_NUMBERS, ["MP_Count_per_L", "Risk_Score", "Microplastic_Size_mm_midpoint", "Density_midpoint"]))


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that two engines can be compared."""
    return df.withColumns({c: F.round(C.quoted(c), places) for c, kind in df.dtypes if kind == "double"})


def orders_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return orders.withColumns(
        {
            "o_totalprice": F.expr("CASE WHEN o_orderkey % 20 <> 0 THEN o_totalprice END"),
            "o_orderstatus": F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END"),
        }
    )


def labelled_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts with a learnable three-class label in which every tenth row is noise."""
    rule = (
        "CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 3 WHEN p_size <= 15 THEN 0 "
        "WHEN p_retailprice < 950 THEN 1 ELSE 2 END"
    )
    return table(spark, folder, "part").select(
        "p_partkey", "p_size", "p_retailprice",
        F.concat(F.lit("Type_"), F.expr(rule).cast("string")).alias("Risk_Type"),
        F.expr("CASE WHEN p_size < 10 THEN 'Low' WHEN p_size < 25 THEN 'Medium' WHEN p_size < 40 THEN 'High' ELSE 'Critical' END").alias("Risk_Level"),
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Text statistics of the labelled documents."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    text = F.col("text")
    return documents.join(labels, "doc_id").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("words"),
        F.length(F.regexp_replace(text, r"[^0-9]", "")).cast("double").alias("digits"),
        "toxic", "quality",
    )


def guessed_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their return flag and a guess at it from the quantity."""
    guess = F.expr("CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END")
    return table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


# Sources


@query
def s_csv_scan(spark, folder):
    path = csv_source.write_csv(table(spark, folder, "customer"), fresh_path(spark, "customer") + ".csv")
    return csv_source.load_dataset(spark, path)


@query
def s_csv_scan_mixed(spark, folder):
    """One folder whose files have two column orders."""
    customers = table(spark, folder, "customer")
    even, odd = (customers.where(F.col("c_custkey") % 2 == k) for k in (0, 1))
    path = csv_source.write_csv(even, fresh_path(spark, "mixed") + ".csv")
    odd.select(*reversed(odd.columns)).write.mode("append").options(header=True, escape='"').csv(path)
    return csv_source.load_dataset(spark, path)


@query
def s_csv_encoding(spark, folder):
    documents = table(spark, folder, "documents")
    paths = []
    for encoding, side in zip(csv_source.ENCODINGS, (F.col("lang") == "en", F.col("lang") != "en")):
        paths.append(csv_source.write_csv(documents.filter(side), fresh_path(spark, "documents"), encoding))
    return csv_source.read_csv(spark, paths, multiline=True)


@query
def s_sample_source(spark, folder):
    return rounded(sample.sample_for(table(spark, folder, "events"), "event_id"), 4)


# Projections and filters


@query
def p_dropna(spark, folder):
    return C.drop_missing(orders_with_gaps(spark, folder), ["o_totalprice", "o_orderstatus"])


@query
def p_target_mask(spark, folder):
    return C.with_target(orders_with_gaps(spark, folder), "o_orderstatus")


@query
def p_drop_null_columns(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", "p_retailprice", F.nullif("p_size", F.lit(1)).alias("some"),
        F.lit(None).cast("double").alias("nothing"),
    )
    return impute.drop_null_columns(parts)


@query
def p_coerce_numeric(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("brand"), F.col("p_type").alias("kind")
    )
    return C.coerce_numeric(parts, ["brand", "kind"])


@query
def p_scatter_pairs(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return relation.scatter_pairs(lines, "l_quantity", "l_discount", "l_returnflag")


# Profiles and statistics


@query
def a_null_profile(spark, folder):
    return profile.null_profile(orders_with_gaps(spark, folder))


@query
def a_table_quality(spark, folder):
    return rounded(profile.table_quality(orders_with_gaps(spark, folder)))


@query
def a_duplicate_rows(spark, folder):
    lines = table(spark, folder, "lineitem")
    return profile.duplicate_rows(lines.unionByName(lines.where("l_orderkey % 10 = 0")))


@query
def a_describe(spark, folder):
    return rounded(profile.describe(table(spark, folder, "lineitem"), LINE_NUMBERS), 4)


def line_types(spark, folder):
    """Line items with a column of each further number type."""
    return table(spark, folder, "lineitem").select(
        F.col("l_quantity").cast("float").alias("as_float"), (F.col("l_quantity") * 2).cast("decimal(12,2)").alias("as_decimal"),
        F.col("l_linenumber").cast("smallint").alias("as_smallint"), F.col("l_linenumber").cast("tinyint").alias("as_tinyint"),
        F.col("l_partkey").cast("int").alias("as_int"),
    )


@query
def a_describe_types(spark, folder):
    return rounded(profile.describe(line_types(spark, folder)), 4)


@query
def f_outlier_detect_types(spark, folder):
    lines = line_types(spark, folder)
    return rounded(outliers.detect_outliers(lines, lines.columns), 4)


@query
def a_whole_profile(spark, folder):
    """Nulls, moments, quartiles, fences and outliers of all columns in two readings."""
    events = table(spark, folder, "events").select(F.expr("CASE WHEN event_id % 9 <> 0 THEN value END").alias("value"), F.col("user_id"))
    lines = summary.whole_profile(table(spark, folder, "lineitem"), LINE_NUMBERS)
    return rounded(lines.unionByName(summary.whole_profile(events)))


def stored_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of orders, kept by priority; one priority comes later and one is loaded twice."""
    orders, path = table(spark, folder, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority"), fresh_path(spark, "stored")
    late = F.col("o_orderpriority") == "1-URGENT"
    stored.store_parts(orders.where(~late), path, "o_orderpriority")
    for _ in range(2):
        stored.store_part(orders.where(late).drop("o_orderpriority"), path, "1-URGENT")
    return stored.stored(spark, path)


@query
def a_stored_moments(spark, folder):
    """Exact statistics merged from the parts of a store."""
    return rounded(stored.merged(stored_orders(spark, folder)).drop("quantiles", "distinct"))


@query
def a_stored_quantiles(spark, folder):
    """Whether each quantile of the store has a true rank within the stated error."""
    found = stored.approximate_quantiles(stored_orders(spark, folder).where("column_name = 'o_totalprice'"), [0.01, 0.25, 0.5, 0.9])
    ranks = table(spark, folder, "orders").join(F.broadcast(found), F.lit(True)).groupBy("p", "n").agg(
        F.count_if(F.col("o_totalprice") < F.col("value")).alias("below"), F.count_if(F.col("o_totalprice") <= F.col("value")).alias("upto")
    )
    error = stored.rank_error(stored.QUANTILE_K)
    fits = (F.col("below") / F.col("n") <= F.col("p") + error) & (F.col("upto") / F.col("n") >= F.col("p") - error)
    return ranks.select("p", "n", fits.alias("within"))


@query
def a_stored_distinct(spark, folder):
    """Whether each number of distinct values of the store is within the stated error."""
    found = stored.approximate_distinct(stored_orders(spark, folder))
    exact = table(spark, folder, "orders").agg(*[F.countDistinct(c).alias(c) for c in ("o_totalprice", "o_custkey", "o_orderstatus")])
    exact = exact.unpivot([], ["o_totalprice", "o_custkey", "o_orderstatus"], "column_name", "exact")
    return found.join(exact, "column_name").select("column_name", "n", "exact", F.col("exact").between(F.col("low"), F.col("high")).alias("within"))


@query
def a_distribution_stats(spark, folder):
    return rounded(profile.distribution_stats(table(spark, folder, "events"), "value"))


@query
def a_score_bands(spark, folder):
    return rounded(profile.score_bands(table(spark, folder, "events"), "value"))


@query
def a_quantiles(spark, folder):
    return rounded(profile.quantiles(table(spark, folder, "lineitem"), LINE_NUMBERS, [0.05, 0.25, 0.5, 0.75, 0.95]))


@query
def a_quantiles_bracketed(spark, folder):
    """``a_quantiles`` the way that large groups take."""
    lines = table(spark, folder, "lineitem")
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    return rounded(profile.quantiles(lines, LINE_NUMBERS, probs, group_cells=1_000, sample_rows=4_096, window_rows=4_096))


@query
def a_skewness(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("constant", F.lit(1.0))
    return rounded(relation.skewness(lines, [*LINE_NUMBERS, "constant"]))


@query
def a_correlation(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return rounded(relation.correlation(lines, "l_discount", "l_extendedprice"))


@query
def a_ols_by_group(spark, folder):
    return rounded(relation.trend_line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag"), 4)


@query
def a_ols_overall(spark, folder):
    return rounded(relation.trend_line(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", "absent"), 4)


@query
def a_box_stats(spark, folder):
    return rounded(relation.box_stats(table(spark, folder, "events"), "value", "event_type"))


@query
def a_box_stats_bracketed(spark, folder):
    """``a_box_stats`` the way that large groups take."""
    events = table(spark, folder, "events")
    return rounded(relation.box_stats(events, "value", "event_type", group_cells=500, sample_rows=1_024, window_rows=1_024))


@query
def a_box_outliers(spark, folder):
    return relation.box_outliers(table(spark, folder, "events"), "value", "event_type")


@query
def a_histogram(spark, folder):
    return rounded(relation.histogram(table(spark, folder, "events"), "value"))


@query
def a_distinct_values(spark, folder):
    return profile.distinct_values(orders_with_gaps(spark, folder), "o_orderstatus")


@query
def a_value_counts(spark, folder):
    return profile.value_counts(orders_with_gaps(spark, folder), "o_orderstatus")


@query
def a_range(spark, folder):
    return profile.value_range(table(spark, folder, "lineitem"), LINE_NUMBERS)


@query
def t_head(spark, folder):
    return profile.head(table(spark, folder, "orders"), ["o_orderkey"])


@query
def t_topk_features(spark, folder):
    scores = ranking.chi2_scores(table(spark, folder, "lineitem"), LINE_NUMBERS, "l_returnflag")
    return rounded(ranking.top_features(scores.select("feature", "chi2_score"), "chi2_score", 3), 4)


# Feature engineering


@query
def f_standard_scale(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    return rounded(transform.fit_standard_scale(lines, LINE_NUMBERS).apply(lines))


@query
def f_one_hot(spark, folder):
    return encode.one_hot(orders_with_gaps(spark, folder), ["o_orderpriority", "o_orderstatus"])


@query
def f_label_encode(spark, folder):
    orders = orders_with_gaps(spark, folder).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded = encode.label_encode(orders, "o_orderpriority")
    return encode.label_encode(coded, "o_orderstatus", name="status_code", missing="nan")


@query
def f_label_encode_shuffled(spark, folder):
    """``f_label_encode`` with tables too large to broadcast."""
    orders = orders_with_gaps(spark, folder).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    coded = encode.label_encode(orders, "o_orderpriority", pin_rows=1)
    return encode.label_encode(coded, "o_orderstatus", name="status_code", missing="nan", pin_rows=1)


@query
def f_one_hot_sparse(spark, folder):
    """One column in place of a column per date and priority."""
    orders = orders_with_gaps(spark, folder).select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority", "o_orderstatus"
    )
    return encode.one_hot_sparse(orders, ["day", "o_orderpriority", "o_orderstatus"])[0]


@query
def f_outlier_detect(spark, folder):
    events = outliers.detect_outliers(table(spark, folder, "events"), ["value"])
    customers = outliers.detect_outliers(table(spark, folder, "customer"), ["c_acctbal"])
    return rounded(events.unionByName(customers))


@query
def f_outlier_table(spark, folder):
    return outliers.outlier_table(outliers.detect_outliers(table(spark, folder, "events"), ["value"]))


@query
def f_outlier_cap(spark, folder):
    return rounded(outliers.cap_outliers(table(spark, folder, "events").select("event_id", "event_type", "value"), ["value"]))


@query
def f_outlier_cap_stats(spark, folder):
    documents = outliers.cap_stats(table(spark, folder, "documents"), ["n_chars"])
    return rounded(outliers.cap_stats(table(spark, folder, "events"), ["value"]).unionByName(documents))


@query
def f_outlier_summary(spark, folder):
    return outliers.outlier_summary(table(spark, folder, "events"), ["value"])


@query
def f_skew_report(spark, folder):
    events = transform.skew_report(table(spark, folder, "events"), ["value"])
    return events.unionByName(transform.skew_report(table(spark, folder, "orders"), ["o_totalprice"]))


@query
def f_skew_before_after(spark, folder):
    events = transform.skew_before_after(table(spark, folder, "events"), ["value"])
    return rounded(events.unionByName(transform.skew_before_after(table(spark, folder, "customer"), ["c_acctbal"])))


@query
def f_log_transform(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return rounded(transform.fit_log_transform(customers, ["c_acctbal"]).apply(customers))


@query
def f_log_transform_skewed(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    return rounded(transform.fit_log_transform(events, ["user_id", "value"], only_skewed=True).apply(events))


@query
def f_impute_median(spark, folder):
    orders = orders_with_gaps(spark, folder)
    return rounded(impute.fit_median(orders, ["o_totalprice"]).apply(orders))


@query
def f_clean_data(spark, folder):
    parts = table(spark, folder, "part").withColumns(
        {
            "p_size": F.nullif("p_size", F.lit(1)),
            "p_brand": F.nullif("p_brand", F.lit("Brand#2")),
            "nothing": F.lit(None).cast("double"),
        }
    )
    return rounded(training.clean_data(parts, "p_type", "p_partkey"))


@query
def f_quantile_bin(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return impute.quantile_bin(orders, "o_totalprice")


@query
def f_quantile_bin_repeated(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", F.expr("CASE WHEN l_discount < 0.03 THEN 0.0 ELSE l_discount END").alias("l_discount")
    )
    return impute.quantile_bin(lines, "l_discount")


@query
def f_mutual_info(spark, folder):
    return rounded(ranking.mutual_info(table(spark, folder, "part"), ["p_size", "p_retailprice"], "p_type", "p_partkey"), 4)


@query
def f_mutual_info_sliced(spark, folder):
    """``f_mutual_info`` with running totals in slices."""
    parts = table(spark, folder, "part")
    return rounded(ranking.mutual_info(parts, ["p_size", "p_retailprice"], "p_type", "p_partkey", window_rows=500), 4)


@query
def f_mutual_info_binned(spark, folder):
    return rounded(ranking.binned_mutual_info(table(spark, folder, "lineitem"), LINE_NUMBERS, "l_returnflag"))


@query
def f_chi2(spark, folder):
    return rounded(ranking.chi2_scores(table(spark, folder, "lineitem"), LINE_NUMBERS, "l_returnflag"), 4)


@query
def f_rf_importance(spark, folder):
    return ranking.forest_importance(labelled_parts(spark, folder), ["p_size", "p_retailprice"], "Risk_Type", id_col="p_partkey")


@query
def f_rf_importance_deep(spark, folder):
    """Trees grown to pure leaves on a class that one of two columns gives away."""
    scores = ranking.forest_importance(ruled_parts(spark, folder), ["worth", "other"], "Risk_Type", trees=10, max_depth=None, id_col="p_partkey")
    return scores.select("feature", (F.col("importance") > 0.5).alias("leads"), F.round(F.sum("importance").over(Window.partitionBy()), 6).alias("total"))


@query
def f_rf_importance_ruled(spark, folder):
    """One column tells all, the other nothing."""
    parts = ruled_parts(spark, folder).withColumn("flat", F.lit(1.0))
    return rounded(ranking.forest_importance(parts, ["worth", "flat"], "Risk_Type", trees=20, id_col="p_partkey"))


@query
def f_target_profile(spark, folder):
    text = profile.target_profile(orders_with_gaps(spark, folder), "o_orderstatus")
    few = profile.target_profile(table(spark, folder, "lineitem"), "l_tax")
    return rounded(text.unionByName(few).unionByName(profile.target_profile(table(spark, folder, "lineitem"), "l_quantity")))


@query
def f_rank_features(spark, folder):
    return feature_selection.rank_features(labelled_parts(spark, folder), "Risk_Type", "p_partkey")


@query
def l_preprocess_preset(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", *LINE_NUMBERS)
    return rounded(presets.preprocess(lines.withColumnsRenamed(CANONICAL), "scale_log"))


@query
def l_preprocess_full(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("value").alias("Risk_Score"), F.col("event_type").alias("Location"))
    return rounded(presets.preprocess(events, "full"), 5)


# Splits, metrics and models


@query
def m_split_random(spark, folder):
    return split.random_split(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query
def m_split_random_cut(spark, folder):
    """``m_split_random`` with the cut found in a bracket."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return split.random_split(orders, "o_orderkey", window_rows=1_024)


@query
def m_split_stratified(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return split.stratified_split(orders, "o_orderkey", "o_orderpriority")


@query
def m_fold_assign(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return split.assign_folds(orders, "o_orderkey", "o_orderpriority")


@query
def m_fold_assign_cut(spark, folder):
    """``m_fold_assign`` with the cuts found in brackets."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return split.assign_folds(orders, "o_orderkey", "o_orderpriority", window_rows=1_024)


@query
def m_class_weights_many(spark, folder):
    """A class for each customer."""
    return rounded(split.class_weights(table(spark, folder, "orders"), "o_custkey"))


@query
def m_class_weights(spark, folder):
    return rounded(split.class_weights(table(spark, folder, "orders"), "o_orderpriority"))


@query
def m_metrics(spark, folder):
    return rounded(evaluate.metrics(guessed_flags(spark, folder)))


@query
def m_classification_report(spark, folder):
    return rounded(evaluate.classification_report(guessed_flags(spark, folder)))


@query
def m_smote_counts(spark, folder):
    grown = smote.smote(labelled_documents(spark, folder), ["n_chars", "words", "digits"], "toxic", "doc_id")
    return profile.value_counts(grown, "toxic")


@query
def m_smote(spark, folder):
    return rounded(smote.smote(labelled_documents(spark, folder), ["n_chars", "words", "digits"], "quality", "doc_id"))


@query
def m_smote_one_feature(spark, folder):
    """Many cells on one feature."""
    return rounded(smote.smote(labelled_documents(spark, folder), ["n_chars"], "quality", "doc_id", cell_rows=8))


@query
def m_smote_cells(spark, folder):
    """The rows of ``m_smote`` whatever the size of a cell."""
    docs = labelled_documents(spark, folder)
    return rounded(smote.smote(docs, ["n_chars", "words", "digits"], "quality", "doc_id", cell_rows=8))


@query
def m_evaluate(spark, folder):
    return training.train_and_evaluate(labelled_parts(spark, folder), "Risk_Type", "p_partkey").scores


def ruled_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose class follows from ``worth`` without noise, with wide gaps between classes."""
    return table(spark, folder, "part").select(
        "p_partkey",
        F.expr("CASE WHEN p_size <= 15 THEN 0.0D WHEN p_size <= 30 THEN 10.0D ELSE 20.0D END + p_partkey % 3 / 10").alias("worth"),
        F.expr("CAST(p_partkey % 5 AS DOUBLE)").alias("other"),
        F.expr("CASE WHEN p_size <= 15 THEN 'Low' WHEN p_size <= 30 THEN 'Medium' ELSE 'High' END").alias("Risk_Type"),
    )


SMALL_MODELS = models.ModelSettings(logistic_iterations=100, trees=10, rounds=5, depth=5)


@query
def m_evaluate_ruled(spark, folder):
    return training.train_and_evaluate(ruled_parts(spark, folder), "Risk_Type", "p_partkey", settings=SMALL_MODELS).scores


@query
def m_cross_validate_ruled(spark, folder):
    settings = replace(SMALL_MODELS, names=tuple(models.SHORT_NAMES))
    return training.cross_validate(ruled_parts(spark, folder), "Risk_Type", "p_partkey", settings=settings)


@query
def m_best_model_ruled(spark, folder):
    """All models are right, so the first named is the best."""
    run = training.train_and_evaluate(ruled_parts(spark, folder), "Risk_Type", "p_partkey", settings=SMALL_MODELS)
    return training.best_model(run.scores, "f1", models.LONG_NAMES)


@query
def m_compare_targets_ruled(spark, folder):
    levels = F.expr("CASE WHEN worth < 5 THEN 'Low' ELSE 'High' END")
    parts = ruled_parts(spark, folder).withColumn("Risk_Level", levels)
    return training.compare_targets(parts, "p_partkey", settings=SMALL_MODELS)


@query
def m_train_models_ruled(spark, folder):
    settings = replace(SMALL_MODELS, names=tuple(models.SHORT_NAMES), balanced=False)
    run = training.train_models(ruled_parts(spark, folder), "Risk_Type", "p_partkey", settings)
    return run.scores.withColumn("is_best", (F.col("model") == run.best_name).cast("int"))


@query
def m_train_reports_ruled(spark, folder):
    """Precision and recall a class, in a test part of known size."""
    settings = replace(SMALL_MODELS, names=tuple(models.SHORT_NAMES), balanced=False)
    reports = training.train_models(ruled_parts(spark, folder), "Risk_Type", "p_partkey", settings).reports
    return rounded(reports.where("`class` in ('0.0', '1.0', '2.0')").drop("support"))


@query
def m_train_smote_ruled(spark, folder):
    """Classes of very different size, grown to the same."""
    rare = F.expr("Risk_Type <> 'Medium' or p_partkey % 8 = 0")
    return training.train_interactive(ruled_parts(spark, folder).where(rare), "Risk_Type", "p_partkey", ["worth", "other"], settings=SMALL_MODELS)


@query
def m_categories_ruled(spark, folder):
    """Models on a one-hot text column that gives the class away."""
    rule = F.expr("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'a' ELSE 'b' END").alias("y")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", rule)
    settings = replace(SMALL_MODELS, rounds=20, balanced=False)
    return training.train_and_evaluate(orders, "y", "o_orderkey", categories=["o_orderpriority"], settings=settings).scores


@query
def m_predict(spark, folder):
    """Every part's class from each model, saved and read back."""
    rows, classes = models.prepare(ruled_parts(spark, folder), "Risk_Type", ["worth", "other"], "p_partkey")
    rows = write_out(rows, "prepared")
    fitted = models.fit_all(rows, 2, len(classes), SMALL_MODELS)
    saved = {name: model_store.save_model(model, fresh_path(spark, "model")) for name, model in fitted.items()}
    read = {name: model_store.load_model(path) for name, path in saved.items()}
    tables = [models.predict_classes(m, rows, classes).withColumn("model", F.lit(name)) for name, m in read.items()]
    return reduce(DataFrame.unionByName, tables)


@query
def m_deep_forest(spark, folder):
    """Every part's class from a forest without a depth limit, which finds also noise by heart."""
    rows, classes = models.prepare(labelled_parts(spark, folder), "Risk_Type", ["p_partkey", "p_size", "p_retailprice"], "p_partkey")
    rows = write_out(rows, "prepared")
    settings = forest.ForestSettings(trees=1, features=3, bootstrap=False)
    made = forest.fit_forest(rows, ["f0", "f1", "f2"], len(classes), settings=settings)
    found = forest.forest_probabilities(rows, made)
    first = F.array_position("probability", F.array_max("probability")) - 1
    return found.select(F.col("id").alias("p_partkey"), first.cast("int").alias("predicted"), F.round(F.array_max("probability"), 6).alias("share"))


@query
def m_score_bars(spark, folder):
    run = training.train_and_evaluate(
        labelled_documents(spark, folder), "quality", "doc_id", ["n_chars", "words", "digits"], fit_on="train"
    )
    return training.long_scores(run.scores)


@query
def m_compare_targets(spark, folder):
    return training.compare_targets(labelled_parts(spark, folder), "p_partkey")


@query
def m_cross_validate(spark, folder):
    return training.cross_validate(labelled_documents(spark, folder).drop("toxic"), "quality", "doc_id")


@query
def m_best_model(spark, folder):
    run = training.train_and_evaluate(labelled_documents(spark, folder).drop("toxic"), "quality", "doc_id")
    return training.best_model(run.scores, "f1", models.LONG_NAMES)


@query
def m_train_models(spark, folder):
    parts = labelled_parts(spark, folder).drop("Risk_Level")
    run = training.train_models(parts, "Risk_Type", "p_partkey")
    return run.scores.withColumn("is_best", (F.col("model") == run.best_name).cast("int"))


@query
def m_train_reports(spark, folder):
    run = training.train_models(labelled_documents(spark, folder).drop("toxic"), "quality", "doc_id")
    return run.reports


@query
def m_train_smote(spark, folder):
    return training.train_interactive(
        labelled_documents(spark, folder), "quality", "doc_id", ["n_chars", "words", "digits"]
    )

"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the given tables (or what Spark derives from them) in
full; doubles are rounded to 6 decimals to compare with the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import config
from tallyspark.functions.exprs import ratio_zero_as_one, round_doubles
from tallyspark.operators import features as feat
from tallyspark.operators import diagnostics as diag
from tallyspark.operators import finance
from tallyspark.operators import risk
from tallyspark.operators import rules
from tallyspark.sources import given

Query = Callable[[SparkSession, str], DataFrame]

DEPTS = config.GIVEN_DEPARTMENTS
ALL_BRANDS = [f"Brand#{i}" for i in range(1, 26)]


def _inputs(spark: SparkSession, sf_dir: str):
    return given.projects(spark, sf_dir), given.work_hours(spark, sf_dir)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, wh = _inputs(spark, sf_dir)
    return finance.financial_summary(p, wh, DEPTS)


def _finance() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["project_work"] = lambda s, d: round_doubles(finance.project_work(given.work_hours(s, d), DEPTS))
    q["financial_summary"] = lambda s, d: round_doubles(_summary(s, d))
    q["department_summary"] = lambda s, d: round_doubles(finance.department_summary(given.work_hours(s, d), DEPTS))
    q["department_matrix"] = lambda s, d: round_doubles(finance.department_matrix(given.work_hours(s, d), ALL_BRANDS))
    q["efficiency_by_type"] = lambda s, d: finance.metrics_by(_summary(s, d), "EfficiencyScore", "ProjectType")
    q["efficiency_by_status"] = lambda s, d: finance.metrics_by(_summary(s, d), "EfficiencyScore", "Status", True)
    q["profit_by_type"] = lambda s, d: finance.metrics_by(_summary(s, d), "Profit", "ProjectType")
    q["profit_margin_by_status"] = lambda s, d: finance.metrics_by(_summary(s, d), "ProfitMargin", "Status", True)
    q["efficiency_distribution"] = lambda s, d: round_doubles(finance.efficiency_distribution(_summary(s, d)))
    q["overall_profitability"] = lambda s, d: round_doubles(finance.overall_profitability(_summary(s, d)))
    q["top_efficient_projects"] = lambda s, d: round_doubles(finance.top_projects(_summary(s, d), "EfficiencyScore", 10))
    q["bottom_efficient_projects"] = lambda s, d: round_doubles(
        finance.top_projects(_summary(s, d), "EfficiencyScore", 10, largest=False))
    q["profitable_projects"] = lambda s, d: round_doubles(finance.profitable_projects(_summary(s, d)))
    q["loss_making_projects"] = lambda s, d: round_doubles(finance.loss_making_projects(_summary(s, d)))
    return q


KEYS = config.GIVEN_KEY_DEPARTMENTS


def _model_columns() -> list[str]:
    """The numeric feature columns (P11) of the feature table, in table order."""
    from tallyspark.plans.oracle import FEATURE_INT_COLS, FEATURE_STR_COLS, feature_columns
    skip = set(feat.NON_FEATURES) | FEATURE_STR_COLS
    return [c for c in feature_columns(KEYS) if c not in skip]


MODEL_COLUMNS = _model_columns()


def _features_and_summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """B4 over the un-imputed projects merged with their financials (J3), and the financial summary.

    The derived work-hour fact is written once to the checkpoint folder, as are the per-project
    numbers made of it, which feed the financials and the features.
    """
    from tallyspark.session import cut_lineage
    p, wh = _inputs(spark, sf_dir)
    wh = cut_lineage(wh.select("ProjectCode", "Department", "Task", "Hours", "Date"))
    state = cut_lineage(feat.project_state(wh, KEYS, departments=DEPTS))
    fs = finance.financial_summary(p, wh, DEPTS, work=feat.project_work(state))
    return feat.create_features(wh, finance.merge_financials(p, fs), KEYS, state=state), fs


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_and_summary(spark, sf_dir)[0]


def _feature_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    wh = given.work_hours
    q["features"] = lambda s, d: round_doubles(_features(s, d))

    def incremental(s, d):
        """The feature table from a stored state of the older work rows and that of the newer ones; each row is read once."""
        from tallyspark.operators import work_state
        from tallyspark.session import cut_lineage, shared_folder
        p, wh = _inputs(s, d)
        newer = F.crc32(F.concat_ws("|", "Project", "Date")) % 4 == 0
        path = shared_folder(s, "work-state")
        fact = cut_lineage(wh.select("ProjectCode", "Department", "Task", "Hours", "Date", newer.alias("newer")))
        work_state.work_state(fact.where(~F.col("newer"))).write.parquet(path)
        merged = cut_lineage(work_state.merge(s.read.parquet(path), work_state.work_state(fact.where("newer"))))
        rows = work_state.as_work_rows(merged)
        state = cut_lineage(feat.project_state(rows, KEYS, departments=DEPTS))
        fs = finance.financial_summary(p, rows, DEPTS, work=feat.project_work(state))
        return round_doubles(feat.create_features(rows, finance.merge_financials(p, fs), KEYS, base=work_state.base_sums(merged), state=state))
    q["features_incremental"] = incremental
    q["feature_base_aggregates"] = lambda s, d: round_doubles(feat.base_aggregates(wh(s, d)))
    q["feature_timeline"] = lambda s, d: round_doubles(feat.timeline(wh(s, d)))
    q["feature_department_mix"] = lambda s, d: round_doubles(feat.department_mix(wh(s, d), KEYS))
    q["feature_collaboration"] = lambda s, d: round_doubles(feat.collaboration(wh(s, d)))
    return q


def _cost_inputs(s: SparkSession, d: str) -> DataFrame:
    """What B9 reads: the projects with their profit."""
    p, wh = _inputs(s, d)
    return finance.merge_financials(p, finance.financial_summary(p, wh, DEPTS))


def _efficiency_inputs(s: SparkSession, d: str) -> DataFrame:
    """What B10 reads: the projects with their tasks per hour."""
    p, wh = _inputs(s, d)
    base = feat.base_aggregates(wh).select("ProjectCode", ratio_zero_as_one("Task_nunique", "Hours_sum").alias("TasksPerHour"))
    return p.select("row_id", "ProjectCode").join(base, "ProjectCode", "left")


def _rule_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["cost_anomalies"] = lambda s, d: round_doubles(rules.cost_anomalies(
        _cost_inputs(s, d).withColumn("CostRevenueRatio", ratio_zero_as_one("PurchaseCost", "ContractPrice"))).select(
        "row_id", "ProjectCode", "anomaly_type", "CostRevenueRatio", "Profit", "cost_ratio_deviation"))
    q["efficiency_anomalies"] = lambda s, d: round_doubles(rules.efficiency_anomalies(_efficiency_inputs(s, d)).select(
        "row_id", "ProjectCode", "anomaly_type", "TasksPerHour", "efficiency_zscore"))
    q["pattern_anomalies"] = lambda s, d: rules.pattern_anomalies(given.work_hours(s, d)).select(
        "ProjectCode", "anomaly_type", F.array_join("department_pattern", "|").alias("department_pattern"))
    typed = lambda s, d: (rules.cost_anomalies(_cost_inputs(s, d)), rules.efficiency_anomalies(_efficiency_inputs(s, d)),
                          rules.pattern_anomalies(given.work_hours(s, d)))
    q["anomaly_counts"] = lambda s, d: rules.anomaly_counts(*typed(s, d))
    q["anomaly_details"] = lambda s, d: round_doubles(rules.all_anomalies(*typed(s, d)))
    return q


def _risk(s: SparkSession, d: str, variant: str = "pipeline") -> DataFrame:
    f, fs = _features_and_summary(s, d)
    if variant.endswith("full"):
        f = risk.with_full_columns(f, fs)
    from tallyspark.session import cut_lineage
    # risk scores feed several summaries (counts + four bounded top-5 scans):
    # materialise once instead of re-running the order-statistics passes
    return cut_lineage(risk.calculate_risk_scores(f, mode="threshold" if variant.startswith("threshold") else "percentile"))


def _features_and_risk(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The feature table, a projection of the one staged table, and the risk scores over it."""
    from tallyspark.session import cut_lineage
    f = _features(s, d)
    return f, cut_lineage(risk.calculate_risk_scores(f, mode="percentile"))


def _risk_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["risk_scores"] = lambda s, d: round_doubles(_risk(s, d))
    q["risk_scores_full"] = lambda s, d: round_doubles(_risk(s, d, "full"))
    q["risk_scores_threshold"] = lambda s, d: round_doubles(_risk(s, d, "threshold"))
    q["risk_scores_threshold_full"] = lambda s, d: round_doubles(_risk(s, d, "threshold_full"))
    q["risk_summary"] = lambda s, d: round_doubles(risk.risk_summary(_risk(s, d)))
    q["risk_level_histogram"] = lambda s, d: risk.level_histogram(_risk(s, d))
    q["risk_by_type"] = lambda s, d: round_doubles(risk.risk_by_type(*_features_and_risk(s, d)))
    q["risk_levels_by_type"] = lambda s, d: risk.risk_levels_by_type(*_features_and_risk(s, d))

    def level_map(s, d):
        rows = risk.risk_level_map_by_type(*_features_and_risk(s, d))
        entry = lambda e: F.concat_ws(":", e["key"], e["value"])
        return round_doubles(rows.withColumn("RiskLevel", F.array_join(
            F.transform(F.array_sort(F.map_entries("RiskLevel")), entry), ",")))
    q["risk_level_map_by_type"] = level_map
    q["risk_by_status"] = lambda s, d: round_doubles(risk.risk_by_status(*_features_and_risk(s, d)))

    def high(s, d):
        f, r = _features_and_risk(s, d)
        return round_doubles(risk.high_risk_projects(r, f, top_n=15))
    q["high_risk_projects"] = high
    q["risk_recommendations"] = lambda s, d: risk.recommendations(_risk(s, d)).withColumn(
        "affected_projects", F.array_join("affected_projects", ","))

    def ranks(s, d):
        f = _features(s, d)
        from tallyspark.functions import ordered
        from tallyspark.functions.exprs import round_half_up
        k = lambda c: round_half_up(c, risk.RANK_DECIMALS)
        return round_doubles(ordered.pct_ranks(f, "row_id", {
            "CostRevenueRatio": k("CostRevenueRatio"), "EfficiencyScore": -k("EfficiencyScore"),
            "WorkVariability": k("WorkVariability"), "DepartmentDiversity": k("DepartmentDiversity")}))
    q["feature_pct_ranks"] = ranks
    return q


def _features_full(s: SparkSession, d: str) -> DataFrame:
    return risk.with_full_columns(*_features_and_summary(s, d))


def _diagnostic_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q["risk_component_stats"] = lambda s, d: round_doubles(diag.component_stats(_risk(s, d)))
    q["risk_threshold_counts"] = lambda s, d: round_doubles(diag.threshold_counts(_features_full(s, d)))
    q["risk_thresholds"] = lambda s, d: round_doubles(diag.thresholds(_features_full(s, d)))
    q["risk_histogram"] = lambda s, d: round_doubles(diag.score_histogram(_risk(s, d)))
    q["risk_component_means"] = lambda s, d: round_doubles(diag.component_means(_risk(s, d)))
    q["risk_level_shares"] = lambda s, d: round_doubles(diag.level_shares(_risk(s, d)))

    def scatter(s, d):
        from tallyspark.session import cut_lineage
        f, fs = _features_and_summary(s, d)
        f = cut_lineage(f)
        r = cut_lineage(risk.calculate_risk_scores(f, mode="percentile"))
        return round_doubles(diag.scatter_pairs(cut_lineage(risk.with_full_columns(f, fs)), r))
    q["risk_scatter_pairs"] = scatter
    return q


def _model_input(s: SparkSession, d: str):
    from tallyspark.operators.anomaly import matrix
    f = _features(s, d)
    cols = feat.numeric_feature_names(f)
    return f, cols, matrix


def _embeddings_lof(s: SparkSession, d: str, **knn_args) -> tuple[DataFrame, DataFrame]:
    from tallyspark.operators.anomaly import lof, matrix
    e = given.embeddings_matrix(s, d)
    cols = [c for c in e.columns if c not in ("row_id", "label")]
    X = matrix.prepare(e, cols)
    return X, lof.lof_labels(lof.lof_scores(matrix.as_vector(X, cols), **knn_args))


def _ensemble(s: SparkSession, d: str):
    from tallyspark.operators.anomaly import ensemble
    f, cols, _ = _model_input(s, d)
    return ensemble.fit(f, cols)


def _model_queries() -> dict[str, Query]:
    from tallyspark.operators.anomaly import ensemble, iforest, lof, matrix, ocsvm
    from tallyspark.plans import reports
    from tallyspark.session import cut_lineage, shared_folder
    q: dict[str, Query] = {}

    def model_matrix(s, d):
        f, cols, matrix = _model_input(s, d)
        return round_doubles(matrix.prepare(f, cols))
    q["model_matrix"] = model_matrix
    q["lof_embeddings"] = lambda s, d: round_doubles(_embeddings_lof(s, d)[1])
    q["lof_embeddings_cells"] = lambda s, d: round_doubles(_embeddings_lof(s, d, cell_size=64, block=48)[1])    # many cells

    def explanations(s, d):
        X, labels = _embeddings_lof(s, d)
        flagged = labels.where(F.col("label") == -1).select(F.col("id").alias("row_id"))
        return round_doubles(ensemble.explain(X, [c for c in X.columns if c != "row_id"], flagged))
    q["anomaly_explanations"] = explanations

    def forest_of(s, d):
        """Features, their scaled matrix (both projections of the one staged table), the forest over it and its decisions."""
        f = _features(s, d)
        cols = sorted(feat.numeric_feature_names(f))        # draws choose features by place: by name, whatever the table's order
        X = matrix.prepare(f, cols)
        forest = iforest.fit(matrix.as_vector(X, cols))
        return f, cols, X, iforest.decide(forest.training, forest)
    q["isolation_forest_scores"] = lambda s, d: round_doubles(forest_of(s, d)[-1])

    def forest_flags(decisions):
        return decisions.select(F.col("id").alias("row_id"), (F.col("decision") < 0).alias("IsAnomaly"))

    def flagged_risk(s, d):
        f, _, _, decisions = forest_of(s, d)
        return f, decisions, cut_lineage(risk.calculate_risk_scores(f, forest_flags(decisions)))
    q["risk_scores_flagged"] = lambda s, d: round_doubles(flagged_risk(s, d)[-1])

    def lookup_flagged(s, d):
        """P9 with the anomaly status of a single project: the one the forest isolates first."""
        f, decisions, r = flagged_risk(s, d)
        mart = reports.project_mart(f, r, forest_flags(decisions))
        first = decisions.orderBy("decision", "id").limit(1).join(f, F.col("id") == F.col("row_id")).first()
        return round_doubles(reports.project_lookup(mart, f, first["ProjectCode"]))
    q["project_lookup_flagged"] = lookup_flagged

    def forest_explained(s, d):
        _, cols, X, decisions = forest_of(s, d)
        own = decisions.where("decision < 0").select(F.col("id").alias("row_id"), "decision")
        return round_doubles(ensemble.explain(X, cols, own, score_col="decision"))
    q["forest_explanations"] = forest_explained

    def halves(s, d):
        """Features fitted on, and features held out: one project in five by its draw."""
        f = cut_lineage(_features(s, d))
        held = iforest.draw(F.col("row_id"), F.lit(0), 7) % 5 == 0
        return f.where(~held), f.where(held), sorted(feat.numeric_feature_names(f))

    def forest_new(s, d):
        old, new, cols = halves(s, d)
        scaler = cut_lineage(matrix.fit_scaler(old, cols))
        vector = lambda f: matrix.as_vector(matrix.transform(f, cols, scaler, ["row_id"]), cols)
        forest = iforest.fit(vector(old))
        found = iforest.decide(iforest.score(vector(new), forest), forest)
        return round_doubles(found.select(F.col("id").alias("row_id"), "decision", (F.col("label") == -1).alias("is_anomaly")))
    q["forest_check_new"] = forest_new

    def svm_scores(s, d):
        f, cols, matrix = _model_input(s, d)
        vec = matrix.as_vector(matrix.prepare(f, cols), cols)
        return ocsvm.score(vec, ocsvm.fit(vec))
    q["one_class_scores"] = svm_scores
    q["anomaly_ensemble"] = lambda s, d: _ensemble(s, d).results
    q["consensus_anomalies"] = lambda s, d: ensemble.consensus_anomalies(_ensemble(s, d))
    q["anomaly_method_report"] = lambda s, d: ensemble.method_report(_ensemble(s, d))

    def check_new(s, d):
        """Fitted on one part of the projects, written, read back, and held against the others."""
        old, new, cols = halves(s, d)
        path = shared_folder(s, "ensemble")
        ensemble.save(ensemble.fit(old, cols), path)
        return ensemble.check_new(ensemble.load(s, path), new)
    q["anomaly_check_new"] = check_new

    def explained(s, d):
        f = cut_lineage(_features(s, d))
        cols = feat.numeric_feature_names(f)
        ens = ensemble.fit(f, cols)
        return round_doubles(ensemble.explain_by_method(ens, matrix.transform(f, cols, ens.scaler, ["row_id"])))
    q["anomaly_explanations_by_method"] = explained

    def lof_windows(s, d):
        """Neighbours in linear work over the project matrix."""
        f = cut_lineage(_features(s, d))
        cols = feat.numeric_feature_names(f)
        return round_doubles(lof.lof_labels(lof.lof_scores(matrix.as_vector(matrix.prepare(f, cols), cols), method="windows")))
    q["lof_windows"] = lof_windows
    return q


def _impute_queries() -> dict[str, Query]:
    from tallyspark.operators import impute, selection
    q: dict[str, Query] = {}

    def pf(s, d):
        p, wh = _inputs(s, d)
        return impute.with_work_features(p, wh, DEPTS)
    q["cost_ratio_by_type"] = lambda s, d: round_doubles(impute.cost_ratio_by_type(pf(s, d)))
    q["imputed_costs"] = lambda s, d: round_doubles(impute.impute_costs(pf(s, d)))
    q["median_fallback"] = lambda s, d: round_doubles(impute.median_fallback(pf(s, d)).select(
        "row_id", "ProjectCode", "ContractPrice", "PurchaseCost"))

    def prices(s, d):
        x = pf(s, d)
        return impute.predict_prices(impute.fit_price_model(x), x)
    q["imputed_prices"] = prices

    def imputed_projects(s, d):
        p, wh = _inputs(s, d)
        return impute.impute(p, wh, DEPTS)
    q["imputed_projects"] = imputed_projects

    def by_median(s, d):
        p, wh = _inputs(s, d)
        return round_doubles(impute.impute(p, wh, DEPTS, method="median").select(
            "row_id", "ProjectCode", "ContractPrice", "PurchaseCost"))
    q["imputed_projects_median"] = by_median

    def importances(s, d):
        return selection.importance_table(impute.fit_price_model(pf(s, d)), impute.FEATURES)
    q["price_model_importances"] = importances

    def prepared(s, d):
        from tallyspark.operators.anomaly import matrix
        f = _features(s, d)
        cols = feat.numeric_feature_names(f)
        return matrix.prepare(f, cols, target="Success"), cols
    q["feature_mutual_information"] = lambda s, d: round_doubles(selection.mutual_information(*prepared(s, d)))
    q["feature_mutual_information_neighbours"] = lambda s, d: round_doubles(
        selection.mutual_information(*prepared(s, d), method="neighbours"))
    q["selected_features_neighbours"] = lambda s, d: selection.select_top(
        round_doubles(selection.mutual_information(*prepared(s, d), method="neighbours")))
    q["feature_anova_f"] = lambda s, d: round_doubles(selection.anova_f(*prepared(s, d)))
    q["selected_features_mi"] = lambda s, d: selection.select_top(
        round_doubles(selection.mutual_information(*prepared(s, d))))
    q["selected_features_f"] = lambda s, d: round_doubles(selection.select_top(selection.anova_f(*prepared(s, d))))
    return q


def _source_queries() -> dict[str, Query]:
    from tallyspark.sources import sheets
    q: dict[str, Query] = {}
    q["work_hours"] = lambda s, d: round_doubles(given.work_hours(s, d))

    def gs_sheet(s, d):
        o = given.table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        sheet = o.select(F.concat(F.lit("GS"), F.col("o_orderkey").cast("string")).alias("ProjectCode"),
                         F.col("o_totalprice").cast("string").alias("ContractPrice"),
                         F.lit("").alias("PurchaseCost"), (F.col("o_orderkey") + 1).alias("row_no"))
        shaped = sheets.shape_projects(sheet, "GS", max_rows=None)
        return round_doubles(shaped.select("row_no", "ProjectCode", "ProjectType", "ColorCode", "Status",
                                           "ContractPrice"))
    q["gs_sheet_status"] = gs_sheet

    def exported(s, d):
        """The given tables written as sheets of several files, and read back."""
        from tallyspark.session import shared_folder
        o = given.table(s, d, "orders")
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        blank = F.when(F.col("o_orderkey") % 50 != 7, F.col("o_orderkey").cast("string"))     # rows without a code are numbered, then dropped
        price = F.when(F.col("o_orderkey") % 20 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
        paths, files = {}, {}
        for kind, rows in (("GS", urgent), ("ISS", ~urgent)):
            sheet = o.where(rows).select("o_orderkey", F.concat(F.lit(kind), blank).alias("Project Code"), F.concat(F.lit("Customer "), "o_custkey").alias("Name"),
                                         price.alias("Price"), (F.col("o_totalprice") / 2).cast("string").alias("Cost"), F.col("o_orderstatus").alias("extra"))
            paths[kind] = shared_folder(s, f"sheet-{kind}")
            files[kind] = sheets.export_sheet(sheet, paths[kind], "o_orderkey", 5)
        work = given.work_hours(s, d).drop("ProjectCode")
        hours = F.when(F.col("Hours") > 49, F.lit("?")).otherwise(F.col("Hours").cast("string"))
        paths["work"] = shared_folder(s, "sheet-work")
        sheets.export_sheet(work.withColumn("Hours", hours).withColumn("by", F.col("Project")), paths["work"], "by", 5)
        return sheets.load_all(s, paths["work"], paths["GS"], paths["ISS"], gs_files=files["GS"], iss_files=files["ISS"])
    q["sheet_work_hours"] = lambda s, d: round_doubles(exported(s, d)[0])
    q["sheet_projects"] = lambda s, d: round_doubles(sheets.combine_projects(*exported(s, d)[1:]))
    return q


def _report_queries() -> dict[str, Query]:
    from tallyspark.plans import pipeline, reports
    q: dict[str, Query] = {}
    q["feature_summary"] = lambda s, d: reports.feature_summary(_features(s, d))

    def lookup(s, d):
        f, r = _features_and_risk(s, d)
        mart = reports.project_mart(f, r)
        return round_doubles(reports.project_lookup(mart, f, "GS2"))
    q["project_lookup"] = lookup

    def run(s, d, models):
        p, wh = _inputs(s, d)
        return pipeline.run(wh, p, DEPTS, KEYS, models=models)
    q["report_lines"] = lambda s, d: run(s, d, True).tables["report_lines"]
    q["console_summary"] = lambda s, d: run(s, d, True).tables["console_summary"]
    q["insights"] = lambda s, d: run(s, d, True).tables["insights"]
    q["project_analysis"] = lambda s, d: run(s, d, True).tables["project_analysis"]
    return q


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    q.update(_finance())
    q.update(_feature_queries())
    q.update(_rule_queries())
    q.update(_risk_queries())
    q.update(_diagnostic_queries())
    q.update(_model_queries())
    q.update(_impute_queries())
    q.update(_source_queries())
    q.update(_report_queries())
    return q


def oracle_sql() -> dict[str, str]:
    from tallyspark.plans import oracle
    s: dict[str, str] = {}
    s.update(oracle.finance_sql(ALL_BRANDS))
    s.update(oracle.features_sql(KEYS))
    s.update(oracle.rules_sql(KEYS))
    s.update(oracle.risk_sql(KEYS))
    s.update(oracle.diagnostics_sql(KEYS))
    s.update(oracle.models_sql(KEYS, MODEL_COLUMNS))
    s.update(oracle.impute_sql())
    s.update(oracle.selection_sql(KEYS, MODEL_COLUMNS))
    s.update(oracle.sources_sql(KEYS))
    return {k: oracle.cast_counts(v) for k, v in s.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 10 projects by efficiency score (the minimum end-to-end slice)."""
    return queries()["top_efficient_projects"](spark, sf_dir)

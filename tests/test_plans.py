"""Plan regression checks: the physical plans keep the properties the design relies on."""

from pyspark.sql import functions as F

from pliego import catalogs as K
from pliego.operators import filters as FL
from pliego.operators import lookup, study
from pliego.plans.contract_view import contract_view
from pliego.sources import html as H

from conftest import SF_SMALL


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark):
    cv = contract_view(spark, SF_SMALL)
    p = FL.date_range_predicate("fecha_de_inicio_del_contrato", "01/01/1998", "31/12/1998")
    plan = executed(cv.where(p).where(F.col("departamento").isin("ASIA")).groupBy("ciudad").count())
    assert "GreaterThanOrEqual(o_orderdate" in plan
    assert "EqualTo(r_name,ASIA)" in plan or "In(r_name" in plan


def test_scan_reads_only_used_columns(spark):
    plan = executed(study.demand_totals(contract_view(spark, SF_SMALL)))
    lineitem_scans = [l for l in plan.split("\n") if "lineitem.parquet" in l]
    assert lineitem_scans and all("l_discount" not in l and "l_shipdate" not in l for l in lineitem_scans)


def scans(plan: str, name: str) -> int:
    final = plan.split("== Initial Plan ==")[0]
    return sum(1 for line in final.split("\n") if f"{name}.parquet" in line)


def final(df) -> str:
    """The plan as it ran, with the exchanges that were used again."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_distributions_and_health_read_the_facts_once(spark):
    cv = contract_view(spark, SF_SMALL)
    for df in (study.distribution(cv, "modalidad_de_contratacion"), study.demand_distributions(cv),
               study.demand_distributions(cv, segment=["departamento"]), study.supplier_distribution(cv)):
        plan = final(df)
        assert scans(plan, "lineitem") == 1 and "ReusedExchange" in plan
    import datetime as dt

    from pliego.operators import quality
    cats = {"departamento": K.DEPARTMENTS, "estado_contrato": K.STATES}
    report = quality.standard_health_check(cv, cats, dt.date(2024, 2, 15), "fecha_de_inicio_del_contrato",
                                           required=["ciudad"], applied={"estado_contrato": ["F"]})
    assert scans(executed(report), "lineitem") == 1


def test_no_job_runs_while_a_plan_is_built(spark):
    from pliego.operators.cleaning import clean
    from pliego.plans.fixtures import raw_results, result_pages
    from pliego.plans.jobs import ContractQuery, query_source1, query_source2
    cv, pages, raw = contract_view(spark, SF_SMALL), result_pages(spark, SF_SMALL), raw_results(spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("plans-only", "plans only")
    try:
        clean(raw)
        FL.filter_keywords(cv, "red")
        q = ContractQuery(keyword="red", department="ASIA", date_from="01/01/1997")
        query_source1(H.extract_result_rows(pages), q)
        query_source2(cv, q)
        assert list(sc.statusTracker().getJobIdsForGroup("plans-only")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_typed_date_filter_reaches_the_scan(spark):
    from pliego.plans.jobs import ContractQuery, api_predicate
    cv = contract_view(spark, SF_SMALL)
    plan = executed(cv.where(api_predicate(cv, ContractQuery(date_from="01/01/1997"))).groupBy("ciudad").count())
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_partial_match_loop_only_for_the_rest(spark):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(F.col("c_name").alias("v"))
    plan = executed(lookup.resolve_catalog(df, "v", K.DEPARTMENTS))
    assert "BroadcastHashJoin" in plan and plan.count("BroadcastNestedLoopJoin") <= 2


def test_catalog_is_broadcast(spark):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select(F.col("c_name").alias("v"))
    plan = executed(lookup.resolve_catalog(df, "v", K.DEPARTMENTS))
    assert "BroadcastNestedLoopJoin" in plan or "BroadcastHashJoin" in plan


def test_html_is_parsed_once(spark, monkeypatch):
    from pliego.plans.fixtures import result_pages
    pages = result_pages(spark, SF_SMALL)
    assert executed(H.extract_result_rows(pages)).count("MapInPandas") == 1
    # three readers: one parse, written before, none in the plan of the result
    parsed, plain = [], H.frozen
    monkeypatch.setattr(H, "frozen", lambda df, name: parsed.append(executed(df).count("MapInPandas")) or plain(df, name))
    assert executed(H.combine_pages(pages)).count("MapInPandas") == 0 and parsed == [1]


def test_study_reads_the_facts_once_and_keeps_nothing(spark, monkeypatch):
    """All sections but the annex come from one scan; the annex reads only rows as large as its last."""
    from pliego.operators import report
    read, plain = [], study.frozen
    monkeypatch.setattr(study, "frozen", lambda df, name: read.append(scans(executed(df), "lineitem")) or plain(df, name))
    cv = contract_view(spark, SF_SMALL)
    sections = report.study(cv)
    for name, df in sections.items():
        plan = executed(df)
        assert scans(plan, "lineitem") == (1 if name == "anexo" else 0), name
    assert sum(read) == 1
    assert "GreaterThanOrEqual(l_extendedprice" in executed(sections["anexo"])
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_distinct_counts_do_not_copy_rows(spark):
    from pliego.operators import quality
    cv = contract_view(spark, SF_SMALL)
    for df in (study.kpis(cv), quality.quality_report(cv)):
        assert "Expand" not in executed(df)


def test_ranks_are_selected_by_counts(spark, monkeypatch):
    """No sort and no range partitioning of all values, also when cells are cut again."""
    from pliego.operators import quantiles as Q
    monkeypatch.setattr(Q, "FINE", 20)
    monkeypatch.setattr(Q, "SPLIT", 4)
    rows = spark.range(5000).selectExpr("id % 3 AS g", "1000 + cast(sqrt(id) * 7 AS double) AS v")
    t = Q.value_table(rows, "v", ["g"])
    assert "rangepartitioning" not in executed(t.values)
    import numpy as np
    got = {r["g"]: r for r in Q.exact_quantiles(rows, "v", [0.0, 0.31, 0.5, 1.0], ["g"]).collect()}
    data = rows.toPandas()
    for g, part in data.groupby("g"):
        assert np.allclose([got[g][f"q_{i}"] for i in range(4)], np.quantile(part["v"], [0.0, 0.31, 0.5, 1.0]), rtol=1e-12)


def test_study_stacks_its_dimensions_without_array_lambdas(spark, monkeypatch):
    from pliego.operators import study as S

    seen = []
    monkeypatch.setattr(S, "frozen", lambda df, name: seen.append(df) or df)
    df = spark.createDataFrame([("a", 1.0, "p"), (None, None, "nan")], "ciudad string, valor_del_contrato double, proveedor_adjudicado string")
    rows = S.study_partials(df, by=["ciudad"]).sums.groupBy("dimension").sum("contratos").collect()
    assert {r[0]: r[1] for r in rows} == {"total": 2, "precio": 1, "ciudad": 2, "proveedor": 1}
    assert "lambda" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_rendered_where_their_lines_are_dealt(spark):
    from pliego.plans.fixtures import result_pages
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "96")
    try:
        plan = executed(result_pages(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    above = plan[:plan.index("Join")]    # one shuffle, of lines, in as many parts as the session's shuffles
    assert above.count("Exchange ") == 1 and "hashpartitioning(page_id" in above and ", 96)" in above

"""Catalog resolution golden cases (tier order, Q24 deviation)."""

from pliego import catalogs as K
from pliego.operators import lookup
from pliego.operators.filters import resolve_option


def resolve(spark, options, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = lookup.resolve_catalog(df, "v", options)
    return {r["v"]: (r["v_etiqueta"], r["v_valores_api"]) for r in out.collect()}


def test_bogota_spellings(spark):
    got = resolve(spark, K.DEPARTMENTS, ["1100", "Bogotá D.C.", "bogota d.c.", "  BOGOTÁ d.c. ", "Nada"])
    for v in ("1100", "Bogotá D.C.", "bogota d.c.", "  BOGOTÁ d.c. "):
        assert got[v][1] == ["Distrito Capital de Bogotá"]
    assert got["Nada"] == (None, None)


def test_state_group_and_own_label(spark):
    got = resolve(spark, K.STATES, ["4", "Terminado", "terminado", "Celebrado"])
    assert len(got["4"][1]) == 6
    assert got["Terminado"][1] == ["terminado"]          # own label outranks group membership
    assert got["terminado"][1] == ["terminado"]
    assert got["Celebrado"][0] == "Celebrado / formalizado"   # partial label


def test_driver_side_resolution_matches(spark):
    for v in ["1100", "Bogotá D.C.", "bogota d.c.", "sant"]:
        o = resolve_option(K.DEPARTMENTS, v)
        got = resolve(spark, K.DEPARTMENTS, [v])[v][0]
        assert o.label == got


def test_orphans_and_unknowns(spark):
    df = spark.createDataFrame([("Cerrado",), ("Nuevo",), (None,)], "e string")
    orphans = {r.valor for r in lookup.catalog_orphans(df, "e", K.STATES).collect()}
    unknowns = {r.valor for r in lookup.catalog_unknowns(df, "e", K.STATES).collect()}
    assert "Cerrado" not in orphans and "terminado" in orphans
    assert unknowns == {"Nuevo"}

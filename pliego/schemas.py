"""Declared column lists and StructTypes (applied softly: only to columns that exist)."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must equal the reference's) -------------------------------
RESULT_COLUMNS = ["numero_proceso", "id_proceso", "entidad", "objeto_contrato", "modalidad", "estado",
                  "departamento", "municipio", "cuantia", "fecha_apertura", "fecha_etiqueta", "url_detalle"]
RESULT_TABLE_POSITIONS = {0: "orden", 1: "numero_proceso", 2: "modalidad", 3: "estado", 4: "entidad",
                          5: "objeto_contrato", 6: "ubicacion_ejecucion", 7: "cuantia", 8: "fecha_texto"}
MONEY_COLUMNS = ["cuantia", "valor_estimado", "valor_adjudicado", "valor_contrato", "valor_del_contrato",
                 "valor_pagado", "valor_facturado", "valor_pendiente_de", "valor_amortizado", "saldo_cdp",
                 "saldo_vigencia"]
DATE_COLUMNS = ["fecha_apertura", "fecha_cierre", "fecha_adjudicacion", "fecha_contrato",
                "fecha_de_inicio_del_contrato", "fecha_de_fin_del_contrato", "fecha_de_firma"]
DETAIL_COLUMNS = ["numero_proceso", "id_proceso", "entidad", "objeto_contrato", "modalidad", "estado",
                  "fecha_apertura", "fecha_cierre", "fecha_adjudicacion", "valor_estimado", "valor_adjudicado",
                  "valor_contrato", "numero_contrato", "tipo_contrato", "estado_contrato", "proveedor",
                  "nit_proveedor", "departamento", "municipio", "url_detalle"]
API_COLUMNS = ["nombre_entidad", "nit_entidad", "departamento", "ciudad", "modalidad_de_contratacion",
               "estado_contrato", "tipo_de_contrato", "objeto_del_contrato", "valor_del_contrato",
               "valor_pagado", "fecha_de_inicio_del_contrato", "fecha_de_fin_del_contrato", "fecha_de_firma",
               "documento_proveedor", "proveedor_adjudicado", "proceso_de_compra", "id_contrato", "urlproceso"]
UNIFIED_COLUMNS = ["nombre_entidad", "objeto_del_contrato", "valor_del_contrato", "valor_pagado",
                   "modalidad_de_contratacion", "ciudad", "departamento", "estado_contrato", "tipo_de_contrato",
                   "proveedor_adjudicado", "proceso_de_compra", "urlproceso", "fecha_de_inicio_del_contrato",
                   "fecha_de_fin_del_contrato"]
SOURCE1_TO_UNIFIED = {
    "entidad": "nombre_entidad", "objeto_contrato": "objeto_del_contrato", "cuantia": "valor_del_contrato",
    "modalidad": "modalidad_de_contratacion", "municipio": "ciudad", "estado": "estado_contrato",
    "tipo_contrato": "tipo_de_contrato", "numero_proceso": "proceso_de_compra", "proveedor": "proveedor_adjudicado",
    "url_detalle": "urlproceso", "fecha_apertura": "fecha_de_inicio_del_contrato",
    "fecha_cierre": "fecha_de_fin_del_contrato", "valor_contrato": "valor_del_contrato",
}
RESULT_PROJECTION = ["nombre_entidad", "objeto_del_contrato", "valor_del_contrato", "valor_pagado",
                     "modalidad_de_contratacion", "ciudad", "departamento", "estado_contrato", "tipo_de_contrato",
                     "proveedor_adjudicado", "proceso_de_compra", "fecha_de_inicio_del_contrato",
                     "fecha_de_fin_del_contrato"]
SEARCH_COLUMN = "_busqueda"
SOURCE_COLUMN = "fuente"
# Text the CSV scan reads as null (pandas' default na_values).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# -----------------------------------------------------------------------------


def strings(cols: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


API_SCHEMA = strings(API_COLUMNS)
DETAIL_SCHEMA = strings(DETAIL_COLUMNS)
RESULT_SCHEMA = strings(RESULT_COLUMNS)

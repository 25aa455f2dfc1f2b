"""Dimension data: option catalogs and portal code tables.

The catalogs are small fixed lists (< 40 options each); they become tiny
DataFrames that are always broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Option:
    """One selectable option with its value in each source.

    ``code`` is the source-1 form code (None when the concept is absent there),
    ``api_value`` the literal source-2 value, ``api_values`` the several
    source-2 values a group option stands for."""
    label: str
    code: str | None = None
    api_value: str | None = None
    api_values: tuple[str, ...] = ()

    @property
    def all_api_values(self) -> tuple[str, ...]:
        if self.api_values:
            return self.api_values
        return (self.api_value,) if self.api_value else ()


# ---- fixed values (must equal the reference's) -------------------------------
ALL_LABEL = "— Todos —"
NATIONAL_LABEL = "🇨🇴 Todo el país (nacional)"

DEPARTMENTS: list[Option] = [
    Option("Amazonas", "91000", "Amazonas"),
    Option("Antioquia", "5000", "Antioquia"),
    Option("Arauca", "81000", "Arauca"),
    Option("Atlántico", "8000", "Atlántico"),
    Option("Bogotá D.C.", "1100", "Distrito Capital de Bogotá"),
    Option("Bolívar", "1300", "Bolívar"),
    Option("Boyacá", "15000", "Boyacá"),
    Option("Caldas", "17000", "Caldas"),
    Option("Caquetá", "1800", "Caquetá"),
    Option("Casanare", "85000", "Casanare"),
    Option("Cauca", "19000", "Cauca"),
    Option("Cesar", "20000", "Cesar"),
    Option("Chocó", "27000", "Chocó"),
    Option("Córdoba", "23000", "Córdoba"),
    Option("Cundinamarca", "25000", "Cundinamarca"),
    Option("Guainía", "94000", "Guainía"),
    Option("Guaviare", "95000", "Guaviare"),
    Option("Huila", "41000", "Huila"),
    Option("La Guajira", "44000", "La Guajira"),
    Option("Magdalena", "47000", "Magdalena"),
    Option("Meta", "50000", "Meta"),
    Option("Nariño", "52000", "Nariño"),
    Option("Norte de Santander", "54000", "Norte de Santander"),
    Option("Putumayo", "86000", "Putumayo"),
    Option("Quindío", "63000", "Quindío"),
    Option("Risaralda", "66000", "Risaralda"),
    Option("San Andrés, Providencia y Santa Catalina", "88000", "San Andrés, Providencia y Santa Catalina"),
    Option("Santander", "668000", "Santander"),
    Option("Sucre", "70000", "Sucre"),
    Option("Tolima", "73000", "Tolima"),
    Option("Valle del Cauca", "76000", "Valle del Cauca"),
    Option("Vaupés", "97000", "Vaupés"),
    Option("Vichada", "99000", "Vichada"),
    Option("Sin departamento definido", None, "No Definido"),
]

MODALITIES: list[Option] = [
    Option("Mínima cuantía", "13", "Mínima cuantía"),
    Option("Contratación directa", "12", "Contratación directa"),
    Option("Contratación directa (con ofertas)", "2", "Contratación Directa (con ofertas)"),
    Option("Régimen especial", "4", "Contratación régimen especial"),
    Option("Licitación pública", "1", "Licitación pública"),
    Option("Licitación pública de obra", "21", "Licitación pública Obra Publica"),
    Option("Selección abreviada de menor cuantía", "11", "Selección Abreviada de Menor Cuantía"),
    Option("Selección abreviada subasta inversa", "9", "Selección abreviada subasta inversa"),
    Option("Concurso de méritos abierto", "15", "Concurso de méritos abierto"),
    Option("Régimen especial (con ofertas)", None, "Contratación régimen especial (con ofertas)"),
    Option("Licitación pública — Acuerdo Marco de Precios", None, "Licitación Pública Acuerdo Marco de Precios"),
    Option("Selección abreviada menor cuantía sin manifestación de interés", None,
           "Seleccion Abreviada Menor Cuantia Sin Manifestacion Interes"),
    Option("Concurso de méritos con precalificación", None, "Concurso de méritos con precalificación"),
    Option("Enajenación de bienes con sobre cerrado", None, "Enajenación de bienes con sobre cerrado"),
    Option("Enajenación de bienes con subasta", None, "Enajenación de bienes con subasta"),
    Option("Modalidad no definida", None, "No Definido"),
    Option("Concurso de méritos con lista corta", "10", None),
    Option("Concurso de méritos con lista multiusos", "14", None),
    Option("Lista multiusos", "16", None),
    Option("Selección abreviada servicios de salud", "17", None),
    Option("Otras formas de contratación directa", "3", None),
    Option("Invitación a cooperativas o asociaciones territoriales", "5", None),
    Option("Selección abreviada literal h (Ley 1150 de 2007)", "18", None),
    Option("Asociación público privada", "19", None),
    Option("Iniciativa privada sin recursos públicos", "20", None),
    Option("Contratos y convenios con más de dos partes", "22", None),
    Option("Concurso de diseño arquitectónico", "23", None),
]

CONTRACT_TYPE_NAMES = [
    "Prestación de servicios", "Suministros", "Compraventa", "Obra", "Arrendamiento de inmuebles",
    "Comodato", "Interventoría", "Consultoría", "Seguros", "Arrendamiento de muebles",
    "Acuerdo Marco de Precios", "Servicios financieros", "Operaciones de Crédito Público",
    "Asociación Público Privada", "Venta muebles", "Venta inmuebles", "Negocio fiduciario", "Comisión",
    "Concesión", "Acuerdo de cooperación", "Decreto 092 de 2017", "Otro", "No Especificado", "No Definido",
]
CONTRACT_TYPES: list[Option] = [Option(n, None, n) for n in CONTRACT_TYPE_NAMES]

STATES: list[Option] = [
    Option("Celebrado / formalizado", "4",
           api_values=("Cerrado", "terminado", "En ejecución", "Modificado", "Prorrogado", "cedido")),
    Option("En ejecución", None, "En ejecución"),
    Option("Cerrado", None, "Cerrado"),
    Option("Terminado", None, "terminado"),
    Option("Modificado", None, "Modificado"),
    Option("Prorrogado", None, "Prorrogado"),
    Option("Cedido", None, "cedido"),
    Option("Suspendido", None, "Suspendido"),
    Option("Cancelado", None, "Cancelado"),
    Option("Aprobado", None, "Aprobado"),
    Option("En aprobación", None, "En aprobación"),
    Option("Enviado al proveedor", None, "enviado Proveedor"),
    Option("Borrador", "1", "Borrador"),
    Option("Convocado", "2", None),
    Option("Adjudicado", "3", None),
    Option("Liquidado", "5", None),
    Option("Descartado", "6", None),
    Option("Terminado anormalmente", "7", None),
    Option("Terminado sin liquidar", "8", None),
]

# Source-1 form code tables (code -> visible name).
MODALITY_CODES: dict[str, str] = {
    "1": "Licitación Pública",
    "11": "Selección Abreviada de Menor Cuantía (Ley 1150 de 2007)",
    "9": "Subasta",
    "13": "Contratación Mínima Cuantía",
    "17": "Selección Abreviada servicios de Salud",
    "10": "Concurso de Méritos con Lista Corta",
    "14": "Concurso de Méritos con Lista Multiusos",
    "15": "Concurso de Méritos Abierto",
    "16": "Lista Multiusos",
    "12": "Contratación Directa (Ley 1150 de 2007)",
    "4": "Régimen Especial",
    "2": "Contratación Directa Menor Cuantía",
    "3": "Otras Formas de Contratación Directa",
    "5": "Invitación ofertas cooperativas o asociaciones de entidades territoriales",
    "18": "Selección Abreviada del literal h del numeral 2 del artículo 2 de la Ley 1150 de 2007",
    "19": "Asociación Público Privada",
    "20": "Iniciativa Privada sin recursos públicos",
    "21": "Licitación obra pública",
    "22": "Contratos y convenios con más de dos partes",
    "23": "Concurso de diseño Arquitectónico",
}
DEPARTMENT_CODES: dict[str, str] = {
    "91000": "Amazonas", "5000": "Antioquia", "81000": "Arauca", "8000": "Atlántico",
    "1100": "Bogotá D.C.", "1300": "Bolívar", "15000": "Boyacá", "17000": "Caldas",
    "1800": "Caquetá", "85000": "Casanare", "19000": "Cauca", "20000": "Cesar", "27000": "Chocó",
    "00002": "Colombia", "23000": "Córdoba", "25000": "Cundinamarca", "94000": "Guainía",
    "95000": "Guaviare", "41000": "Huila", "44000": "La Guajira", "47000": "Magdalena",
    "50000": "Meta", "52000": "Nariño", "54000": "Norte De Santander", "00000": "Otros Paises",
    "86000": "Putumayo", "63000": "Quindío", "66000": "Risaralda",
    "88000": "San Andrés, Providencia y Santa Catalina", "668000": "Santander", "70000": "Sucre",
    "73000": "Tolima", "76000": "Valle del Cauca", "97000": "Vaupés", "99000": "Vichada",
}
STATE_CODES: dict[str, str] = {
    "1": "Borrador", "2": "Convocado", "3": "Adjudicado", "4": "Celebrado", "5": "Liquidado",
    "6": "Descartado", "7": "Terminado Anormalmente después de Convocado", "8": "Terminado sin Liquidar",
}
VALUE_BAND_CODES: dict[str, str] = {
    "0": "Cualquier Valor",
    "1": "$0 - $100.000.000",
    "2": "$100.000.001 - $300.000.000",
    "3": "$300.000.001 - $500.000.000",
    "4": "$500.000.001 - $1.000.000.000",
    "5": "Más de $1.000.000.000",
}
# Closed value bands of the codes above, in pesos (None = unbounded).
VALUE_BANDS: dict[str, tuple[float | None, float | None]] = {
    "1": (0.0, 100_000_000.0),
    "2": (100_000_001.0, 300_000_000.0),
    "3": (300_000_001.0, 500_000_000.0),
    "4": (500_000_001.0, 1_000_000_000.0),
    "5": (1_000_000_001.0, None),
}
# -----------------------------------------------------------------------------

CATALOGS: dict[str, list[Option]] = {
    "departamento": DEPARTMENTS, "modalidad": MODALITIES,
    "tipo_de_contrato": CONTRACT_TYPES, "estado": STATES,
}
CODE_TABLES: dict[str, dict[str, str]] = {
    "modalidad": MODALITY_CODES, "departamento": DEPARTMENT_CODES,
    "estado": STATE_CODES, "cuantia": VALUE_BAND_CODES,
}

CATALOG_SCHEMA = ("pos int, etiqueta string, codigo_secop1 string, valor_api string, "
                  "valores_api array<string>")


def catalog_frame(spark: SparkSession, options: list[Option]) -> DataFrame:
    """Catalog as a DataFrame (order kept in ``pos``)."""
    rows = [(i, o.label, o.code, o.api_value, list(o.all_api_values)) for i, o in enumerate(options)]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def code_table_frame(spark: SparkSession, table: dict[str, str]) -> DataFrame:
    rows = [(i, k, v) for i, (k, v) in enumerate(table.items())]
    return spark.createDataFrame(rows, "pos int, codigo string, nombre string")

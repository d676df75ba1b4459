"""Fixed values of the school panel: column names, code systems, file tags.

Everything here is data that results must agree on; no logic.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Canonical key of every consolidated table.
PANEL_KEYS = ["rbd", "agno", "curso"]

# Canonical score table, in output order.
SCORE_SCHEMA = T.StructType([
    T.StructField("rbd", T.LongType()),
    T.StructField("agno", T.IntegerType()),
    T.StructField("curso", T.StringType()),
    T.StructField("prom_mate_rbd", T.DoubleType()),
    T.StructField("prom_lect_rbd", T.DoubleType()),
    T.StructField("cod_grupo", T.StringType()),
    T.StructField("cod_depe2", T.StringType()),
    T.StructField("cod_rural_rbd", T.StringType()),
])

# The two target columns of the score table.
SCORE_TARGETS = ["prom_mate_rbd", "prom_lect_rbd"]

# Score column names that carry the level, and their canonical names.
SCORE_RENAMES = {
    r"prom_mate\w+_rbd": "prom_mate_rbd",
    r"prom_lect\w+_rbd": "prom_lect_rbd",
}

# Canonical indicator table, in output order.
INDICATOR_SCHEMA = T.StructType([
    T.StructField("rbd", T.LongType()),
    T.StructField("agno", T.IntegerType()),
    T.StructField("curso", T.StringType()),
    T.StructField("idps_am", T.DoubleType()),
    T.StructField("idps_cc", T.DoubleType()),
    T.StructField("idps_hv", T.DoubleType()),
    T.StructField("idps_pf", T.DoubleType()),
    T.StructField("nom_rbd", T.StringType()),
    T.StructField("cod_reg_rbd", T.StringType()),
    T.StructField("nom_reg_rbd", T.StringType()),
    T.StructField("cod_pro_rbd", T.StringType()),
    T.StructField("nom_pro_rbd", T.StringType()),
    T.StructField("cod_com_rbd", T.StringType()),
    T.StructField("nom_com_rbd", T.StringType()),
    T.StructField("nom_deprov_rbd", T.StringType()),
    T.StructField("cod_depe2", T.StringType()),
    T.StructField("cod_grupo", T.StringType()),
    T.StructField("cod_rural_rbd", T.StringType()),
    T.StructField("codigo_bbdd", T.StringType()),
    T.StructField("fecha_bbdd", T.StringType()),
])

# The analysis table and the consolidated names behind its columns.
ANALYSIS_SCHEMA = T.StructType([
    T.StructField("rbd", T.LongType()),
    T.StructField("agno", T.IntegerType()),
    T.StructField("cod_grupo", T.StringType()),
    T.StructField("cod_depe2", T.StringType()),
    T.StructField("cod_rural_rbd", T.StringType()),
    T.StructField("prom_mate2m_rbd", T.DoubleType()),
    T.StructField("prom_lect2m_rbd", T.DoubleType()),
    T.StructField("ind_am", T.DoubleType()),
    T.StructField("ind_cc", T.DoubleType()),
    T.StructField("ind_hv", T.DoubleType()),
    T.StructField("ind_pf", T.DoubleType()),
])
ANALYSIS_RENAMES = {
    "prom_mate_rbd": "prom_mate2m_rbd",
    "prom_lect_rbd": "prom_lect2m_rbd",
    "idps_am": "ind_am",
    "idps_cc": "ind_cc",
    "idps_hv": "ind_hv",
    "idps_pf": "ind_pf",
}
ANALYSIS_LEVEL = "2m"
ANALYSIS_TARGETS = ["prom_mate2m_rbd", "prom_lect2m_rbd"]
ANALYSIS_NUMERIC = ["ind_am", "ind_cc", "ind_hv", "ind_pf"]
ANALYSIS_CATEGORICAL = ["cod_grupo", "cod_rural_rbd", "cod_depe2"]

# Sub-dimensions of the indicators, as (indicator, dimension).
DETAIL_PAIRS = [
    ("am", "aa"), ("am", "me"),
    ("cc", "ao"), ("cc", "ar"), ("cc", "as"),
    ("hv", "ac"), ("hv", "ha"), ("hv", "va"),
    ("pf", "pa"), ("pf", "sp"), ("pf", "vd"),
]

# The four measures of the indicator table.
INDICATORS = ["idps_am", "idps_cc", "idps_hv", "idps_pf"]

# Published column names that differ from the canonical ones.
INDICATOR_ALIASES = {
    "id_rbd": "rbd",
    "ano": "agno",
    "ind_am": "idps_am",
    "ind_am_rbd": "idps_am",
    "ind_cc": "idps_cc",
    "ind_cc_rbd": "idps_cc",
    "ind_hv": "idps_hv",
    "ind_hv_rbd": "idps_hv",
    "ind_pf": "idps_pf",
    "ind_pf_rbd": "idps_pf",
    "codigo_bdd": "codigo_bbdd",
    "nom_regi_n": "nom_reg_rbd",
    "nom_provincia": "nom_pro_rbd",
    "nom_comuna": "nom_com_rbd",
    "nom_deprov": "nom_deprov_rbd",
}

# Indicator codes of long files, text and numeric.
TEXT_INDICATOR_CODES = {
    "am": "idps_am",
    "aa": "idps_am",
    "cc": "idps_cc",
    "hv": "idps_hv",
    "pf": "idps_pf",
}
NUMERIC_INDICATOR_CODES = {"1": "idps_am", "2": "idps_cc", "3": "idps_hv", "4": "idps_pf"}

# Level codes and the folder names that stand for them.
LEVELS = ["2m", "4b", "6b", "8b"]
LEVEL_OF_FOLDER = {
    "2": "2m", "4": "4b", "6": "6b", "8": "8b",
    "2m": "2m", "4b": "4b", "6b": "6b", "8b": "8b",
}

# Marks of files with finer grain than one row per key.
DETAIL_FILE_TAGS = ["_dim", "niveles", "subdim"]

# Labels of the categorical codes.
GROUP_LABELS = {
    "1": "Bajo", "2": "Medio bajo", "3": "Medio", "4": "Medio alto", "5": "Alto",
}
GROUP_ORDER = ["Bajo", "Medio bajo", "Medio", "Medio alto", "Alto"]
DEPENDENCY_LABELS = {
    "1": "Municipal", "2": "Particular subvencionado", "3": "Particular pagado", "4": "SLEP",
}
RURAL_LABELS = {"1": "Urbano", "2": "Rural"}

# Text significance flags and their numeric twins.
SIGNIFICANCE_CODES = {
    "No significativa": "0",
    "Positiva y significativa": "1",
    "Negativa y significativa": "-1",
}

# Phrases that mark a variable or a description column of a glossary sheet.
VARIABLE_WORDS = ["nombre", "variable", "código"]
DESCRIPTION_WORDS = ["descrip", "etiqueta", "label"]
TOP_HEADER_WORDS = ["nombre", "variable"]
HEADER_PHRASES = [
    "nombre", "variable", "nombre variable", "nombre de la variable", "nombre de variable",
]
INDEX_SHEET_MARK = "ndice"
LOCK_FILE_PREFIX = "~$"
NO_DESCRIPTION = "Sin descripción"
NO_LEVEL = "general"
NO_YEAR = "desconocido"

# Page listing texts.
PAGE_TITLE = "# Extracción de Presentación PDF"
PAGE_PLACEHOLDER = "_(sin texto extraíble — slide visual)_"

# Cell texts that a delimited reader takes for missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

"""Code tables of project keys, and functions over keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names as the registries use them.
STATES = {
    "AG": "Aguascalientes", "BC": "Baja California", "BS": "Baja California Sur", "CM": "Campeche", "CS": "Chiapas",
    "CH": "Chihuahua", "CO": "Coahuila", "CL": "Colima", "DF": "Ciudad de México", "DG": "Durango", "GT": "Guanajuato",
    "GR": "Guerrero", "HG": "Hidalgo", "JL": "Jalisco", "ME": "Estado de México", "MI": "Michoacán", "MO": "Morelos",
    "NA": "Nayarit", "NL": "Nuevo León", "OA": "Oaxaca", "PU": "Puebla", "QT": "Querétaro", "QR": "Quintana Roo",
    "SL": "San Luis Potosí", "SI": "Sinaloa", "SO": "Sonora", "TB": "Tabasco", "TM": "Tamaulipas", "TL": "Tlaxcala",
    "VE": "Veracruz", "YU": "Yucatán", "ZA": "Zacatecas", "MG": "Nacional/Marino", "MP": "Múltiple",
}
TYPES = {
    "H": "MIA Particular", "G": "MIA Regional", "I": "Informe Preventivo", "T": "Cambio de Uso de Suelo",
    "D": "Estudio de Riesgo", "X": "Trámite Sector Hidrocarburos (X)",
}
SECTORS = {
    "01": "Vías de Comunicación", "02": "Hidráulico", "03": "Oleoductos / Gasoductos / Minería", "04": "Eléctrico",
    "05": "Industria Química / Petroquímica", "06": "Siderúrgica / Metalúrgica", "07": "Cementera / Calera", "08": "Automotriz",
    "09": "Turístico", "10": "Inmobiliario / Desarrollo Urbano", "11": "Manejo de Residuos Peligrosos",
    "12": "Forestal / Cambio de Uso de Suelo", "14": "Obras Marítimas / Puertos", "21": "Sector Hidrocarburos",
    "28": "Sector Gas natural y Gas LP", "30": "Exploración y Extracción",
}
STRICT_KEY = r"^\d{2}[A-Z]{2}\d{4}[A-Z]\d{4}$"
AUDIT_KEY = r"^\d{2}[A-Z]{2}\d{4}[A-Z0-9]\d{3,5}$"
PLACEHOLDERS = ("desconocido", "unknown", "", "n/a", "nd", "no disponible", "sin datos")


def lookup(code: Column, table: dict[str, str]) -> Column:
    """The name of a code, or the code itself where the table has none."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def is_missing(value: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Null, blank, or a placeholder in any case."""
    return F.coalesce(F.lower(F.trim(value)).isin(*placeholders), F.lit(True))


def is_mock_key(key: Column) -> Column:
    return key.endswith("9999") | key.contains("TEST") | key.contains("MOCK")


def heal_key(raw: Column) -> Column:
    """A 13-character candidate with digits and letters that scanners confuse put right by place, or null."""
    digits = lambda a, n: F.translate(F.substring(raw, a, n), "OILSZ", "01152")
    letters = lambda a, n: F.translate(F.substring(raw, a, n), "015", "OIS")
    healed = F.concat(digits(1, 2), letters(3, 2), digits(5, 4), letters(9, 1), digits(10, 4))
    return F.when((F.length(raw) == 13) & healed.rlike(STRICT_KEY), healed)

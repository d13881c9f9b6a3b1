"""Tumour types and their matched normal tissues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Study abbreviations of tumours and the names of the matched normal tissues, the best first; of HNSC they are approximate.
MATCHED = {
    "BLCA": ("Bladder",),
    "BRCA": ("Breast - Mammary Tissue",),
    "CESC": ("Cervix - Ectocervix", "Cervix - Endocervix"),
    "CRC": ("Colon - Transverse", "Colon - Sigmoid"),
    "GBM": ("Brain - Cortex", "Brain - Frontal Cortex (BA9)"),
    "HNSC": ("Minor Salivary Gland", "Esophagus - Mucosa"),
    "KICH": ("Kidney - Cortex",),
    "KIRC": ("Kidney - Cortex",),
    "KIRP": ("Kidney - Cortex",),
    "LIHC": ("Liver",),
    "LUAD": ("Lung",),
    "LUSC": ("Lung",),
    "OV": ("Ovary", "Fallopian Tube"),
    "PAAD": ("Pancreas",),
    "PRAD": ("Prostate",),
    "SKCM": ("Skin - Sun Exposed (Lower leg)", "Skin - Not Sun Exposed (Suprapubic)"),
    "STAD": ("Stomach",),
    "THCA": ("Thyroid",),
    "UCEC": ("Uterus",),
}


def matched_tissues(tumor: str | Column) -> Column:
    """array<string>: tissues of a tumour type; empty for an unknown one."""
    table = F.create_map(*(x for k, v in MATCHED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    t = F.col(tumor) if isinstance(tumor, str) else tumor
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(t))), F.array().cast("array<string>"))

"""Operators of a large-scale training-data pipeline."""

from __future__ import annotations

from . import decontaminate, infill, langid, licenses, media, packing, pii, quality, search, simhash, toxicity, warc, wrappers

QUERIES = {
    "op1_media": media.op1_media,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_surrogates": pii.op3_surrogates,
    "op4_licenses": licenses.op4_licenses,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_main_text": wrappers.op6_main_text,
    "op7_packing": packing.op7_packing,
    "op8_language": langid.op8_language,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
    "op11_warc": warc.op11_warc,
    "op12_infill": infill.op12_infill,
    "op13_search": search.op13_search,
}

ORACLES: dict[str, str] = {
    "op5_decontamination": decontaminate.ORACLE_SQL,
    "op11_warc": warc.ORACLE_SQL,
    "op12_infill": infill.ORACLE_SQL,
    "op13_search": search.ORACLE_SQL,
}

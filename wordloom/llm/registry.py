"""The subpackage's queries and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import capfilter, ctw, decontaminate, language, licenses, maintext, packing, repeats, secrets, simhash

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_cap_filter_dedup": capfilter.op2_cap_filter_dedup,
    "op3_crf_language": language.op3_crf_language,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_min_cut_extraction": maintext.op5_min_cut_extraction,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_fixed_block_dedup": repeats.op7_fixed_block_dedup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_ctw_scoring": ctw.op9_ctw_scoring,
    "op10_seed_align_decontamination": decontaminate.op10_seed_align_decontamination,
}
SQL = {"op7_fixed_block_dedup": repeats.oracle(), "op8_license_scan": licenses.oracle()}

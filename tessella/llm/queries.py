"""The queries of this subpackage, and their SQL where SQL can express them."""

from tessella.llm import decontaminate, exact_dedup, language, lm_scoring, log_templates, packing, paragraphs, secrets, simhash, toxicity

QUERIES = {
    "op1_paragraphs": paragraphs.op1_paragraphs,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_log_templates": log_templates.op3_log_templates,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_packing": packing.op6_packing,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_secrets": secrets.op8_secrets,
    "op9_language": language.op9_language,
    "op10_simhash": simhash.op10_simhash,
}

SQL = {
    "op4_lm_scoring": lm_scoring.SQL,
    "op3_log_templates": log_templates.SQL,
    "op5_decontamination": decontaminate.SQL,
    "op7_exact_dedup": exact_dedup.SQL,
}

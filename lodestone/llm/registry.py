"""The queries of this subpackage and their SQL, for __spark_entry__."""

from lodestone.llm import (
    chat, decontaminate, licenses, linededup, packing, pitmanyor, quality, simhash, tokencounts, toxicity,
)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": packing.query,
    "op2_token_counts": tokencounts.query,
    "op3_decontamination": decontaminate.query,
    "op4_quality_rules": quality.query,
    "op5_lm_scoring": pitmanyor.query,
    "op6_simhash_dedup": simhash.query,
    "op7_chat_formatting": chat.query,
    "op8_toxicity": toxicity.query,
    "op9_license_scans": licenses.query,
    "op10_line_dedup": linededup.query,
    "pipeline": pipeline,
}

ORACLES = {
    "op3_decontamination": decontaminate.SQL,
    "op4_quality_rules": quality.SQL,
    "op7_chat_formatting": chat.SQL,
    "op10_line_dedup": linededup.SQL,
}

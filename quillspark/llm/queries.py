"""The subpackage's registered queries and their SQL."""

from . import bpe, decontam, lexical, licenses, ngramjoin, pieces, pii, quality, runs, sharding, tokbin, tokcount, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontam.op1,
        "op2_bpe": bpe.op2,
        "op3_quality_rules": quality.op3,
        "op4_pii": pii.op4,
        "op5_sharding": sharding.op5,
        "op6_ngram_jaccard": ngramjoin.op6,
        "op7_token_counts": tokcount.op7,
        "op8_token_files": tokbin.op8,
        "op9_warc": warc.op9,
        "op10_license_scan": licenses.op10,
        "op11_ranked_search": lexical.op11,
        "op12_sentencepiece": pieces.op12,
        "op13_periodic_runs": runs.op13,
    }


def oracle_sql() -> dict:
    return {
        "op1_decontamination": decontam.ORACLE, "op3_quality_rules": quality.ORACLE, "op6_ngram_jaccard": ngramjoin.ORACLE, "op9_warc": warc.ORACLE, "op10_license_scan": licenses.ORACLE, "op11_ranked_search": lexical.ORACLE, "op13_periodic_runs": runs.ORACLE,
    }

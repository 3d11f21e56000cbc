"""The queries of this subpackage, by the name they are registered under, and the SQL of those it can express."""

from __future__ import annotations

from newsloom.llm import bpe, chat, covertree, decontaminate, fim, license, maintext, manifest, pii, quality, repeats, simhash, toxicity


def pipeline(spark, sf_dir):
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_license_scan": license.op1,
    "op2_embedding_near_dedup": covertree.op2,
    "op3_pii": pii.op3,
    "op4_html_main_text": maintext.op4,
    "op5_simhash_near_dedup": simhash.op5,
    "op6_bpe": bpe.op6,
    "op7_quality": quality.op7,
    "op8_repeated_bytes": repeats.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_toxicity": toxicity.op10,
    "op11_manifest": manifest.op11,
    "op12_fill_in_middle": fim.op12,
    "op13_chat": chat.op13,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op2_embedding_near_dedup": covertree.OP2_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_manifest": manifest.OP11_SQL,
    "op12_fill_in_middle": fim.OP12_SQL,
    "op13_chat": chat.OP13_SQL,
}

"""Queries of the text operators and their SQL, for the repository's entry module."""

from __future__ import annotations

from plinth.llm.chat import OP6_SQL, op6_chat_formatting
from plinth.llm.decontamination import op8_decontamination
from plinth.llm.langid import op7_langid
from plinth.llm.lm_scoring import op10_lm_scoring
from plinth.llm.ngram_join import op5_ngram_join
from plinth.llm.oracles import OP2_SQL, OP5_SQL
from plinth.llm.packing import op1_packing
from plinth.llm.quality import op2_quality_rules
from plinth.llm.sharding import op3_sharding
from plinth.llm.token_counts import op4_token_counts
from plinth.llm.toxicity import op9_toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_quality_rules": op2_quality_rules,
        "op3_sharding": op3_sharding,
        "op4_token_counts": op4_token_counts,
        "op5_ngram_join": op5_ngram_join,
        "op6_chat_formatting": op6_chat_formatting,
        "op7_langid": op7_langid,
        "op8_decontamination": op8_decontamination,
        "op9_toxicity": op9_toxicity,
        "op10_lm_scoring": op10_lm_scoring,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op5_ngram_join": OP5_SQL, "op6_chat_formatting": OP6_SQL}

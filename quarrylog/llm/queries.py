"""The queries and SQL of this subpackage, for __spark_entry__.py."""

import corpus_pipeline
from quarrylog.llm import bpe, language, lm, mixing, neighbours, pii, sharding, simhash, token_files, topk

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_pii": pii.op1_pii,
    "op2_token_files": token_files.op2_token_files,
    "op3_language": language.op3_language,
    "op4_mixing": mixing.op4_mixing,
    "op5_simhash": simhash.op5_simhash,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_sharding": sharding.op7_sharding,
    "op8_bpe": bpe.op8_bpe,
    "op9_lm": lm.op9_lm,
    "op10_topk": topk.op10_topk,
}
ORACLE_SQL = {
    "op4_mixing": mixing.OP4_SQL,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    "op6_neighbours": neighbours.OP6_SQL,
    "op10_topk": topk.OP10_SQL,
}

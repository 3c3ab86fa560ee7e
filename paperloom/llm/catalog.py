"""The queries of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import chat, decontaminate, exact_dedup, language, line_dedup, packing, sharding, simhash, token_files, toxicity
from paperloom.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "op1_decontamination": lambda s, d: decontaminate.leaks(docs(s, d), table(s, d, "benchmark")),
        "op2_sharding": lambda s, d: sharding.op2(docs(s, d)),
        "op3_packing": lambda s, d: packing.op3(docs(s, d)),
        "op4_exact_dedup": lambda s, d: exact_dedup.op4(docs(s, d)),
        "op5_line_dedup": lambda s, d: line_dedup.op5(docs(s, d)),
        "op6_language_id": lambda s, d: language.op6(docs(s, d)),
        "op7_chat_formatting": lambda s, d: chat.op7(table(s, d, "conversations")),
        "op8_token_files": lambda s, d: token_files.op8(docs(s, d)),
        "op9_toxicity": lambda s, d: toxicity.op9(docs(s, d), table(s, d, "labels")),
        "op10_simhash": lambda s, d: simhash.op10(docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.op2_sql(), "op4_exact_dedup": exact_dedup.OP4_SQL, "op7_chat_formatting": chat.OP7_SQL}

"""SQL surface: register(spark) adds functions and table functions for use in queries."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomspark import budget
from loomspark.functions import tokenizers
from loomspark.functions.tokenizers import Spec
from loomspark.operators.chunk import _worker
from loomspark.options import ChunkingOptions
from loomspark.plans.contract import options_from

_ROW = "position int, text string, header_context string, start_offset int, end_offset int, token_count int"


def _options(text: str | None) -> ChunkingOptions:
    return options_from(json.loads(text)) if text else ChunkingOptions()


def _table_function(kind: str, spec: Spec | None):
    runs: dict = {}

    def runner(options: str | None):
        if options not in runs:
            o = _options(options).but(input_type=kind.capitalize())
            profile = budget.resolve(o)
            own = spec or tokenizers.for_profile(profile.kind)
            runs[options] = _worker(own, o, budget.working_budget(o, profile, own.build().count), kind)
        return runs[options]

    class Chunks:
        def eval(self, value, options: str = "", ordered: bool = False):
            for i, p in enumerate(runner(options).rows(value, ordered)[0]):
                yield i, *p

    return F.udtf(Chunks, returnType=_ROW, useArrow=True)


def register(spark: SparkSession, tokenizer: Spec | None = tokenizers.WORD) -> None:
    """Adds chunk_text, chunk_list and chunk_table (table functions) and token_count, token_slice, token_ids and utf16_length.

    Table functions take a value and options as JSON: ``FROM docs, LATERAL chunk_text(text, '{"maxTokens": 64}')``. A null
    tokenizer is the one that the options' model asks for.
    """
    for kind in ("text", "list", "table"):
        spark.udtf.register(f"chunk_{kind}", _table_function(kind, tokenizer))
    own = tokenizer or tokenizers.public_bpe()

    @F.pandas_udf("int")
    def token_count(texts):
        import pandas as pd

        tok = own.build()
        return pd.Series([tok.count(t) for t in texts], dtype="int32")

    @F.pandas_udf("string")
    def token_slice(texts, starts, counts):
        import pandas as pd

        tok = own.build()
        return pd.Series([tok.slice_tokens(t, int(s), int(n)) for t, s, n in zip(texts, starts, counts, strict=True)], dtype=object)

    @F.pandas_udf(ArrayType(IntegerType()))
    def token_ids(texts):
        import pandas as pd

        tok = own.build()
        return pd.Series([tok.encode(t) for t in texts], dtype=object)

    spark.udf.register("token_count", token_count)
    spark.udf.register("token_slice", token_slice)
    if own.kind != "word":
        spark.udf.register("token_ids", token_ids)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION utf16_length(s STRING) RETURNS INT RETURN CAST(octet_length(encode(s, 'UTF-16BE')) / 2 AS INT)")

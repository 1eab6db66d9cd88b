"""L1: pluggable token counters.

The default counter is a pure column expression (``ceil(bytes / 4)``, see
:func:`corpusflow.functions.text.proxy_tokens`). An exact counter needs the
model's vocabulary file, which is not shipped; when one is supplied, this
module turns it into an Arrow-batched pandas UDF that loads the vocabulary once
per Python worker and counts whole texts (never prefixes).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_CACHE: dict[str, object] = {}


def _load(path: str):
    tok = _CACHE.get(path)
    if tok is None:
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        _CACHE[path] = tok
    return tok


def vocabulary_counter(tokenizer_json: str):
    """Return ``counter(col) -> Column`` counting token ids of a tokenizer.json."""
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tok = _load(tokenizer_json)
        vals = texts.fillna("").tolist()
        enc = tok.encode_batch(vals, add_special_tokens=False)
        return pd.Series([len(e.ids) for e in enc], dtype="int64")

    def counter(col) -> Column:
        return count(F.col(col) if isinstance(col, str) else col)
    return counter

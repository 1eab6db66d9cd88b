"""L1: a vocabulary-backed token counter as a pandas UDF."""

import os

from pyspark.sql import functions as F

from corpusflow.functions.tokens import vocabulary_counter
from corpusflow.sources.files import snapshot


def test_vocabulary_counter(spark, tmpdir_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    tok = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    path = os.path.join(tmpdir_path, "tokenizer.json")
    tok.save(path)
    count = vocabulary_counter(path)
    df = spark.createDataFrame([("a b c",), ("",), ("a\r\nb",)], "content string")
    got = [r.tokens for r in snapshot(df, count(F.col("content"))).collect()]
    assert got == [3, 0, 2]

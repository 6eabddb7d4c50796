"""Rows that operators on documents must bear: nulls, blanks, ties, repeats, long texts, clashing column names."""

import random

import pandas as pd

SMALL = "/root/testdata/sf0.001"
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "  two  spaces \n tab\t x", "it's we'll don't 's", "naïve café — ünïcode 日本語 テキスト",
    "x\u00a0y\u3000z\u2028w", "<|endoftext|> as text", "#*$%&|<> !!!", "Z" * 700, "ab " * 900, "a\r\nb\r\n\r\nc", "\x1c sep \x85 end",
]
CLASHES = "_row string, _text string, _words string, _host string, n_words string, row string, score string, _t string, _key string, ids string"


def documents(spark, count=60, seed=3):
    """(DataFrame, [(doc_id, text, source)]): test documents, the odd texts, a null id, a repeated row; extra columns clash."""
    base = pd.read_parquet(f"{SMALL}/documents.parquet").head(count)
    rows = [(int(i), t, s) for i, t, s in zip(base.doc_id, base.text, base.source)]
    rows += [(10_000 + i, t, None if i % 3 else "src0") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, rows[3][1], rows[3][2]), rows[5], rows[5]]
    random.Random(seed).shuffle(rows)
    extra = len(CLASHES.split(","))
    frame = spark.createDataFrame([(*r, *["x"] * extra) for r in rows], f"doc_id long, text string, source string, {CLASHES}")
    return frame, rows


def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")

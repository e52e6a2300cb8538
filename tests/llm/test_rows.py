"""Columns with the names that operators work with inside pass through all of them."""

import public_tokenizers
import pytest

from tallyhouse.llm import language, packing, pages, quality, simhash, suffixes

SCHEMA = "doc_id long, text string, lang string"
CLASH = ("_row", "row", "digest", "doc", "_text", "_digest", "spans_", "lead", "whole", "html", "a `b", "n.c d")
DOCUMENTS = [(1, "some words of a text", "en"), (1, "some words of a text", "en"), (2, None, None), (None, "", "en")]


@pytest.mark.parametrize("apply, added", [
    (lambda f, c: language.predicted(f, None, c), ["lang_pred", "score"]),
    (lambda f, c: quality.scored(f, None, c), ["score", "predicted"]),
    (lambda f, c: packing.tokenized(f, c, public_tokenizers.path("byte_bpe_50k.json")), ["start", "length", "ids", "doc_tokens"]),
    (lambda f, c: simhash.near_duplicates(f, [x for x in c if x != "doc_id"]), ["fingerprint", "component_id"]),
    (lambda f, c: suffixes.without_repeats(f, c, length=48), ["kept", "spans"]),
    (lambda f, c: pages.main_texts(f, pages.Labeller(), c, "text").drop("html_"), ["text"]),
])
def test_columns_of_any_name_pass_through(spark, apply, added):
    frame = spark.createDataFrame(DOCUMENTS, SCHEMA)
    for name in CLASH:
        frame = frame.withColumn(name, frame.doc_id * 2)
    columns = ["doc_id", *CLASH]
    found = apply(frame, columns)
    assert found.columns == [*columns, *added]
    rows = [tuple(r)[: len(columns)] for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(((d, *[None if d is None else 2 * d] * len(CLASH)) for d, _, _ in DOCUMENTS), key=repr)

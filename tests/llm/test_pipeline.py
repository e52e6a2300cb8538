"""The pipeline stage by stage against plain versions, and the registered queries' shapes."""

from collections import Counter

import pytest
from tests.llm.conftest import SAMPLE
from tests.llm.test_mixing import plain_targets, words
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffixes import plain

import __spark_entry__ as driver
import corpus_pipeline as pipeline
from checks.compare import database, difference
from tallyhouse.llm.queries import QUERIES
from tallyhouse.llm.storage import saved

COLUMNS = {
    "op1_exact_search": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_chat": {"conv_id": "bigint", "n_turns": "bigint", "text": "string"},
    "op4_suffixes": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_pages": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op10_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_registered_shapes(spark, name):
    found = QUERIES[name](spark, SAMPLE)
    assert COLUMNS[name].items() <= dict(found.dtypes).items()
    assert not found.isEmpty()
    assert driver.queries()[name] is QUERIES[name]


@pytest.mark.parametrize("name", [n for n in QUERIES if n in driver.oracle_sql()])
def test_equal_to_duckdb(spark, name):
    from checks import compare

    compare.QUERIES, compare.ORACLES = driver.queries(), driver.oracle_sql()
    assert difference(spark, database(SAMPLE), SAMPLE, name) is None


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's result over the small documents and some odd rows."""
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    first = docs.where("doc_id = 3").first()
    odd = [(900_001, None, "en", "src0", 0), (900_002, "", None, None, None), (900_003, "12 34", None, "src1", 5), (None, "words without an id " * 30, None, None, None),
           tuple(first), (900_004, first.text, None, "src2", 1)]
    found = [docs.unionByName(spark.createDataFrame(odd, docs.schema))]
    for name, stage in pipeline.STAGES:
        found.append(saved(stage(spark, found[-1], SAMPLE), name.replace(" ", "-")))
    return [[tuple(r) for r in f.collect()] for f in found]


def test_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SAMPLE).columns == docs.columns
    assert driver.queries()["pipeline"] is pipeline.run and "pipeline" not in driver.oracle_sql()


def test_language_stage_drops_only_texts_without_letters(stages):
    kept = [r for r in stages[0] if any(c.isalpha() for c in r[1] or "")]
    assert Counter((r[0], r[1]) for r in stages[1]) == Counter((r[0], r[1]) for r in kept)
    assert all(r[2] for r in stages[1])


def test_near_duplicate_stage_keeps_one_of_each_component(stages):
    prints = [(r[0], plain_fingerprint(r[1])) for r in stages[1]]
    components = set(plain_components(prints))
    assert sorted((r[0] for r in stages[2]), key=repr) == sorted(components, key=repr)


def test_near_duplicate_stage_tells_components_apart_without_ids(spark):
    texts = [" ".join(f"{word}{i}" for i in range(60)) for word in ("apple", "stone", "river", "cloud")]
    rows = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (7, texts[2], "en", "a", 1), (7, texts[3], "en", "a", 1), (None, texts[0], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, docs, SAMPLE).collect()]
    assert sorted(found, key=repr) == sorted(zip([None, None, 7, 7], texts, strict=True), key=repr)


def test_repeat_stage_removes_repeats_of_its_input(stages):
    expected = {(doc, kept.decode("utf-8", "ignore")) for doc, kept, _ in plain([(r[0], r[1]) for r in stages[2]], pipeline.REPEAT)}
    assert {(r[0], r[1]) for r in stages[3]} == expected and len(stages[3]) == len(stages[2])
    assert all(r[4] == len(r[1]) for r in stages[3])


def test_mixing_stage_takes_the_targets(stages):
    size, taken, own = Counter(), Counter(), Counter()
    for doc, text, _, source, _ in stages[3]:
        size[source] += len(words(text))
    for doc, text, _, source, _ in stages[4]:
        taken[source] += len(words(text))
        own[doc] += len(words(text))
    for source, target in plain_targets(size).items():
        assert abs(taken[source] - target) <= 128
    lengths = {doc: len(words(text)) for doc, text, *_ in stages[3]}
    assert all(n <= 2 * lengths[doc] for doc, n in own.items())


def test_packing_stage_holds_the_mix(stages):
    tokens = Counter()
    for doc, start, length, *_ in stages[5]:
        tokens[doc] += length
    assert set(tokens) == {r[0] for r in stages[4]}


def test_no_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SAMPLE).collect() == []

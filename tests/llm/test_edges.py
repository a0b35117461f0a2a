"""Empty tables, null-only tables and clashing columns, for every operator and stage."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidefold.llm import byte_bpe, decontaminate, language, license_scan, near_dedup, preference, repetition, shared, slots, token_files, url_filter

BPE, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
#: Names that operators use inside, beside the documents' own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, row int, hash string, comp int, key string, size string, score int, kept string, virtual_slot string, first int, u int, v int, h int, s int, hits int, t int, _i int, _t int, _row int, _hash int"
DOC_ROWS = {"empty": [], "nulls": [(None,) * 25] * 3}
BENCH = "item_id long, text string, i int, t string"
TURNS = "conv_id long, turn long, role string, text string, a int, b int, l int, to int, answer int, n_prompt_turns int"
PAGES = "page_id long, url string, host string, path string, rule string, verdict string, score int, _u int"


def split(spark, docs):
    path = shared.fresh_dir(spark, "edge-map")
    records = slots.measured(docs.withColumns({"shard": F.lit("x"), "slot": F.lit("y"), "text_crc32": F.lit(0)}))
    return slots.assign(records, path, slots.plan(records, path, 16))


def filed(spark, docs):
    path = shared.fresh_dir(spark, "edge-tokens")
    token_files.write(docs, path, WORDS)
    return token_files.read(spark, path)


@pytest.fixture(scope="module", params=["empty", "nulls"])
def docs(request, spark):
    return spark.createDataFrame(DOC_ROWS[request.param], DOCS)


@pytest.fixture(scope="module")
def n(docs):
    return docs.count()


def test_one_row_for_each_document(spark, docs, n):
    """Null texts count as empty, and every operator that returns documents returns all of them."""
    ids = filed(spark, docs).collect()
    assert [(r.start, r.n_tokens) for r in sorted(ids, key=lambda r: r.start)] == [(k, 1) for k in range(n)]
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()] == [(None, 0, None, False)] * n
    assert [r.n_tokens for r in byte_bpe.encode_decode(docs, BPE, P.PATTERN).collect()] == [0] * n
    assert [(r.n_words, r.base_failed, r.kept) for r in repetition.judge(docs).collect()] == [(0, True, False)] * n
    profiles = language.fit(docs.where(~language.held_out()))
    assert [(r.lang_pred, r.score) for r in language.predict(docs, profiles).collect()] == [("und", 0.0)] * n
    assert sorted(r.slot for r in split(spark, docs).collect()) == list(range(n))


def test_searches_find_nothing(spark, docs):
    assert license_scan.scan(docs).collect() == []
    for rows in ([], [(None, None, 1, "x")], [(1, "", 1, "x")]):
        items = spark.createDataFrame(rows, BENCH)
        assert decontaminate.find_leaks(docs, items).collect() == []
        assert decontaminate.remove_leaks(docs, items).count() == docs.count()


def test_stages_keep_their_columns(spark, docs, n):
    profiles = language.fit(docs.where(~language.held_out()))
    for kept, rows in ((repetition.keep(docs), 0), (language.keep(docs, profiles), 0), (near_dedup.deduplicated(docs), n)):
        assert kept.columns == docs.columns and kept.count() == rows


@pytest.mark.parametrize("rows", [[], [(None,) * 10] * 2])
def test_conversations(spark, rows):
    turns = spark.createDataFrame(rows, TURNS)
    got = preference.format_pairs(turns, preference.answered_by_next(turns), "conv_id").collect()
    assert sorted((r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in got if r.conv_id is None) == sorted([(0, "", "<||>\n<|end|>\n", ""), (0, "", "", "<||>\n<|end|>\n")] * len(rows)) and len(got) == 2 * len(rows)


@pytest.mark.parametrize("rows", [[], [(None,) * 8] * 2])
def test_urls(spark, rows):
    pages = spark.createDataFrame(rows, PAGES)
    model = url_filter.fit(spark.createDataFrame([], "url string, bad int"))
    got = url_filter.judge(pages, [("com/", "allow")], model).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("", "", None, "allow")] * len(rows)


def test_one_very_long_text(spark):
    """Copies of a text of two million characters: found, measured and encoded whole."""
    text = " ".join(f"w{k * k % 99991}" for k in range(300_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x" * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles > 40_000, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, 3)}
    assert {r.doc_id: r.n_words for r in repetition.judge(docs).collect()} == {1: 300_000, 2: 300_000, 3: 1}
    tail = " ".join(text.split()[-60:])
    items = spark.createDataFrame([(7, tail)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()} == {(1, 7), (2, 7)}
    ids = byte_bpe.encode_decode(docs, BPE, P.PATTERN).collect()
    assert len({r.ids_sha256 for r in ids}) == 2 and all(r.n_tokens > 30_000 for r in ids)


def test_language_ties_and_a_very_long_text(spark):
    """Equal profiles: the lesser name; equal counts: one order; a text of two million characters counts whole."""
    train = spark.createDataFrame([("b", "the cat sat"), ("a", "the cat sat"), ("c", "un chat noir"), (None, "x"), ("d", None)], "lang string, text string")
    profiles = language.fit(train)
    docs = spark.createDataFrame([(1, "the cat sat"), (1, "the cat sat"), (2, "le chat noir " * 150_000), (3, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred) for r in language.predict(docs, profiles).collect())
    assert got == [(1, "a"), (1, "a"), (2, "c"), (3, "und")]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_keeps_columns_named_like_its_keys(spark):
    rows = [(1, "a b c d e f", 5, 6), (2, "a b c d e f", 7, 8), (3, "", 9, 9)]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _row int, _hash int"))
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]

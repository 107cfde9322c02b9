"""Every operator and stage on nulls, long texts, clashing names and repeated rows."""

import random
import time

import public_tokenizers as PT
import pytest

import corpus_pipeline
from geopressure.llm import byte_bpe, decontaminate, html_text, near_dedup, personal_data, quality, secret_scan, token_count, top_k, toxicity

NAMES = "cls n node sig top gid members grams slot own_a x own_b label score content_score metadata_score keep h pos seed __item blob kind start end rank"
LONG = {
    "digits": "1" * 1_000_000,
    "tags": "<a " * 330_000,
    "nested": "<div>" * 50_000 + "deep" + "</div>" * 50_000,
    "word": "a" * 1_000_000,
    "words": "lorem ipsum " * 80_000,
    "dots": "1." * 400_000,
    "ats": "a@" * 400_000,
    "quotes": "<a '" * 200_000 + '"',
}


def docs_of(spark, rows):
    extra = NAMES.split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in extra)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], schema)


def ordinary():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(k, " ".join(word() for _ in range(30))) for k in range(20)]
    return [*rows, rows[3], (3, "another text of one id"), (50, rows[4][1]), (None, rows[5][1]), (None, None), (51, None), (52, "")]


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.fit(docs, labels), personal_data.fit(docs), quality.fit(docs, labels)


def runs(spark, models):
    ranks = byte_bpe.load_ranks(PT.path("byte_bpe_multi_50k.tiktoken"))
    pieces = token_count.load_pieces(PT.path("piece_bpe_32k.model"))
    toxic, field, good = models
    return {
        "near_dedup": lambda d: near_dedup.near_duplicates(d),
        "keep_one": lambda d: near_dedup.keep_one(d, near_dedup.near_duplicates(d)),
        "token_count": lambda d: token_count.token_counts(d, pieces),
        "toxicity": lambda d: toxicity.score(d, toxic),
        "personal_data": lambda d: personal_data.find(d, field),
        "redact": lambda d: personal_data.redact(d, field),
        "decontaminate": lambda d: decontaminate.decontaminate(d, spark.createDataFrame([(1, "q w e r t y u i o p")], "item_id long, text string")),
        "byte_bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, ranks, PT.PATTERN), ranks),
        "secrets": lambda d: secret_scan.per_document(secret_scan.scan(d)),
        "quality": lambda d: quality.score(d, good),
        "keep_good": lambda d: quality.keep_good(d, good),
    }


OPERATORS = "near_dedup keep_one token_count toxicity personal_data redact decontaminate byte_bpe secrets quality keep_good".split()
FILTERS = ("keep_one", "decontaminate", "keep_good")


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_odd_rows(spark, models, name):
    rows = ordinary()
    docs = docs_of(spark, rows)
    got = runs(spark, models)[name](docs)
    if name in (*FILTERS, "redact"):
        assert got.columns == docs.columns
    n = got.count()
    assert 0 < n <= len(rows) if name in FILTERS else n == len(rows)
    assert runs(spark, models)[name](docs.where("false")).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_long_texts(spark, models, name):
    docs = docs_of(spark, list(enumerate(LONG.values())))
    began = time.time()
    n = runs(spark, models)[name](docs).count()
    assert n <= len(LONG) if name in FILTERS else n == len(LONG)
    assert time.time() - began < 90


def test_pages_of_odd_length():
    began = time.time()
    for page in LONG.values():
        html_text.best_path(page)
    assert html_text.extract(LONG["nested"], html_text.best_path(LONG["nested"])[0]) == ["deep"]
    assert time.time() - began < 30


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf_dir, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = docs_of(spark, ordinary())
    got = stage(spark, docs, sf_dir)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
    assert got.count() <= docs.count()
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_top_k_keeps_a_query_with_one_valid_vector_and_deals_blocks(spark, monkeypatch):
    rows = [(50, [None, 1.0]), (50, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [float("nan"), 1.0]), (3, None), (None, [1.0, 1.0]), (4, [1.0])]
    rows += [(k, [float(k % 7), float(k % 5)]) for k in range(100, 400)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vectors.where("vec_id % 50 = 0")
    want = top_k.top_k(vectors, queries).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in want} == {50, 100, 150, 200, 250, 300, 350}
    monkeypatch.setattr(top_k, "MAX_BROADCAST", 64)
    dealt = top_k.top_k(vectors, queries)
    assert dealt.orderBy("query_id", "rank").collect() == want

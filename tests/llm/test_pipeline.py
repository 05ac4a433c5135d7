import random
from collections import Counter

import pytest

import corpus_pipeline
from quillon.llm.spark_util import documents


def test_stages_keep_the_columns_and_take_effect(spark, small):
    docs = documents(spark, small)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "substrings", "packing"]
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns and after.count() <= before


def test_run_gives_whole_sequences(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    sizes = {}
    for r in rows:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(sizes.values()) <= 1024


CLASHES = "doc_id long, text string, lang string, source string, n_chars long, kept_text string, _doc string, doc int, host string, key int, gone int, cut_doc_id int, class_id int, predicted int, kept boolean, score double, n_words int, text_key string, piece int, start int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, copies, repeated rows, boilerplate and a very long text, with columns of all names that stages use."""
    r = random.Random(3)
    prose = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage, notice = prose(80), "this notice stands on every page " * 3
    texts = [None, "", "  ", prose(70), prose(40_000), *[prose(60) + f"\n{notice}\n" + prose(60) for _ in range(25)], *[prose(60) + " " + passage for _ in range(3)]]
    copy = prose(120)
    texts += [copy] * 30 + [copy + " more"]
    rows = [(k, t, "en", "host" if k % 9 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[10], (None, prose(80), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame([(*x, *[None] * 15) for x in rows], CLASHES).repartition(4)


def test_stages_on_odd_rows(spark, odd, small, tmp_path):
    """Each stage keeps all columns and untouched rows; what it drops is what it should."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs.collect()
        after = stage(spark, docs, small)
        assert after.columns == odd.columns and dict(after.dtypes) == dict(odd.dtypes), name
        after.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        now = docs.collect()
        gone = Counter(r["doc_id"] for r in before) - Counter(r["doc_id"] for r in now)
        if name == "quality":
            assert set(gone) == {0, 1, 2, None} and gone[None] == 1  # null, empty and blank texts only
            assert not any("notice" in r["text"] for r in now if r["source"] == "host") and all(len(r["text"]) == r["n_chars"] for r in now if r["n_chars"])
        elif name == "toxicity":
            assert not gone
        elif name == "near_duplicates":
            copies = [r["doc_id"] for r in before if r["doc_id"] is not None and r["doc_id"] >= 33]
            assert set(gone) == set(copies) - {min(copies)}
        else:
            assert not gone
            with_passage = [r for r in now if r["doc_id"] in (30, 31, 32)]
            words = Counter(w for r in with_passage for w in r["text"].split())
            assert sum(c == 3 for c in words.values()) < 10
    pieces = corpus_pipeline.STAGES[4][1](spark, docs, small).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in now}


def test_stages_on_an_empty_table(spark, odd, small):
    empty = spark.createDataFrame([], odd.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, small)
        assert out.count() == 0 and (name == "packing" or out.columns == odd.columns)

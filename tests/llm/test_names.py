"""Columns whose names clash with results or inner columns, in any case."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strokeframe.llm import decontaminate, fingerprint, lang_id, lm, near_dup, quality, sentencepiece_codec, sharding, toxicity, url_filter
from strokeframe.llm.names import fresh, others
from strokeframe.llm.training import labelled_texts
from strokeframe.tables import read_table

DIR = "/root/testdata/sf0.001"
CLASHES = ["Score", "LANG_PRED", "Rejected", "_lettered", "_text", "_Row", "_chunk", "Ids", "Fingerprint", "N_tokens", "Ids_Sha256", "Shard", "Slot", "Hit_key", "component_ID", "KEPT", "_range", "n_words"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([(1, "one two three", "x"), (2, None, "y"), (3, "w " * 9000, "z")], "doc_id bigint, text string, kept_by string")
    return rows.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def unclear(df):
    names = [c.lower() for c in df.columns]
    return [c for c in names if names.count(c) > 1]


def test_names():
    assert others(["a", "Score", "b"], "score") == ["a", "b"]
    assert fresh(["A", "_a"], "a", "b", "B") == ["__a", "b", "_B"]


def test_models(spark, docs):
    given, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    langs = lang_id.fit(given, "lang", 30)
    judged = {
        "language": lang_id.identify(docs, langs), "quality": quality.score(docs, quality.fit(labelled_texts(given, labels, "quality", 4, 2, 50))),
        "toxicity": toxicity.score(docs, toxicity.fit(labelled_texts(given, labels, "toxic", 3, 1, 50), langs, 200)),
        "fingerprint": fingerprint.fingerprints(docs, np.arange(fingerprint.STEPS + 1)),
    }
    for name, df in judged.items():
        assert unclear(df) == [] and df.select("doc_id", "kept_by").collect()[0] == (1, "x"), name
    assert lang_id.accepted(docs, langs).columns == docs.columns


@pytest.mark.parametrize("chunk", [1000, 1 << 14])
def test_codec(spark, docs, chunk):
    model = sentencepiece_codec.read_model(spark)
    keep = [c for c in docs.columns if c != "text"]
    coded = sentencepiece_codec.encode(docs, model, keep, chunk=chunk)
    back = sentencepiece_codec.decode(coded, model, [c for c in coded.columns if c != "ids"])
    assert unclear(coded) == unclear(back) == []
    assert {r.doc_id: r.text for r in back.collect()} == {1: "one two three", 2: "", 3: "w " * 9000}
    assert {r["_Row"] for r in back.collect()} == {CLASHES.index("_Row")}


def test_the_rest(spark, docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in decontaminate.remove_spans(docs, bench).collect()}[1] == ""
    dealt = sharding.gapless_slots(sharding.shard_rows(docs, "doc_id", 2), "shard", ["doc_id"], 4)
    assert unclear(dealt) == [] and dealt.count() == 3
    kept = near_dup.drop_near_duplicates(docs, 5, 80)
    assert kept.columns == docs.columns and kept.count() == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), *[c for c in CLASHES]).withColumns({"Host": F.lit(1), "RULE": F.lit(2)})
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    judged = url_filter.judge_urls(pages, rules)
    assert unclear(judged) == [] and {r.verdict for r in judged.collect()} == {"block"}


def test_counts_beyond_32_bits():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 5).astype(np.uint64))
    counts = np.array([1, (1 << 32) - 1, 1 << 32, 10**10, 1 << 60], np.int64)
    piece = lm.Piece.of([(0, b"\0" * 8, keys.tobytes(), counts.tobytes())])
    exact, _ = lm.lookups([piece], 0)
    assert exact(keys).tolist() == counts.tolist()

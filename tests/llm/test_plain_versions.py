"""Queries of the classifiers against plain versions of what their models say, and cases that once went wrong."""

import math
import os
import re

import numpy as np
import pyarrow as pa

from strokeframe.llm import decontaminate, lang_id, quality, queries, toxicity, url_filter
from strokeframe.llm.store import scope, shared, written
from strokeframe.llm.training import labelled_texts, remainder
from strokeframe.tables import read_table

DIR = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def grams(text, sizes, bits):
    raw, counts = (text or "").encode(), {}
    for n in sizes:
        for i in range(len(raw) - n + 1):
            h = n
            for b in raw[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            at = (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
            counts[at] = counts.get(at, 0) + 1
    return counts


def test_language_query(spark):
    docs = read_table(spark, DIR, "documents")
    m = lang_id.fit(docs.select("doc_id", "text", "lang").where(remainder(docs["doc_id"], 4) != 2), "lang", queries.LANG_ROWS)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op5_lang_id(spark, DIR).collect():
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        counts = grams(texts[r.doc_id], lang_id.SIZES, lang_id.BITS)
        total = max(sum(counts.values()), 1)
        z = [(sum(c / total * float(m.logits[k, j]) for k, c in counts.items()) + float(m.bias[j])) / m.temperature for j in range(m.logits.shape[1])]
        p = [math.exp(x - max(z)) for x in z]
        p = [x / sum(p) for x in p][: len(m.langs)]
        assert math.isclose(r.score, max(p), abs_tol=1e-4) and p[m.langs.index(r.lang_pred)] >= max(p) - 1e-4
    rng = np.random.default_rng(1)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    junk = spark.createDataFrame([(i, "".join(rng.choice(letters, 400))) for i in range(40)], DOC)
    assert lang_id.identify(junk, m).where("rejected").count() >= 38
    known = docs.where("lang IS NOT NULL AND length(text) > 60").select("doc_id", "text")
    assert lang_id.accepted(known, m).count() >= 0.98 * known.count()


def test_quality_terms():
    """The terms of each block against counts over plain texts."""

    def bucket(gram, bits):
        h = len(gram)
        for x in gram:
            h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
        return (h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)

    def shape(b):
        c = chr(b)
        return 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 if "0" <= c <= "9" else 4 if b > 127 else 5 if c in " \t\n\r\v\f" else b

    def back(words):
        seen = {}
        for i, w in enumerate(words):
            yield min(int(np.log2(i - seen[w])) + 1, 7) if w in seen else 0
            seen[w] = i

    texts = ["The cat, the CAT 42!! the\tcat", "", "é", "a a a a b a", None, " ".join(f"w{i % 90}" for i in range(300))]
    got = quality.raw_features(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        streams = [(raw, (3,)), (bytes(map(shape, raw)), (3, 4)), (bytes(back(w for w in re.split(rb"[\x20\x09-\x0d]+", raw) if w)), (1, 2, 3))]
        want = [np.zeros(n) for n in quality.WIDTHS]
        for (stream, sizes), bits, row in zip(streams, quality.BITS, want, strict=True):
            for n in sizes:
                for i in range(len(stream) - n + 1):
                    row[bucket(stream[i : i + n], bits)] += 1
        assert np.allclose(got[k], np.log1p(np.concatenate(want)), atol=1e-5)


def test_latent_axes_are_those_of_the_decomposition():
    x = np.random.default_rng(2).normal(size=(90, 120)) * np.geomspace(1, 1e-4, 120)
    own, full = quality.latent_axes(x), np.linalg.svd(x)[2][: quality.RANK].T
    assert np.allclose(own.T @ own, np.eye(quality.RANK), atol=1e-8) and np.linalg.norm(x @ own) >= np.linalg.norm(x @ full) * (1 - 1e-6)


def test_quality_query(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    m = quality.fit(labelled_texts(docs, labels, "quality", 4, 2, queries.QUALITY_ROWS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op2_quality(spark, DIR).collect():
        x = m.embed(quality.raw_features(pa.array([texts[r.doc_id]], pa.string())))[0]
        cosine = [sum(float(a) * float(b) for a, b in zip(x, v, strict=True)) for v in m.vectors]
        near = sorted(range(len(cosine)), key=lambda k: (-cosine[k], k))[: quality.NEIGHBOURS]
        vote = [max(cosine[k], 1e-3) ** quality.SHARPNESS * m.weights[k] for k in near]
        want = sum(v * m.labels[k] for v, k in zip(vote, near, strict=True)) / sum(vote)
        assert math.isclose(r.score, want, abs_tol=1e-6) and r.predicted == int(r.score >= 0.7)


def test_toxicity_query(spark):
    docs, labels = read_table(spark, DIR, "documents"), read_table(spark, DIR, "labels")
    languages = lang_id.fit(docs.select("doc_id", "text", "lang").where(remainder(docs["doc_id"], 3) != 1), "lang", queries.LANG_ROWS)
    m = toxicity.fit(labelled_texts(docs, labels, "toxic", 3, 1, queries.TOXIC_ROWS), languages)
    texts, net = {r.doc_id: r.text for r in docs.collect()}, m.net
    for r in queries.op10_toxicity(spark, DIR).collect():
        words, stems, _ = toxicity.word_rows(pa.array([texts[r.doc_id]], pa.string()))
        e = [net.word[a] + net.stem[b] for a, b in zip(*net.rows(words, stems), strict=True)]
        pad, n = [np.zeros(toxicity.DIM)] * (max(toxicity.WIDTHS) - 1), max(len(e), 1)
        e = (e or [np.zeros(toxicity.DIM)]) + pad
        best = []
        for j, kernel in enumerate(net.kernels):
            at = [sum(e[i + k] @ kernel[k] for k in range(len(kernel))) + net.kernel_bias[j] for i in range(n)]
            best.append(np.max(at, axis=0))
        z = np.maximum(np.concatenate(best), 0) @ net.out + net.bias
        p, t = 1 / (1 + math.exp(-np.clip(m.slope * z + m.intercept, -30, 30))), m.thresholds.get(r.lang_pred, m.thresholds[""])
        want = max(1 - 0.3 * (1 - p) / (1 - t), 0.7) if p >= t else 0.7 * p / t
        assert math.isclose(r.score, want, abs_tol=1e-3) and r.predicted == int(r.score >= 0.7)


def test_urls_by_tables(spark):
    pages = read_table(spark, DIR, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "http://org/"), (-3, "http://org/"), (-4, "http://a.example.org/es/" + "x" * 100_000)], "page_id bigint, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    every = pages.unionByName(odd)
    rows = [sorted(map(str, url_filter.judge_urls(every, rules, most_bits=n).select("page_id", "host", "path", "rule", "verdict").collect())) for n in (1 << 20, 1)]
    assert rows[0] == rows[1] and len(rows[0]) == every.count()


def test_contaminated_rows_without_id_and_clashing_names(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    d = spark.createDataFrame([(None, passage, 1, 2), (7, f"x {passage} y", 3, 4), (8, "clean", 5, 6), (9, None, 7, 8)], f"{DOC}, hit_spans int, hit_0 int")
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [8, 9]
    cut = {r.doc_id: (r.text, r.hit_spans, r.hit_0) for r in decontaminate.remove_spans(d, bench).collect()}
    assert cut == {None: ("", 1, 2), 7: ("x y", 3, 4), 8: ("clean", 5, 6), 9: (None, 7, 8)}


def test_scope_takes_its_tables_and_broadcasts_away(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    with scope(spark):
        kept = written(spark.range(3), "kept", keep=True)
        written(spark.range(3), "gone")
        b = shared(spark, [1])
        assert b.value == [1]
    assert [n.split("-")[0] for n in set(os.listdir(folder)) - before] == ["kept"] and kept.count() == 3

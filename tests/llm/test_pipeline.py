"""The pipeline's stages against plain versions on the smallest tables."""

import re

import corpus_pipeline
import sentencepiece
from test_operators import brute_groups

from strokeframe.llm import sentencepiece_codec as sp
from strokeframe.tables import read_table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, DIR, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_dup", "decontamination", "sentencepiece"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DIR)
        assert after.columns == docs.columns
        kept[name] = (docs.collect(), after.collect())
        docs = after
    labels = {r.doc_id: r.quality for r in read_table(spark, DIR, "labels").collect()}
    before, after = kept["quality"]
    good = {r.doc_id for r in after}
    judged = [(labels[r.doc_id], r.doc_id in good) for r in before if r.doc_id in labels]
    assert sum(k for q, k in judged if q == 1) >= 0.97 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.9 * sum(q == 0 for q, _ in judged)
    before, after = kept["language"]
    assert len(after) >= 0.98 * len(before)
    before, after = kept["near_dup"]
    assert {r.doc_id for r in after} == {i for i, g in brute_groups([(r.doc_id, r.text) for r in before], 5).items() if g[2]}
    before, after = kept["decontamination"]

    def split(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]

    windows = set()
    for r in read_table(spark, DIR, "benchmark").collect():
        w = split(r.text)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    clean = set()
    for r in before:
        w = split(r.text)
        hit = {k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(r.doc_id)
    assert {r.doc_id for r in after} == clean
    library = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    texts = {r.doc_id: r.text or "" for r in after}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {i: len(library.encode(t)) for i, t in texts.items()}
    assert all(r.round_trip for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == set(texts)

"""op7 gives the same rows whether its tables are broadcast or, as on large inputs, stay tables."""

import bisect
import math
import re
from collections import Counter

from strokeframe.llm import lm

DOC = "doc_id bigint, text string"
ROWS = [
    (1, None), (2, ""), (4, "one two"), (4, "one two"), (4, "other words one"), (None, "no id"), (None, "no id at all"), (None, None),
    (5, " ".join(f"w{i % 700}" for i in range(3000))), (6, "É ü 中文 ▁x"), *[(i, f"the cat sat on mat {i}") for i in range(10, 60)],
]


def rows_of(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def assert_same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:4] == y[:4] and math.isclose(x[4], y[4], abs_tol=1e-9) and math.isclose(x[5], y[5], abs_tol=1e-9)


def test_repeated_and_null_ids_beyond_the_counts_bound(spark):
    d = spark.createDataFrame(ROWS, DOC).repartition(3)
    model, counts = lm.fit(d.where("doc_id < 40").select("text"))
    small = rows_of(lm.score(d, model, counts))
    assert len(small) == len(ROWS)
    assert_same(rows_of(lm.score(d, model, counts, 60)), small)


def test_all_pairs_beyond_the_filter_bound(spark):
    d = spark.createDataFrame(ROWS, DOC).repartition(3)
    train = d.where("doc_id < 40").select("text")
    model, counts = lm.fit(train)
    large, large_counts = lm.fit(train, filter_bytes=400)
    small = rows_of(lm.score(d, model, counts))
    assert large.filter_bytes > large.most_bytes and large.pair_weight == model.pair_weight
    assert_same(rows_of(lm.score(d, large, large_counts)), small)
    assert_same(rows_of(lm.score(d, large, large_counts, 60)), small)


def test_probabilities_add_up_to_one_at_most_and_equal_a_plain_bigram_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 400)  # hardly any false answer
    texts = [r[1] for r in ROWS[8:]] + ["a b a c a d", "a b a b", "b a", "c d a a", None]
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    model, grams = lm.fit(d.select("text"))
    rows = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None] for t in texts]
    words, pairs = Counter(w for r in rows for w in r), Counter((a, b) for r in rows for a, b in zip(["<", *r], r, strict=False))
    floors = sorted({1, 2, 3} | {2**k for k in range(40)} | {3 * 2**k for k in range(40)})

    def level(c):
        k = bisect.bisect_right(floors, c) - 1
        return (0, 0) if c == 0 else (floors[k], floors[k + 1] - 1)

    mass = sum(sum(level(c)) / 2 for c in words.values())
    weight = min(max(1 - sum(c == 1 for c in pairs.values()) / sum(words.values()), 0), 0.95)

    def p(w, before):
        alone = (sum(level(words[w])) / 2 + 0.5) / (mass + 0.5 * (len(words) + 1))
        most = len(texts) if before == "<" else level(words[before])[1]
        if not most:
            return alone
        return weight * min(level(pairs[before, w])[0] / most, 1) + (1 - weight) * alone

    for before in ["<", *words, "unseen"]:
        assert sum(p(w, before) for w in [*words, "unseen"]) <= 1 + 1e-9
    asked = [*texts, "unseen a b", "d d d", "mat on sat"]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(list(enumerate(asked)), DOC), model, grams).collect()}
    for i, t in enumerate(asked):
        r = [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
        assert math.isclose(got[i], sum(math.log10(p(b, a)) for a, b in zip(["<", *r], r, strict=False)), abs_tol=1e-6)

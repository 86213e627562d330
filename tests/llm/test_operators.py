"""The operators on small tables: nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from strokeframe.llm import decontaminate, fingerprint, lang_id, lm, near_dup, quality, queries, sharding, toxicity, url_filter
from strokeframe.llm.store import written
from strokeframe.llm.training import bounded_sample, labelled_texts, remainder

DIR = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"
LONG = " ".join(f"w{i}" for i in range(20_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "no id"), (5, LONG), (6, "É ü 中文 ▁x")]


def docs(spark, rows=ODD):
    return spark.createDataFrame(rows, DOC)


def crc(x, m):
    return zlib.crc32(str(x).encode()) % m


def words(t):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert difference(queries.queries()[name](spark, DIR), connect(DIR), queries.oracle_sql()[name]) == ""


# -- op3 ----------------------------------------------------------------------


def test_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = [None, "", "nothing", "http://A.Example.org/es/x?y", "http://example.org/en/12#z", "https://org", "http://x.com/de/", "http://x.com/fr/", "http://xcom/de/", "http://badexample.org/es/", "://", "http://" + "a." * 3000 + "com/de/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string, host string")
    got = {r.page_id: (r.host if r.page_id != 11 else "", r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    none = ("", "", None, "allow")
    assert [got[i] for i in (0, 1, 2, 10)] == [none] * 4
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("org", "", None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][2:] == ("com/fr/", "allow") and got[8][2:] == (None, "allow")
    assert got[9][2:] == ("org/", "allow") and got[11][2:] == ("com/de/", "block")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    """With few bits a key several levels are needed, and every key of the universe is still answered rightly."""
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 7)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(3000)], "key string")
    c = url_filter.Cascade.build(listed, universe, bits_per_key=2)
    got = {r.key for r in universe.where(c.contains(F.col("key"))).collect()}
    assert len(c.levels) > 2 and got == {f"k{i}" for i in range(0, 3000, 7)}


# -- op6 ----------------------------------------------------------------------


def test_hits(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage), (2, "Short Item"), (3, None), (4, "..."), (10, passage)], "item_id bigint, text string")
    rows = [(1, passage.upper() + " tail"), (2, "x short, item! y short item"), (3, "p1 p2 p3"), (4, None), (5, "p5 " * 5 + LONG), (6, "a " + " ".join(f"p{i}" for i in range(4, 17)) + " b" * 400)]
    got = {r.doc_id: r for r in decontaminate.find_hits(docs(spark, rows), bench).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1]["items"]) == (31, 30, ["1", "10"])
    assert (got[2].n_words, got[2].n_hit, got[2]["items"]) == (6, 4, ["2"])
    assert [got[k].n_hit for k in (3, 4, 5)] == [0, 0, 0] and got[4].n_words == 0 and got[5].n_words == 20_005
    assert got[6].n_hit == 13 and [tuple(s) for s in got[6].hit_spans] == [(2, 14)]
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()}
    assert kept == {3, 4, 5, 6}
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(docs(spark, rows), bench).collect()}
    assert cut[1] == "tail" and cut[2] == "x y" and cut[3] == "p1 p2 p3"
    assert decontaminate.find_hits(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.find_hits(docs(spark, []), bench).count() == 0


def test_hits_in_slices(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 7)
    assert difference(queries.op6_decontamination(spark, DIR), connect(DIR), queries.oracle_sql()["op6_decontamination"]) == ""


# -- op8 ----------------------------------------------------------------------


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 12345678901234, (1 << 63) - 1, -(1 << 63), *range(2, 200)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 100):
        got = {r.k: r.s for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    r = sharding.shard_rows(spark.range(3000).withColumn("shard", F.lit("clash")), "id", 16)
    assert r.where("grown_shard <> shard AND grown_shard <> 16").count() == 0
    moved = r.where("grown_shard = 16").count()
    assert 100 < moved < 260


def test_slots_have_no_gaps(spark):
    rows = docs(spark).withColumn("n", F.length("text"))
    for r in (rows, rows.limit(0)):
        got = sharding.gapless_slots(sharding.shard_rows(r, "doc_id", 2), "shard", ["doc_id", "n"], 4).collect()
        by = collections.defaultdict(list)
        for x in got:
            by[x.shard].append(x.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(got) == r.count()


# -- op9 ----------------------------------------------------------------------


def brute_groups(rows, n, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(seed=3, groups=6, size=40):
    """Groups of copies with more and more changed words: chains of links, and copies too far from all others."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(120)]
        for c in range(size):
            w = list(base)
            for k in rng.choice(len(w), rng.integers(0, 14), replace=False):
                w[k] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows) * 3 + 1, " ".join(w)))
    return rows + [(2, "a b"), (5, "A  B\n"), (8, ""), (11, None), (14, "a b c")]


@pytest.mark.parametrize("group", [256, 16])
def test_near_duplicates_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(near_dup, "GROUP", group)
    rows = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs(spark, rows), 4, 80).collect()}
    assert got == brute_groups(rows, 4)


def test_near_duplicates_of_odd_rows(spark):
    got = near_dup.near_duplicates(docs(spark), 5, 80).collect()
    assert len(got) == len(ODD) and all(r.component_id == r.doc_id and r.kept for r in got)
    assert near_dup.near_duplicates(docs(spark, []), 5, 80).count() == 0
    clash = docs(spark, copies()).withColumns({"component_id": F.lit("x"), "kept": F.lit(1)})
    kept = near_dup.drop_near_duplicates(clash, 4, 80)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {i for i, g in brute_groups(copies(), 4).items() if g[2]}


def test_sketches_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    for size in (3, 50, 2000):
        agree = []
        for k in range(20):
            x = rng.permutation(pool)[: size + size // 4]
            a, b = x[:size], x[size // 4 :]
            s = near_dup.sketch(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != 0).all()
            agree.append((s[0] == s[1]).mean())
            want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(agree) - want) < 0.06


def test_connected(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (20, 21), (7, 7), *[(k, k + 1) for k in range(100, 160)]], "a bigint, b bigint")
    got = {r.node: r.root for r in near_dup.connected(links).collect()}
    assert got == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, **dict.fromkeys(range(100, 161), 100)}


# -- op7 ----------------------------------------------------------------------


def test_lm_counts_and_slices(spark):
    d = docs(spark, [(i, t) for i, (_, t) in enumerate(ODD)] + [(100, "the cat sat"), (101, "the cat ran")])
    model, counts = lm.fit(d.select("text"))
    c = collections.Counter(w for r in d.collect() for w in [*words(r.text), None])
    n, v = sum(c.values()), len(c)
    for most in (1 << 30, 60):
        got = {r.doc_id: r for r in lm.score(d, model, counts, most).collect()}
        for r in d.collect():
            t = [*words(r.text), None]
            assert (got[r.doc_id].n_tokens, got[r.doc_id].n_known, got[r.doc_id].train_tokens) == (len(t), len(t), n)
            assert math.isclose(got[r.doc_id].base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
            assert got[r.doc_id].score < 0


def test_lm_levels_are_never_low_and_prefers_seen_text(spark):
    d = docs(spark, [(i, "the quick brown fox jumps over the lazy dog") for i in range(20)] + [(50, " ".join(f"q{i}" for i in range(300)))])
    model, counts = lm.fit(d.select("text"))
    test = docs(spark, [(1, "the quick brown fox"), (2, "fox brown quick the")])
    got = {r.doc_id: r.score for r in lm.score(test, model, counts).collect()}
    assert got[1] > got[2] + 1
    for r in counts.collect():
        k, c = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], np.int64)
        piece = lm.Piece.of([(r["segment"], r["bits"], r["keys"], r["counts"])])
        assert (piece.level(k, model.segment_bits) >= lm.levels(c)).all() and (piece.counts == c).all()
        other = np.arange(1, 20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        own = other[(other >> np.uint64(64 - model.segment_bits)) == r["segment"]]
        assert (piece.level(own, model.segment_bits) > 0).mean() < 0.06


def test_lm_empty(spark):
    d = docs(spark, [(i, f"a b c d{i}") for i in range(200)])
    empty, counts = lm.fit(d.select("text").limit(0))
    got = lm.score(d, empty, counts).collect()
    assert len(got) == 200 and all(r.base_score == 0 and r.n_known == 0 for r in got)


# -- op4 ----------------------------------------------------------------------


def test_entropy_is_exact():
    rng = np.random.default_rng(0)
    raw = np.concatenate([rng.integers(0, 256, 3000), rng.integers(97, 101, 3000), np.full(200, 65)]).astype(np.uint8)
    steps = fingerprint.entropy_steps(raw)
    for i in range(0, len(steps), 37):
        n = np.bincount(raw[i : i + fingerprint.WINDOW])
        p = n[n > 0] / fingerprint.WINDOW
        assert abs(steps[i] - 1000 * -(p * np.log2(p)).sum() / np.log2(fingerprint.WINDOW)) <= 1.01


def test_fingerprints(spark):
    rng = np.random.default_rng(5)
    text = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(text)] + [(6, None), (7, ""), (8, "é" * 9), (9, text[0])]
    d = docs(spark, rows)
    ranks = fingerprint.rarity_ranks(d)
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(d, ranks, sharding.id_ranges(d, "doc_id", 4)).collect()}
    assert len(got) == 10
    by = dict(rows)
    for i in range(10):
        own, nxt = by[i] or "", by[(i - 1) % 10] or ""
        half = len(own) // 2
        assert got[i].n_chars == len(own)
        assert got[i].edited_sha256 == hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest()
    assert got[0].fingerprint == got[9].fingerprint and got[6].fingerprint == got[7].fingerprint and got[7].near_next == 1
    for i in range(1, 6):
        assert 0.3 < got[i].near_edited < 0.7 and got[i].near_next < 0.1
    alone = docs(spark, [(3, "x" * 100)])
    (one,) = fingerprint.compare_with_edits(alone, ranks, sharding.id_ranges(alone, "doc_id", 4)).collect()
    assert one.near_next == 1
    assert fingerprint.compare_with_edits(docs(spark, []), ranks, F.lit(0)).count() == 0
    odd = fingerprint.fingerprints(docs(spark).withColumn("fingerprint", F.lit(1)), ranks)
    assert odd.count() == len(ODD)


# -- op2, op5, op10 -----------------------------------------------------------


def test_remainder_and_sample(spark):
    got = spark.range(50).select("id", remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r.r == crc(r.id, 4) for r in got)
    s = bounded_sample(spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("y")), "y", 500)
    assert all(380 < r["count"] < 620 for r in s.groupBy("y").count().collect())


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op2_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.97 * got.count() > 50


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op10_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert got.where("predicted = toxic").count() >= 0.85 * got.count() > 50


def test_language_held_out(spark):
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op5_lang_id(spark, "/root/testdata/sf0.01").join(lang, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count() > 100


def test_classifiers_on_odd_rows(spark):
    train = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    odd = docs(spark).withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1), "rejected": F.lit(2)})
    languages = lang_id.fit(train, "lang", 100)
    found = lang_id.identify(odd, languages)
    assert found.count() == len(ODD)
    assert found.where("lang_pred = 'und'").count() == 3 and found.where("rejected AND score = 0").count() == 3
    assert lang_id.accepted(odd, languages).columns == odd.columns
    q = quality.fit(labelled_texts(train, labels, "quality", 4, 2, 100))
    assert quality.score(odd, q).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert quality.accepted(odd, q).columns == odd.columns
    t = toxicity.fit(labelled_texts(train, labels, "toxic", 3, 1, 100), languages)
    assert toxicity.score(odd, t).where("score BETWEEN 0 AND 1").count() == len(ODD)
    for f in (lambda d: lang_id.identify(d, languages), lambda d: quality.score(d, q), lambda d: toxicity.score(d, t)):
        assert f(odd.limit(0)).count() == 0


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, label int")
    assert quality.score(docs(spark), quality.fit(none)).where("score = 0.5").count() == len(ODD)
    languages = lang_id.fit(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert lang_id.identify(docs(spark), languages).where("lang_pred = 'und'").count() == len(ODD)
    assert toxicity.score(docs(spark), toxicity.fit(none, languages)).where("score < 0.5").count() == len(ODD)


def test_written_tables(spark):
    df = written(spark.range(5), "t")
    assert df.count() == 5

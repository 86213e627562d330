"""Benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame functions only.

The benchmark's windows of consecutive words are keyed by a hash of three of their words; the set's size
is checked before it is broadcast. Every document's windows are keyed once, in one scan, and probed
against the set, and each hit is verified on all the window's words. Only hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh

SPACE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of the benchmark that are broadcast at once.
BROADCAST_WINDOWS = 2_000_000


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters a-z and characters beyond ASCII; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is right, and much faster, where all is ASCII
    only_az = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(only_az)
    return F.filter(F.split(lower, SPACE), lambda w: w != "")


def window_key(words: Column, start: Column, n: int) -> Column:
    """Hash of the length and the first, middle and last word of the window of ``n`` words at ``start`` (from 0)."""
    return F.xxhash64(F.get(words, start), F.get(words, start + n // 2), F.get(words, start + (n - 1)), F.lit(n))


def _places(words: Column, n: int) -> Column:
    """The number of windows of ``n`` words."""
    return F.greatest(F.size(words) - (n - 1), F.lit(0))


def _window_keys(words: Column, lengths: list[int]) -> Column:
    """The keys of all windows, length by length, each in the order of the text."""

    def of(n: int) -> Column:
        keys = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: window_key(words, i, n))
        return F.when(F.size(words) >= n, keys).otherwise(F.array().cast("array<bigint>"))

    keys = [of(n) for n in lengths]
    return keys[0] if len(keys) == 1 else F.concat(*keys)


def benchmark_windows(benchmark: DataFrame, window: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, n, words, hash): every window of ``window`` words; an item of fewer, but not none, is one window."""
    items = benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    n = F.least(F.lit(window), F.size("w"))
    return items.select(
        "item_id", n.alias("n"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).alias("words")
    ).distinct()


def _scan(words: DataFrame, bench: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, n_words, pos, len, item_id): the verified hits, and a row without item for every document.

    The arrays are made in a projection, once a document; the loop over them, the probe of the broadcast set
    and the check of the words are generated code that copies no words. explode_outer, as explode would
    evaluate the arrays in a filter as well.
    """
    probes = words.withColumn("keys", _window_keys(F.col("words"), lengths)).select(
        "doc_id", "words", F.posexplode_outer("keys").alias("place", "key")
    )
    before, skipped = F.lit(0), []
    for n in lengths:
        skipped.append(F.when(bench["n"] == n, before))
        before = before + _places(probes["words"], n)
    pos = probes["place"] + 1 - F.coalesce(*skipped)
    same = (probes["key"] == bench["key"]) & (F.slice(probes["words"], pos, bench["n"]) == bench["bench_words"])
    first = probes["place"].isNull() | (probes["place"] == 0)
    return probes.join(F.broadcast(bench), same, "left").where(F.col("item_id").isNotNull() | first).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), pos.alias("pos"), bench["n"].alias("len"), "item_id"
    )


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, hit_spans, items) of every document.

    n_hit counts words inside any verified window; hit_spans has the merged [from, to] word ranges, from 1;
    items are the item_ids with a window in the text, as strings in order. Null and empty texts, and texts
    without words, have no words and no hits; null item_ids are left out. Rows that share a doc_id (or have
    none) count as one document: the most words, and the union of their hits.
    """
    bench = benchmark_windows(benchmark, window).where(F.col("item_id").isNotNull())
    # lengths below the window come only from short items: at most ``window`` distinct integers
    lengths = sorted(r[0] for r in bench.select("n").distinct().collect()) or [window]
    key = F.coalesce(*[F.when(F.col("n") == n, window_key(F.col("words"), F.lit(0), n)) for n in lengths])
    bench = bench.select("item_id", "n", F.col("words").alias("bench_words"), key.alias("key"))
    words = docs.select(F.col(doc_id).alias("doc_id"), words_of(F.col(text)).alias("words"))
    # a set beyond the bound is broadcast in slices, each in a scan of its own
    slices = -(-bench.count() // BROADCAST_WINDOWS) or 1
    scans = [_scan(words, bench.where(F.pmod("key", F.lit(slices)) == i) if slices > 1 else bench, lengths) for i in range(slices)]
    hits = reduce(DataFrame.unionByName, scans)
    span = F.when(F.col("item_id").isNotNull(), F.struct(F.col("pos"), (F.col("pos") + F.col("len") - 1).alias("end")))
    by_doc = hits.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )

    def merge(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.struct(last["pos"].alias("pos"), F.greatest(last["end"], span["end"]).alias("end"))
        joins = (F.size(done) > 0) & (span["pos"] <= last["end"] + 1)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(span)))

    merged = F.aggregate("spans", F.array().cast("array<struct<pos:int,end:int>>"), merge)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["pos"] + 1)
    return by_doc.select("doc_id", "n_words", merged.alias("hit_spans"), "items").select("doc_id", "n_words", n_hit.alias("n_hit"), "hit_spans", "items")


def contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word is hit, and at least one in ``share``."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents; all columns stay. Rows that share a doc_id, or have none, are one
    document: they stay or go together."""
    hits = find_hits(docs, benchmark, window, doc_id, text)
    [key] = fresh(docs.columns, "hit_key")
    bad = hits.where(contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("doc_id").alias(key))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[key]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the hit words of every document cut from its text; all columns stay.

    A text with hits becomes its words that are left, joined by spaces; others stay as they are. Rows that share
    a doc_id, or have none, are one document: the words at the places of any of their hits are cut from each.
    """
    spans, key = fresh(docs.columns, "hit_spans", "hit_key")
    hits = find_hits(docs, benchmark, window, doc_id, text).where("n_hit > 0").select(F.col("doc_id").alias(key), F.col("hit_spans").alias(spans))
    joined = docs.join(hits, docs[doc_id].eqNullSafe(hits[key]), "left")
    kept = F.filter(words_of(F.col(text)), lambda w, i: ~F.exists(spans, lambda s: (s["pos"] <= i + 1) & (i + 1 <= s["end"])))
    return joined.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.concat_ws(" ", kept))).select(*docs.columns)

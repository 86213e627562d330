"""URL rules answered by a cascade of Bloom filters, in DataFrame functions only.

Every url offers a few candidate keys: a suffix of its host followed by a prefix of its path. The
set of rule keys is encoded by a cascade: level 1 holds the listed keys, level 2 the unlisted keys of
the corpus that level 1 also accepts, level 3 the listed keys that level 2 also accepts, and so on
until a level accepts nothing wrong. Over the corpus's complete key universe the first level that
rejects a key then tells exactly whether it is listed, so rows are judged without a join.

A level of more than MOST_BITS is a table of its words instead of a literal: each distinct key's probes
are joined with the words that they fall in, and the distinct (host, path) with what they found.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

WORD = 63  # bits used of a bigint, so that no literal is negative
PROBES = 3
BITS_PER_KEY = 8
LEAST_BITS = 256
#: Bits of a level up to which it is a literal of the plan.
MOST_BITS = 1 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; '' if there is none."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; '' if there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, label_counts: Sequence[int], path_lengths: Sequence[int]) -> Column:
    """Array of (n, key), longest first: a host suffix of so many labels and a path prefix of such a length, as some rule has."""
    labels = F.split(host, r"\.")
    suffixes = [F.when(F.size(labels) >= n, F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n))) for n in label_counts]
    prefixes = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths]
    keys = F.array_distinct(F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in prefixes])))
    return F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))))


def _positions(key: Column, bits: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * PROBES + i), key), F.lit(bits)) for i in range(PROBES)]


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % WORD).cast("int"))


def bloom_table(keys: DataFrame, bits: int, level: int) -> DataFrame:
    """(word, mask): the filter over column ``key`` of ``keys`` as bigints of 63 bits; words without a bit are left out."""
    hit = keys.select(F.explode(F.array(*_positions(F.col("key"), bits, level))).alias("bit"))
    return hit.groupBy(F.floor(F.col("bit") / WORD).alias("word")).agg(F.bit_or(_mask(F.col("bit"))).alias("mask"))


def bloom_words(keys: DataFrame, bits: int, level: int) -> list[int]:
    """All words of the filter; their number is that of ``bits``, whatever the input."""
    found = {r["word"]: r["mask"] for r in bloom_table(keys, bits, level).collect()}
    return [found.get(i, 0) for i in range(-(-bits // WORD))]


def might_contain(words: list[int], bits: int, level: int, key: Column) -> Column:
    """Whether the level's filter accepts the key."""
    table = F.array(*[F.lit(w).cast("bigint") for w in words])

    def bit(at: Column) -> Column:
        word = F.element_at(table, (F.floor(at / WORD) + 1).cast("int"))
        return word.bitwiseAND(_mask(at)) != 0

    return reduce(lambda a, b: a & b, [bit(at) for at in _positions(key, bits, level)])


class Cascade:
    """Exact membership of listed keys within a key universe; a level is a list of words, or a table of them."""

    def __init__(self, levels: list[tuple[list[int] | DataFrame, int]]):
        self.levels = levels

    @property
    def tabled(self) -> bool:
        return any(isinstance(words, DataFrame) for words, _ in self.levels)

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS) -> Cascade:
        """Both frames have one string column ``key``; null keys are left out. A level has ``bits_per_key`` bits for
        each of its keys."""
        inside = listed.select("key").where(F.col("key").isNotNull()).distinct()
        outside = universe.select("key").where(F.col("key").isNotNull()).distinct().join(inside, "key", "left_anti")
        made = cls([])
        encode, other = inside, outside
        n = encode.count()
        while n:
            bits, level = max(LEAST_BITS, bits_per_key * n), len(made.levels)
            words = bloom_words(encode, bits, level) if bits <= most_bits else written(bloom_table(encode, bits, level), "bloom")
            made.levels.append((words, bits))
            encode, other = made.accepted(other, level), encode
            if isinstance(words, DataFrame):
                encode = written(encode, "keys")
            n = encode.count()
        return made

    def accepted(self, keys: DataFrame, level: int) -> DataFrame:
        """The distinct ``keys`` (key) that the level's filter accepts."""
        words, bits = self.levels[level]
        if not isinstance(words, DataFrame):
            return keys.where(might_contain(words, bits, level, F.col("key")))
        probes = keys.select("key", F.explode(F.array(*_positions(F.col("key"), bits, level))).alias("bit"))
        hit = probes.withColumn("word", F.floor(F.col("bit") / WORD)).join(words, "word").where(F.col("mask").bitwiseAND(_mask(F.col("bit"))) != 0)
        return hit.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == PROBES).select("key")

    def listed_among(self, keys: DataFrame) -> DataFrame:
        """The listed ones of distinct ``keys`` (key) of the universe, level after level."""
        found = keys.limit(0)
        for level in range(len(self.levels)):
            inside = written(self.accepted(keys, level), "keys")
            if level % 2:
                found = found.unionByName(keys.join(inside, "key", "left_anti"))
            keys = inside
        return found.unionByName(keys) if len(self.levels) % 2 else found

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the number of levels accepted in a row is odd. Not for tables."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in range(len(self.levels) - 1, -1, -1):
            words, bits = self.levels[level]
            answer = F.when(might_contain(words, bits, level, key), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", bits_per_key: int = BITS_PER_KEY, most_bits: int = MOST_BITS
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to ``pages``.

    rules: (host, path, verdict), verdict being allow or block; (host, path) is unique. A rule fits its
    host and all subdomains if the url's path starts with the rule's path; the longest fitting rule wins
    (host and path counted together). Where none fits, the url is in no list, and the verdict is ``default``.
    A null url, or one without ``://``, has an empty host and path. Columns of these names are replaced.
    Two cascades are built over all candidate keys of the table: of all rules, and of those that block. The rows
    are the same whether their levels are literals (up to ``most_bits``) or tables.
    """
    keyed = rules.select(F.concat("host", "path").alias("key"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n"), "verdict")
    # a rule list has few distinct label counts and path lengths, whatever its length
    label_counts, lengths = (sorted(r[0] for r in keyed.select(c).distinct().collect()) for c in ("labels", "n"))
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    candidates = candidate_keys(F.col("host"), F.col("path"), label_counts, lengths)
    universe = parsed.select(F.explode_outer(candidates).alias("c")).select(F.col("c.key").alias("key")).where("key IS NOT NULL").distinct().persist()
    listed = Cascade.build(keyed.select("key"), universe, bits_per_key, most_bits)
    blocked = Cascade.build(keyed.where("verdict = 'block'").select("key"), keyed.select("key"), bits_per_key, most_bits)
    if not (listed.tabled or blocked.tabled):
        universe.unpersist()
        fits = F.filter(candidates, lambda c: listed.contains(c["key"]))
        rule = F.try_element_at(fits, F.lit(1))["key"]
        verdict = F.when(rule.isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
        return parsed.withColumn("rule", rule).withColumn("verdict", verdict)
    known = listed.listed_among(universe)
    blocks = written(blocked.listed_among(keyed.select("key").distinct()).select(F.col("key").alias("rule"), F.lit("block").alias("verdict")), "blocks")
    places = parsed.select("host", "path").distinct()
    fits = places.select("host", "path", F.explode(candidates).alias("c")).select("host", "path", "c.n", "c.key").join(known, "key")
    best = fits.groupBy("host", "path").agg(F.max_by("key", "n").alias("rule"))
    judged = written(best.join(blocks, "rule", "left").select("host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")), "judged")
    universe.unpersist()
    found = parsed.drop("rule", "verdict").join(judged, ["host", "path"], "left")
    return found.select(*parsed.drop("rule", "verdict").columns, "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

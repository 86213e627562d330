"""SentencePiece encoding and decoding by a max-plus scan over chunks.

For a BPE vocabulary a token sequence is the encoding of its text exactly if every two neighbours, joined,
encode to themselves: merges within a range keep their order when the range is looked at alone, so a merge
across a boundary would show in the pair. Encoding is then a best path: tokens that match the text are
edges, an edge weighs 0 after a neighbour it is compatible with and minus infinity otherwise, and each
prefix of a text has exactly one path.

A giant text is cut into chunks of a fixed number of code points, whatever lies there. A chunk's transfer
matrix says, for every token that may lie across its start and every one that may lie across its end,
whether a path joins them (0 or minus infinity). The matrices are combined associatively in the max-plus
semiring, which fixes the token across each boundary; every chunk is then traced back on its own.
Within a chunk a path need only be sought up to a place that no piece crosses, such as the start of a word;
what stands between two such places is encoded once and kept in a bounded cache.

The ids are those of the sentencepiece library for the same model file.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import fresh, others
from .store import shared, written

SPACE = "▁"
#: Code points of a chunk, units in each of the two halves of a worker's cache, and pairs of tokens that it keeps.
CHUNK, CACHED, PAIRS = 16384, 100_000, 300_000
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
START = 0  # the state at a text's start

Matrix = dict[tuple[int, int], float]


def read_model(spark, path: str = MODEL) -> bytes:
    """The model file's bytes, read by Spark."""
    from pathlib import Path

    if "://" not in path:
        return Path(path).read_bytes()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


class Node(dict):
    """A place of the trie of pieces: the places after it by code point, and the id of the piece that ends here (or -1)."""

    __slots__ = ("id",)

    def __init__(self):
        self.id = -1


class Vocabulary:
    """Pieces of a SentencePiece BPE model; ids from ``size`` on stand for code points without a piece."""

    def __init__(self, model: bytes):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = p.get_piece_size()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}  # every prefix of a piece; -1 if it is none itself
        self.text: list[str] = [""] * self.size
        self.out: list[bytes] = [b""] * self.size
        self.byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for i in range(self.size):
            if p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                continue
            piece = p.id_to_piece(i)
            self.text[i], self.score[piece] = piece, p.get_score(i)
            self.out[i] = piece.replace(SPACE, " ").encode()
            for n in range(1, len(piece)):
                self.ids.setdefault(piece[:n], -1)
            self.ids[piece] = i
        for b, i in enumerate(self.byte_ids):
            self.out[i] = bytes([b])
        self.longest = max(map(len, self.score))
        self.wide = [len(x) for x in self.text]
        self.trie = Node()
        for piece in self.score:
            node = self.trie
            for c in piece:
                if c not in node:
                    node[c] = Node()
                node = node[c]
            node.id = self.ids[piece]
        # the next shorter token at the same place
        self.shorter = [self._longest(x[:-1], 0) if len(x) > 1 else -1 for x in self.text]
        if any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.score):
            raise ValueError("a piece holds a space after another character: words are no safe cuts")
        # control characters in no piece are safe cuts on both sides
        inside = {c for x in self.score for c in x}
        alone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in inside)
        self.units = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        if any(self._merge(x) != [x] for x, i in self.ids.items() if i >= 0):
            raise ValueError("a piece is not its own encoding")

    def _merge(self, s: str) -> list[str]:
        """Plain BPE of a short string: the best-scored, then leftmost, pair is merged until none is a piece."""
        parts = list(s)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a: kept in ``pairs`` by a * 2^32 + b."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known = a >= self.size or b >= self.size
        if not known:
            x, y = self.text[a], self.text[b]
            known = self._merge(x + y) == [x, y]
        self.pairs[a << 32 | b] = known
        return known

    def _longest(self, s: str, i: int) -> int:
        """The longest token that matches at s[i:]."""
        found, node = self.size + ord(s[i]), self.trie
        for c in s[i : i + self.longest]:
            node = node.get(c)
            if node is None:
                break
            if node.id >= 0:
                found = node.id
        return found

    def tokens_at(self, s: str, i: int) -> list[tuple[int, int]]:
        """(end, id) of every token that matches at s[i:]."""
        found, ids, j = [], self.ids.get, i + 1
        end = min(len(s), i + self.longest)
        while j <= end and (t := ids(s[i:j])) is not None:
            if t >= 0:
                found.append((j, t))
            j += 1
        return found if found and found[0][0] == i + 1 else [(i + 1, self.size + ord(s[i])), *found]

    def paths(self, s: str, start: int, before: int | None, stop: int) -> dict[int, tuple[int, int]]:
        """end -> (start, id) of the last token of the path from ``start``, after token ``before``, to each end
        that it can reach with tokens that begin before ``stop``."""
        last: dict[int, tuple[int, int]] = {}
        ids, pairs, longest, n = self.ids.get, self.pairs.get, self.longest + 1, len(s) + 1
        for i in range(start, stop):
            if i == start:
                prev = before
            elif i in last:
                prev = last[i][1]
            else:
                continue
            for j in range(i + 1, min(n, i + longest)):
                t = ids(s[i:j])
                if t is None or t < 0:
                    if j == i + 1:
                        t = self.size + ord(s[i])
                    elif t is None:
                        break
                    else:
                        continue
                if j not in last:
                    if prev is None:
                        last[j] = (i, t)
                    else:
                        known = pairs(prev << 32 | t)
                        if known or (known is None and self._follows(prev, t)):
                            last[j] = (i, t)
        return last

    def whole_path(self, s: str) -> list[int]:
        """The ids of the path through all of ``s``, which starts and ends at safe cuts: longest tokens first,
        going back where none may follow. A prefix has only one path, so a place where none goes on is dead."""
        n, size, pairs, wide, shorter = len(s), self.size, self.pairs.get, self.wide, self.shorter
        path: list[int] = []
        places: list[int] = []
        dead: set[int] = set()
        i, prev = 0, -1
        while True:
            t, node = size + ord(s[i]), self.trie  # as _longest()
            for c in s[i : i + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                if node.id >= 0:
                    t = node.id
            while True:
                while t >= 0:
                    j = i + (wide[t] if t < size else 1)
                    known = prev < 0 or pairs(prev << 32 | t)
                    if (known or (known is None and self._follows(prev, t))) and j not in dead:
                        break
                    t = shorter[t] if t < size else -1
                if t >= 0:
                    break
                # nothing may follow the last token: the next shorter one in its place
                dead.add(i)
                i, t = places.pop(), path.pop()
                prev = path[-1] if path else -1
                t = shorter[t] if t < size else -1
            path.append(t)
            if j == n:
                return path
            places.append(i)
            i, prev = j, t

    def width(self, t: int) -> int:
        """Code points of a token."""
        return len(self.text[t]) if t < self.size else 1

    @staticmethod
    def trace(last: dict[int, tuple[int, int]], start: int, end: int) -> list[int]:
        """The ids of the path from ``start`` to ``end``."""
        out = []
        while end > start:
            end, t = last[end]
            out.append(t)
        return out[::-1]

    def packed(self, tokens: list[int]) -> bytes:
        """int32 ids; a code point without a piece becomes the ids of its bytes."""
        if tokens and max(tokens) >= self.size:
            known = [[t] if t < self.size else [self.byte_ids[b] for b in chr(t - self.size).encode("utf-8", "surrogatepass")] for t in tokens]
            tokens = [i for ids in known for i in ids]
        return struct.pack(f"<{len(tokens)}i", *tokens)


class Units(dict):
    """Packed ids of units, made when first asked for. When it is full, the units of the last round are kept aside,
    and those that are asked for again move back: frequent units stay, others go."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.aside: dict[str, bytes] = {}

    def __missing__(self, unit: str) -> bytes:
        found = self.aside.get(unit)
        if found is None:
            v = self.vocabulary
            found = v.packed(v.whole_path(unit))
        if len(self) >= CACHED:
            self.aside = dict(self)
            self.clear()
        if len(unit) <= 64:
            self[unit] = found
        return found


def normalised(text: str) -> str:
    """Spaces as the vocabulary's mark, with one before the text; an empty text stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Chunk:
    """A chunk [lo, hi) of a normalised text, seen with up to ``longest`` code points around it."""

    def __init__(self, v: Vocabulary, units: Units, s: str, lo: int, hi: int, first: bool, final: bool):
        self.v, self.units, self.s, self.lo, self.hi, self.first, self.final = v, units, s, lo, hi, first, final

    def _cut(self, start: int) -> int | None:
        """The first safe cut of the chunk from ``start`` on. A unit begins at a safe cut, whatever place before it the units are
        looked for from; where the view begins is none."""
        at = max(start, self.lo)
        for m in self.v.units.finditer(self.s, max(at - 1, 0)):
            q = m.start()
            if q >= self.hi:
                return None
            if q >= at and (q > 0 or self.first):
                return q
        return None

    def _last_cut(self) -> int | None:
        """The last safe cut of the chunk, sought from its end."""
        reach = 256
        while True:
            begin, found = max(self.hi - reach, 0), None
            for m in self.v.units.finditer(self.s, begin):
                q = m.start()
                if q >= self.hi:
                    break
                if q > begin or (q == 0 and self.first):
                    found = q
            if found is not None and found >= self.lo:
                return found
            if begin < self.lo or begin == 0:
                return None
            reach *= 8

    def states(self, at: int) -> list[int]:
        """The tokens that may lie across boundary ``at`` (begin before it, end at it or after): how far they
        begin before it times 64, plus how far they end after it."""
        found = []
        for i in range(max(0, at - self.v.longest), at):
            found += [(at - i) * 64 + j - at for j, _ in self.v.tokens_at(self.s, i) if j >= at]
        return found

    def _token(self, at: int, state: int) -> tuple[int, int, int]:
        i, j = at - state // 64, at + state % 64
        return i, j, next(t for end, t in self.v.tokens_at(self.s, i) if end == j)

    def _exits(self, last: dict[int, tuple[int, int]]) -> list[int]:
        return [(self.hi - i) * 64 + j - self.hi for j, (i, _) in last.items() if i < self.hi <= j]

    def _entry(self, state: int) -> tuple[int, int | None]:
        if state == START:
            return self.lo, None
        _, end, token = self._token(self.lo, state)
        return end, token

    def matrix(self) -> Matrix:
        """(entry, exit) -> 0 for each pair of states that a path joins; all others are minus infinity."""
        out: Matrix = {}
        last = self._last_cut()
        tail = [] if last is None else self._exits(self.v.paths(self.s, last, None, self.hi))
        for state in [START] if self.first else self.states(self.lo):
            start, before = self._entry(state)
            cut = self._cut(start)
            if cut is None:  # no safe cut: a path through the whole chunk
                exits = self._exits(self.v.paths(self.s, start, before, self.hi))
                if start >= self.hi:  # the token reaches over the whole chunk
                    exits = [(self.hi - self.lo + state // 64) * 64 + start - self.hi]
            else:
                reached = cut == start or cut in self.v.paths(self.s, start, before, cut)
                exits = tail if reached else []
            for x in exits:
                out[state, x] = 0.0
        return out

    def encode(self, entry: int, leave: int) -> bytes:
        """The ids of the tokens that begin in the chunk, on the path from state ``entry`` to state ``leave``."""
        v, s = self.v, self.s
        start, before = self._entry(entry)
        if start >= self.hi:
            return b""
        i, end, token = self._token(self.hi, leave)
        cut, last = self._cut(start), self._last_cut()
        if cut is None:
            return v.packed([*v.trace(v.paths(s, start, before, i), start, i), token])
        head = v.packed(v.trace(v.paths(s, start, before, cut), start, cut)) if cut > start else b""
        middle = b"".join(map(self.units.__getitem__, v.units.findall(s, cut, last)))
        return head + middle + v.packed([*v.trace(v.paths(s, last, None, i), last, i), token])


def compose(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product of two transfer matrices; associative."""
    by_entry: dict[int, list[tuple[int, float]]] = {}
    for (entry, leave), w in b.items():
        by_entry.setdefault(entry, []).append((leave, w))
    out: Matrix = {}
    for (entry, mid), w in a.items():
        for leave, x in by_entry.get(mid, ()):
            if w + x > out.get((entry, leave), float("-inf")):
                out[entry, leave] = w + x
    return out


def boundary_states(matrices: list[Matrix]) -> list[tuple[int, int]]:
    """(entry, exit) of each chunk on the best path from START to the end, by a tree of products and a walk down it."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([compose(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    ends = [max((w, x) for (entry, x), w in levels[-1][0].items() if entry == START)]
    chosen = [(START, ends[0][1])]
    for row in reversed(levels[:-1]):
        below = []
        for k, (entry, leave) in enumerate(chosen):
            if 2 * k + 1 == len(row):
                below.append((entry, leave))
                continue
            left, right = row[2 * k], row[2 * k + 1]
            mid = max((w + right[m, leave], m) for (e, m), w in left.items() if e == entry and (m, leave) in right)[1]
            below += [(entry, mid), (mid, leave)]
        chosen = below
    return chosen


_worker: dict[str, tuple[Vocabulary, Units]] = {}


def vocabulary(model: bytes) -> tuple[Vocabulary, Units]:
    """One of each model for a Python worker."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _worker:
        v = Vocabulary(model)
        _worker[key] = (v, Units(v))
    return _worker[key]


def _lists(packed: list[bytes]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(docs: DataFrame, model: bytes, keep: list[str], text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The columns ``keep`` of each row of ``docs``, and ``ids`` (array<int>) of its whole text.

    Null and empty texts have no ids; a kept column named ids, in any case, is replaced. Texts of more than ``chunk`` code points are cut into chunks that are
    encoded apart, by whichever task reads them.
    """
    held = shared(docs.sparkSession, model)
    keep = others(keep, "ids")
    whole_text, row = fresh(keep, "_text", "_row")
    picked = docs.select(*keep, F.coalesce(text, F.lit("")).alias(whole_text))
    kept = docs.select(*keep).schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, units = vocabulary(held.value)
        for b in _blocks(batches):
            ids = [b"".join(map(units.__getitem__, v.units.findall(normalised(t)))) for t in b.column(whole_text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], _lists(ids)], [*keep, "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = vocabulary(held.value)
        for b in _blocks(batches, 1):
            s = normalised(b.column(whole_text)[0].as_py())
            n = -(-len(s) // chunk)
            for k in range(0, n, 64):
                at = [i * chunk for i in range(k, min(n, k + 64))]
                yield pa.record_batch({
                    "_row": pa.array([b.column("_row")[0].as_py()] * len(at), pa.int64()), "_chunk": pa.array(range(k, k + len(at)), pa.int32()),
                    "_chunks": pa.array([n] * len(at), pa.int32()), "_lo": pa.array([min(i, v.longest) for i in at], pa.int32()),
                    "_hi": pa.array([min(i, v.longest) + min(chunk, len(s) - i) for i in at], pa.int32()),
                    "_view": pa.array([s[max(0, i - v.longest) : i + chunk + v.longest] for i in at], pa.string()),
                })

    def seen(b: pa.RecordBatch) -> Iterator[Chunk]:
        v, units = vocabulary(held.value)
        for k, n, lo, hi, s in zip(*(b.column(c).to_pylist() for c in ("_chunk", "_chunks", "_lo", "_hi", "_view")), strict=True):
            yield Chunk(v, units, s, lo, hi, k == 0, k == n - 1)

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            edges = [np.array(sorted(c.matrix()), "<i4").reshape(-1).tobytes() for c in seen(b)]
            yield pa.record_batch({"_row": b.column("_row"), "_chunk": b.column("_chunk"), "edges": pa.array(edges, pa.binary())})

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("_chunk")
        edges = [np.frombuffer(x, "<i4").reshape(-1, 2).tolist() for x in table.column("edges").to_pylist()]
        states = boundary_states([{(a, z): 0.0 for a, z in e} for e in edges])
        return pa.table({"_row": table.column("_row"), "_chunk": table.column("_chunk"), "_entry": pa.array([s[0] for s in states], pa.int32()), "_leave": pa.array([s[1] for s in states], pa.int32())})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            ids = [c.encode(e, x) for c, e, x in zip(seen(b), b.column("_entry").to_pylist(), b.column("_leave").to_pylist(), strict=True)]
            yield pa.record_batch({"_row": b.column("_row"), "_chunk": b.column("_chunk"), "ids": _lists(ids)})

    out = "_row bigint, _chunk int, ids array<int>"
    short = picked.where(F.length(whole_text) < chunk).mapInArrow(whole, kept.add("ids", T.ArrayType(T.IntegerType())))
    # the giants' rows get numbers that are written down with their chunks
    giants = written(picked.where(F.length(whole_text) >= chunk).withColumn(row, F.monotonically_increasing_id()), "giants")
    views = written(giants.select(F.col(row).alias("_row"), whole_text).mapInArrow(cut, "_row bigint, _chunk int, _chunks int, _lo int, _hi int, _view string"), "chunks")
    states = views.mapInArrow(transfer, "_row bigint, _chunk int, edges binary").groupBy("_row").applyInArrow(combine, "_row bigint, _chunk int, _entry int, _leave int")
    parts = views.join(states, ["_row", "_chunk"]).mapInArrow(back, out)
    long = parts.groupBy("_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(giants.drop(whole_text).join(long.withColumnRenamed("_row", row), row).drop(row))


def decode(encoded: DataFrame, model: bytes, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` of each row, ``text`` decoded from ``ids`` (null counts as no ids), and n_tokens and
    ids_sha256 (of the ids as little-endian 32-bit integers); kept columns of these three names, in any case, are replaced.

    Byte pieces that do not form UTF-8 become U+FFFD, as does nothing that encode() has made.
    """
    held = shared(encoded.sparkSession, model)
    keep = others(keep, "text", "n_tokens", "ids_sha256")
    [given] = fresh(keep, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, _ = vocabulary(held.value)
        for b in _blocks(batches):
            lists = b.column(given)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values, np.int32)
            texts, digests = [], []
            for i, j in zip(at[:-1], at[1:], strict=True):
                raw = b"".join(map(v.out.__getitem__, flat[i:j].tolist()))
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
                digests.append(hashlib.sha256(flat[i:j].astype("<i4").tobytes()).hexdigest())
            columns = [*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(np.diff(at).astype(np.int64)), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "text", "n_tokens", "ids_sha256"])

    schema = encoded.select(*keep).schema.add("text", "string").add("n_tokens", "long").add("ids_sha256", "string")
    ready = encoded.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias(given))
    return ready.mapInArrow(run, schema)


def round_trip(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chars, n_tokens, ids_sha256, text_sha256, decoded_sha256, round_trip) of each row of ``docs``.

    round_trip is false only for texts that hold the vocabulary's own space mark U+2581, which decodes as a space.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select(
        F.col(doc_id).alias("doc_id"), whole.alias("text"), F.length(whole).cast("bigint").alias("n_chars"), F.sha2(whole.cast("binary"), 256).alias("text_sha256")
    )
    keep = ["doc_id", "n_chars", "text_sha256"]
    back = decode(encode(marked, model, keep, chunk=chunk), model, keep)
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return back.select(*keep, "n_tokens", "ids_sha256", digest.alias("decoded_sha256"), (digest == F.col("text_sha256")).alias("round_trip"))

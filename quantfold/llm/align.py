"""Alignment of the tokens of two tokenizers over the same bytes, by galloping intersection of token ends.

Both tokenizers encode every text (A: space + text, byte-level BPE; B: the text, a piece model that puts the space
there itself), and each list of tokens becomes an ascending list of byte offsets where they end.

1. Per text the shorter list drives: each of its ends starts at the place found for an earlier end and searches the
   longer list in steps of 1, 2, 4, …, then halves the last step.  numpy does that for many ends
   at once: every 32nd end first (recursively), the ends between them from there.
2. The search gives each end's rank in the longer list and whether it is there.  Common ends cut both
   lists into groups.  Rank differences of neighbouring ends give the range of tokens that a token overlaps: the links.
3. Spark counts in how many documents each pair of ids is linked, and weighs the links of every document by that.

Encoding: where a single space stands between characters that aren't white space, both tokenizers cut (A by its
pre-token pattern; B if no piece holds a space behind another character, which is checked), so distinct stretches
between such spaces are encoded once per worker and texts are put together with numpy.  Texts with unusual white space,
and those whose tokens don't spell them, are encoded whole.

Scale: a text meets one task; its distinct pairs are written once, with their multiplicity.  Counts of pairs are
bounded by the vocabularies; up to ``BROADCAST_ROWS`` they are broadcast, beyond it only those of the most
frequent pairs, and the others, none of which is hot, are joined in a shuffle.

Defined cases: a null or empty text, and one whose tokens of A or B don't spell space + text, has no tokens:
zeros and an empty digest; rows are judged one by one, and repeated rows count as documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import large, merged, ragged_take, stored, tidy
from .tokens import by_rank, byte_of_character

SLICE = 1 << 20
#: Stretches that a worker remembers; stretches that are encoded in one call.
MEMORY, TOGETHER = 300_000, 2000
#: Every so many ends are searched first.
STRIDE = 32
#: Rows of (pair, count) up to which they are broadcast (17 bytes each).
BROADCAST_ROWS = 4_000_000
#: Characters that a text may hold only if it is encoded whole: control characters, white space beyond ASCII, U+2581.
UNUSUAL = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{A0}\\x{1680}\\x{180E}\\x{2000}-\\x{200F}\\x{2028}-\\x{202F}\\x{205F}-\\x{2060}\\x{2581}\\x{3000}\\x{FEFF}]"

# Fixed value: the pre-token pattern of byte-level files.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters up to here are of the same kind in every library.
LATIN = "\u024f"

_LOADED: dict[tuple, TwoEncoders] = {}


class ByteLevel:
    """Tokenizer A with the bytes of its entries."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cut = said.get("pre_tokenizer") or {}
        self.cuts_at_spaces = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        of, vocab = byte_of_character(), self.model.get_vocab()
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        self.by_rank = by_rank(said, PRE_TOKEN) if self.cuts_at_spaces else None

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with its space."""
        if self.by_rank is not None and max(text) <= LATIN:
            return np.array(self.by_rank.encode_ordinary(text), np.int64)
        return np.array(self.model.encode(text, add_special_tokens=False).ids, np.int64)


class PieceModel:
    """Tokenizer B with the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.cuts_at_spaces = not any(b" " in p.lstrip(b" ") for p in self.pieces)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text that begins with its space, which the model puts there itself."""
        return np.array(self.model.encode(text[1:], num_threads=1), np.int64)


class Side:
    """The remembered ids of one tokenizer: stretch k has ``ids[start[k] : start[k] + size[k]]``."""

    def __init__(self, coder: ByteLevel | PieceModel):
        self.coder = coder
        self.length = np.array([len(p) for p in coder.pieces], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(coder.pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.ids, self.size, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def spell(self, ids: np.ndarray) -> bytes:
        return ragged_take(self.begin[ids], self.length[ids], self.bytes).tobytes()

    def learn(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.ids = np.concatenate([self.ids, *ids])
        self.size = np.concatenate([self.size, *sizes])
        self.start = np.cumsum(self.size) - self.size


class TwoEncoders:
    """Tokens of many texts by both tokenizers."""

    def __init__(self, a_path: str, b_path: str):
        self.sides = Side(ByteLevel(a_path)), Side(PieceModel(b_path))
        self.by_stretch = all(s.coder.cuts_at_spaces for s in self.sides)
        self.known: dict[str, int] = {}

    def _learn(self, new: list[str]) -> None:
        """Encode stretches, many plain ones (one space, then no white space at the ends) in one call."""
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        got: tuple[list, list] = ([], [])
        sizes: tuple[list, list] = ([], [])

        def together(group: list[str]) -> None:
            text = "".join(group)
            raw, ends = text.encode(), np.cumsum([len(s.encode()) for s in group])
            for k, side in enumerate(self.sides):
                ids = side.coder.encode(text)
                at = np.cumsum(side.length[ids])
                place = np.searchsorted(at, ends)
                if side.spell(ids) == raw and np.array_equal(at[np.minimum(place, len(at) - 1)], ends):
                    got[k].append(ids)
                    sizes[k].append(np.diff(place + 1, prepend=0))
                elif len(group) > 1:
                    parts = [side.coder.encode(s) for s in group]
                    got[k].extend(parts)
                    sizes[k].append(np.array([len(p) for p in parts]))
                else:
                    got[k].append(ids)
                    sizes[k].append(np.array([len(ids)]))

        group: list[str] = []
        for s in new:
            plain = s[1:2].strip() and s[-1].strip()
            if group and (not plain or len(group) == TOGETHER):
                together(group)
                group = []
            if plain:
                group.append(s)
            else:
                together([s])
        if group:
            together(group)
        for side, ids, size in zip(self.sides, got, sizes):
            side.learn(ids, size)

    def _stretches(self, spaced: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(offsets, number)`` of the stretches of texts that begin with their space."""
        offsets = spaced.buffers()[1]
        offsets = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        byte = np.frombuffer(spaced.buffers()[2], np.uint8)[: offsets[-1]]
        white = (byte == 32) | ((byte >= 9) & (byte <= 13))
        cut = byte == 32
        cut[1:] &= ~white[:-1]
        cut[:-1] &= ~white[1:]
        cut[-1:] = False
        last = offsets[1:] - 1  # a space at the end of a text belongs to the stretch before it
        cut[last] = False
        cut[offsets[:-1]] = True
        begin = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, offsets[-1]).astype(np.int64)), spaced.buffers()[2])
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > MEMORY:
            self.known = {}
            for side in self.sides:
                side.forget()
        new = [s for s in distinct if s not in self.known]
        if new:
            self._learn(new)
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        return np.searchsorted(begin, offsets), number[coded.indices.to_numpy()]

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """``(texts, (offsets, ids) of A, (offsets, ids) of B)`` of the texts (numbers, in any order) that both tokenizers spell."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        full = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        usual = full & ~pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False) if self.by_stretch else np.zeros(len(texts), bool)
        chosen, sizes, ids = np.flatnonzero(usual), [[], []], [[], []]
        if len(chosen):
            some = large(spaced.take(pa.array(chosen)))
            offsets, number = self._stretches(some)
            extent = np.diff(np.frombuffer(some.buffers()[1], np.int64)[: len(some) + 1])
            own = [(ragged_take(s.start[number], s.size[number], s.ids), np.concatenate([[0], np.cumsum(s.size[number])])[offsets]) for s in self.sides]
            right = np.ones(len(chosen), bool)
            for s, (got, at) in zip(self.sides, own):
                # Same bytes as the texts: same total per text, and the same bytes one by one.
                total = np.diff(np.concatenate([[0], np.cumsum(s.length[got])])[at])
                right &= total == extent
            buffer = np.frombuffer(some.buffers()[2], np.uint8)
            starts = np.frombuffer(some.buffers()[1], np.int64)[: len(some)]
            if right.any():
                at_text = np.concatenate([[0], np.cumsum(np.where(right, extent, 0))])
                want = ragged_take(starts[right], extent[right], buffer)
                for s, (got, at) in zip(self.sides, own):
                    mine = got[np.repeat(right, np.diff(at))]
                    wrong = np.flatnonzero(ragged_take(s.begin[mine], s.length[mine], s.bytes) != want)
                    right[np.searchsorted(at_text, wrong, "right") - 1] = False
            for k, (got, at) in enumerate(own):
                ids[k].append(got[np.repeat(right, np.diff(at))])
                sizes[k].append(np.diff(at)[right])
            usual[chosen[~right]] = False
            chosen = chosen[right]
        whole = []
        for i in np.flatnonzero(full & ~usual).tolist():
            text = spaced[i].as_py()
            got = [s.coder.encode(text) for s in self.sides]
            if all(s.spell(g) == text.encode() for s, g in zip(self.sides, got)):
                whole.append(i)
                for k in (0, 1):
                    ids[k].append(got[k])
                    sizes[k].append(np.array([len(got[k])]))
        out = []
        for k in (0, 1):
            n = np.concatenate([np.zeros(0, np.int64), *sizes[k]]).astype(np.int64)
            out.append((np.concatenate([[0], np.cumsum(n)]), np.concatenate([np.zeros(0, np.int64), *ids[k]])))
        return np.append(chosen, np.array(whole, np.int64)), *out


def encoders(a_path: str, b_path: str) -> TwoEncoders:
    """The worker's encoders, loaded once per Python worker."""
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = TwoEncoders(a_path, b_path)
    return _LOADED[a_path, b_path]


def gallop(keys: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray) -> np.ndarray:
    """First place from ``start`` (all before it is smaller) with a value >= key, or ``stop``."""
    low, high, step, todo = start.copy(), stop.copy(), 1, np.arange(len(keys))
    while len(todo):  # exponential: all before ``low`` is smaller than the key
        at = low[todo] + step - 1
        inside = at < stop[todo]
        smaller = inside & (values[np.minimum(at, len(values) - 1)] < keys[todo])
        high[todo[inside & ~smaller]] = at[inside & ~smaller]
        todo = todo[smaller]
        low[todo] += step
        step *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):  # binary
        mid = (low[todo] + high[todo]) // 2
        smaller = values[mid] < keys[todo]
        low[todo[smaller]] = mid[smaller] + 1
        high[todo[~smaller]] = mid[~smaller]
        todo = todo[low[todo] < high[todo]]
    return low


def ranks(keys: np.ndarray, doc: np.ndarray, nth: np.ndarray, values: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Place of every key (``nth`` of its document) among the values ``begin[doc] : stop[doc]`` of its document; both ascend."""
    if not len(keys):
        return np.zeros(0, np.int64)
    head = nth % STRIDE == 0
    if head.all() or not (nth >= STRIDE).any():
        start = begin[doc]
    else:
        start = ranks(keys[head], doc[head], nth[head] // STRIDE, values, begin, stop)[np.cumsum(head) - 1]
    return gallop(keys, start, stop[doc], values)


class Alignment:
    """Groups and links of many texts, as places in the token arrays of A and B.

    ``a_cut``, ``b_cut``: places of the tokens that end at common ends; ``link_a``, ``link_b``: the links."""

    def __init__(self, a_offsets: np.ndarray, a_ends: np.ndarray, b_offsets: np.ndarray, b_ends: np.ndarray):
        n = len(a_offsets) - 1
        a_size, b_size = np.diff(a_offsets), np.diff(b_offsets)
        cuts, links = [], []
        for swap, mine in ((False, a_size <= b_size), (True, a_size > b_size)):  # the shorter list drives
            (size, offsets, ends), (_, long_offsets, long_ends) = [(a_size, a_offsets, a_ends), (b_size, b_offsets, b_ends)][:: -1 if swap else 1]
            doc = np.repeat(np.arange(n), np.where(mine, size, 0))
            first = offsets[:-1][doc]
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(np.where(mine, size, 0)) - np.where(mine, size, 0), np.where(mine, size, 0))
            token = first + nth
            key = ends[token]
            rank = ranks(key, doc, nth, long_ends, long_offsets[:-1], long_offsets[1:])
            hit = long_ends[np.minimum(rank, max(len(long_ends) - 1, 0))] == key if len(key) else np.zeros(0, bool)
            # A token reaches from behind the tokens that end by its start to the one that holds its last byte.
            low = np.where(nth > 0, np.append(0, rank[:-1] + hit[:-1]) if len(rank) else rank, long_offsets[:-1][doc])
            count = rank - low + 1
            one = np.repeat(token, count)
            other = np.arange(len(one)) + np.repeat(low - (np.cumsum(count) - count), count)
            pairs, common = (one, other), (token[hit], rank[hit])
            cuts.append(common[:: -1 if swap else 1])
            links.append(pairs[:: -1 if swap else 1])
        self.a_cut, self.b_cut = (np.sort(np.concatenate(x)) for x in zip(*cuts))
        self.link_a, self.link_b = (np.concatenate(x) for x in zip(*links))


class Digits:
    """Decimal ids with a separator behind them, as bytes."""

    MARKS = (b",", b"|", b";", b"")

    def __init__(self, n: int):
        texts = [str(i).encode() + m for m in self.MARKS for i in range(n)]
        self.n, self.length = n, np.array([len(t) for t in texts], np.int64)
        self.begin, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(texts), np.uint8)

    def joined(self, ids: np.ndarray, mark: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        at = mark * self.n + ids
        text = ragged_take(self.begin[at], self.length[at], self.bytes)
        ends = np.concatenate([[0], np.cumsum(self.length[at])])[offsets]
        view = memoryview(text)
        return [view[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def group_texts(digits: Digits, al: Alignment, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[memoryview]:
    """``a1,a2|b1;a3|b2,b3`` of every text."""
    (a_offsets, a_ids), (b_offsets, b_ids) = a, b
    a_group = np.searchsorted(al.a_cut, np.arange(len(a_ids)))
    b_group = np.searchsorted(al.b_cut, np.arange(len(b_ids)))
    ids, mark = np.empty(len(a_ids) + len(b_ids), np.int64), np.zeros(len(a_ids) + len(b_ids), np.int64)
    a_at = np.arange(len(a_ids)) + np.append(0, al.b_cut + 1)[a_group]  # behind the tokens of B of the groups before
    b_at = np.arange(len(b_ids)) + (al.a_cut + 1)[b_group]
    ids[a_at], ids[b_at] = a_ids, b_ids
    mark[a_at[al.a_cut]], mark[b_at[al.b_cut]] = 1, 2
    mark[b_at[b_offsets[1:] - 1]] = 3
    return digits.joined(ids, mark, a_offsets + b_offsets)


SCHEMA = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
GROUPS = ", a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str, groups: bool = False) -> DataFrame:
    """``SCHEMA``: one row a document.  ``pairs`` are its distinct linked ids, ``id of A * vocabulary of B + id of B``, ascending, and
    ``times`` how often each is linked; ``row`` names the row.  With ``groups`` also the ids of both and the tokens of A and B in each group."""

    schema = SCHEMA + (GROUPS if groups else "")

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, row = encoders(a_path, b_path), TaskContext.get().partitionId() << 33
        (a_side, b_side), n_b = two.sides, len(two.sides[1].coder.pieces)
        digits = Digits(max(len(s.coder.pieces) for s in two.sides))
        for t in merged(batches, "text", SLICE):
            n = len(t)
            which, a, b = two.tokens(large(t["text"]))
            al = Alignment(a[0], np.cumsum(a_side.length[a[1]]), b[0], np.cumsum(b_side.length[b[1]]))
            doc = np.searchsorted(a[0], al.link_a, "right") - 1
            key = np.sort((which[doc] << 44) | (a[1][al.link_a] * n_b + b[1][al.link_b]))
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(key)))
            distinct = key[first]
            pair_offsets = np.searchsorted(distinct >> 44, np.arange(n + 1))
            out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups")}
            out["n_a"][which], out["n_b"][which] = np.diff(a[0]), np.diff(b[0])
            cut = np.searchsorted(al.a_cut, a[0])
            out["n_groups"][which] = np.diff(cut)
            sha = [""] * n
            if len(which):
                for i, text in zip(which.tolist(), group_texts(digits, al, a, b)):
                    sha[i] = hashlib.sha256(text).hexdigest()
            columns = [
                pa.array(np.arange(row, row + n)), t["doc_id"].combine_chunks(), *[pa.array(x) for x in out.values()],
                pa.array(np.bincount(which[doc], minlength=n).astype(np.int64)), pa.array(sha, pa.string()),
                lists(pair_offsets, distinct & (1 << 44) - 1, pa.int64()), lists(pair_offsets, times, pa.int32())]
            if groups:
                order = np.argsort(which, kind="stable")
                for offsets, values in (a, b, (cut, np.diff(al.a_cut, prepend=-1)), (cut, np.diff(al.b_cut, prepend=-1))):
                    size = np.zeros(n, np.int64)
                    size[which] = np.diff(offsets)
                    columns.append(lists(np.concatenate([[0], np.cumsum(size)]), ragged_take(offsets[:-1][order], np.diff(offsets)[order], values), pa.int32()))
            whole = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])
            for at in range(0, n, 1000):
                yield whole.slice(at, 1000)
            row += n

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInArrow(tidy(run), schema)


def pair_counts(rows: DataFrame, vocabulary_b: int) -> DataFrame:
    """``pair, n, best``: in how many documents each pair is linked, and whether no pair of its id of A is in more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {vocabulary_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row per id of A
    return stored(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def weighed(rows: DataFrame, counts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``row, n_best, count_sum`` of rows that have links."""
    links = rows.select("row", F.arrays_zip("pairs", "times").alias("z")).select("row", F.explode("z").alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    if counts.count() <= broadcast_rows:
        known = links.join(F.broadcast(counts), "pair")
    else:  # the most frequent pairs are broadcast; no other pair is hot
        scale = F.floor(F.log2("n")).cast("int")
        sizes = {r["s"]: r["c"] for r in counts.groupBy(scale.alias("s")).agg(F.count("*").alias("c")).collect()}  # at most 64 rows
        floor, room = max(sizes) + 1, broadcast_rows
        for s in sorted(sizes, reverse=True):
            room -= sizes[s]
            if room < 0:
                break
            floor = s
        rest = links.join(F.broadcast(counts.where(scale >= floor)), "pair", "left")
        rare = rest.where(F.col("n").isNull()).select("row", "pair", "times").join(counts.where(scale < floor).hint("shuffle_hash"), "pair")
        known = rest.where(F.col("n").isNotNull()).unionByName(rare)
    times = F.col("times").cast("long")
    return known.groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))


def alignment_query(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Counts, weights and a digest of the groups of every document."""
    import sentencepiece

    rows = stored(aligned(docs, a_path, b_path), "aligned")
    counts = pair_counts(rows, sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size())
    weights = weighed(rows, counts, broadcast_rows)
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(weights, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The new words of a part of a partition lie in flat arrays of symbols, cut wherever no piece of the vocabulary could
reach across. In each round every segment takes the best rank among its pairs (a segmented minimum), merges that pair's
leftmost places at once, and the arrays are compacted; segments without a pair that makes a piece are taken out. The
rounds end when none is left. A round stops a segment's merges behind the first one that would make a pair of the same
or a better rank, as the library's queue would take that one next: so the result is the library's, ties included.

The vocabulary is a BPE model file of the sentencepiece library with byte fallback and no normalisation map; its path
is a parameter. Other kinds of model are refused. A worker keeps the words that it has met in two bounded generations.

Defined results: null text is empty text; empty text has the begin and the end id only and decodes to empty text.
Characters without a piece become their UTF-8 bytes. U+2581 in a text counts as a space, as in the library. Every
repeated row is encoded. Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, column, held_by_worker, numbered, pieces, span_hashes, table

#: Words of one generation that a worker remembers, and the longest of them in characters.
WORDS_KEPT = 200_000
LONGEST_KEPT = 48
#: Text bytes whose new words are merged together; a longer document is taken alone and whole.
PART_BYTES = 1 << 21
#: Fixed values of the library: the space's symbol, kinds of model and piece, what an unknown piece decodes to.
SPACE = "▁"
BPE_MODEL = 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CHARS = 0x110000
NO_RANK = np.iinfo(np.int32).max

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Pairs:
    """Finds the number of a pair of symbols in a hash table; -1 for pairs that aren't there."""

    def __init__(self, left: np.ndarray, right: np.ndarray, width: int):
        self.width = width
        self.keys = np.append(left.astype(np.int64) * width + right, -1)
        self.bits = max(8, int(4 * len(left)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        home, open_, self.probes = self._home(self.keys[:-1]), np.arange(len(left)), 0
        while len(open_):
            at = (home[open_] + self.probes) & (len(self.slots) - 1)
            free = np.flatnonzero(self.slots[at] < 0)
            where, first = np.unique(at[free], return_index=True)
            self.slots[where] = open_[free[first]]
            open_ = np.delete(open_, free[first])
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        home = self._home(keys)
        out = self.slots[home]
        wrong = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        out[wrong] = -1
        for step in range(1, self.probes):
            if not len(wrong):
                break
            found = self.slots[(home[wrong] + step) & (len(self.slots) - 1)]
            good = self.keys[found] == keys[wrong]
            out[wrong[good]] = found[good]
            wrong = wrong[~good & (found >= 0)]
        return out


class Codec:
    """Pieces, the pairs that make them, and the words met so far."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = np.array([p.type for p in spec.pieces])
        rules = spec.normalizer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if spec.trainer_spec.model_type != BPE_MODEL or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or not plain or not np.isin(kinds, (NORMAL, UNKNOWN, CONTROL, BYTE)).all():
            raise ValueError("only BPE models with byte fallback, a space before each text and no normalisation are supported")
        names = [p.piece for p in spec.pieces]
        normal = {name: i for i, name in enumerate(names) if kinds[i] == NORMAL}
        byte = {name: i for i, name in enumerate(names) if kinds[i] == BYTE}
        self.size = len(names)
        self.begin, self.end = names.index(spec.trainer_spec.bos_piece), names.index(spec.trainer_spec.eos_piece)
        self.bytes = np.array([byte[f"<0x{b:02X}>"] for b in range(256)], np.int32)
        # a character that is no piece stands as a symbol behind the pieces
        self.symbol = np.arange(self.size, self.size + CHARS, dtype=np.int32)
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        self._pairs(names, normal, np.array([p.score for p in spec.pieces]))
        self._surfaces(names, kinds, spec.trainer_spec.unk_surface)
        # where every text may be cut before a space, and where long runs of spaces may
        self.at_spaces = not any(SPACE in name.lstrip(SPACE) for name in normal)
        self.block = 0
        self.block = self._space_block(normal)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _pairs(self, names: list[str], normal: dict[str, int], scores: np.ndarray) -> None:
        """Each way to make a piece of two symbols: rank (the same for equal scores) and what is made; and the
        characters that stand side by side in a piece."""
        ranks = np.unique(-scores, return_inverse=True)[1]
        symbol = lambda s: normal.get(s, self.size + ord(s) if len(s) == 1 else None)
        found, beside = [], set()
        for name, made in normal.items():
            for k in range(1, len(name)):
                beside.add((ord(name[k - 1]), ord(name[k])))
                a, b = symbol(name[:k]), symbol(name[k:])
                if a is not None and b is not None:
                    found.append((a, b, made))
        left, right, made = np.array(found, np.int32).reshape(-1, 3).T
        self.pairs = Pairs(left, right, self.size + CHARS)
        self.made, self.rank = made.copy(), np.append(ranks[made], NO_RANK).astype(np.int32)  # rank[-1]: of no pair
        self.beside = Pairs(*np.array(sorted(beside), np.int64).reshape(-1, 2).T, CHARS)

    def _surfaces(self, names: list[str], kinds: np.ndarray, unknown: str) -> None:
        """What each id decodes to, as bytes, one behind the other."""
        shown = {CONTROL: lambda n: b"", UNKNOWN: lambda n: unknown.encode(), BYTE: lambda n: bytes([int(n[1:-1], 16)]), NORMAL: lambda n: n.replace(SPACE, " ").encode()}
        raw = [shown[kind](name) for kind, name in zip(kinds.tolist(), names, strict=True)]
        self.surface = np.frombuffer(b"".join(raw), np.uint8)
        self.long = np.array([len(r) for r in raw])
        self.first = np.cumsum(self.long) - self.long
        self.control = kinds == CONTROL
        self.spaced = np.array([kind == NORMAL and name.startswith(SPACE) for kind, name in zip(kinds.tolist(), names, strict=True)])

    def _space_block(self, normal: dict[str, int]) -> int:
        """Length of the longest piece of spaces, if a run of spaces is cut into such pieces from its left whatever
        follows: all pieces of spaces have one score, the worst, and no other piece has a space behind its first place."""
        runs = [name for name in normal if len(name) > 1 and not name.strip(SPACE)]
        if not runs or not self.at_spaces or any(name.startswith(SPACE * 2) and name.strip(SPACE) for name in normal):
            return 0
        ranks = {int(self.rank[:-1][self.made == normal[name]][0]) for name in runs if (self.made == normal[name]).any()}
        if ranks != {int(self.rank[:-1].max())}:
            return 0
        block, tried = max(map(len, runs)), [b" " * n for n in range(1, 3 * max(map(len, runs)) + 1)]
        ids, counts = self.merge(tried)
        each = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        whole = [normal[SPACE * block]]
        return block if all(x == whole * (n // block) + (each[n % block - 1] if n % block else []) for n, x in enumerate(each, 1)) else 0

    def _cuts(self, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether a segment begins at each character."""
        cut = np.ones(len(code), bool)
        cut[1:] = self.beside.find(code[:-1], code[1:]) < 0
        cut[np.cumsum(sizes)[:-1]] = True
        if self.block:
            space = code == ord(SPACE)
            place = np.arange(len(code))
            begins = space & (cut | np.append(True, ~space[:-1]))
            begins[np.cumsum(sizes)[:-1]] |= space[np.cumsum(sizes)[:-1]]
            run = np.maximum.accumulate(np.where(begins, place, -1))
            cut |= space & ((place - run) % self.block == 0)
        return cut

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one behind the other, and how many each word has."""
        raw = b"".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        sizes = np.diff(np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))[ends], prepend=0)
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.int32).copy()
        code[code == ord(" ")] = ord(SPACE)
        word = np.repeat(np.arange(len(words)), sizes)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        starts = np.flatnonzero(self._cuts(code, sizes))
        sizes = np.diff(starts, append=len(code))
        symbol, place = self.symbol[code], np.arange(len(code))
        last = np.zeros(len(code), bool)
        last[starts - 1] = True  # the one before the first segment is the last of all
        pair = np.where(last, -1, self.pairs.find(symbol, np.roll(symbol, -1)))
        rank = self.rank[pair]
        ended, stands = np.zeros(len(code), np.int32), np.zeros(len(code), bool)
        while True:
            low = np.minimum.reduceat(rank, starts)
            if (done := low == NO_RANK).any():
                out = np.repeat(done, sizes)
                ended[place[out]] = symbol[out]
                stands[place[out]] = True
                symbol, place, last, pair, rank = (x[~out] for x in (symbol, place, last, pair, rank))
                sizes, low = sizes[~done], low[~done]
                starts = np.cumsum(sizes) - sizes
            if not len(symbol):
                break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            n = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, n, 0))
            hit = hit[(n - run) % 2 == 0]
            made = self.made[pair[hit]]
            segment = np.searchsorted(starts, hit, "right") - 1
            several = np.flatnonzero(np.bincount(segment, minlength=len(starts))[segment] > 1)
            if len(several) and len(late := several[self._late(symbol, last, low, starts, hit[several], made[several], segment[several])]):
                hit, made, segment = (np.delete(x, late) for x in (hit, made, segment))
            symbol[hit] = made
            last[hit] = last[hit + 1]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, place, last, pair, rank = (x[keep] for x in (symbol, place, last, pair, rank))
            sizes = sizes - np.bincount(segment, minlength=len(starts))
            starts = np.cumsum(sizes) - sizes
            hit -= np.arange(len(hit))
            changed = np.concatenate((hit, hit[hit > 0] - 1))
            new = np.where(last[changed], -1, self.pairs.find(symbol[changed], symbol[np.minimum(changed + 1, len(symbol) - 1)]))
            pair[changed], rank[changed] = new, self.rank[new]
        ids = ended[stands]
        return self._as_bytes(ids, word[stands], len(words))

    def _late(self, symbol: np.ndarray, last: np.ndarray, low: np.ndarray, starts: np.ndarray, hit: np.ndarray, made: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places behind one of the same segment whose merge makes a pair that comes before them."""
        beside = np.flatnonzero((np.diff(hit) == 2) & (np.diff(segment) == 0)) + 1
        left = symbol[hit - 1]
        left[beside] = made[beside - 1]
        before = self.rank[self.pairs.find(left, made)]
        before[hit == starts[segment]] = NO_RANK
        after = self.rank[self.pairs.find(made, symbol[np.minimum(hit + 2, len(symbol) - 1)])]
        after[last[hit + 1]] = NO_RANK
        sooner = np.minimum(before, after) <= low[segment]
        total = np.cumsum(sooner) - sooner
        heads = np.maximum.accumulate(np.where(np.diff(segment, prepend=-1) != 0, np.arange(len(hit)), 0))
        return total > total[heads]

    def _as_bytes(self, ids: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as their bytes; then ids for each word."""
        if len(lost := np.flatnonzero(ids >= self.size)):
            raw = [chr(c).encode() for c in (ids[lost] - self.size).tolist()]
            times = np.ones(len(ids), np.int64)
            times[lost] = [len(r) for r in raw]
            word, wide, ids = np.repeat(word, times), np.repeat(ids >= self.size, times), np.repeat(ids, times)
            ids[wide] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, np.bincount(word, minlength=n)

    def _spans(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the words, each with the spaces before it, of texts that start with a space."""
        begins = np.zeros(len(raw) + 1, bool)
        if self.at_spaces:
            begins[1:-1] = (raw[1:] == ord(" ")) & (raw[:-1] != ord(" "))
        begins[at] = True
        starts = np.flatnonzero(begins[:-1])
        return starts, np.append(starts[1:], len(raw))

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit integers; words that weren't met before are merged together."""
        if len(self.young) > WORDS_KEPT:
            self.old, self.young = self.young, {}
        known = self.young
        out = list(map(known.get, words))
        absent = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in absent:
            x = self.old.get(words[i])
            if x is None:
                new.append(i)
            else:
                known[words[i]] = out[i] = x
        ids, counts = self.merge([words[i] for i in new])
        raw, end = ids.astype("<u4").tobytes(), 0
        for i, n in zip(new, (4 * counts).tolist(), strict=True):
            out[i] = raw[end : end + n]
            end += n
            if len(words[i]) <= LONGEST_KEPT:
                known[words[i]] = out[i]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, begin and end included, one text behind the other, and how many each text has."""
        texts = pc.replace_substring(texts, SPACE, " ")
        texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
        raw, at = buffers(texts)
        starts, ends = self._spans(raw, at)
        number = numbered(raw, starts, ends, span_hashes(raw, starts, ends))
        some = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        some[number] = np.arange(len(number))
        data = raw.tobytes()
        made = self._known([data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(made), "<u4")
        count = np.fromiter(map(len, made), np.int64, len(made)) // 4
        n, first = count[number], (np.cumsum(count) - count)[number]
        total = np.append(0, np.cumsum(n))
        ids = flat[np.arange(total[-1]) + np.repeat(first - total[:-1], n)]
        cuts = total[np.searchsorted(starts, at)]
        sizes = np.diff(cuts) + 2
        out = np.empty(len(ids) + 2 * len(sizes), np.int32)
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(sizes)) + 1, sizes - 2)] = ids
        last = np.cumsum(sizes)
        out[last - sizes], out[last - 1] = self.begin, self.end
        return out, sizes

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each sequence of ids: the pieces' surfaces, without the space that was put first."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        seen = np.flatnonzero(~self.control[ids])
        first = seen[np.diff(text[seen], prepend=-1) != 0]
        n, start = self.long[ids], self.first[ids]
        lead = first[self.spaced[ids[first]]]
        n[lead] -= 1
        start[lead] += 1
        before = np.append(0, np.cumsum(n))
        raw = self.surface[np.arange(before[-1]) + np.repeat(start - before[:-1], n)].tobytes()
        ends = before[np.cumsum(sizes)].tolist()
        return [raw[a:b].decode("utf-8", "each_byte") for a, b in zip([0, *ends], ends, strict=False)]


def codec(path: str) -> Codec:
    """The worker's codec, which the tasks that it runs one after the other share."""
    return held_by_worker(("pieces", path), lambda: Codec(path))


def _mapped(docs: DataFrame, text: str, keep: tuple[str, ...], added: dict[str, str], made: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """The kept columns and those that made() gives for the texts of a part."""
    spare = next(f"__{i}" for i in range(len(keep) + 1) if f"__{i}" not in keep)
    rows = docs.select(*(docs[f"`{c}`"] for c in keep), F.coalesce(docs[f"`{text}`"], F.lit("")).alias(spare))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != spare), *(f"{c} {kind}" for c, kind in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, spare, PART_BYTES):
                yield pa.RecordBatch.from_arrays([*(column(part, k) for k in keep), *made(column(part, spare))], [*keep, *added])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids (begin and end included) and decoded."""

    def made(texts: pa.Array) -> list[pa.Array]:
        ids, sizes = codec(path).encode(texts)
        listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
        return [pa.array(sizes, pa.int64()), listed, pa.array(codec(path).decode(ids, sizes), pa.string())]

    return _mapped(docs, text, keep, {"n_tokens": "long", "ids": "array<int>", "decoded": "string"}, made)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() with the ids and the decoded text as SHA-256, worked out where the texts are so that they never leave
    the task."""

    def made(texts: pa.Array) -> list[pa.Array]:
        ids, sizes = codec(path).encode(texts)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        sha = lambda raws: pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())
        return [pa.array(sizes, pa.int64()), sha(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), sha(x.encode() for x in codec(path).decode(ids, sizes))]

    return _mapped(docs, "text", ("doc_id",), {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, made)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())

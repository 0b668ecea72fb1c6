"""BPE encoding and decoding with a pair occurrence index.

The distinct new words of a part of a partition are laid out as linked symbols. An index maps each mergeable pair to
all its positions. Ranks that occur are applied in ascending order, each to all its positions, and the lists of the
neighbouring pairs follow. A worker keeps the words that it has met in two bounded generations: words in use move to the
young one, and when that is full, the old one is dropped. So a frequent word is worked out once, and memory is bounded.

The vocabulary is a file of the tokenizers library's JSON form with word ends (``end_of_word_suffix``); its path is a
parameter. Added tokens in a text are taken first, as the library does.

Defined results: null text is empty text; empty text has no tokens, its ids and decoded text are empty strings. Every
repeated row is encoded. Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, held_by_worker, pieces, table

#: Words of one generation that a worker remembers.
WORDS_KEPT = 160_000
#: Text bytes whose new words are indexed together; a longer document is taken alone and whole.
PART_BYTES = 1 << 20
#: Fixed values of the tokenizer's word pattern: contractions, letter runs, single digits, runs of anything else.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACES}\p{{L}}\p{{N}}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def lowered(text: str) -> str:
    """NFC, then each character's own lower case, without regard to its neighbours."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Codec:
    """Vocabulary, merges by pair, and the words met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.token = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.base = 1 + max(self.token)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges.setdefault(vocab[a] * self.base + vocab[b], (rank, vocab[a + b]))
        end = spec["model"]["end_of_word_suffix"]
        units = [*byte_symbols(), *(s + end for s in byte_symbols())]
        self.units = np.array([vocab[u] for u in units])
        number = {i: n for n, i in enumerate(self.units.tolist())}
        #: Rank of each pair of bytes, -1 for none; the second may be a word's last.
        self.starts = np.full(512 * 512, -1)
        for pair, (rank, _) in self.merges.items():
            x, y = (number.get(i, -1) for i in divmod(pair, self.base))
            if x >= 0 and y >= 0:
                self.starts[x * 512 + y] = rank
        self.ids: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        self.old_text: dict[str, str] = {}

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: this vocabulary has no decoder that would undo the byte symbols or word ends."""
        return " ".join(map(self.token.__getitem__, ids))

    def encode_words(self, words: Iterable[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index over all of them."""
        raws = [w.encode() for w in words]
        if not raws:
            return []
        base, ends = self.base, np.cumsum([len(r) for r in raws])
        code = np.frombuffer(b"".join(raws), np.uint8).astype(np.int64)
        code[ends - 1] += 256  # the symbols that end a word
        heads = np.concatenate(([0], ends[:-1]))
        place = np.arange(len(code))
        follow, lead = place + 1, place - 1
        follow[ends - 1], lead[heads] = -1, -1
        # the index of the bytes' pairs: positions sorted by rank, cut where it changes
        rank = np.where(follow >= 0, self.starts[code * 512 + np.roll(code, -1)], -1)
        found = np.flatnonzero(rank >= 0)
        found = found[np.argsort(rank[found], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[found], prepend=-1))
        symbol = self.units[code].tolist()
        heads, after, before = heads.tolist(), follow.tolist(), lead.tolist()
        merge = self.merges.get
        where: dict[int, list[int]] = {}
        for places in np.split(found, cuts[1:]) if len(found) else ():
            i = int(places[0])
            where[symbol[i] * base + symbol[i + 1]] = places.tolist()
        active = [(*merge(pair), pair) for pair in where]
        heapq.heapify(active)
        while active:
            _, made, pair = heapq.heappop(active)
            a, b = divmod(pair, base)
            places = where.pop(pair)
            for i in sorted(places) if a == b else places:
                j = after[i]
                if j < 0 or symbol[i] != a or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = made, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if known := merge(new := made * base + symbol[k]):
                        if new in where:
                            where[new].append(i)
                        else:
                            where[new] = [i]
                            heapq.heappush(active, (*known, new))
                h = before[i]
                if h >= 0 and (known := merge(new := symbol[h] * base + made)):
                    if new in where:
                        where[new].append(h)
                    else:
                        where[new] = [h]
                        heapq.heappush(active, (*known, new))
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def words(self, text: str) -> list[str]:
        """Words of a text; an added token stands as a word that starts with a NUL."""
        if self.split is None or not any(t in text for t in self.added):
            return WORDS.findall(lowered(text))
        parts = self.split.split(text)
        return [w for i, part in enumerate(parts) for w in (["\0" + part] if i % 2 else WORDS.findall(lowered(part)))]

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Decimal ids and decoded text of each text."""
        if len(self.ids) > WORDS_KEPT:
            self.old_ids, self.old_text, self.ids, self.text = self.ids, self.text, {}, {}
        found = [self.words(t) for t in texts]
        absent = set().union(*found).difference(self.ids)
        met = absent.intersection(self.old_ids)
        for w in met:
            self.ids[w], self.text[w] = self.old_ids[w], self.old_text[w]
        new = list(absent - met)
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.added]
        made = dict(zip(plain, self.encode_words(plain), strict=True))
        for w in new:
            ids = made.get(w) or [self.added[w[1:]]]
            self.ids[w] = " ".join(map(str, ids))
            self.text[w] = self.decode(ids)
        for ws in found:
            yield " ".join(map(self.ids.__getitem__, ws)), " ".join(map(self.text.__getitem__, ws))


def codec(path: str) -> Codec:
    """The worker's codec, which the tasks that it runs one after the other share."""
    return held_by_worker(("bpe", path), lambda: Codec(path))


def encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids (decimal, joined by a space) and decoded."""
    spare = next(f"__{i}" for i in range(len(keep) + 1) if f"__{i}" not in keep)
    rows = docs.select(*(docs[f"`{c}`"] for c in keep), F.coalesce(docs[text], F.lit("")).alias(spare))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != spare), "n_tokens long, ids string, decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, spare, PART_BYTES):
                out = list(codec(path).encode(column(part, spare).to_pylist()))
                ids, decoded = [x for x, _ in out], [x for _, x in out]
                count = [x.count(" ") + 1 if x else 0 for x in ids]
                kept = [column(part, k) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], [*keep, "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """encode() with the ids and the decoded text as SHA-256, worked out where the texts are so that they never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
        for batch in batches:
            for part in pieces(batch, "text", PART_BYTES):
                ids, decoded = map(list, zip(*codec(path).encode([x or "" for x in column(part, "text").to_pylist()]), strict=True))
                count = [x.count(" ") + 1 if x else 0 for x in ids]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(count, pa.int64()), sha(ids), sha(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' columns but text and n_chars, with token count, ids and decoded text, which take the
    place of columns of these names in any letters."""
    return encode(docs, vocabulary(), keep=tuple(c for c in docs.columns if c.lower() not in ("text", "n_chars", "n_tokens", "ids", "decoded")))

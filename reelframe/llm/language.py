"""Language identification by cross-parsing against one suffix automaton per language.

A text is parsed from left to right into the longest phrases that occur in a language's training text; a symbol that
the training text lacks is a phrase of its own. Few phrases mean that the text looks like that language. Phrases are
counted per symbol and times log2 of the training length, which is about the bits that a symbol takes, so that
languages with less training text aren't favoured. Texts are lower-cased, whatever lies between letters is a space, and
symbols are bytes of UTF-8, so that letters of all scripts are told apart.

Training takes at most ``DOCS_PER_LANG`` documents of each language, chosen by hash over all documents, and an equal
share of at most ``CHARS_PER_LANG`` characters from each, spread over its length. Prediction reads whole texts.

Defined results: null text, empty text and text without a letter give ``und`` with score 0; so does everything when
no language could be learned. Equal counts go to the language whose name sorts first. Repeated rows are scored each.
Columns besides those named are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, fold_is, held_by_worker, pieces, table

DOCS_PER_LANG = 64
#: Characters of whole training documents of a language; a document that would exceed them is left out.
CHARS_PER_LANG = 24_000
SHARPNESS = 8.0
#: Text bytes that are parsed together; a longer document is taken alone and whole.
PART_BYTES = 4 << 20
#: Texts that still take steps together; what is left of fewer is parsed one after the other, with the same result.
FEW = 24
#: A text that takes more bits a symbol than this, and FIRST more in all, in every language is in none that is known:
#: letters of a known language take about 5 at most even if drawn evenly, letters of other scripts up to 14.
UNLIKE, FIRST = 6.0, 160.0
_BETWEEN = re.compile(r"[\W\d_]+")


def folded(text: str) -> bytes:
    """Lower-case letters in UTF-8, with one space for whatever lies between them."""
    low = _BETWEEN.sub(" ", unicodedata.normalize("NFC", text).lower()).strip()
    if not low.replace(" ", "").isalpha():  # word characters that are no letters: fractions, circled and Roman numbers
        low = " ".join("".join(c if c.isalpha() else " " for c in low).split())
    return low.encode()


def automaton(text: bytes) -> list[dict[int, int]]:
    """The suffix automaton of a text: for each state, the next state by symbol. State 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return nexts


class Parser:
    """Counts the longest phrases of folded texts in several training texts.

    All automata are one table of transitions, so that all texts of a batch and all languages take a step together; the
    few texts that are longer than all others are finished one after the other. A state is its row's place in the table.
    Row 0 leads nowhere: a text is there before its first symbol and after one that a language lacks."""

    def __init__(self, texts: tuple[bytes, ...]):
        self.codes = np.zeros(256, np.uint8)  # 0 is a byte that no training text has; no text has all 256 of UTF-8
        used = sorted(set().union(*texts))
        self.codes[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, roots, rows, codes = [np.zeros(self.width, np.int32)], [], 1, self.codes.tolist()
        for text in texts:
            nexts = automaton(text)
            roots.append(rows * self.width)
            table = np.zeros(len(nexts) * self.width, np.int32)
            for s, to in enumerate(nexts):
                for c, t in to.items():
                    table[s * self.width + codes[c]] = (rows + t) * self.width
            tables.append(table)
            rows += len(nexts)
        self.table, self.roots = np.concatenate(tables), np.array(roots)

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text in each language: places where the phrase so far doesn't go on, and a new one begins."""
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        code = self.codes[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int32)
        start, size = (np.cumsum(size) - size)[order], size[order]
        first = self.table[self.roots[:, None] + np.arange(self.width)]
        state, found = np.zeros((len(self.roots), len(texts)), np.int32), np.zeros((len(self.roots), len(texts)), np.int32)
        done, k = 0, len(texts) - int(np.searchsorted(size[::-1], 0, "right"))
        while k >= max(1, FEW):
            symbol = code[start[:k] + done]
            now = self.table.take(state[:, :k] + symbol)
            begins = now == 0
            found[:, :k] += begins
            state[:, :k] = np.where(begins, first.take(symbol, 1), now)
            done += 1
            k = len(texts) - int(np.searchsorted(size[::-1], done, "right"))
        one, codes = memoryview(self.table), self.codes.tobytes()
        for i in range(k):
            rest = texts[order[i]][done:].translate(codes)
            for lang, root in enumerate(self.roots.tolist()):
                at, n = int(state[lang, i]), 0
                for c in rest:
                    longer = one[at + c]
                    if not longer:
                        n += 1
                        longer = one[root + c]
                    at = longer
                found[lang, i] += n
        out = np.zeros((len(texts), len(self.roots)), np.int64)
        out[order] = found.T
        return out


def parser(texts: tuple[bytes, ...]) -> Parser:
    """The worker's parser, which the tasks that it runs one after the other share."""
    return held_by_worker(("language", texts), lambda: Parser(texts))


class Model:
    """Languages in order, with their folded training texts."""

    def __init__(self, texts: dict[str, str]):
        known = {k: t for k, v in sorted(texts.items()) if (t := folded(v))}
        self.langs, self.texts = list(known), tuple(known.values())
        self.weights = np.log2(np.array([len(t) + 2 for t in self.texts], float))

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Bits that a symbol of each folded text takes in each language."""
        return parser(self.texts).count(texts) * self.weights / np.maximum(1, [len(t) for t in texts])[:, None]


def learn(labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG) -> Model:
    """Model from (doc_id, text, lang); which rows may be learned from is the caller's choice."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(docs_per_lang)).alias("slot")
    size = F.length("text").alias("size")
    picked = rows.select("lang", slot, F.struct(F.xxhash64("doc_id", F.lit(29)).alias("mark"), size, "text").alias("x")).groupBy("lang", "slot").agg(F.min("x").alias("x"))
    texts: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in sorted(picked.select("lang", "x.mark", "x.size", "x.text").collect()):  # docs_per_lang of each language
        if r.text not in texts.setdefault(r.lang, []) and r.size <= left.setdefault(r.lang, chars_per_lang):
            texts[r.lang].append(r.text)
            left[r.lang] -= r.size
    for r in sorted(picked.select("lang", "x.size", "x.text").where(F.col("lang").isin([k for k, v in texts.items() if not v])).collect()) if not all(texts.values()) else ():
        texts[r.lang] = texts[r.lang] or [r.text]  # all are longer: the shortest
    return Model({k: "\n".join(v) for k, v in texts.items()})


def predict(docs: DataFrame, model: Model, text: str = "text", unlike: float | None = None) -> DataFrame:
    """All columns of docs, then lang_pred and score, which must not be among them.

    With unlike, texts whose symbols take more bits each in every language are ``und`` too; what a short text may take
    more, as its few phrases tell little, falls with its length: by FIRST / symbols."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in pieces(batch, text, PART_BYTES):
                symbols = [folded(t or "") for t in column(part, text).to_pylist()]
                names, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                known = np.array([bool(t) for t in symbols]) & bool(model.langs)
                if known.any():
                    cost = model.costs([t for t in symbols if t])
                    if unlike is not None:
                        known[known] = cost.min(1) <= unlike + FIRST / np.array([len(t) for t in symbols if t])
                        cost = cost[[bool(k) for k, t in zip(known, symbols, strict=True) if t]]
                    names[known] = np.array(model.langs, object)[cost.argmin(1)]
                    score[known] = 1 / ((cost.min(1)[:, None] / cost) ** SHARPNESS).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~fold_is("doc_id", 5, 0)))
    return predict(docs.select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "text"), model).drop("text")


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in no known language go, and a missing lang becomes the predicted one.

    Texts go whose symbols take more bits in every language than any text in its letters would, and texts without a
    letter. Where no language is known, or the table has no lang, only texts without a letter go."""
    names = docs.columns
    model = learn(docs.select("doc_id", "text", "lang" if "lang" in {c.lower() for c in names} else F.lit(None).cast("string").alias("lang")))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    clash = {"lang_pred", "score"} & {c.lower() for c in names}
    inner = docs.select("text", F.struct(*[docs[f"`{c}`"] for c in names if c != "text"]).alias("row")) if clash else docs
    kept = predict(inner, model, unlike=UNLIKE).where("lang_pred != 'und'")
    column_of = lambda c: F.col(f"row.`{c}`") if clash and c != "text" else F.col(f"`{c}`")
    return kept.select(*(F.coalesce(column_of(c), "lang_pred").alias(c) if c == "lang" else column_of(c).alias(c) for c in names))

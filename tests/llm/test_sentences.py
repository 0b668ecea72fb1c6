"""SentencePiece coding against the library itself."""

import hashlib
import random
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from reelframe.llm import sentences

from ..conftest import DATA


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentences.vocabulary())


@pytest.fixture(scope="module")
def codec():
    return sentences.Codec(sentences.vocabulary())


def check(codec, library, texts):
    ids, sizes = codec.encode(pa.array(texts, pa.string()))
    want = library.encode(texts, add_bos=True, add_eos=True)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want
    assert codec.decode(ids, sizes) == [library.decode(x) for x in want]


def test_odd_texts(codec, library):
    """Spaces in runs of any length, names of special pieces as text, bytes, letters that repeat."""
    check(codec, library, ["", "a", " ", "▁", "a▁▁b", "<s>", "</s>", "<unk>", "<0x41>", "\0", "a\0b", "\n \n", "é", "é", "🙂" * 3, "ﷺ", "\U0010ffff"])
    check(codec, library, [" " * n + end for n in range(120) for end in ("", "the", "日")])
    check(codec, library, [x * n for n in range(1, 90) for x in ("a", "ab", "the", "🙂", "\n")])


def test_random_texts(codec, library):
    rnd = random.Random(13)
    letters = "ab the▁  éü日本語の🙂\n\t\0xyz<s>0x41>‮"
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    for _ in range(20):
        check(codec, library, ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(200)])
        check(codec, library, ["".join(rnd.choices("theinrsao", k=rnd.randint(0, 300))) for _ in range(40)])
        check(codec, library, ["".join(rnd.choices(names, k=rnd.randint(0, 40))) for _ in range(60)])


@pytest.mark.parametrize("text", [" " * 100_000, "a" * 100_000, "ab" * 50_000, "漢字仮名" * 20_000, "🙂" * 20_000])
def test_very_long_words(codec, library, text):
    check(codec, library, [text, "x", text])


def test_ranks_that_do_not_rise():
    """A merge whose result pairs with its neighbour at a better rank: the queue takes that pair next, so must a round."""
    names = ["<unk>", "<s>", "</s>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "x", "y", "z", "xy", "xyx", "yx", "zz", "zzz"]
    model = sentencepiece_model_pb2.ModelProto()
    scores = {"xyx": -1.0, "xy": -2.0, "zzz": -3.0, "zz": -3.0}
    for i, name in enumerate(names):
        model.pieces.add(piece=name, score=scores.get(name, -9.0), type=2 if i == 0 else 3 if i < 3 else 6 if i < 259 else 1)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback = 2, True
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.add_dummy_prefix = True
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(model.SerializeToString())
        f.flush()
        own, library = sentences.Codec(f.name), sentencepiece.SentencePieceProcessor(model_file=f.name)
    rnd = random.Random(5)
    check(own, library, ["".join(rnd.choices("xyz ", (4, 4, 3, 1), k=rnd.randint(0, 40))) for _ in range(2000)])


def test_words_leave_the_memory(library, monkeypatch):
    monkeypatch.setattr(sentences, "WORDS_KEPT", 50)
    own, rnd = sentences.Codec(sentences.vocabulary()), random.Random(3)
    for _ in range(30):
        check(own, library, [" ".join("".join(rnd.choices("etaoin", k=rnd.randint(1, 5))) for _ in range(20))])
    assert len(own.young) < 200 and len(own.old) < 200


def test_decode_of_any_ids(codec, library):
    rnd = random.Random(4)
    drawn = [rnd.choices([0, 1, 2, 3, 200, 240, 242, 259, 29871, *range(259, 32000, 97)], k=rnd.randint(1, 12)) for _ in range(500)]
    got = codec.decode(np.array(sum(drawn, [])), np.array([len(x) for x in drawn]))
    assert got == [library.decode(x) for x in drawn]


def test_query(spark, library):
    docs = pq.read_table(f"{DATA}/documents.parquet").to_pydict()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentences.op13_sentencepiece(spark, DATA).collect()}
    want = {}
    for d, t in zip(docs["doc_id"], docs["text"], strict=True):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[d] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_frames(spark, library):
    """Null, empty and repeated rows, clashing and further columns, an empty table."""
    rows = [(1, None, "a"), (1, "the one", "b"), (1, "the one", "b"), (None, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __0 string")
    out = sentences.encode(df, sentences.vocabulary(), keep=("doc_id", "__0")).collect()
    assert sorted((r["__0"], r.n_tokens, r.ids, r.decoded) for r in out) == sorted((c, len(i := library.encode(t or "", add_bos=True, add_eos=True)), i, t or "") for _, t, c in rows)
    assert sentences.digests(df.limit(0), sentences.vocabulary()).collect() == []
    assert sentences.digests(df.drop("__0"), sentences.vocabulary()).count() == 4

import hashlib

import numpy as np
import public_tokenizers
import pytest
from binfall.llm import bpe
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    None,
    " ",
    "a  b\n\nc\t d",
    "<|startoftext|> hi <|endoftext|>x",
    "é ́x ΑΣ Σ a",
    "don't DON'T we'll 12 3x ### $$$",
    "x" * 30_000 + " ̀y \x00 z",
    " a　b  c‍ d",
    "\U0001f600 \U0001f468‍\U0001f469 ok️ fine",
    "Straße ÜBER été Ça İstanbul ǆ ﬁ",
    "가 ᅡ ᆨx",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_exact_on_documents(spark, documents, prose, library):
    shared = " ".join(prose(300))
    texts = ODD + [" ".join(prose(n)) for n in (1, 20, 500)] + [shared, "x " + shared, shared + " y", shared] + [" ".join(prose(60_000))]
    rows = bpe.encode(documents(texts), PATH, add=("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, texts[r.doc_id])
        assert r.n_tokens == len(r.ids)
        assert library.decode(r.ids, skip_special_tokens=False) == r.decoded


def test_chunks_are_reused_and_bounded(prose, monkeypatch, library):
    encoder = bpe.ChunkEncoder(PATH)
    shared = " ".join(prose(3000))
    encoder.encode([shared])
    before = len(encoder.chunks)
    encoder.encode(["new start " + shared])
    assert before > 50 and len(encoder.chunks) <= before + 2
    monkeypatch.setattr(bpe, "CHUNKS", 20)
    monkeypatch.setattr(bpe, "PIECES", 50)
    texts = [" ".join(prose(400)) for _ in range(5)]
    for t in texts:
        assert encoder.encode([t])[0] == np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_doubtful_joins_are_repaired_by_merging(library):
    encoder = bpe.ChunkEncoder(PATH)
    for text in ODD:
        if text and not any(s in text for s in encoder.special):
            assert encoder.joined(text.replace("\n", " ").split(" ")) == encoder.plain([text])[0]


def test_empty_table_and_clashing_columns(spark, documents):
    assert bpe.encode(documents([]), PATH).count() == 0
    odd = spark.createDataFrame([(1, "a b", 5, "c")], "doc_id long, text string, ids int, decoded string")
    assert bpe.encode(odd, PATH).columns == ["doc_id", *bpe.ADDED]


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)], "doc_id long, text string")
    rows = bpe.encode(df, PATH, add=("n_tokens", "ids_sha256")).collect()
    assert len(rows) == 4 and len({r.ids_sha256 for r in rows}) == 2 and sorted(r.n_tokens for r in rows) == [0, 3, 3, 3]


def test_failing_joins_merge_chunks_until_all_agree(prose, library, monkeypatch):
    """Joins that are said to fail are encoded as one chunk with what follows; the ids stay the library's."""
    encoder = bpe.ChunkEncoder(PATH)
    monkeypatch.setattr(bpe, "CHUNK_MASK", 3)
    text = " ".join(prose(900))
    want = np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode([text])[0] == want and encoder.repairs == 0 and len(encoder.joins) > 100
    for i, pair in enumerate(list(encoder.joins)):
        encoder.joins[pair] = i % 3 > 0
    assert encoder.encode([text])[0] == want and encoder.repairs > 50


def test_other_tokenizers_are_found_out():
    """A tokenizer that keeps spaces is never given chunks."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, other = bpe.ChunkEncoder(path), Tokenizer.from_file(path)
    assert not encoder.spaced and bpe.ChunkEncoder(PATH).spaced and bpe.ChunkEncoder(PATH).lowers and bpe.ChunkEncoder(PATH).parts
    texts = [t for t in ODD if t] + ["Two  Words, and more."]
    assert encoder.encode(texts) == [np.asarray(other.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

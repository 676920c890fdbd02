import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wayside.llm import bpe, tokencount
from wayside.llm.common import table
from wayside.llm.lexicon import Lexicon, compile_lexicon

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "  a  b ", "\n\n x\t\t", "x<|endoftext|>y <|endoftext|>", "▁a", "<s>x</s>", "é" * 300, "a" * 3000, "a \n \n b", "it's we'll x", "\x00\x1c a", "👍🏽 ok"]


def odd_documents(spark):
    rows = [(i, t, "src", "clash") for i, t in enumerate([*ODD, *ODD[:4]])]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens string")


def real_documents(spark):
    return table(spark, SF, "documents").select("doc_id", "text")


@pytest.mark.parametrize("documents", [odd_documents, real_documents])
def test_bpe_equals_the_library_and_round_trips(spark, documents):
    docs = documents(spark)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(map(tuple, bpe.digests(docs, bpe.tokenizer_file()).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


@pytest.mark.parametrize("documents", [odd_documents, real_documents])
def test_token_counts_equal_the_library(spark, documents):
    docs = documents(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as file:
        got = sorted(map(tuple, tokencount.count_tokens(docs, file.read(), limit=50, frequent=100).collect()))
    want = []
    for doc_id, text in docs.select("doc_id", "text").collect():
        n = len(library.encode(text or ""))
        want.append((doc_id, len((text or "").encode()), n, n > 50))
    assert got == sorted(want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(docs, bpe.tokenizer_file()).collect() == []
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        assert tokencount.count_tokens(docs, file.read()).collect() == []


def test_chunks_and_stretches_of_random_texts():
    rnd = random.Random(7)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "▁", "12", "👍", ".", "<s>", "'s", "　", "<|endoftext|>", " \n"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = bpe.Vocabulary(bpe.tokenizer_file())
    encoder = bpe.Encoder(vocabulary, compile_lexicon([(w, vocabulary.merge(w)) for w in (b" the", b"the", b" a")]))
    lengths = tokencount.Lengths(pieces, {})
    for _ in range(2000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert encoder.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert (sum(map(lengths.__getitem__, tokencount.chunks(text))) if text else 0) == len(pieces.encode(text))


def test_lexicon_is_minimal_and_exact():
    words = sorted({bytes(random.Random(i).choices(b"abc", k=i % 7 + 1)) for i in range(300)})
    entries = [(w, [i, i + 1][: i % 3]) for i, w in enumerate(words)]
    lexicon = Lexicon(compile_lexicon(entries))
    assert lexicon.lookup(words) == [ids for _, ids in entries]
    others = [b"", b"d", b"abcd", b"aaaaaaaaa"]
    assert lexicon.lookup(others) == [None] * 4
    # "tap taps top tops": one state each for the start, t, ta = to, tap, and the end
    shared = Lexicon(compile_lexicon([(w, [1]) for w in (b"tap", b"taps", b"top", b"tops")]))
    assert len(shared.final) == 5


def test_long_words_merge_as_short_ones_do():
    vocabulary = bpe.Vocabulary(bpe.tokenizer_file())
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for word in ("thenation" * 20, "x" * 500, "ababab" * 30):
        assert vocabulary.merger()(word) == vocabulary.merge(word.encode()) == library.encode(word, add_special_tokens=False).ids

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from wayside.llm import wordshuffle
from wayside.llm.bpe import PATTERN
from wayside.llm.common import table

ODD = [None, "", " ", "  a  b ", "\n\n x\t\t", "<|endoftext|>", "é" * 300, "a" * 30000, "a \n \n b", "it's we'll x", "\x00\x1c a \x1c b", "👍🏽 ok", "a " * 40000, "a  b\xa0 c", "x ", " y", "　 全角"]


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return wordshuffle.read_ranks(file.read())


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_that_of_the_vocabulary():
    assert public_tokenizers.PATTERN == PATTERN


def test_packed_numbers_come_back():
    numbers = np.array([0, 1, 127, 128, 16383, 16384, 2**40, 5])
    assert wordshuffle.unpack(wordshuffle.pack(numbers)).tolist() == numbers.tolist()
    assert wordshuffle.unpack(wordshuffle.pack(numbers[:0])).tolist() == []


def test_words_of_random_texts_are_the_matches_of_the_pattern():
    rnd = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "12", "👍", ".", "'s", "　", " \n", "\xa0", "\x1c", "\x85"]
    cut = regex.compile(PATTERN).findall
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))) for _ in range(5000)]
    words, positions, counts = wordshuffle.words_of(pa.array(texts), cut)
    found = iter([words[i] for i in positions.tolist()])
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert [next(found) for _ in range(n)] == cut(text)


@pytest.mark.parametrize("kind", ["odd", "real", "empty"])
def test_digests_equal_the_library(spark, ranks, kind):
    odd = [(i, t, "src", "clash") for i, t in enumerate(ODD)] + [(None, "no id", None, None), (3, "  a  b ", "src", "clash")]
    schema = "doc_id long, text string, source string, ids string"
    docs = table(spark, "/root/testdata/sf0.001", "documents") if kind == "real" else spark.createDataFrame(odd if kind == "odd" else [], schema).repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want, encode = [], library(ranks).encode_ordinary
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = encode(text or "")
        want.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    got = [tuple(r) for r in wordshuffle.digests(docs, ranks).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_blocks_and_other_columns(spark, ranks):
    texts = [f"text {i % 7} of the day, {'very ' * (i % 5)}long" for i in range(60)]
    docs = spark.createDataFrame([(str(i), t, "x") for i, t in enumerate(texts)], "doc_id string, text string, decoded string").coalesce(1)
    encode = library(ranks).encode_ordinary
    got = wordshuffle.decode_ids(wordshuffle.encode_words(docs, ranks, block=100).withColumn("decoded", wordshuffle.F.lit("x")), ranks).collect()
    assert sorted((r.doc_id, list(r.ids), bytes(r.decoded).decode()) for r in got) == sorted((str(i), encode(t), t) for i, t in enumerate(texts))

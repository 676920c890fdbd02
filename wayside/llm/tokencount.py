"""Token counts by a two-tier lookup of pre-tokens, without shuffling any."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import table, texts
from wayside.llm.frequent import frequent_words

BLOCK = "▁"  # the sign by which sentencepiece writes a blank
CHUNK = re.compile(r" ( *[^ ]*)")
#: Entries that a worker's cache of rare pre-tokens holds before it starts anew, and their length.
CACHE, CACHED_LENGTH = 200_000, 64


def chunks(text: str) -> list[str]:
    """Stretches that sentencepiece encodes independently, each without the blank it begins with.

    A piece of the vocabulary has blanks only in front, so no merge crosses from a letter to a
    blank: a run of blanks and the letters behind it are tokenized alike alone and in a text. The
    encoder puts a blank before whatever it gets, here that of the chunk, at the start of the text
    its own.
    """
    text = text.replace(BLOCK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return CHUNK.findall(" " + text)
    return text.split(" ")


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast frequent ones, and those met since."""

    def __init__(self, encoder, frequent: dict[str, int]):
        super().__init__(frequent)
        self.encoder, self.frequent = encoder, frequent
        self[""] = 1  # a blank with nothing behind it

    def __missing__(self, chunk: str) -> int:
        n = len(self.encoder.encode(chunk))
        if len(chunk) <= CACHED_LENGTH:
            if len(self) > CACHE + len(self.frequent):
                self.clear()
                self.update(self.frequent)
                self[""] = 1
            self[chunk] = n
        return n


#: Of the broadcast that this worker used last.
_LENGTHS: dict[str, Lengths] = {}


def check_model(model: bytes) -> None:
    """Raise ValueError if a piece has a blank behind a letter, where chunks would not be exact."""
    encoder = load(model)
    if any(BLOCK in encoder.id_to_piece(i).lstrip(BLOCK) for i in range(encoder.vocab_size())):
        raise ValueError("the vocabulary has pieces across blanks")


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def token_counter(docs: DataFrame, model: bytes, frequent: int = 1 << 15):
    """A column function from text to its number of tokens.

    The ``frequent`` most frequent pre-tokens of ``docs`` are encoded once and broadcast with their
    lengths (a bound on the size of what is sent); the rest are encoded where they occur, through
    a cache in each worker.
    """
    check_model(model)
    encoder = load(model)
    words = [w for w in frequent_words(docs, chunks, frequent) if w]
    known = dict(zip(words, map(len, encoder.encode(words)), strict=True)) if words else {}
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((model, known))

    @F.arrow_udf(T.LongType())
    def count(text: pa.Array) -> pa.Array:
        lengths = _LENGTHS.get(key)
        if lengths is None:
            _LENGTHS.clear()
            lengths = _LENGTHS[key] = Lengths(load(sent.value[0]), sent.value[1])
        return pa.array([sum(map(lengths.__getitem__, chunks(t))) if t else 0 for t in texts(text)], pa.int64())

    return count


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096, frequent: int = 1 << 15) -> DataFrame:
    """Bytes and tokens of every document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit``).

    Counts are those of the whole text without added tokens; null counts as empty, which has none.
    Repeated rows are counted one by one; other columns are not read.
    """
    count = token_counter(docs, model, frequent)
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        count("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), file.read())

"""Byte-level BPE: encoding through a lexicon of frequent words with exact merging of the rest, and decoding."""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import batched, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import bundles, table
from wayside.llm.frequent import frequent_words
from wayside.llm.lexicon import Lexicon, compile_lexicon

# Fixed value: how byte-level BPE cuts a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words, and stretches up to a length, that each of a cache's two generations holds.
CACHE, LONGEST = 50_000, 64
#: Bytes of texts that are encoded together, and ids that are decoded together.
BUNDLE, SPELLED = 1 << 21, 1 << 17
#: Decoded texts that are strings of Python at one time.
SPELLED_ROWS = 256
BLANKS = r" [\x09-\x0d\x1c-\x20\x{85}\p{Z}]"
MARKS = ".,"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t.encode() for t, i in self.specials.items()}
        self.single = [0] * 256
        for c, b in letters.items():
            self.single[b] = vocab[c]
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        made = [new for _, new in self.merges.values()]
        #: Whether ids rise with the rank of the merge that makes them, as a table of ranks needs.
        self.ranked = made == sorted(made)

    def merger(self) -> Callable[[str], list[int]]:
        """What merges one word exactly: the ranks' own library where ids are ranks, else ``merge``."""
        if not self.ranked:
            return lambda word: self.merge(word.encode("utf-8", "surrogatepass"))
        import tiktoken

        ranks = {t: i for i, t in self.tokens.items() if i not in self.specials.values()}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: the merge of lowest rank first, leftmost first, until none applies."""
        ids = [self.single[b] for b in word]
        merges = self.merges
        # a heap of possible merges over a linked list
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else len(ids)
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(ids) and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right]))
        return [i for i in ids if i is not None]


class Cache:
    """The latest entries: a full generation becomes the old one, from which what is met again is taken over."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def room(self, n: int) -> None:
        """Make room for ``n`` entries; nothing goes from the new generation before the next call."""
        if len(self.new) + n > CACHE:
            self.old, self.new = self.new, {}

    def recall(self, key: str) -> bytes | None:
        """An entry of the old generation, which becomes one of the new."""
        found = self.old.get(key)
        if found is not None:
            self.new[key] = found
        return found


class Encoder:
    """Ids of texts: words are looked up in the lexicon, others merged; caches keep what both gave.

    A stretch is what stands between two blanks, with the first of them. Words never go across the
    beginning of a stretch unless white space follows the blank; texts with such places, and those
    with special tokens, are cut into words as a whole. Of the others each distinct stretch is
    looked up once for a bundle of texts. Ids are held as the bytes of 32-bit numbers.
    """

    def __init__(self, vocabulary: Vocabulary, lexicon: bytes):
        import regex

        self.vocabulary, self.merge = vocabulary, vocabulary.merger()
        self.cut = regex.compile(PATTERN).findall
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None
        self.words, self.stretches = Cache(), Cache()
        # The file has no name any more once it is mapped, so nothing stays behind on the executor.
        file, name = tempfile.mkstemp()
        os.write(file, lexicon)
        self.lexicon = Lexicon(mmap.mmap(file, 0, access=mmap.ACCESS_READ))
        os.close(file)
        os.unlink(name)

    def learn(self, words: list[str]) -> None:
        """Put words into the cache: from the lexicon, the rest by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = self.words.new
        for word, rank in zip(words, self.lexicon.ranks(raw).tolist(), strict=True):
            out[word] = array("i", self.merge(word) if rank < 0 else self.lexicon.output(rank)).tobytes()

    def know(self, words: set[str]) -> None:
        """Have all these words in the cache at once, whatever else goes from it."""
        self.words.room(len(words))
        known, recall = self.words.new, self.words.recall
        new = [w for w in words if w not in known and recall(w) is None]
        if new:
            self.learn(new)

    def of_stretches(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct stretches, given without their blanks."""
        self.stretches.room(len(parts))
        known, recall = self.stretches.new, self.stretches.recall
        ids = [known.get(p) or recall(p) for p in parts]
        gaps = [i for i, x in enumerate(ids) if x is None]
        # a stretch of letters is one word, with a mark behind it two; the rest is cut
        pieces = []
        for i in gaps:
            w = parts[i]
            if w.isalpha():
                pieces.append((" " + w,))
            elif w[-1:] in MARKS and w[:-1].isalpha():
                pieces.append((" " + w[:-1], w[-1]))
            else:
                pieces.append(self.cut(" " + w))
        self.know({*chain.from_iterable(pieces)})
        get = self.words.new.__getitem__
        for i, words in zip(gaps, pieces, strict=True):
            ids[i] = get(words[0]) if len(words) == 1 else b"".join(map(get, words))
            if len(parts[i]) <= LONGEST:
                known[parts[i]] = ids[i]
        return ids

    def whole(self, text: str) -> bytes:
        """The ids of one text that is cut into words as a whole, special tokens in it read as such."""
        out, at = [], 0
        for m in [*(self.special.finditer(text) if self.special else ()), None]:
            words = self.cut(text[at : m.start() if m else None])
            for i in range(0, len(words), CACHE):
                some = words[i : i + CACHE]
                self.know({*some})
                out += map(self.words.new.__getitem__, some)
            if m:
                out.append(np.int32(self.vocabulary.specials[m[0]]).tobytes())
                at = m.end()
        return b"".join(out)

    def odd(self, text: pa.Array) -> np.ndarray:
        """Which texts have to be cut as a whole."""
        out = pc.match_substring_regex(text, BLANKS)
        for token in self.vocabulary.specials:
            out = pc.or_(out, pc.match_substring(text, token))
        return out.to_numpy(zero_copy_only=False)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a bundle of texts one after the other, and how many each text has."""
        n = len(text)
        odd = self.odd(text)
        alone = np.flatnonzero(odd)
        cut = pc.split_pattern(pc.if_else(pa.array(odd), "", text), " ")
        starts = cut.offsets.to_numpy()
        found = cut.flatten().dictionary_encode()
        which = found.indices.to_numpy().astype(np.int64)
        # entries: distinct stretches, the first ones of the texts, which have no blank, and whole texts
        first = cut.flatten().take(pa.array(starts[:-1])).dictionary_encode()
        parts, firsts = found.dictionary.to_pylist(), [self.cut(w) for w in first.dictionary.to_pylist()]
        entries = self.of_stretches(parts)
        self.know({*chain.from_iterable(firsts)})
        entries += [b"".join(map(self.words.new.__getitem__, words)) for words in firsts]
        which[starts[:-1]] = len(parts) + first.indices.to_numpy()
        which[starts[:-1][alone]] = len(entries) + np.arange(len(alone))
        entries += [self.whole(text[i].as_py()) for i in alone.tolist()]
        lengths = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        ids = gather(np.frombuffer(b"".join(entries), np.int32), np.cumsum(lengths) - lengths, lengths, which)
        ends = np.concatenate([[0], np.cumsum(lengths[which])])[starts]
        return ids, np.diff(ends) if n else np.empty(0, np.int64)


def gather(block: np.ndarray, starts: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``block`` that ``which`` names, one after the other."""
    size = lengths[which]
    ends = np.cumsum(size)
    return block[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + size, size)]


def stretches(text: str) -> list[str]:
    return text.split(" ")


class Speller:
    """The bytes that runs of ids stand for, copied from one block of all tokens."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens, default=-1) + 2  # the last place is for ids that aren't in the vocabulary
        spelled = [tokens.get(i, b"") for i in range(n)]
        self.block = np.frombuffer(b"".join(spelled) or b"\0", np.uint8)
        self.lengths = np.fromiter(map(len, spelled), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids: np.ndarray, counts: np.ndarray) -> Iterator[bytes]:
        """The bytes of each run of ``counts`` ids."""
        at = 0
        for bundle in np.split(counts, np.flatnonzero(np.diff(np.cumsum(counts) // SPELLED)) + 1):
            own = ids[at : at + bundle.sum()].astype(np.int64)
            at += len(own)
            own = np.where((own < 0) | (own >= len(self.lengths)), len(self.lengths) - 1, own)
            data = gather(self.block, self.starts, self.lengths, own).tobytes()
            edges = np.concatenate([[0], np.cumsum(self.lengths[own])])[np.concatenate([[0], np.cumsum(bundle)])].tolist()
            for a, b in pairwise(edges):
                yield data[a:b]


class Coder:
    """What a worker needs of one tokenizer; each half is made when it is first used."""

    def __init__(self, tokenizer: bytes, lexicon: bytes = b""):
        self.vocabulary, self.lexicon = Vocabulary(tokenizer), lexicon

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self.vocabulary, self.lexicon)

    @cached_property
    def speller(self) -> Speller:
        return Speller(self.vocabulary.tokens)

    def ids(self, text: pa.Array) -> pa.ListArray:
        coded = [self.encoder.encode(some) for some in bundles(text.fill_null(""), BUNDLE)]
        ends = np.cumsum(np.concatenate([[0], *[n for _, n in coded]])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *[ids for ids, _ in coded]])))

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        values = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        spelled = [pa.array([], pa.string())]
        for bundle in batched(self.speller(values, lengths), SPELLED_ROWS):
            spelled.append(pa.array([b.decode("utf-8", "replace") for b in bundle], pa.string()))
        return pa.concat_arrays(spelled)


#: Of the broadcast that this worker used last.
_CODERS: dict[str, Coder] = {}


def coder_of(key: str, sent) -> Coder:
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(*sent.value)
    return _CODERS[key]


def lexicon_of(docs: DataFrame, tokenizer: bytes, frequent: int = 1 << 16) -> bytes:
    """The words of the ``frequent`` most frequent stretches between blanks in all of ``docs``, with their ids.

    Its size is bounded by ``frequent``. Which words it holds decides how fast a word is encoded,
    never how.
    """
    import regex

    cut = regex.compile(PATTERN).findall
    merge = Vocabulary(tokenizer).merger()
    words = {p for w in frequent_words(docs, stretches, frequent) for p in (*cut(" " + w), *cut(w)[:1])}
    return compile_lexicon([(w.encode("utf-8", "surrogatepass"), merge(w)) for w in words])


def encoder(docs: DataFrame, tokenizer: bytes, frequent: int = 1 << 16):
    """A column function from text to the array of its token ids."""
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer, lexicon_of(docs, tokenizer, frequent)))
    key = uuid.uuid4().hex

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(text: pa.Array) -> pa.Array:
        return coder_of(key, sent).ids(text)

    return encode


def decoder(spark, tokenizer: bytes):
    """A column function from an array of ids to its text; bytes that aren't UTF-8 become U+FFFD.

    Ids that are null or not in the vocabulary stand for nothing; a null array is an empty text.
    """
    sent = spark.sparkContext.broadcast((tokenizer,))
    key = uuid.uuid4().hex

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return coder_of(key, sent).decoded(ids)

    return decode


def encode_documents(docs: DataFrame, tokenizer: bytes, frequent: int = 1 << 16) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole text, special tokens in it read as such.

    Null and empty texts have no ids; repeated rows are encoded one by one. An ``ids`` column that
    was there is replaced; other columns stay.
    """
    return docs.withColumn("ids", encoder(docs, tokenizer, frequent)(docs["text"]))


def decode_documents(docs: DataFrame, tokenizer: bytes) -> DataFrame:
    """``docs`` with ``decoded``, the text that ``ids`` stand for; null ids stand for an empty text."""
    return docs.withColumn("decoded", decoder(docs.sparkSession, tokenizer)(docs["ids"]))


def round_trip(docs: DataFrame, tokenizer: bytes, frequent: int = 1 << 16) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, as ``encode_documents`` and ``decode_documents`` give them.

    Both come from one call for each batch: chained, the two would have every text encoded twice. Null and empty texts
    have no ids and decode to an empty text; repeated rows are coded one by one; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer, lexicon_of(docs, tokenizer, frequent)))
    key = uuid.uuid4().hex
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @F.arrow_udf(kind)
    def code(text: pa.Array) -> pa.Array:
        coder = coder_of(key, sent)
        ids = coder.ids(text)
        out = pa.StructArray.from_arrays([ids, coder.decoded(ids)], ["ids", "decoded"])
        pa.default_memory_pool().release_unused()
        return out

    both = docs.withColumn("_coded", code(docs["text"]))
    return both.withColumns({"ids": both["_coded.ids"], "decoded": both["_coded.decoded"]}).drop("_coded")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def digests(docs: DataFrame, tokenizer: bytes) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text; null and empty texts have no tokens."""
    return round_trip(docs, tokenizer).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_bpe(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file())

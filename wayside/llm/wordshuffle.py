"""Byte-level BPE by one shuffle of distinct words: each is encoded once for the whole corpus.

Texts are cut into blocks of whole documents. Of a block, every distinct word is exploded once, with
the positions at which it stands kept in the block's own row; words meet by their hash, each distinct
one is encoded there, its ids go back to the blocks that have it, and each block puts its ids together
by position. Words and ids travel packed, those of one block and bucket in one row: a row for each word
would weigh more than the texts.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.bpe import MARKS, PATTERN, Speller, gather
from wayside.llm.common import bundles, table

#: Bytes of texts in a block, which holds one text at least.
BLOCK = 8 << 20
#: Numbers that are packed together.
STEP = 1 << 16
#: Bytes behind a blank with which white space may begin; no word is cut off before such a blank.
SPACES = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a table of ranks: lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, seven bits to a byte, the last byte of each below 128."""
    out = []
    for i in range(0, len(numbers), STEP):
        some = numbers[i : i + STEP].astype(np.int64)
        size = np.ones(len(some), np.int64)
        for bits in range(7, 63, 7):
            size += some >= 1 << bits
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - 1 - np.arange(ends[-1])
        out.append((np.repeat(some, size) >> 7 * left & 127 | np.where(left > 0, 128, 0)).astype(np.uint8).tobytes())
    return b"".join(out)


def unpack(data: bytes) -> np.ndarray:
    """The numbers that ``pack`` took."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    out = np.empty(len(ends), np.int64)
    start = 0
    for i in range(0, len(ends), STEP):
        own = ends[i : i + STEP] - start
        some = raw[start : start + own[-1] + 1]
        size = np.diff(own, prepend=-1)
        left = np.repeat(own, size) - np.arange(len(some))
        out[i : i + STEP] = np.add.reduceat((some & 127).astype(np.int64) << 7 * left, own - size + 1)
        start += len(some)
    return out


def stretches(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts cut before every blank that begins a word whatever surrounds it, and how many pieces each has."""
    text = text.cast(pa.string())
    edges = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    cut = np.empty(len(data) + 1, bool)
    cut[-1] = True
    cut[:-2] = (data[:-1] == 32) & ~SPACES[data[1:]]
    cut[len(data) - 1 : len(data)] = False
    last = edges[1:][np.diff(edges) > 0] - 1  # what follows a text's last byte isn't its own
    cut[last] = False
    cut[edges[:-1]] = True
    starts = np.flatnonzero(cut).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data))
    return pieces, np.diff(np.searchsorted(starts, edges))


def words_of(text: pa.Array, cut) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of a block, which of them stands at each position, and how many words each text has."""
    pieces, counts = stretches(text)
    found = pieces.dictionary_encode()
    which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    places: dict[str, int] = {}
    codes, lengths = [], []
    for piece in found.dictionary.to_pylist():
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            own = (piece,)
        elif piece[-1] in MARKS and piece[1:-1].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            own = (piece[:-1], piece[-1])
        else:
            own = cut(piece)
        lengths.append(len(own))
        for word in own:
            codes.append(places.setdefault(word, len(places)))
    lengths = np.array(lengths, np.int64)
    positions = gather(np.array(codes, np.int64), np.cumsum(lengths) - lengths, lengths, which)
    ends = np.concatenate([[0], np.cumsum(lengths[which])])[np.concatenate([[0], np.cumsum(counts)])]
    # the most frequent words have the smallest numbers, which take the least room
    order = np.argsort(-np.bincount(positions, minlength=len(places)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    words = list(places)
    return [words[i] for i in order.tolist()], rank[positions], np.diff(ends)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Array, pa.Array]]:
    """The documents of this task in blocks of about ``most`` bytes: number, doc_ids, texts."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    waiting: list[pa.RecordBatch] = []
    size = 0

    def flush():
        nonlocal number
        rows = pa.Table.from_batches(waiting)
        ids, text = (pa.concat_arrays(rows.column(c).chunks) for c in (0, 1))
        at = 0
        for some in bundles(text := text.cast(pa.large_string()).fill_null(""), most):
            yield number, ids.slice(at, len(some)), some
            at += len(some)
            number += 1

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= most:
            yield from flush()
            waiting.clear()
            size = 0
    if waiting:
        yield from flush()


def bucket_order(words: list[str], n_buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words as bytes, their buckets, and their order by bucket and bytes."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    buckets = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % n_buckets
    order = np.array(sorted(range(len(raw)), key=raw.__getitem__), np.int64)
    return raw, buckets, order[np.argsort(buckets[order], kind="stable")]


def packed_words(words: list[bytes]) -> bytes:
    return zlib.compress(pack(np.fromiter(map(len, words), np.int64, len(words))) + b"".join(words), 1)


def unpacked_words(data: bytes, n: int) -> list[bytes]:
    data = zlib.decompress(data)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8)[: 9 * n] < 128)[:n]
    lengths = unpack(data[: ends[-1] + 1])
    edges = (ends[-1] + 1 + np.concatenate([[0], np.cumsum(lengths)])).tolist()
    return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def encode_words(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """doc_id and ids, the token ids of every whole text: each match of ``pattern`` is merged by ``ranks`` on its own.

    ``pattern`` must be one whose matches begin before a single blank that letters, digits or signs
    follow, as those of byte-level vocabularies do. Null and empty texts have no ids. Repeated rows and
    equal or null doc_ids stay rows of their own; an empty table gives an empty one; of ``docs`` only
    doc_id and text are read. A word is in one row for each block at most, so frequent words weigh no
    more than rare ones; memory follows ``block``, in bytes of texts, or the longest text if that is longer.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = spark.sparkContext.broadcast(ranks)
    key = uuid.uuid4().hex

    def exploded(batches):
        import regex

        cut = regex.compile(pattern).findall
        for number, ids, text in blocks(batches, block):
            yield number, ids, *words_of(text, cut)

    def words(batches):
        for number, _, distinct, _, _ in exploded(batches):
            raw, buckets, order = bucket_order(distinct, n_buckets)
            edges = np.flatnonzero(np.diff(buckets[order], prepend=-1)).tolist() + [len(order)]
            order_, own = order.tolist(), buckets[order].tolist()
            packs = [(own[a], b - a, packed_words([raw[i] for i in order_[a:b]])) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([p[0] for p in packs], pa.int32()), "block": pa.array([number] * len(packs), pa.int64()),
                "n": pa.array([p[1] for p in packs], pa.int32()), "words": pa.array([p[2] for p in packs], pa.binary()),
            })

    def encoded(group: pa.Table) -> pa.Table:
        encode = encoder_of(key, sent)
        packs = [unpacked_words(w, n) for w, n in zip(group["words"].to_pylist(), group["n"].to_pylist(), strict=True)]
        known = {w: encode(w) for w in {w for p in packs for w in p}}
        out = []
        for p in packs:
            ids = [known[w] for w in p]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, lengths.sum())
            out.append(zlib.compress(pack(lengths) + pack(flat), 1))
        return pa.table({
            "block": group["block"], "bucket": group["bucket"], "n": group["n"], "data": pa.array(out, pa.binary()),
            "docs": pa.nulls(len(out), rows_kind), "places": pa.nulls(len(out), pa.binary()),
        })

    def positions(batches):
        for number, ids, distinct, at, counts in exploded(batches):
            order = bucket_order(distinct, n_buckets)[2]
            own = pa.StructArray.from_arrays([ids, pa.array(counts, pa.int64())], ["doc_id", "n"])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "bucket": pa.array([-1], pa.int32()), "n": pa.array([len(distinct)], pa.int32()),
                "data": pa.array([pack(at)], pa.binary()),
                "docs": pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "places": pa.array([pack(order)], pa.binary()),
            })

    def reassembled(group: pa.Table) -> pa.Table:
        group = group.sort_by("bucket")
        data, n = group["data"].to_pylist(), group["n"].to_pylist()
        if sum(n[1:]) != n[0]:
            raise ValueError("words of a block are missing: its texts were read differently in two scans")
        order = unpack(group["places"][0].as_py())
        flat, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for some, own in zip(data[1:], n[1:], strict=True):
            numbers = unpack(zlib.decompress(some))
            counts.append(numbers[:own])
            flat.append(numbers[own:])
        lengths = np.concatenate(counts)
        starts = np.cumsum(lengths) - lengths
        by_place = np.empty((2, len(order)), np.int64)
        by_place[:, order] = starts, lengths
        at = unpack(data[0])
        ids = gather(np.concatenate(flat).astype(np.int32), by_place[0], by_place[1], at)
        own = group["docs"].combine_chunks()[0].values
        words_to = np.concatenate([[0], np.cumsum(own.field("n").to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(by_place[1][at])])[words_to]
        return pa.table({"doc_id": own.field("doc_id"), "ids": pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(ids)).cast(pa.list_(pa.int32()))})

    rows = T._parse_datatype_string(f"docs array<struct<doc_id:{doc_id},n:bigint>>")
    from pyspark.sql.pandas.types import to_arrow_type

    rows_kind = to_arrow_type(rows[0].dataType)
    schema = f"block bigint, bucket int, n int, data binary, docs array<struct<doc_id:{doc_id},n:bigint>>, places binary"
    back = docs.mapInArrow(words, "bucket int, block bigint, n int, words binary").groupBy("bucket").applyInArrow(encoded, schema)
    return docs.mapInArrow(positions, schema).unionByName(back).groupBy("block").applyInArrow(reassembled, f"doc_id {doc_id}, ids array<int>")


#: Of the broadcast that this worker used last.
_ENCODERS: dict = {}


def encoder_of(key: str, sent):
    """What gives the ids of one word's bytes, whatever they are."""
    if key not in _ENCODERS:
        import tiktoken

        _ENCODERS.clear()
        _ENCODERS[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=sent.value, special_tokens={})
    return _ENCODERS[key]._core_bpe.encode_single_piece


def decode_ids(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``docs`` with ``decoded``, the bytes for which ``ids`` stand, by the broadcast table of tokens and their bytes.

    Ids that are null or not in the table stand for nothing, a null array for no bytes. A column
    ``decoded`` that was there is replaced; all others stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    key = uuid.uuid4().hex

    @F.arrow_udf(T.BinaryType())
    def decode(ids: pa.Array) -> pa.Array:
        if key not in _SPELLERS:
            _SPELLERS.clear()
            _SPELLERS[key] = Speller(sent.value)
        lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return pa.array(_SPELLERS[key](ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False), lengths.astype(np.int64)), pa.binary())

    return docs.withColumn("decoded", decode(docs["ids"]))


#: Of the broadcast that this worker used last.
_SPELLERS: dict[str, Speller] = {}


@F.arrow_udf(T.StringType())
def ids_digest(ids: pa.Array) -> pa.Array:
    """SHA-256 of ids as little-endian unsigned numbers of 32 bits."""
    data = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    edges = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    return pa.array([sha256(data[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)], pa.string())


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the bytes that they decode to; null and empty texts have no tokens."""
    return decode_ids(encode_words(docs, ranks, pattern), ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_distinct_words(spark, sf_dir):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = read_ranks(file.read())
    return digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)

"""Masked pseudo-likelihood of documents under a bidirectional window network."""

from __future__ import annotations

import hashlib
import math
import pickle
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayside.llm.common import bundles, emit_summary, materialise, merge_summaries, table
from wayside.llm.frequent import SUMMARY

#: Words seen on each side, size of the hidden layer.
SIDE, HIDDEN = 2, 16
#: The vocabulary: frequent words, then hash buckets that other words share, then the edge of a
#: text. It is square: a word is predicted by its class and its place in the class. This is the
#: least vocabulary; it grows with the square root of the corpus (``classes_for``).
CLASSES = 32
VOCABULARY = CLASSES * CLASSES
FREQUENT, EDGE = VOCABULARY - 257, VOCABULARY - 1
OTHERS = EDGE - FREQUENT
#: Words up to so many bytes stand for themselves, longer ones are told apart by a digest.
LONGEST = 64
#: Words whose counts are broadcast for speed; the counts of all others are joined.
KNOWN = 1 << 18
#: Most bytes of parameters that are averaged in one go.
AVERAGED = 1 << 28
#: Words that a step predicts, its rate, and words that are scored together.
MINIBATCH, RATE, PIECE = 1 << 14, 0.3, 1 << 14
#: Bytes of texts whose words are held at once, and bytes for each word that they are looked up in: each
#: time a table of these words is built, which so takes a fixed share of the time of looking up.
BUNDLE, FOR_EACH = 1 << 22, 16
#: Words that are held until they are counted.
COUNTED = 1 << 22
#: Sums of weights whose exponentials are far from the limits of 32-bit numbers, and the least such number.
SAFE, TINY = 40.0, np.float32(1e-38)
#: Numbers of a softmax that are held at once, so that they stay in a core's cache.
CACHED = 400_000
ONES = np.ones(1 << 15, np.float32)
#: Rows of a run up to which runs are summed together.
SHORT = 8
AROUND = [i for i in range(-SIDE, SIDE + 1) if i]


def classes_for(n_words: int) -> int:
    """Classes of the least square that holds so many frequent words, the buckets and the edge."""
    return max(CLASSES, math.isqrt(n_words + OTHERS) + 1)


def new_parameters(seed: int = 11, classes: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    return {
        "words": small(classes * classes, 2 * SIDE * HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
        "classes": small(HIDDEN + 1, classes), "places": small(classes, HIDDEN + 1, classes),
    }


def key_of(word: bytes) -> bytes:
    """The word, or a digest of a long one behind a blank, which no word has."""
    return word if len(word) <= LONGEST else b" " + hashlib.blake2b(word, digest_size=16).digest()


class Ids(dict):
    def __init__(self, words: list[bytes], classes: int = CLASSES):
        super().__init__({w: i for i, w in enumerate(words)} | {b"": classes * classes - 1})
        self.others = classes * classes - 1 - OTHERS

    def __missing__(self, word: bytes) -> int:
        found = self.others + zlib.crc32(word if len(word) <= LONGEST else key_of(word)) % OTHERS
        if len(self) < 300_000:
            self[word] = found
        return found


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def words_in(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts (``words_of`` of each, null: none), and where each text's words end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    words = lists.flatten().cast(pa.binary())
    # blanks at either end of a text leave empty strings
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        ends, words = np.concatenate([[0], np.cumsum(real)])[ends], words.filter(pa.array(real))
    return words, ends


def keys_of(words: pa.Array) -> pa.Array:
    """``key_of`` each word."""
    if (pc.max(pc.binary_length(words)).as_py() or 0) <= LONGEST:
        return words
    return pa.array([key_of(w) for w in words.to_numpy(zero_copy_only=False)], pa.binary())


def buckets_of(keys: pa.Array) -> np.ndarray:
    """Each key's bucket, from 0."""
    return np.fromiter(map(zlib.crc32, keys.to_numpy(zero_copy_only=False)), np.int64, len(keys)) % OTHERS


def look_up(words: pa.Array, known: pa.Array, others: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Where each word stands in ``known``, or ``others`` and its bucket; keys of those not known, and which these are."""
    found = pc.index_in(words, known)
    unknown = found.is_null().to_numpy(zero_copy_only=False)
    at = found.fill_null(0).to_numpy().astype(np.int64)
    keys = keys_of(words.filter(pa.array(unknown)))
    at[unknown] = others + buckets_of(keys)
    return at, keys, unknown


def bundles_for(column: pa.Array, known: pa.Array) -> Iterator[pa.Array]:
    """Slices of a column of texts whose words are looked up in ``known``."""
    return bundles(column, max(BUNDLE, FOR_EACH * len(known)))


def windows(texts_of_ids: Iterator[np.ndarray], size: int, edge: int) -> Iterator[np.ndarray]:
    """The texts one after the other, edges before, between and behind them, in stretches.

    A stretch has up to ``size`` places to predict and SIDE more at either end, so that every word
    of every text is to be predicted in one stretch, with its neighbours.
    """
    gap = np.full(SIDE, edge, np.int64)
    held, have = [gap], SIDE
    for ids in texts_of_ids:
        held += [ids, gap]
        have += len(ids) + SIDE
        if have >= size + 2 * SIDE:
            stream = np.concatenate(held)
            while len(stream) >= size + 2 * SIDE:
                yield stream[: size + 2 * SIDE]
                stream = stream[size:]
            held, have = [stream], len(stream)
    stream = np.concatenate(held)
    if len(stream) > 2 * SIDE:
        yield stream


def ones(n: int) -> np.ndarray:
    return ONES[:n] if n <= len(ONES) else np.ones(n, np.float32)


def pieces(h: np.ndarray, weights: np.ndarray) -> Iterator[slice]:
    """Slices of the rows of ``h`` of which ``h @ weights`` has about CACHED numbers."""
    size = max(1, CACHED // weights.shape[1])
    for start in range(0, len(h), size):
        yield slice(start, start + size)


def bounded(weights: np.ndarray) -> bool:
    """Whether exponentials of what ``weights`` make of numbers from -1 to 1 are surely in range."""
    return bool(np.abs(weights).sum(axis=-2).max() < SAFE)


def exponentials(x: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in proportion to the softmax of ``x``, in its place, and their sum in each row.

    Unless what made ``x`` is ``safe``, each row's greatest value is taken off first.
    """
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    return x, x @ ones(x.shape[1])


def log_probability_of(h: np.ndarray, weights: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of each row's softmax at one place."""
    out = np.empty(len(h), h.dtype)
    for own in pieces(h, weights):
        x, total = exponentials(h[own] @ weights, safe)
        there = x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at[own]]
        out[own] = np.log(np.maximum(there, TINY)) - np.log(total)
    return out


def backward(h: np.ndarray, weights: np.ndarray, at: np.ndarray, safe: bool, dh: np.ndarray) -> np.ndarray:
    """The gradient of the summed log-probabilities by the weights; that by ``h`` is added to ``dh``."""
    gradient = None
    for own in pieces(h, weights):
        x, total = exponentials(h[own] @ weights, safe)
        x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at[own]] -= total
        # what each row was multiplied by is taken out of the narrow side of the products
        scale = (1 / total)[:, None]
        dh[own] += (x @ weights[:HIDDEN].T) * scale
        more = (x.T @ (h[own] * scale)).T
        gradient = more if gradient is None else gradient + more
    return np.ascontiguousarray(gradient)


def backward_of(h: np.ndarray, weights: np.ndarray, groups: list[tuple[int, slice]], at: np.ndarray, safe: bool, dh: np.ndarray) -> np.ndarray:
    """``backward`` of several small classes, whose rows share what can be done for all at once."""
    x = np.empty((len(h), weights.shape[2]), np.result_type(h, weights))
    for c, own in groups:
        np.matmul(h[own], weights[c], out=x[own])
    x, total = exponentials(x, safe)
    x.reshape(-1)[np.arange(0, x.size, x.shape[1]) + at] -= total
    scale = (1 / total)[:, None]
    scaled, back = h * scale, np.empty(dh.shape, x.dtype)
    gradients = np.empty((len(groups), *weights.shape[1:]), x.dtype)
    for k, (c, own) in enumerate(groups):
        np.matmul(x[own], weights[c, :HIDDEN].T, out=back[own])
        np.matmul(scaled[own].T, x[own], out=gradients[k])
    back *= scale
    dh += back
    return gradients


def sums_of_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the rows from each of ``first`` up to the next: long runs one by one, short ones together."""
    lengths = np.diff(np.append(first, len(rows)))
    out = rows[first]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        run = rows[first[i] : first[i] + lengths[i]]
        out[i] = ones(len(run)) @ run
    for k in range(1, SHORT):
        more = np.flatnonzero((lengths > k) & (lengths <= SHORT))
        out[more] += rows[first[more] + k]
    return out


def hidden(p: dict, stream: np.ndarray) -> np.ndarray:
    """The hidden layer at all places but the SIDE at either end, behind it a one for the biases."""
    n = len(stream) - 2 * SIDE
    rows = p["words"].take(stream, axis=0)
    total = np.repeat(p["bias"][None], n, axis=0)
    for k, i in enumerate(AROUND):
        total += rows[SIDE + i : SIDE + i + n, k * HIDDEN : (k + 1) * HIDDEN]
    out = np.ones((n, HIDDEN + 1), np.float32)
    np.tanh(total, out=out[:, :HIDDEN])
    return out


def places_in_order(stream: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretch's places in order of their words; and those to be predicted, counted from SIDE."""
    order = np.argsort(stream)
    inner = order[: np.searchsorted(stream[order], edge)]  # the edge is the greatest id
    inner = inner[(inner >= SIDE) & (inner < len(stream) - SIDE)] - SIDE
    return order, inner


def by_class(cls: np.ndarray, classes: int) -> Iterator[tuple[int, slice]]:
    """Each class that occurs with its places in ``cls``, which is sorted."""
    bounds = np.searchsorted(cls, np.arange(classes + 1)).tolist()
    for c, (start, stop) in enumerate(pairwise(bounds)):
        if start < stop:
            yield c, slice(start, stop)


def stretches(cls: np.ndarray, classes: int) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """Stretches of ``cls``, which is sorted, and the classes in each with their places there.

    A stretch has one class, or several of which a softmax has about CACHED numbers.
    """
    size = max(1, CACHED // classes)
    start, stop, groups = 0, 0, []
    for c, own in by_class(cls, classes):
        if groups and own.stop - start > size:
            yield slice(start, stop), groups
            start, groups = own.start, []
        stop = own.stop
        groups.append((c, slice(own.start - start, stop - start)))
    if groups:
        yield slice(start, stop), groups


def log_probabilities(p: dict, stream: np.ndarray) -> np.ndarray:
    """Log-probability of each word given the words on both its sides; 0 for edges and the SIDE places at either end."""
    classes = p["classes"].shape[1]
    _, inner = places_in_order(stream, classes * classes - 1)
    h = hidden(p, stream)[inner]
    cls, place = np.divmod(stream[inner + SIDE], classes)
    found = log_probability_of(h, p["classes"], cls, bounded(p["classes"])).astype(np.float64)
    safe = bounded(p["places"])
    for c, own in by_class(cls, classes):
        found[own] += log_probability_of(h[own], p["places"][c], place[own], safe)
    out = np.zeros(len(stream))
    out[inner + SIDE] = found
    return out


class Trainer:
    """Stochastic gradient steps with Adagrad on one task's documents."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = {k: v.copy() for k, v in parameters.items()}
        self.squares = {k: np.ones(v.shape, np.float32) for k, v in parameters.items()}
        self.seen = 0

    def update(self, name: str, at, grad: np.ndarray) -> None:
        squares = self.squares[name][at]
        squares += grad * grad
        if isinstance(at, np.ndarray):  # else ``squares`` is a view
            self.squares[name][at] = squares
        grad *= RATE
        grad /= np.sqrt(squares)
        self.p[name][at] -= grad

    def step(self, stream: np.ndarray) -> None:
        """Predict every word of a stretch."""
        p, n = self.p, len(stream) - 2 * SIDE
        classes = p["classes"].shape[1]
        order, inner = places_in_order(stream, classes * classes - 1)
        m = len(inner)
        if not m:
            return
        self.seen += m
        h = hidden(p, stream)[inner]
        cls, place = np.divmod(stream[inner + SIDE], classes)
        dh = np.zeros((m, HIDDEN), np.float32)
        self.update("classes", slice(None), backward(h, p["classes"], cls, bounded(p["classes"]), dh))
        safe = bounded(p["places"])
        for own, groups in stretches(cls, classes):  # only the classes that occur
            first, last = groups[0][0], groups[-1][0]
            if first == last:
                self.update("places", first, backward(h[own], p["places"][first], place[own], safe, dh[own]))
                continue
            gradients = backward_of(h[own], p["places"], groups, place[own], safe, dh[own])
            if last - first < len(groups):
                self.update("places", slice(first, last + 1), gradients)
            else:
                for (c, _), gradient in zip(groups, gradients, strict=True):
                    self.update("places", c, gradient)
        h = h[:, :HIDDEN]
        dh *= 1 - h * h
        self.update("bias", slice(None), dh.sum(axis=0))
        # what each place's word has to do with the places around it, summed by word
        back = np.zeros((n, HIDDEN), np.float32)
        back[inner] = dh
        shares = np.zeros((len(stream), 2 * SIDE * HIDDEN), np.float32)
        for k, i in enumerate(AROUND):
            shares[SIDE + i : SIDE + i + n, k * HIDDEN : (k + 1) * HIDDEN] = back
        ids = stream[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        self.update("words", ids[first], sums_of_runs(shares.take(order, axis=0), first))


def pack(p: dict[str, np.ndarray], weight: int) -> bytes:
    return pickle.dumps((weight, {k: (v * np.float32(1)).astype(np.float32) for k, v in p.items()}))


def average(blobs: list[bytes]) -> bytes:
    """The mean of parameter sets, each weighed by the positions it was trained on."""
    total, weight = None, 0
    for blob in blobs:
        n, p = pickle.loads(blob)
        own = {k: v.astype(np.float64) * n for k, v in p.items()}
        total = own if total is None else {k: total[k] + own[k] for k in total}
        weight += n
    return pickle.dumps((weight, {k: (v / max(weight, 1)).astype(np.float32) for k, v in total.items()}))


def train(docs: DataFrame, words: list[bytes], rounds: int = 2, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters trained on every word of ``docs``.

    A checksum of its bytes deals each text to one of the rounds, in which all of its words are
    predicted. In each round every task trains from the shared parameters on its own documents, and
    the results are averaged, a few at a time, weighed by how many words each has predicted; so
    they depend on how the documents are dealt to tasks.
    """
    classes = classes_for(len(words))
    edge = classes * classes - 1
    parameters = new_parameters(seed, classes)
    fan_in = max(2, min(16, AVERAGED // sum(v.nbytes for v in parameters.values())))
    context = docs.sparkSession.sparkContext
    for own_round in range(rounds):
        sent = context.broadcast((parameters, words))

        def fit(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer, known = Trainer(sent.value[0]), pa.array(sent.value[1], pa.binary())

            def codes() -> Iterator[np.ndarray]:
                for batch in batches:
                    for bundle in bundles_for(batch.column(0), known):
                        found, ends = words_in(bundle)
                        yield from np.split(look_up(found, known, edge - OTHERS)[0], ends[:-1])

            for stream in windows(codes(), MINIBATCH, edge):
                trainer.step(stream)
            yield from emit_summary(pack(trainer.p, trainer.seen) if trainer.seen else None)

        own = docs.filter(F.crc32("text") % rounds == own_round).select("text")
        merged = merge_summaries(own.mapInArrow(fit, SUMMARY), average, fan_in)
        if merged:
            parameters = pickle.loads(merged)[1]
        sent.unpersist()
    return parameters


COUNT = "word binary, n long"


def count_words(docs: DataFrame) -> DataFrame:
    """How often each word occurs in all texts: word (its key), n, level (eight to a doubling of n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(words: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(pa.chunked_array(words, pa.binary()).value_counts().flatten(), ["word", "n"])

        held, have = [], 0
        for batch in batches:
            for bundle in bundles(batch.column(0), BUNDLE):
                held.append(keys_of(words_in(bundle)[0]))
                have += len(held[-1])
                if have > COUNTED:
                    yield rows(held)
                    held, have = [], 0
        yield rows(held)

    counts = docs.select("text").mapInArrow(count, COUNT).groupBy("word").agg(F.sum("n").alias("n"))
    return materialise(counts.withColumn("level", F.floor(F.log2("n") * 8)), "words")


def vocabulary(counts: DataFrame) -> tuple[list[bytes], list[bytes], np.ndarray, np.ndarray]:
    """Frequent words, words known beyond them, the known ones' counts, and the counts of buckets.

    There are as many frequent words as the square root of the number of all words, or FREQUENT if
    that is more; whole levels of counts are taken as long as they fit.
    """
    short = F.length("word") <= LONGEST
    short &= F.substring("word", 1, 1) != F.lit(b" ")
    levels = counts.groupBy("level").agg(F.sum(short.cast("long")).alias("words"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()

    def lowest(most: int) -> int:
        low, have = 1 << 30, 0
        for r in levels:
            have += r["words"]
            if have > most:
                break
            low = r["level"]
        return low

    total = sum(r["n"] for r in levels)
    frequent = short & (F.col("level") >= lowest(max(FREQUENT, math.isqrt(total))))
    known = short & (F.col("level") >= lowest(max(KNOWN, FREQUENT, math.isqrt(total))))
    rows = counts.filter(known).select("word", "n", frequent.alias("frequent")).collect()
    rows = sorted(((bytes(r["word"]), r["n"], r["frequent"]) for r in rows), key=lambda r: (not r[2], -r[1], r[0]))
    buckets = np.zeros(OTHERS)
    for r in counts.filter(~frequent).groupBy((F.crc32("word") % OTHERS).alias("b")).agg(F.sum("n").alias("n")).collect():
        buckets[r["b"]] = r["n"]
    more = [(w, n) for w, n, f in rows if not f]
    return [w for w, _, f in rows if f], [w for w, _ in more], np.array([n for _, n in more], float), buckets


#: The logarithms of counts are summed as whole numbers, so that the order of rows doesn't matter.
UNIT = 1 << 30
SCORE = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("log_probability", T.DoubleType()),
    T.StructField("rare", T.ArrayType(T.BinaryType())),
])


def scorer(spark, parameters: dict[str, np.ndarray], words: list[bytes], more: list[bytes], counts: np.ndarray, buckets: np.ndarray):
    """A column function from text to its number of words, their summed log-probability and its rare words.

    A word outside the vocabulary has its bucket's probability times its share in the bucket's
    occurrences. Of words neither in ``words`` nor in ``more`` the logarithm of the count is still
    to be added; these are the rare ones.
    """
    sent = spark.sparkContext.broadcast((parameters, words, more, counts, buckets))

    @F.arrow_udf(SCORE)
    def score(text: pa.Array) -> pa.Array:
        p, words, more, counts, buckets = sent.value
        edge = len(p["words"]) - 1
        known = pa.array([*words, *more], pa.binary())
        own_bucket = buckets_of(known[len(words) :])
        # of the known words, then of each bucket's others
        id_of = np.concatenate([np.arange(len(words)), edge - OTHERS + own_bucket, np.arange(edge - OTHERS, edge)])
        whole = np.log(np.maximum(buckets, 1))
        share = np.concatenate([np.zeros(len(words)), np.log(counts) - whole[own_bucket], -whole])
        n_words, sums, n_rare, rare = [np.empty(0, np.int64)], [np.empty(0)], [np.zeros(1, np.int64)], []
        for bundle in bundles_for(text, known):
            found, ends = words_in(bundle)
            at, keys, unknown = look_up(found, known, len(known))
            size = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(len(bundle)), size)
            # each stretch without its last places, which the next one begins with
            values = [log_probabilities(p, stream)[SIDE:-SIDE] for stream in windows(np.split(id_of[at], ends[:-1]), PIECE, edge)]
            values = np.concatenate([np.empty(0), *values])[np.arange(len(at)) + SIDE * owner] + share[at]
            sums.append(np.bincount(owner, values, len(bundle)))
            n_words.append(size)
            n_rare.append(np.bincount(owner[unknown], minlength=len(bundle)))
            rare.append(keys)
        ends = pa.array(np.cumsum(np.concatenate(n_rare)), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.chunked_array(rare, pa.binary()).combine_chunks())
        n_words, sums = np.concatenate(n_words), np.concatenate(sums)
        return pa.StructArray.from_arrays([pa.array(n_words), pa.array(sums), lists], ["n_words", "log_probability", "rare"])

    return score


def score_documents(docs: DataFrame, rounds: int = 2, seed: int = 11) -> DataFrame:
    """Train on all texts of ``docs`` and score each: doc_id, n_words, log_probability, per_word.

    ``log_probability`` sums, over all words of the whole text, the log-probability of the word
    given two words on each side; ``per_word`` is its mean. Words outside the vocabulary share hash
    buckets: such a word has the probability of its bucket times its share in all occurrences of the
    bucket's words. Null and empty texts have no words, sum 0 and a null mean. Words are told apart
    without regard to the case of A-Z. Repeated rows get the same score but for the rounding of
    32-bit products; an empty table gives no rows; other columns are not read.
    """
    counts = count_words(docs)
    words, more, known, buckets = vocabulary(counts)
    parameters = train(docs, words, rounds, seed)
    score = scorer(docs.sparkSession, parameters, words, more, known, buckets)
    scored = materialise(
        docs.select("doc_id", score("text").alias("s"))
        .select("doc_id", "s.n_words", "s.log_probability", "s.rare").withColumn("row", F.monotonically_increasing_id()),
        "scored",
    )
    rare = scored.select("row", F.explode("rare").alias("word"))
    # words that occur once have the logarithm 0
    logs = rare.join(counts.filter("n > 1").select("word", F.round(F.log("n") * UNIT).cast("long").alias("log_n")), "word")
    logs = logs.groupBy("row").agg((F.sum("log_n") / UNIT).alias("logs"))
    whole = scored.drop("rare").join(logs, "row", "left").withColumn("log_probability", F.col("log_probability") + F.coalesce("logs", F.lit(0.0)))
    return whole.select(
        "doc_id", "n_words", "log_probability",
        F.when(F.col("n_words") > 0, F.col("log_probability") / F.col("n_words")).alias("per_word"),
    )


def op1_pseudo_likelihood(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))

"""The trie of conversations' turns, from their sorted order.

Conversations are put in order by their turns over the whole table. Of every beginning of every
conversation, the first and the last conversation that share it are found by binary search, each on its
own, over a sparse table of the minima of what neighbours share: that interval is a node of the trie. A
task knows whole those nodes that neither its first nor its last conversation belongs to; the nodes on
these two paths go up, with what hangs below them summed, and are joined by the same search.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import WORD_PATTERN, join_keyed, materialise, table

#: Characters of a turn's digest, and tasks whose paths are joined at once.
WIDTH, FAN = 20, 64
#: Conversations in one row of those that end at a node.
PIECE = 1 << 16
NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
FIELDS = {"kind": "string", "slot": "bigint", "key": "string", "parent_key": "string", **dict.fromkeys(NUMBERS, "bigint"), "ends_sha256": "string", "path": "string"}
FIELDS |= dict.fromkeys(("words", "sums", "ids"), "array<bigint>")
NODE = ", ".join(f"{name} {kind}" for name, kind in FIELDS.items())
KINDS = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
SCHEMA = pa.schema([(name, KINDS[kind]) for name, kind in FIELDS.items()])
#: What a path carries for each of its nodes: members, the smallest of them, and sums over what is known below.
N, LOW, KIDS, LEAVES, SAVED = range(5)
NO_CONV = np.iinfo(np.int64).max


def numbered(paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The turns of all paths as numbers, a root before each path's first, and where the paths begin."""
    offsets = np.cumsum([0] + [len(p) // WIDTH + 1 for p in paths])
    data = "".join(paths).encode()
    turns = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WIDTH), len(data) // WIDTH, [None, pa.py_buffer(data)])
    numbers = np.full(offsets[-1], -1, np.int64)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[:-1]] = False
    numbers[inner] = turns.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return numbers, offsets


def shared(numbers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many turns, root included, each path shares with the one before it; 0 for the first."""
    sizes = np.diff(offsets)
    out = np.zeros(len(sizes), np.int64)
    least = np.minimum(sizes[1:], sizes[:-1])
    at = np.arange(1, len(sizes))
    d = 0
    while len(at):
        at = at[least[at - 1] > d]
        at = at[numbers[offsets[at] + d] == numbers[offsets[at - 1] + d]]
        out[at] += 1
        d += 1
    return out


def extents(lcp: np.ndarray, item: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last path around each ``item`` between which all neighbours share ``need`` turns."""
    n = len(lcp)
    minima = [lcp]
    while 2 << (len(minima) - 1) <= n:
        half = 1 << (len(minima) - 1)
        minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
    left, right = item.copy(), item.copy()
    for k in range(len(minima) - 1, -1, -1):
        step, least = 1 << k, minima[k]
        at = right + 1
        right += np.where((at + step <= n) & (least[np.minimum(at, len(least) - 1)] >= need), step, 0)
        at = left - step + 1
        left -= np.where((at >= 1) & (least[np.maximum(at, 0)] >= need), step, 0)
    return left, right


def key_of(path: str, depth: int) -> str:
    return sha256(path[: depth * WIDTH].encode()).hexdigest()


def ends_digest(ids: list[int]) -> str:
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


def join_paths(paths: list[str], words: np.ndarray, sums: np.ndarray, slot: int, final: bool, ends: np.ndarray | None = None) -> pa.Table:
    """The nodes of sorted paths that are whole here, and for the rest the first and the last path.

    ``words`` and ``sums`` have a column for each turn of each path, root included. ``ends`` are the
    conversations of the paths, where these are conversations themselves. With ``final`` all nodes are whole.
    """
    numbers, offsets = numbered(paths)
    sizes = np.diff(offsets)
    item = np.repeat(np.arange(len(paths)), sizes)
    depth = np.arange(len(item)) - offsets[item]
    left, right = extents(shared(numbers, offsets), item, depth + 1)
    place = offsets[left] + depth
    nodes = np.flatnonzero(left == item)  # in preorder: a node's subtree follows it
    at = np.empty(len(item), np.int64)
    at[nodes] = np.arange(len(nodes))
    node = at[place]
    total = np.zeros((5, len(nodes)), np.int64)
    total[LOW] = NO_CONV
    for k in (N, KIDS, LEAVES, SAVED):
        np.add.at(total[k], node, sums[k])
    np.minimum.at(total[LOW], node, sums[LOW])
    depth_, words_, item_ = depth[nodes], words[nodes], item[nodes]
    parent = np.where(depth_ > 0, node[nodes - 1], -1)
    whole = np.full(len(nodes), True) if final else (item_ > 0) & (right[nodes] < len(paths) - 1)
    np.add.at(total[KIDS], parent[whole & (parent >= 0)], 1)
    total[LEAVES] += whole & (total[KIDS] == 0)
    total[SAVED] += np.where(whole, (total[N] - 1) * words_, 0)
    after = np.searchsorted(nodes, offsets[right[nodes] + 1])
    below = {k: np.append(0, np.cumsum(total[k])) for k in (LEAVES, SAVED)}
    below = {k: s[after] - s[: len(nodes)] for k, s in below.items()}

    done = np.flatnonzero(whole)
    above = parent[done]
    hangs = (above >= 0) & ~whole[above]
    out = {name: pa.nulls(len(done), kind) for name, kind in zip(SCHEMA.names, SCHEMA.types, strict=True)}
    out["kind"] = pa.array(["node"] * len(done), pa.string())
    out["parent_key"] = pa.array([key_of(paths[item_[i]], depth_[i] - 1) if h else None for i, h in zip(done.tolist(), hangs.tolist(), strict=True)], pa.string())
    out["parent_conv_id"] = pa.array(total[LOW][above], mask=hangs | (above < 0))
    if ends is None:
        out["key"] = pa.array([key_of(paths[item_[i]], depth_[i]) for i in done.tolist()], pa.string())
    for name, values in (("conv_id", total[LOW]), ("depth", depth_), ("n_convs", total[N]), ("n_children", total[KIDS]), ("n_leaves", below[LEAVES]), ("saved_tokens", below[SAVED])):
        out[name] = pa.array(values[done])
    tables = []
    if ends is not None:
        # who ends at a node stands first among its members, in order of number
        count = np.bincount(node[offsets[1:] - 1], minlength=len(nodes))
        out["ends_sha256"] = pa.array([ends_digest(ends[item_[i] : item_[i] + count[i]].tolist()) for i in done.tolist()], pa.string())
        for i in np.flatnonzero(~whole & (count > 0)).tolist():
            own, key = ends[item_[i] : item_[i] + count[i]], key_of(paths[item_[i]], depth_[i])
            tables += [rows(kind="ends", key=key, ids=own[a : a + PIECE].tolist()) for a in range(0, len(own), PIECE)]
    tables.append(pa.table(out, SCHEMA))
    if not final:
        # what hangs whole below a node of a path is summed at that node
        under = done[hangs]
        for k, s in below.items():
            np.add.at(total[k], parent[under], s[under])
        for i in dict.fromkeys((0, len(paths) - 1)):
            places = slice(offsets[i], offsets[i + 1])
            own = total[:, node[places]]
            if i:
                own[:, left[places] == 0] = np.array([[0], [NO_CONV], [0], [0], [0]])
            tables.append(rows(kind="path", slot=slot, path=paths[i], words=words[places].tolist(), sums=own.ravel().tolist()))
    return pa.concat_tables(tables)


def joined_tries(group: pa.Table) -> pa.Table:
    """The nodes that the paths of neighbouring tasks make together."""
    return joined(group, False)


def finished_trie(group: pa.Table) -> pa.Table:
    """The nodes that the last paths make."""
    return joined(group, True)


def rows(**values) -> pa.Table:
    return pa.Table.from_pylist([values], SCHEMA)


def local_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of this task's sorted conversations."""
    from pyspark import TaskContext

    whole = [b for b in batches if b.num_rows]
    if not whole:
        return
    own = pa.Table.from_batches(whole).combine_chunks()
    paths, conv = own["path"].to_pylist(), own["conv_id"].to_numpy()
    sizes = own["words"].combine_chunks().value_lengths().to_numpy()
    words = np.insert(own["words"].combine_chunks().flatten().to_numpy(), np.cumsum(sizes) - sizes, 0)
    sums = np.zeros((5, len(words)), np.int64)
    sums[N] = 1
    sums[LOW] = np.repeat(conv, sizes + 1)
    yield from join_paths(paths, words, sums, TaskContext.get().partitionId(), False, conv).to_batches()


def joined(group: pa.Table, final: bool) -> pa.Table:
    # a task's first path is not behind its last one
    own = sorted(group.to_pylist(), key=lambda r: (r["slot"], r["path"]))
    words = np.concatenate([r["words"] for r in own]).astype(np.int64)
    sums = np.concatenate([np.array(r["sums"], np.int64).reshape(5, -1) for r in own], axis=1)
    return join_paths([r["path"] for r in own], words, sums, own[0]["slot"] // FAN, final)


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each key from its pieces in order; of all pieces one at a time is held."""
    key, state = None, sha256()
    for batch in batches:
        done = []
        for own, ids in zip(batch["key"].to_pylist(), batch["ids"], strict=True):
            if own != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, sha256()
            else:
                state.update(b",")
            state.update(",".join(map(str, ids.as_py())).encode())
        yield pa.RecordBatch.from_pylist([{"key": k, "own_ends": e} for k, e in done], pa.schema([("key", pa.string()), ("own_ends", pa.string())]))
    if key is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "own_ends": state.hexdigest()}])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns``, an array of (digest, words) for each conv_id.

    ``digest`` has 20 characters and stands for a turn, ``words`` is the number of words of its text. Returns
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 for each node, the root included. Null arrays count as empty; rows with a null conv_id take no
    part; an empty table has no node. Each row is a member of its own, even if a conv_id occurs twice. Other columns
    are not read. A group of equal sequences is cut where a task is full, and its members' numbers are
    hashed one piece after the other. A task holds its share of the sorted table; a sequence is one row.
    """
    spark = sequences.sparkSession
    none = F.array().cast("array<bigint>")
    paths = sequences.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.array_join(F.transform("turns", lambda t: t["digest"]), ""), F.lit("")).alias("path"),
        F.coalesce(F.transform("turns", lambda t: t["words"].cast("bigint")), none).alias("words"),
    )
    by = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = paths.repartitionByRange(by, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    level = materialise(ordered.mapInArrow(local_tries, NODE), "trie")
    levels, slots = [level], by
    while True:
        final = slots <= FAN
        grouped = level.filter("kind = 'path'").groupBy(F.expr(f"slot div {FAN}"))
        level = materialise(grouped.applyInArrow(finished_trie if final else joined_tries, NODE), "trie")
        levels.append(level)
        if final:
            break
        slots = -(-slots // FAN)
    # nodes that were whole in one task know all but, perhaps, their parent; the few others get their ends, too
    columns = [*NUMBERS, "ends_sha256"]
    late = levels[1]
    for other in levels[2:]:
        late = late.unionByName(other)
    pieces = levels[0].filter("kind = 'ends'").select("key", "ids").repartition(by, "key").sortWithinPartitions("key", F.col("ids")[0])
    ends = pieces.mapInArrow(hashed_ends, "key string, own_ends string")
    late = late.filter("kind = 'node'").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("own_ends", F.lit(ends_digest([]))))
    late = late.select("key", "parent_key", *columns)
    nodes = levels[0].filter("kind = 'node'").select("key", "parent_key", *columns).unionByName(late)
    parents = late.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"), F.col("n_children").alias("n"))
    hung = join_keyed(nodes.filter("parent_key IS NOT NULL"), parents, "parent_key")
    known = nodes.filter("parent_key IS NULL").select(columns)
    return known.unionByName(hung.withColumn("parent_conv_id", F.col("above")).select(columns))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, the array of (digest, words) of each conversation in order of ``turn``, null first.

    Null roles and texts are empty. Equal turns of a conversation, repeated rows too, are all kept, by role and then
    by the SHA-256 of role and text, which spares the shuffle their texts. Rows with a null conv_id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH * 3 // 4)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD_PATTERN)).alias("words")).alias("t"),
    )
    return turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(F.base64(t["digest"]).alias("digest"), t["words"])).alias("turns"))


def with_shared_openings(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``sequences`` rebuilt: the first h turns are those of the conversation before it that ``every`` divides.

    h is a checksum of conv_id below ``most``; where that conversation is shorter or absent, there are fewer.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = sequences.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0))
    rows_ = sequences.withColumn("base", base).join(heads, "base", "left")
    return rows_.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the conversations as they are; see there and at ``turn_sequences`` for odd rows."""
    return prefix_trie(turn_sequences(conversations))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(with_shared_openings(turn_sequences(table(spark, sf_dir, "conversations"))))


ORACLE = r"""
WITH bits AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) r(i)
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), numbered AS (
  SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda s, b: xor(s // 256, t[(xor(s, b) % 256) + 1])), 4294967295) % 4 AS h
  FROM own, crc
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS seq
  FROM numbered a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), prefixes AS (
  SELECT conv_id, seq, d, seq[1:d] AS path FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(seq) = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY path, d
), kids AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT path[1:k] AS path, k AS d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves
  FROM (SELECT m.path, m.saved, x.n IS NULL AS leaf, unnest(range(m.d + 1)) AS k FROM nodes m LEFT JOIN kids x ON x.path = m.path AND x.d = m.d) GROUP BY ALL
)
SELECT m.conv_id, m.d AS depth, p.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM nodes m JOIN below b ON b.path = m.path AND b.d = m.d LEFT JOIN kids k ON k.path = m.path AND k.d = m.d
LEFT JOIN nodes p ON m.d > 0 AND p.d = m.d - 1 AND p.path = m.path[1:m.d - 1]
"""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from wayside.llm import trie
from wayside.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def literal_trie(rows, shared=True):
    """Every beginning of every conversation in a dictionary."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (*t[:3], digest(t)))] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        seqs[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    saved = {p: (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0 for p, m in members.items()}
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            sums[p[:d]] += saved[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], sums[p], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(4 * n), n):
        kind = rnd.random()
        texts = ["hello there", "same  for all"] * 3 if kind < 0.3 else [rnd.choice(["a b c", "d", "", " \t", None, "e f"]) for _ in range(rnd.randint(1, 7))]
        rows += [(c, rnd.choice([k, k, None, 1]) if kind > 0.8 else k, rnd.choice(["user", "system", None]) if kind > 0.9 else "user", t, "x") for k, t in enumerate(texts)]
    rows += rows[:9] + [(None, 1, "user", "x", None)]
    rnd.shuffle(rows)
    return rows


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("seed", "partitions"), [(1, 1), (1, 7), (2, 70)])  # 70 tasks are joined in two levels
def test_trie_equals_the_literal_definition(spark, seed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = conversations(seed)
        docs = spark.createDataFrame(rows, SCHEMA)
        assert result(trie.conversation_trie(docs)) == literal_trie(rows, shared=False)
        assert result(trie.prefix_trie(trie.with_shared_openings(trie.turn_sequences(docs)))) == literal_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_one_and_long_conversations(spark):
    assert result(trie.conversation_trie(spark.createDataFrame([], SCHEMA))) == []
    rows = [(c, t, "user", f"turn {t}", None) for c in (40, 41, 42, 7) for t in range(300 if c > 40 else 2)]
    assert result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == literal_trie(rows, shared=False)
    # a conversation none of whose own turns is left, and whose base is absent
    rows = [(25, 1, "user", "gone", None)] * (zlib.crc32(b"25") % 4 > 0) + [(26, t, None, None, None) for t in range(5)]
    got = trie.prefix_trie(trie.with_shared_openings(trie.turn_sequences(spark.createDataFrame(rows, SCHEMA))))
    assert result(got) == literal_trie(rows)


def test_pieces_of_ends(spark, monkeypatch):
    rows = [(c, 1, "user", "copy", None) for c in range(500)]
    monkeypatch.setattr(trie, "PIECE", 7)
    assert result(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == literal_trie(rows, shared=False)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = trie.op11_prefix_trie(spark, sf)
    want = con.sql(trie.ORACLE)
    assert got.columns == want.columns
    assert result(got) == sorted(want.fetchall(), key=str) == literal_trie(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect())

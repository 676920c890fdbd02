import hashlib
import random
import zlib

import pytest

from wayside.llm import periodic
from wayside.llm.common import table


def literal_runs(w, least=6, exponent=4):
    """Every stretch of one period that no neighbour extends, those with smaller periods first."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def literal_row(doc_id, text):
    w = [x for x in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = literal_runs(w)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(kept))


def random_words(rnd):
    w = []
    while len(w) < rnd.randint(0, 60):
        part = [rnd.choice(b"abc") for _ in range(rnd.randint(1, 4))]
        w += part * rnd.choice([1, 1, 3, 4, 5, 9])
    return [bytes([c]) for c in w]


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (3, 3), (12, 5), (1, 4)])
def test_runs_of_random_texts(least, exponent):
    rnd = random.Random(least)
    texts = [random_words(rnd) for _ in range(1500)]
    found = periodic.runs_of(texts, least, exponent)
    for text, rows in zip(texts, found, strict=True):
        assert [tuple(r) for r in rows.tolist()] == literal_runs(text, least, exponent), text


def test_few_periods_are_refused(spark):
    with pytest.raises(ValueError, match="three periods"):
        periodic.periodic_runs(table(spark, "/root/testdata/sf0.001", "documents"), exponent=2)


def test_digests_equal_the_literal_definition(spark):
    texts = [None, "", " \n", "a", "a " * 6, "x a a a a a", "a b " * 4 + "a", "\tone\x0btwo " * 9, "é ü é ü é ü é ü", "a\xa0b " * 7, "a b c " * 5 + "a b c d " * 6]
    texts += [" ".join(w.decode() for w in random_words(random.Random(i))) for i in range(120)] + ["la di da " * 400, "z"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b " * 8, None, None), (4, "a " * 6, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = [tuple(r) for r in periodic.digests(periodic.with_planted_runs(docs)).collect()]
    assert sorted(got, key=str) == sorted((literal_row(r[0], r[1]) for r in rows), key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.digests(periodic.with_planted_runs(empty)).collect() == []


def test_query_equals_the_literal_definition(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in periodic.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [r for r in docs if len(r.text) < 8000]
    assert len(got) == len(docs)
    assert [got[r.doc_id] for r in short] == [literal_row(r.doc_id, r.text) for r in short]


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "a " * 200_000), (2, "b c " * 100_000 + "d"), (3, " ".join(map(str, range(200_000))))], "doc_id long, text string")
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic.periodic_runs(docs).collect()}
    assert got == {1: [(0, 200_000, 1)], 2: [(0, 200_000, 2)], 3: []}

import random

from wayside.llm import neardup
from wayside.llm.common import table


def brute_force(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for own in where.values() for n, a in enumerate(own) for b in own[:n]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((d, len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def test_crowded_family(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(250):
        own = list(base)
        for _ in range(rnd.randint(1, 9)):
            own[rnd.randrange(len(own))] = word()
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == brute_force(rows)


def test_equals_brute_force(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == brute_force(rows)


def test_chains_copies_and_odd_texts(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(150):  # a drifting chain of near copies around one text
        own = list(base if rnd.random() < 0.5 else texts[rnd.randrange(len(texts))].split())
        for _ in range(rnd.randint(0, 3)):
            own[rnd.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(base).upper()] * 30 + [None, "", " \n ", "a b", "A  b", "a b c d e", "a b c d e f"] * 2
    rows = [(i + 5, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    assert sorted(map(tuple, neardup.near_duplicates(docs).collect())) == brute_force(rows)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c")], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=repr)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (None, 1, None, True)]
    assert neardup.drop_near_duplicates(docs).count() == 3

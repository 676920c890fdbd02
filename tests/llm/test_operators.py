import base64
import gzip
import hashlib
import math
import random
import urllib.parse

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayside.llm import ann, langid, lm, mixing, quality, secretscan, urls
from wayside.llm.common import table
from wayside.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rounded(v):
    return round(v, 9) if isinstance(v, float) else v


def against_sql(spark, query, sql, tables):
    con = duckdb.connect()
    for name, df in tables.items():
        rows = df.toPandas()
        con.register(f"_{name}", rows)
        con.sql(f"create table {name} as select * from _{name}")
    want = con.sql(sql)
    columns = sorted(query.columns)
    assert sorted(want.columns) == columns
    got = sorted((tuple(rounded(r[c]) for c in columns) for r in query.collect()), key=repr)
    assert got == sorted((tuple(rounded(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


ODD = [
    (1, None, "en", "b", None), (2, "", None, "b", 0), (3, " \n\t", "de", None, 3), (4, "one two three four five six seven eight nine ten", "en", "a", 48),
    (5, "x y z w v " * 30, "fr", "a", 300), (6, "same\nsame\n\nsame # $ |", "en", None, 20), (7, "é ü " * 40, "de", "é", 160), (7, "é ü " * 40, "de", "é", 160), (8, "w" * 5000, "en", "c", 5000),
]


@pytest.mark.parametrize("name", ["op2_host_reputation", "op5_mix", "op6_host_rules"])
def test_queries_equal_their_sql(spark, name):
    tables = {t: table(spark, SF, t) for t in ("documents", "pages", "labels")}
    against_sql(spark, QUERIES[name](spark, SF), ORACLE_SQL[name], tables)


def test_mixing_odd_documents(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    got = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.taken <= 3 * r.size for r in rows)
    by_source = {}
    for r in mixing.mix(docs).collect():
        by_source.setdefault(r.source, []).append(r)
    assert abs(sum(v[0].target for v in by_source.values()) - sum(r.size for r in rows)) < 1e-6
    assert all(v[0].target <= 3 * v[0].source_size for v in by_source.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=repr) == sorted(map(tuple, mixing.mix(docs).collect()), key=repr)
    assert mixing.mix(docs.limit(0)).collect() == []
    copies = mixing.mix_documents(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.repeats for r in mixing.mix(docs).collect())


def test_water_filling_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 100), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    # weights 1, 2, 3, 1 of 210: b stops at 30, the empty source at 0, a and c share 180 as 1 to 3
    assert got == {"a": 45.0, "b": 30.0, "c": 135.0, None: 0.0}


def test_quality_odd_documents(spark):
    docs = spark.createDataFrame([*ODD[:7], ODD[8]], DOCS)
    against_sql(spark, quality.judge_documents(docs), ORACLE_SQL["op6_host_rules"], {"documents": docs})
    assert quality.judge_documents(docs.limit(0)).collect() == []


def test_hosts_that_mostly_fail_are_rejected(spark):
    good = "the quick brown fox jumps over a lazy dog and then another one sleeps"
    rows = [(i, good if i % 10 else "bad", "en", "fine", 1) for i in range(100)] + [(100 + i, "bad" if i % 10 else good, "en", "farm", 1) for i in range(100)]
    kept = {r.doc_id for r in quality.judge_documents(spark.createDataFrame(rows, DOCS)).filter("kept").collect()}
    assert kept == {i for i in range(100) if i % 10}
    assert {r.doc_id for r in quality.keep_documents(spark.createDataFrame(rows, DOCS)).collect()} == kept


def brute_repeats(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, w in enumerate(wins) if wins.count(w) > 1 for k in range(5)})


def test_repeated_words_equal_brute_force():
    rnd = random.Random(2)
    for n in (0, 1, 5, 6, 10, 40, 200):
        words = [rnd.choice("abc") for _ in range(n)]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?q#f"), (2, "http://example.com/en/"), (3, "http://a.example.com/en"), (4, "https://m.org.net/es/1"), (5, "nothing"), (6, None), (7, "x://com/"), (8, "http://farm.co.uk#top"), (8, "http://farm.co.uk#top"), (9, "http://net"), (10, "a://b://c/d")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("x")).withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(8, 0, 1), (8, 0, 1), (1, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(pages, urls.labelled_outcomes(labels))
    against_sql(spark, got, ORACLE_SQL["op2_host_reputation"], {"pages": pages, "labels": labels})
    by = {r.page_id: r for r in got.collect()}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert by[2].verdict == "block" and by[3].rule == "com/" and by[4].rule == "net/es/" and (by[5].host, by[6].path) == ("", "")
    assert urls.judge_urls(pages.limit(0), urls.labelled_outcomes(labels)).collect() == []


def test_a_bad_host_is_blocked_and_its_domain_is_not(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 60 else 'good'}.site.org/{i}") for i in range(120)], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 60 < 50], "page_id long, bad int")
    got = urls.judge_urls(pages, outcomes).collect()
    assert all((r.verdict == "block") == (r.page_id < 60) for r in got)


SECRET = 'token = "abcdef0123456789"'


@pytest.mark.parametrize(
    "wrap",
    [
        urllib.parse.quote, lambda s: base64.b64encode(s.encode()).decode(), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
        lambda s: base64.b64encode(urllib.parse.quote(base64.b64encode(s.encode()).decode()).encode()).decode(), lambda s: urllib.parse.quote(urllib.parse.quote(s)),
    ],
)
def test_secrets_behind_encodings(wrap):
    text = f"Ünder {wrap(SECRET)} end"
    base, spans = secretscan.scan(text)
    assert base == [s for s in spans if text[s[0] : s[2]] == SECRET]
    assert any(kind == 0 and text.index("der") + 4 <= start < end <= len(text) - 4 for start, kind, end in spans)


@pytest.mark.parametrize("beside", ["\u00a0", "\u3000", "\u200b", "\u200d", "\f", "\0", "José "])
@pytest.mark.parametrize("code", ["utf-8", "utf-16-le", "latin-1"])
def test_secrets_beside_odd_characters(beside, code):
    data = beside.encode(code if code != "latin-1" or beside.isascii() or beside < "\u0100" else "utf-8") + b" token=abcdef123456 " + SECRET.encode()
    for wrapped in (urllib.parse.quote(data), base64.b64encode(data).decode(), base64.b64encode(gzip.compress(data)).decode()):
        text = f"before {wrapped} after"
        spans = [x for x in secretscan.scan(text)[1] if x[1] == 0]
        assert spans and all(7 <= a < b <= len(text) - 6 for a, _, b in spans)
    assert secretscan.scan("name=Jos%E9&token%3Dabcdef123456")[1][-1] == (12, 0, 32)


def test_secrets_in_wrapped_base64():
    data = ("some words before it, of 55 bytes, so that it breaks. " + SECRET + " and some more words that come after it, over lines").encode()
    for body, newline in [(data, "\n"), (gzip.compress(random.Random(2).randbytes(300) + data), "\r\n")]:
        lines = base64.encodebytes(body).decode().split()
        for text in (newline.join(lines), newline.join(["see an-identifier-before-it", *lines, "and more"])):
            spans = [x for x in secretscan.scan(text)[1] if x[1] == 0]
            assert spans and all(text[a:b].strip("=") for a, _, b in spans)
            if body is data:  # at its own place, across the break of lines
                a, _, b = spans[-1]
                assert b - a < 60 and newline in text[a:b] and b"abcdef" in base64.b64decode("".join(lines)[(a - text.index(lines[0])) // 4 * 4 :])[:40]


def test_secrets_in_large_streams(monkeypatch):
    whole = b"word " * 4_000_000 + SECRET.encode()
    text = base64.b64encode(gzip.compress(whole)).decode()
    assert (0, 0, len(text.rstrip("="))) in [(a, k, b - text.count("=", b - 2, b)) for a, k, b in secretscan.scan(text)[1]]
    monkeypatch.setattr(secretscan, "PIECE", 200)
    for shift in range(380, 420):  # across the first cut
        text = base64.b64encode(gzip.compress(b"." * shift + SECRET.encode() + b" ." * 900)).decode()
        assert any(k == 0 for _, k, _ in secretscan.scan(text)[1])


@pytest.mark.parametrize("wrapped", [False, True])
def test_long_encoded_stretches_across_pieces(monkeypatch, wrapped):
    """A secret far behind in base64 that is longer than the overlap, one line or many, in a layer of several pieces."""
    monkeypatch.setattr(secretscan, "PIECE", 1000)
    rnd = random.Random(1)
    for before, inside, after in ((10, 3000, 50), (1500, 6000, 4000), (1990, 9000, 9000), (5000, 700, 0)):
        body = bytes(rnd.choice(b"abc.,") for _ in range(inside)) + b' "' + SECRET.encode() + b'" ' + bytes(rnd.choice(b"abc.,") for _ in range(300))
        coded = base64.encodebytes(body) if wrapped else base64.b64encode(body)
        layer = b"plain " * (before // 6) + b"\n" + coded + b" " + b"more words " * (after // 11)
        text = base64.b64encode(gzip.compress(layer)).decode()
        assert any(k == 0 for _, k, _ in secretscan.scan(text)[1]), (before, inside, after)
        cut = base64.b64encode(gzip.compress(layer)[:-9]).decode()  # a stream without its end is searched as far as it goes
        assert isinstance(secretscan.scan(cut)[1], list)


def test_open_runs():
    assert secretscan._open_run(b"word word") == 5
    assert secretscan._open_run(b"no end") == 3
    lines = b"QUJDREVGR0hJSktMTU5P\r\n" * 3
    assert secretscan._open_run(b"text: \n" + lines + b"QUJD") == 7
    assert secretscan._open_run(b"a short line\n" + b"QUJD\n" + b"QUJD") == 18
    assert secretscan._open_run(b"x" * 5000) == 0 and secretscan._open_run(b"") == 0 and secretscan._open_run(b"ends ") == 5


def test_secrets_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, SECRET), (4, "a" * 23 + " " + "a" * 24), (5, "AKIA" + "A" * 15 + " AKIA" + "A" * 16), (6, 'token: "token: abcdefgh PASSWORD=12345 api_key=1234567'), (7, "%41%zz %e2%82 \\ud800 " + "QUJD" * 10), (8, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secretscan.secrets(docs).collect()}
    text = {i: [(s.kind, s.start, s.end) for s in got[i].base] for i, _ in rows}
    assert text[1] == text[2] == text[8] == [] and text[3] == [("assign", 0, 25)] and text[4] == [("hex", 24, 48)] and text[5] == [("access", 20, 40)]
    assert text[6] == [("assign", 39, 54)]
    cleaned = {r.doc_id: r.text for r in secretscan.redact_documents(docs).collect()}
    assert cleaned[1] is None and cleaned[3] == '[assign]"' and cleaned[2] == ""


@pytest.mark.parametrize("layer", [
    lambda s: base64.b64encode(gzip.compress(b"nothing here " * 50) + gzip.compress(s)).decode(),  # the second member
    lambda s: base64.b64encode(gzip.compress(s) + b"trailing").decode(),
    lambda s: base64.b64encode(b"\x00\x1b" + s).decode(),
    lambda s: base64.b64encode("é…".encode() + s + b"\xff").decode(),
    lambda s: "".join(f"\\u{c:04x}" for c in s),
    lambda s: "\\ud83d\\ude00" + urllib.parse.quote(s, safe=""),
])
def test_layers_that_are_easily_lost(layer):
    text = "before " + layer(b"token=abcdef123456") + " after"
    found = [x for x in secretscan.scan(text)[1] if x[1] == 0]
    assert found and all(text[a:b].strip() and 7 <= a < b <= len(text) - 6 for a, _, b in found)


def test_surrogate_pairs_are_one_character():
    data, places = secretscan._unescape("\\ud83d\\ude00é\\u0041\\ud83d", 5, secretscan.ESCAPE)
    assert data.decode() == "😀éA\ufffd"
    text, places = secretscan._as_text(data, places)
    assert [places.span(i, i + 1) for i in range(4)] == [(5, 17), (17, 18), (18, 24), (24, 30)]


def test_secrets_query_equals_literal_patterns(spark):
    import re

    rules = {"assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), "access": re.compile(r"(AKIA[A-Z0-9]+)"), "hex": re.compile(r"([0-9a-f]+)")}
    least = {"assign": 6, "access": 20, "hex": 24}
    got = {r.doc_id: r for r in QUERIES["op10_secret_spans"](spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans = sorted((m.start(), list(rules).index(kind), m.end()) for kind, rule in rules.items() for m in rule.finditer(d.text or "") if len(m[1]) >= least[kind])
        text = ",".join(f"{list(rules)[k]}:{a}:{b}" for a, k, b in spans)
        r = got[d.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secrets_of_repeated_rows_and_empty_tables(spark):
    long = urllib.parse.quote("token=abcdef123456 " * 20_000, safe="")
    docs = spark.createDataFrame([(1, long), (1, long), (2, None)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    rows = secretscan.secrets(docs).collect()
    assert len(rows) == 3 and [len(r.spans) for r in rows if r.doc_id == 1] == [20_000] * 2
    assert secretscan.secrets(docs.limit(0)).collect() == []


def test_languages_of_held_out_texts(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_languages_of_odd_texts(spark):
    learn = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "123 ###"), (4, "the dog"), (5, "die katze" * 50_000), (6, "ß")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: (r.lang_pred, r[-1]) for r in langid.identify(docs, learn).collect()}
    assert langid.identify(docs, learn).columns == ["doc_id", "text", "lang_pred", "score"]
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "de" and got[6][0] in ("en", "de")
    assert langid.identify(docs, learn.limit(0)).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0), learn).collect() == []
    marks = spark.createDataFrame([(1, "² ½ 7"), (2, "² ½ 7"), (2, "² ½ 7")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(marks, learn).collect()] == ["und"] * 3


def literal_grams(text):
    """The buckets of a text's n-grams, one by one."""
    mask = 0xFFFFFFFF
    chars = [32 if ord(c) < 128 and not c.isalpha() else ord(c) for c in text.lower()]
    factors = [int(x) for x in langid.MULTIPLIERS]
    for order in range(langid.ORDERS):
        for i in range(len(chars) - order):
            run = 0
            for k in range(order + 1):
                run = (run ^ chars[i + k]) * factors[k] & mask
                run ^= run >> 15
            yield (run + order) * 0x27D4EB2F % (mask + 1) >> (32 - langid.BITS)


def test_languages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 100)  # most texts go through in several stretches
    docs = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").orderBy("doc_id").limit(40).collect() if r.text] + [(9001, "aΣ" * 60 + "İx", "xx"), (9002, "q", "xx")]
    counts = {}
    for _, text, lang in docs:
        for b in literal_grams(text) if lang else ():
            counts.setdefault(lang, [0.5] * (1 << langid.BITS))[b] += 1
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    names, matrix = langid.fit(frame.filter("lang is not null"))
    assert names == sorted(counts)
    for i, lang in enumerate(names):
        assert np.allclose(matrix[:, i], np.log(np.array(counts[lang]) / sum(counts[lang])), atol=1e-5)
    totals = langid.score_batch([x for _, text, _ in docs[-12:] for x in langid.pieces(text)], matrix)
    at = 0
    for _, text, _ in docs[-12:]:
        n = len(list(langid.pieces(text)))
        want = sum(matrix[b].astype(float) for b in literal_grams(text))
        assert np.allclose(totals[at : at + n].sum(axis=0), want, rtol=1e-5)
        at += n


def test_batch_scores_do_not_depend_on_neighbours():
    matrix = np.log(np.random.default_rng(0).dirichlet(np.ones(2), 1 << langid.BITS)).astype(np.float32)
    texts = [(langid.codes_of(t), 0) for t in ("abc", "dé", "x", "hello there")]
    together = langid.score_batch(texts, matrix)
    alone = np.concatenate([langid.score_batch([t], matrix) for t in texts])
    assert np.allclose(together, alone)


def test_nearest_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    v[100:160] = v[100]
    rows = [(i, [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]
    odd = [(5000, None), (5020, []), (5040, [0.0] * 32), (5060, [float("nan")] * 32), (5080, [None] * 32), (5100, [float("inf")] + [1.0] * 31), (5120, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(3000) if i % 20 == 0}
    x = np.array([row for _, row in rows])
    hits = 0
    for q, found in got.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        hits += len(set(order) & {i for _, i, _ in found})
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(abs(scores[i] - s) < 1e-9 for _, i, s in found)
        assert [i for _, i, _ in sorted(found)] == [i for _, i in sorted((-s, i) for _, i, s in found)]
    assert hits >= 0.9 * 20 * len(got)
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>")
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def literal_score(p, codes):
    """The summed log-probability of a text's ids, word by word in 64-bit numbers."""
    classes = p["classes"].shape[1]
    edge, h, total = classes * classes - 1, lm.HIDDEN, 0.0
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for at, word in enumerate(codes):
        seen = np.array(p["bias"], float)
        for k, i in enumerate(lm.AROUND):
            other = codes[at + i] if 0 <= at + i < len(codes) else edge
            seen = seen + p["words"][other, k * h : (k + 1) * h]
        layer = np.append(np.tanh(seen), 1.0)
        cls, place = divmod(int(word), classes)
        total += math.log(softmax(layer @ p["classes"].astype(float))[cls]) + math.log(softmax(layer @ p["places"][cls].astype(float))[place])
    return total


def stream_score(p, codes):
    edge = len(p["words"]) - 1
    return sum(lm.log_probabilities(p, x).sum() for x in lm.windows(iter([codes]), 64, edge))


def test_pseudo_likelihood_prefers_text_to_shuffled_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").filter("lang = 'en'").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    words = [w for w, _ in __import__("collections").Counter(w for t in texts for w in lm.words_of(t)).most_common(lm.FREQUENT)]
    p = lm.train(docs, words)
    ids = lm.Ids(words)
    score = lambda ws: stream_score(p, np.fromiter(map(ids.__getitem__, ws), np.int64)) / len(ws)
    rnd = random.Random(1)
    whole = mixed = 0.0
    for t in [t for t in texts if len(t) > 2000][:40]:
        ws = lm.words_of(t)
        whole += score(ws)
        mixed += score(rnd.sample(ws, len(ws)))
    assert whole > mixed


def test_windows_hold_every_word_once_with_its_neighbours():
    rnd = np.random.default_rng(3)
    for size in (1, 2, 5, 64):
        docs = [rnd.integers(0, 50, n) for n in (0, 1, 2, 9, 0, 130, 3)]
        found = []
        for x in lm.windows(iter(docs), size, 99):
            assert len(x) <= size + 2 * lm.SIDE
            found += [tuple(x[i - lm.SIDE : i + lm.SIDE + 1]) for i in range(lm.SIDE, len(x) - lm.SIDE) if x[i] != 99]
        want = []
        for d in docs:
            padded = np.concatenate([[99] * lm.SIDE, d, [99] * lm.SIDE])
            want += [tuple(padded[i : i + 2 * lm.SIDE + 1]) for i in range(len(d))]
        assert found == want


def test_gradients_equal_differences(monkeypatch):
    """One step moves each parameter as the slope of the literal score says."""
    monkeypatch.setattr(lm, "RATE", 1e-3)
    p = {k: v.astype(np.float64) for k, v in lm.new_parameters(classes=17).items()}
    codes = np.array([1, 2, 1, 1, 40, 2, 1, 250, 1, 1, 1, 1, 1, 1])
    trainer = lm.Trainer(p)
    (stream,) = lm.windows(iter([codes]), 64, 288)
    trainer.step(stream)
    assert trainer.seen == len(codes)
    for name, at in [("words", (1, 3)), ("words", (288, 0)), ("words", (288, 2 * lm.SIDE * lm.HIDDEN - 1)), ("words", (250, 20)), ("bias", (4,)), ("classes", (2, 0)), ("classes", (lm.HIDDEN, 14)), ("places", (0, 5, 1)), ("places", (14, lm.HIDDEN, 12))]:
        moved = {k: v.copy() for k, v in p.items()}
        moved[name][at] += 1e-4
        slope = (literal_score(moved, codes) - literal_score(p, codes)) / 1e-4
        assert abs((trainer.p[name][at] - p[name][at]) - 1e-3 * slope / math.sqrt(1 + slope * slope)) < 2e-6 + 1e-4 * 1e-3 * abs(slope)


def test_small_classes_together_have_the_gradients_of_each(monkeypatch):
    rnd = np.random.default_rng(6)
    for classes, cached in ((9, 40), (9, 400), (30, 4000)):
        monkeypatch.setattr(lm, "CACHED", cached)
        cls = np.sort(rnd.choice([0, 0, 0, 1, 2, 4, classes - 1], 60))
        place, h = rnd.integers(0, classes, 60), rnd.normal(0, 1, (60, lm.HIDDEN + 1))
        weights = rnd.normal(0, 1, (classes, lm.HIDDEN + 1, classes))
        seen = []
        for safe in (True, False):
            for own, groups in lm.stretches(cls, classes):
                assert len(groups) == 1 or (own.stop - own.start) * classes <= cached
                dh, want = np.zeros((own.stop - own.start, lm.HIDDEN)), np.zeros((own.stop - own.start, lm.HIDDEN))
                found = lm.backward_of(h[own], weights, groups, place[own], safe, dh)
                for (c, part), gradient in zip(groups, found, strict=True):
                    assert (cls[own][part] == c).all()
                    seen += [c] * (part.stop - part.start)
                    assert np.allclose(gradient, lm.backward(h[own][part], weights[c], place[own][part], safe, want[part]))
                assert np.allclose(dh, want)
        assert seen == [*cls, *cls]


def test_every_text_trains_in_one_round(spark):
    # texts of under 8 words train too, and so do their last words, whose right-hand neighbour is the edge
    docs = spark.createDataFrame([(i, f"alpha beta gamma {i}", "en", "a", 16) for i in range(40)], DOCS)
    p, fresh = lm.train(docs, [b"alpha", b"beta", b"gamma"]), lm.new_parameters()
    for side in range(2 * lm.SIDE):
        assert not np.array_equal(p["words"][lm.EDGE, side * lm.HIDDEN :][: lm.HIDDEN], fresh["words"][lm.EDGE, side * lm.HIDDEN :][: lm.HIDDEN])


def test_probabilities_sum_to_one():
    p = lm.new_parameters()
    total = sum(math.exp(lm.log_probabilities(p, np.array([1, 2, w, 3, lm.EDGE]))[2]) for w in range(lm.EDGE))
    # what is left is the edge's, which is never predicted
    assert 1 - 5e-3 < total < 1


def test_pseudo_likelihood_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "a b " * 30_000), (3, "one")], "doc_id long, text string").withColumn("per_word", F.lit("clash"))
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert got[1].n_words == got[2].n_words == 0 and got[1].per_word is None and got[4].n_words == 60_000 and got[3].log_probability < 0
    assert lm.score_documents(docs.limit(0)).collect() == []


def test_words_outside_the_vocabulary_have_their_share(spark, monkeypatch):
    from collections import Counter

    rnd = random.Random(4)
    # 700 words 20 times, 3000 words up to 9 times, two long ones; the vocabulary and KNOWN don't hold the rare ones
    words = [f"w{i}" for i in range(700) for _ in range(20)] + [f"r{i}" for i in range(3000) for _ in range(1 + i % 9)] + ["L" * 90_000, "l" * 70] * 2
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i::300])) for i in range(300)]
    docs = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string")
    monkeypatch.setattr(lm, "KNOWN", 2000)
    counts = lm.count_words(docs)
    want = Counter(w for r in docs.collect() for w in lm.words_of(r.text))
    assert {bytes(r.word): r.n for r in counts.collect()} == {lm.key_of(w): n for w, n in want.items()}
    frequent, more, known, buckets = lm.vocabulary(counts)
    assert {f"w{i}".encode() for i in range(700)} <= set(frequent) and len(frequent) <= lm.FREQUENT and len(more) > 100 and [want[w] for w in more] == list(known)
    p, ids = lm.train(docs, frequent), lm.Ids(frequent)
    per_bucket = Counter()
    for w, n in want.items():
        if w not in frequent:
            per_bucket[ids[w]] += n
    assert [per_bucket[lm.FREQUENT + i] for i in range(lm.OTHERS)] == list(buckets)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    assert len(got) == 300 and lm.score_documents(docs).count() == 301
    for i, text in rows[:20]:
        own = lm.words_of(text)
        codes = np.fromiter(map(ids.__getitem__, own), np.int64)
        full = literal_score(p, codes)
        full += sum(math.log(want[w] / per_bucket[ids[w]]) for w in own if w not in frequent)
        assert got[i].n_words == len(own) and abs(got[i].log_probability - full) < 1e-3 * abs(full)
    assert lm.classes_for(lm.FREQUENT) == lm.CLASSES and lm.classes_for(10_000) == 102


def test_words_of_many_texts_are_looked_up_as_one_by_one(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "FOR_EACH", 0)
    monkeypatch.setattr(lm, "BUNDLE", 60)
    rnd = random.Random(8)
    parts = ["Alpha", "beta", "\u00c9t\u00e9", "x\x1cy", "z\x85w", "q\u00a0r", "\x00", "L" * 64, "M" * 65, "m" * 65 + "\u00c9", " ", "\t", "\x0b\x0c", "\r\n"]
    texts = [None, "", " ", "\n a", "a ", *(rnd.choice(["", " "]).join(rnd.choices(parts, k=rnd.randrange(12))) for _ in range(300)), None]
    frequent = [b"beta", b"a", b"alpha"]
    ids = lm.Ids(frequent)
    for kind in (pa.string(), pa.large_string()):
        for column in (pa.array(texts, kind), pa.array(texts, kind)[7:90], pa.array(texts, kind)[:0]):
            codes, unknown, words = [], [], []
            for bundle in lm.bundles_for(column, pa.array(frequent)):
                found, ends = lm.words_in(bundle)
                at, keys, new = lm.look_up(found, pa.array(frequent), lm.FREQUENT)
                assert len(ends) == len(bundle) and new.sum() == len(keys)
                codes += [x.tolist() for x in np.split(at, ends[:-1])]
                unknown += keys.to_pylist()
                words += lm.keys_of(found).to_pylist()
            want = [lm.words_of(t or "") for t in column.to_pylist()]
            assert codes == [[ids[w] for w in ws] for ws in want]
            assert words == [lm.key_of(w) for ws in want for w in ws]
            assert unknown == [lm.key_of(w) for ws in want for w in ws if w not in frequent]


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_neardup import brute_force

    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    stats = [quality.text_stats(d["text"]) for d in docs]
    docs = [d for d, s in zip(docs, stats, strict=True) if s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"]]
    kept = {r[0] for r in brute_force([(d["doc_id"], d["text"]) for d in docs]) if r[3]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = [d | {"text": _redacted(d["text"])} for d in docs if d["doc_id"] in kept]
    frame = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], len(d["text"])) for d in clean], DOCS)
    want = []
    for r in mixing.mix(frame).collect():
        text = next(d["text"] for d in clean if d["doc_id"] == r.doc_id)
        want += [(r.doc_id, library.encode(text, add_special_tokens=False).ids, hashlib.sha256(text.encode()).hexdigest())] * r.repeats
    got = [(r.doc_id, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def _redacted(text):
    out, at = "", 0
    for start, kind, end in secretscan.scan(text)[1]:
        if end > at:
            out += text[at:start] + f"[{secretscan.KINDS[kind]}]" if start >= at else ""
            at = end
    return out + text[at:]

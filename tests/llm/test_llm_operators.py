"""The training-data operators against brute force, on odd rows and on properties."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ripple.llm import golay, knn, linededup, packing, pieces, pii, queries, sharding, toxicity, urlrules, weighted

SF001 = "/root/testdata/sf0.001"
SP = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, name="documents"):
    return spark.read.parquet(f"{SF001}/{name}.parquet")


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"word{i % 977} of line {i}." for i in range(6_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the old river bank", "en", "a", 1, "x", 0.5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "y", 0.1),
        (None, "A text without an id but with words enough for a shingle", "en", None, 5, None, None),
        (4, "  \n\t ", "en", "b", 4, "z", 0.2),
        (5, "same line here for all of the documents to share today\nown line five", "en", "b", 3, "q", 0.3),
        (5, "same line here for all of the documents to share today\nown line five", "en", "b", 3, "q", 0.3),
        (6, "same line here for all of the documents to share today\nown line six", "de", "b", 3, "q", 0.3),
        (7, long_text, "en", "c", len(long_text), "w", 0.9),
        (8, long_text, "en", "c", len(long_text), "w", 0.9),
        (9, "Schöne Grüße 日本語 😀 ▁ mark\r\nmail: a.b@c.example.org", "de", "c", 9, "u", 0.4),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < -1")


# -- 1 sharding -------------------------------------------------------------

def test_karmarkar_karp_places_every_item_and_balances():
    r = random.Random(1)
    for k in (1, 2, 5, 40):
        sizes = np.array([r.randint(1, 5000) for _ in range(700)])
        part = sharding.karmarkar_karp(sizes, k)
        sums = np.bincount(part, weights=sizes, minlength=k)
        assert sums.sum() == sizes.sum() and part.min() >= 0 and part.max() < k
        assert sums.max() - sums.min() <= max(1, sizes.max() * 0.02 if k < 40 else sizes.max() * 0.5)
    assert sharding.karmarkar_karp(np.array([5]), 3).tolist() == [0]
    part = sharding.karmarkar_karp(np.array([8, 7, 6, 5, 4]), 2)      # the textbook case: 16 and 14
    assert sorted(np.bincount(part, weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_shards_hold_equal_texts_together_with_gapless_slots(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(sharding, "PACKETS", 32)         # most groups lie in packets
    for docs, k in ((docs_of(spark), 7), (odd_docs, 4)):
        rows = sharding.shard(docs, k).collect()
        assert len(rows) == docs.count()
        by_shard, by_text = {}, {}
        texts = {(r["doc_id"], None if r["text"] is None else zlib.crc32(r["text"].encode())): r["text"]
                 for r in docs.collect()}
        for r in rows:
            text = texts[(r["doc_id"], r["text_crc32"])]
            assert r["size"] == 16 + len((text or "").encode())
            by_shard.setdefault(r["shard"], []).append(r["slot"])
            by_text.setdefault(text, set()).add(r["shard"])
        assert all(len(s) == 1 for s in by_text.values())
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert sharding.shard(no_docs, 4).collect() == []


def test_shards_stay_balanced_beside_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PACKETS", 128)
    r = random.Random(3)
    texts = ["hot text " * 20] * 400 + ["x" * r.randint(10, 900) + str(i) for i in range(900)]
    sums = Counter()
    for row in sharding.shard(frame(spark, texts), 5).collect():
        sums[row["shard"]] += row["size"]
    hot = 400 * (16 + 9 * 20)
    rest = sorted(sums.values())[:-1] if max(sums.values()) == hot else list(sums.values())
    assert max(rest) - min(rest) <= 0.02 * sum(rest) / len(rest)


# -- 2 toxicity -------------------------------------------------------------

def test_gradients_match_differences():
    model = toxicity.Model({"a": 1, "b": 2, "c": 3})
    model.p = {k: x.astype(np.float64) for k, x in model.p.items()}
    words, index = ["a", "b", "c", "xyz", "qq"], np.array([[0, 1, 2, 3, -1], [4, 0, -1, -1, -1], [1, 1, 3, 2, 0]])
    labels, weights = np.array([1, 0, 1.0]), np.array([1, 2, 1.0])
    loss = lambda: model.gradients(words, index, labels, weights)[0]
    _, g = model.gradients(words, index, labels, weights)
    for k, x in model.p.items():
        dense = g[k]
        if isinstance(dense, tuple):
            dense = np.zeros_like(x)
            dense[g[k][0]] = g[k][1]
        flat, own = x.reshape(-1), dense.reshape(-1)
        for j in np.argsort(-np.abs(own))[:4]:
            old = flat[j]
            flat[j] = old + 1e-4
            up = loss()
            flat[j] = old - 1e-4
            down = loss()
            flat[j] = old
            assert abs((up - down) / 2e-4 - own[j]) <= 0.02 * abs(own[j]) + 2e-5, k


def test_windows_overlap_and_cover_all_words():
    for n in (0, 1, 39, 40, 41, 70, 71, 1000):
        spans = toxicity.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))


@pytest.fixture(scope="module")
def toxic_model():
    r = random.Random(5)
    word = lambda: "".join(r.choice(["ba", "do", "ri", "ka", "mu", "el"]) for _ in range(r.randint(1, 3)))
    texts, labels = [], []
    for i in range(240):
        words, bad = [word() for _ in range(r.randint(5, 150))], i % 4 == 0
        for _ in range(3 * bad):
            words.insert(r.randint(0, len(words)), r.choice(["zorgon", "Vrekt!", "quaxil,"]))
        texts.append(" ".join(words))
        labels.append(int(bad))
    return toxicity.train(texts[:160], labels[:160]), texts, labels


def test_toxicity_separates_held_out_texts(toxic_model):
    model, texts, labels = toxic_model
    scores = model.scores(texts[160:])
    bad = [s for s, y in zip(scores, labels[160:]) if y]
    good = [s for s, y in zip(scores, labels[160:]) if not y]
    assert np.mean(np.array(bad) >= 0.7) >= 0.9 and np.mean(np.array(good) >= 0.7) <= 0.05
    # a window anywhere in a long text counts
    clean = " ".join(t for t, y in zip(texts, labels) if not y)
    assert model.scores([clean + " zorgon vrekt " + clean])[0] > model.scores([clean])[0]


def test_scores_of_odd_rows(spark, odd_docs, no_docs, toxic_model):
    scored = toxicity.with_score(odd_docs, toxic_model[0])
    assert scored.columns == odd_docs.columns               # the clashing score is replaced
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert toxicity.with_score(no_docs, toxic_model[0]).collect() == []
    assert {r["score"] for r in toxicity.with_score(odd_docs, None).collect()} == {0.0}
    assert toxicity.train(["a", "b"], [0, 0]) is None


# -- 3 SentencePiece --------------------------------------------------------

ALPHABET = [" ", " ", "  ", "\n", "a", "the", "The", "'s", "don't", "é", "ß", "▁", "\t", "1", "23", ".", "!!", "日本", "😀",
            "　", "\xa0", "\x1c", "\x00", "<|endoftext|>", "́", "word", "<s>", "</s>", "<unk>", "\r\n", "ﬁ", "Ａ"]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return ["", " ", "  ", "a ", " a"] + ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_chunk_table_equals_the_library():
    model, known, texts = sentencepiece.SentencePieceProcessor(model_file=SP), pieces.ChunkTable(SP), odd_texts(4000)
    chunks = [pieces.chunks_of(t) for t in texts]
    known.learn(chunks)
    for text, own in zip(texts, chunks):
        ids = model.encode(text)
        assert known.encode(own) == np.array(ids, "<i4").tobytes(), repr(text)
        assert known.decode(own) == model.decode(ids), repr(text)


def test_sentencepiece_rows(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)      # the table is emptied on the way
    model = sentencepiece.SentencePieceProcessor(model_file=SP)
    for docs in (odd_docs, docs_of(spark)):
        encoded = pieces.encode_decode(docs, SP)
        texts = Counter((r["doc_id"], tuple(model.encode(r["text"] or ""))) for r in docs.collect())
        rows = encoded.collect()
        assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == texts
        assert all(r["decoded"] == model.decode(r["ids"]) for r in rows)
    again = {tuple(r) for r in pieces.decode(pieces.encode_decode(odd_docs, SP), SP).collect()}
    assert again == {(r["doc_id"], r["decoded"]) for r in pieces.encode_decode(odd_docs, SP).collect()}
    row = pieces.digests(pieces.encode_decode(frame(spark, ["The cat  sat"]), SP)).first()
    ids = model.encode("The cat  sat")
    assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert row["decoded_sha256"] == hashlib.sha256(b"The cat  sat").hexdigest()
    assert pieces.encode_decode(no_docs, SP).collect() == []


# -- 4 line dedup -----------------------------------------------------------

def word_edits(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, d[0] = d[0], i
        for j, b in enumerate(y, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (a != b))
    return d[len(y)]


def brute_lines(docs):
    """(doc_id, line) of the lines that go; docs in order."""
    seen, gone = [], {}
    for doc_id, text in docs:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            if not words:
                continue
            near = any(len(w) >= 8 and len(words) >= 8 and w != words and abs(len(w) - len(words)) < 2
                       and word_edits(w, words) == 1 for w in seen_before(seen, words))
            if near:
                gone[doc_id, i] = "near"
            elif words in seen:
                gone[doc_id, i] = "exact"
            seen.append(words)
    return gone


def seen_before(seen, words):
    """Distinct lines that first occur before this line first occurs."""
    stop = seen.index(words) if words in seen else len(seen)
    return seen[:stop]


def test_line_dedup_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(6)]
    lines = []
    for _ in range(40):
        lines.append([r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 7, 8, 9, 12]))])
    for _ in range(120):
        line = list(r.choice(lines))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randint(0, len(line))
            what = r.choice("ird")
            if what == "i":
                line.insert(at, r.choice(vocabulary))
            elif line and at < len(line):
                line[at:at + 1] = [] if what == "d" else [r.choice(vocabulary)]
        lines.append(line)
    r.shuffle(lines)
    docs, at = [], 0
    while at < len(lines):
        n = r.randint(1, 6)
        docs.append((len(docs), "\n".join(r.choice([" ", "  ", "\t"]).join(x) for x in lines[at:at + n])))
        at += n
    gone = brute_lines(docs)
    assert "near" in gone.values() and "exact" in gone.values()
    got = {(d["doc_id"], d["line"]): "near" if d["near"] else "exact" for d in linededup.dropped_lines(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == gone
    for row in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        own = row["text"].split("\n")
        assert row["_kept"] == "\n".join(x for i, x in enumerate(own) if (row["doc_id"], i) not in gone)


def test_line_dedup_odd_rows(spark, odd_docs, no_docs):
    out = linededup.dedup_lines(odd_docs)
    rows = out.collect()
    assert out.columns[:len(odd_docs.columns)] == odd_docs.columns and len(rows) == odd_docs.count()
    five, six = [[r for r in rows if r["doc_id"] == i] for i in (5, 6)]
    assert [r["_n_exact"] for r in five] == [0, 0] and five[0]["_kept"] == five[0]["text"]
    assert six[0]["_kept"] == "own line six"
    assert [(r["_kept"], r["_n_lines"]) for r in rows if r["doc_id"] == 2] == [(None, 0)]
    assert [r["_kept"] for r in rows if r["doc_id"] in (3, 4)] == [r["text"] for r in rows if r["doc_id"] in (3, 4)]
    assert sorted(len(r["_kept"]) for r in rows if r["doc_id"] in (7, 8))[0] == 0    # the second copy loses its line
    assert linededup.dedup_lines(no_docs).collect() == []


def test_one_edit_verifies(spark):
    pairs = []
    for x in itertools.product("ab", repeat=3):
        for n in range(5):
            for y in itertools.product("ab", repeat=n):
                pairs.append((list(x), list(y)))
    rows = spark.createDataFrame(pairs, "x array<string>, y array<string>").withColumn(
        "one", linededup.one_edit(F.col("x"), F.col("y"))).collect()
    assert all(r["one"] == (word_edits(r["x"], r["y"]) <= 1) for r in rows)


# -- 5 url filters ----------------------------------------------------------

def brute_url(url, rules, default="allow"):
    at = -1 if url is None else url.find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, pattern in rules:
        h, _, p = pattern.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            key = (-len(pattern), pattern, verdict != "block")
            best = min(best, (key, pattern, verdict)) if best else (key, pattern, verdict)
    return host, path, best and best[1], best[2] if best else default


def test_url_rules_equal_brute_force(spark, no_docs):
    r = random.Random(2)
    hosts = ["net", "x.net", "example.net", "A.Example.NET", "example.com", "notexample.com", "org", "a.org", "net.org", "",
             "example.net:80", "münchen.net"]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/", "/frx", "/EN/", "?q=/en/", "#/en/", "/en/?a=b#c", "//x"]
    urls = [r.choice(["http://", "https://", "HTTP://", "//", "", "a://b://"]) + r.choice(hosts) + r.choice(paths)
            for _ in range(600)] + [None, "", "://", "http://", "x\ny://net/\nz"]
    rules = queries.URL_RULES + [("allow", "net/"), ("block", "x.net/en")]
    df = spark.createDataFrame([(i if i else None, u, "h") for i, u in enumerate(urls)],
                               "page_id long, url string, host string").repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in urlrules.judge(df, rules).collect()}
    assert got == {(i if i else None): brute_url(u, rules) for i, u in enumerate(urls)}
    wild = urlrules.judge(df.where("url is not null"), [("block", "*.net/*/x"), ("block", "exam*.com/")])
    assert wild.count() == len(urls) - 1
    assert urlrules.judge(no_docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), rules).collect() == []


def test_rules_are_filed_under_their_rarest_token():
    index = urlrules.rule_index([("block", "a.com/"), ("block", "a.com/x/"), ("allow", "*/")], {"a": 5, "com": 9, "x": 1})
    assert {t: [p for p, *_ in found] for t, found in index.items()} == {"a": ["a.com/"], "x": ["a.com/x/"], None: ["*/"]}


# -- 6 exact top-k ----------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knn, "SHARD_ROWS", 40)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 6)
    monkeypatch.setattr(knn, "LEAF_ROWS", 4)
    r = random.Random(4)
    vectors = {i: [r.uniform(-1, 1) for _ in range(5)] for i in range(150)}
    for i in range(60, 110):
        vectors[i] = vectors[60]                         # a very common vector: ties
    rows = [(i, v) for i, v in vectors.items()] + [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0]), (202, [float("nan")] * 5),
                                                   (203, [float("inf")] * 5), (None, [0.5] * 5), (204, [0.5] * 3), (250, [])]
    points = knn.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    q = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows
         if i is not None and v is not None and i not in (201, 202, 203)}
    got = {}
    for row in knn.top_k(points, points.where(F.col("id") % 10 == 0), 5).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    for i in (i for i in q if i % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(q[i], v)), j) for j, v in q.items() if j != i and len(v) == len(q[i]))[:5]
        assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)], i
    none = points.where("id < -1")
    assert knn.top_k(none, none, 5).collect() == []


# -- 7 personal data --------------------------------------------------------

BRUTE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    found = []
    for no, (kind, pattern) in enumerate(BRUTE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                  "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), no, m.end(), kind))
    return sorted(found)


def pii_texts():
    r = random.Random(9)
    bits = ["a@b.c", "%d@e.f", "@", "x@y", ".com", "1.2.3.4", "256.1.1.1", "001.002.003.0004", "4111 1111 1111 1111",
            "4111111111111111", "5500-0000-0000-0004", "+1 (017) 555-7713", "+4", "+49 30 1234567", " ", " ", "é", "😀", "-", "(",
            "12", "7", ".", "word", "\n", "+1.2.3.4.5.6.7.8.9", "٣"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(600)]


def test_base_spans_equal_brute_force(spark, odd_docs, no_docs):
    docs = frame(spark, pii_texts()).unionByName(odd_docs.select("doc_id", "text"))
    for docs in (docs, docs_of(spark)):
        texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
        want = sorted((str(i), [tuple(s) for s in brute_spans(t or "")]) for i, t in texts)
        rows = pii.find(docs).collect()
        assert len(rows) == docs.count()
        got = sorted({(str(r["doc_id"]), tuple(map(tuple, r["base"]))) for r in rows})
        assert got == sorted({(i, tuple(s)) for i, s in want})
        assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in rows)
    assert pii.find(no_docs).collect() == []


def test_confident_patterns_discover_unseen_identifiers(spark):
    texts = [f"please write to customer mailbox user{i}@mail.example.org now" for i in range(30)]
    texts += ["please write to customer mailbox root@localhost today", "the version root@localhost is a file",
              "room 1234567 is free"]
    rows = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    found = [tuple(s) for s in rows[30]["spans"]]
    start = texts[30].index("root@")
    assert found == [(start, 0, start + len("root@localhost"), "email")]
    assert [rows[i]["spans"] for i in (31, 32)] == [[], []]


def plain_patterns(occurrences):
    """All rounds by hand: {(kind, pattern): confidence}."""
    edges, seeds, shapes = {}, {}, {}
    for patterns, instance, seed, own in occurrences:
        for p in patterns:
            edges.setdefault(p, set()).add(instance)
            if seed:
                seeds.setdefault((p, instance), set()).add(seed)
            shapes.setdefault((p, instance), set()).update(set(own) - {None})
    # a seed edge counts for the kind that is last in the alphabet, as the maximum does
    seed_of = {k: max(v) for k, v in seeds.items()}
    base = {(k, i) for (_, i), k in seed_of.items()}
    score, found = {b: 1.0 for b in base}, {}
    for _ in range(pii.ROUNDS):
        found = {}
        for kind in pii.KINDS:
            for p, own in edges.items():
                fits = {i for i in own if kind in shapes[p, i] or kind in seeds.get((p, i), ())}
                total = sum(score.get((kind, i), 0.0) for i in own)
                if sum(score.get((kind, i), 0.0) >= 1.0 for i in own) >= pii.MIN_SEEDS:
                    found[kind, p] = total / (total + len(own - fits) + pii.DOUBT)
        doubt = {}
        for (kind, p), c in found.items():
            for i in edges[p]:
                if (p, i) not in seed_of and kind in shapes[p, i]:
                    doubt[kind, i] = doubt.get((kind, i), 1.0) * max(1.0 - c, 1e-9)
        score = {b: 1.0 for b in base}
        for key, d in doubt.items():
            score[key] = max(score.get(key, 0.0), 1.0 if 1.0 - d >= pii.CONFIDENT else 1.0 - d)
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pattern_scores_equal_brute_force_in_all_rounds(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for _ in range(500):
        i = rnd.randrange(120)
        kind = pii.KINDS[i % 4] if i < 90 else None           # instances above 90 have no fitting shape
        shape = [k if k == kind else None for k in pii.KINDS]
        known = kind if i % 3 == 0 and kind and rnd.random() < 0.8 else None
        near = lambda: (i % 4) * 4 + rnd.randrange(4) if rnd.random() < 0.85 else rnd.randrange(25)  # noqa: B023, E731
        rows.append(([f"p{near()}" for _ in range(rnd.randint(0, 2))], i, known, shape))
    df = spark.createDataFrame(rows, "patterns array<string>, instance long, seed string, shapes array<string>")
    got = {(r["kind"], r["pattern"]): r["confidence"] for r in pii.scored_patterns(df).collect()}
    want = plain_patterns(rows)
    assert set(got) == set(want) and want and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_discovered_identifiers_seed_the_next_round(spark):
    # "ring" has base seeds; what it discovers makes "bell" eligible, which no base seed stands behind
    texts = [f"ring +49 30 12345{i}7 now" for i in range(10)] + [f"ring (555) 123 45{i}7 now" for i in range(10, 14)]
    texts += [f"bell (555) 123 45{i}7 now" for i in range(10, 14)] + ["bell (555) 999 0000 now", "room 3 now"]
    rows = {r["doc_id"]: r for r in pii.find(frame(spark, texts)).collect()}
    for i in range(10, 19):
        start, end = texts[i].index("("), texts[i].index(" now")
        assert [tuple(s) for s in rows[i]["spans"]] == [(start, 3, end, "phone")], texts[i]
    assert rows[19]["spans"] == [] and all(rows[i]["base"] == rows[i]["spans"] != [] for i in range(10))


def test_redaction(spark):
    rows = frame(spark, ["mail a@b.c or 1.2.3.4", "none", ""]).join(
        pii.find(frame(spark, ["mail a@b.c or 1.2.3.4", "none", ""])), "doc_id")
    got = {r["doc_id"]: r["x"] for r in rows.select("doc_id", pii.redact(F.col("text"), F.col("spans")).alias("x")).collect()}
    assert got == {0: "mail <EMAIL> or <IP>", 1: "none", 2: ""}


# -- 8 packing --------------------------------------------------------------

def test_chunk_ids_equal_the_tokenizer():
    model, known, texts = Tokenizer.from_file(BPE), packing.ChunkIds(BPE), odd_texts(4000, 6)
    for text, ids in zip(texts, known.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)


def test_chunk_ids_of_all_white_space_runs(monkeypatch):
    """Every product of white-space characters up to five, between words and at both ends; the table starts anew at times."""
    monkeypatch.setattr(packing, "TABLE_BYTES", 100_000)
    model, known = Tokenizer.from_file(BPE), packing.ChunkIds(BPE)
    assert known.ranks is not None
    few, many = " \t\n\xa0", " \t\n\r\x0b\x0c\x1c\x85\xa0\u1680\u180e\u2003\u200b\u2028\u3000\ufeff"
    runs = ["".join(c) for n in range(1, 6) for c in itertools.product(few, repeat=n)]
    runs += ["".join(c) for n in range(1, 4) for c in itertools.product(many, repeat=n)]
    texts = [t for r in runs for t in (r, f"x{r}", f"{r}y", f"x{r}y's {r}\u00e9z", f"x <|endoftext|>{r}\u0221")]
    for at in range(0, len(texts), 500):
        some = texts[at:at + 500]
        for text, ids, e in zip(some, known.encode(some), model.encode_batch(some, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, repr(text)


def test_sequences_without_ids(spark):
    rows = spark.createDataFrame([(1, 0, [5, 6]), (1, 2, None), (2, 0, None)], "sequence_id int, offset int, ids array<int>")
    assert {r["sequence_id"]: r["ids"] for r in packing.sequences(rows).collect()} == {1: [5, 6], 2: []}


@pytest.mark.parametrize("which", ["odd", "sf"])
def test_packing_is_whole_and_tight(spark, odd_docs, which):
    docs, size = (odd_docs, 64) if which == "odd" else (docs_of(spark), 1024)
    model = Tokenizer.from_file(BPE)
    packed = packing.pack(packing.pieces(docs, BPE, 2, size, keep_ids=True), size)
    rows = packed.collect()
    want = Counter()
    for d in docs.collect():
        ids = model.encode(d["text"] or "", add_special_tokens=False).ids + [2]
        cuts, start = packing.piece_lengths(len(ids), size), 0
        assert max(cuts) <= size and (len(ids) > size or len(cuts) == 1)
        for k, n in enumerate(cuts):
            own = ids[start:start + n]
            want[d["doc_id"], k, start, n, zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= size
    total = sum(r["length"] for r in rows)
    assert len(by) <= 1.02 * math.ceil(total / size) + 2
    assert sum(len(r["ids"]) for r in packing.sequences(packed).collect()) == total


def test_sum_of_squares_choice_and_empty(spark, no_docs):
    bins, offsets = packing.sum_of_squares(np.array([6, 6, 4, 3, 1]), 10)
    # 4 fills a gap of 4; 3 takes the other gap of 4 (none other open), 1 the gap of 1 left
    assert bins[2] != bins[3] and offsets.tolist() == [0, 0, 6, 6, 9]
    assert packing.pack(packing.pieces(no_docs, BPE, 2, 64), 64).collect() == []


# -- 9 fingerprints ---------------------------------------------------------

def weighted_jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(8)
    errors = []
    # every pair has words of its own, so the errors of the pairs are independent
    texts = [" ".join(f"v{i // 2}-{r.randrange(40)}" for _ in range(r.randint(5, 120))) for i in range(160)]
    sig = {x["doc_id"]: x["sig"] for x in weighted.fingerprint(frame(spark, texts)).collect()}
    for i in range(0, 160, 2):
        like = np.mean([a == b for a, b in zip(sig[i], sig[i + 1])])
        errors.append(like - weighted_jaccard(texts[i], texts[i + 1]))
    # 80 pairs: the mean error of an unbiased estimate is within 3 sigma of 0
    assert abs(np.mean(errors)) < 3 * 0.5 / math.sqrt(80 * weighted.SAMPLES)


def test_likeness_of_single_pairs(spark):
    # 120 pairs at a similarity of 0.85, each with words of its own and weights from 1 to 3
    texts, true = [], 51 / 60
    for k in range(120):
        shared = [f"s{k}-{i}" for i in range(17) for _ in range(3)]
        for side in "ab":
            own = {"a": 4, "b": 5}[side]
            texts.append(" ".join(shared + [f"{side}{k}-{i}" for i in range(own)]))
    assert all(weighted_jaccard(texts[i], texts[i + 1]) == pytest.approx(true) for i in range(0, 240, 2))
    sig = {x["doc_id"]: x["sig"] for x in weighted.fingerprint(frame(spark, texts)).collect()}
    errors = np.array([np.mean([a == b for a, b in zip(sig[i], sig[i + 1])]) - true for i in range(0, 240, 2)])
    # 64 draws or more: a standard error of 0.045 at most (24 draws: 0.073), and few pairs far off
    assert np.sqrt(np.mean(errors ** 2)) < 0.056
    assert np.mean(np.abs(errors) > 0.125) < 0.04


def plain_draw(term, weight, i):
    """(ln a, t) of the documented formulas from the same two hashes (Spark's, over the term's hash)."""
    def long_hash(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64((v % 2 ** (8 * size)).to_bytes(size, "little"), seed=h).intdigest()
        return h

    first, second = (long_hash((term, 8), (2 * i + k, 4)) for k in (0, 1))
    uniform = lambda h, at: ((h >> at) % 2 ** 25 + 0.5) / 2 ** 25
    r = -math.log(uniform(first, 0) * uniform(first, 25))
    c = -math.log(uniform(second, 0) * uniform(second, 25))
    b = ((first >> 50) * 2 ** 14 + (second >> 50) + 0.5) / 2 ** 28
    t = math.floor(math.log(weight) / r + b)
    return math.log(c) - r * (t - b) - r, t


def test_draws_follow_the_formulas(spark):
    rnd = random.Random(3)
    terms = [(rnd.randrange(-2 ** 63, 2 ** 63), w) for w in [1, 1, 2, 3, 7, 1000] * 10]
    df = spark.createDataFrame(terms, "term long, n long")
    for i in (0, 5):
        got = df.select("term", "n", weighted._ranked(F.col("term"), F.log("n"), i).alias("x")).collect()
        for r in got:
            log_a, t = plain_draw(r["term"], r["n"], i)
            assert (r["x"] >> 32) / 2 ** weighted.STEP_BITS + weighted.LEAST == pytest.approx(log_a, abs=2e-7)
        assert len({r["x"] & 0xFFFFFFFF for r in got}) == len(terms)
    # t stays 0 at weight 1
    many = [plain_draw(k * 7919, 1, k) for k in range(4000)]
    assert {t for _, t in many} == {0}


def test_compare_with_edited_and_next(spark, odd_docs, no_docs):
    for docs in (docs_of(spark), odd_docs):
        rows = sorted(weighted.compare(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        texts = [(i, t or "") for i, t in {(r["doc_id"], r["text"]) for r in docs.collect()}]
        texts.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        assert len(rows) == len(texts)
        by_text = {}
        for k, (row, (i, t)) in enumerate(zip(rows, texts)):
            nxt = texts[(k + 1) % len(texts)][1]
            q = len(t) // 4
            edited = t[:len(t) - q] + nxt[:q]
            assert (row["doc_id"], row["n_chars"]) == (i, len(t))
            assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            by_text.setdefault(t.strip() and t, set()).add(row["fingerprint"])
            assert row["near_next"] == pytest.approx(np.mean([
                a == b for a, b in zip(*(re.findall(".{8}", x) for x in (
                    row["fingerprint"], rows[(k + 1) % len(rows)]["fingerprint"])))]))
        assert all(len(f) == 1 for f in by_text.values())
    assert np.mean([r["near_edited"] for r in weighted.compare(docs_of(spark)).collect()]) > 0.4
    assert weighted.compare(no_docs).collect() == []


def test_texts_drawn_together_have_the_signatures_they_have_alone(spark):
    texts = [(1, "a b b c", "a b c c d"), (2, "a b", ""), (3, None, "x x y"), (4, "same words same", "same words same"),
             (5, " ", None)]
    df = spark.createDataFrame(texts, "row long, text string, edited string").repartition("row")
    both = {r["row"]: r for r in weighted.signatures(df, "row", ["text", "edited"]).collect()}
    assert set(both) == {1, 2, 3, 4}
    for col in ("text", "edited"):
        alone = {r["row"]: r[f"{col}_sig"] for r in weighted.signatures(df, "row", [col]).collect()}
        assert {k: r[f"{col}_sig"] for k, r in both.items() if r[f"{col}_sig"]} == alone
        assert all(len(s) == weighted.SAMPLES for s in alone.values())
    assert both[2]["edited_sig"] is None and both[3]["text_sig"] is None
    assert both[4]["text_sig"] == both[4]["edited_sig"]
    # what all texts begin with may end inside a word, beside spaces or be empty
    for head in ("q a", "q  ", " q", ""):
        split = weighted.signatures(df, "row", ["text", "edited"], F.lit(head)).collect()
        whole = df.select("row", *(F.concat(F.lit(head), F.coalesce(c, F.lit(""))).alias(c) for c in ("text", "edited")))
        want = {r["row"]: r for r in weighted.signatures(whole.repartition("row"), "row", ["text", "edited"]).collect()}
        # a null text has the head's whole words only: left out of the comparison
        for r in split:
            for c, gone in (("text", (3,)), ("edited", (5,))):
                assert r["row"] in gone or r[f"{c}_sig"] == want[r["row"]][f"{c}_sig"]


def test_draws_are_code_that_the_jvm_compiles(spark, capsys):
    df = spark.createDataFrame([(1, "a b", "a c")], "row long, text string, edited string").repartition("row")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        weighted.signatures(df, "row", ["text", "edited"]).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shown = capsys.readouterr().out
    assert "StrictMath.log" in shown             # the draws are part of the generated code
    # methods of 8000 bytes and more are interpreted
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown))) < 8000


# -- 10 SimHash -------------------------------------------------------------

def brute_simhash(text, k=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def brute_components(fps, ids, bits=2):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(range(len(fps)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            root[top(a)] = top(b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(fps))]


def test_golay_code():
    code = golay.Golay()
    r = np.random.default_rng(1)
    words = r.integers(0, 1 << 23, 400)
    codeword = words ^ code.error[code.low[words & 0xFFF] ^ code.high[words >> 12]]
    assert all(int(a ^ b).bit_count() <= 3 for a, b in zip(words, codeword))
    for i, j in itertools.combinations(range(23), 2):      # two flips apart: a shared index
        pair = np.array([words[0], words[0] ^ (1 << i) ^ (1 << j)])
        x, y = code.indices(pair, 23)
        assert set(x) & set(y)


def test_links_lose_nothing(spark, monkeypatch):
    r = random.Random(6)
    for bucket in (16, 2):                                 # with and without the exact way for large keys
        monkeypatch.setattr(golay, "BUCKET", bucket)
        fps = [r.getrandbits(64) for _ in range(30)]
        for _ in range(170):
            x = r.choice(fps)
            for _ in range(r.randint(1, 4)):
                x ^= 1 << r.randrange(64)
            fps.append(x)
        fps = sorted(set(fps))
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        df = spark.createDataFrame([(x,) for x in signed], "fp long")
        roots = {x["node"]: x["root"] for x in golay.components(golay.links(df)).collect()}
        want = brute_components(fps, list(range(len(fps))))
        got = {}
        for i, x in enumerate(signed):
            got.setdefault(roots.get(x, x), []).append(i)
        assert sorted(map(tuple, got.values())) == sorted(
            tuple(i for i in range(len(fps)) if want[i] == w) for w in set(want))


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    rows = golay.components(edges).collect()
    assert len(rows) == n + 1 and len({r["root"] for r in rows}) == 1


def test_near_duplicates_equal_brute_force(spark, odd_docs, no_docs):
    for docs in (odd_docs, docs_of(spark)):
        rows = docs.collect()
        fps = [brute_simhash(r["text"]) if len(r["text"] or "") < 50_000 else golay.simhash(r["text"], 3) for r in rows]
        want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(
            rows, fps, brute_components(fps, [r["doc_id"] for r in rows])))
        assert Counter(map(tuple, golay.near_duplicates(docs).collect())) == want
    kept = golay.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6, 7, 9]
    assert golay.near_duplicates(no_docs).collect() == [] and golay.representatives(no_docs).collect() == []


# -- registration -----------------------------------------------------------

def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)

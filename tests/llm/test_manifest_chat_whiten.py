"""Merkle manifest, reply trees and whitening against brute force, on odd rows and on properties."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripple.llm import chat, merkle, queries, whiten

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int, pos int"


def odd_documents(spark):
    long_text = "wörd " * 60_000
    rows = [(i, "s", "en", i, f"text {i}", "x", 1, 2) for i in range(300)]
    rows += [(7, "s", "en", 7, "text 7", "y", 1, 2), (7, None, "en", 7, "other", "y", 1, 2), (3, "s", "en", 3, "text 3", "x", 1, 2)]
    rows += [(None, "s", "de", None, None, None, None, None), (900, "", "de", 4, "", "", 0, 0), (901, "s", "de", 1, long_text, "", 0, 0)]
    rows += [(902, "s", None, None, "no language", "", 0, 0), (903, "s", "Zz", 1, "alone", "", 0, 0), (904, "ü", "ßz", 2, "a", "", 0, 0)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, add=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The root and, for each leaf, (side, sibling) level by level."""
    ways, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            other = level[p ^ 1] if p ^ 1 < len(level) else None
            ways[i].append((p & 1, other))
            at[i] = p // 2
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], ways


def plain_manifest(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)), r) for r in rows if r["lang"] == lang)
        own = [r for _, r in own]
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, above = plain_tree([t[1] for t in trees])
    out = []
    for (own, subroot, ways), up in zip(trees, above):
        for r, way in zip(own, ways):
            way = way + up
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = plain_leaf(r, int(tampered))
            for side, other in way:
                h = sha(other, h) if side else sha(h, other or "")
            out.append((r["doc_id"], plain_leaf(r), subroot, root, sha(*(o for _, o in way if o)), h, h == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("step", [8, 3])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, step):
    monkeypatch.setattr(merkle, "STEP", step)              # 3: several blocks and steps
    docs = odd_documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = order(tuple(r) for r in queries.QUERIES["op11_merkle"](spark, str(tmp_path)).collect())
    assert got == order(plain_manifest(docs.collect()))
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark, tmp_path):
    docs = odd_documents(spark)
    for name, keep in (("one", "doc_id = 903"), ("none", "doc_id < -1"), ("two", "doc_id in (903, 904)")):
        own = docs.where(keep)
        own.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = order(tuple(r) for r in queries.QUERIES["op11_merkle"](spark, f"{tmp_path}/{name}").collect())
        assert got == (order(plain_manifest(own.collect())) if own.count() else [])


def test_a_changed_text_fails(spark):
    docs = odd_documents(spark).limit(20)
    whole = merkle.manifest(docs, FIELDS, also={"changed": merkle.leaf_digest(*(
        F.concat("text", F.lit("!")) if f == "text" else F.col(f) for f in FIELDS))})
    for r in merkle.folded(whole, "changed").collect():
        same = bytes(r["changed"]) == bytes(r["leaf"])     # a null text stays null
        assert (r["folded_root"] == bytes(r["root"]).hex()) == same
    assert all(merkle.fold(bytes(r["leaf"]), merkle.steps(bytes(r["proof"]))) == bytes(r["root"]) for r in whole.collect())


# -- reply trees ------------------------------------------------------------

def plain_chat(rows):
    """op12 by hand: turns in order, escaping character by character."""
    by = {}
    for r in [*rows, *[{"conv_id": -7, "turn": t, "role": role, "text": "</s>[INST] ok [/INST]"} for t, role in enumerate(("user", "assistant"))]]:
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))

    def grown(text):
        return sum(1 + (c == "\\" or any(text.startswith(s, i) for s in chat.CONTROL)) for i, c in enumerate(text))

    out = []
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), 0))
        loss = "".join(t for _, role, t in own if role == "assistant")
        digest = sha(*(f"{role}\n{t}\n" for _, role, t in own))
        chars = sum(len(chat.START) + len(chat.END) + 1 + grown(role) + role.count("\n") + grown(t) for _, role, t in own)
        out.append((conv, len(own), digest, len(loss), sha(loss), chars))
    return out


def test_op12_equals_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    bits = ["a", "\\", "\n", "<", "|", "im_end|>", "<|im_end|>", "<|im_end|>\n", "<|im_start|>", "</s>", "<s>", "[INST]", "[/INST]", "日", "😀", "$1", "E\\E"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))), "x")
            for c in range(40) for t in range(rnd.randint(1, 9))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}", "x") for t in range(300)]
    rows += [(None, 0, None, "no id", "x"), (None, 1, "assistant", None, "x"), (101, 0, "ro\nle\\", "<|im_end|>\n", "x"),
             (102, 0, "assistant", "word </s> " * 20_000, "x"), (103, None, "user", "no turn", "x"),
             (104, 0, "user", "again", "x"), (104, 0, "user", "again", "x"), (104, 1, "assistant", "again", "x")]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, path string").repartition(3)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = order(tuple(r) for r in queries.QUERIES["op12_chat"](spark, str(tmp_path)).collect())
    assert got == order(plain_chat([r.asDict() for r in table.collect()]))
    table.where("conv_id < -1").write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r["conv_id"] for r in queries.QUERIES["op12_chat"](spark, f"{tmp_path}/none").collect()] == [-7]


@pytest.mark.parametrize("branches", [1, 2, 1000])
def test_branches_of_random_trees(spark, branches):
    rnd = random.Random(branches)
    parent = {f"m{i}": f"m{rnd.randrange(i)}" if i and rnd.random() < 0.97 else None for i in range(400)}
    parent |= {"long0": None} | {f"long{i}": f"long{i - 1}" for i in range(1, 130)}
    parent |= {"lost": "unknown", "c1": "c2", "c2": "c1"}                       # a circle has no root
    score = {m: rnd.choice([0.0, 0.5, 1.0, None]) for m in parent}
    links = spark.createDataFrame([(m, p, score[m]) for m, p in parent.items()], "id string, parent string, score double")
    got = {}
    for r in chat.chosen_paths(links, branches).collect():
        got.setdefault(r["path"], []).append((r["place"], r["id"]))
    leaves = {m for m in parent} - {p for p in parent.values()} - {"c1", "c2"}
    by_root = {}
    for leaf in leaves:
        way = [leaf]
        while parent.get(way[-1]) in parent:
            way.append(parent[way[-1]])
        mean = sum(score[m] or 0.0 for m in way) / len(way)
        by_root.setdefault(way[-1], []).append((-mean, leaf, way[::-1]))
    want = {leaf: list(enumerate(way)) for own in by_root.values() for _, leaf, way in sorted(own)[:branches]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_trees_are_formatted(spark):
    links = spark.createDataFrame([(1, None, 0.0), (2, 1, 0.2), (3, 1, 0.9), (4, 3, 0.1), (5, 9, 0.0)], "id int, parent int, score double")
    contents = spark.createDataFrame([(i, f"t{i}", "user" if i == 1 else "assistant", f"<s>{i}") for i in range(1, 6)],
                                     "id int, name string, role string, text string")
    rows = {r["path"]: r for r in chat.read_back(chat.format_trees(links, contents)).collect()}
    assert set(rows) == {4, 5} and [tuple(t) for t in rows[4]["turns"]] == [
        ("user", "<s>1"), ("assistant", "<s>3"), ("assistant", "<s>4")]
    assert rows[4]["loss_text"] == ["<s>3", "<s>4"] and "<s>" not in rows[4]["formatted"]
    assert chat.format_trees(links.where("id < 0"), contents).collect() == []


# -- whitening --------------------------------------------------------------

def plain_whitened(vectors):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * c - t) ** 2 for c, t in zip(row, s)) for row in x]
    z = np.array([[float(n * c - t) / n for c, t in zip(row, s)] for row in x])
    values, vectors_ = np.linalg.eigh(z.T @ z / n)
    return deviation, z, values[::-1], vectors_[:, ::-1].T


@pytest.mark.parametrize("n,width", [(400, 40), (90, 5), (25, 60)])
def test_whitening_equals_brute_force(spark, tmp_path, n, width):
    r = np.random.default_rng(n)
    data = (r.standard_normal((n, width)) * r.uniform(0.1, 3, width)).astype(np.float32).astype(float).tolist()
    data[3] = data[2]                                                            # repeated vectors
    odd = [(None, data[0]), (1000, None), (1001, [float("nan")] * width), (1002, [float("inf")] * width),
           (1003, [None] * width), (1004, [1.0] * (width + 1)), (1005, [])]
    rows = [(i, v) for i, v in enumerate(data)] + odd
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, component int").repartition(3)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_whiten"](spark, str(tmp_path)).collect()
    ids = [*range(n), None]
    deviation, z, values, vectors = plain_whitened([*data, data[0]])
    rank = int((values > 1e-12 * values[0]).sum())
    k = min(32, width, rank)
    assert len(got) == (n + 1) * k and {r["n"] for r in got} == {n + 1}
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert [by[i, 1]["deviation"] for i in ids] == deviation
    assert max(r["identity_error"] for r in got) < 1e-8
    for c in range(1, k + 1):
        assert by[0, c]["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)
        own = np.array([by[i, c]["whitened"] for i in ids])
        want = z @ vectors[c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-6
    white = np.array([[by[i, c]["whitened"] for c in range(1, k + 1)] for i in ids])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(k)).max() < 1e-8


def test_whitening_without_spread(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    for rows in ([], [(1, [0.5, 0.2])], [(i, [0.5, 0.2]) for i in range(9)], [(1, None)]):
        assert whiten.whitened(whiten.quantized(frame(rows))).collect() == []
    flat = whiten.whitened(whiten.quantized(frame([(i, [float(i), 3.0, 2.0 * i]) for i in range(8)]))).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)


@pytest.mark.parametrize("values", [[3.0] * 12, [5.0] * 6 + [1.0] * 6, [1.0, 1.0 - 1e-13, 0.5, 0.5, 0.1, 0.0], [2.0]])
def test_eigenvectors_of_clusters(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    found, vectors = whiten.leading(a, len(values))
    assert np.abs(found - sorted(values, reverse=True)).max() < 1e-13 * len(values)
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-13 * len(values)


def test_large_numbers_stay_exact(spark):
    rows = spark.createDataFrame([(i, [10 ** 9 * i + 7, i]) for i in range(6)], "vec_id int, x array<long>")
    got = {r["vec_id"]: r["deviation"] for r in whiten.whitened(rows, 1).collect()}
    sums = [sum(10 ** 9 * i + 7 for i in range(6)), 15]
    want = {i: (6 * (10 ** 9 * i + 7) - sums[0]) ** 2 + (6 * i - 15) ** 2 for i in range(6)}
    assert got == {i: d if d < 2 ** 63 else None for i, d in want.items()} and None in got.values()

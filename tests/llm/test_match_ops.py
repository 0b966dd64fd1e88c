"""Near duplicates, vectors and language-model scores against brute force, and odd inputs."""

import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitory.llm import ann, caps, jaccard, mixing
from visitory.llm.common import connected_components

DOC = "doc_id long, text string, lang string, node string, bands string"


def _roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rnd = random.Random(4)
    chain = [(k, k + 1) for k in range(200)]
    links = chain + [(rnd.randint(300, 500), rnd.randint(300, 500)) for _ in range(120)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = _roots(501, links)
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def _near_texts():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    base = [rnd.choices(words, k=rnd.randint(8, 80)) for _ in range(25)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rnd.randint(0, 6)):
            c = list(b)
            for _ in range(rnd.randint(0, 3)):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            texts.append(" ".join(c) if rnd.random() < 0.8 else " ".join(c).upper() + "!")
    crowd = rnd.choices(words, k=120)
    for _ in range(60):  # a large group of near copies
        c = list(crowd)
        c[rnd.randrange(len(c))] = "x" + str(rnd.random())
        texts.append(" ".join(c))
    return texts + ["same text here", "same text here", "one", "One!", "two", "", None, "!!!", "!!!", "?!"] + [texts[0]] * 5 + ["long " * 30_000]


@pytest.mark.parametrize("chunk", [2048, 7])
def test_jaccard_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", chunk)
    texts = _near_texts()
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links = []
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            same = bool(texts[a]) and texts[a] == texts[b]
            both = len(sets[a] & sets[b])
            if same or (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9):
                links.append((a, b))
    count, root = Counter(x for p in links for x in p), _roots(len(texts), links)
    rows = [(k, t, "en", "n", "b") for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    assert {k: (r.class_id, r.n_links, r.kept) for k, r in got.items()} == {k: (root[k], count[k], root[k] == k) for k in range(len(texts))}


def test_jaccard_odd_rows(spark):
    rows = [(5, "a b c d e f", None, None, None)] * 2 + [(3, "a b c d e f", None, None, None), (None, "a b c d e f", None, None, None), (9, None, None, None, None)]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOC)).collect()), key=str)
    assert got == sorted([(3, 3, 2, True), (5, 3, 2, False), (5, 3, 2, False), (None, None, 0, True), (9, 9, 0, True)], key=str)
    assert jaccard.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


VEC = "vec_id long, embedding array<float>, label int, vector string, node string"


def _vectors():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24))
    near = x[:40] + rng.normal(size=(40, 24)) * 0.15
    crowd = x[50] + rng.normal(size=(60, 24)) * 0.1
    x = np.concatenate([x, near, crowd, x[:5]]).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 20, (len(x), 1))


def _vector_rows(x):
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [None] * 24), (9005, [1.0, 2.0]), (9050, [float("inf")] * 24), (None, [1.0] * 24), (9006, [])]
    return [(k, v.tolist(), 1, "v", "n") for k, v in enumerate(x.astype(np.float32))] + [(i, v, None, None, None) for i, v in odd]


@pytest.mark.parametrize("chunk", [1024, 8])
def test_caps_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(caps, "CHUNK", chunk)
    x = _vectors().astype(np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    links = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if cosine[a, b] >= 0.95]
    count, root = Counter(k for p in links for k in p), _roots(len(x), links)
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame(_vector_rows(x), VEC)).collect()}
    assert len(got) == len(x) + 8
    assert {k: (got[k].n_links, got[k].component_id, got[k].kept) for k in range(len(x))} == {k: (count[k], root[k], root[k] == k) for k in range(len(x))}
    assert all(got[k].n_links == 0 and got[k].kept for k in range(9001, 9007))
    assert got[None].n_links == 0
    assert caps.near_vectors(spark.createDataFrame([], VEC)).count() == 0


def test_nearest_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    x = _vectors().astype(np.float32).astype(float)
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    got = ann.nearest(spark.createDataFrame(_vector_rows(x), VEC), F.col("vec_id") % 25 == 0).collect()
    right = total = 0
    for q in range(0, len(x), 25):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and all(r.vec_id != q for r in mine)
        assert all(abs(r.score - cosine[q, r.vec_id]) < 1e-12 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        want = sorted((k for k in range(len(x)) if k != q), key=lambda k: (-cosine[q, k], k))[:5]
        right, total = right + len({r.vec_id for r in mine} & set(want)), total + 5
    assert right >= 0.9 * total and not any(r.query_id >= 9000 for r in got)
    few = ann.nearest(spark.createDataFrame(_vector_rows(x[:3])[:3], VEC), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert ann.nearest(spark.createDataFrame([], VEC), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 4, 8, 11, 12, 16])
def test_near_vectors_of_few_dimensions_share_a_cell(dims):
    made, rng = caps.Cells(dims, 0.95), np.random.default_rng(6)
    a, b = rng.normal(size=(2, 800, dims))
    a = caps.units(a)
    b = caps.units(b - (a * b).sum(axis=1, keepdims=True) * a + (1e-3 if dims == 1 else 0))
    x, y = made.listed(a), made.listed(0.95 * a + np.sqrt(1 - 0.95**2) * b if dims > 1 else a)
    assert all(len(np.intersect1d(p, q)) for p, q in zip(x, y, strict=True))
    assert np.mean([len(p) for p in x]) < 120 and all(len(np.unique(p)) == len(p) for p in x)


def test_caps_of_few_dimensions_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(500, 3)), rng.normal(size=(1, 3)) + 0.01 * rng.normal(size=(80, 3))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    links = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if cosine[a, b] >= 0.95]
    count, root = Counter(k for p in links for k in p), _roots(len(x), links)
    got = caps.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {k: (count[k], root[k]) for k in range(len(x))}


@pytest.mark.parametrize("dims", [17, 24, 32, 64])
def test_near_vectors_share_filters_in_large_tables(dims):
    made, rng = caps.Filters(dims, 1_000_000), np.random.default_rng(5)
    a, b = rng.normal(size=(2, 1500, dims))
    a = caps.units(a)
    b = caps.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    lists = zip(made.listed(a), made.listed(0.95 * a + np.sqrt(1 - 0.95**2) * b), strict=True)
    assert sum(not len(np.intersect1d(x, y)) for x, y in lists) == 0


def test_scores(spark):
    rnd = random.Random(6)
    langs = {"en": "the and of to in was with that".split(), "fr": "le la des une que dans pour est".split()}
    rows = []
    for k in range(120):
        lang = "en" if k % 3 else "fr"
        rows.append((k, " ".join(rnd.choices(langs[lang], k=40) + [f"{rnd.choice('abc')}{rnd.choice('xyz')}{rnd.randint(0, 99)}"]).title(), lang))
    rows += [(900, None, "en"), (901, "", None), (902, "x" * 100_000, "en"), (None, "the cat", None), rows[7]]
    got = mixing.scores(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("block", F.lit(1)).withColumn("word", F.lit("w"))).collect()
    assert len(got) == len(rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    count = Counter(w for d, t, _ in rows if not held(d) for w in [*(t or "").encode().lower().split(), b""])
    n, v = sum(count.values()), len(count)
    want = {d: [*(t or "").encode().lower().split(), b""] for d, t, _ in rows}
    better = total = 0
    for r in got:
        words = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(words), sum(count[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
        if r.doc_id is not None and r.doc_id < 120 and r.held_out:
            better, total = better + (r.score > r.base_score), total + 1
    assert better > 0.5 * total
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert mixing.scores(empty).count() == 0
    alone = mixing.scores(spark.createDataFrame([(k, "aa bb", None) for k in range(30) if held(k)], "doc_id long, text string, lang string")).collect()
    assert alone and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in alone)


def test_scores_follow_order_and_not_partitions(spark):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(8)]
    texts = [" ".join(f"{w} {w}x" for w in rnd.choices(words, k=30)) for _ in range(120)]
    own = texts[3].split()
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(500, " ".join(own), "en"), (501, " ".join(sorted(own)), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = {r.doc_id: r.score for r in mixing.scores(docs.repartition(1)).collect()}
    many = {r.doc_id: r.score for r in mixing.scores(docs.repartition(5)).collect()}
    assert all(math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)
    assert one[500] > one[501] + 1


def test_held_out_texts_do_not_change_the_model(spark):
    """Words of one training document that also stand in held-out ones, which other blocks hold, are learned once."""
    rnd = random.Random(12)

    def rare(k):
        return "".join(rnd.choices("abcdefghij", k=6)) + str(k)

    own = [rare(k) for k in range(150)]
    rows = [(k, " ".join([own[k % 150], *rnd.choices(own, k=6), *(f"w{rnd.randrange(9)}" for _ in range(20))]), "en") for k in range(400)]
    rows = [(k, t if zlib.crc32(str(k).encode()) % 5 == 1 else " ".join([own[k % 150] if k < 150 else "w1", *t.split()[7:]]), "en") for k, t, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, six, many = ({r.doc_id: r.score for r in mixing.scores(docs.repartition(n)).collect()} for n in (1, 6, 17))
    assert all(math.isclose(one[k], six[k], rel_tol=1e-9) and math.isclose(one[k], many[k], rel_tol=1e-9) for k in one)
    # and scores of training documents stay when held-out ones go
    train = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1")
    alone = {r.doc_id: r.score for r in mixing.scores(train).collect()}
    assert len(alone) < len(one) and all(math.isclose(one[k], alone[k], rel_tol=1e-9) for k in alone)


def test_weights_are_fitted_on_all_training_words(spark, monkeypatch):
    """Even if no word is drawn to start from, weights and refinement come from the training words, and are the better for it."""
    rnd = random.Random(13)
    rows = [(k, " ".join(f"{rnd.choice('abc')}{rnd.choice('xyz')}{rnd.randrange(30)}" for _ in range(40)) + f" q{k}z{rnd.randrange(10**6)}", "en") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    full, found = mixing._fitted, []
    monkeypatch.setattr(mixing, "FIT_TOKENS", 0)
    monkeypatch.setattr(mixing, "FIT_WORDS", 0)
    monkeypatch.setattr(mixing, "_fitted", lambda *a: found.append(full(*a)) or found[-1])
    fitted = sum(r.score for r in mixing.scores(docs).filter("held_out").collect())
    mixer, speller = found[0]
    assert np.ptp(mixer.weights) > 0.05 and np.ptp(speller.weights) > 0.001
    plain = mixing.Mixer(mixer.table, mixer.sizes), mixing.Speller(speller.table)
    assert abs(mixer.refined - plain[0].refined).max() > 0.01
    monkeypatch.setattr(mixing, "_fitted", lambda *a: plain)
    assert fitted > sum(r.score for r in mixing.scores(docs).filter("held_out").collect())


def _small_block(texts, spelled=-20.0, follows=()):
    import xxhash

    words, seqs = {}, []
    for t in texts:
        seqs.append([words.setdefault(w, len(words)) for w in [*t.encode().split(), b""]])
    place = np.array([p for q in seqs for p in q])
    c = np.bincount(place, minlength=len(words)).astype(np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(w) >> 32 for w in words], np.uint32)
    g = np.arange(len(words)) % 2
    held = {}
    for k, x, n in zip(mixing.bit_length(c).tolist(), g.tolist(), c.tolist(), strict=True):
        w, t = held.get((k, x), (0, 0))
        held[k, x] = (w + 1, t + n)
    code = mixing.Code(2, held)
    block = mixing.Block(code, place, np.array([len(q) for q in seqs]), np.zeros(len(seqs), bool), np.arange(len(seqs)).astype(np.uint64), c, g, h, np.ones(len(words)), np.full(len(words), spelled), np.array(follows, np.int64).reshape(-1, 5))
    return code, block, c, g


def test_code_is_a_prefix_code():
    code = _small_block(["a b b c c c d d d d e", "a a a b f g h"])[0]
    paths = ["".join(map(str, code.turns[f : f + n])) for f, n in zip(code.first, code.depth, strict=True)]
    assert math.isclose(sum(2.0 ** -len(x) for x in paths), 1.0)
    assert not any(a != b and b.startswith(a) for a in paths for b in paths)


def test_bits_equal_a_plain_walk():
    """The bits and their probabilities, token by token in plain Python, from the same tables."""
    rnd = random.Random(4)
    code, block, c, g = _small_block([" ".join(rnd.choices("abcdefgh", k=90)), "", "z y z", "a b a b a"])
    sizes = (10, 10, 10, 10)
    table = mixing._small(np.random.default_rng(3).integers(0, 9, (4 << 10, 2)).astype(np.float32))
    mixer = mixing.Mixer(table, sizes, np.random.default_rng(4).uniform(0, 0.6, (4, 4, mixing.LEVELS)))
    got = mixer.scores(block)
    start = 0
    for d, size in enumerate(block.sizes):
        total, ones, seen = 0.0, Counter(), Counter()
        events = []
        for a, b in block.batches():
            token, kind, bit, name = block.events(a, b)
            slots = list(block.slots(token, name, sizes))
            events += [(int(t), int(k), int(x), [int(s[i]) for s in slots]) for i, (t, k, x) in enumerate(zip(token, kind, bit, strict=True)) if start <= t < start + size]
        waiting, at = [], -1
        for t, k, x, slot in sorted(events, key=lambda e: e[0]):
            pos = int(t - start)
            part = (pos >> 6).bit_length()
            if part != at:
                for cell, hit in waiting:
                    seen[cell] += 1
                    ones[cell] += hit
                waiting, at = [], part
            dot = 0.0
            for j, s in enumerate(slot):
                n0, n1 = int(table[s]) & 4095, int(table[s]) >> 12
                dot += mixer.weights[k, j, min(int(math.log2(n0 + n1 + 1)), mixing.LEVELS - 1)] * (math.log(n1 + 0.02) - math.log(n0 + 0.02))
            dot = min(12.0, max(-12.0, dot))
            cell = (k, round(dot * 2))
            p = (1 / (1 + math.exp(-dot)) + (mixing.PRIOR * mixer.refined[k, cell[1] + mixing.STEPS // 2] + ones[cell]) / (mixing.PRIOR + seen[cell])) / 2
            total += math.log(p if x else 1 - p)
            waiting.append((cell, x))
        assert math.isclose(got[d], total, rel_tol=1e-4, abs_tol=1e-4)
        start += size


def test_passages_cost_one_bit():
    block = _small_block(["a b c d e f g h i j", "a b c d e f g h i j"], follows=[(1, 8, 3, 2, 4)])[1]
    assert block.covered.tolist() == [False] * 11 + [False] * 8 + [True] * 3
    token, kind, bit, _ = block.events(0, 22)
    assert [(int(t), int(x)) for t, k, x in zip(token, kind, bit, strict=True) if k == mixing.FOLLOW] == [(19, 1)]
    assert not set(token[kind != mixing.FOLLOW].tolist()) & {19, 20, 21}


def test_spelling_is_a_probability():
    model = mixing.Speller(mixing._small(np.random.default_rng(1).integers(0, 5, (mixing._BASE[-1], 2)).astype(np.float32)))
    for _ in range(3):
        model.learn([b"abc", b"abd", b"b", b""])
    # all first bytes together: each bit splits what is left
    total = 0.0
    for first in range(256):
        p = 1.0
        for bit, slots in mixing._Bits([bytes([first])]).each():
            odds, gates = model._inputs(bit[:1], [s[:1] for s in slots], np.zeros(1, np.int64))
            dot = sum(model.weights[k][g] * o for k, (o, g) in enumerate(zip(odds, gates, strict=True)))
            one = 1 / (1 + math.exp(-float(dot[0])))
            p *= one if bit[0] else 1 - one
        total += p
    assert abs(total - 1) < 1e-6


def test_long_words_take_bounded_memory():
    code = (
        "import resource, numpy as np\nfrom visitory.llm import mixing\n"
        "word = np.random.default_rng(1).integers(97, 123, 10_000_000).astype(np.uint8).tobytes()\n"
        "model = mixing.Speller(mixing._small(np.zeros((mixing._BASE[-1], 2), np.float32)))\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nmodel.spell([word], np.zeros(1))\n"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)"
    )
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=240).stdout) < 500

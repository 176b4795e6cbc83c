"""Near copies, embedding links and nearest neighbours against brute force."""

import numpy as np
import pytest
import xxhash

from codexflow.llm import embedding_dedup, nearest, simhash
from codexflow.llm.common import written
from codexflow.llm.components import components
from codexflow.llm.queries import QUERIES


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def fingerprint(text, words=3):
    own = (text or "").encode().lower().split()
    shingles = [own] if 0 < len(own) < words else [own[i:i + words] for i in range(len(own) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7_rows(spark, sf, small):
    docs = sorted(small.collect(), key=lambda r: r["doc_id"])
    prints = [fingerprint(r["text"]) for r in docs]
    own = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    got = sorted(tuple(r) for r in QUERIES["op7_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == [(d["doc_id"], f"{p:016x}", docs[c]["doc_id"]) for d, p, c in zip(docs, prints, own)]


def test_near_pairs_lose_nothing(spark):
    random = np.random.default_rng(4)
    values = {0}
    for _ in range(40):
        base = int(random.integers(0, 2 ** 63, dtype=np.uint64))
        values |= {base} | {base ^ int(sum(1 << int(b) for b in random.choice(64, k, replace=False))) for k in (1, 2, 3, 4, 3, 3, 2)}
    values = sorted(v - 2 ** 64 if v >= 2 ** 63 else v for v in values)
    got = {tuple(sorted(r)) for r in simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fingerprint long"), 3).collect()}
    assert got == {(a, b) for i, b in enumerate(values) for a in values[:i] if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3}


def test_link_odd_rows(odd, empty):
    rows = simhash.link(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r["component"] for r in rows}
    assert by_id[0] == by_id[1] == by_id[2] == 0 and by_id[4] == by_id[5] == 4
    assert simhash.link(empty).count() == 0


def test_group_keeps_the_similarity(spark, odd, empty):
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    base = [list(random.choice(words, 300)) for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:  # one changed word touches five shingles of 296; forty changed words leave no similarity of 0.8
        near, far = list(b), list(b)
        near[150] = "changed"
        for k in range(0, 300, 8):
            far[k] = "other"
        texts += [" ".join(near), " ".join(far), " ".join(b).upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    own = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert sorted((r["doc_id"], r["component"]) for r in simhash.group(df).collect()) == list(enumerate(own))
    got = simhash.group(odd)
    assert got.count() == odd.count() and simhash.group(empty).count() == 0
    assert {r["doc_id"]: r["component"] for r in got.collect()}[5] == 4


def jaccard_roots(texts, least=0.8):
    sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(max(len(t.split()) - 4, 1))} for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]
    return roots(len(texts), links), len(links)


def changed(words, places, tag):
    """The words with those at the given places replaced; each place touches five shingles."""
    return [f"{tag}x{i}" if i in places else w for i, w in enumerate(words)]


@pytest.mark.parametrize("cell", [1024, 16])
def test_group_links_pairs_behind_a_smaller_sibling(spark, cell):
    """A family of one template, most under 0.8 to each other: its pairs over 0.8 are all linked, whoever leads the buckets."""
    random = np.random.default_rng(3)
    base = [f"w{i}" for i in random.integers(0, 5000, 204)]
    places = lambda: {7 + 10 * int(p) for p in random.choice(19, 4, replace=False)}
    texts = [" ".join(changed(base, places(), f"s{k}")) for k in range(60)]
    for k in range(12):  # a sibling, and the same with four more words changed: 180 of 220 shingles
        sibling = changed(base, places(), f"p{k}")
        texts += [" ".join(sibling), " ".join(changed(sibling, {p + 5 for p in places()}, f"q{k}"))]
    own, links = jaccard_roots(texts)
    assert links >= 12 and len(set(own)) > 30
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r["doc_id"], r["component"]) for r in simhash.group(df, cell=cell).collect()) == list(enumerate(own))


def test_group_hands_on_rows_in_proportion_to_a_family(spark, monkeypatch):
    """A family of one template at similarities from 0.70 to 0.78: its pairs grow with the square, the rows handed on do not."""
    counts: dict = {}

    def counted(df, name):
        out = written(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(simhash, "written", counted)
    found = []
    for n in (100, 200, 400):
        random = np.random.default_rng(11)
        base = [f"w{i}" for i in random.integers(0, 10 ** 6, 204)]
        texts = [" ".join(changed(base, {5 + 5 * int(p) for p in random.choice(38, int(random.integers(5, 7)), replace=False)}, f"s{k}x")) for k in range(n)]
        own, _ = jaccard_roots(texts)
        counts.clear()
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted((r["doc_id"], r["component"]) for r in simhash.group(df, cell=64).collect()) == list(enumerate(own))
        found.append(dict(counts))
        assert counts["crossing-links"] < n * 16
    for name in ("partnered-members", "crossing-links", "close-pairs"):
        assert found[2][name] <= 10 * found[0][name] + 400  # four times the texts; in cells of 64, up to four blocks


def test_keep_first_loses_no_text(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a, "x"), (1, b, "x"), (2, a, "x"), (3, b.upper(), "x"), (1, a, "x"), (1, a, "y"), (None, b, "x"), (None, "c d e f g h", "x"), (None, "c d e f g h", "x")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a, "x"), (1, b, "x"), (None, "c d e f g h", "x")], key=str)


def test_group_links_every_pair_just_over_the_similarity(spark):
    """300 pairs between 0.80 and 0.85, short and long, none lost."""
    random = np.random.default_rng(8)
    texts, pairs = [], []
    for k in range(300):
        n = int(random.integers(40, 260))
        a = [f"w{i}" for i in random.integers(0, 10 ** 6, n + 4)]
        lost = int(n / 9 / 5)  # a ninth of the shingles may differ on either side
        b = changed(a, {4 + 5 * int(p) for p in random.choice((n - 4) // 5, max(lost, 1), replace=False)}, f"c{k}")
        sets = [{tuple(t[i:i + 5]) for i in range(n)} for t in (a, b)]
        pairs.append(len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]))
        texts += [" ".join(a), " ".join(b)]
    assert sum(pairs) > 250
    got = {r["doc_id"]: r["component"] for r in simhash.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[2 * k + 1] == 2 * k for k in range(300)] == pairs


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 150)], [(5, 5), (7, 6), (6, 7), (9, 8), (8, 7)]])
def test_components(spark, links):
    n = 1 + max((max(p) for p in links), default=0)
    own = roots(n, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: own[x] for p in links if p[0] != p[1] for x in p}


ODD_VECTORS = [None, [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0], [1.0, 2.0, 3.0], [1.0, 2.0, 3.0],
               [2.0, 4.0, 6.0], [-1.0, -2.0, -3.0], [1.0, 2.0], [], [1.0, 2.0, 3.1]]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [(i, v, 1, "x", 0) for i, v in enumerate(ODD_VECTORS)] + [(None, [1.0, 2.0, 3.0], 1, "x", 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, vector string, id int")


def clusters(n, dims, seed):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(n, dims))
    x = np.concatenate([c + random.normal(size=(k, dims)) * 0.2 for c, k in zip(centres, random.integers(1, 30, n))])
    return np.concatenate([x, x[:40], x[:40], np.repeat(x[:1], 50, axis=0)])


@pytest.mark.parametrize("cell", [1024, 16])
def test_embedding_links(spark, cell):
    x = clusters(25, 48, 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    rows = sorted(embedding_dedup.link(df, cell=cell).collect())
    links = np.array([r["n_links"] for r in rows])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.98 * near.sum()
    own = roots(len(x), np.argwhere(near).tolist())
    assert np.mean([r["component"] == c for r, c in zip(rows, own)]) >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component"]) for r in rows)


def test_embedding_links_odd_rows(odd_vectors):
    rows = {r["vec_id"]: r for r in embedding_dedup.link(odd_vectors).collect()}
    assert len(rows) == len(ODD_VECTORS) + 1
    for i in (0, 1, 2, 3, 4, 8, 9, 10, None):
        assert (rows[i]["n_links"], rows[i]["component"], rows[i]["kept"]) == (0, i, True)
    assert [rows[i]["n_links"] for i in (5, 6, 7, 11)] == [3, 3, 3, 3] and {rows[i]["component"] for i in (5, 6, 7, 11)} == {5}
    assert embedding_dedup.link(odd_vectors.limit(0)).count() == 0


def test_op10_rows(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    u = np.stack(x["embedding"]).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    rows = sorted(QUERIES["op10_embedding_dedup"](spark, sf).collect())
    assert [r["n_links"] for r in rows] == near.sum(axis=1).tolist()


@pytest.mark.parametrize("block", [4096, 32])
def test_nearest(spark, block):
    x = clusters(30, 40, 5) * np.linspace(0.5, 2, 40)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = nearest.search(df, df.filter("vec_id % 7 = 0"), k=10, block=block).collect()
    found, hits = {}, 0
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q, got in found.items():
        scores = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:10]
        assert len(got) == 10 and q not in [i for i, _ in got]
        assert np.allclose([s for _, s in got], [scores[i] for i, _ in got], rtol=0, atol=1e-12)
        assert got == sorted(got, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in got} & set(order))
    assert len(found) == len(range(0, len(x), 7)) and hits >= 0.9 * 10 * len(found)


def test_nearest_ties_and_odd_rows(spark, odd_vectors):
    rows = nearest.search(odd_vectors, odd_vectors, k=20).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(by_query) == {5, 6, 7, 8, 11}
    assert sorted(by_query[8]) == [(1, 5), (2, 6), (3, 11), (4, 7)]
    assert nearest.search(odd_vectors.limit(0), odd_vectors).count() == 0


def test_op2_recall(spark, sf):
    x = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    v, ids = np.stack(x["embedding"]).astype(float), x["vec_id"].to_numpy()
    hits = total = 0
    rows = QUERIES["op2_nearest"](spark, sf).toPandas()
    for q, got in rows.groupby("query_id"):
        scores = v @ v[ids == q][0]
        scores[ids == q] = -np.inf
        hits += len(set(got["vec_id"]) & set(ids[np.argsort(-scores)[:20]]))
        total += 20
    assert rows["query_id"].nunique() == (ids % 20 == 0).sum() and hits >= 0.9 * total


def test_fingerprint_pairs_join_all_within_three_bits(spark):
    random = np.random.default_rng(8)
    base = random.integers(-2 ** 62, 2 ** 62, 60).tolist()
    prints = base + [p ^ (1 << i % 60) ^ (1 << (i * 7 + 3) % 60) ^ (1 << 61) for i, p in enumerate(base[:40])] + base[:20]
    pairs = simhash.fingerprint_pairs(spark.createDataFrame(list(enumerate(prints)), "node long, fingerprint long"))
    links = [tuple(r) for r in pairs.collect()]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (2 ** 64 - 1)).bit_count() <= 3]
    assert len(near) >= 60 and roots(len(prints), links) == roots(len(prints), near)


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """The pipeline's stage compares what multi-index hashing brings together, and its exact check decides."""
    met = []
    pairs = simhash.fingerprint_pairs

    def seen(nodes, bits=3):
        met.append(pairs(nodes, bits).count())
        return pairs(nodes, bits)

    monkeypatch.setattr(simhash, "fingerprint_pairs", seen)
    text = " ".join(f"word{i * 7 % 400}" for i in range(400))
    rows = [(1, text), (2, text + " tail"), (3, "something else altogether with its own words in it"), (4, None)]
    found = simhash.group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert dict(map(tuple, found.collect())) == {1: 1, 2: 1, 3: 3, 4: 4} and met == [1]

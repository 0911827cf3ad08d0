import numpy as np
import pytest
import xxhash

from foliomill.llm import simhash_dedup as S


def components(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def plain(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) > k else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_is_perfect():
    bits, errors = S.golay_tables()
    assert len({int(e) for e in errors}) == 2048 and max(bin(int(e)).count("1") for e in errors) == 3
    words = np.arange(0, 1 << 23, 9973)
    index, mask = S.codeword_indices(words)
    assert set(mask.sum(axis=1)) <= {1, 6}


def test_all_ways_to_spread_four_errors_share_a_key():
    rng = np.random.default_rng(9)
    for a in range(5):
        for b in range(5 - a):
            for c in range(5 - a - b):
                x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
                y = x.copy()
                for i in range(len(y)):
                    for at, n, width in ((0, a, 23), (23, b, 23), (46, c, 18)):
                        for bit in rng.choice(width, n, replace=False):
                            y[i] ^= np.uint64(1) << np.uint64(at + int(bit))
                shared = [set() for _ in x]
                r, k = S.fuzzy_keys(x.view(np.int64))
                for i, key in zip(r.tolist(), k.tolist()):
                    shared[i].add(key)
                r, k = S.fuzzy_keys(y.view(np.int64))
                assert {i for i, key in zip(r.tolist(), k.tolist()) if key in shared[i]} == set(range(len(x))), (a, b, c)


@pytest.mark.parametrize("errors", range(5))
def test_pairs_within_four_bits_share_a_key(errors):
    rng = np.random.default_rng(errors)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, errors, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for v in (x, y):
        r, k = S.fuzzy_keys(v.view(np.int64))
        by = [set() for _ in v]
        for i, key in zip(r.tolist(), k.tolist()):
            by[i].add(key)
        keys.append(by)
    assert all(a & b for a, b in zip(*keys))


def test_fingerprints_and_components(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [plain(t) for _, t in rows]
    found = S.near_copies(docs).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in found) == sorted((str(i), f"{p:016x}") for (i, _), p in zip(rows, prints))
    root = components(prints)
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == sorted((str(i), str(least[r])) for (i, _), r in zip(rows, root))


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    prints = [plain(t) for _, t in rows]
    root = components(prints)
    least = {r: min(i for (i, _), x in zip(rows, root) if x == r) for r in set(root)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.op9_simhash_dedup(spark, sf_dir).collect()}
    assert found == {i: (f"{p:016x}", least[r]) for (i, _), p, r in zip(rows, prints, root)}


def test_crowded_keys_give_the_same_components(spark, monkeypatch):
    """Dense groups and lone ones around them, with the pivots of crowded keys and without."""
    rng = np.random.default_rng(3)
    fps = set()
    for base in rng.integers(0, 1 << 62, 6).tolist():
        for _ in range(60):
            f = base
            for b in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                f ^= 1 << b
            fps.add(f)
    fps |= set(rng.integers(0, 1 << 62, 40).tolist())
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    root = components(fps)
    expected = {f: fps[min(j for j in range(len(fps)) if root[j] == r)] for f, r in zip(fps, root)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for crowd in (2, 24, 10_000):
        monkeypatch.setattr(S, "CROWD", crowd)
        from foliomill.llm.common import Scratch

        assert {r["fp"]: r["root"] for r in S.fingerprint_components(frame, Scratch(spark, "t")).collect()} == expected


def test_similar_copies(docs, empty):
    found = {(r["doc_id"], r["component_id"]) for r in S.similar_copies(docs).collect()}
    assert {(34, 33), (35, 33), (36, 33), (33, 33)} <= found
    assert (1, 1) in found and (38, 38) in found
    assert S.similar_copies(empty).count() == 0 and S.near_copies(empty).count() == 0


def test_similar_copies_in_crowds(spark, monkeypatch):
    """A dense group of near copies of different nearness: crowded keys or not, the groups are the same."""
    import random

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randint(0, 149)] = f"x{rng.randint(0, 5000)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for crowd in (2, 10_000):
        monkeypatch.setattr(S, "CROWD", crowd)
        found.append(sorted((r["doc_id"], r["component_id"]) for r in S.similar_copies(frame).collect()))
    assert found[0] == found[1] and 1 < len({c for _, c in found[0]}) < 120


def test_similar_copies_are_those_by_brute_force(spark):
    """Groups by the Jaccard similarity of distinct shingles: different texts with one line twenty times, and pairs on
    both sides of 0.8."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    line = " ".join(word() for _ in range(10))
    texts = [" ".join([*[line] * 20, *(word() for _ in range(100))]) for _ in range(12)]
    for changed in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10):
        for _ in range(3):
            words = [word() for _ in range(200)]
            other = list(words)
            for k in range(changed):
                other[10 + 18 * k] = word()
            texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            similarity = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += 0.7 <= similarity < 0.8
            if similarity >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    assert near >= 6 and len(set(root)) < len(texts)
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in root}
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.similar_copies(frame).collect()}
    assert found == {k: least[r] for k, r in enumerate(root)}


@pytest.mark.parametrize("crowd", (4, 10_000))
def test_a_crowded_key_is_settled_whole(crowd):
    """One key of a star, of a chain whose ends are far apart and of lone words: nodes are linked as by all pairs, and
    with few rows."""
    rng = np.random.default_rng(4)
    star = [int(rng.integers(1 << 62))]
    star += [star[0] ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in range(80)]
    chain = [int(rng.integers(1 << 62))]
    for _ in range(15):
        chain.append(chain[-1] ^ sum(1 << (4 * (len(chain) - 1) + k) for k in range(4)))
    fps = np.unique(np.array([*star, *chain, *rng.integers(0, 1 << 62, 60).tolist()], np.uint64)).view(np.int64)
    links = S.forest(*S.key_links(np.zeros(len(fps), np.int64), fps, fps.view(np.uint64)[:, None], 4, crowd, S.SPLITS))
    root = components(fps.tolist())
    least = {}
    for f, r in zip(fps.tolist(), root):
        least[r] = min(f, least.get(r, f))
    assert dict(zip(*(x.tolist() for x in links))) == {f: least[r] for f, r in zip(fps.tolist(), root) if f != least[r]}
    assert len(links[0]) < len(fps)


def test_no_join_is_made_under_a_key(spark):
    """Rows of crowded keys meet in a task: no join of keys or of their labels, whose rows grow with the group's square."""
    rng = np.random.default_rng(6)
    base = int(rng.integers(1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(62, 5, replace=False)) for _ in range(300)}
    from foliomill.llm.common import Scratch

    kept = []
    scratch = Scratch(spark, "t")
    keep = scratch.keep
    scratch.keep = lambda df, name, codec="zstd": kept.append(name) or keep(df, name, codec)
    root = components(sorted(fps))
    found = {r["fp"]: r["root"] for r in S.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long"), scratch).collect()}
    assert len(set(found.values())) == len(set(root))
    assert not {"pool", "groups", "heads", "left", "many"} & set(kept)


def test_pairs_at_the_edge_of_a_large_group_are_linked(spark):
    """Four hundred texts around one, of similarities below 0.8, and five of them with a twin: no pivot is near the
    twins, which share crowded keys only."""
    import random

    rng = random.Random(21)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(400):
        words = list(base)
        for j, at in enumerate((rng.randint(8, 45), rng.randint(55, 95), rng.randint(105, 145), rng.randint(155, 190))):
            words[at] = f"x{k}-{j}-{rng.randint(0, 10**6)}"
        texts.append(words)
    for k in range(0, 400, 80):
        words = list(texts[k])
        words[2] = f"y{k}"
        texts.append(words)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in root}
    frame = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in S.similar_copies(frame).collect()}
    assert found == {k: least[r] for k, r in enumerate(root)}
    assert all(found[400 + k] == found[80 * k] for k in range(5)) and len(set(root)) > 100

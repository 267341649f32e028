"""SimHash, suffix, recompression and embedding dedup against brute force."""

import numpy as np
import pytest

from docgraph.llm import rabitq, recompress, repeats, simhash, suffix
from tests.llm.conftest import frame, prose


def brute_groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids if find(i) != i}


def corpus():
    rng = np.random.default_rng(1)
    rows = [(i, prose(i, int(rng.integers(80, 300))), "s") for i in range(120)]
    for k in range(40):
        words = rows[k][1].split()
        for _ in range(int(rng.integers(0, max(1, len(words) // 60)))):
            words[int(rng.integers(0, len(words)))] = "changed"
        rows.append((200 + k, " ".join(words), "s"))
    rows += [(300, rows[0][1], "s"), (301, rows[0][1].upper(), "s")]
    return rows


def test_simhash_brute(spark):
    import pyarrow as pa

    rows = corpus()
    marks = simhash.fingerprints(pa.array([t for _, t, _ in rows]))
    d = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2)
    ids = [i for i, _, _ in rows]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if d[i, j] <= simhash.RADIUS}
    heads = spark.createDataFrame([(i, *map(int, m.view(np.int64))) for i, m in zip(ids, marks, strict=True)], "id long, h1 long, h2 long").dropDuplicates(["h1", "h2"])
    edges = [tuple(r) for r in simhash.near_pairs(heads).collect()]
    assert all((a, b) in want or (b, a) in want or brute_groups(ids, want).get(max(a, b), max(a, b)) == brute_groups(ids, want).get(min(a, b), min(a, b)) for a, b in edges)
    got = {r["doc_id"]: r["keep_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    full = brute_groups(ids, want)
    assert sum(got.get(k) == v for k, v in full.items()) >= 0.9 * len(full)
    assert set(got) <= set(full)
    assert got[300] == 0 and got[301] == 0


def test_simhash_recall_near_radius(spark):
    """Isolated pairs at 22 bits and more, up to the radius itself: at least nine tenths of each distance are linked."""
    rng = np.random.default_rng(21)
    n, steps = 2000, (22, 26, simhash.RADIUS)
    base = rng.integers(0, 2, (n, simhash.BITS)).astype(np.uint8)
    other = base.copy()
    for i in range(n):
        other[i, rng.choice(simhash.BITS, steps[i % 3], replace=False)] ^= 1
    marks = np.packbits(np.concatenate([base, other]), axis=1).view(np.int64)
    heads = spark.createDataFrame([(i, *m) for i, m in enumerate(marks.tolist())], "id long, h1 long, h2 long")
    found = {tuple(sorted(r)) for r in simhash.near_pairs(heads).collect()}
    assert all(b == a + n for a, b in found)
    for k in range(3):
        pairs = {(i, i + n) for i in range(k, n, 3)}
        assert len(found & pairs) >= 0.9 * len(pairs), steps[k]


def test_simhash_loses_no_link(spark):
    """All pairs at the radius itself are linked, and none beyond it, among strangers and at every way to cut."""
    rng = np.random.default_rng(4)
    n = 3000
    base = rng.integers(0, 2, (n, simhash.BITS)).astype(np.uint8)
    other = base.copy()
    for i in range(n):
        other[i, rng.choice(simhash.BITS, simhash.RADIUS + (i % 4 == 3), replace=False)] ^= 1
    marks = np.packbits(np.concatenate([base, other]), axis=1)
    heads = spark.createDataFrame([(i, *m) for i, m in enumerate(marks.view(np.int64).tolist())], "id long, h1 long, h2 long")
    want = {(i, i + n) for i in range(n) if i % 4 != 3}
    assert {tuple(sorted(r)) for r in simhash.near_pairs(heads).collect()} == want
    marks = np.concatenate([marks[:250], marks[n : n + 250]]).view(np.uint64)
    for count in range(8, 18, 2):
        parts = simhash.cut_parts(count, simhash.RADIUS)
        assert sum(p.width for p in parts) == simhash.BITS and sum(p.tolerance + 1 for p in parts) == simhash.RADIUS + 1
        found = {(min(a, b), max(a, b)) for p in parts for a, b in zip(*(x.tolist() for x in simhash.cell_edges(marks, p, 0, simhash.RADIUS)), strict=True)}
        assert found == {(i, i + 250) for i in range(250) if i % 4 != 3}


def test_simhash_classes(spark, odd, none):
    """One row for each id: as brute force has it, with large families and strangers, and with odd rows."""
    import pyarrow as pa

    rows = corpus()
    rows += [(1000 + k, rows[0][1], "a") for k in range(300)]
    ids = [i for i, _, _ in rows]
    marks = simhash.fingerprints(pa.array([t for _, t, _ in rows]))
    d = np.bitwise_count(marks[:, None] ^ marks[None]).sum(axis=2)
    full = brute_groups(ids, {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if d[i, j] <= simhash.RADIUS})
    got = [tuple(r) for r in simhash.classes(frame(spark, rows)).collect()]
    assert sorted(got) == sorted((i, full.get(i, i)) for i in set(ids))
    assert sorted(tuple(r) for r in simhash.classes(odd).collect()) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert simhash.classes(none).count() == 0
    twice = frame(spark, [(1, "one text", "a"), (2, "another one", "a"), (3, "one text", "a"), (3, "another one", "a")])
    assert sorted(tuple(r) for r in simhash.classes(twice).collect()) == [(1, 1), (2, 1), (3, 1)]


def test_simhash_recall_does_not_depend_on_size():
    """The same pairs at 24 bits among ten times as many strangers: sampling keeps the chance to meet."""
    rng = np.random.default_rng(2)
    for strangers in (2_000, 20_000, 200_000):
        base = rng.integers(0, 2, (300, simhash.BITS)).astype(np.uint8)
        other = base.copy()
        for i in range(len(base)):
            other[i, rng.choice(simhash.BITS, simhash.RADIUS, replace=False)] ^= 1
        marks = np.packbits(np.concatenate([base, other]), axis=1).view(np.uint64)
        met = np.zeros(300, bool)
        for t, places in enumerate(simhash.sampling(strangers)):
            key = simhash.shard_keys(marks, places, t)
            met |= key[:300] == key[300:]
        assert met.mean() > 0.87, strangers


def test_bk_tree_of_many_near_copies():
    """linked() gives the components of pairs(), also where large families, strangers and later bridges mix."""
    rng = np.random.default_rng(7)
    bits = []
    for k in range(4):
        base = rng.integers(0, 2, simhash.BITS).astype(np.uint8)
        for _ in range(1200 if k < 2 else 60):
            x = base.copy()
            x[rng.choice(simhash.BITS, int(rng.integers(1, 14)), replace=False)] ^= 1
            bits.append(x)
    bits += list(rng.integers(0, 2, (300, simhash.BITS)).astype(np.uint8))
    marks = np.packbits(np.array(bits)[rng.permutation(len(bits))], axis=1).view(np.uint64)
    tree = simhash.Trees(marks, np.zeros(len(marks), np.uint64))
    for radius in (10, 20, simhash.RADIUS):
        item, root = simhash.forest(len(marks), tree.pairs(radius))
        want = np.arange(len(marks))
        want[item] = root
        assert (tree.linked(radius) == want).all()


def test_bk_tree_finds_all_within_radius():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, (30, 2)).astype(np.uint64)
    marks = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, (30, 2)).astype(np.uint64)), base])
    shard = np.zeros(len(marks), np.uint64)
    found = {(int(a), int(b)) for x, y in simhash.Trees(marks, shard).pairs(20) for a, b in zip(x, y, strict=True)}
    assert found == {(i, j) for j in range(len(marks)) for i in range(j) if simhash.distance(marks[[i]], marks[[j]])[0] <= 20}


def test_simhash_odd(spark, odd, none):
    assert {tuple(r) for r in simhash.near_duplicates(odd).collect()} == {(5, 4)}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def brute_spans(rows):
    where = {}
    texts = [(i, [w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]) for i, t, _ in rows if i is not None and t is not None]
    for k, (_, w) in enumerate(texts):
        for s in range(len(w) - repeats.LENGTH + 1):
            where.setdefault(tuple(w[s : s + repeats.LENGTH]), []).append((k, s))
    hits = {}
    for places in where.values():
        if len(places) > 1:
            first = min(texts[k][0] for k, _ in places)
            for k, s in places:
                hits.setdefault(texts[k][0], []).append((s, s + repeats.LENGTH, first))
    out = set()
    for i, spans in hits.items():
        now = None
        for s, e, f in sorted(spans):
            if now and s <= now[1]:
                now = (now[0], max(now[1], e), min(now[2], f))
            else:
                if now:
                    out.add((i, *now))
                now = (s, e, f)
        out.add((i, *now))
    return out


def passages():
    shared = [prose(1000 + k, n) for k, n in enumerate((50, 51, 80, 200, 49))]
    rows = [(i, f"{prose(i, 40)} {shared[i % 5]}  {prose(50 + i, 30)}", "s") for i in range(25)]
    one = "same " * 130
    return [*rows, (30, one.strip(), "s"), (31, "same " * 60, "s"), (32, prose(7, 60) + " " + prose(7, 60), "s"), (33, "ab cd " * 90, "s"), (34, "x ab cd " * 40, "s")]


@pytest.mark.parametrize("find", [suffix.repeated_passages, recompress.repeated_substrings])
def test_repeats_brute(spark, find):
    rows = passages()
    got = {tuple(r) for r in find(frame(spark, rows)).collect()}
    assert got == brute_spans(rows)
    assert any(r[0] == 30 for r in got)


@pytest.mark.parametrize("find", [suffix.repeated_passages, recompress.repeated_substrings])
@pytest.mark.parametrize("hot", [0, 3])
def test_repeats_of_hot_anchors(spark, monkeypatch, find, hot):
    """The same result where all anchors, or those of more than three rows, go by their windows' digits."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = [*passages(), (40, None, "s"), (None, prose(1002, 80), "s"), (30, "same " * 70, "s")]
    assert {tuple(r) for r in find(frame(spark, rows)).collect()} == brute_spans(rows)


@pytest.mark.parametrize("hot", [0, 2, 5])
def test_repeated_hashes(spark, hot):
    rng = np.random.default_rng(hot)
    rows = [(int(h), i) for i, h in enumerate(rng.integers(0, 40, 90))] + [(77, i) for i in range(30_000)]
    got = {(r["h"], r["id"], r["hot"]) for r in repeats.repeated_hashes(spark.createDataFrame(rows, "h long, id long"), hot).collect()}
    n = {h: sum(x == h for x, _ in rows) for h in {x for x, _ in rows[:200]}}
    assert got == {(h, i, n[h] > hot) for h, i in rows if n[h] > 1}


@pytest.mark.parametrize("find", [suffix.repeated_passages, recompress.repeated_substrings])
def test_repeats_odd_that_repeat(spark, find):
    """Repeated ids, clashing columns and a very long text, where there is something to find."""
    long = prose(3, 60_000)
    rows = [(1, long, None), (1, "x " + long[:2000], "a"), (None, long, "a"), (2, None, "a"), (3, "", "a")]
    assert {tuple(r) for r in find(frame(spark, rows)).collect()} == brute_spans(rows) != set()


@pytest.mark.parametrize("find", [suffix.repeated_passages, recompress.repeated_substrings])
def test_repeats_odd(spark, odd, none, find):
    assert find(odd).count() == 0
    assert find(none).count() == 0
    assert find(none).columns == ["doc_id", "start_word", "end_word", "first_doc"]


def vectors(d=32, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((150, d))
    near = x[:50] + rng.standard_normal((50, d)) * 0.22 * rng.random((50, 1))
    x = np.concatenate([x, near, x[:5]])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_rabitq_brute(spark):
    x = vectors()
    df = spark.createDataFrame([(i, [float(a) for a in v], 0, 5, "h") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, id int, h string")
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = [(i, j) for i in range(len(x)) for j in range(i) if unit[i] @ unit[j] >= rabitq.THRESHOLD]
    full = brute_groups(range(len(x)), want)
    got = {r["vec_id"]: r["keep_id"] for r in rabitq.near_duplicates(df).collect()}
    assert set(got) <= set(full)
    assert sum(got.get(k) == v for k, v in full.items()) >= 0.95 * len(full)


def test_rabitq_estimate_is_unbiased_and_bounded():
    x = vectors(64)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    errors = []
    for seed in range(30):
        turn = rabitq.rotation(64, seed)
        rotated, codes, factor = rabitq.encode(x, turn)
        value, bound = rabitq.estimate(rotated[:100], codes[50:150], factor[50:150])
        true = np.einsum("ij,ij->i", x[:100], x[50:150])
        errors.append(value - true)
        assert (np.abs(value - true) <= bound).mean() > 0.97
    assert abs(np.mean(errors)) < 0.01


def test_rabitq_bounds_hold():
    """What the bytes' bounds decide is right, and what the codes' bounds leave out is almost never a pair."""
    x = vectors(64).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = rabitq.unpack(rabitq.pack(*rabitq.encode(x, rabitq.rotation(64))), 64)
    true = x @ x.T
    item, root, a, b = rabitq.shard_links(coded, np.arange(len(x)), 0.95)
    want = brute_groups(range(len(x)), [(i, j) for i in range(len(x)) for j in range(i) if true[i, j] >= 0.95])
    sure = [(int(i), int(r)) for i, r in zip(item, root, strict=True)]
    assert all(want.get(i, i) == want.get(r, r) for i, r in sure)
    got = brute_groups(range(len(x)), sure + [(int(i), int(j)) for i, j in zip(a, b, strict=True) if true[i, j] >= 0.95])
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.98 * len(want) and len(a) < 40


def test_rabitq_hot_shard_is_linear(monkeypatch):
    """A shard full of near copies is linked without its pairs being listed, and a stranger's link is not lost."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    x = np.concatenate([base + 0.02 * rng.standard_normal((3000, 64)), rng.standard_normal((5, 64))])
    x[-1] = x[-2] + 0.01 * rng.standard_normal(64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    coded = rabitq.unpack(rabitq.pack(*rabitq.encode(x, rabitq.rotation(64))), 64)
    monkeypatch.setattr(rabitq, "BLOCK", 256)
    item, root, a, _ = rabitq.shard_links(coded, np.arange(len(x)), 0.95)
    assert len(item) == 3000 and not len(a) and set(root[:-1].tolist()) == {0} and (item[-1], root[-1]) == (3004, 3003)


def test_rabitq_odd(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (None, [1.0, 0.0]), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (9, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "h", 2, [0.5], "c") for r in rows], "vec_id long, embedding array<float>, id long, h string, head long, v array<double>, code string")
    assert {tuple(r) for r in rabitq.near_duplicates(df).collect()} == {(2, 1)}
    assert rabitq.near_duplicates(df.limit(0)).count() == 0

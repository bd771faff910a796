"""Top-k search, embedding copies, SimHash copies and components against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from swayscan.llm import neighbours, simhash, topk
from swayscan.llm.graph import components

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cls long, key string"


def groups(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", 7, "z") for i, v, l in rows], VECTORS)


def odd_rows():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(6, 12))
    rows = []
    for i in range(150):
        v = near[i % 6] + rng.normal(scale=0.02 if i % 3 else 0.8, size=12)
        rows.append((i, [float(np.float32(x)) for x in v], i % 2 if i % 7 else None))
    same = rows[4][1]
    rows += [(200 + i, same, 0) for i in range(40)]  # many equal vectors
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 12, 0), (303, [float("nan")] * 12, 0), (304, [1.0, None], 0)]
    rows += [(306, [1.0, 2.0], 0), (308, [float("inf")] * 12, 0), (None, rows[5][1], 1), (4, same, 0)]
    return rows


def test_top_k_is_exact(spark):
    rows = odd_rows()
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") % 4 == 0, k=5).collect()
    usable = {}
    for i, v, _ in rows:
        if i is not None and v is not None and not any(x is None or not np.isfinite(x) for x in v):
            w = [int(np.floor(256 * x)) for x in v] + [0] * (12 - len(v))
            usable[i] = min(usable.get(i, w), w)
    want = []
    for q in usable:
        if q % 4 == 0:
            best = sorted((-sum(a * b for a, b in zip(usable[q], w)), i) for i, w in usable.items() if i != q)[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_or_no_rows(spark):
    one = vectors(spark, [(0, [1.0, 2.0], 0)])
    assert topk.top_k(one, F.col("vec_id") % 4 == 0).count() == 0
    three = vectors(spark, [(0, [1.0, 2.0], 0), (1, [1e30, -1e30], 0), (2, [0.5, 0.5], 0)])
    assert [r["rank"] for r in topk.top_k(three, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]
    assert topk.top_k(one.limit(0), F.col("vec_id") % 4 == 0).count() == 0


@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_copies_are_exact(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)  # small slots, so that cells are split
    rows = [r for r in odd_rows() if r[0] is not None][:-1]
    got = {r.vec_id: r for r in neighbours.near_duplicates(vectors(spark, rows)).collect()}
    links = []
    for a, (_, x, lx) in enumerate(rows):
        for b, (_, y, ly) in enumerate(rows[:a]):
            if lx is None or lx != ly or not x or not y or len(x) != len(y) or None in x or None in y:
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            with np.errstate(all="ignore"):
                if np.isfinite(x_).all() and np.isfinite(y_).all() and x_ @ y_ / np.sqrt(x_ @ x_ * (y_ @ y_)) >= 0.93:
                    links.append((a, b))
    label = groups(len(rows), links)
    for n, (i, _, _) in enumerate(rows):
        least = min(rows[m][0] for m in range(len(rows)) if label[m] == label[n])
        row = got[i]
        assert (row.n_links, row.component_id, row.kept) == (sum(n in l for l in links), least, least == i), i


def test_embedding_copies_write_no_vectors_for_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    tables, plain = [], neighbours.written

    def counted(df):
        out = plain(df)
        tables.append((out.count(), df.columns, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(neighbours, "written", counted)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 0) for i in range(600)]  # one label, many tiles
    assert neighbours.near_duplicates(vectors(spark, rows)).count() == 600
    assert max(n for n, _, _ in tables) <= 600  # no row for a cell or a pair
    plan = next(plan for _, columns, plan in tables if columns == ["cls", "n", "other"])
    assert "CartesianProduct" in plan and "Exchange" not in plan  # tiles are read side by side, not dealt out


def test_embedding_copies_of_repeats_and_nothing(spark):
    rows = vectors(spark, [(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (None, [2.0, 0.0], 1)])
    assert sorted((r.n_links, r.component_id) for r in neighbours.near_duplicates(rows).collect()) == [(2, 5)] * 3
    assert neighbours.near_duplicates(rows.limit(0)).count() == 0


def test_masks_meet_every_pair_within_the_limit():
    rng = np.random.default_rng(1)
    for _ in range(500):
        bits = rng.choice(64, size=4, replace=False)
        difference = sum(1 << int(b) for b in bits)
        assert any(not difference & m for m in simhash.masks(4))


@pytest.mark.parametrize("tile", [4096, 20])
def test_links_of_codes_lose_none(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(2)
    codes = {0, 1, (1 << 64) - 1}
    for centre in rng.integers(0, 1 << 63, size=60, dtype=np.uint64).tolist():
        for _ in range(12):
            flips = rng.choice(64, size=rng.integers(0, 8), replace=False)
            codes.add(centre ^ sum(1 << int(b) for b in flips))
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(df, 4)).collect()}
    array = np.array(codes, np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 4
    label = groups(len(codes), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    mine = [roots.get(c, c) for c in signed]
    pairs = {(m, w) for m, w in zip(mine, label)}
    assert len(pairs) == len(set(mine)) == len(set(label))


def test_simhash_groups(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [
        (9, text, "en"), (3, text.upper(), "en"), (12, text + " more", "en"), (1, None, "en"), (2, "", "en"),
        (4, " \t\n", "en"), (5, "one two", "en"), (6, "ONE  two", "en"), (7, "é", "en"), (None, text, "en"), (9, text, "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, r)
    assert [by[i].component_id for i in (9, 3, 12, None)] == [3] * 4
    assert [by[i].component_id for i in (1, 2, 4)] == [1] * 3 and by[1].fingerprint == "0" * 16
    assert by[5].component_id == by[6].component_id == 5 and by[7].component_id == 7
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_fingerprint_by_its_definition():
    import xxhash

    text = "The  Quick brown FOX\x0bjumps over the quick brown fox jumps"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (2000, 2001), (2001, 2000)], "a long, b long")
    roots = {r.node: r.root for r in components(links).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[1000 + i] for i in range(200)}) == 1
    assert len(set(roots.values())) == 3 and len(roots) == 301 + 200 + 2

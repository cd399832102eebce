"""Operators 11, 12 and 13 against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op11_topk as o11
from quire.llm import op12_structure as o12
from quire.llm import op13_merkle as o13
from tests.llm.data import CLASHING

# -- 11 --------------------------------------------------------------------------------------------------------------

VEC = "vec_id bigint, vec array<bigint>"


def best_brute(cands, asks, k):
    whole = lambda rows: {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v}
    found = defaultdict(list)
    for q, v in whole(asks):
        found[q] += [(-sum(a * b for a, b in zip(v, w)), c) for c, w in whole(cands) if c != q]
    return sorted((q, r + 1, c, -s) for q, out in found.items() for r, (s, c) in enumerate(sorted(out)[:k]))


def vectors(seed, n, dim, most, empty=0.5):
    rng = random.Random(seed)
    return [(rng.randrange(2 * n), [0 if rng.random() < empty else rng.randint(-most, most) for _ in range(rng.randrange(dim + 1))])
            for _ in range(n)]


@pytest.mark.parametrize("seed,most,empty,blocks", [(1, 3, 0.5, 1), (2, 2, 0.05, 5), (3, 10 ** 5, 0.9, 3), (4, 2 ** 28, 0.3, 4)])
def test_top_k(spark, seed, most, empty, blocks):
    rows = vectors(seed, 120, 12, most, empty) + [(7, None), (None, [1, 2]), (8, [1, None]), (9, []), (500, [1] * 12), (500, [1] * 12)]
    rows += [(1000 + k, [1, 1, 1]) for k in range(60)]  # ties
    asks = [r for r in rows if r[0] is not None and r[0] % 3 == 0] + [(-5, [2] * 40)]
    clash = {c: F.lit(k) for k, c in enumerate(CLASHING)}
    got = o11.top_k(spark.createDataFrame(rows, VEC).withColumns(clash), spark.createDataFrame(asks, VEC), 10, blocks).collect()
    assert sorted(map(tuple, got)) == best_brute(rows, asks, 10)


def test_top_k_edges(spark):
    one = spark.createDataFrame([(1, [2 ** 62]), (2, [1]), (3, [0, 5])], VEC)
    asks = spark.createDataFrame([(2, [1]), (4, [])], VEC)
    got = sorted(map(tuple, o11.top_k(one, asks, 5).collect()))
    assert got == [(2, 1, 1, 2 ** 62), (2, 2, 3, 0), (4, 1, 1, 0), (4, 2, 2, 0), (4, 3, 3, 0)]
    none = one.limit(0)
    assert not o11.top_k(none, one, 5).count() and not o11.top_k(one, none, 5).count()
    with pytest.raises(Exception, match="larger than a long"):
        o11.top_k(spark.createDataFrame([(1, [2 ** 62]), (2, [4])], VEC), one, 5).collect()


def test_best_and_lists():
    assert list(o11.best(np.array([5.0, 1, 5, 5, 9]), 2)) == [4, 0] and list(o11.best(np.array([1, 2]), 5)) == [0, 1]
    lists = o11.Lists(np.arange(4), np.array([0, 0, 1, 3]), np.array([0, 2, 2, 2]), np.array([3, 1, 2, -4]))
    assert {t: at is None for t, (at, _) in lists.lists.items()} == {0: False, 2: True}  # a long list is kept dense
    assert lists.scores(1, np.array([0, 0]), np.array([0, 2]), np.array([2, 10])).tolist() == [[16, 20, 0, -40]]


def test_whole_numbers(spark):
    df = spark.createDataFrame([([0.5, -0.01, 0.999],), ([float("nan")],), ([float("-inf"), 1.0],), ([1.0, None],), (None,), ([],)],
                               "v array<float>")
    assert [r[0] for r in df.select(o11.whole_numbers(F.col("v"))).collect()] == [[32, -1, 63], None, None, None, None, []]


# -- 12 --------------------------------------------------------------------------------------------------------------

def cell_all_splits(symbols):
    """The textbook chart: every split of every span."""
    n, chart = len(symbols), {}
    for i, s in enumerate(symbols):
        chart[i, i + 1] = o12.row_cell(s)
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            cell = {}
            for m in range(i + 1, i + size):
                for at, found in o12.combined(chart[i, m], chart[m, i + size]).items():
                    o12.better(cell, at, *found)
            chart[i, i + size] = cell
    return chart[0, n]


@pytest.mark.parametrize("seed", range(4))
def test_one_split_is_enough(seed):
    rng = random.Random(seed)
    for n in range(1, 20):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(n))
        assert o12.span_cell(symbols) == cell_all_splits(symbols)


def parse_brute(rows):
    """Least (cost, audit) over (rows read, mark) by a search that knows nothing of spans. ``rows``: (symbol, ...)."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, p = heapq.heappop(heap)
        if (i, p) in done:
            continue
        done.add((i, p))
        if i == len(rows) and p in (0, 3):
            final = (cost, audit)
            return final
        for (m, x), q in {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.items():
            if m == p:
                if x != "s":
                    heapq.heappush(heap, (cost + 2, audit + "I", i, q))
                if i < len(rows) and rows[i] != "x":
                    if rows[i].lower() == x:
                        heapq.heappush(heap, (cost + rows[i].isupper(), audit + "K", i + 1, q))
                    elif x != "s":
                        heapq.heappush(heap, (cost + 2 + rows[i].isupper(), audit + "R", i + 1, q))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, p))


@pytest.mark.parametrize("seed", range(5))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    for n in list(range(0, 14)) * 12:
        symbols = "".join(rng.choice("xsuauauaoSUAO"[: rng.choice((3, 8, 13))]) for _ in range(n))
        cuts = sorted(rng.randrange(n + 1) for _ in range(3))
        cells = [o12.span_cell(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, n])]
        cost, parts = o12.chosen(cells)
        assert (cost, "".join(a for _, a in parts)) == parse_brute(symbols)


def summary_brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv].append(((turn is not None, turn), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), turn, role, text))
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: t[:2])
        seen, symbols, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\f\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            seen.add((role, text))
            s = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else s.upper() if fault else s
            if fault:
                n[fault] += 1
        cost, audit = parse_brute(symbols)
        initials = [t[3][:1] for t in turns]
        numbers = [t[2] for t in turns if t[2] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        left, lines, mark = iter(turns), [], 0
        for e in audit:
            x = "a" if mark == 2 else "u"
            if e == "I":
                role, text = o12.ROLES[x], ""
            else:
                _, _, _, role, text = next(left)
                if e == "D":
                    continue
                role = role if e == "K" else o12.ROLES[x]
            lines.append(f"{role}:{text}")
            mark = {"s": 1, "u": 2, "a": 3}[role[0]]
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


TURNS = "conv_id bigint, turn bigint, role string, text string"


def conversations():
    rng = random.Random(5)
    rows = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (2, 0, "assistant", "No start"), (2, 5, None, "What role?"),
            (2, None, "user", "Before all."), (3, 0, "", "No role."), (3, 1, "tool", "Result."), (4, 0, "user", None), (4, 1, "user", " \n\x0b"),
            (None, 0, "user", "Null id."), (None, 0, "assistant", "Same turn."), (5, 0, "system", "S."), (5, 1, "system", "S."), (5, 1, "system", "S."),
            (6, 3, "user", "é "), (6, 3, "user", "a" * 50_000 + "."), (6, 4, "assistant", "End.\x85"), (7, None, "user", "x."), (7, None, "user", "x.")]
    for c in range(10, 60):
        rows += [(c, t + rng.randrange(2), rng.choice(("user", "assistant", "system", "user", "assistant")), rng.choice(("", "Fine.", "cut", f"t{t}.", f"{c}!")))
                 for t in range(rng.randrange(1, 9))]
    rows += [(99, t, ("user", "assistant")[t % 2 if t % 50 else 0], f"Turn {t % 700}.") for t in range(1500)]
    return rows + [(100, 3, "user", "Again.")] * 300


def test_structure(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(4).withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)})
    asked = spark.createDataFrame([(1,), (12345,), (None,)], "conv_id bigint")
    got = {r.conv_id: tuple(r)[1:] for r in o12.summary(df, asked).collect()}
    want = summary_brute(rows) | {12345: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == want[c], c
    assert not o12.summary(df.limit(0), asked.limit(0)).count() and not o12.repaired(df.limit(0)).count()


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "user", ""), (1, 2, "user", "Q"), (2, 0, "system", "S.")], TURNS)
    got = sorted(map(tuple, o12.repaired(df).collect()), key=str)
    by = defaultdict(list)
    for r in got:
        by[r[0]].append(r)
    assert [(e, role, text) for _, s, e, role, text in sorted(by[1], key=lambda r: (r[1] is None, r[1] or 0, r[4]))] == [
        ("I", "user", ""), ("K", "assistant", "A."), ("D", "user", ""), ("D", "user", "Q")]  # as cheap as RDR, and less
    assert by[2] == [(2, None, "D", "system", "S.")]


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b!c? {t}.") for c in range(12) for t in range(12)] + [(None, None, None, None)]
    got = defaultdict(list)
    for r in o12.damaged(spark.createDataFrame(rows, TURNS)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text))
    for c, t, role, text in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        one = {1: (role, ""), 2: (role, "".join(x for x in text if x not in ".!?")), 4: ("user", text)}.get(way, (role, text))
        assert got[c, t] == [one] * {0: 0, 3: 2}.get(way, 1)


# -- 13 --------------------------------------------------------------------------------------------------------------

def test_van_emde_boas_places():
    for levels in range(1, 8):
        places = np.concatenate([o13.address(levels, d, np.arange(3 ** d)) for d in range(levels)])
        assert sorted(places) == list(range(o13.nodes(levels)))
    # four levels: the upper two (4 nodes), then each lower tree of two levels in one piece
    assert list(o13.address(4, 1, np.arange(3))) == [1, 2, 3]
    assert list(o13.address(4, 2, np.arange(4))) == [4, 8, 12, 16] and list(o13.address(4, 3, np.arange(4))) == [5, 6, 7, 9]


def test_block_paths():
    for n, h in ((1, 0), (1, 2), (2, 1), (5, 2), (27, 3), (20, 8)):
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        data = o13.layout(leaves, h)
        block = o13.Block(data, n, h)
        for k, leaf in enumerate(leaves):
            assert o13.folded(leaf.hex(), block.path(k)) == data[:32].hex()


def tree_brute(leaves):
    """(root, siblings of each leaf, level by level as (before, after))."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        level = [o13.joined(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def manifest_brute(rows):
    groups = defaultdict(list)
    for g, key, digest, now in rows:
        groups[g].append(((key is not None, key), digest, now))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: (sorted(groups[g]), *tree_brute([d.hex() for _, d, _ in sorted(groups[g])])) for g in order}
    root, above = tree_brute([trees[g][1] for g in order])
    out = []
    for g, up in zip(order, above):
        leaves, subroot, paths = trees[g]
        for ((_, key), digest, now), path in zip(leaves, paths):
            whole = path + up
            fold = now.hex()
            for a, b in whole:
                fold = hashlib.sha256((a + fold + b).encode()).hexdigest()
            out.append((g, key, digest.hex(), subroot, hashlib.sha256("".join(a + b for a, b in whole).encode()).hexdigest(), fold))
    return root, sorted(out, key=repr)


LEAF = "g string, key bigint, digest binary, now binary"


def leaves(sizes, seed=0):
    rng = random.Random(seed)
    h = lambda *x: hashlib.sha256(repr(x).encode()).digest()
    rows = [(g, k, h(g, k), h(g, k) if rng.random() < 0.7 else h("tampered", g, k)) for g, n in sizes.items() for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"only": 1}, {"a": 2}, {None: 4, "": 1, "é": 3, "z": 10, "\U0001f600": 9, "￿": 28}, {"big": 6562, "b": 19700, "c": 6561},
                                   {f"s{k}": 1 + k % 2 for k in range(6700)}])
def test_manifest(spark, sizes):
    rows = leaves(sizes)
    if len(rows) < 100:
        rows += rows[:3] + [("z", None, b"\1" * 32, b"\2" * 32)]  # rows that repeat, and a null key
        rows = [(g, k, d, n) for g, k, d, n in rows]
    df = spark.createDataFrame(rows, LEAF).repartition(5).withColumns({c: F.lit(1) for c in CLASHING if c != "key"})
    got, root = o13.manifest(df)
    want_root, want = manifest_brute(rows)
    assert root == want_root
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_manifest_of_nothing(spark):
    got, root = o13.manifest(spark.createDataFrame([], LEAF))
    assert got.count() == 0 and root == hashlib.sha256(b"").hexdigest()


def test_leaf_digest(spark):
    df = spark.createDataFrame([(1, None, "é\n"), (None, "", "x" * 100_000)], "a bigint, b string, c string")
    got = [bytes(r[0]) for r in df.select(o13.leaf_digest(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [hashlib.sha256(x.encode()).digest() for x in ("1:1-3:é\n", "-0:100000:" + "x" * 100_000)]

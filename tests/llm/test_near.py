"""Near-duplicate documents and passages, and nearest neighbours, against brute force."""

import os
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace import session
from millrace.llm import common, near_dedup, neighbours, substring_dedup

from .conftest import shingles, words


def _components(rows):
    """(n_shingles, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            lists[x].append(i)
    tried = set()
    for members in lists.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    first = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return [(d, len(s), d if not s else first[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def _check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.components(docs).collect()
    want = _components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    return got


def _changed(rng, text, share, vocabulary):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text.split())


def test_groups(spark, odd_texts):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(2000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for n in (3, 20, 80, 150, 400):
        base = prose(n)
        rows += [base, base.upper(), base.replace(" ", "\n")] + [_changed(rng, base, s, vocabulary) for s in (0.01, 0.02, 0.03, 0.05) for _ in range(4)]
    rows += odd_texts[:6] + odd_texts[7:]
    rng.shuffle(rows)
    _check(spark, list(enumerate(rows)))


def test_a_long_list_by_pivots(spark, monkeypatch):
    """A group far longer than a short list: links through members, copies of copies, and a passage in common."""
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    monkeypatch.setattr(near_dedup, "MARKED", 4)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = prose(150), prose(60)
    near = [_changed(rng, base, s, vocabulary) for s in (0.01, 0.02, 0.03, 0.04, 0.06) for _ in range(12)]
    again = [_changed(rng, near[-1], 0.01, vocabulary) for _ in range(15)]
    third = [_changed(rng, again[0], 0.02, vocabulary) for _ in range(10)]
    shared = [f"{prose(20)} {passage} {prose(20)}" for _ in range(40)]
    rows = [base, *near, *again, *third, *shared]
    rng.shuffle(rows)
    _check(spark, list(enumerate(rows)))


def test_pairs_grow_with_the_rows(spark, monkeypatch):
    """Of near copies of one text, four times as many give at most five times the pairs to verify; components are those of all pairs."""
    verified = []
    of = near_dedup.stored

    def counted(df, name):
        made = of(df, name)
        if name == "pairs":
            verified.append(made.count())
        return made

    monkeypatch.setattr(near_dedup, "stored", counted)
    vocabulary = [f"w{i}" for i in range(20000)]
    for size, share in ((300, 0.02), (300, 0.03)):
        pairs = []
        for n in (100, 400):
            rng = random.Random(5)
            base = " ".join(rng.choice(vocabulary) for _ in range(size))
            verified.clear()
            _check(spark, list(enumerate(_changed(rng, base, share, vocabulary) for _ in range(n))))
            pairs.append(sum(verified))
        assert pairs[1] <= 5 * pairs[0] + 100, pairs


def test_a_very_long_text(spark, odd_texts):
    """A text of 120,000 words beside a near copy and a copy with a word more."""
    long = odd_texts[6]
    cut = long.split()
    cut[5000:5600] = ["new"] * 500
    docs = spark.createDataFrame([(4, long), (3, " ".join(cut)), (2, "a short one"), (1, long + " end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.components(docs).collect()}
    assert got == {1: (len(shingles(long + " end")), 1), 2: (1, 2), 3: (len(shingles(" ".join(cut))), 1), 4: (len(shingles(long)), 1)}


def test_extra_columns(spark, odd_docs):
    """Columns named like inner ones change nothing and stay."""
    slim = odd_docs.select("doc_id", "text")
    key = lambda rows: sorted(map(repr, rows))
    assert key(near_dedup.components(odd_docs).collect()) == key(near_dedup.components(slim).collect())
    kept = near_dedup.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns and key(kept.select("doc_id", "text").collect()) == key(near_dedup.keep_first(slim).collect())


def test_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (5, text), (3, text + " more"), (None, text), (9, None), (9, ""), (None, None), (8, "a b"), (6, "A\nB"), (4, "b a")]
    got = _check(spark, rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (5, 3, 8)} == {5: 3, 3: 3, 8: 6}
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component string")
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 9, 9, None, 6, 4], key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.components(empty).collect() == [] and near_dedup.keep_first(empty).collect() == []


def test_components_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    _check(spark, rows)


def test_passages(spark, odd_docs, no_docs):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    exact, near, short = prose(60), prose(90), prose(30)
    rows = [f"{prose(rng.randint(0, 150))} {exact} {prose(rng.randint(0, 150))}" for _ in range(12)]
    rows += [f"{prose(80)} {_changed(rng, near, 0.015, vocabulary)} {prose(70)}" for _ in range(6)]
    rows += [f"{prose(100)} {short} {prose(100)}" for _ in range(5)] + [prose(300) for _ in range(20)] + [rows[0]] * 2
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = substring_dedup.repeated(docs).collect()
    caught = {r.doc_id for r in got}
    assert caught == {r.partner_id for r in got}
    assert set(range(12)) | {43, 44} <= caught and not caught & set(range(18, 43))
    assert len(caught & set(range(12, 18))) >= 4
    _sound(rows, got)
    assert len(got) <= 2 * 2 * 3 * len(rows)
    odd = substring_dedup.repeated(odd_docs).collect()
    texts = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        if len(words(r.text)) >= 50:
            texts[r.text].append(r.doc_id)
    # texts are there twice, but for one: documents of equal long texts have rows, and no others
    assert {r.doc_id for r in odd} == {d for ds in texts.values() if len(ds) > 1 for d in ds}
    assert substring_dedup.repeated(no_docs).collect() == []


def _sound(rows, got):
    """Every row's passages are as similar as it says, of 50 words on one side at least."""
    low = [words(x.lower() if x else x) for x in rows]
    for r in got:
        a, b = low[r.doc_id][r.start : r.end], low[r.partner_id][r.partner_start : r.partner_end]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert max(len(a), len(b)) >= 50 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.75


def _with_equal_runs(rows):
    """By brute force: the rows with a run of 50 words that another row has too."""
    where = defaultdict(set)
    for d, t in rows:
        w = [x.lower() for x in words(t)]
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(d)
    return set().union(*(ds for ds in where.values() if len(ds) > 1))


def test_passages_of_the_tables(spark):
    """Every document with a run of 50 words that another document has is reported."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in substring_dedup.repeated(docs).collect()}
    assert got >= _with_equal_runs(rows)


def test_passages_beside_many_that_hold_part(spark):
    """Two equal passages of 60 words among 40 documents that hold 40 of the words: the pair is found whatever the words."""
    rows, pairs = [], []
    for seed in range(12):
        rng = random.Random(seed)
        prose = lambda n, rng=rng: [f"w{rng.randrange(10**7)}" for _ in range(n)]
        passage = prose(60)
        cut = rng.randint(0, 20)
        pairs.append(frozenset((len(rows), len(rows) + 1)))
        rows += [" ".join(prose(30) + passage + prose(30)) for _ in range(2)]
        rows += [" ".join(prose(30) + passage[cut : cut + 40] + prose(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated(docs).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} >= set(pairs)
    _sound(rows, got)


def test_passages_with_one_block_changed():
    """Where only one block in the middle differs, the sets alone decide, however wide the gap."""
    rng = random.Random(4)
    for size, put, cut in ((80, 6, 0), (80, 6, 6), (98, 8, 8), (80, 0, 6), (150, 12, 12), (400, 60, 60), (90, 2, 0), (60, 6, 6), (80, 30, 0)):
        for stray in (0, 3):
            a = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
            new = np.array([rng.getrandbits(64) for _ in range(put)], np.uint64)
            mid = size // 2
            b = np.concatenate([a[: mid - cut // 2], new, a[mid - cut // 2 + cut :]])
            x, y = common.shingle_hashes(a), common.shingle_hashes(b)
            alike = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            # a few shingles of the passage once more, some way off
            tail = common.shingle_hashes(np.array([rng.getrandbits(64) for _ in range(30)], np.uint64))
            text = np.concatenate([y, tail, x[5 : 5 + stray]])
            got = substring_dedup.passages(x, text, [0, len(text)])
            whole = [p for p in got if p[2] == 0 and p[3] >= len(y)]
            assert bool(whole) == (alike >= 0.75), (size, put, cut, stray, alike, got)
            assert all(p[4] >= 0.75 for p in got)


def test_passages_behind_a_hot_phrase(spark):
    """Pairs share an exact passage, half of it a phrase of many other texts, which has the least hash for some or all functions."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    phrase = prose(28)
    rows = [" ".join([*prose(60), *phrase, *prose(60)]) for _ in range(600)]
    pairs = []
    for k in range(120):
        cut = rng.randint(0, 26) if k % 2 else 13
        passage = [*prose(cut), *phrase, *prose(26 - cut)] if k % 4 else [*prose(11), *phrase, *prose(11)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join([*prose(rng.randint(0, 60)), *passage, *prose(rng.randint(0, 60))]) for _ in range(2)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated(docs).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} >= {frozenset(p) for p in pairs}
    _sound(rows, got)


def test_changed_passages_beside_many_that_hold_parts(spark):
    """Two similar passages without a long equal run, all of whose parts are in many other texts: each pair is found."""
    rows, pairs = [], []
    for seed in range(16):
        rng = random.Random(100 + seed)
        prose = lambda n, rng=rng: [f"w{rng.randrange(10**7)}" for _ in range(n)]
        passage = prose(90)
        changed = list(passage)
        for at in (45,) if seed % 2 else (30, 60):
            changed[at] = "changed"
        pairs.append(frozenset((len(rows), len(rows) + 1)))
        rows += [" ".join(prose(30) + x + prose(30)) for x in (passage, changed)]
        rows += [" ".join(prose(30) + passage[cut : cut + 38] + prose(30)) for cut in (0, 17, 35, 52) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated(docs).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} >= set(pairs)
    _sound(rows, got)


def test_alike_joins_all_classes():
    """Parts of one signature: classes as by comparing all pairs; of a few parts all pairs; what isn't shown is in a passage already."""
    rng = np.random.default_rng(7)
    fresh = lambda n: rng.integers(1 << 62, size=n, dtype=np.uint64)
    for count in (4, substring_dedup.ALL, 40):
        for _ in range(4):
            cores = [fresh(rng.integers(60, 120)) for _ in range(4)]
            # cores in a chain: each begins as the one before ends
            cores += [np.concatenate([c[-40:], fresh(30)]) for c in cores[:2]]
            parts = []
            for _ in range(count):
                core = cores[rng.integers(len(cores))].copy()
                if rng.random() < 0.8:
                    core[rng.integers(len(core), size=rng.integers(1, 16))] = fresh(1)
                parts.append(np.concatenate([fresh(rng.integers(30)), core, fresh(rng.integers(30))]))
            parts[-1] = np.tile(fresh(5), 20)
            parts[-2] = np.tile(parts[-1][:5], 12)
            keys = np.arange(count)
            both = lambda i, k: substring_dedup.passages(parts[i], parts[k], [0, len(parts[k])]) or substring_dedup.passages(parts[k], parts[i], [0, len(parts[i])])
            want = {frozenset((i, k)) for k in range(count) for i in range(k) if both(i, k)}
            got = {frozenset(x[:2]) for x in substring_dedup.alike(keys, parts)}
            assert got <= want and frozenset((count - 1, count - 2)) in got
            if count <= substring_dedup.ALL:
                assert got == want

            def classes(links):
                names = list(range(count))
                for x in links:
                    i, k = (names[y] for y in x)
                    names = [i if y == k else y for y in names]
                return {frozenset(y for y in range(count) if names[y] == z) for z in names}

            assert classes(got) == classes(want)
            assert substring_dedup.alike(np.zeros(count, np.int64), parts) == []


def test_passages_of_near_copies(spark):
    """Of near copies, whose signatures are all hot, every similar pair is found, not only those that make them one class."""
    rng = random.Random(21)
    base, rows = [f"w{rng.randrange(10**7)}" for _ in range(120)], []
    for _ in range(24):
        text = list(base)
        for at in rng.sample(range(120), 2):
            text[at] = f"w{rng.randrange(10**7)}"
        rows.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = substring_dedup.repeated(docs).collect()
    x = [common.shingle_hashes(h) for _, h in common.word_hashes(rows)]
    want = {frozenset((i, k)) for k in range(24) for i in range(k) if substring_dedup.passages(x[i], x[k], [0, len(x[k])])}
    assert len(want) > 100 and {frozenset((r.doc_id, r.partner_id)) for r in got} >= want
    _sound(rows, got)


def test_alike_leaves_what_is_known(monkeypatch):
    """Parts known to be in one class and covered, or in windows of one other signature, aren't compared again; a part that isn't is."""
    rng = np.random.default_rng(3)
    core, count = rng.integers(1 << 62, size=300, dtype=np.uint64), substring_dedup.ALL + 6
    parts = [core.copy() for _ in range(count)]
    for p in parts:
        p[rng.integers(300, size=4)] = rng.integers(1 << 62, size=1, dtype=np.uint64)
    made, keys = [], np.arange(count)
    compare = substring_dedup.passages
    monkeypatch.setattr(substring_dedup, "passages", lambda *x: made.append(1) or compare(*x))
    known = [[5]] * count, [[0, 300]] * count
    assert substring_dedup.alike(keys, parts, *known) == [] and not made
    assert substring_dedup.alike(keys, parts, over=[[7, 9]] * count) == [] and not made
    lone = [[5]] * (count - 1) + [[]], [[0, 300]] * (count - 1) + [[]]
    assert {k for x in substring_dedup.alike(keys, parts, *lone) for k in x[:2]} >= {count - 1}
    assert substring_dedup.alike(keys, parts, over=[[7, 9]] * (count - 1) + [[8]])
    windows = [{"sig": s, "begin": b, "end": e} for s, b, e in ((1, 0, 100), (2, 0, 100), (3, 10, 60), (4, 50, 120), (3, 20, 70))]
    assert substring_dedup._over(windows) == [[], [1], [1, 2], [], [1, 2]]


def test_few_alike():
    """Groups of parts at once: all pairs that share as many shingles as a passage needs, by comparing sets; no pair of one text or over groups."""
    rng = np.random.default_rng(5)
    pool = rng.integers(1 << 62, size=(6, 90), dtype=np.uint64)
    groups, keys, parts = [], [], []
    for g in range(30):
        for _ in range(rng.integers(1, 12)):
            groups.append(g)
            keys.append(rng.integers(0, 9))
            size = rng.integers(50, 90)
            parts.append(np.where(rng.random(size) < 0.7, pool[rng.integers(6)][:size], rng.integers(1 << 62, size=size, dtype=np.uint64)) if rng.random() < 0.9 else np.tile(pool[0][:3], 20))
    i, k = substring_dedup.few_alike(np.array(groups), np.array(keys), parts)
    got = set(zip(i.tolist(), k.tolist()))
    need = [substring_dedup._needed(p) for p in parts]
    want = set()
    for b in range(len(parts)):
        for a in range(b):
            if groups[a] == groups[b] and keys[a] != keys[b] and len(np.intersect1d(parts[a], parts[b])) >= max(min(need[a][0], need[b][0]), need[a][1], need[b][1]):
                want.add((a, b))
    assert got == want and got


def test_passages_of_the_places_that_a_place_is_made_of():
    """What a passage of a narrower place covers is covered, though matches further off part it in the wider one."""
    rng, hidden = np.random.default_rng(9), 0
    for _ in range(60):
        a = rng.integers(1 << 62, size=200, dtype=np.uint64)
        b = np.where(rng.random(200) < rng.choice([0.6, 0.8, 0.9], size=4).repeat(50), a, rng.integers(1 << 62, size=200, dtype=np.uint64))
        made_of = [x for at in range(0, 150, 25) for x in (at, at + 50)]
        got, whole = np.zeros(200, bool), np.zeros(200, bool)
        for found, held in ((substring_dedup.place_passages(a, b, made_of), got), (substring_dedup.passages(a, b, [0, 200]), whole)):
            for x in found:
                held[x[2] : x[3]] = True
        for begin, end in zip(made_of[::2], made_of[1::2]):
            for x in substring_dedup.passages(a, b, [begin, end]):
                own = (a == b)[x[2] : x[3]]
                assert (own & ~got[x[2] : x[3]]).sum() <= substring_dedup.EDGE
                hidden += (own & ~whole[x[2] : x[3]]).sum() > substring_dedup.EDGE
    assert hidden


def test_no_run_of_a_place_is_tried_twice(monkeypatch):
    """Places that overlap share their runs: each is parted once, and the passages are those of each place by itself."""
    rng, runs, total = np.random.default_rng(4), [], 0
    part = substring_dedup._densest
    monkeypatch.setattr(substring_dedup, "_densest", lambda run: runs.append((run[0], run[-1])) or part(run))
    for _ in range(40):
        a = rng.integers(1 << 62, size=300, dtype=np.uint64)
        b = np.where(rng.random(300) < rng.choice([0.6, 0.75, 0.9], size=6).repeat(50), a, rng.integers(1 << 62, size=300, dtype=np.uint64))
        made_of = [x for at in range(0, 200, 10) for x in (at, at + 100)]
        want, left = substring_dedup.passages(a, b, [0, 300]), np.isin(b, a)
        for p in want:
            left[p[2] : p[3]] = False
        for begin, end in zip(made_of[::2], made_of[1::2]):
            for p in substring_dedup.passages(a, b, [begin, end]) if left[begin:end].sum() > substring_dedup.EDGE else ():
                if left[p[2] : p[3]].any():
                    want.append(p)
                    left[p[2] : p[3]] = False
        runs.clear()
        assert substring_dedup.place_passages(a, b, made_of) == want
        assert len(runs) == len(set(runs))
        total += len(runs)
    assert total > 100


def _plain_passages(a, b):
    """Passages of b that are near duplicates of a: each run's sets are built anew, and no run is given up early."""
    width, least, percent = substring_dedup.WIDTH, substring_dedup.LEAST, substring_dedup.PERCENT
    found = []
    first_in_a = {x: i for i, x in reversed(list(enumerate(a.tolist())))}
    b = b.tolist()

    def similar(run):
        y = b[run[0] : run[-1] + 1]
        if len(y) < least or 100 * len({b[i] for i in run}) < percent * len(set(y)):
            return False
        there = [first_in_a[b[i]] for i in run]
        middle = sorted(t - i for t, i in zip(there, run))[len(run) // 2]
        for wide in (len(run) // 4 + width, len(run) // 3 + width):
            near = [t for t, i in zip(there, run) if abs(t - i - middle) <= wide]
            first, size = min(near), len(y)
            on = [k for k, x in enumerate(a[first : first + size].tolist()) if x in set(y)]
            most = max(2 * width - 1, max([y - x for x, y in zip(run, run[1:])], default=1) - 1) + 1
            reach = next((x for x, y in zip(on, on[1:]) if y - x > most), on[-1]) + 1
            for last in (max(near) + 1, min(first + size, len(a)), first + reach):
                x = set(a[first:last].tolist())
                if last - first >= least * percent // 100 and 100 * len(x & set(y)) >= percent * len(x | set(y)):
                    found.append((first, last, run[0], run[-1] + 1, len(x & set(y)) / len(x | set(y))))
                    return True
        return False

    todo = [[i for i, x in enumerate(b) if x in first_in_a]]
    while todo:
        run = todo.pop()
        if len(run) < least * percent // 100 or run[-1] - run[0] + 1 < least or similar(run):
            continue
        worth = [100 * i - percent * (x - run[0]) for i, x in enumerate(run)]
        low = np.minimum.accumulate(worth)
        last = int(np.argmax(np.array(worth) - low))
        begin = int(np.argmin(worth[: last + 1]))
        if 0 < last + 1 - begin < len(run) and similar(run[begin : last + 1]):
            todo += [run[:begin], run[last + 1 :]]
        elif max(gaps := np.diff(run)) > 1:
            todo += [part.tolist() for part in np.split(np.array(run), np.flatnonzero(gaps == gaps.max()) + 1)]
    return found


def test_passages_are_those_of_plain_sets(monkeypatch):
    """Texts with changes, inserted and moved blocks and repeated shingles. No set is built for a run that is tried."""
    rng, cases = np.random.default_rng(12), []
    for n in range(240):
        a = rng.integers(1 << 62, size=rng.integers(46, 400), dtype=np.uint64)
        if n % 3 == 0:  # shingles come again and again
            a = a[rng.integers(len(a) // 2, size=len(a))]
        if n % 5 == 0:
            a = np.concatenate([a, a[: len(a) // 2]])
        b = np.where(rng.random(len(a)) < rng.choice([0.5, 0.75, 0.85, 0.95], size=len(a) // 25 + 1).repeat(25)[: len(a)], a, rng.integers(1 << 62, size=len(a), dtype=np.uint64))
        if n % 2:
            cuts = np.sort(rng.integers(len(b), size=4))
            pieces = np.split(b, cuts)
            b = np.concatenate([pieces[k] for k in rng.permutation(5)] if n % 4 == 1 else [*pieces[:3], rng.integers(1 << 62, size=rng.integers(5, 60), dtype=np.uint64), *pieces[3:]])
        cases.append((a, b))
    want = [_plain_passages(a, b) for a, b in cases]
    assert sum(map(bool, want)) > 60 and sum(map(len, want)) > sum(map(bool, want))

    def refuse(*args, **kwargs):
        raise AssertionError("a set is built")

    with monkeypatch.context() as m:
        for name in ("unique", "isin", "intersect1d"):
            m.setattr(np, name, refuse)
        got = [substring_dedup.passages(a, b, [0, len(b)]) for a, b in cases]
    assert got == want


def test_only_what_is_read_again_takes_disk(spark, small):
    """When the passages are found, tables on the way there are gone, and shuffle files but for those of a stage or two; the tables that the result reads go with an outer scratch."""
    disk, folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager(), spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffles():
        files = disk.getAllFiles()
        return {x[1] for x in (files.apply(k).getName().split("_") for k in range(files.size())) if x[0] == "shuffle"}

    shuffled, tables, setting = shuffles(), set(os.listdir(folder)), spark.conf.get(name)
    with session.scratch(spark):
        got = substring_dedup.repeated(spark.read.parquet(f"{small}/documents.parquet"))
        for _ in range(50):  # files go in the background
            if len(shuffles() - shuffled) <= 2:
                break
            time.sleep(0.2)
        assert len(shuffles() - shuffled) <= 2
        assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - tables} == {"first", "passages", "more"}
        assert spark.conf.get(name) == setting and got.count()
    assert not set(os.listdir(folder)) - tables


def test_collisions_stream():
    """Batches of any size give the same hits: all pairs of signatures of few texts, and each window of a hot one by itself."""
    rng = random.Random(3)
    rows = sorted({(rng.choice([0, 1, 8, 9, 16, 24]) if rng.random() < 0.6 else 8 * rng.randrange(5, 60), rng.randrange(1, 9), rng.randrange(40)) for _ in range(300)})
    texts = defaultdict(set)
    for sig, key, _ in rows:
        texts[sig].add(key)
    want = set()
    for sig, key, span in rows:
        few = sorted(texts[sig])
        hot = len(few) > substring_dedup.FEW
        near = {few[0], few[few.index(key) - 1]} if key != few[0] else set()
        want |= {(r, key, sig & 7, span, sig, hot) for r in near | ({key} if hot else set())}
    for size in (1, 2, 7, 50, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows[i : i + size])], names=["sig", "key", "span"]) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in substring_dedup._collisions(iter(batches)) for r in b.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want, size


def _windows(x, lo, hi, least):
    if hi - lo < least:
        return set()
    c = lo + int(np.argmin(x[lo:hi]))
    return {(int(x[c]), lo, c, hi - 1)} | _windows(x, lo, c, least) | _windows(x, c + 1, hi, least)


def test_compact_windows():
    rng = np.random.default_rng(1)
    x = rng.permutation(500).astype(np.uint64)
    lo, hi = np.array([0, 120, 130]), np.array([120, 130, 500])
    got = set(zip(*(a.tolist() for a in substring_dedup.compact_windows(x, lo, hi, 9))))
    assert got == set().union(*(_windows(x, int(a), int(b), 9) for a, b in zip(lo, hi)))
    same = np.zeros(1 << 16, np.uint64)
    assert len(substring_dedup.compact_windows(same, np.array([0]), np.array([1 << 16]), 50)[0]) > 1000


def _nearest(ids, v, q, k=10):
    d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]]
    return [(int(ids[i]), float(d[i])) for i in order[:k]]


def test_hilbert_keys_walk():
    for d, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        keys = neighbours.hilbert_keys(cells, bits)
        walk = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(400)] + [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [nan, 1.0, 1.0]), (1400, [inf, 1.0, 1.0]), (1500, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, key string, point int").repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [(i, v) for i, v in rows[:400]]
    ids, v = np.array([i for i, _ in good]), np.array([x for _, x in good])
    assert dict(got) == {q: _nearest(ids, v, q) for q in (0, 100, 200, 300)}  # all points lie in the window
    few = neighbours.search(df.filter("vec_id < 4")).collect()
    assert len(few) == 3
    assert neighbours.search(df.filter("vec_id > 1050")).count() == 0
    assert neighbours.search(df.filter("vec_id < 0")).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in neighbours.search(df).collect():
        got[r.query_id].add(r.vec_id)
    ids, w = np.arange(6000), v.astype(float)
    hits = sum(len(got[q] & {i for i, _ in _nearest(ids, w, q)}) for q in range(0, 6000, 100))
    assert hits >= 0.9 * 600


def test_windows_are_short_of_all(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    rows = neighbours.search(df, share=0.01, least=12).filter(F.col("query_id") == 100).collect()
    assert {r.vec_id for r in rows} <= set(range(80, 121)) and len(rows) == 10


def test_clusters_need_few_distances(spark):
    """Vectors in clusters: of 50,000 rows a query is compared with less than a tenth, and 0.9 of the true neighbours are found."""
    rng = np.random.default_rng(5)
    n, width = 50_000, 32
    v = (rng.normal(size=(1000, width))[rng.integers(0, 1000, n)] + 0.1 * rng.normal(size=(n, width))).astype(np.float32)
    table = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), width).cast(pa.list_(pa.float32()))})
    found, window = neighbours.searched(spark.createDataFrame(table).repartition(4), 500, 10, None, neighbours.LEAST_WINDOW, "vec_id", "embedding")
    assert 2 * window * neighbours.CURVES < n / 10
    got = defaultdict(set)
    for r in found.collect():
        got[r.query_id].add(r.vec_id)
    ids, w = np.arange(n), v.astype(float)
    hits = sum(len(got[q] & {i for i, _ in _nearest(ids, w, q)}) for q in range(0, n, 500))
    assert hits >= 0.9 * 1000

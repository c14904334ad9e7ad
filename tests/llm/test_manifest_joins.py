"""Manifest, overlap join and filter interactions against brute-force versions."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkframe.llm import interactions, manifest, overlapjoin
from tests_llm_words import fold, space_words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, path string, rid string, before int"


@pytest.fixture(scope="module")
def table_of(spark):
    def make(rows):
        """(doc_id, text, lang, source, n_chars) rows, with columns named like the operators' own and two awkward names."""
        full = [(*r, "x", 7, "y", "z", 3) for r in rows]
        return spark.createDataFrame(full, COLUMNS).withColumn("a.b", F.lit(1)).withColumn("a b", F.lit(2))

    return make


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute_tree(nodes):
    """(root, path of every leaf)."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 16 * 16:a // 16 * 16 + 16]
            paths[i].append(("".join(run[:a % 16]), "".join(run[a % 16 + 1:])))
        level = [h(*level[a:a + 16]) for a in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return level[0], paths


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, text, lang, source, n_chars) rows."""
    by = {}
    for d, t, lang, src, n in rows:
        by.setdefault(src, []).append((d, brute_leaf((d, src, lang, n, t))))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        leaves = sorted(by[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = leaves, *brute_tree([x[1] for x in leaves])
    root, above = brute_tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        leaves, sub, paths = trees[s]
        out += [(d, leaf, sub, root, h(*[a + b for a, b in path + up])) for (d, leaf), path in zip(leaves, paths)]
    return sorted(out, key=str)


def made_manifest(df):
    got = df.select("doc_id", "leaf", "subroot", "root", manifest.proof(F.col("path")).alias("p"), manifest.fold(F.col("leaf"), F.col("path")).alias("f"))
    rows = got.collect()
    assert all(r["f"] == r["root"] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=str)


def test_manifest_is_brute_force(table_of, odd_texts):
    rows = [(i, t, None if i % 2 else "en", None, None if t is None else len(t)) for i, t in enumerate(odd_texts)]
    rows += [(1000 - 3 * i, f"text {i}", "de", "hot", i) for i in range(600)]  # 600, 38, 3, 1 nodes
    rows += [(5, "same", "x", "twice", 1)] * 17 + [(None, "no id", "x", "twice", 1), (None, None, None, "twice", None)]
    rows += [(10**15 + i, "alone", None, f"s{i:02d}", 0) for i in range(20)] + [(7, "blank source", None, "", 1), (8, "ü", "é", "ü", 1)]
    assert made_manifest(manifest.manifest(table_of(rows))) == brute_manifest(rows)


def test_manifest_does_not_depend_on_order_or_partitions(table_of):
    rows = [(i * i * 7919 % 10007, f"t{i}", "en", f"s{i % 3}", i) for i in range(100)]
    one = made_manifest(manifest.manifest(table_of(rows)))
    assert one == made_manifest(manifest.manifest(table_of(rows[::-1]).repartition(5))) == brute_manifest(rows)


def test_manifest_of_one_row_and_of_none(table_of):
    docs = table_of([(1, "a", None, None, None)])
    r = manifest.manifest(docs, carry={"tree": F.upper("text")}).first()
    assert r["leaf"] == r["subroot"] == r["root"] == brute_leaf((1, None, None, None, "a")) and r["path"] == [] and r["tree"] == "A"
    assert manifest.manifest(docs.limit(0)).count() == 0
    assert manifest.manifest(docs.drop("lang", "n_chars")).first()["leaf"] == r["leaf"]


def test_changed_text_is_found(table_of):
    docs = table_of([(i, f"Text {i}", "en", "s", 1) for i in range(40)])
    changed = manifest.leaf({c: F.col(c) for c in manifest.FIELDS[:-1]} | {"text": F.lower("text")})
    out = manifest.manifest(docs, carry={"new": F.when(F.col("doc_id") == 21, changed)})
    bad = out.filter(manifest.fold(F.coalesce("new", "leaf"), F.col("path")) != F.col("root"))
    assert [r["doc_id"] for r in bad.collect()] == [21]


# --- overlap join ------------------------------------------------------------------------------------------------
def shingles(text, k=3):
    w = space_words(fold(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def brute_components(docs, percent=90):
    sets = [(d, shingles(t)) for d, t in docs]
    label = {d: d for d, _ in docs}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(sets):
            for b, y in sets[:i]:
                if x and y and 100 * len(x & y) >= percent * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted((d, len(s), label[d]) for d, s in sets)


def near_texts(seed, groups=6, size=9, words=60):
    rng = np.random.default_rng(seed)
    common = [f"c{i}" for i in range(40)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(4, words)))] + common[: int(rng.integers(0, 40))]
        for _ in range(size):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(0, len(w)))
                w[at:at + int(rng.integers(0, 2))] = [f"n{rng.integers(0, 5)}"]
            out.append(" ".join(w))
    return out


def linked_ids(docs, **how):
    got = overlapjoin.jaccard_links(docs.withColumn("a.b", F.lit(1)).withColumn("_own", F.lit(0)), **how)
    want = brute_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    return sorted(tuple(r) for r in got.collect()), want


def test_overlap_join_is_brute_force(documents, odd_texts):
    got, want = linked_ids(documents([*odd_texts, *near_texts(1), *near_texts(2, groups=2, size=30)]))
    assert got == want and len({c for _, _, c in want}) < len(want) - 5


def test_overlap_join_in_blocks(documents):
    """Groups larger than a block; all documents share a passage, so groups are large and some are dealt by their lists."""
    got, want = linked_ids(documents([*near_texts(1), *near_texts(2, groups=2, size=30)]), block=150)
    assert got == want


def test_groups_are_dealt_by_lists_where_that_sends_less(spark):
    """A chain of documents in lists of two is one group of many blocks: by lists, every document is sent twice at most."""
    n = 40
    members = spark.createDataFrame([(i, 0, 10) for i in range(n)] + [(100 + i, 1, 10) for i in range(6)], "cid long, component long, size long")
    rows = [(1000 + i, x) for i in range(n - 1) for x in (i, i + 1)] + [(k, 100 + i) for k in range(9) for i in range(6)]
    cells = overlapjoin.cells_of(members, spark.createDataFrame(rows, "key long, cid long"), 20)
    got = [(r["key"], r["cid"]) for r in cells.collect()]
    assert sorted(got) == sorted([r for r in rows if r[0] >= 1000] + [(1, 100 + i) for i in range(6)])


def test_overlap_join_of_repeated_and_empty(documents):
    docs = documents(["a b c d", "a b c d", None, "x"], ids=[3, 3, None, None])
    got = sorted((tuple(r) for r in overlapjoin.jaccard_links(docs).collect()), key=str)
    assert got == sorted([(3, 2, 3), (3, 2, 3), (None, 0, None), (None, 1, None)], key=str)
    assert overlapjoin.jaccard_links(docs.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [60, 75, 90, 100])
def test_t_occurrence_connects_what_is_linked(percent):
    rng = np.random.default_rng(percent)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 60, int(rng.integers(0, 40)))).astype(np.uint64)]
        for _ in range(25):
            s = set(sets[int(rng.integers(0, len(sets)))].tolist())
            s ^= set(rng.integers(0, 60, int(rng.integers(0, 5))).tolist())
            sets.append(np.array(sorted(s), np.uint64))
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        side = rng.integers(0, 2, len(sets))
        for kind in (None, side):
            def linked(a, b):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                return bool(x and y) and 100 * len(x & y) >= percent * len(x | y) and (kind is None or side[a] != side[b])

            links = overlapjoin.t_occurrence(np.concatenate(sets), first, percent, kind)
            assert all(linked(a, b) for a, b in links)

            def roots(pairs):
                root = list(range(len(sets)))
                for _ in sets:
                    for a, b in pairs:
                        root[a] = root[b] = min(root[a], root[b])
                return root

            assert roots(links) == roots([(a, b) for a in range(len(sets)) for b in range(a) if linked(a, b)])


# --- filter interactions -----------------------------------------------------------------------------------------
def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for d, t, lang in docs:
        t = t or ""
        w = space_words(t)
        bad = {f for f, on in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                          re.search("[#$%&*|]", t))) if on}
        if d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs):
            bad.add("E")
        rows.append((lang or "", bad, d in good, d in toxic))
    out, whole = [], {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in mine if f in r[1] and not r[1] & before]
                whole[part, f] = whole.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), k + 1, sum(not r[1] & (before | {f}) for r in mine), len(gone),
                            sum(f in r[1] and bool(r[1] & before) for r in mine), sum(r[1] == {f} for r in mine),
                            sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r, whole[r[0], r[1][r[2] - 1]]) for r in out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_is_brute_force(spark, table_of, odd_texts):
    long = " ".join(f"word{i}" for i in range(120))
    texts = [*odd_texts, long, long, long.upper(), long + " #", "A B", "a " * 130, long, "", "x | y", long + " ü", long + "\x0b\x1f"]
    docs = [(i if i != 12 else None, t, [None, "", "en", "de"][i % 4], "s", 1) for i, t in enumerate(texts)] + [(3, "one", "de", "s", 1)] * 2
    labels = [(1, 1, 0), (3, 1, 1), (3, 0, 0), (5, None, 1), (None, 1, 1), (11, 1, None), (13, 0, 1), (99, 1, 1), (16, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interactions.filter_audit(table_of(docs), marks)
    assert sorted(tuple(r) for r in got.select(*AUDIT).collect()) == brute_audit([(d, t, lang) for d, t, lang, _, _ in docs], labels)
    none = interactions.filter_audit(table_of(docs), marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0]
    assert none == 0
    assert interactions.filter_audit(table_of(docs).limit(0), marks).count() == 0


def test_audit_of_own_filters(spark):
    """Any filters as id tables; one that nothing fails and one that all fail."""
    rows = spark.range(10).select(F.col("id").alias("rid"), F.lit("p").alias("part"))
    fails = {"none": spark.range(0), "all": spark.range(10), "even": spark.range(0, 10, 2)}
    got = {(r["before"], r["filter"]): tuple(r)[3:] for r in interactions.audit(rows, {k: v.select(F.col("id").alias("rid")) for k, v in fails.items()}).collect()}
    assert got[0, "none"] == (10, 0, 0, 0) and got[0, "all"] == (0, 10, 0, 5) and got[2, "even"] == (0, 0, 5, 0) and got[5, "all"] == (0, 5, 5, 5)
    with pytest.raises(ValueError):
        interactions.audit(rows, dict.fromkeys(map(str, range(8)), rows.select("rid")))

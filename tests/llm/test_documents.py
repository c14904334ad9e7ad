"""Operators against brute-force versions on the given tables and on odd rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkframe.llm import decontaminate, graph, neardup, packing, quality, queries, secrets, sharding, substrings, toxicity
from tests_llm_words import fold, space_words

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# --- op1 ---------------------------------------------------------------------------------------------------------
def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))


def brute_contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        for a in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[a:a + 13])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def contaminated(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_contamination_is_brute_force(spark, given, limit):
    """Also when the benchmark is cut into several automata."""
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    got = contaminated(decontaminate.contamination(given, bench, limit_bytes=limit))
    assert got == brute_contamination(texts_of(given), [(r["item_id"], r["text"]) for r in bench.collect()])


def test_contamination_of_odd_rows(spark, documents, odd_texts):
    docs = documents([*odd_texts, "x ONE-two, three! y", "two three"])
    items = [(1, "one two three"), (1, "three"), (2, None), (3, ""), (None, "y"), (10, "Word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, carry=True)
    assert contaminated(got) == brute_contamination(texts_of(docs), items)
    assert got.select("_row.*").columns == docs.columns
    r = got.filter("doc_id = 10").first()
    assert [("x ONE-two, three! y"[s["s"]:s["e"]]) for s in r["spans"]] == ["ONE-two, three", "y"]
    assert contaminated(decontaminate.contamination(docs, bench.limit(0))) == brute_contamination(texts_of(docs), [])
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# --- op2 ---------------------------------------------------------------------------------------------------------
def check_pieces(df, docs):
    encode = packing.ByteTokenizer("byte_bpe_50k").exact
    rows = df.collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert len(by_doc) == len(docs)
    for d, t in docs:
        want = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        parts = sorted(by_doc[d], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in parts) == want
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        assert {r["doc_tokens"] for r in parts} == {len(want) // 4}
    for parts in by_seq.values():
        parts = sorted(parts, key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1].tolist()]
        assert sum(r["length"] for r in parts) <= 1024
    return 1 - sum(r["length"] for r in rows) / (1024 * len(by_seq))


def test_packing_is_a_partition_of_the_tokens(given):
    assert check_pieces(packing.pack(given), texts_of(given)) < 0.05


def test_packing_of_odd_rows(documents, odd_texts):
    docs = documents([*odd_texts, "a <|endoftext|> b", "русский текст", "x" * 5000])
    check_pieces(packing.pack(docs), texts_of(docs))
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 500)
    load = np.bincount(packing.multiway(sizes, 64), weights=sizes, minlength=64)
    assert load.sum() == sizes.sum() and load.max() - load.min() <= 16
    assert np.bincount(packing.deal(sizes, 1024), weights=sizes).max() <= 1024
    assert packing.multiway(np.array([5]), 1).tolist() == [0]
    # the textbook case of two-way differencing: 8 7 | 6 5 4 is found as 16 against 14
    two = np.bincount(packing.multiway(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])
    assert sorted(two) == [14, 16]


# --- op4 ---------------------------------------------------------------------------------------------------------
def brute_strip(docs):
    count = Counter()
    for _, t in docs:
        w = space_words(t)
        count.update(tuple(w[i:i + 35]) for i in range(len(w) - 34))
    out = []
    for d, t in docs:
        w = space_words(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = True
        out.append((d, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def stripped(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("leaves", [substrings.LEAVES, 1])
def test_strip_is_brute_force(given, leaves):
    """Also when every prefix with several leaves is split by whole windows."""
    got = stripped(substrings.strip_repeats(given, leaves=leaves))
    assert got == brute_strip(texts_of(given))
    assert sum(r[2] for r in got) > 0


def test_strip_of_odd_rows(documents, odd_texts):
    rng = np.random.default_rng(1)
    words = [f"v{i}" for i in range(5)]
    noise = [" ".join(rng.choice(words, 120)) for _ in range(6)]
    passage = " ".join(f"p{i}" for i in range(36))
    docs = documents([*odd_texts, *noise, f"a {passage} b", f"c  {passage}\nd", passage[: passage.rindex(" ")], "n1 n2"])
    assert stripped(substrings.strip_repeats(docs)) == brute_strip(texts_of(docs))
    assert substrings.strip_repeats(docs.limit(0)).count() == 0


# --- op5 ---------------------------------------------------------------------------------------------------------
def brute_near(docs):
    sets, least = [], {}
    for d, t in docs:
        w = space_words(fold(t))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 75 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    for i, (d, _) in enumerate(docs):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def near(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_near_duplicates_are_brute_force(given):
    got = neardup.near_duplicates(given)
    assert near(got) == brute_near(texts_of(given))
    rows = got.collect()
    assert all(r["keep"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_of_odd_rows(documents, odd_texts):
    base = " ".join(f"b{i}" for i in range(60))
    near_texts = [base, base + " x", base.upper(), base.replace("b30", "z"), base.replace("b10", "z").replace("b40", "y")]
    texts = [*odd_texts, *near_texts, base]
    docs = documents(texts, [*range(len(texts) - 3), None, 13, 13])
    got = neardup.near_duplicates(docs)
    assert near(got) == brute_near(texts_of(docs))
    kept = Counter(r["component_id"] for r in got.collect() if r["keep"] and r["n_shingles"])
    assert set(kept.values()) == {1}
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_families_that_share_a_passage_stay_apart(documents):
    """Similar but unlinked documents meet in buckets; no link is lost or made up."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([*passage, *(f"u{d}_{i}" for i in range(int(rng.integers(10, 40))))]) for d in range(40)]
    texts += [t + f" end{i}" for i, t in enumerate(texts[:10])]
    docs = documents(texts)
    assert near(neardup.near_duplicates(docs)) == brute_near(texts_of(docs))


def test_bit_estimates_are_corrected(documents):
    a = set(range(300))
    for shared in (300, 240, 150, 0):
        b = set(range(300 - shared, 600 - shared))
        mins = [neardup.minima(np.sort(neardup.mix(np.array(sorted(s), np.uint64) + np.uint64(1))), np.array([0, len(s)])) for s in (a, b)]
        got = neardup.estimate(neardup.pack(mins[0])[0], neardup.pack(mins[1])[0])
        assert abs(got - len(a & b) / len(a | b)) < 0.2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(tuple(r) for r in graph.components(edges).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- op6 ---------------------------------------------------------------------------------------------------------
def check_shards(docs, rows, shards=40):
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in docs)
    text = dict(docs)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    sizes = [len(per[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_shards_are_even_and_keep_copies_together(given):
    docs, rows = texts_of(given), sharding.assign_shards(given).collect()
    check_shards(docs, rows)
    at, text = {r["doc_id"]: r["shard"] for r in rows}, dict(docs)
    groups = defaultdict(list)
    for d, t in text.items():
        groups[t].append(at[d])
    many = [v for v in groups.values() if len(v) > 1]
    assert many and np.mean([len(set(v)) == 1 for v in many]) > 0.8


def test_shards_of_odd_rows(documents, odd_texts):
    docs = documents([*odd_texts, *["copy"] * 30, *(f"t{i}" for i in range(50))])
    rows = sharding.assign_shards(docs, shards=4).collect()
    check_shards(texts_of(docs), rows, 4)
    text = dict(texts_of(docs))
    copies = Counter(r["shard"] for r in rows if text[r["doc_id"]] == "copy")
    assert max(copies.values()) >= 10
    assert sharding.assign_shards(docs.limit(0)).count() == 0
    check_shards(texts_of(docs.limit(3)), sharding.assign_shards(docs.limit(3)).collect())


# --- op8 ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("pairs,alone", [(1600, 0), (640, 640)])
def test_linked_rows_are_gathered_when_shards_are_full(spark, documents, pairs, alone):
    """Copies in pairs and one group of a third of all rows: all rows linked, and as many that room is short until others leave."""
    group = (2 * pairs + alone) // 2
    docs = documents(["copy"] * group + [f"p{i}" for i in range(pairs)] * 2 + [f"t{i}" for i in range(alone)])
    rows = sharding.assign_shards(docs).collect()
    check_shards(texts_of(docs), rows)
    text, at = dict(texts_of(docs)), defaultdict(Counter)
    for r in rows:
        at[text[r["doc_id"]]][r["shard"]] += 1
    cut = sum(len(at[f"p{i}"]) > 1 for i in range(pairs))
    quota = len(rows) // 40
    parts = -(-group // (quota // 2))
    held = sorted(at["copy"].values(), reverse=True)
    assert len(held) <= parts  # a shard of its own for every part at most
    assert cut <= (0 if alone else 39)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    hit = rows.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert hit > 0.97
    bad = rows.groupBy("toxic").agg(F.avg(F.col("predicted").cast("double")).alias("flagged")).collect()
    assert {r["toxic"]: r["flagged"] for r in bad}[0] < 0.01 and {r["toxic"]: r["flagged"] for r in bad}[1] > 0.85


SENTENCES = {"aimed": "You are an idiot.", "plain": "The idiot left the room.", "reported": "He said: the idiot left.", "negated": "That was never an idiot.",
             "threat": "I will kill you tomorrow.", "threat reported": "She wrote: I will kill you.", "threat negated": "I will not kill you."}
INNOCENT = ["We walked along the path.", "It is worth it.", "You will lose the game.", "I will kill the lights.", "idiotic", ""]


def scores(texts, model):
    x = toxicity.clause_features(pa.array(texts), toxicity.Lexicon(model))
    return x, toxicity.probability(x, model.weights)


def check_sentences(model):
    x, p = scores(list(SENTENCES.values()), model)
    for row, kind in zip(x, SENTENCES):
        assert {c for c, v in zip(toxicity.FEATURES[1:], row[1:]) if v} == {kind}
    p = dict(zip(SENTENCES, p))
    assert p["aimed"] >= p["plain"] > p["reported"] > p["negated"]
    assert p["threat"] > p["threat reported"] > p["threat negated"] and p["threat"] > 0.5 > p["threat negated"]
    assert max(scores(INNOCENT, model)[1]) < 0.5


def test_grammar_scores_clauses(monkeypatch):
    model = toxicity.Model()
    check_sentences(model)
    p = dict(zip(SENTENCES, scores(list(SENTENCES.values()), model)[1]))
    assert p["plain"] > 0.5 > p["reported"]
    before = scores(list(SENTENCES.values()), model)[1] >= 0.5
    with monkeypatch.context() as patch:  # without marks results change
        plain = toxicity.Transducer(0, (0,), lambda state, s: (0, {"I": "plain", "T": "threat"}.get(s[0], "o")))
        patch.setattr(toxicity, "GRAMMAR", plain)
        assert (scores(list(SENTENCES.values()), model)[1] >= 0.5).sum() > before.sum()
    lexicon = toxicity.Lexicon(model)
    assert lexicon.clauses("not good. idiot") == lexicon.clauses("idiot") == [{"plain": toxicity.SEED_WEIGHT}]
    assert lexicon.clauses('he said: "idiot". clown') == [{"reported": toxicity.SEED_WEIGHT}, {"plain": toxicity.SEED_WEIGHT}]


def test_automaton_is_the_composition_of_its_transducers():
    """Every string of up to four symbols: the composed automaton and the five transducers one after another agree."""
    chain = [toxicity.negation(), toxicity.targets(), toxicity.reported(), toxicity.insults(), toxicity.threats()]
    for n in range(1, 5):
        for word in itertools.product(toxicity.ALPHABET, repeat=n):
            state, at, out = toxicity.GRAMMAR.start, [t.start for t in chain], []
            for symbol in word:
                state, one = toxicity.GRAMMAR.step(state, symbol)
                for i, t in enumerate(chain):
                    at[i], symbol = t.step(at[i], symbol)
                assert one == symbol


def test_learned_forms_and_threats(spark, documents):
    """A beginning needs several words behind it; repeated labelled ids count once; class weights keep the grammar's order."""
    rows = [(i, f"text {i} pathetic blorg{'abcdefgh'[i % 8]}x" if i % 2 else f"text {i} along the path", i % 2) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1, "again")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] * 2, "doc_id long, quality int, toxic int")
    assert toxicity._training(docs, labels, 1000).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(400))
    model = toxicity.fit(docs, labels)
    assert model.words["pathetic"] > 0 and any(s.startswith("blor") for s in model.stems) and not any(s.startswith("path") for s in model.stems)
    w = model.weights[0]
    assert w[2] >= w[3] >= w[4] >= w[5]
    check_sentences(toxicity.Model(weights=model.weights))


def test_toxicity_of_odd_rows(spark, documents, odd_texts):
    docs = documents([*odd_texts, "you idiot"])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, model).collect()}
    assert all(0 <= v <= 1 for v in got.values()) and got[10] > 0.5 and max(v for k, v in got.items() if k != 10) < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in held}


# --- op9 ---------------------------------------------------------------------------------------------------------
def brute_measures(text):
    text = text or ""
    w = space_words(text)
    lines = [x for x in text.split("\n") if space_words(x)]
    count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = np.zeros(len(w), bool)
    for i in range(len(w) - 7):
        if count[tuple(w[i:i + 8])] > 1:
            again[i:i + 8] = True
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), int(again.sum())


def test_measures_are_brute_force(given, documents, odd_texts):
    for docs in (given, documents([*odd_texts, "a\na\r\na\n\n b", "x y z " * 9 + "# <tag>"])):
        text = dict(texts_of(docs))
        for r in quality.measure(docs).collect():
            assert tuple(r[c] for c in quality.COUNTS) == brute_measures(text[r["doc_id"]])
    assert quality.measure(given.limit(0)).count() == 0


def test_decision_list_learns_and_generalises(spark):
    rng = np.random.default_rng(2)
    x = {"a": rng.random(600), "b": rng.random(600)}
    low = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] < 0.5))
    rules = quality.cover(x, low)
    said = np.zeros(600, bool)
    for r in rules:
        said |= r.rows(x)
    assert (said == low).mean() > 0.95
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x["a"], x["b"]))], "i int, a double, b double")
    assert [r["v"] is not None for r in df.orderBy("i").select(quality.decision(rules).alias("v")).collect()] == said.tolist()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    wrong = rows.agg(F.avg((F.col("kept") & (F.col("quality") == 0)).cast("double")), F.avg((F.col("rule").isNotNull() & (F.col("quality") == 1)).cast("double"))).first()
    assert max(wrong) < 0.02


def test_label_propagation_never_cuts_more(spark):
    """From a random start: cut pairs fall in every round, quotas hold, and where there is room no group stays apart."""
    rng = np.random.default_rng(6)
    sizes = [2] * 30 + [3] * 10 + [25, 40]
    rows = [(g, int(rng.integers(0, 5))) for g, n in enumerate(sizes) for _ in range(n)]
    start = spark.createDataFrame([(i, str(g), s) for i, (g, s) in enumerate(rows)], "rid long, grp string, shard int")

    def cut(df):
        groups = {}
        for r in df.collect():
            groups.setdefault(r["grp"], []).append(r["shard"])
        return sum(a != b for m in groups.values() for i, a in enumerate(m) for b in m[:i])

    load = np.bincount([s for _, s in rows], minlength=5)
    for quota in ([80] * 5, [int(n) + 4 for n in load], [int(n) for n in load]):
        out, cuts = sharding.propagate(start, quota)
        assert cuts[0] == cut(start) and cuts[-1] == cut(out) and all(b < a for a, b in zip(cuts, cuts[1:]))
        held = np.bincount([r["shard"] for r in out.collect()], minlength=5)
        assert held.sum() == len(rows) and (held <= quota).all()
        if quota[0] == 80:
            assert cuts[-1] == 0
        elif quota == load.tolist():
            assert len(cuts) == 1  # no room anywhere
        else:
            assert len(cuts) > 1


# --- op10 --------------------------------------------------------------------------------------------------------
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)


def brute_base(text):
    text = text or ""
    rows = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]
    rows += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    rows += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))


def test_base_spans_are_brute_force(spark, documents, odd_texts):
    more = ["secret: token : abcdefghij", 'é😀 API_KEY = "abcdefgh.1" token=short', "AKIA" * 5 + " " + "0af" * 12, "password:" + "ab" * 20 + "0" * 40]
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), documents([*odd_texts, *more])):
        text = dict(texts_of(docs))
        for r in secrets.scan_secrets(docs, [0.0] * 128 * 128).select("doc_id", secrets.listed("base").alias("b")).collect():
            assert r["b"] == brute_base(text[r["doc_id"]])


def test_markov_ratio_finds_random_tokens(documents):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    draw = lambda n: "".join(rng.choice(letters, n))
    names = ["connection_handler", "default_settings_value", "internal_request_state", "performance_counter", "application_context"]
    train = documents([f"token={draw(40)} {' '.join(rng.choice(names, 20))}" for _ in range(60)])
    ratios = secrets.train(train)
    random, plain = draw(30) + "7a", "internal_request_counter_2"
    docs = documents([f"x {random} y {plain} z", f"token={random}", None])
    got = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in secrets.scan_secrets(docs, ratios).collect()}
    assert got == {0: [(3, random)], 1: [(0, random)], 2: []}
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def ratios(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def brute_spans(text, ratios):
    """Base spans, and tokens beside them whose summed log ratio reaches the threshold."""
    text = text or ""
    base = [x.split(":") for x in brute_base(text).split(",") if x]
    taken = [(int(s), int(e)) for _, s, e in base]
    rows = [(int(s), secrets.KINDS.index(k), int(e)) for k, s, e in base]
    for m in re.finditer(r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_]{10,}={0,2}", text):
        total = sum(ratios[ord(a) * 128 + ord(b)] for a, b in zip(m[0], m[0][1:]))
        if total >= secrets.THRESHOLD and not any(s < m.end() and m.start() < e for s, e in taken):
            rows.append((m.start(), 3, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(rows))


def test_all_spans_are_brute_force(spark, documents, odd_texts, ratios):
    rng = np.random.default_rng(8)
    keys = ["".join(rng.choice(list("abcXYZ0189+/"), n)) for n in (9, 10, 15, 30)]
    more = [f"é {k}== -{k}_ and/or well-known-words 😀{k} token={k}x{k}" for k in keys]
    docs = documents([*odd_texts, *more]).withColumns({"_text": F.lit("t"), "_base": F.lit(1), "_more": F.lit(2), "a.b": F.lit(3), "a b": F.lit(4)})
    got = secrets.scan_secrets(docs, ratios)
    assert got.columns == [*docs.columns, "base", "spans"]
    for r in got.select("doc_id", "text", secrets.listed("spans").alias("s")).collect():
        assert r["s"] == brute_spans(r["text"], ratios)


def test_planted_keys_by_kind_and_length(spark, documents, ratios):
    """Recall of random keys of 16 to 64 characters; the corpus itself and ordinary long tokens stay clean."""
    rng = np.random.default_rng(5)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = {"base62": (upper + lower + digits, range(16, 65, 8)), "base64": (upper + lower + digits + "+/", range(16, 65, 8)), "hex": (digits + "abcdef", range(16, 32, 5))}
    keys = [(k, "".join(rng.choice(list(a), n))) for k, (a, sizes) in kinds.items() for n in sizes for _ in range(20)]
    found = {r["doc_id"]: r["n"] for r in secrets.scan_secrets(documents([f"see {k} here" for _, k in keys]), ratios).select("doc_id", F.size("spans").alias("n")).collect()}
    for kind in kinds:
        mine = [found[i] > 0 for i, (k, _) in enumerate(keys) if k == kind]
        assert np.mean(mine) >= 0.9, kind
    plain = documents(["internationalization and/or well-known-facts 2024-01-15 12345678901234", "default_settings_value src/main/resources/application"])
    added = F.size(F.filter("spans", lambda x: x["kind"] == 3))
    assert secrets.scan_secrets(plain, ratios).agg(F.sum(added)).first()[0] == 0
    corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert secrets.scan_secrets(corpus, ratios).agg(F.sum(added)).first()[0] <= 1


def test_digest_columns(spark):
    r = queries.op10_secrets(spark, DIR).filter("n_assign = 0 and n_access = 0 and n_hex = 0").first()
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(name, spark, duck):
    from compare import compare
    assert compare(queries.QUERIES[name](spark, DIR), duck, queries.ORACLES[name]) is None

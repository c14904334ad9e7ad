"""Surrogates, link-graph trust and the whole pipeline."""

import re
import shutil
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from talkframe.llm import pii, queries, urlfilter

DIR = "/root/testdata/sf0.001"


# --- op3 ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [2, 3, 26, 100, 1000])
def test_permutation_is_one_cycle(n):
    p = pii.Permutation(b"k" * 16, "x", n)
    at, seen = 0, set()
    for _ in range(n):
        seen.add(at)
        at = p(at)
    assert seen == set(range(n)) and at == 0


def test_kinds_and_formats_survive():
    made = pii.Surrogates("key")
    text = ("Write to Anna.Bell@Mail3.example.com or anna.bell@mail3.example.com; call +1 (988) 555-2485 or +1 988-555-2485; from 42.144.35.254 and "
            "192.168.1.7; card 4041 8949 7460 8795; IBAN DE89 3704 0044 0532 0130 00.")
    new, found = pii.replace(text, made)
    again = pii.find(new)
    assert [k for *_, k, _ in found] == [k for *_, k, _ in again]
    assert len(new) == len(text) or any(k == "ip" for *_, k, _ in found)
    old_forms = {c for *_, c in found}
    assert not old_forms & {c for *_, c in again}
    # one entity, one surrogate, whatever its spelling
    assert len({c for *_, k, c in again if k == "email"}) == 1 == len({c for *_, k, c in again if k == "phone"})
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    for kind in ("email", "card", "phone", "iban"):
        olds, news = ([t[s:e] for s, e, k, _ in f if k == kind] for t, f in ((text, found), (new, again)))
        assert [shape(o) for o in olds] == [shape(n) for n in news]
    card = next(c for *_, k, c in again if k == "card")
    assert pii.luhn(card) and card[0] == "4"
    assert [c for *_, k, c in again if k == "ip"][1].startswith("192.168.")


def test_names_keep_gender_script_and_coreference():
    made = pii.Surrogates("key")
    new, found = pii.replace("Mrs. Maria Lopez met Herr Klaus Weber. Lopez smiled; WEBER too. Господин Иван Петров и Елена Петрова. maria stayed.", made)
    words = new.split()
    assert words[1] in pii.GIVEN["latin", "f"] and words[1] != "Maria"
    assert words[5] in pii.GIVEN["latin", "m"] and words[5] != "Klaus"
    assert words[2] == words[7] != "Lopez" and words[9].isupper() and words[9].lower() == words[6].rstrip(".").lower()
    assert new.split("Господин ")[1].split()[0] in pii.GIVEN["cyrillic", "m"]
    he, she = re.search(r"Господин \w+ (\w+) и \w+ (\w+)\.", new).groups()
    assert she == he + "а" and he != "Петров"
    assert new.endswith("maria stayed.") and pii.find("The an ea. Anna went on 3 May 2024, version 1.2.3, 12345.") == []


@pytest.mark.parametrize("kind,values", [
    ("card", [f"4{i:015d}" for i in range(300)]), ("phone", [f"1:{i:07d}" for i in range(300)]),
    ("ip", [f"10.0.{i // 20}.{i % 20}" for i in range(200)] + [f"8.8.{i}.8" for i in range(100)]), ("email", [f"a{i}@x.org" for i in range(200)] + ["a@b.org", "b@b.org"]),
    ("name", [x + y for x in "abcdef" for y in ("lopez", "weber", "garcía", "петров", "петрова")]),
])
def test_surrogates_are_distinct(kind, values):
    made = getattr(pii.Surrogates("another key"), kind)
    out = [made(v) for v in values]
    assert len(set(out)) == len(set(values)) and all(a != b for a, b in zip(values, out))


def test_anonymise_given_and_odd_rows(spark, documents, odd_texts):
    given = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    got = {r["doc_id"]: r for r in queries.op3_pii(spark, DIR).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = pii.find(t)
        assert got[d]["n_entities"] == len(want)
        assert (got[d]["text"] == t) == (not want)
        assert not any(t[s:e] in got[d]["text"] for s, e, k, _ in want if k != "name")
    docs = documents([*odd_texts, "mail a.b@c.org", "mail a.b@c.org"])
    out = pii.anonymise(docs, "k")
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == [*docs.columns, "_entities"]
    assert [rows[i]["text"] for i in range(len(odd_texts))] == odd_texts
    assert rows[10]["text"] == rows[11]["text"] != "mail a.b@c.org"
    assert pii.anonymise(docs.limit(0), "k").count() == 0


def test_collisions_are_counted(spark):
    rows = [("email", "a@x.org", "b@x.org"), ("email", "b@x.org", "c@x.org"), ("phone", ":1234567", ":7654321"), ("phone", ":1111111", ":7654321"), ("name", "maria", "anna"), ("name", "anna", "laura")]
    assert pii.collisions(spark.createDataFrame(rows, "kind string, canon string, surrogate string")) == 2


def test_colliding_entities_are_moved_on(spark, documents):
    """Crowded classes: no key is free of collisions, three-letter names are more than half of their class, one phone has no class."""
    ips = [f"192.168.{i // 250}.{i % 250 + 1}" for i in range(1000)]
    names = [a + b for a in "BCDFG" for b in "aeiou"] + [a + b for a in "aeiou".upper() for b in "bcdfghjklmn"] + ["Kim", "Ñç"]
    mails = [f"{a}@{b}.org" for a in "aeiou" for b in "bcdfghjklmnpqrstvwxyz"]
    texts = [f"from {i}, to Mr {n}, {m}" for i, n, m in zip(ips, names * 20, mails * 10)] + [f"host {i}" for i in ips] + ["Call 1 at +٤٩ ٣٠ ١٢٣٤٥٦", None, ""]
    docs = documents(texts)
    rows = {r["doc_id"]: r for r in pii.anonymise(docs, "k").collect()}
    assert len(rows) == len(texts)
    made = {}
    for i, t in enumerate(texts):
        if not t:
            assert rows[i]["text"] == t
            continue
        old, new = pii.find(t), rows[i]["text"]
        assert [(s, e, k) for s, e, k, _ in old] == [tuple(x[c] for c in ("start", "end", "kind")) for x in rows[i]["_entities"]]
        parts = re.split("|".join(re.escape(t[b:a]) for b, a in zip([0, *(e for _, e, _, _ in old)], [s for s, _, _, _ in old]) if a > b), new)
        values = [p for p in parts if p]
        assert len(values) == len(old)
        for (_, _, k, c), v in zip(old, values):
            assert made.setdefault((k, c), v.lower()) == v.lower()  # one surrogate wherever it stands
    assert len(made) == len(ips) + len(names) + len(mails) + 1
    assert len({(k, v) for (k, _), v in made.items()}) == len(made)
    assert not {(k, v) for (k, _), v in made.items()} & set(made)
    assert all("٤٩ ٣٠ ١٢٣٤٥٦" not in (r["text"] or "") for r in rows.values())


def test_gate_loses_no_entity():
    """Triggers that touch typographic punctuation, and digits of other scripts, are sought like all others."""
    names = ["“Mr Smith”", "‘Dr. Kim’ said", "¿Señora García?", "«Frau Müller»", "he—Dr Brown—left", "l’Anna Rossi", "…Herr Weber", "„Prof. Groß“", "»Иван Петров«", "–Γιώργος Παππάς"]
    texts = [*names, "+٤٩ ٣٠ ١٢٣٤٥٦", "a@b.org", None, "", "Done. Mrs", "plain words", "5", "the Msx Dr.Who", "Anna went"]
    texts += [f"{quote}{who} Lopez" for quote in "\"'“”‘’«»‹›„‚¿¡—–…•·\u00a0\u2009(" for who in ("Mr", "Dr.", "Señora", "Госпожа", "Julia", "Νίκος")]
    got = {r: pii.find(t, n) if t else [] for t, r, n in pii._candidates(pa.record_batch([pa.array(texts)], names=["text"]))}
    assert got == {r: pii.find(t or "") for r, t in enumerate(texts)}
    assert all(got[r] for r in range(len(names) + 2))


@pytest.mark.parametrize("n", [2, 6, 97, 100])
def test_steps_reach_the_whole_class(n):
    p = pii.Permutation(b"k" * 16, "x", n)
    for x in range(n):
        assert {p(x, step) for step in range(n)} == set(range(n))


# --- op7 ---------------------------------------------------------------------------------------------------------
def brute_trust(edges, good, bad, rounds=urlfilter.ROUNDS, damping=urlfilter.DAMPING):
    out, into = Counter(), Counter()
    for (a, b), n in edges.items():
        out[a] += n
        into[b] += n
    hosts = {h for e in edges for h in e} | set(good) | set(bad)
    seeds = [{h: s.get(h, 0) / (sum(s.values()) or 1) for h in hosts} for s in (good, bad)]
    trust, distrust = seeds
    for _ in range(rounds):
        t, d = ({h: (1 - damping) * s[h] for h in hosts} for s in seeds)
        for (a, b), n in edges.items():
            t[b] += damping * trust[a] * n / out[a]
            d[a] += damping * distrust[b] * n / into[b]
        trust, distrust = t, d
    return trust, distrust


PAGES = [
    (1, "http://A.net/x", '<a href="http://b.com/">b</a> <a href="/own">o</a>'), (2, "https://c.com/p", '<a class=x href=//a.net/z>k</a><a href="https://d.org/fr/">'),
    (3, "http://d.org/fr/?q", '<A HREF = "http://E.com#x">'), (4, None, None), (5, "nourl", ""), (6, "http://e.com?x://y", '<a href="http://f.com">f'),
    (7, "http://www.example.net/en/7", '<a href="http://c.com">'), (8, "http://www.example.net/de/7", None), (9, "http://example.com/de/", ""),
    (10, "http://notexample.com/de/", ""), (11, "x://org/fr/1", ""), (12, "http://f.com/", ""), (13, "http://net", ""), (3, "http://d.org/fr/?q", '<A HREF = "http://E.com#x">'),
]


def test_trust_is_brute_force(spark):
    df = spark.createDataFrame(PAGES, "page_id int, url string, html string").withColumn("verdict", F.lit("clash"))
    rows = {r["page_id"]: r for r in urlfilter.judge(df).collect()}
    rule = {1: "net/", 3: "org/fr/", 7: "example.net/en/", 8: "net/", 9: "example.com/de/", 11: "org/fr/"}
    assert {k: r["rule"] for k, r in rows.items() if r["rule"]} == rule
    assert (rows[1]["host"], rows[1]["path"], rows[4]["host"], rows[5]["path"], rows[6]["path"], rows[13]["path"]) == ("a.net", "/x", "", "", "", "")
    edges = {("a.net", "b.com"): 1, ("c.com", "a.net"): 1, ("c.com", "d.org"): 1, ("d.org", "e.com"): 2, ("e.com", "f.com"): 1, ("www.example.net", "c.com"): 1}
    good = {"d.org": 2, "www.example.net": 1, "org": 1}
    bad = {"a.net": 1, "www.example.net": 1, "example.com": 1}
    trust, distrust = brute_trust(edges, good, bad)
    for r in rows.values():
        assert (r["trust"], r["distrust"]) == pytest.approx((trust.get(r["host"], 0), distrust.get(r["host"], 0)), abs=1e-12)
        said = "block" if r["distrust"] > 0 and r["distrust"] >= 0.5 * (r["trust"] + r["distrust"]) else "allow"
        assert r["verdict"] == ({"net/": "block", "example.com/de/": "block"}.get(r["rule"], "allow") if r["rule"] else said)
    assert urlfilter.judge(df).count() == len(PAGES)
    assert urlfilter.judge(df.limit(0)).count() == 0


# --- pipeline ----------------------------------------------------------------------------------------------------
def test_stages_keep_columns_and_clean_rows(spark, documents, odd_texts, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{DIR}/{name}.parquet", tmp_path / f"{name}.parquet")
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").first()["text"]
    base = " ".join(f"b{i}" for i in range(80))
    texts = [*odd_texts, base, base.replace("b7 ", "z "), "you are an idiot and a moron", bench, "mail x.y@z.org please now", "a clean text of its own"]
    docs = documents(texts)
    docs = docs.union(docs.filter("doc_id = 15"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.schema.names == docs.schema.names
        assert dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"]: r for r in kept.collect()}
    assert kept.count() == len(left)
    assert set(left) == set(range(len(texts))) - {4, 7, 11, 12, 13}
    assert {i: left[i]["text"] for i in left if i != 14} == {i: texts[i] for i in left if i != 14}
    assert "x.y@z.org" not in left[14]["text"] and left[14]["n_chars"] == len(left[14]["text"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == set(left)


def test_run_is_the_chain_of_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DIR)) == key(docs)


ODD_NAMES = ["a.b", "a b", "a`b", "_text", "_moved", "_base", "_row", "_key", "_id", "toxicity_"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_any_column_name_and_empty_tables(spark, odd_texts, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    texts = [*odd_texts[:6], "Mr John Smith wrote from 192.168.0.1", "Mr John Smith wrote from 192.168.0.2 and 10.0.0.7"]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.IntegerType()),
              *[T.StructField(c, T.StringType()) for c in ODD_NAMES]]
    rows = [(10**9 + i, t, 1, *ODD_NAMES) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, T.StructType(fields))
    out = stage(spark, docs, DIR)
    if name == "packing":
        assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
    else:
        assert out.columns == docs.columns
        got = out.collect()
        assert all([r[c] for c in ODD_NAMES] == ODD_NAMES for r in got) and {r["doc_id"] for r in got} <= {r[0] for r in rows}
        assert len(got) == len(rows) - (name == "near_dedup")  # the two texts "one" are copies
    none = stage(spark, docs.limit(0), DIR)
    assert none.columns == out.columns and none.count() == 0


def test_moved_entities_beside_odd_column_names(spark, monkeypatch):
    """Surrogates that are real values move on, whatever the other columns are called."""
    key = "k"
    first = pii.anonymise(spark.createDataFrame([(1, "from 192.168.0.1")], "doc_id long, text string"), key).first()["text"]
    rows = [(1, "from 192.168.0.1", *ODD_NAMES), (2, first, *ODD_NAMES)]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ODD_NAMES]]
    out = pii.anonymise(spark.createDataFrame(rows, T.StructType(fields)), key)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "text", *ODD_NAMES, "_entities"]
    assert len({got[1]["text"], got[2]["text"], *(r[1] for r in rows)}) == 4
    assert [got[1][c] for c in ODD_NAMES] == ODD_NAMES

"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, colon or quote, other, sentence end). Five transducers are
composed into one automaton: negation marks what follows a negator, targets mark what is aimed at someone (a second run of the same
transducer over the reversed clause marks what stands before its target), reported speech marks the rest of its sentence, also past a
colon or an opening quote, and the insult and threat transducers turn marked symbols into clause classes: insults aimed, plain, reported
or negated, threats plain, reported or negated. A threat without a target has no class. A document's features are the weights of its
strongest clause and of every class; two logistic functions, one over insults and one over threats, are joined as independent causes.
Their weights are learned, shrunk towards ``PRIOR``, which stands for classes that no labelled row shows.

Insults are learned by sequential covering: word beginnings and whole words whose share of toxic documents is too high for chance,
weighted by their log odds and added to a fixed list; weaker forms are only looked for in toxic documents that stronger ones do not
reach. A beginning needs several different words behind it, none of which holds half of its toxic documents: "path" is no insult because
"pathetic" is one. The longest known form of a word decides. All is fitted on at most ``SAMPLE`` labelled rows, whole texts; rows with
crc32(doc_id) mod 5 = 0 are never learned from.

Null and empty texts score as a text without matched clauses. Texts of any length are read whole. Repeated rows score alike; in training,
rows equal in doc_id and label count once (the smallest text). Ties between forms are broken by kind and form. An input column named
``toxicity`` is replaced, others pass through under any name. Empty tables give empty results; without both labels the fixed lists and
weights are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from talkframe.llm.common import column_bytes, numbered, settle

SAMPLE = 20_000  # labelled rows learned from at most, by a hash of their id
TAME = 5  # documents of a form that is taken for harmless
HELD = 2_000_000  # characters of forms a task counts before it hands them on
FORMS = 4_000  # learned forms at most, the most telling first
STRONG = (4.0, 3.0, 2.0)  # log odds of an insult, toxic against clean documents: weaker ones only for what stronger ones leave unexplained
SHORT, LONG = 4, 9  # characters of a word beginning
VARIETY = 4  # different words of toxic documents behind a word beginning, at least
FOLDS = 5

# --- fixed values: function words and a seed list of insults -----------------------------------------------------
INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting dumbass bastard imbecile vermin"
THREATS = "kill hurt destroy punch strangle töten umbringen schlagen tuer frapper détruire matar golpear destruir"
TARGETS = "you your yourself u he she they du dich dir ihr euch tu te toi vous tú ti usted ustedes vos"
NEGATORS = "not no never isn't aren't don't didn't nicht kein keine nie pas jamais aucun no nunca ningún"
REPORTERS = "said says wrote claims quoted told sagte schrieb behauptet dit écrit raconte dijo escribió afirma"
NEGATION_REACH, TARGET_REACH = 3, 4
THREAT_WEIGHT, SEED_WEIGHT = 2.0, 3.0
# -----------------------------------------------------------------------------------------------------------------
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n\"“”„«»]")
END, QUOTE = set(".!?;\n"), set(":\"“”„«»")
GAP = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic letter transducer. ``step`` maps (state, symbol) to (state, symbol out); a symbol is a letter and marks."""

    start: int
    states: tuple
    step: object

    def compose(self, after: Transducer) -> Transducer:
        """Feed the output of this transducer to ``after``; states are pairs, numbered as they are reached."""
        first, second = self, after
        pairs = [(first.start, second.start)]
        at = {pairs[0]: 0}
        table: dict[tuple[int, str], tuple[int, str]] = {}
        for n, (p, q) in enumerate(pairs):
            for symbol in ALPHABET:
                p2, mid = first.step(p, symbol)
                q2, out = second.step(q, mid)
                if (p2, q2) not in at:
                    at[p2, q2] = len(pairs)
                    pairs.append((p2, q2))
                table[n, symbol] = at[p2, q2], out
        return Transducer(0, tuple(range(len(pairs))), lambda state, symbol: table[state, symbol])


INSULT, THREAT, TARGET, NEGATION, REPORT, SPEECH, OTHER, STOP = LETTERS = "ITYNR:o|"
ALPHABET = [*LETTERS, INSULT + "!", THREAT + "!"]  # the last two: marked by the run over the reversed clause
CLASSES = ("aimed", "plain", "reported", "negated", "threat", "threat reported", "threat negated")
SCALE = dict(zip(CLASSES, (1.5, 1.0, 0.4, 0.25, 1.0, 0.4, 0.25)))  # what a mark leaves of a weight, in the strongest clause


def marked(symbol: str, mark: str, when: bool) -> str:
    return symbol + mark if when and symbol[0] in INSULT + THREAT and mark not in symbol else symbol


def negation() -> Transducer:
    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol[0] in STOP + SPEECH:
            return 0, symbol
        if symbol[0] == NEGATION:
            return NEGATION_REACH, symbol
        return max(0, left - 1), marked(symbol, "~", left > 0)
    return Transducer(0, tuple(range(NEGATION_REACH + 1)), step)


def targets() -> Transducer:
    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol[0] in STOP + SPEECH:
            return 0, symbol
        if symbol[0] == TARGET:
            return TARGET_REACH, symbol
        return max(0, left - 1), marked(symbol, "!", left > 0)
    return Transducer(0, tuple(range(TARGET_REACH + 1)), step)


def reported() -> Transducer:
    def step(inside: int, symbol: str) -> tuple[int, str]:
        if symbol[0] == STOP:
            return 0, symbol
        if symbol[0] == REPORT:
            return 1, symbol
        return inside, marked(symbol, '"', inside > 0)
    return Transducer(0, (0, 1), step)


def insults() -> Transducer:
    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol[0] != INSULT:
            return 0, symbol
        return 0, "negated" if "~" in symbol else "reported" if '"' in symbol else "aimed" if "!" in symbol else "plain"
    return Transducer(0, (0,), step)


def threats() -> Transducer:
    def step(state: int, symbol: str) -> tuple[int, str]:
        if symbol[0] != THREAT:
            return 0, symbol
        return 0, OTHER if "!" not in symbol else "threat" + (" negated" if "~" in symbol else " reported" if '"' in symbol else "")
    return Transducer(0, (0,), step)


AHEAD = targets()
GRAMMAR = negation().compose(targets()).compose(reported()).compose(insults()).compose(threats())
FEATURES = ("top", *CLASSES)
#: Weights of a model without evidence: intercept and weights of the strongest insult clause and of log1p of each insult class's total;
#: intercept and weight of log1p of the threats' scaled total.
PRIOR = ((-4.0, 1.2, 0.8, 0.8, 0.2, 0.0), (-1.5, 2.5))


@dataclass
class Model:
    """Learned word beginnings and whole words with their weights (0: known to be harmless), and the logistic weights of insults and of
    threats."""

    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)
    weights: tuple[tuple[float, ...], tuple[float, ...]] = PRIOR


class Lexicon:
    def __init__(self, model: Model):
        self.stems, self.words = model.stems, dict(model.words)
        for w in INSULTS.split():
            self.words.setdefault(w, SEED_WEIGHT)
        self.roles = {w: letter for letter, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATORS), (REPORT, REPORTERS)) for w in ws.split()}
        self.quick = ahocorasick.Automaton()
        for s in (s for s, weight in self.stems.items() if weight):
            self.quick.add_word(" " + s, 1)
        for w in [*(w for w, weight in self.words.items() if weight), *THREATS.split()]:
            self.quick.add_word(f" {w} ", 1)
        self.quick.make_automaton()

    def possible(self, low: str) -> bool:
        """Whether any insult or threat occurs at all."""
        return next(self.quick.iter(f" {GAP.sub(' ', low)} "), None) is not None

    def symbol(self, token: str) -> tuple[str, float]:
        if token in END:
            return STOP, 0.0
        if token in QUOTE:
            return SPEECH, 0.0
        best = self.words.get(token)
        if best is None:
            best = next((self.stems[token[:n]] for n in range(min(LONG, len(token)), SHORT - 1, -1) if token[:n] in self.stems), 0.0)
        if best:
            return INSULT, best
        role = self.roles.get(token, OTHER)
        return role, THREAT_WEIGHT if role == THREAT else 0.0

    def clauses(self, low: str) -> list[dict[str, float]]:
        """Weight of every class in each clause with a match."""
        out, state, clause = [], GRAMMAR.start, []
        for token in [*TOKEN.findall(low), "."]:
            symbol, weight = self.symbol(token)
            clause.append((symbol, weight))
            if symbol not in STOP + SPEECH:
                continue
            if any(w for _, w in clause):
                ahead, seen = AHEAD.start, []
                for letter, _ in reversed(clause):
                    ahead, letter = AHEAD.step(ahead, letter)
                    seen.append(letter)
                found: dict[str, float] = {}
                for letter, (_, w) in zip(reversed(seen), clause):
                    state, kind = GRAMMAR.step(state, letter)
                    if kind in SCALE:
                        found[kind] = found.get(kind, 0.0) + w
                if found:
                    out.append(found)
            else:
                for letter, _ in clause:
                    state, _ = GRAMMAR.step(state, letter)
            clause = []
        return out


def clause_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """``FEATURES`` of every text: the scaled weight of its strongest insult clause, and the total weight of every class."""
    data, offsets = column_bytes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for r in range(len(texts)):
        low = data[offsets[r]:offsets[r + 1]].tobytes().decode().lower()
        if lexicon.possible(low):
            for found in lexicon.clauses(low):
                out[r, 0] = max(out[r, 0], sum(w * SCALE[k] for k, w in found.items() if not k.startswith("threat")))
                for kind, w in found.items():
                    out[r, FEATURES.index(kind)] += w
    return out


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the insult and the threat function see of ``FEATURES``."""
    scale = np.array([SCALE[k] for k in CLASSES[4:]])
    return np.column_stack([x[:, :1], np.log1p(x[:, 1:5])]), np.log1p(x[:, 5:] @ scale)[:, None]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probability(x: np.ndarray, weights: tuple[tuple[float, ...], tuple[float, ...]]) -> np.ndarray:
    """Insults and threats as independent causes; without an aimed threat only insults count."""
    insult, threat = _parts(x)
    p, q = (_sigmoid(w[0] + part @ np.array(w[1:])) for w, part in zip(weights, (insult, threat)))
    return 1 - (1 - p) * (1 - np.where(threat[:, 0] > 0, q, 0.0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold, settled."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    # at most ``sample`` rows of two numbers: small enough to broadcast by construction
    rows = settle(docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), "training")
    if not rows.groupBy("doc_id", "toxic").count().filter("count > 1").isEmpty():
        rows = settle(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "training")
    return rows.select("text", "toxic")


def _form_counts(train: DataFrame, explained: Lexicon | None) -> DataFrame:
    """(kind, form, toxic, clean): documents with each word beginning (kind 0) and each whole word (kind 1), and all (kind 2). Toxic
    documents in which ``explained`` finds something are left out."""
    def rows_of(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
        forms = sorted(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in forms], pa.int32()), pa.array([f for _, f in forms], pa.string()),
             pa.array([counts[1][f] for f in forms], pa.int64()), pa.array([counts[0][f] for f in forms], pa.int64())],
            names=["kind", "form", "toxic", "clean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = (Counter(), Counter()), 0
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                low = (text or "").lower()
                if y and explained and explained.possible(low):
                    continue
                words = set(GAP.sub(" ", low).split())
                forms = {(0, w[:n]) for w in words for n in range(SHORT, min(LONG, len(w) - 1) + 1)} | {(1, w) for w in words}
                counts[y].update(forms | {(2, "")})
                held += sum(len(f) for _, f in forms)
                if held > HELD:  # partial counts go on to the aggregate
                    yield rows_of(counts)
                    counts, held = (Counter(), Counter()), 0
        yield rows_of(counts)

    rows = train.mapInArrow(run, "kind int, form string, toxic long, clean long")
    return rows.groupBy("kind", "form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _cover(train: DataFrame, model: Model, strong: float, forms: int) -> bool:
    """Add the forms of one strength to ``model``. False when there is nothing left to explain."""
    counts = settle(_form_counts(train, Lexicon(model) if model.stems or model.words else None), "forms")
    total = counts.filter("kind = 2").first()
    if not total or not total["toxic"] or not total["clean"]:
        return False
    bad, good = total["toxic"], total["clean"]
    base = bad / (bad + good)
    n = F.col("toxic") + F.col("clean")
    odds = F.log((F.col("toxic") + 0.5) * (good + 1) / ((F.col("clean") + 0.5) * (bad + 1)))
    # log-likelihood ratio against the base rate: how far from chance the form's share is
    above = F.col("toxic") * F.log(F.greatest(F.col("toxic") / n, F.lit(1e-9)) / base) + F.col("clean") * F.log(
        F.greatest(F.col("clean") / n, F.lit(1e-9)) / (1 - base))
    limit = math.log(max(2, counts.count())) + 1  # fewer than one form of all is expected to get there by chance
    counts = counts.filter("kind < 2").withColumns({"odds": odds, "above": above})
    heads = [F.substring("form", 1, i) for i in range(SHORT, LONG + 1)]
    likely = counts.filter((F.col("odds") >= strong) & (F.col("above") >= limit))
    behind = counts.filter((F.col("kind") == 1) & (F.col("toxic") > 0)).select(
        F.explode(F.array(*heads)).alias("head"), "form", F.col("toxic").alias("docs")).filter("length(form) > length(head)")
    behind = behind.groupBy("head").agg(F.count("*").alias("words"), F.max("docs").alias("most"))
    spread = F.col("kind").eqNullSafe(1) | ((F.col("words") >= VARIETY) & (2 * F.col("most") < F.col("toxic")))
    likely = likely.join(behind, (likely["form"] == behind["head"]) & (likely["kind"] == 0), "left").filter(spread)
    found = likely.orderBy(F.desc("above"), "kind", "form").limit(forms).collect()
    for row in found:
        (model.words if row["kind"] else model.stems).setdefault(row["form"], float(row["odds"]))
    begins = sorted(row["form"] for row in found if not row["kind"])
    if begins:  # longer forms of these beginnings that are seen often enough and are not insults
        inside = F.arrays_overlap(F.array(*heads), F.array(*[F.lit(x) for x in begins]))
        tame = counts.filter((F.col("odds") < strong) & (n >= TAME) & inside).orderBy(F.desc(n), "kind", "form").limit(forms).collect()
        for row in tame:
            (model.words if row["kind"] else model.stems).setdefault(row["form"], 0.0)
    return True


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, forms: int = FORMS) -> Model:
    """Forms and logistic weights from a bounded sample. Without both classes the fixed list and weights are used."""
    train = _training(docs, labels, sample)
    model = Model()
    for strong in STRONG:
        if not _cover(train, model, strong, forms):
            break
    if train.select("toxic").distinct().count() < 2:
        return model
    lexicon = Lexicon(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = clause_features(batch.column("text"), lexicon)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column("toxic")], names=[f"x{i}" for i in range(x.shape[1])] + ["toxic"])

    seen = train.mapInArrow(run, ", ".join(f"x{i} double" for i in range(len(FEATURES))) + ", toxic int").toPandas()  # bounded by ``sample``
    x, y = seen.drop(columns="toxic").to_numpy(), seen["toxic"].to_numpy()
    insult, threat = _parts(x)
    some = threat[:, 0] > 0
    model.weights = _ordered(insult, y, PRIOR[0]), _logistic(threat[some], y[some], PRIOR[1])
    return model


def _ordered(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...]) -> tuple[float, ...]:
    """Weights of insults in which no class counts more than one before it in ``CLASSES``: neighbours that the rows would order the
    other way share one weight."""
    groups = [[i] for i in range(x.shape[1])]  # the first is the strongest clause, not a class
    while True:
        at = np.zeros((x.shape[1], len(groups)))
        for g, members in enumerate(groups):
            at[members, g] = 1
        centre = (prior[0], *(np.mean([prior[1 + i] for i in members]) for members in groups))
        w = _logistic(x @ at, y, centre)
        wrong = next((g for g in range(1, len(groups) - 1) if w[g + 2] > w[g + 1]), None)
        if wrong is None:
            return (w[0], *map(float, at @ np.array(w[1:])))
        groups[wrong:wrong + 2] = [groups[wrong] + groups[wrong + 1]]


def _logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...], ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps; a quadratic penalty draws the weights to ``prior`` (its intercept stands without rows). A
    step that does not lower the loss is halved."""
    centre = np.array(prior)
    z, b = np.column_stack([np.ones(len(x)), x]), centre.copy()
    penalty = np.diag([0.1, *[ridge] * x.shape[1]])

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(np.sum(np.logaddexp(0, m) - y * m) + (w - centre) @ penalty @ (w - centre) / 2)

    for _ in range(100):
        p = _sigmoid(z @ b)
        step = np.linalg.solve(z.T * (p * (1 - p)) @ z + penalty, z.T @ (y - p) - penalty @ (b - centre))
        while np.abs(step).max() > 1e-9 and loss(b + step) > loss(b) + 1e-9:
            step /= 2
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), replacing a column of that name. Only ``text`` is looked at; empty and null texts get the score
    of a text without matched clauses. Rows are independent; an empty table gives an empty result."""
    docs = docs.drop("toxicity")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model)
        for batch in batches:
            p = probability(clause_features(batch.column("text"), lexicon), model.weights)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*schema.names, "toxicity"])

    return numbered(docs, "text").mapInArrow(run, StructType([*schema.fields, StructField("toxicity", DoubleType())]))

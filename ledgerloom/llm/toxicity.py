"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the classes of a clause's words: insult (an insult right
after another weighs more), threat (stronger after a first person or a modal), target
(an address near the match), negation (a match shortly after a negation counts less)
and reported speech (a match after a reporting verb counts less). They are composed
into one machine whose arcs carry a factor and an addend; a clause's score is the sum
over its matches of the word's weight times the factor.

The lexicon is a small fixed one, plus words and word beginnings learned from labelled
rows, with log-odds weights. A logistic curve over a text's largest clause score and
the sum of all turns scores into probabilities. Only texts are read to score; labels
are used to learn, from a stated fold and a sample of at most ``LABELLED`` rows.

Texts are searched for lexicon entries with an Aho-Corasick automaton; only clauses
with a match run through the machine, whole and once, in time linear in their length.
Nothing is shuffled to score.

Defined results: null and empty texts get the curve's lowest value; rows without an id
are scored like others and count as not held out; repeated labels of an id count by
their largest value; without labels the fixed lexicon and curve are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free

#: Labelled rows that are learned from, at most.
LABELLED = 40_000
#: Learned entries: rows with label 1 that hold it, and their share among all rows that do.
LEAST_ROWS, LEAST_SHARE = 5, 0.95
#: And, of all rows with label 1, this share: words of a few copied texts stay out.
LEAST_OF_TOXIC = 0.004
#: The curve without labels: constant, largest clause score, logarithm of the sum.
CURVE = (-4.0, 1.5, 0.5)
BEGINNINGS = range(4, 8)
#: Kinds of words before a learned entry, at least.
LEAST_CONTEXTS = 4

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SELF = range(7)
#: Word lists in English, German, French and Spanish.
WORDS = {
    INSULT: "idiot idiots moron morons loser losers scum clown clowns trash stupid pathetic worthless disgusting dumb fool imbecile "
    "dummkopf abschaum versager widerlich dumm imbécile débile ordure minable dégoûtant imbécil estúpido estúpida basura asqueroso patético",
    THREAT: "kill hurt destroy beat stab shoot burn töten umbringen schlagen zerstören tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u he she they him her them these those du dich dir ihr euch sie tu toi te vous votre tú usted ustedes vosotros",
    NEGATION: "not no never neither nor without isn't aren't wasn't don't nicht nie kein keine pas jamais aucun nunca jamás ni sin",
    REPORT: "said says say wrote writes called calls quoted quote claimed claims reported sagte schrieb nannte dit écrit appelé dijo escribió llamó",
    SELF: "i i'll we we'll will gonna shall ich wir werde je nous vais yo nosotros voy",
}
SCHEMA = "doc_id long, clause_max double, clause_sum double"
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?")
_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"[.!?;:\n]")

Step = tuple[int, float, float]


def _window(trigger: int, reach: int, factor: float) -> dict[tuple[int, int], Step]:
    """A match within ``reach`` words after a trigger gets a factor."""
    arcs = {}
    for state in range(reach + 1):
        for kind in range(7):
            hit = factor if state and kind in (INSULT, THREAT) else 1.0
            arcs[state, kind] = (reach if kind == trigger else max(state - 1, 0), hit, 0.0)
    return arcs


def _target() -> dict[tuple[int, int], Step]:
    """An address up to three words before a match, or two after it. States: 0-3 since an address, 4-5 since a match."""
    arcs = {}
    for state in range(6):
        for kind in range(7):
            if kind in (INSULT, THREAT):
                arcs[state, kind] = (5, 1.5 if 1 <= state <= 3 else 1.0, 0.0)
            elif kind == TARGET:
                arcs[state, kind] = (3, 1.0, 0.5 if state >= 4 else 0.0)
            else:
                arcs[state, kind] = ({5: 4, 4: 0, 3: 2, 2: 1}.get(state, 0), 1.0, 0.0)
    return arcs


def _insult() -> dict[tuple[int, int], Step]:
    return {(s, k): (int(k == INSULT), 1.2 if s and k == INSULT else 1.0, 0.0) for s in (0, 1) for k in range(7)}


def _threat() -> dict[tuple[int, int], Step]:
    """A threatening verb is one only after a first person or a modal in its clause."""
    return {(s, k): (int(s or k == SELF), (1.5 if s else 0.2) if k == THREAT else 1.0, 0.0) for s in (0, 1) for k in range(7)}


def _reported() -> dict[tuple[int, int], Step]:
    return {(s, k): (int(s or k == REPORT), 0.5 if s and k in (INSULT, THREAT) else 1.0, 0.0) for s in (0, 1) for k in range(7)}


def compose(*machines: dict[tuple[int, int], Step]) -> list[list[Step]]:
    """The product machine, reached from all start states 0: by state and class, the next state, factor and addend."""
    number, todo, arcs = {(0,) * len(machines): 0}, [(0,) * len(machines)], []
    while todo:
        state = todo.pop(0)
        row = []
        for kind in range(7):
            steps = [m[s, kind] for m, s in zip(machines, state)]
            after = tuple(s[0] for s in steps)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append((number[after], math.prod(s[1] for s in steps), sum(s[2] for s in steps)))
        arcs.append(row)
    return arcs


class Grammar:
    """The composed machine with a lexicon: words and beginnings (ending in ``*``) to weights."""

    def __init__(self, weights: dict[str, float]):
        self.machine = compose(_insult(), _threat(), _target(), _window(NEGATION, 3, 0.25), _reported())
        self.kind = {w: k for k, words in WORDS.items() for w in words.split()}
        self.weight = dict(weights)
        self.sizes = sorted({len(w) - 1 for w in weights if w.endswith("*")})
        self.find = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in [*(x.rstrip("*") for x in weights), *(x for x, k in self.kind.items() if k in (INSULT, THREAT))]:
            self.find.add_word(w)
        self.find.make_automaton()

    def classify(self, word: str) -> tuple[int, float]:
        kind = self.kind.get(word, OTHER)
        weight = self.weight.get(word)
        if weight is None:
            for n in self.sizes:
                if n > len(word):
                    break
                weight = self.weight.get(word[:n] + "*")
                if weight is not None:
                    break
        if weight is not None:
            return (THREAT if kind == THREAT else INSULT), weight
        return kind, 1.0

    def clause(self, text: str) -> float:
        state = total = 0
        for word in map(re.Match.group, _TOKEN.finditer(text)):
            kind, weight = self.classify(word)
            state, factor, more = self.machine[state][kind]
            total += more
            if kind in (INSULT, THREAT):
                total += weight * factor
        return total

    def score(self, text: str) -> tuple[float, float]:
        """The largest clause score, and the sum of all. Each clause with a match is read once, from its first to its last word."""
        text = text.lower()
        most = total = 0.0
        done = 0  # all clauses before this place are scored
        for end, size in self.find.iter(text):
            start = end - size + 1
            if start < done or (start and text[start - 1].isalnum()):
                continue
            begin = max(text.rfind(c, done, start) for c in ".!?;:\n") + 1 or done
            stop = _BREAK.search(text, end)
            done = stop.start() if stop else len(text)
            value = self.clause(text[begin:done])
            most = max(most, value)
            total += value
        return most, total


def _features(text: str) -> dict[str, int]:
    """A text's words and beginnings, each with a bit for every kind of word before it."""
    out: dict[str, int] = {}
    before = ""
    for word in _WORD.findall(text.lower()):
        if len(word) >= 4:
            bit = 1 << crc32(before.encode()) % 62
            out[word] = out.get(word, 0) | bit
            for n in BEGINNINGS:
                if n <= len(word):
                    out[word[:n] + "*"] = out.get(word[:n] + "*", 0) | bit
        before = word
    return out


def _count_toxic(batches):
    """Rows with each entry, and the words that stand before it."""
    held: dict[str, list[int]] = {}
    for batch in batches:
        for text in batch["text"].to_pylist():
            for entry, bits in _features(text or "").items():
                mine = held.setdefault(entry, [0, 0])
                mine[0] += 1
                mine[1] |= bits
    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["entry", "n", "bits"])


def _count_clean(entries: set[str]):
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                words = set(_WORD.findall((text or "").lower()))
                held.update(entries.intersection(words | {w[:n] + "*" for w in words for n in BEGINNINGS if n <= len(w)}))
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["entry", "n"])

    return run


def _learn_entries(sample: DataFrame) -> dict[str, float]:
    """Log-odds weights of words and beginnings, from rows (text, label).

    Entries come from rows with label 1, after different words: those of a text that
    was copied often always follow the same word, and are left out.
    """
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return {}
    by = sample.filter("label = 1").select("text").mapInArrow(_count_toxic, "entry string, n long, bits long").groupBy("entry").agg(F.sum("n").alias("a"), F.expr("bit_count(bit_or(bits))").alias("contexts"))
    by = by.filter((F.col("a") >= max(LEAST_ROWS, LEAST_OF_TOXIC * toxic)) & (F.col("contexts") >= LEAST_CONTEXTS))
    # each entry is held by a share LEAST_OF_TOXIC of the sampled rows: at most 1 / LEAST_OF_TOXIC times the entries of an average row
    held = {r["entry"]: r["a"] for r in by.collect()}
    other = sample.filter("label = 0").select("text").mapInArrow(_count_clean(set(held)), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("b"))
    others = {r["entry"]: r["b"] for r in other.collect()}
    found: dict[str, float] = {}
    for entry in sorted(held, key=lambda e: (len(e.rstrip("*")), e)):
        a, b, word = held[entry], others.get(entry, 0), entry.rstrip("*")
        if a < LEAST_SHARE * (a + b) or any(word[:n] + "*" in found for n in BEGINNINGS if n <= len(word)):
            continue
        found[entry] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    return found


def _fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by damped Newton steps, pulled slightly towards the fixed curve so that separable labels give a finite one."""
    base = np.array(CURVE)
    design, beta = np.column_stack([np.ones(len(x)), x]), base.copy()

    def loss(b):
        z = design @ b
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum((b - base) ** 2)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        grad = design.T @ (p - y) + (beta - base)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(3), grad)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > loss(beta):
            size /= 2
        beta = beta - size * step
        if abs(size * step).max() < 1e-7:
            break
    return beta


def _curve_input(most: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.minimum(most, 10.0), np.log1p(np.maximum(total, 0))])


def fold(id_column: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids give null."""
    return F.crc32(id_column.cast("string").cast("binary")) % modulus


def learn(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", held_out: int = 0) -> tuple[dict[str, float], list[float]]:
    """Lexicon weights and curve from labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).dropna().filter(fold(F.col("doc_id")) != held_out)
    known = known.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    n = known.count()
    if n > LABELLED:
        # a share that gives at most LABELLED rows, but for less than one case in a million
        share = (LABELLED - 5 * LABELLED**0.5) / n
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).join(F.broadcast(known), "doc_id").select("doc_id", "text", "label")
    seeds = {w: 4.0 for w in WORDS[INSULT].split()} | {w: 2.0 for w in WORDS[THREAT].split()}
    weights = seeds | _learn_entries(sample)
    scored = clause_scores(sample, weights, extra="label").toArrow()  # at most LABELLED rows of three numbers
    x, y = _curve_input(scored["clause_max"].to_numpy(), scored["clause_sum"].to_numpy()), scored["label"].to_numpy().astype(float)
    return weights, (_fit_curve(x, y) if len(y) else np.array(CURVE)).tolist()


def clause_scores(docs: DataFrame, weights: dict[str, float], extra: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its largest clause score and the sum of all."""
    made: dict = {}

    def run(batches):
        if not made:
            made["grammar"] = Grammar(weights)
        score = made["grammar"].score
        for batch in batches:
            got = [score(t) if t else (0.0, 0.0) for t in batch["text"].to_pylist()]
            out = [batch["doc_id"], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64())]
            names = ["doc_id", "clause_max", "clause_sum"]
            if extra:
                out.append(batch[extra])
                names.append(extra)
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.mapInArrow(run, SCHEMA + (f", {extra} int" if extra else ""))


def _score(most: Column, total: Column, curve: list[float]) -> Column:
    z = F.lit(curve[0]) + F.least(most, F.lit(10.0)) * curve[1] + F.log1p(F.greatest(total, F.lit(0.0))) * curve[2]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each row of ``docs``: doc_id, held_out, score, predicted."""
    weights, curve = learn(docs, labels, id_column, text_column)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return clause_scores(rows, weights).select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        _score(F.col("clause_max"), F.col("clause_sum"), curve).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay as they are. The text is scored by a pandas UDF on the side."""
    weights, curve = learn(labelled_docs, labels)
    made: dict = {}

    @F.pandas_udf("struct<clause_max double, clause_sum double>")
    def clauses(texts):
        import pandas as pd

        if not made:
            made["grammar"] = Grammar(weights)
        return pd.DataFrame([made["grammar"].score(t) if t else (0.0, 0.0) for t in texts], columns=["clause_max", "clause_sum"])

    clauses = clauses.asNondeterministic()  # so that it runs once
    mark, = free(docs, "clauses_")
    marked = docs.withColumn(mark, clauses(F.col(text_column)))
    return marked.filter(_score(F.col(f"{mark}.clause_max"), F.col(f"{mark}.clause_sum"), curve) < 0.5).drop(mark)

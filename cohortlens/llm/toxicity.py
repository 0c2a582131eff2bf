"""Toxicity by a weighted finite-state grammar of clauses.

Words become classes (insult, threat, target, negation, reported speech).  Four
transducers read the classes of a clause: the first guesses whether the clause
has a target and accepts where the guess was right, so that it marks aimed
insults and threats; the second turns marks in the reach of a negation; the third
turns marks inside reported speech; the last gives each mark that is left its
feature.  They are composed into one machine, whose arcs carry the weights.  So
matched clauses are scored, not words: the weight of a lone insult in a document,
without target, threat or a second one, is held below every usual threshold.

The insult lexicon has fixed words and units (words and beginnings of words)
learned from labelled rows: those that stand in many toxic documents and hardly
ever in others (a doubtful beginning counts where two words of a text have it), chosen one after another by what they newly explain, so
that a group of copies does not bring in its whole vocabulary.  The weights of
the features come from a ridge regression on the same rows towards stated
priors.  At most MAX_ROWS labelled rows are used, chosen by hash.

Contract.  Null and empty texts match nothing and score as such.  Labels, lang
and source are no inputs of a score; doc_id decides held_out alone (null: not
held out, not learned from).  A document with several labels counts by its
largest.  Equal rows get equal rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import discard, written
from ._text import slices

#: Labelled rows that are learned from.
MAX_ROWS = 16_000
#: A learned unit: beginnings of words so long, in so many labelled documents, so surely.
PREFIXES, LEAST_DOCS, LEAST_GAIN, SURE = (3, 4, 5, 6, 7), 5, 3, 0.97
#: As SURE, of beginnings that two words of a document have.
SURE_TWICE = 0.85
#: Units that are on the driver at a time; the choice is among all.
MAX_UNITS = 2_000

#: Words of the grammar.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool dumme dummkopf trottel arschloch abschaum imbécile connard débile ordure idiota estúpido imbécil basura escoria".split()
THREATS = "kill hurt destroy crush punish beat töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your he she they them him her his their du dich dir ihr euch sie er tu toi vous il elle ils elles tú usted ustedes él ella ellos ellas".split()
NEGATIONS = "not no never nobody isn't aren't don't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says claimed wrote called quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words that a negation reaches over.
REACH = 3
#: What the composed machine's arcs are marked with.
MARKS = ("insult", "aimed", "threat", "negated", "told")
FEATURES = ("lone", "several", "again", "aimed", "threat", "negated", "told", "density", "hint")
#: Priors of the weights: bias first.
PRIOR = np.array([-4.0, 2.0, 4.0, 1.0, 4.0, 4.0, 0.5, 0.5, 0.5, 1.0])
#: Log odds that a lone insult may reach: 0.25.
LONE_AT_MOST = -1.1
#: The class of a clause's end; classes of words from DOUBTFUL on are doubtful beginnings, by number.
CLAUSE_END, DOUBTFUL = 9, 100
RIDGE = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Transducer:
    """Arcs {(state, symbol): (state, symbol)}, start states and final states; it may guess, but one path at most accepts."""

    def __init__(self, arcs: dict, starts: set, finals: set):
        self.arcs, self.starts, self.finals = arcs, starts, finals

    def after(self, other: Transducer) -> Transducer:
        """The composition that reads what other writes; only states that can be reached."""
        starts = {(x, y) for x in other.starts for y in self.starts}
        symbols = {symbol for _, symbol in other.arcs}
        arcs, todo, seen = {}, list(starts), set(starts)
        while todo:
            x, y = todo.pop()
            for symbol in symbols:
                if (first := other.arcs.get((x, symbol))) and (second := self.arcs.get((y, first[1]))):
                    state = (first[0], second[0])
                    arcs[(x, y), symbol] = state, second[1]
                    if state not in seen:
                        seen.add(state)
                        todo.append(state)
        return Transducer(arcs, starts, {s for s in seen if s[0] in other.finals and s[1] in self.finals})

    def numbered(self) -> Transducer:
        """The same machine with whole numbers as states."""
        number = {s: k for k, s in enumerate(sorted({*self.starts, *(x[0] for x in self.arcs), *(x[0] for x in self.arcs.values())}, key=repr))}
        return Transducer({(number[s], x): (number[t], y) for (s, x), (t, y) in self.arcs.items()}, {number[s] for s in self.starts}, {number[s] for s in self.finals if s in number})

    def read(self, symbols: list) -> list | None:
        """What the accepted path writes."""
        for state in self.starts:
            out = []
            for x in symbols:
                step = self.arcs.get((state, x))
                if step is None:
                    break
                state = step[0]
                out.append(step[1])
            else:
                if state in self.finals:
                    return out
        return None


def _aiming() -> Transducer:
    """Marks insults and threats; "none" guesses a clause without target, "ahead" one whose target is still to come."""
    arcs = {}
    for state in ("none", "ahead", "seen"):
        for c in (OTHER, NEGATION, REPORT):
            arcs[state, c] = state, c
        arcs[state, INSULT] = state, "insult" if state == "none" else "aimed"
        arcs[state, THREAT] = state, OTHER if state == "none" else "threat"
        if state != "none":
            arcs[state, TARGET] = "seen", OTHER
    return Transducer(arcs, {"none", "ahead"}, {"none", "seen"})


def _negating() -> Transducer:
    """The state is how many more words a negation reaches over."""
    arcs = {}
    for left in range(REACH + 1):
        for x in (OTHER, REPORT, *MARKS[:3]):
            arcs[left, x] = max(0, left - 1), "negated" if left and x in MARKS else x
        arcs[left, NEGATION] = REACH, OTHER
    return Transducer(arcs, {0}, set(range(REACH + 1)))


def _reporting() -> Transducer:
    """The state is whether a reporting verb came before."""
    arcs = {}
    for inside in (0, 1):
        for x in (OTHER, *MARKS[:4]):
            arcs[inside, x] = inside, "told" if inside and x in MARKS[:3] else x
        arcs[inside, REPORT] = 1, OTHER
    return Transducer(arcs, {0}, {0, 1})


def _weighing() -> Transducer:
    """Gives each mark the number of its feature."""
    return Transducer({(0, x): (0, MARKS.index(x) if x in MARKS else None) for x in (OTHER, *MARKS)}, {0}, {0})


MACHINE = _weighing().after(_reporting().after(_negating().after(_aiming()))).numbered()


def clause_features(classes: list[int], gaps: list[int]) -> np.ndarray:
    """How often the composed machine writes each of MARKS; gaps are the other words before each class."""
    symbols: list[int] = []
    for c, gap in zip(classes, gaps, strict=True):
        symbols += [OTHER] * min(gap, REACH + 1) + [c]
    out = np.zeros(len(MARKS))
    for k in MACHINE.read(symbols) or ():
        if k is not None:
            out[k] += 1
    return out


def document_features(total: np.ndarray, n_words: int, hint: bool) -> tuple:
    """FEATURES from the marks of all clauses of a document."""
    insult, aimed, threat, negated, told = total
    some = insult + aimed
    counts = some > 1 or aimed > 0
    density = np.log1p(1000 * some / max(50, n_words)) if counts else 0.0
    return (float(some == 1 and not aimed and not threat), some > 1, np.log(max(1.0, some)), aimed > 0, threat > 0, np.log1p(negated), np.log1p(told), density, hint)


class Grammar:
    """Classes of words, and features of texts."""

    def __init__(self, units: list[str] = ()):
        self.words = {w: k for k, group in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in group}
        self.words.update((u[2:], INSULT) for u in units if u[0] == "w")
        self.starts = {u[2:]: INSULT for u in units if u[0] == "p"}
        for k, u in enumerate(x for x in units if x[0] == "d"):
            self.starts.setdefault(u[2:], DOUBTFUL + k)
        self.sizes = sorted({len(x) for x in self.starts})

    def of(self, word: str) -> int:
        if (k := self.words.get(word)) is not None:
            return k
        return min((self.starts[word[:n]] for n in self.sizes if len(word) > n and word[:n] in self.starts), default=0)

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row of FEATURES per text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        # Words are runs of letters and apostrophes; one piece in between tells where a clause ends.
        lower = pc.utf8_lower(texts)
        plain = pc.replace_substring_regex(lower, r"[.!?;:\n]+", " . ")
        pieces = pc.split_pattern_regex(plain, r"[^\p{L}'.]+")
        offsets = np.asarray(pieces.offsets).astype(np.int64)
        offsets -= offsets[0]
        code = pc.dictionary_encode(pieces.flatten())
        kinds = np.array([CLAUSE_END if w == "." else self.of(w) for w in code.dictionary.to_pylist()] or [0], np.int32)
        word = code.indices.to_numpy(zero_copy_only=False)
        kind = kinds[word] if len(code) else np.zeros(0, np.int32)
        out = np.zeros((len(texts), len(FEATURES)))
        for d in np.unique(np.searchsorted(offsets, np.flatnonzero((kind == INSULT) | (kind == THREAT) | (kind >= DOUBTFUL)), "right") - 1):
            own = kind[offsets[d] : offsets[d + 1]].copy()
            hint = False
            for k in np.unique(own[own >= DOUBTFUL]):
                # A doubtful beginning counts where two different words have it, else it is a hint.
                sure = len(np.unique(word[offsets[d] : offsets[d + 1]][own == k])) > 1
                hint |= not sure
                own[own == k] = INSULT if sure else OTHER
            out[d] = document_features(_marks(own), len(own), hint)
        return out


def _marks(kinds: np.ndarray) -> np.ndarray:
    """MARKS of all clauses of a document, of which those with an insult or a threat are read."""
    ends = np.concatenate([[-1], np.flatnonzero(kinds == CLAUSE_END), [len(kinds)]])
    total = np.zeros(len(MARKS))
    for e in np.unique(np.searchsorted(ends, np.flatnonzero((kinds == INSULT) | (kinds == THREAT)))):
        at = np.flatnonzero(kinds[ends[e - 1] + 1 : ends[e]])
        gaps = np.diff(np.concatenate([[-1], at])) - 1
        total += clause_features(kinds[ends[e - 1] + 1 : ends[e]][at].tolist(), gaps.tolist())
    return total


def _units(text: Column) -> Column:
    """Distinct words of a text and their beginnings."""
    found = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    return F.transform(F.array(found), _units_of)[0]  # the words are bound, so they are split once


def _units_of(words: Column) -> Column:

    def starts_of(n: int, kind: str) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit(kind), F.substring(w, 1, n)))

    def twice(x: Column) -> Column:
        return F.filter(x, lambda y, k: F.coalesce(y == F.get(x, k + 1), F.lit(False)))

    starts = [starts_of(n, "p:") for n in PREFIXES]
    pairs = [F.transform(F.array(F.array_sort(starts_of(n, "d:"))), twice)[0] for n in PREFIXES if n > 3]
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), *starts, *pairs))


def learned_units(sample: DataFrame) -> list[str]:
    """Units that tell toxic rows of sample (text, toxic), greedily by what they newly explain.

    The driver gets at most MAX_UNITS units at a time, with at most MAX_ROWS numbers each.  Gains only
    fall, so a choice among them is that among all units while its gain is over what the others had.
    """
    rows = written(sample.select("toxic", "row_id", F.explode(_units(F.col("text"))).alias("unit")))
    good = rows.groupBy("unit").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= LEAST_DOCS).where(F.col("t") >= F.when(F.col("unit").startswith("d:"), SURE_TWICE).otherwise(SURE) * F.col("n"))
    # Most newly explained; then words before beginnings, longer beginnings first.
    rank = (F.desc("gain"), F.desc(F.expr("instr('dpw', left(unit, 1))")), F.desc(F.length("unit")), F.desc("t"), "unit")
    pairs = written(rows.where("toxic = 1").join(good.select("unit", "t"), "unit").select("unit", "t", "row_id").distinct())
    discard(rows)
    out: list[str] = []
    while True:
        best = pairs.groupBy("unit", "t").agg(F.countDistinct("row_id").alias("gain")).where(F.col("gain") >= LEAST_GAIN).orderBy(*rank).limit(MAX_UNITS + 1).collect()
        if not best:
            return out
        others = best[MAX_UNITS]["gain"] if len(best) > MAX_UNITS else 0
        best = best[:MAX_UNITS]
        names = [r["unit"] for r in best]
        chosen = pairs.where(F.col("unit").isin(names)).groupBy("unit").agg(F.collect_set("row_id").alias("ids")).collect()
        total, has = {r["unit"]: r["t"] for r in best}, {r["unit"]: set(r["ids"]) for r in chosen}
        gone: set[int] = set()
        first = True
        while has:
            key = {u: (-len(ids - gone), -"dpw".index(u[0]), -len(u), -total[u], u) for u, ids in has.items()}
            u = min(key, key=key.get)
            gain = -key[u][0]
            if not first and gain <= others:
                break
            if gain < LEAST_GAIN + 2 * (u[0] == "d"):
                return out
            out.append(u)
            gone |= has.pop(u)
            first = False
        if not others:
            return out
        spent = pairs.sparkSession.createDataFrame([(x,) for x in gone], "row_id long")
        pairs = written(pairs.join(F.broadcast(spent), "row_id", "left_anti"))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a ridge towards PRIOR, by damped Newton steps."""
    w, x = PRIOR.copy(), np.hstack([np.ones((len(x), 1)), x])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - y @ z + RIDGE / 2 * ((w - PRIOR) ** 2).sum())

    for _ in range(100):
        p = np.exp(-np.logaddexp(0, -(x @ w)))
        slope = x.T @ (p - y) + RIDGE * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * (slope @ step):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return held(w)


def held(w: np.ndarray) -> np.ndarray:
    """Weights under which a lone insult stays where it must."""
    w = w.copy()
    w[1] = min(w[1], LONE_AT_MOST - w[0])
    return w


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], np.ndarray]:
    """Units and weights from labelled rows that are not held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    share = min(1.0, max_rows / max(1, n))
    own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    text = docs.select("doc_id", "text")
    sample = written(text.join(own, "doc_id").select("text", "toxic", F.xxhash64("doc_id", "text").alias("row_id")))
    units = learned_units(sample)
    grammar = Grammar(units)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0)):
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in grammar.features(batch.column(0)[a:b]).T), batch.column(1)[a:b].cast(pa.float64())], names=[*FEATURES, "toxic"])

    schema = ", ".join(f"{c} double" for c in (*FEATURES, "toxic"))
    found = np.array([tuple(r) for r in sample.select("text", "toxic").mapInArrow(features, schema).collect()], float).reshape(-1, len(FEATURES) + 1)
    return units, fitted(found[:, :-1], found[:, -1]) if len(found) else PRIOR


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    units, weights = learn(docs, labels, max_rows)
    grammar = Grammar(units)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                z = weights[0] + grammar.features(batch.column(1)[a:b]) @ weights[1:]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

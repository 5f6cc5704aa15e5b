"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes: insult and threat words with weights, words for whoever
is addressed, negations, words of reporting.  Five weighted transducers are
composed into one machine that reads a clause's classes.  The insult and the
threat transducer (their union comes first) pick one word as the match and
pass the others on; negation and reported speech rewrite the match where it is
within their reach; the target transducer writes how the match is said and
weighs the clause, and ends a threat only where someone is addressed.  A
clause's score of each kind (meant, negated, reported) is the greatest weight
of a path through that machine.  A document's features are the greatest clause
scores and the number of matched clauses.

Insult words beyond the seeds, and stems of them, are learnt from a bounded
sample of labelled rows, and so is the logistic weight of each feature, with a
prior that trusts what is meant more than what is negated or reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize, rows_within, small
from .tokens import Words, rows_of

#: About how many labelled rows the lexicon and the weights are learnt from.
SAMPLE = 40_000
#: A learnt word or stem is in at least so many toxic rows, which are at least this share of all its rows.
LEAST_ROWS, LEAST_SHARE = 5, 0.7
THRESHOLD = 0.3

INSULTS = "idiot idiots moron morons loser losers stupid worthless pathetic scum trash clown clowns disgusting imbecile fool fools dumb garbage vermin idioten dummkopf arschloch trottel abschaum idiote imbécile connard ordure crétin idiota estúpido imbécil basura escoria".split()
THREATS = "kill killed hurt destroy murder beat stab shoot burn töten umbringen vernichten verletzen tuer détruire frapper matar destruir golpear".split()
TARGETS = "you your you're he she they them him her people du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes vosotros ellos él ella".split()
NEGATIONS = "not no never don't isn't aren't doesn't won't nicht kein keine nie niemals ne pas jamais aucun non nunca jamás ningún".split()
REPORTS = "said says say called calls wrote writes quoted quote claimed reported asked sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()

#: Letters and what is beyond ASCII, the apostrophe within words.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(97, 123), 39, *range(128, 256)]] = True
STEMS = (4, 5, 6)
#: Bytes that end a clause.
_CUT = np.zeros(256, bool)
_CUT[list(b".!?;:\n")] = True

CLASSES = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = tuple(range(6))
KINDS = MEANT, NEGATED, REPORTED = tuple(range(3))
#: What a clause's one matched word is rewritten to: its class and how it is said.
MATCHES = tuple((c, kind) for c in (INSULT, THREAT) for kind in KINDS)


@dataclass(frozen=True)
class Transducer:
    """A weighted machine that begins in state 0: ``arcs[state][symbol]`` -> (output, weight, state), ...; ``final[state]``: the weight of ending there, 0 if it may not."""

    arcs: tuple[dict, ...]
    final: tuple[float, ...]

    def union(self, other: Transducer) -> Transducer:
        """Whatever either machine reads."""

        def moved(outs: tuple, by: int) -> tuple:
            return tuple((o, w, s + by) for o, w, s in outs)

        here, there = 1, 1 + len(self.arcs)
        start = {c: moved(self.arcs[0].get(c, ()), here) + moved(other.arcs[0].get(c, ()), there) for c in self.arcs[0] | other.arcs[0]}
        rest = [{c: moved(outs, by) for c, outs in row.items()} for machine, by in ((self, here), (other, there)) for row in machine.arcs]
        return Transducer((start, *rest), (max(self.final[0], other.final[0]), *self.final, *other.final))

    def compose(self, other: Transducer) -> Transducer:
        """``other`` reads what this machine writes; weights multiply.  Only states that can be reached are kept."""
        names, arcs = {(0, 0): 0}, []
        for a, b in (order := [(0, 0)]):
            row = {}
            for symbol, outs in self.arcs[a].items():
                row[symbol] = ()
                for middle, w, a2 in outs:
                    for out, x, b2 in other.arcs[b].get(middle, ()):
                        if (a2, b2) not in names:
                            names[a2, b2] = len(names)
                            order.append((a2, b2))
                        row[symbol] += ((out, w * x, names[a2, b2]),)
            arcs.append(row)
        return Transducer(tuple(arcs), tuple(self.final[a] * other.final[b] for a, b in order))


def one_of(wanted: int, weight: float) -> Transducer:
    """Matches one word of a class, whichever; other insults and threats become plain words."""
    plain = {c: OTHER if c in (INSULT, THREAT) else c for c in CLASSES}
    before, after = ({c: ((plain[c], 1.0, s),) for c in CLASSES} for s in (0, 1))
    before[wanted] += (((wanted, MEANT), weight, 1),)
    return Transducer((before, after), (0.0, 1.0))


def insult() -> Transducer:
    return one_of(INSULT, 1.0)


def threat() -> Transducer:
    return one_of(THREAT, 0.8)


def negation(reach: int = 3) -> Transducer:
    """A match among the ``reach`` words after a negation is negated.  State: how far the last one still reaches, then: matched."""
    done = reach + 1
    rows = [{c: ((c, 1.0, reach if c == NEGATION else max(0, s - 1)),) for c in CLASSES} | {m: (((m[0], NEGATED if s else m[1]), 1.0, done),) for m in MATCHES} for s in range(done)]
    return Transducer((*rows, {c: ((c, 1.0, done),) for c in CLASSES}), (1.0,) * (done + 1))


def reported_speech() -> Transducer:
    """A match after a word of reporting is reported, negated or not.  State: such a word has come up, then: matched."""
    rows = [{c: ((c, 1.0, int(s or c == REPORT)),) for c in CLASSES} | {m: (((m[0], REPORTED if s else m[1]), 1.0, 2),) for m in MATCHES} for s in (0, 1)]
    return Transducer((*rows, {c: ((c, 1.0, 2),) for c in CLASSES}), (1.0,) * 3)


def target(more: float = 1.25) -> Transducer:
    """Writes how the match is said.  A clause that addresses or speaks of someone, before the match or after it, weighs more; a threat needs that."""
    unseen, seen, insulted, threatened, both = range(5)
    after = {unseen: seen, seen: seen, insulted: both, threatened: both, both: both}
    rows = [{c: ((None, 1.0, after[s] if c == TARGET else s),) for c in CLASSES} for s in range(5)]
    for m in MATCHES:
        rows[unseen][m] = ((m[1], 1.0, insulted if m[0] == INSULT else threatened),)
        rows[seen][m] = ((m[1], 1.0, both),)
    return Transducer(tuple(rows), (0.0, 0.0, 1.0, 0.0, more))


REACH = 3
GRAMMAR = insult().union(threat()).compose(negation(REACH)).compose(reported_speech()).compose(target())


def clause_score(classes: list[int], weights: list[float]) -> tuple[float, float, float]:
    """The greatest weight of a path of the grammar through a clause that ends in a meant, a negated and a reported match; a word's own weight counts where it is matched."""
    paths, plain = {(0, None): 1.0}, 0
    for c, own in zip(classes, weights):
        plain = plain + 1 if c == OTHER else 0
        if plain > REACH:  # no state is left that one more plain word changes
            continue
        after: dict = {}
        for (state, kind), w in paths.items():
            for out, x, to in GRAMMAR.arcs[state][c]:
                key, gain = ((to, kind), w * x) if out is None else ((to, out), w * x * own)
                if gain > after.get(key, 0.0):
                    after[key] = gain
        paths = after
    best = [0.0, 0.0, 0.0]
    for (state, kind), w in paths.items():
        if kind is not None:
            best[kind] = max(best[kind], w * GRAMMAR.final[state])
    return best[0], best[1], best[2]


class Lexicon:
    """Hashes of words and stems with their weights."""

    def __init__(self, learnt: dict[int, float]):
        weights = {int(h): 1.0 for h in _hashes(INSULTS + THREATS)} | learnt
        self.h = np.array(sorted(weights), np.uint64)
        self.w = np.array([weights[int(h)] for h in self.h])
        self.threats = set(_hashes(THREATS).tolist())
        self.classes = {w.encode(): c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}

    def look_up(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.w[at], 0.0)


def _hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array(words), _LETTERS).hashes()


def _features(w: Words) -> list[np.ndarray]:
    """Hashes of the words, and of their stems where a word is longer (a stem ends at a mark of its own)."""
    out, end = [w.hashes()], w.end
    for k in STEMS:
        longer = w.end - w.start > k
        w.end = np.where(longer, w.start + k, end)
        out.append(np.where(longer, w.hashes() ^ np.uint64(0x5555555555555555 + k), np.uint64(0)))
        w.end = end
    return out


def document_features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: greatest clause score as meant, negated, reported; log of matched clauses; density per hundred words."""
    w = Words(texts, _LETTERS)
    out = np.zeros((len(texts), 5))
    if not len(w):
        return out
    word, *stems = _features(w)
    weight = lexicon.look_up(word)
    for s in stems:
        weight = np.maximum(weight, lexicon.look_up(s))
    hit = np.flatnonzero(weight)
    row = np.searchsorted(w.first, hit, "right") - 1
    threat = np.isin(word[hit], np.array(sorted(lexicon.threats), np.uint64))
    raw = w.data.tobytes()
    cuts = np.flatnonzero(_CUT[w.data])
    cut = np.searchsorted(cuts, w.start[hit])
    cuts = np.concatenate((cuts, [len(w.data), -1]))  # the last one is before the first
    low, high = np.maximum(w.rows[row], cuts[cut - 1] + 1), np.minimum(w.rows[row + 1], cuts[cut])
    low, high = np.searchsorted(w.start, low), np.searchsorted(w.start, high)
    at = 0
    matched = np.zeros(len(texts), np.int64)
    while at < len(hit):
        r, i, j = row[at], low[at], high[at]
        upto = at + 1
        while upto < len(hit) and hit[upto] < j:
            upto += 1
        classes = [lexicon.classes.get(raw[w.start[k] : w.end[k]], OTHER) for k in range(i, j)]
        weights = [0.0] * (j - i)
        for k in range(at, upto):
            classes[hit[k] - i] = THREAT if threat[k] else INSULT
            weights[hit[k] - i] = float(weight[hit[k]])
        score = clause_score(classes, weights)
        if any(score):
            out[r, :3] = np.maximum(out[r, :3], score)
            matched[r] += 1
        at = upto
    out[:, 3] = np.log1p(matched)
    out[:, 4] = np.minimum(1.0, 100 * matched / np.maximum(w.counts, 1))
    return out


def _counted(texts: DataFrame, wanted) -> DataFrame:
    """h, n: in how many texts each word or stem is (of those ``wanted``, unless it is None)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text", 4 << 20):
            w = Words(batch.column("text"), _LETTERS)
            row = w.row_of().astype(np.uint64)
            h = np.concatenate(f := _features(w))
            row = np.tile(row, len(f))
            keep = h != 0
            if wanted is not None:
                keep &= np.isin(h, wanted.value)
            pairs = np.unique(np.rec.fromarrays([h[keep], row[keep]]))
            h, n = np.unique(pairs["f0"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame) -> dict[int, float]:
    """Words and stems of toxic rows that other rows seldom have, and their weights; the sample bounds how many."""
    toxic = _counted(sample.filter("toxic = 1"), None).filter(F.col("n") >= LEAST_ROWS).toPandas()  # bounded by the sample
    if not len(toxic):
        return {}
    h = toxic["h"].to_numpy(np.int64).view(np.uint64)
    context = sample.sparkSession.sparkContext
    clean = _counted(sample.filter("toxic = 0"), context.broadcast(np.sort(h))).toPandas()
    n = dict(zip(clean["h"].to_numpy(np.int64).view(np.uint64).tolist(), clean["n"]))
    shares = {k: p / (p + n.get(k, 0)) for k, p in zip(h.tolist(), toxic["n"])}
    return {k: float(share) for k, share in shares.items() if share >= LEAST_SHARE}


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 2.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights (the last is the constant) by Newton steps, pulled towards ``prior``."""
    x = np.column_stack((x, np.ones(len(x))))
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - strength * (w - prior)
        h = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return w


#: Meant, negated, reported, matched clauses, density, constant.
PRIOR = np.array([4.0, 0.5, 0.5, 0.5, 0.5, -2.5])


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic: the documents of some ``sample`` labels, picked by hash before any text is read, so that no text is shuffled."""
    labels = labels.filter("__id IS NOT NULL AND toxic IN (0, 1)").withColumn("toxic", F.col("toxic").cast("int"))
    share = min(1.0, sample / max(1, labels.count()))
    chosen = materialize(labels.filter(F.pmod(F.xxhash64(F.lit(4), "__id"), F.lit(1_000_003)) < int(share * 1_000_003)))
    rows = docs.filter("text IS NOT NULL").join(small(chosen, 2 * sample), "__id")
    if not rows_within(rows.select("toxic"), 2 * sample):  # an id that many rows repeat: one of its texts stands for all
        rows = rows.groupBy("__id", "toxic").agg(F.any_value("text").alias("text"))
    return materialize(rows.select("text", "toxic"))


def train(chosen: DataFrame) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from labelled rows (text, toxic), a bounded number of them."""
    lexicon = Lexicon(learn_lexicon(chosen))
    shared = chosen.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, "text"):
            x = document_features(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k].copy()) for k in range(5)), batch.column("toxic")], names=["a", "b", "c", "d", "e", "y"])

    rows = chosen.mapInArrow(run, "a double, b double, c double, d double, e double, y int").toPandas().to_numpy(float)
    return lexicon, fit(rows[:, :5], rows[:, 5], PRIOR) if len(rows) else PRIOR


def score(docs: DataFrame, labels: DataFrame, train_row: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = (), sample: int = SAMPLE, score_col: str = "score") -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns (or the id), ``score_col``: from 0 to 1.

    Learns from the rows of ``docs`` that ``labels`` labels 0 or 1 and for
    which ``train_row`` (over ``docs``) holds.  Null and empty texts get the
    score of a text without matches.  Long texts are read whole, in time linear in
    their length.  A clause that ties in weight keeps that weight.  Without labels the seeds and the prior
    stand.  Repeated ids and nulls are scored row by row; a label's repeated
    rows count again in learning, up to twice the sample in all.  Other columns are not read.
    """
    one = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("toxic"))
    known = sampled(docs.filter(train_row).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")), one, sample)
    model = docs.sparkSession.sparkContext.broadcast(train(known))
    names = [c for c in dict.fromkeys(keep or (id_col,)) if c != text_col or not keep]
    df = docs.select(*(F.col(f"`{c}`") for c in names), F.col(text_col).alias("__text"))
    whole = keep and text_col in keep  # the text itself is asked for: it passes through as it is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights = model.value
        for batch in rows_of(batches, "__text"):
            x = document_features(batch.column("__text"), lexicon)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:5] + weights[5], -30, 30)))
            extra = [batch.column("__text")] if whole else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra, pa.array(p)], names=[*names, *(["__text"] if whole else []), score_col])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in names or (whole and f.name == "__text"))
    return df.mapInArrow(run, f"{kept}`{score_col}` double").withColumnRenamed("__text", text_col)

"""Toxicity of documents: lexicon hits through Levenshtein automata, weighed by their context.

Learning (on a bounded sample of labelled rows): terms that are significantly more frequent in
documents with the label make the lexicon, as whole words and as word beginnings. A logistic model
over the hits of a document is fitted on labelled rows that did not make the lexicon.

Matching: the lexicon is a trie; the Levenshtein automaton of every whole word (one edit) runs over
it, and both together are made deterministic once, so a word costs one table step per character.
Word beginnings are matched exactly.

Context: a hit inside quotation marks or shortly after a reporting word counts as a quotation and
goes into features of its own; hits near a second-person word count as address.

Defined cases: a null text is scored as an empty one; an empty text gets the score of a text without
hits; without both labels in the sample every score is the share of the label (0 without rows);
repeated rows are scored each; of repeated labels of an id the largest counts; null labels do not
count; an empty table gives an empty result; other columns are ignored, whatever their names are.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, written

WORD = re.compile(r"[^\W_]+")
# Words that report speech, words of address, and quotation marks.
REPORTING = set(
    "said says wrote writes called calls quoted quote quoting stated reported claims claimed term"
    " word dit écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó palabra".split()
)
ADDRESS = set("you your youre yourself u tu te toi vous ton ta du dich dein deine sie ihr usted".split())
QUOTES = "\"“”„«»"
FEATURES = 9


@dataclass
class Lexicon:
    """Deterministic automaton of all terms; state 0 is dead, state 1 the start."""

    step: np.ndarray  # state x character class -> state
    classes: dict  # character -> class; 0 is any other
    exact: np.ndarray  # weight of a word that ends in the state, 0 if none
    fuzzy: np.ndarray  # the same, one edit away
    prefix: np.ndarray  # weight of a word beginning that ends in the state


def build_lexicon(terms: list[tuple[str, float]], fuzzy_length: int = 5) -> Lexicon:
    """``terms``: (word, or word beginning with ``*`` behind it; weight)."""
    children: list[dict] = [{}]
    word_weight, prefix_weight, depth_left = {}, {}, {}
    for term, weight in terms:
        node, body = 0, term.rstrip("*")
        fuzzy = not term.endswith("*") and len(body) >= fuzzy_length
        path = [0]
        for c in body:
            if c not in children[node]:
                children.append({})
                children[node][c] = len(children) - 1
            node = children[node][c]
            path.append(node)
        (prefix_weight if term.endswith("*") else word_weight)[node] = weight
        if fuzzy:
            depth_left.update(dict.fromkeys(path, True))
    fuzzy_word = {n: w for n, w in word_weight.items() if depth_left.get(n)}
    classes = {c: k + 1 for k, c in enumerate(sorted({c for kids in children for c in kids}))}

    def closed(states: set) -> frozenset:
        # A left-out character: the next node, one edit later.
        more = {
            (kid, 1) for node, e in states if e == 0
            for kid in children[node].values() if depth_left.get(kid)
        }
        return frozenset(states | {(n, 1) for n, _ in more if (n, 0) not in states})

    def moved(states: frozenset, c: str | None) -> frozenset:
        out = set()
        for node, e in states:
            kids = children[node]
            if c in kids and (e == 0 or depth_left.get(kids[c])):
                out.add((kids[c], e))
            if e == 0 and depth_left.get(node):
                out.add((node, 1))
                out.update((k, 1) for x, k in kids.items() if x != c and depth_left.get(k))
        return closed({(n, e) for n, e in out if e == 0 or (n, 0) not in out})

    start = closed({(0, 0)})
    number, states, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
    at = 0
    letters = [None, *classes]
    while at < len(states):
        row = []
        # Characters that no node of the state has on an edge behave like any other character.
        known = {x for n, _ in states[at] for x in children[n]}
        other = None
        for c in letters:
            if c not in known and other is not None:
                row.append(other)
                continue
            target = moved(states[at], c) if states[at] else frozenset()
            if target not in number:
                number[target] = len(states)
                states.append(target)
            row.append(number[target])
            if c not in known:
                other = number[target]
        rows.append(row)
        at += 1

    def best(weights: dict, edit: int) -> np.ndarray:
        return np.array(
            [max((weights.get(n, 0.0) for n, e in s if e == edit), default=0.0) for s in states]
        )

    return Lexicon(
        np.array(rows, dtype=np.int32), classes,
        best(word_weight, 0), best(fuzzy_word, 1), best(prefix_weight, 0),
    )


def match_words(lexicon: Lexicon, words: list[str], longest: int = 40) -> np.ndarray:
    """Weights (exact, one edit away, beginning) of each word, as rows."""
    out = np.zeros((len(words), 3))
    if not words:
        return out
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    table = np.zeros(65536, dtype=np.int32)
    for c, k in lexicon.classes.items():
        if ord(c) < 65536:
            table[ord(c)] = k
    classes = np.where(codes < 65536, table[np.minimum(codes, 65535)], 0)
    starts = np.cumsum(lengths) - lengths
    state = np.ones(len(words), dtype=np.int32)
    begun = np.zeros(len(words))
    for i in range(min(longest, int(lengths.max()))):
        live = np.flatnonzero((lengths > i) & (state > 0))
        if not len(live):
            break
        state[live] = lexicon.step[state[live], classes[starts[live] + i]]
        begun[live] = np.maximum(begun[live], lexicon.prefix[state[live]])
    ended = lengths <= longest
    out[:, 0] = np.where(ended, lexicon.exact[state], 0)
    out[:, 1] = np.where(ended & (out[:, 0] == 0), lexicon.fuzzy[state], 0)
    out[:, 2] = np.where(out[:, 0] == 0, begun, 0)
    out[out[:, 2] > 0, 1] = 0
    return out


def _in_quotation(text: str, start: int, stop: int, words_before: list[str], window: int) -> bool:
    if any(w in REPORTING for w in words_before):
        return True
    left, right = text[max(0, start - window) : start], text[stop : stop + window]
    opened = sum(left.count(q) for q in QUOTES)
    return opened % 2 == 1 and any(q in right for q in QUOTES)


class Scorer:
    """Features of texts; keeps the words it has matched, up to ``memo_words``."""

    def __init__(self, lexicon: Lexicon, memo_words: int = 300_000):
        self.lexicon, self.limit = lexicon, memo_words
        self.known: dict[str, int] = {}
        self.weights: list[tuple] = [(0.0, 0.0, 0.0)]

    def _learn(self, words: set) -> None:
        words = list(words)
        found = match_words(self.lexicon, words)
        hit = found.any(axis=1)
        for n in np.flatnonzero(hit):
            self.known[words[n]] = len(self.weights)
            self.weights.append(tuple(found[n]))
        self.known.update(dict.fromkeys((words[n] for n in np.flatnonzero(~hit)), 0))

    def features(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known, self.weights = {}, [(0.0, 0.0, 0.0)]
        lowered = [t.lower() for t in texts]
        split = [WORD.findall(t) for t in lowered]
        unknown: set = set()
        codes = []
        for words in split:
            of = list(map(self.known.get, words))
            if None in of:
                unknown.update(w for w, c in zip(words, of) if c is None)
            codes.append(of)
        self._learn(unknown)
        out = np.zeros((len(texts), FEATURES))
        for n, (words, of) in enumerate(zip(split, codes)):
            if None in of:
                known = self.known
                of = [known[w] if c is None else c for w, c in zip(words, of)]
            out[n, 8] = np.log1p(len(words))
            if any(of):
                out[n, :8] = self._hits(lowered[n], words, of)
        return out

    def _hits(self, text: str, words: list[str], of: list[int], window: int = 80) -> list[float]:
        spans = [m.span() for m in WORD.finditer(text)]
        direct = fuzzy = begun = quoted = address = top = 0.0
        hits = 0
        for i, code in enumerate(of):
            if not code:
                continue
            exact, near, beginning = self.weights[code]
            weight = max(exact, near, beginning)
            before = words[max(0, i - 4) : i]
            if _in_quotation(text, *spans[i], before, window):
                quoted += weight
                continue
            hits += exact > 0
            direct, fuzzy, begun = direct + exact, fuzzy + near, begun + beginning
            top = max(top, exact, beginning)
            if any(w in ADDRESS for w in words[max(0, i - 3) : i + 4]):
                address += weight
        size = np.sqrt(len(words) + 1)
        return [
            direct / size, fuzzy / size, begun / size, quoted / size, address / size, top,
            np.log1p(hits), np.log1p(begun),
        ]


def _terms_of(texts: list[str], labels: list[int], prefixes: range):
    """(term, documents with the label, documents without) of a batch."""
    counts = (Counter(), Counter())
    for text, label in zip(texts, labels):
        words = set(WORD.findall(text.lower()))
        terms = {w for w in words if 3 <= len(w) <= 24}
        for k in prefixes:
            terms.update(w[:k] + "*" for w in words if len(w) > k)
        counts[label].update(terms)
    for term in counts[0].keys() | counts[1].keys():
        yield term, counts[1][term], counts[0][term]


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, label_col: str) -> DataFrame:
    """text, label of at most ``most`` labelled rows, the first by a hash of the id."""
    chosen = (
        labels.where(F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .withColumn("order", F.xxhash64("doc_id", F.lit(7)))
        .orderBy("order", "doc_id")
        .limit(most)
    )
    # The bound makes it safe to send this side to every task.
    return docs.join(F.broadcast(chosen), "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "label",
        (F.pmod(F.col("order"), F.lit(5)) < 3).alias("for_terms"),
    )


def learn_terms(sample: DataFrame, most_terms: int = 160, least_z: float = 2.6) -> list:
    """(term, weight) by the significance of their log odds."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []

    def terms(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                found = list(
                    _terms_of(some.column(0).to_pylist(), some.column(1).to_pylist(), range(4, 8))
                )
                columns = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))],
                    names=["term", "a", "c"],
                )

    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("c") + 0.5))
    rows = (
        sample.select("text", "label").mapInArrow(terms, "term string, a long, c long")
        .groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
        .where("a >= 3")
        .select("term", odds.alias("weight"), (odds / error).alias("z"))
        .where((F.col("z") >= least_z) & (F.col("weight") >= 1.0))
        .orderBy(F.desc("z"), "term")
        .limit(most_terms)
        .collect()
    )
    return [(r["term"], float(r["weight"])) for r in rows]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients of standardised features and, last, the constant; then means and scales."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        grad = z.T @ (y - p) - penalty * beta
        hessian = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, grad)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([beta, np.r_[mean, 0], np.r_[scale, 1]])


def apply_logistic(model: np.ndarray, x: np.ndarray) -> np.ndarray:
    beta, mean, scale = model
    z = (x - mean[:-1]) / scale[:-1]
    return 1 / (1 + np.exp(-np.clip(z @ beta[:-1] + beta[-1], -30, 30)))


def _feature_batches(lexicon: Lexicon):
    def run(batches, text_col="text"):
        scorer = Scorer(lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch, np.concatenate(
                [scorer.features(texts[a : a + 256]) for a in range(0, len(texts), 256)]
                or [np.zeros((0, FEATURES))]
            )

    return run


def scored_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    most_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    score_col: str = "toxicity",
) -> DataFrame:
    """All columns of ``docs`` and ``score_col``, which replaces a column of that name.

    ``labels``: doc_id and ``label_col`` to learn from; ``most_rows`` bounds the labelled documents
    that are looked at.
    """
    sample = written(
        labelled_sample(id_and_text(docs, id_col, text_col), labels, most_rows, label_col), "labelled"
    )
    shares = sample.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    batches_of = _feature_batches(build_lexicon(learn_terms(sample.where("for_terms"))))

    def features(batches):
        for batch, x in batches_of(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(list(x), type=pa.list_(pa.float64()))],
                names=["label", "x"],
            )

    model = None
    if shares[1] == 0 and shares[2] == 1:
        rows = (
            sample.where("NOT for_terms").select("text", "label")
            .mapInArrow(features, "label int, x array<double>").collect()
        )
        rows = sorted((r["label"], tuple(r["x"])) for r in rows)
        y = np.array([r[0] for r in rows])
        if len(y) and 0 < y.mean() < 1:
            model = fit_logistic(np.array([r[1] for r in rows]), y)
    share = float(shares[0] or 0.0)
    docs = docs.drop(score_col)
    names = [f"c{n}" for n in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]

    def score(batches):
        for batch, x in batches_of(batches, at):
            s = np.full(len(x), share) if model is None else apply_logistic(model, x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(s, type=pa.float64())], names=[*batch.schema.names, "score"]
            )

    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, docs.columns)]
    return (
        docs.toDF(*names).mapInArrow(score, ", ".join([*fields, "score double"]))
        .toDF(*docs.columns, score_col)
    )


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    most_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, score of every document."""
    return scored_rows(
        id_and_text(docs, id_col, text_col), labels, label_col, most_rows, score_col="score"
    ).select("doc_id", "score")

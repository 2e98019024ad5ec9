"""Language of documents by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece,
estimated by expectation maximisation over the words of a bounded sample of labelled texts. A word
is scored by the forward algorithm: the sum, over all ways to cut it into pieces, of the product of
their probabilities. A text is scored by its words; the score is the posterior of the best language.

Words come again and again, so each task keeps the scores of words it has seen, in a bounded memo;
words not seen before go through the forward algorithm together, one table step per place and
piece length.

Defined cases: a null text or one without a letter is ``und`` with score 0; without labelled rows
everything is ``und``; null labels are not learned; ties go to the first language by name; repeated
rows are answered each; an empty table gives an empty result; other columns are ignored, whatever
their names are.
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

WORD = re.compile(r"[^\W\d_]+")
START = "▁"  # the vocabulary's mark of a word's beginning
FLOOR = 1e-7  # of a single character that is no piece, in any language


@dataclass
class PieceTrie:
    """Pieces as a trie with one table row per node; node 0 is dead, node 1 the root."""

    step: np.ndarray
    piece: np.ndarray  # piece of a node, or -1
    table: np.ndarray  # code point (below 65536) to character class
    pieces: int
    longest: int


def piece_trie(vocabulary: str, letters: set[str], longest: int = 8) -> PieceTrie:
    """Pieces of the vocabulary file that consist of ``letters``."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    letters = letters | {START}
    texts = sorted(
        {t for t in map(model.id_to_piece, range(model.vocab_size()))
         if len(t) <= longest and letters.issuperset(t)} | letters
    )
    classes = {c: n + 1 for n, c in enumerate(sorted(letters))}
    rows: list[dict] = [{}, {}]
    ends = [-1, -1]
    for n, text in enumerate(texts):
        node = 1
        for c in text:
            if classes[c] not in rows[node]:
                rows[node][classes[c]] = len(rows)
                rows.append({})
                ends.append(-1)
            node = rows[node][classes[c]]
        ends[node] = n
    step = np.zeros((len(rows), len(classes) + 1), dtype=np.int32)
    for node, kids in enumerate(rows):
        for c, kid in kids.items():
            step[node, c] = kid
    table = np.zeros(65536, dtype=np.int16)
    for c, n in classes.items():
        table[ord(c)] = n
    return PieceTrie(step, np.array(ends), table, len(texts), max(map(len, texts)))


def _matrix(trie: PieceTrie, words: list[str]) -> np.ndarray:
    """Character classes of words of one length range, padded with -1."""
    width = max(map(len, words))
    text = "".join(w.ljust(width, "\0") for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = codes.reshape(len(words), width)
    classes = np.where(codes < 65536, trie.table[np.minimum(codes, 65535)], 0)
    return np.where(codes == 0, -1, classes)


def _buckets(words: list[str], cells: int = 400_000):
    """Positions of words of similar length, in groups of at most about ``cells`` characters."""
    order = sorted(range(len(words)), key=lambda n: len(words[n]))
    at = 0
    while at < len(order):
        shortest = max(8, len(words[order[at]]))
        stop = at + 1
        while (
            stop < len(order) and len(words[order[stop]]) <= 2 * shortest
            and (stop - at) * len(words[order[stop]]) < cells
        ):
            stop += 1
        yield order[at:stop]
        at = stop


def _lattice(trie: PieceTrie, classes: np.ndarray, i: int):
    """(length, words, pieces) of every piece that begins at place ``i``; piece -1 is a character
    outside the vocabulary."""
    live = np.flatnonzero(classes[:, i] >= 0)
    node = np.ones(len(live), dtype=np.int32)
    for length in range(1, trie.longest + 1):
        if i + length > classes.shape[1]:
            return
        c = classes[live, i + length - 1]
        node = np.where(c >= 0, trie.step[node, np.maximum(c, 0)], 0)
        if length == 1:
            strange = live[node == 0]
            if len(strange):
                yield 1, strange, None
        keep = node > 0
        live, node = live[keep], node[keep]
        if not len(live):
            return
        piece = trie.piece[node]
        found = piece >= 0
        if found.any():
            yield length, live[found], piece[found]


def forward(trie: PieceTrie, probability: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probability of each word (with its beginning mark) in each language, over all
    segmentations. ``probability``: languages x pieces."""
    out = np.zeros((len(words), len(probability)))
    by_piece = np.ascontiguousarray(probability.T)
    for chosen in _buckets(words):
        some = [words[n] for n in chosen]
        classes = _matrix(trie, some)
        lengths = np.fromiter(map(len, some), dtype=np.int64, count=len(some))
        count, width = classes.shape
        ring = trie.longest + 1
        alpha = np.zeros((ring, count, len(probability)))
        alpha[0] = 1.0
        scale = np.zeros(count)
        result = np.zeros((count, len(probability)))
        for i in range(width):
            now = alpha[i % ring]
            if i and i % 8 == 0:
                # Keeps long words within the range of floating point numbers.
                most = now.max(1)
                live = most > 0
                scale[live] += np.log(most[live])
                alpha[:, live] /= most[live][None, :, None]
            for length, rows, pieces in _lattice(trie, classes, i):
                weight = FLOOR if pieces is None else by_piece[pieces]
                alpha[(i + length) % ring, rows] += now[rows] * weight
            ended = np.flatnonzero(lengths == i + 1)
            if len(ended):
                final = alpha[(i + 1) % ring, ended]
                result[ended] = np.log(np.maximum(final, 1e-300)) + scale[ended, None]
            alpha[i % ring] = 0.0
        out[chosen] = result
    return out


def expected_counts(
    trie: PieceTrie, probability: np.ndarray, words: list[str], weights: np.ndarray
) -> np.ndarray:
    """Expected uses of each piece in ``words`` over all segmentations, for one language."""
    total = np.zeros(trie.pieces)
    for chosen in _buckets(words):
        classes = _matrix(trie, [words[n] for n in chosen])
        count, width = classes.shape
        lengths = (classes >= 0).sum(1)
        steps = [list(_lattice(trie, classes, i)) for i in range(width)]
        alpha = np.zeros((count, width + 1))
        beta = np.zeros((count, width + 1))
        alpha[:, 0] = 1.0
        beta[np.arange(count), lengths] = 1.0
        def weight(pieces):
            return FLOOR if pieces is None else probability[pieces]
        for i in range(width):
            for length, rows, pieces in steps[i]:
                alpha[rows, i + length] += alpha[rows, i] * weight(pieces)
        for i in range(width - 1, -1, -1):
            for length, rows, pieces in steps[i]:
                beta[rows, i] += beta[rows, i + length] * weight(pieces)
        whole = np.maximum(alpha[np.arange(count), lengths], 1e-300)
        factor = weights[chosen] / whole
        for i in range(width):
            for length, rows, pieces in steps[i]:
                if pieces is not None:
                    uses = alpha[rows, i] * probability[pieces] * beta[rows, i + length]
                    np.add.at(total, pieces, uses * factor[rows])
    return total


@dataclass
class Model:
    languages: list[str]
    trie: PieceTrie
    probability: np.ndarray
    prior: np.ndarray


def train(
    rows: DataFrame,
    vocabulary: str,
    most_rows: int = 4_000,
    most_words: int = 20_000,
    most_languages: int = 200,
    rounds: int = 3,
) -> Model | None:
    """Learn from ``rows`` (text, lang).

    Bounds: of each language, the first ``most_rows`` texts by a hash and their ``most_words`` most
    frequent words of at most 40 letters; the ``most_languages`` most frequent labels.
    """
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    sizes = sorted((r["lang"], r["n"]) for r in sizes.limit(most_languages).collect())
    if not sizes:
        return None
    # The share of the hash range that holds about most_rows texts of each language.
    share = F.create_map(
        *[F.lit(x) for lang, n in sizes for x in (lang, int(min(1.0, most_rows / n) * (1 << 31)))]
    )
    kept = rows.where(
        F.pmod(F.xxhash64("text"), F.lit(1 << 31)) < F.coalesce(share[F.col("lang")], F.lit(0))
    )

    def counted(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = (w for w in WORD.findall(text.lower()) if len(w) <= 40)
                found.setdefault(lang, Counter()).update(words)
            flat = [(lang, w, n) for lang, of in found.items() for w, n in of.items()]
            columns = list(zip(*flat)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))],
                names=["lang", "word", "n"],
            )

    words = written(
        kept.select("lang", "text").mapInArrow(counted, "lang string, word string, n long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")),
        "language-words",
    )
    top: dict[str, list] = {}
    for lang, _ in sizes:
        some = words.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(most_words)
        top[lang] = [(r["word"], r["n"]) for r in some.collect()]
    languages = [lang for lang, _ in sizes if top[lang]]
    if not languages:
        return None
    letters = Counter(c for lang in languages for w, _ in top[lang] for c in w if ord(c) < 65536)
    trie = piece_trie(vocabulary, {c for c, _ in letters.most_common(400)})
    counts = []
    for lang in languages:
        spelled = [START + w for w, _ in top[lang]]
        weights = np.array([n for _, n in top[lang]], dtype=float)
        p = np.full(trie.pieces, 1.0 / trie.pieces)
        for _ in range(rounds):
            uses = expected_counts(trie, p, spelled, weights)
            p = (uses + 1e-3) / (uses.sum() + 1e-3 * trie.pieces)
        counts.append(uses)
    counts = np.array(counts)
    shares = counts / counts.sum(1, keepdims=True)
    # A little of the mean of all languages, so that no piece decides on its own.
    mixed = 0.99 * shares + 0.01 * shares.mean(0) + 1e-9
    number = dict(sizes)
    prior = np.log(np.array([number[x] for x in languages], dtype=float) / sum(number.values()))
    return Model(languages, trie, mixed / mixed.sum(1, keepdims=True), prior)


class Classifier:
    def __init__(self, model: Model, memo_words: int = 400_000):
        self.model, self.limit = model, memo_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.languages)), dtype=np.float32)

    def _learn(self, words: list[str]) -> None:
        start = len(self.known)
        need = start + len(words)
        if need > len(self.scores):
            more = np.zeros((2 * need, self.scores.shape[1]), dtype=np.float32)
            more[:start] = self.scores[:start]
            self.scores = more
        self.known.update(zip(words, range(start, need)))
        self.scores[start:need] = forward(
            self.model.trie, self.model.probability, [START + w for w in words]
        )

    def classify(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > self.limit:
            self._clear()
        split = [WORD.findall(t.lower()) for t in texts]
        of_texts = [list(map(self.known.get, words)) for words in split]
        unknown = {
            w for words, of in zip(split, of_texts) if None in of
            for w, n in zip(words, of) if n is None
        }
        self._learn(sorted(unknown))
        out = []
        for words, of in zip(split, of_texts):
            if not words:
                out.append(("und", 0.0))
                continue
            if None in of:
                known = self.known
                of = [known[w] if n is None else n for w, n in zip(words, of)]
            total = self.model.prior + self.scores[of].sum(0, dtype=np.float64)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def detect_languages(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score of every document."""

    def run(batches):
        classifier = None if model is None else Classifier(model)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if classifier is None:
                found = [("und", 0.0)] * len(texts)
            else:
                found = [
                    x for a in range(0, len(texts), 256) for x in classifier.classify(texts[a : a + 256])
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([x for x, _ in found], type=pa.string()),
                    pa.array([s for _, s in found], type=pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )

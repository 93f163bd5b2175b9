"""Scores of toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

Two words are alike as far as they share subsequences of 3 and 4 letters; a subsequence counts less the wider it is spread (DECAY for each letter that it spans, SPANS at most),
so an insult with letters inserted or left out, and one that is bent by an ending, keeps most of its likeness. The kernel of sentences is the sum over their words; punctuation
within words and blanks between single letters are taken out first. LANDMARKS words span the feature space: those that tell toxic rows apart in the sample, and others as background.

Labels are given for whole texts, and one insult makes a text toxic, so a text's sentences are a bag: those of clean texts are negative, of a toxic text at least one is positive.
The machine is trained with the sentence that speaks most for each toxic text, and chooses again, ROUNDS times. A text's score is that of its worst sentence, as a probability.

The machine is linear in the words' features, so a word has one number, whatever the sentence: workers compute it once for each distinct word and look it up after that.
Nothing is shuffled but the sample's ids and texts, which are bounded; every text is scored whole.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import AT_A_TIME, MEMO_ENTRIES, raw, slim, table, unslim, with_carried

#: Bounds of the sample that the model is fitted on: rows of each label, bytes of a text, clean sentences. Longer texts are scored like others, only not learned from.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SENTENCES = 1500, 20_000, 10_000
#: Letters of a subsequence -> letters that it may span.
SPANS = {3: 6, 4: 7}
DECAY, SHARP, ALIKE, LANDMARKS, ROUNDS, FOLDS, REGULAR = 0.7, 2, 0.3, 128, 3, 3, (1e-4, 1e-5, 1e-6, 1e-7)
#: Words beyond so many letters are read in pieces that overlap, so that no subsequence is lost; sentences beyond so many words in parts.
WIDTH, WORDS = 24, 40

_END = re.compile(rb"[.!?]+(?=\s|$)|[\n\r]+")
_MARKS = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum())
_SINGLES = re.compile(rb"(?:^|(?<=\s))[a-z0-9](?: [a-z0-9])+(?=\s|$)")
#: Words' numbers are kept as integers of this unit, so that sums don't hang on their order.
UNIT = 2.0**-32


def sentences(data: bytes) -> list[list[bytes]]:
    """The words of each sentence, lower-cased, without ASCII punctuation; runs of single letters (a-z, digits) are one word. Parts of WORDS words at most."""
    out = []
    lower = data.decode("utf-8", "replace").lower().encode()
    for part in _END.split(_SINGLES.sub(lambda x: x[0].replace(b" ", b""), lower)):
        words = part.translate(None, _MARKS).split()
        if len(words) <= WORDS:
            if words:
                out.append(words)
        else:
            out += [words[k : k + WORDS] for k in range(0, len(words), WORDS)]
    return out


def pieces(word: bytes) -> list[str]:
    text = word.decode()
    step = WIDTH - max(SPANS.values()) + 1
    return [text] if len(text) <= WIDTH else [text[k : k + WIDTH] for k in range(0, len(text) - WIDTH + step, step)]


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points, zero beyond a word's end, with room for the widest span."""
    room = max(SPANS.values())
    out = np.zeros((len(words), width + room), np.int64)
    out[:, :width] = np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width)
    return out


def _norms(p: int) -> np.ndarray:
    """By a word's length, up to WIDTH: how long its vector of subsequences would be if all its letters were different. None of too short ones."""
    told = np.zeros(WIDTH + 1)
    for rest in itertools.combinations(range(1, SPANS[p]), p - 1):
        told += np.maximum(np.arange(WIDTH + 1) - rest[-1], 0) * DECAY ** (2 * rest[-1] + 2)
    return np.sqrt(told)


class Subsequences:
    """The subsequences that occur in given words, numbered, as a trie in arrays; finds them in other words."""

    def __init__(self, words: list[str]) -> None:
        self.alphabet = {c: k for k, c in enumerate(sorted({c for x in words for c in x}), 1)}
        self.size = len(self.alphabet) + 1
        self.depth = max(SPANS)
        found: list[dict[tuple[int, int], int]] = [{} for _ in range(self.depth + 1)]
        for text in words:
            code = [self.alphabet[c] for c in text]
            for p, span in SPANS.items():
                for at in range(len(code)):
                    for rest in itertools.combinations(range(1, span), p - 1):
                        if at + rest[-1] < len(code):
                            node = code[at]
                            for level, o in enumerate(rest, 2):
                                node = found[level].setdefault((node, code[at + o]), len(found[level]) + 1)
        self.next = [np.zeros(0, np.int32)] * 2
        for level in range(2, self.depth + 1):
            rows = self.size if level == 2 else len(found[level - 1]) + 1
            made = np.zeros(rows * self.size, np.int32)
            for (node, c), k in found[level].items():
                made[node * self.size + c] = k
            self.next.append(made)
        self.numbers = {p: len(found[p]) + 1 for p in SPANS}
        self.codes = np.zeros(0x110000, np.int16)
        for c, k in self.alphabet.items():
            self.codes[ord(c)] = k

    def hits(self, words: list[str], width: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length of subsequence (index of word, number, weight) of all that occur in the words."""
        letters = _letters(words, width)
        codes = self.codes[letters].astype(np.int32)
        out: dict[int, list] = {p: [] for p in SPANS}
        nodes: dict[tuple[int, ...], np.ndarray] = {(): codes[:, :width]}
        for level in range(2, self.depth + 1):
            span = max(s for p, s in SPANS.items() if p >= level)
            told = {}
            for rest, node in nodes.items():
                for o in range((rest[-1] if rest else 0) + 1, span):
                    made = self.next[level][node * self.size + codes[:, o : o + width]]
                    told[(*rest, o)] = made
                    if level in SPANS and o < SPANS[level]:
                        at = np.flatnonzero(made)
                        if len(at):
                            out[level].append((at // width, made.ravel()[at], np.full(len(at), DECAY ** (o + 1))))
            nodes = told
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return {p: tuple(map(np.concatenate, zip(*own, strict=True))) if own else none for p, own in out.items()}


class Landmarks:
    """Words, and the subsequences that each holds, listed by subsequence; gives other words' kernels with them."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.found = words, Subsequences(words)
        self.first, self.of, self.weight = {}, {}, {}
        self.norms = {p: _norms(p) for p in SPANS}
        sizes = np.array([len(x) for x in words])
        for p, (of, number, weight) in self.found.hits(words, WIDTH).items():
            keys, where = np.unique(number.astype(np.int64) * len(words) + of, return_inverse=True)  # by number, then by word
            self.of[p] = keys % len(words)
            self.weight[p] = np.bincount(where, weight, minlength=len(keys)) / self.norms[p][sizes[self.of[p]]]
            self.first[p] = np.searchsorted(keys // len(words), np.arange(self.found.numbers[p] + 1))

    def kernel(self, words: list[str]) -> np.ndarray:
        """(word, landmark): the mean over lengths of the products of subsequence vectors, each divided by its norm, to the power of SHARP."""
        n, sizes = len(self.words), np.array([len(x) for x in words])
        out = np.zeros((len(words), n), np.float32)
        for width, rows in by_width(words):
            for part in (rows[k : k + 2000] for k in range(0, len(rows), 2000)):
                for p, (of, number, weight) in self.found.hits([words[k] for k in part], width).items():
                    start, size = self.first[p][number], self.first[p][number + 1] - self.first[p][number]
                    at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                    made = np.bincount(np.repeat(of, size) * n + self.of[p][at], np.repeat(weight, size) * self.weight[p][at], minlength=len(part) * n).reshape(len(part), n).astype(float)
                    norm = self.norms[p][sizes[part]][:, None]
                    out[part] += np.divide(made, norm, out=np.zeros_like(made), where=norm > 0) / len(SPANS)
        return out**SHARP


def by_width(words: list[str]) -> list[tuple[int, np.ndarray]]:
    """(width, indices) of words, so that short ones aren't padded much."""
    sizes = np.array([len(x) for x in words])
    edges = [0, 6, 9, 12, 16, WIDTH]
    return [(high, np.flatnonzero((sizes > low) & (sizes <= high))) for low, high in itertools.pairwise(edges) if ((sizes > low) & (sizes <= high)).any()]


class Model:
    """What a text's score takes: landmarks and their weights, an offset, and the curve to probabilities."""

    def __init__(self, marks: Landmarks | None, weights: np.ndarray, offset: float, curve: np.ndarray) -> None:
        self.marks, self.weights, self.offset, self.curve = marks, weights, offset, curve

    def values(self, words: list[bytes]) -> np.ndarray:
        """What each word adds to its sentence; of a long word's pieces the largest."""
        if self.marks is None or not words:
            return np.zeros(len(words))
        flat, starts = [], []
        for word in words:
            starts.append(len(flat))
            flat += pieces(word)
        told = np.concatenate([self.marks.kernel(flat[k : k + 20_000]) @ self.weights for k in range(0, len(flat), 20_000)])
        return np.maximum.reduceat(told, starts)

    def probability(self, sums: list[float]) -> float:
        """Of a text, given its sentences' sums."""
        first, second = (sorted(sums, reverse=True) + [0.0, 0.0])[:2] if sums else (0.0, 0.0)
        told = float(self.curve @ (first + self.offset, second + self.offset, 1.0))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, told)))))

    def scores(self, texts: list[bytes], memo: dict[bytes, int]) -> list[float]:
        """Of each text. memo: words' numbers so far, emptied beyond MEMO_ENTRIES."""
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        bags = [[set(x) for x in sentences(data)] for data in texts]
        fresh = [x for x in set().union(*(own for bag in bags for own in bag)) if x not in memo]
        memo.update(zip(fresh, np.rint(self.values(fresh) / UNIT).astype(np.int64).tolist(), strict=True))
        return [self.probability([sum(map(memo.__getitem__, x)) * UNIT for x in bag]) for bag in bags]


def _support(x: np.ndarray, y: np.ndarray, cost: np.ndarray, regular: float) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps over the rows within the margin; the last column is the offset's."""
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, regular), 1e-6)
    before = None
    for _ in range(30):
        inside = y * (x @ w) < 1
        if before is not None and (inside == before).all():
            break
        before = inside
        own, c = x[inside], cost[inside]
        w = np.linalg.solve((own * c[:, None]).T @ own + np.diag(keep), (own * c[:, None]).T @ y[inside])
    return w


def _curve(decisions: np.ndarray, toxic: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """A logistic curve over a text's decisions, the last number being its shift, and its loss; targets are softened, and rows weigh so that toxic ones have their share in all labels."""
    n = np.array([(~toxic).sum(), toxic.sum()])
    target = np.where(toxic, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = np.where(toxic, share / n[1], (1 - share) / n[0]) * len(toxic)
    x, soft = np.column_stack((decisions, np.ones(len(toxic)))), np.diag([1e-2, 1e-2, 1e-9])
    told = np.array([0.5, 0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ told, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + soft, x.T @ (weight * (p - target)) + soft @ told)
        told = told - step * min(1.0, 3 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ told, -30, 30))), 1e-9, 1 - 1e-9)
    return told, float(-(weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum())


def fit(texts: list[bytes], toxic: list[bool], share: float | None = None) -> Model:
    """A model of labelled texts. share: of toxic ones among all labels, else as given here. With rows of one label only, the score is that label's share for every text."""
    label = np.array(toxic, bool)
    share = float(label.mean() if share is None and len(label) else share or 0.0)
    if not label.any() or label.all():
        return Model(None, np.zeros(0), 0.0, np.array([0.0, 0.0, 30.0 if share >= 1 else -30.0]))
    bags = [[sorted(set(x)) for x in sentences(data)] or [[]] for data in texts]
    words = sorted({x for bag in bags for own in bag for x in own})
    number = {x: k for k, x in enumerate(words)}
    df = np.zeros((2, len(words)))
    for bag, y in zip(bags, label, strict=True):
        df[int(y), [number[x] for x in {x for own in bag for x in own}]] += 1
    n = np.array([[(~label).sum()], [label.sum()]])
    odds = np.log((df + 0.5) / (n - df + 0.5))
    z = (odds[1] - odds[0]) / np.sqrt(1 / (df + 0.5) + 1 / (n - df + 0.5)).sum(0)
    shown = [max(pieces(x), key=len) for x in words]
    marks = Landmarks(_landmarks(shown, z, df.sum(0)))
    gram = marks.kernel(marks.words).astype(float)
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > 1e-4
    white = (axes[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    features = np.concatenate([marks.kernel(shown[k : k + 20_000]) @ white for k in range(0, len(shown), 20_000)])

    owner = np.array([k for k, bag in enumerate(bags) for _ in bag])
    flat = [[number[x] for x in own] for bag in bags for own in bag]
    x = np.ones((len(flat), features.shape[1] + 1), np.float32)
    for k, own in enumerate(flat):
        x[k, :-1] = features[own].sum(0)
    worst = np.array([np.maximum(z[own] - 2, 0).sum() if own else 0.0 for own in flat])
    order = np.array([zlib.crc32(b" ".join(words[j] for j in own)) for own in flat])
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    fold = np.array([zlib.crc32(data) % FOLDS for data in texts])
    best = (np.inf, REGULAR[0], np.zeros(3))
    for regular in REGULAR:  # the curve and the weight of regularisation go by decisions about texts that the machine hasn't seen
        top = np.zeros((len(label), 2))
        for k in range(FOLDS):
            held = fold == k
            if held.any() and label[~held].any() and not label[~held].all():
                w = _trained(x, owner, label, ~held, worst, order, regular)
                top[held] = _two_largest(x @ w, starts, w[-1])[held]
        curve, loss = _curve(top, label, min(max(share, 1e-3), 1 - 1e-3))
        best = min(best, (loss, regular, curve), key=lambda told: told[0])
    w = _trained(x, owner, label, np.ones(len(label), bool), worst, order, best[1])
    return Model(marks, white.astype(float) @ w[:-1], float(w[-1]), best[2])


def _two_largest(decision: np.ndarray, starts: np.ndarray, none: float) -> np.ndarray:
    """Of each bag; a bag of one has the decision about an empty sentence as its second."""
    first = np.maximum.reduceat(decision, starts)
    sizes = np.diff(np.append(starts, len(decision)))
    at = np.flatnonzero(decision == np.repeat(first, sizes))
    rest = decision.copy()
    rest[at[np.searchsorted(at, starts)]] = -np.inf
    second = np.maximum.reduceat(rest, starts)
    return np.stack((first, np.where(sizes > 1, second, none)), 1)


def _trained(x: np.ndarray, owner: np.ndarray, label: np.ndarray, use: np.ndarray, worst: np.ndarray, order: np.ndarray, regular: float) -> np.ndarray:
    """Weights learned from the bags in use: all sentences of clean texts, up to SAMPLE_SENTENCES by hash, against the sentences that speak for toxic ones."""
    clean = np.flatnonzero((~label & use)[owner])
    clean = np.sort(clean[np.argsort(order[clean], kind="stable")[:SAMPLE_SENTENCES]])
    bad = np.flatnonzero((label & use)[owner])
    starts = np.flatnonzero(np.concatenate(([True], owner[bad][1:] != owner[bad][:-1])))
    decision = worst[bad]
    for turn in range(ROUNDS):
        speaks = np.array([at + int(np.argmax(decision[at:to])) for at, to in zip(starts, [*starts[1:], len(bad)], strict=True)])
        if turn:
            speaks = np.union1d(speaks, np.flatnonzero(decision > 0))
        rows = np.concatenate((clean, bad[speaks]))
        y = np.concatenate((-np.ones(len(clean)), np.ones(len(speaks))))
        cost = np.concatenate((np.full(len(clean), 1 / len(clean)), np.full(len(speaks), 1 / len(speaks))))
        w = _support(x[rows].astype(float), y, cost, regular)
        decision = x[bad] @ w
    return w


def _landmarks(words: list[str], z: np.ndarray, df: np.ndarray) -> list[str]:
    """Half of them the words that tell toxic texts apart most, none much like one before; the rest any others, by a hash of the word."""
    long_enough = [k for k in np.argsort(-z, kind="stable").tolist() if len(words[k]) >= min(SPANS)]
    first = [k for k in long_enough if z[k] > 1][: 8 * LANDMARKS]
    chosen: list[str] = []
    if first:
        told = list(dict.fromkeys(words[k] for k in first))
        alike = Landmarks(told).kernel(told)
        taken: list[int] = []
        for k in range(len(told)):
            if len(taken) < LANDMARKS // 2 and not (taken and alike[k, taken].max() > ALIKE):
                taken.append(k)
        chosen = [told[k] for k in taken]
    rest = sorted((k for k in long_enough if df[k] > 1 or len(words) < 4 * LANDMARKS), key=lambda k: (zlib.crc32(words[k].encode()), words[k]))
    return list(dict.fromkeys(chosen + [words[k] for k in rest[: LANDMARKS - len(chosen)]]))


def sampled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> tuple[list[bytes], list[bool], float]:
    """Texts and labels to learn from, and the share of toxic ones among all labels that may be learned from.

    Rows whose crc32(id as text) mod 5 is 0 are held out. Of each label the SAMPLE_ROWS rows with the smallest hashes of their ids are taken; a row that has several labels is
    toxic if one says so, an id that several texts have gives the least of them. Labels or ids that are null count for nothing.
    """
    told = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id IS NOT NULL AND y IS NOT NULL")
    told = told.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("y").alias("y"))
    n = {r.y: r.n for r in told.groupBy(F.col("y") > 0).agg(F.count("*").alias("n")).toDF("y", "n").collect()}
    ids = [told.where(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for y in (0, 1)]
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.octet_length("text").between(1, SAMPLE_BYTES))
    some = docs.join(F.broadcast(ids[0].unionByName(ids[1])), "id")  # 2 * SAMPLE_ROWS rows at most
    rows = some.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).collect()
    rows.sort(key=lambda r: r.id)
    return [r.text.encode() for r in rows], [r.y > 0 for r in rows], n.get(True, 0) / max(1, sum(n.values()))


def toxicity(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, predicted) of every row, and carried columns. Null and empty texts, and texts without words, get the score of an empty sentence; long ones are read whole."""
    given = slim(df, id_col, text_col, carry)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        for batch in (whole.slice(k, AT_A_TIME) for whole in batches for k in range(0, whole.num_rows, AT_A_TIME)):
            scores = model.scores([data or b"" for data in raw(batch.column(1))], memo)
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "score", "predicted", *batch.schema.names[2:]])

    return unslim(given.mapInArrow(go, with_carried("id long,score double,predicted int", given)), id_col, carry)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all documents. A null id is held out, as nothing can be learned from it; equal texts get equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*sampled(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")

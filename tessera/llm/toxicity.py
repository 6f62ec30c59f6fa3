"""Toxicity scores from a learned lexicon, Levenshtein automata and quotation windows (operator 8).

Fit, on a bounded sample of labelled rows (``SAMPLE_ROWS``, in hash order, ids only are sorted):
words and word beginnings are counted by label, documents that are copies of each other counting
as one; those that are more frequent in toxic documents than chance allows among so many are the
lexicon, a beginning in place of its words where it stands for several. What chance allows follows
from the toxic share among documents of like vocabulary (``_groups``), so that a language with more
or fewer toxic documents than others has its own measure. Terms that clean documents also use at
times are weak: they count by weight and by their density only. A logistic regression over the hit
counts calibrates the score. Counting runs on the executors; the driver gets the frequent
terms and the sample's hit counts only, which the sample bounds.

Scoring, one scan without a shuffle, whole texts: the lexicon is a trie, and the automaton of all
words within one or two edits of an entry is intersected with it, state by state as tokens need
them (Schulz and Mihov, "Fast String Correction with Levenshtein Automata", 2002), so a token is
rejected after its first few letters. Entries that are word beginnings match any ending and no
edit. A near miss that occurs in clean labelled documents is an ordinary word and not a hit; an entry
loses an edit only where near misses met in a single clean document are many beside its toxic
documents, because that many more are to be expected (Good and Turing). Words that punctuation joins are also
met one by one, and long runs of letters are searched for entries within them. A hit's window decides how much of it is quotation: quotation marks on both sides within ``WINDOW`` words,
or a word that reports speech before it. The quoted share of a hit counts on its own, with a small
prior weight; the rest counts as abuse.

Labels, language, source and ids are never inputs of a score. Defined results: a null or empty text
is scored from no words; without labels every score is 0; with one label value only every score is
the labels' smoothed mean. Labels that are null or on null ids are ignored; of contradictory labels
for one id the larger counts. Repeated rows get equal scores. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dup import _LOWER, _mix, shingles
from .near_dup import _words as _hashes
from .scratch import Scratch
from .tokens import slices
from .workers import tidy

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
#: Share of a term's documents that must be toxic; from WEAK_SHARE on, and for some multiple of what is due, a term is weak.
LEAST_SHARE = 0.93
WEAK_SHARE, WEAK_TIMES = 0.25, 2.5
#: Groups of like vocabulary, at most, and buckets of words that tell them apart.
GROUPS, BUCKETS = 8, 64
#: Longer words are also searched for entries within them, as are scripts and lines without spaces.
LONG = 40
PREFIXES = range(4, 8)
WINDOW = 6
#: Words from this length on may have one edit, or two.
ONE_EDIT, TWO_EDITS = 5, 10
#: How much of a hit quotation marks on both sides, or a reporting word before it, make a quotation.
MARKED, REPORTED = 0.85, 0.6
#: Near misses met in a single clean document that an entry may have for each of its toxic documents.
SINGLES = 0.05
#: Tokens and their length that a matcher remembers; a bound on memory, without effect on results.
_TOKENS, _TOKEN_CHARS = 250_000, 64

_OPEN, _CLOSE = "\"'“„«‘‹`", "\"'”“»’›`"
REPORTING = frozenset(
    "said says say called calls calling wrote writes quoted quotes quote quoting term word words phrase slur insult insults insulting"
    " dijo dice llamó palabra insulto sagte sagt nannte wort beleidigung dit disait appelé mot insulte".split()
)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W_]+")
_LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


class Automaton:
    """Levenshtein automata of a lexicon, intersected with its trie; states are made when first needed.

    A state is a set of (trie node, edits spent). ``entries`` maps a word to (edits allowed, whether
    any ending may follow).
    """

    def __init__(self, entries: dict[str, tuple[int, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.allowed = [0]  # most edits of any entry below the node
        self.final: list[tuple[int, bool] | None] = [None]
        for word, (edits, open_) in entries.items():
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in word:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                    self.final.append(None)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            old = self.final[node]
            self.final[node] = (max(edits, old[0]), open_ or old[1]) if old else (edits, open_)
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.verdicts: list[int] = []
        self.opened: list[bool] = []
        self.start = self._number(self._closed({(0, 0)}))

    def _closed(self, positions: set[tuple[int, int]]) -> frozenset:
        """With the positions reached by leaving out letters of an entry."""
        todo, seen = list(positions), set(positions)
        while todo:
            node, edits = todo.pop()
            for child in self.children[node].values():
                if edits < self.allowed[child] and (child, edits + 1) not in seen:
                    seen.add((child, edits + 1))
                    todo.append((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in seen:
            least[node] = min(edits, least.get(node, edits))
        return frozenset(least.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            best = 9
            for node, edits in state:
                if self.final[node] and edits <= self.final[node][0]:
                    best = min(best, edits)
            self.verdicts.append(best)
            self.opened.append(any(edits == 0 and self.final[node] and self.final[node][1] for node, edits in state))
        return self.numbers[state]

    def _move(self, number: int, c: str) -> int:
        found = set()
        for node, edits in self.states[number]:
            if (child := self.children[node].get(c)) is not None:
                found.add((child, edits))
            if edits < self.allowed[node]:
                found.add((node, edits + 1))
            for child in self.children[node].values():
                if edits < self.allowed[child]:
                    found.add((child, edits + 1))
        self.moves[number][c] = following = self._number(self._closed(found)) if found else -1
        return following

    def edits(self, word: str) -> int | None:
        """Fewest edits to an entry within its allowance; 0 also for an open entry's beginning; None: no entry."""
        if len(self.states) > 200_000:  # the states are a cache
            self.numbers, self.states, self.moves, self.verdicts, self.opened = {}, [], [], [], []
            self.start = self._number(self._closed({(0, 0)}))
        at = self.start
        for c in word:
            following = self.moves[at].get(c)
            at = self._move(at, c) if following is None else following
            if at < 0:
                return None
            if self.opened[at]:
                return 0
        return self.verdicts[at] if self.verdicts[at] < 9 else None


    def holds(self, word: str) -> bool:
        """Whether an entry of five letters or more stands anywhere in a word, letter by letter."""
        for start in range(len(word)):
            node = 0
            for at in range(start, len(word)):
                node = self.children[node].get(word[at], 0)
                if not node:
                    break
                if self.final[node] and at - start + 1 >= ONE_EDIT:
                    return True
        return False


class Matcher(dict):
    """Raw token to 0 (none), 1 (an entry), 2 (an entry but for edits or lookalike letters) or 2 and a weak term's weight; remembers tokens."""

    def __init__(self, entries: dict[str, tuple[int, bool]], ordinary: frozenset[str], weak: dict[str, float] | None = None):
        super().__init__()
        self.automaton, self.ordinary, self.weak = Automaton(entries), ordinary, weak or {}

    def kind(self, raw: str) -> tuple[float, str]:
        word = _EDGE.sub("", raw.lower())
        if not word:
            return 0, word
        edits = self.automaton.edits(word)
        if edits is None and not word.isalpha():
            shown = _INNER.sub("", raw.lower().translate(_LOOKALIKES))
            if len(shown) >= 4 and not shown.isdigit() and self.automaton.edits(shown) == 0:
                edits, word = 1, shown if shown != word else word
        if edits is not None and not (edits and word in self.ordinary):
            return (2 if edits else 1), word
        if not word.isalpha() and len(parts := [p for p in _INNER.split(word) if p]) > 1:
            inner = [self.kind(p) for p in parts]
            hits = [k for k in inner if 0 < k[0] <= 2]
            if hits:
                return min(hits)
            return max(inner)
        if len(word) > LONG and self.automaton.holds(word):
            return 2, word
        weight = max((self.weak.get(t, 0.0) for t in (word, *(f"{word[:n]}*" for n in PREFIXES))), default=0.0) if self.weak else 0.0
        return (2 + weight if weight else 0), word

    def __missing__(self, raw: str) -> float:
        found = self.kind(raw)[0]
        if len(raw) <= _TOKEN_CHARS:
            if len(self) > _TOKENS:
                self.clear()
            self[raw] = found
        return found


def quotation(tokens: list[str], at: int) -> float:
    """How much of the word at a place is quoted rather than meant, from 0 to 1."""
    before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
    opened = max((i for i, t in enumerate(before) if t[0] in _OPEN), default=-1)
    marked = opened >= 0 and not any(t[-1] in _CLOSE for t in before[opened:-1]) and any(t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in _CLOSE for t in after)
    reported = any(_EDGE.sub("", t.lower()) in REPORTING for t in before[:-1])
    return 1 - (1 - MARKED * marked) * (1 - REPORTED * reported)


FEATURES = 5


def features(matcher: Matcher, text: str | None) -> list[float]:
    """Logarithms of 1 plus: exact abusive hits, misspelt abusive hits, quoted hits; the share of hits in the words; the density of weak terms."""
    tokens = (text or "").split()
    kinds = [matcher[t] for t in tokens] if len(matcher) == 0 else list(map(matcher.__getitem__, tokens))
    exact = near = quoted = weak = 0.0
    if any(kinds):
        for at, kind in enumerate(kinds):
            if kind:
                q = quotation(tokens, at)
                if kind > 2:
                    weak += (kind - 2) * (1 - q)
                    continue
                quoted += q
                exact, near = (exact + 1 - q, near) if kind == 1 else (exact, near + 1 - q)
    hits = exact + near
    return [math.log1p(exact), math.log1p(near), math.log1p(quoted), hits / (hits + 0.002 * len(tokens)) if hits else 0.0, min(4.0, weak / (3 + 0.01 * len(tokens)))]


#: Prior weights of the features, towards which the regression shrinks.
PRIOR = np.array([3.0, 1.5, 0.2, 1.0, 3.0])


class Model:
    """A fitted lexicon and its regression; ``constant`` is the score of all where there was nothing to fit."""

    def __init__(self, entries: dict[str, tuple[int, bool]], ordinary: frozenset[str], weights: np.ndarray, bias: float, constant: float | None = None, weak: dict[str, float] | None = None):
        self.weak = weak or {}
        self.entries, self.ordinary, self.weights, self.bias, self.constant = entries, ordinary, weights, bias, constant
        self._matcher: Matcher | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matcher": None}

    @property
    def matcher(self) -> Matcher:
        if self._matcher is None:
            self._matcher = Matcher(self.entries, self.ordinary, self.weak)
        return self._matcher

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        rows = np.array([features(self.matcher, t) for t in texts]).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip(rows @ self.weights + self.bias, -30, 30)))


def _regression(rows: np.ndarray, labels: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, weights shrunk towards ``PRIOR``, the bias free."""
    x = np.column_stack([rows, np.ones(len(rows))])
    prior = np.append(PRIOR, math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
    shrink = np.append(np.full(FEATURES, strength), 0.01)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + shrink * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    w[:FEATURES] = np.maximum(w[:FEATURES], 0)
    return w[:-1], float(w[-1])


def _words(text: str | None) -> set[str]:
    """A text's words in lower case, and the parts of those that punctuation joins."""
    whole = {w for w in (_EDGE.sub("", t) for t in set((text or "").lower().split())) if w}
    return whole | {p for w in whole if not w.isalpha() for p in _INNER.split(w) if p}


def _terms(words: set[str]) -> set[str]:
    """Whole words, and their beginnings marked by a closing asterisk."""
    return words | {f"{w[:n]}*" for w in words for n in PREFIXES if len(w) > n and w[:n].isalpha()}


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def _buckets(text: str | None) -> np.ndarray:
    """Square roots of the numbers of words in each bucket of word hashes."""
    words = np.array([_hashes[w] for w in (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()], np.uint64)
    return np.sqrt(np.bincount((_mix(words) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)).astype(np.float32)


def _groups(vectors: np.ndarray) -> np.ndarray:
    """Groups of like vocabulary by spherical k-means over bucketed word counts, from seeds far apart."""
    seeds = [int(np.argmax(vectors @ vectors.mean(0)))]
    near = vectors @ vectors[seeds[0]]
    while len(seeds) < GROUPS and near.min() < 0.8:
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[seeds[-1]])
    middle = vectors[seeds]
    for _ in range(20):
        group = np.argmax(vectors @ middle.T, axis=1)
        sums = np.stack([vectors[group == g].sum(0) for g in range(len(seeds))])
        middle = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True))
    return group


def _choose(found: dict[str, tuple[int, int, float]], tried: int) -> list[tuple[float, str]]:
    """Terms more frequent in toxic documents than chance allows among ``tried`` terms, most significant first.

    Of a term: its toxic documents, all its documents, and the toxic share that their groups make likely.
    """
    bar = math.log(max(1, tried))
    out = []
    for term, (t, n, base) in found.items():
        share = t / n
        if share >= min(max(LEAST_SHARE, base), max(WEAK_SHARE, WEAK_TIMES * base)):
            gain = t * math.log(share / base) + ((n - t) * math.log((1 - share) / (1 - base)) if n > t else 0)
            if gain >= bar:
                out.append((gain, term))
    return sorted(out, key=lambda x: (-x[0], x[1]))


def _lexicon(candidates: list[tuple[float, str]], found: dict[str, tuple[int, int, float]]) -> tuple[list[str], dict[str, float]]:
    """Entries and weak terms with their weights: words, and word beginnings that stand for more than their most frequent word alone.

    Among beginnings the most significant is taken, and of equals the longest; a term that a taken beginning covers is left out.
    """
    words = {t for _, t in candidates if not t.endswith("*")}
    most: dict[str, int] = {}
    for w in words:
        for n in PREFIXES:
            most[w[:n]] = max(most.get(w[:n], 0), found[w][0])
    stems: list[str] = []
    for _, stem in sorted(((gain, t[:-1]) for gain, t in candidates if t.endswith("*")), key=lambda x: (-round(x[0], 6), -len(x[1]), x[1])):
        reach = found[f"{stem}*"][0]
        related = [s for s in stems if s.startswith(stem) or stem.startswith(s)]
        if reach >= 1.2 * most.get(stem, 0) and reach >= most.get(stem, 0) + 3 and not related:
            stems.append(stem)
    covered = tuple(stems)
    chosen = [f"{s}*" for s in stems] + sorted(w for w in words if not w.startswith(covered) or not covered)
    chosen = sorted(chosen, key=lambda t: -found[t][0])
    odds = lambda p: math.log(p / (1 - p))
    weak = {t: odds(found[t][0] / found[t][1]) - odds(found[t][2]) for t in chosen if found[t][0] < LEAST_SHARE * found[t][1]}
    return [t for t in chosen if t not in weak], weak


def _allowances(entries: dict[str, tuple[int, bool]], clean: dict[str, int], toxic: dict[str, int]) -> dict[str, tuple[int, bool]]:
    """Entries with as many edits as the near misses in clean documents leave them.

    ``clean`` has the clean documents of each near miss, ``toxic`` the toxic documents of each entry.
    """
    out = {}
    for word, (edits, open_) in entries.items():
        if edits:
            near = Automaton({word: (edits, False)})
            singles = [near.edits(w) for w, n in clean.items() if n <= 1]
            while edits and sum(1 for e in singles if e and e <= edits) > SINGLES * toxic[word]:
                edits -= 1
        out[word] = (edits, open_)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, scratch: Scratch | None = None) -> Model:
    """A model from at most ``sample_rows`` labelled documents outside the held-out quarter."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "toxicity")
    marked = labels.select(F.col(id_col).alias("tox_id"), F.col(label_col).cast("int").alias("tox_label")).where("tox_id is not null and tox_label is not null").where(~held_out(F.col("tox_id")))
    marked = marked.groupBy("tox_id").agg(F.max("tox_label").alias("tox_label")).orderBy(F.xxhash64("tox_id"), "tox_id").limit(sample_rows)
    marked = scratch.save(marked, "marked")
    sample = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(marked), F.col("doc") == F.col("tox_id"))  # at most sample_rows ids
    # one row an id, so that repeated rows cannot outgrow the bound
    sample = sample.groupBy("doc").agg(F.max("text").alias("text"), F.max("tox_label").alias("label"))
    sample = scratch.save(sample.select(F.col("doc").cast("string").alias("doc"), "text", "label"), "sample")

    @tidy
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Three MinHash samples of a document's three-word shingles: copies share all, near copies most; and its words by bucket."""
        for batch in batches:
            least, buckets = [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, 3)
                buckets.append(_buckets(text))
                least.append([int(_mix(found + np.uint64(seed)).min() >> np.uint64(1)) if len(found) else seed for seed in range(3)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([x[i] for x in least], pa.int64()) for i in range(3)), pa.array(buckets, pa.list_(pa.float32()))], names=["doc", "label", "p0", "p1", "p2", "buckets"])

    printed = sample.mapInArrow(prints, "doc string, label int, p0 bigint, p1 bigint, p2 bigint, buckets array<float>").toArrow().to_pydict()  # sample_rows short rows
    n = len(printed["doc"])
    label = dict(zip(printed["doc"], printed["label"]))
    toxic = sum(1 for v in label.values() if v == 1)
    if not n:
        return Model({}, frozenset(), PRIOR, 0.0, 0.0)
    if not 0 < toxic < len(label):
        return Model({}, frozenset(), PRIOR, 0.0, (toxic + 0.5) / (len(label) + 1))
    # one document speaks for a group of copies: the first in at least two of its three groups
    groups: list[dict[tuple, list[str]]] = [defaultdict(list) for _ in range(3)]
    for row in sorted(zip(printed["doc"], printed["label"], printed["p0"], printed["p1"], printed["p2"])):
        for group, p in zip(groups, row[2:]):
            group[(p, row[1])].append(row[0])
    voices = set()
    for doc, bad, *own in zip(printed["doc"], printed["label"], printed["p0"], printed["p1"], printed["p2"]):
        mine = [group[(p, bad)] for group, p in zip(groups, own)]
        if sum(m[0] == doc for m in mine) >= 2:
            voices.add(doc)
    if not voices:
        voices = set(label)
    base = min(0.9, max(0.001, sum(1 for d in voices if label[d] == 1) / len(voices)))
    # the toxic share among documents of like vocabulary, in millionths and drawn to that of all
    speakers = sorted((doc, own) for doc, own in zip(printed["doc"], printed["buckets"]) if doc in voices)
    vectors = np.array([own for _, own in speakers], float)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    group, bad_voice = _groups(vectors), np.array([label[doc] == 1 for doc, _ in speakers], float)
    sizes = np.bincount(group)
    shares = np.clip((np.bincount(group, bad_voice) + 20 * base) / (sizes + 20), 0.001, max(0.5, base))
    due = {doc: round(1e6 * shares[g]) for (doc, _), g in zip(speakers, group.tolist())}

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_, bad, likely = Counter(), Counter(), Counter()
        for batch in batches:
            for doc, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if doc in due:
                    terms = _terms(_words(text))
                    all_.update(terms)
                    for t in terms:
                        likely[t] += due[doc]
                    if mark == 1:
                        bad.update(terms)
        terms = list(all_)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([all_[t] for t in terms], pa.int64()), pa.array([likely[t] for t in terms], pa.int64())], names=["term", "bad", "n", "likely"])

    counted = sample.mapInArrow(count, "term string, bad bigint, n bigint, likely bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("bad", "n", "likely")))
    counted = scratch.save(counted, "terms")
    frequent = counted.where((F.col("bad") >= 3) & (F.col("bad") >= F.lit(WEAK_SHARE) * F.col("n")) & (F.col("bad") * F.lit(1e6) > F.col("likely")))
    found = {t: (b, m, x / (1e6 * m)) for t, b, m, x in frequent.collect()}  # terms of the sample's toxic documents
    candidates = _choose(found, counted.where("n >= 3").count())
    chosen, weak = _lexicon(candidates, found)
    entries: dict[str, tuple[int, bool]] = {}
    for term in chosen:
        word, open_ = term.rstrip("*"), term.endswith("*")
        edits = 0 if open_ or len(word) < ONE_EDIT else 1 if len(word) < TWO_EDITS else 2
        entries[word] = (edits, open_ or entries.get(word, (0, False))[1])

    # near misses in clean documents are ordinary words; the regression sees half of the sample with the other half's list
    @tidy
    def misses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, frozenset())
        for batch in batches:
            words, halves, voiced = [], [], []
            for doc, text, mark in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if mark != 1:
                    for token in set((text or "").split()):
                        kind, word = matcher.kind(token) if matcher[token] else (0, "")
                        if kind == 2:
                            words.append(word)
                            halves.append(xxhash.xxh3_64_intdigest(doc.encode()) & 1)
                            voiced.append(int(doc in due))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(halves, pa.int32()), pa.array(voiced, pa.int64())], names=["word", "half", "n"])

    ordinary: dict[int, set[str]] = {0: set(), 1: set()}
    clean: Counter[str] = Counter()
    for word, half, n in sample.mapInArrow(misses, "word string, half int, n bigint").groupBy("word", "half").agg(F.sum("n")).toLocalIterator():
        ordinary[half].add(word)
        clean[word] += n
    lists = {h: frozenset(ws) for h, ws in ordinary.items()}
    entries = _allowances(entries, clean, {w: found[w][0] for w, (edits, _) in entries.items() if edits})

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = {h: Matcher(entries, lists[1 - h], weak) for h in (0, 1)}
        for batch in batches:
            rows = [features(matchers[xxhash.xxh3_64_intdigest(doc.encode()) & 1], text) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["label", "x"])

    seen = sample.mapInArrow(measure, "label int, x array<double>").toArrow()
    rows = np.array(seen["x"].to_pylist(), float).reshape(-1, FEATURES)
    weights, bias = _regression(rows, np.array(seen["label"].to_pylist(), float) == 1)
    scratch.drop("marked", "sample", "terms")
    return Model(entries, lists[0] | lists[1], weights, bias, weak=weak)


def _scored(model: Model, texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(model.scores(some.to_pylist()) for _, _, some in slices(texts))])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = _scored(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def reject(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scored(model, pc.cast(batch.column(at), pa.string())) < threshold))

    return docs.mapInArrow(run, docs.schema)

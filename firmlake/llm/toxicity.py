"""Toxicity scores from a fuzzy lexicon and the context of its matches (operator 3).

A lexicon of insults and of stems learned from labelled rows forms a trie. Intersected with Levenshtein automata,
it becomes one automaton that reads a word once and says which term it is, with how many edits; its states are
made as words ask for them. Matches are then looked at in a window of words: quotation marks and verbs of saying
speak for quotation, words that address somebody for abuse. A logistic regression turns the counts into a score.

Only a bounded sample of labelled rows outside the held-out fold is learned from. Null and empty texts are scored
as texts without a match. Repeated rows get the same score; of terms that match with as many edits, the first counts.
A row without a doc_id is scored and never learned from. Very long texts are read whole. An empty table gives no rows,
and without labelled rows the lexicon alone is known and every score is the same. Only doc_id and text are read, so
other columns cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlake.llm.common import Memo, bucket, map_rows, scratch, table
from firmlake.llm.learning import labelled_sample, logistic, sigmoid

#: Insults known from the start; learned terms and stems come on top.
LEXICON = ("clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SAYING = frozenset("said says wrote writes called calls quote quoted quotes dit écrit appelle sagte schrieb nannte dijo escribió llamó".split())
ADDRESS = frozenset("you your you're yourself tu toi vous votre du dich dir dein ihr euch tú te usted tus".split())
#: Words on either side of a match that count as its context.
WINDOW = 8
#: Labelled rows learned from at most; learned terms at most; toxic documents that must hold one (once, or twice and
#: more); their share of all that do; and what a clean one counts against it.
SAMPLE_ROWS = 6_000
LEARNED_TERMS = 150
LEARNED_SUPPORT = 3
LEARNED_PRECISION = 0.75
CLEAN_COST = 2
#: Candidates that are weighed against each other, those found in most toxic documents first.
CANDIDATES = 4_000
FEATURES = 9
WORD = re.compile(r"[^\W\d_]+")
#: Words with digits or symbols inside, which WORD takes apart; those without a letter or with nothing else are left out.
MIXED = re.compile(r"\w+(?:[^\w\s]{1,2}\w+)*")
ODD = re.compile(r"[\W\d_]")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")


def edits_allowed(term: str, stem: bool) -> int:
    """A stem stands for many words, so only long ones may be misspelled."""
    return 0 if len(term) < (9 if stem else 5) else 1 if len(term) < 9 or stem else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie; deterministic states are made on demand.

    Two neighbouring letters that change places are one edit: beside nodes of the trie, a state may hold the node behind
    both letters and the one that must still come.

    ``terms``: (text, is a stem) pairs. A stem matches every word that starts with it or with a misspelling of it.
    """

    def __init__(self, terms: list[tuple[str, bool]], most_states: int = 100_000):
        self.terms, self.most_states = terms, most_states
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.room = [0]
        for i, (text, stem) in enumerate(terms):
            node, room = 0, edits_allowed(text, stem)
            self.room[0] = max(self.room[0], room)
            for c in text:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.room.append(0)
                node = self.child[node][c]
                self.room[node] = max(self.room[node], room)
            self.ends[node].append(i)
        self.reset()

    def reset(self) -> None:
        self.ids: dict = {}
        self.sets: list = []
        self.next: list[dict[str, int]] = []
        self.first = self._id(self._closed({0: 0}), None)

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With every node that skipping letters of a term leads to."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                continue
            e = nodes[node] + 1
            for c in self.child[node].values():
                if e <= self.room[c] and e < nodes.get(c, 99):
                    nodes[c] = e
                    todo.append(c)
        return nodes

    def _id(self, nodes: dict[int, int], hit: tuple[int, int] | None) -> int:
        for node, e in nodes.items():
            for i in self.ends[node] if isinstance(node, int) else ():
                if self.terms[i][1] and e <= edits_allowed(*self.terms[i]) and (hit is None or (e, i) < hit):
                    hit = (e, i)
        key = (frozenset(nodes.items()), hit)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append((nodes, hit))
            self.next.append({})
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        nodes, hit = self.sets[state]
        out: dict[int, int] = {}
        for node, e in nodes.items():
            if isinstance(node, tuple):
                to, missing = node
                if letter == missing:
                    out[to] = min(e, out.get(to, 99))
                continue
            for c, to in self.child[node].items():
                behind = self.child[to].get(letter)
                if c != letter and behind is not None and e + 1 <= self.room[behind]:
                    out[behind, c] = min(e + 1, out.get((behind, c), 99))
            if e + 1 <= self.room[node]:
                out[node] = min(e + 1, out.get(node, 99))
            for c, to in self.child[node].items():
                cost = e + (c != letter)
                if cost <= self.room[to] and cost < out.get(to, 99):
                    out[to] = cost
        return self._id(self._closed(out), hit)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best match of a whole word, or None."""
        if len(self.sets) > self.most_states:
            self.reset()
        state = self.first
        for letter in word:
            to = self.next[state].get(letter)
            if to is None:
                to = self.next[state][letter] = self._step(state, letter)
            state = to
            if not self.sets[state][0] and not self.sets[state][1]:
                return None
        nodes, hit = self.sets[state]
        for node, e in nodes.items():
            for i in self.ends[node] if isinstance(node, int) else ():
                if e <= edits_allowed(*self.terms[i]) and (hit is None or (e, i) < hit):
                    hit = (e, i)
        return hit


class Matcher:
    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms, self.automaton = terms, Automaton(terms)
        self.memo = Memo(lambda words: [self.automaton.match(w) or self.masked(w) or 0 for w in words], 400_000)
        self.short: dict[str, int] = {}
        for i, (text, stem) in enumerate(terms):
            if not stem and len(text) == 4:
                for k in range(4):
                    self.short.setdefault(f"{text[:k]}\0{text[k + 1 :]}", i)

    def masked(self, word: str) -> tuple[int, int] | None:
        """A term of four letters, one of them replaced by a digit or symbol."""
        i = self.short.get(ODD.sub("\0", word)) if len(word) == 4 else None
        return None if i is None else (1, i)

    def mixed(self, low: str) -> list[tuple[int, tuple[int, int]]]:
        """(start, match) of words with digits or symbols inside that are a term as a whole, while none of their parts is."""
        spans = [(m.start(), m[0]) for m in MIXED.finditer(low) if not m[0].isalpha() and WORD.search(m[0])]
        found = [(at, w, x) for (at, w), x in zip(spans, self.memo.look([w for _, w in spans])) if x]
        return [(at, x) for at, w, x in found if not any(self.memo.look(WORD.findall(w)))]

    def features(self, text: str | None) -> np.ndarray:
        """exact, misspelled, stem, misspelled stem, quoted and addressed matches (logs), density of words and of stems, whether there is one."""
        out = np.zeros(FEATURES)
        low = (text or "").lower()
        words = WORD.findall(low)
        whole = self.mixed(low)
        found = [x for x in self.memo.look(words) if x] + [x for _, x in whole]
        if not found:
            return out
        exact = sum(1 for e, i in found if not e and not self.terms[i][1])
        stems = sum(1 for e, i in found if not e and self.terms[i][1])
        fuzzy_stems = sum(1 for e, i in found if e and self.terms[i][1])
        tokens = TOKEN.findall(low)
        hits = {k for k, x in enumerate(self.memo.look(tokens)) if x}
        if whole:
            starts = [m.start() for m in TOKEN.finditer(low)]
            hits |= {bisect_left(starts, at) for at, _ in whole}
        marks = np.cumsum([len(t) == 1 and not t.isalpha() for t in tokens])
        quoted = addressed = 0
        for k in hits:
            around = tokens[max(0, k - WINDOW) : k + WINDOW + 1]
            quoted += bool(marks[k] % 2 or not SAYING.isdisjoint(around))
            addressed += not ADDRESS.isdisjoint(around)
        out[:6] = np.log1p([exact, len(found) - exact - stems - fuzzy_stems, stems, fuzzy_stems, quoted, addressed])
        out[6:8] = np.log1p(np.array([exact, stems]) * 300 / (len(words) + 20))
        out[8] = float(exact + stems > 0)
        return out


_MATCHERS: dict[tuple, Matcher] = {}


def matcher(terms: list[tuple[str, bool]]) -> Matcher:
    key = tuple(terms)
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(terms)
    return _MATCHERS[key]


def _terms(text: str | None) -> Counter:
    """How often each word (with a closing mark) and each stem stands in a text."""
    out: Counter = Counter()
    for w, n in Counter(WORD.findall((text or "").lower())).items():
        if len(w) > 2:
            out[w + "$"] += n
            for k in range(3, min(len(w), 10) + 1):
                out[w[:k]] += n
    return out


def learned_terms(sample: DataFrame, most: int = LEARNED_TERMS) -> list[tuple[str, bool]]:
    """Words and stems of the sample that clean documents hardly hold, or hardly repeat, chosen to cover the toxic ones."""
    def counted(batches: Iterator[dict]) -> Iterator[dict]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                for t, n in _terms(text).items():
                    x = seen.setdefault(t, [0, 0, 0, 0])
                    x[int(y)] += 1
                    if n > 1:
                        x[2 + int(y)] += 1
        rows = list(seen.values())
        yield {"term": list(seen), "c1": [x[0] for x in rows], "t1": [x[1] for x in rows], "c2": [x[2] for x in rows], "t2": [x[3] for x in rows]}

    schema = "term string, c1 long, t1 long, c2 long, t2 long"
    counts = map_rows(sample.select("text", "y"), counted, schema).groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c1", "t1", "c2", "t2")])
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("least"), F.col(f"c{k}").alias("clean"), F.col(f"t{k}").alias("toxic")) for k in (1, 2)]))
    good = counts.select("term", kinds.alias("x")).select("term", "x.*").where((F.col("toxic") >= LEARNED_SUPPORT) & (F.col("toxic") >= LEARNED_PRECISION * (F.col("toxic") + F.col("clean"))))
    clean = {(r.term, r.least): r.clean for r in good.orderBy(F.desc(F.col("toxic") - CLEAN_COST * F.col("clean")), "term", "least").limit(CANDIDATES).collect()}
    if not clean:
        return []
    number = {x: i for i, x in enumerate(clean)}

    def holds(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            bits = np.zeros((len(batch["text"]), len(number)), bool)
            for row, text in zip(bits, batch["text"]):
                for t, n in _terms(text).items():
                    for k in (1, 2):
                        if n >= k and (t, k) in number:
                            row[number[t, k]] = True
            yield {"doc_id": batch["doc_id"], "bits": [x.tobytes() for x in np.packbits(bits, axis=1)]}

    # a bit for each candidate of each toxic document of the sample: a few megabytes at most
    held = map_rows(sample.where("y = 1").select("doc_id", "text"), holds, "doc_id long, bits binary").collect()
    in_docs: dict[tuple[str, int], set[int]] = {x: set() for x in clean}
    keys = list(clean)
    for r in held:
        for i in np.flatnonzero(np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=len(keys))):
            in_docs[keys[i]].add(r.doc_id)
    out: dict[tuple[str, bool], None] = {}
    while len(out) < most:
        best = max(in_docs, key=lambda x: (len(in_docs[x]) - CLEAN_COST * clean[x], x[0][-1] == "$", len(x[0]), x))
        covered = set(in_docs[best])
        if len(covered) - CLEAN_COST * clean[best] < LEARNED_SUPPORT:
            break
        out[best[0].rstrip("$"), not best[0].endswith("$")] = None
        for x in in_docs.values():
            x -= covered
    return list(out)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """(terms, weights) learned from at most ``rows`` labelled rows outside the held-out fold."""
    with scratch(docs.sparkSession):
        sample = labelled_sample(docs, labels, "toxic", rows)
        terms = [(w, False) for w in LEXICON]
        terms += [t for t in learned_terms(sample) if t[0] not in LEXICON]

        def run(batches: Iterator[dict]) -> Iterator[dict]:
            m = matcher(terms)
            for batch in batches:
                yield {"doc_id": batch["doc_id"], "y": [int(y) for y in batch["y"]], "x": [m.features(t).tolist() for t in batch["text"]]}

        got = map_rows(sample.select("doc_id", "text", "y"), run, "doc_id long, y int, x array<double>").orderBy("doc_id").collect()
        if len({r.y for r in got}) < 2:
            prior = np.clip(np.mean([r.y for r in got]) if got else 0.0, 0.001, 0.999)
            return terms, np.array([0.0] * FEATURES + [np.log(prior / (1 - prior))])
        return terms, logistic(np.array([r.x for r in got]), np.array([r.y for r in got], float))


def score_toxicity(docs: DataFrame, model: tuple[list[tuple[str, bool]], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, matches) for every row of ``docs``."""
    terms, weights = model

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        m = matcher(terms)
        for batch in batches:
            x = np.array([m.features(t) for t in batch["text"]])
            scores = sigmoid(x @ weights[:-1] + weights[-1])
            yield {"doc_id": batch["doc_id"], "score": scores, "matches": np.rint(np.expm1(x[:, :4]).sum(1)).astype(np.int64)}

    got = map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double, matches long")
    return got.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))

"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Nodes are the words that hold a digit or ``@``; a hard factor labels every other word as nothing, so it drops out of the
graph exactly. Chain edges join neighbouring nodes. Skip edges join words of one key (the last seven digits, or the word in
lower case): each to the next one, but words outside base matches to the nearest one inside where the group has any, so that a
repeat costs an edge and evidence need not travel through a long group. All skip edges share one potential, as do all chain
edges: of one kind, both nothing, of different kinds, one nothing. Words that a base match covers are clamped to its kind.
Loopy belief propagation runs over the documents of a batch at once, each until its messages settle; words outside base matches
whose marginal for a kind reaches ``SURE`` become spans.

The potentials are fitted by pseudo-likelihood over all documents, as counts of equal cases. The base matches are the labels.
What they miss is not known to be nothing, so words that share a key with a base match are left out, and for every base match a
repeat is added whose label is hidden from the patterns: the same word in another notation, to be told by its skip edge alone.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import slices

KINDS = ("email", "ip", "card", "phone")
#: Steps of the fit, its rate, and the pull of all weights towards 0.
STEPS, RATE, DECAY = 2000, 0.5, 1e-4
#: Messages have settled when none changes by more; a document that has not after ``ROUNDS`` is marked.
SETTLED, ROUNDS = 1e-5, 2000
SURE = 0.9
CHUNK_BYTES = 8 << 20

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits matches from its first one or not at all
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile("[0-9@]")
WORD_END = re.compile(r"[\x20\x09-\x0D]")
DIGIT = re.compile("[0-9]")
TRIM = "\"'.,;:!?()[]{}<>"
GAP = re.compile(r"[\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches hold one @ each: the run of local characters before it, then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of all base matches, by kind, then start; in code points."""
    out = [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _words(text: str) -> Iterator[tuple[int, int]]:
    """Words that hold a digit or @."""
    pos = 0
    while m := MARK.search(text, pos):
        start = m.start()
        while start > pos and not WORD_END.match(text, start - 1):
            start -= 1
        end = e.start() if (e := WORD_END.search(text, m.end())) else len(text)
        yield start, end
        pos = end


FEATURES = 16


def _shape(word: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    return [
        1.0, "@" in word, word.count("@") == 1 and "." in word.partition("@")[2], word.count(".") == 3 and not letters, word[:1] == "+",
        "(" in word or ")" in word, "-" in word and not letters, "=" in word, letters > 0, letters > digits,
        digits <= 3, 4 <= digits <= 6, 7 <= digits <= 9, 10 <= digits <= 15, 16 <= digits <= 19, digits > 19,
    ]


def _key(word: str) -> str | None:
    low = word.strip(TRIM).lower()
    if "@" in low:
        return low
    digits = re.sub("[^0-9]", "", low)
    return digits[-7:] if len(digits) >= 7 else low if len(low) >= 4 else None


def _bits(word: str) -> int:
    return sum(1 << i for i, f in enumerate(_shape(word)) if f)


def _renoted(word: str, kind: int) -> str:
    """A base match's word as its pattern would not find it: an address without its end, other numbers with dashes only."""
    if kind == 1:
        return word.rpartition(".")[0] or word
    return "-".join(re.findall("[0-9]+", word)) or word


@dataclass
class Graph:
    """The nodes of some documents: document, place, word, base kind (0: none, else 1 + kind); edges of both sorts."""

    doc: list
    place: list
    word: list
    base: list
    key: list
    chain: list
    skip: list

    @staticmethod
    def of(texts: list[tuple[str, list]]) -> Graph:
        g = Graph([], [], [], [], [], [], [])
        for d, (text, spans) in enumerate(texts):
            first, before, spans = len(g.doc), None, sorted((x, y, kind) for kind, x, y in spans)
            at, groups = 0, {}
            for a, b in _words(text):
                i = len(g.doc)
                while at < len(spans) and spans[at][1] <= a:
                    at += 1
                kind, key = 0, _key(text[a:b])
                for x, y, k in itertools.islice(spans, at, None):
                    if x >= b:
                        break
                    if y > a and (not kind or k + 1 < kind):
                        kind = k + 1
                        # a match of several words is known by its last one
                        key = _key(text[x:y]) if y <= b else None
                g.doc.append(d)
                g.place.append((a, b))
                g.word.append(text[a:b])
                g.base.append(kind)
                g.key.append(key)
                if before is not None and GAP.fullmatch(text, before, a):
                    g.chain.append((i - 1, i))
                before = b
                if key is not None:
                    groups.setdefault(key, []).append(i)
            near = {e for e in g.chain if e[0] >= first}
            for own in groups.values():
                held = [i for i in own if g.base[i]]
                edges = set(zip(held, held[1:]) if held else zip(own, own[1:]))
                if held:
                    for i, k in zip(own, np.searchsorted(held, own).tolist()):
                        if not g.base[i]:
                            beside = [held[j] for j in (k - 1, k) if 0 <= j < len(held)]
                            hub = min(beside, key=lambda j: (abs(j - i), j))
                            edges.add((min(i, hub), max(i, hub)))
                g.skip += sorted(edges - near)
        return g

    def cases(self) -> tuple[np.ndarray, np.ndarray]:
        """What the fit sees: (shape, label, labels of chain neighbours, of skip neighbours) as rows of numbers, and their counts."""
        size = len(KINDS) + 1
        told = {(d, k) for d, k, y in zip(self.doc, self.key, self.base) if y and k is not None}
        hidden = [not y and (d, k) in told for d, k, y in zip(self.doc, self.key, self.base)]
        near = np.zeros((2, len(self.doc), size), np.int64)
        for n, edges in zip(near, (self.chain, self.skip)):
            for i, j in edges:
                if not hidden[i] and not hidden[j]:
                    n[i, self.base[j]] = min(n[i, self.base[j]] + 1, 2)
                    n[j, self.base[i]] = min(n[j, self.base[i]] + 1, 2)
        rows = []
        for i, (word, y) in enumerate(zip(self.word, self.base)):
            if hidden[i]:
                continue
            rows.append((_bits(word), y, *near[0, i], *near[1, i]))
            if self.key[i] is not None:
                alone, repeat = [0] * size, [0] * size
                repeat[y] = 1
                bits = _bits(_renoted(word, y) if y else word)
                # beside up to two words that are nothing
                for beside in ([n, *alone[1:]] for n in range(3)):
                    rows.append((bits, y, *beside, *repeat))
                    if y:
                        # without a match to tell it by, such a word is nothing, be it repeated or not
                        rows += [(bits, 0, *beside, n, *alone[1:]) for n in range(3)]
        return np.unique(np.array(rows, np.int64).reshape(len(rows), 2 + 2 * size), axis=0, return_counts=True)


@dataclass(frozen=True)
class Potentials:
    shape: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _ties(near: np.ndarray) -> np.ndarray:
    """For counts of neighbours by label, what the four shared weights of an edge add to each label: (cases, labels, weights)."""
    kinds = near[:, 1:].sum(axis=1)
    out = np.zeros((len(near), near.shape[1], 4))
    out[:, 0, 1], out[:, 0, 3] = near[:, 0], kinds
    out[:, 1:, 0], out[:, 1:, 2], out[:, 1:, 3] = near[:, 1:], kinds[:, None] - near[:, 1:], near[:, :1]
    return out


def fit(cases: np.ndarray, counts: np.ndarray) -> Potentials:
    """Pseudo-likelihood: each label given its word's shape and its neighbours' labels, by accelerated gradient ascent."""
    size = len(KINDS) + 1
    w, edge = np.zeros((FEATURES, size)), np.zeros(8)
    if len(cases):
        x = (cases[:, :1] >> np.arange(FEATURES) & 1).astype(float)
        hot = np.eye(size)[cases[:, 1]]
        ties = np.concatenate((_ties(cases[:, 2 : 2 + size]), _ties(cases[:, 2 + size :])), axis=2)
        mass = counts / counts.sum()
        v, ve = np.zeros_like(w), np.zeros_like(edge)
        for _ in range(STEPS):
            z = x @ w + ties @ edge
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            miss = (hot - p) * mass[:, None]
            v = 0.9 * v + RATE * (x.T @ miss - DECAY * w)
            ve = 0.9 * ve + RATE * (np.einsum("cl,clw->w", miss, ties) - DECAY * edge)
            w, edge = w + v, edge + ve
    pair = []
    for same, none, differ, mixed in edge.reshape(2, 4):
        m = np.full((size, size), differ)
        np.fill_diagonal(m, same)
        m[0, :] = m[:, 0] = mixed
        m[0, 0] = none
        pair.append(m)
    return Potentials(w, *pair)


def infer(g: Graph, w: Potentials) -> tuple[np.ndarray, np.ndarray]:
    """Marginals by synchronous loopy belief propagation, nodes in base matches clamped; which nodes' documents have settled."""
    shape = np.array([_bits(x) for x in g.word])[:, None] >> np.arange(FEATURES) & 1
    unary = shape @ w.shape
    fixed, doc = np.array(g.base), np.array(g.doc)
    held = np.flatnonzero(fixed)
    unary[held] = -1e9
    unary[held, fixed[held]] = 1e9
    open_ = np.zeros(len(doc), bool)
    edges = [(np.array(e), m) for e, m in ((g.chain, w.chain), (g.skip, w.skip)) if e]
    if edges:
        ends = np.concatenate([e for e, _ in edges])
        src, dst = np.concatenate((ends[:, 0], ends[:, 1])), np.concatenate((ends[:, 1], ends[:, 0]))
        pair = np.concatenate([np.broadcast_to(m, (len(e), *m.shape)) for e, m in edges] * 2)
        back = np.concatenate((np.arange(len(ends), len(src)), np.arange(len(ends))))
        sent = np.zeros((len(src), unary.shape[1]))
        active = np.arange(len(src))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst[active], sent[active])
            out = belief[src[active]] - sent[back[active]]
            z = out[:, :, None] + pair[active]
            top = z.max(axis=1)
            new = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
            new = 0.5 * sent[active] + 0.5 * (new - new.max(axis=1, keepdims=True))
            moved = np.zeros(doc[-1] + 1)
            np.maximum.at(moved, doc[src[active]], np.abs(new - sent[active]).max(axis=1))
            sent[active] = new
            # a document is done on its own, whatever else is in the batch
            active = active[moved[doc[src[active]]] > SETTLED]
            if not len(active):
                break
        open_ = np.isin(doc, doc[src[active]])
        np.add.at(unary, dst, sent)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), ~open_


def added_spans(g: Graph, marginals: np.ndarray, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each document the spans of words outside base matches that are surely of a kind; neighbours of a kind are one span."""
    out: list[list] = [[] for _ in texts]
    joined = {j for _, j in g.chain}
    last = None
    for i, (d, (a, b)) in enumerate(zip(g.doc, g.place)):
        k = int(marginals[i].argmax())
        if g.base[i] or not k or marginals[i, k] < SURE:
            continue
        word = texts[d][a:b]
        a, b = a + len(word) - len(word.lstrip(TRIM)), b - len(word) + len(word.rstrip(TRIM))
        if a >= b:
            continue
        if last == (d, k, i - 1) and i in joined:
            out[d][-1] = (k - 1, out[d][-1][1], b)
        else:
            out[d].append((k - 1, a, b))
        last = (d, k, i)
    return out


def _cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK_BYTES):
        g = Graph.of([(t, base_spans(t)) for t in part.column("text").to_pylist() if t and MARK.search(t)])
        if g.doc:
            rows, counts = g.cases()
            yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["case", "n"])


def train(docs: DataFrame) -> Potentials:
    """Potentials from all documents: equal cases are counted, and as many rows as there are different ones reach the driver,
    a number that shapes, labels and at most two neighbours of a label bound, whatever the corpus."""
    rows = docs.select("text").mapInArrow(_cases, "case array<bigint>, n bigint").groupBy("case").agg(F.sum("n").alias("n")).orderBy("case").collect()
    size = 2 + 2 * (len(KINDS) + 1)
    return fit(np.array([r["case"] for r in rows], np.int64).reshape(len(rows), size), np.array([float(r["n"]) for r in rows]))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, settled): spans array<struct<kind, start, stop, base>> by kind, then start; offsets in code points, stop exclusive.

    Every row is searched whole; null and empty texts have no spans; repeated rows repeat; other columns are ignored; an
    empty table gives an empty one. A base match is never dropped or changed. ``settled`` is false where messages still changed
    after ``ROUNDS``.
    """
    plain = docs.select("doc_id", "text")
    weights = train(plain)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            found = [[(k, a, b, True) for k, a, b in base_spans(t)] for t in texts]
            marked = [i for i, t in enumerate(texts) if MARK.search(t)]
            settled = [True] * len(texts)
            g = Graph.of([(texts[i], [x[:3] for x in found[i]]) for i in marked])
            if g.doc:
                marginals, done = infer(g, weights)
                for i, more in zip(marked, added_spans(g, marginals, [texts[i] for i in marked])):
                    found[i] += [(*x, False) for x in more]
                for d in {g.doc[k] for k in np.flatnonzero(~done)}:
                    settled[marked[d]] = False
            rows = [[{"kind": KINDS[k], "start": a, "stop": b, "base": base} for k, a, b, base in sorted(own)] for own in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(item)), pa.array(settled)], names=["doc_id", "spans", "settled"])

    return plain.mapInArrow(run, f"doc_id {dict(plain.dtypes)['doc_id']}, spans array<struct<kind:string,start:int,stop:int,base:boolean>>, settled boolean")


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`find`; the counts are of base matches, ``n_added`` counts the others, ``n_spans`` all."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    n = F.size("spans").cast("long")
    return find(docs).withColumn("base", base).select(
        "doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), (n - F.size("base")).cast("long").alias("n_added"), n.alias("n_spans"), "settled"
    )

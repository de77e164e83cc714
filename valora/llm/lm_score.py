"""Language-model scores: causal self-attention over subword ids, beside a unigram base.

Base. Words (A-Z lowered) of every document are hashed, counted per document and
packed into bins by hash; a bin adds up the training documents' counts of its
words and gives each document its words' share of the score. Nothing but sums
leaves a bin, so the vocabulary is never in one place. Words that nearly every
document has would fill a bin each: the FREQUENT most frequent ones of a bounded
sample of documents are counted in all training documents without any shuffle of
their occurrences, as one sum per task, and never go to bins. Which words these
are changes no result.

Model. Every word's subword ids come from a public tokenizer, each word with its
leading blank, and a text ends with the end id. One layer of causal attention
(bias by distance, queries, keys and values from tables by id) gives a
distribution over CLASSES: the most frequent ids alone, the others by whether
they begin a word and by frequency. Classes are in GROUPS of MEMBERS by frequency,
P(class) = P(group) P(class | group), so a place costs GROUPS + MEMBERS scores.
Scores begin with the logs of how often each class follows the id before it, in
all training documents (smoothed), and the attention layer adds what the further
context says. Within a class ids have the add-one share of their counts in all
training documents. So the model's probabilities of all ids add up to one,
whatever the context.

The attention layer is trained in numpy: STEPS steps on a bounded sample (at most
SAMPLE documents, those with the smallest hashes, and SAMPLE_WINDOWS windows of
each) give a start that all tasks share; from it each task takes a step for every
BATCH of its windows, and the tasks' weights are averaged by their windows. All
windows of all training documents take part. So counts, documents, windows and steps follow the input.
Which rows share a task changes the weights a little.

Every text is tokenised once and its ids are stored; counting, learning and
scoring read them. Scoring cuts a text into windows of CONTEXT + STEP inputs that
overlap by CONTEXT; each id is scored once, in the window in which it is among
the last STEP ones.

Null texts are empty and have one token, the end. Ids are integers (see id_of);
null ids count as the empty text for choosing training documents. Other columns
of the input are not read. Without training documents all counts are
0, the base is log10(1) for every token and the model gives every id the same
probability. Repeated rows count as documents of their own.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from valora.llm import _bins as B, _kernel as K, _spark as S

INPUTS, GROUPS, MEMBERS, RARE_BANDS, WIDTH, KEYS, CONTEXT, STEP = 2048, 16, 14, 6, 32, 8, 8, 24
CLASSES = GROUPS * MEMBERS
#: Columns of a place's scores: groups, members, and none up to a width that matrix products are fast for.
SCORES = 32
#: Counts that smooth the shares of classes after an input.
SMOOTH = 500.0
#: Columns of a state: WIDTH and a one, so that constants are rows of the matrices that states are multiplied with.
HALF = WIDTH + 1
#: A score so low that its share of attention is exactly zero.
OUT = -1000.0
_ONES, _TINY = np.ones(64, np.float32), np.float32(1e-37)
#: Adds up the scores of groups and those of members.
_BOTH = np.repeat(np.eye(3, 2, dtype=np.float32), (GROUPS, MEMBERS, SCORES - GROUPS - MEMBERS), axis=0)
#: Rows of a list that are added up at once.
TOGETHER = 16
SAMPLE, SAMPLE_WINDOWS, STEPS, BATCH, RATE, LATER_RATE = 900, 48, 900, 192, 0.015, 0.0015
WINDOWS_AT_ONCE, IDS_AT_ONCE = 192, 1 << 18
#: Words kept out of the bins, and documents that they are looked for in.
FREQUENT, FREQUENT_SAMPLE = 16_384, 2000
BEGIN, END = 1, 2
#: How ids are stored; the tokenizer has fewer than this holds.
KIND = np.uint16


class Subwords:
    """Subword ids of words by a sentencepiece model, kept in an open hash table of word hashes."""

    FEW, MOST = 1 << 16, 1 << 21  # slots at first, and before the table starts anew

    def __init__(self, path: str, frequent: np.ndarray | None = None):
        import sentencepiece

        self.frequent = np.zeros(0, np.uint64) if frequent is None else frequent
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        if self.size > np.iinfo(KIND).max:
            raise ValueError("the tokenizer has more pieces than ids are stored for")
        self.clear()

    def clear(self) -> None:
        self.SLOTS = self.FEW
        self.key, self.word = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.at, self.length, self.place, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.n_words = self.n_ids = 0

    def starts_word(self) -> np.ndarray:
        return np.array([self.model.id_to_piece(k).startswith("▁") for k in range(self.size)])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's word, -1 where it is new."""
        out = np.full(len(h), -1, np.int32)
        rest, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(rest):
            word = self.word[slot]
            same = (word >= 0) & (self.key[slot] == h[rest])
            out[rest[same]] = word[same]
            on = (word >= 0) & ~same
            rest, slot = rest[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def add(self, h: np.ndarray, words: list[str]) -> None:
        """New hashes, each once, and their words."""
        found = self.model.encode(words, num_threads=1)
        length = np.array([len(x) for x in found], np.int32)
        flat = np.array([i for x in found for i in x], np.int32)
        n, m = self.n_words + len(h), self.n_ids + len(flat)
        while n > len(self.at):
            self.at, self.length, self.place = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.place))
        while m > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : m] = flat
        self.length[self.n_words : n] = length
        self.place[self.n_words : n] = K.place_in(h, self.frequent)
        self.at[self.n_words : n] = self.n_ids + np.cumsum(length) - length
        self.place_all(h, np.arange(self.n_words, n, dtype=np.int32))
        self.n_words, self.n_ids = n, m

    def place_all(self, h: np.ndarray, number: np.ndarray) -> None:
        rest, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(rest):
            free = self.word[slot] < 0
            self.word[slot[free]] = number[rest[free]]  # of several for one slot the last one wins
            won = free & (self.word[slot] == number[rest])
            self.key[slot[won]] = h[rest[won]]
            rest, slot = rest[~won], (slot[~won] + 1) & (self.SLOTS - 1)

    def numbers(self, data: np.ndarray, w: K.Words, h: np.ndarray) -> np.ndarray:
        """The number of each word of a block. The table is kept half empty: it grows up to MOST slots, then starts anew."""
        if self.n_words + len(h) > self.MOST // 2 and self.n_words:
            self.clear()
        if self.n_words + len(h) > self.SLOTS // 2:
            old, used = self.key, self.word >= 0
            number, h_old = self.word[used], old[used]
            while self.n_words + len(h) > self.SLOTS // 2:
                self.SLOTS *= 2
            self.key, self.word = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
            self.place_all(h_old, number)
        number = self.find(h)
        new = np.flatnonzero(number < 0)
        if len(new):
            found, first = np.unique(h[new], return_index=True)
            raw = K.LOWER[data].tobytes()
            at = new[first]
            self.add(found, [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            number[new] = self.find(h[new])
        return number

    def sequences(self, data: np.ndarray, w: K.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' ids, each with END after it, where they begin, and each word's place among the frequent ones."""
        n = len(w.at) - 1
        if not len(h):
            return np.full(n, END, np.int32), np.arange(n + 1), np.zeros(0, np.int32)
        number = self.numbers(data, w, h)
        length = self.length[number]
        ends = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
        nth = np.arange(ends[-1]) - np.repeat(ends[:-1], length)
        out = np.full(ends[-1] + n, END, np.int32)
        out[np.repeat(ends[:-1] + w.doc(), length) + nth] = self.ids[np.repeat(self.at[number], length) + nth]
        return out, ends[w.at] + np.arange(n + 1), self.place[number]


_tables: dict[str, Subwords] = {}


def subwords(path: str, frequent: np.ndarray | None = None) -> Subwords:
    """The worker's table for a tokenizer file: it outlives a task, as the worker does. Other frequent words start it anew."""
    frequent = np.zeros(0, np.uint64) if frequent is None else frequent
    table = _tables.get(path)
    if table is None:
        table = _tables[path] = Subwords(path, frequent)
    elif not np.array_equal(table.frequent, frequent):
        table.frequent = frequent
        table.clear()
    return table


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences beginning at ``at``: each window's sequence, its first scored place, and the sequence's end."""
    size = np.diff(at)
    n = -(-size // STEP)
    seq = np.repeat(np.arange(len(size)), n)
    first = at[:-1][seq] + STEP * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    return seq, first, at[1:][seq]


def keep_buffers() -> None:
    """Freed arrays of a worker stay with it for its next ones, where the C library allows it: steps and scores
    use the same few sizes again and again, and giving pages back each time costs more than the arithmetic."""
    import ctypes

    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        # The numbers of M_MMAP_THRESHOLD, M_TRIM_THRESHOLD and M_TOP_PAD.
        for option, nbytes in ((-3, 32 << 20), (-1, 256 << 20), (-2, 32 << 20)):
            mallopt(option, nbytes)


class Attention:
    """P(group | ids before) and P(class | group, ids before) with one causal attention layer, and P(id | class)."""

    def __init__(self, counts: np.ndarray, starts_word: np.ndarray):
        self.frequent, self.frequent_counts, self.learned, self.rate = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, LATER_RATE
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        self.input = np.minimum(rank, INPUTS - 3).astype(np.int32)
        self.begin, self.pad = INPUTS - 2, INPUTS - 1
        single = CLASSES - 2 * RARE_BANDS
        share = np.cumsum(counts[order] + 1)[rank]
        low = float(share[order[single - 1]]) if len(counts) > single else 0.0
        band = np.clip((RARE_BANDS * (share - low) / max(share.max() - low, 1e-9)).astype(int), 0, RARE_BANDS - 1)
        self.cls = np.where(rank < single, rank, single + 2 * band + starts_word).astype(np.int32)
        total = np.bincount(self.cls, weights=counts + 1.0, minlength=CLASSES)
        self.within = np.log((counts + 1.0) / total[self.cls]).astype(np.float32)
        rng = np.random.default_rng(23)
        draw = lambda *shape, s=0.1: (rng.standard_normal(shape) * s).astype(np.float32)
        # tables by id: what a place asks (embedding, one, query, one) and what it gives (value, zero, key, padding).
        # The four fixed columns add the scores' constants and take padding out of the softmax.
        ask, give = np.ones((INPUTS, HALF + KEYS + 1), np.float32), np.zeros((INPUTS, HALF + KEYS + 1), np.float32)
        ask[:, :WIDTH], ask[:, HALF:-1] = draw(INPUTS, WIDTH), draw(INPUTS, KEYS)
        give[:, :WIDTH], give[:, HALF:-1] = draw(INPUTS, WIDTH, s=0.02), draw(INPUTS, KEYS)
        give[self.pad, -1] = OUT
        to_group, to_class = draw(HALF, GROUPS), draw(GROUPS, HALF, MEMBERS)
        to_group[-1], to_class[:, -1] = 0, 0
        self.share = total / total.sum()
        self.follow(np.zeros(INPUTS * CLASSES))
        self.p = {"ask": ask, "give": give, "lag": np.zeros(CONTEXT + STEP, np.float32), "G": to_group, "M": to_class}
        i, j = np.arange(STEP)[:, None] + CONTEXT, np.arange(CONTEXT + STEP)[None, :]
        self.lag = np.where(j <= i, i - j, 0)
        self.later = np.where(j <= i, 0, OUT).astype(np.float32)

    def pairs(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each id the cell of the input before it and its class."""
        before = np.empty(len(ids), np.int64)
        before[1:] = self.input[ids[:-1]]
        before[at[:-1]] = self.begin
        return before * CLASSES + self.cls[ids]

    def follow(self, counts: np.ndarray) -> None:
        """counts: how often each class follows each input, in all training documents. Their smoothed shares are what the
        attention layer starts from: logs of P(group | input before) and P(class | group, input before)."""
        n = counts.reshape(INPUTS, CLASSES) + SMOOTH * self.share
        by_group = n.reshape(INPUTS, GROUPS, MEMBERS).sum(2)
        logs = lambda part, whole: np.where(part > 0, np.log(np.maximum(part, 1e-30) / np.maximum(whole, 1e-30)), -60).astype(np.float32)
        # for each input and group of the target: the groups' logs, then the members'
        self.logs = np.full((INPUTS, GROUPS, SCORES), OUT, np.float32)
        self.logs[:, :, :GROUPS] = logs(by_group, by_group.sum(1, keepdims=True))[:, None, :]
        self.logs[:, :, GROUPS : GROUPS + MEMBERS] = logs(n.reshape(INPUTS, GROUPS, MEMBERS), by_group[:, :, None])

    def inputs(self, ids: np.ndarray, at: np.ndarray, seq: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of CONTEXT + STEP inputs: the id before each place, BEGIN before a text, padding elsewhere."""
        lead = CONTEXT + STEP  # every text with padding around it, so that a window is a stretch of it
        shift = lead * (np.arange(len(at) - 1) + 1)
        row = np.full(len(ids) + lead * len(at), self.pad, np.int32)
        row[np.arange(len(ids)) + np.repeat(shift, np.diff(at)) + 1] = self.input[ids]
        row[at[:-1] + shift] = self.begin
        row[at[1:] + shift] = self.pad  # a text's last id is no input
        return row[(first + shift[seq] - CONTEXT)[:, None] + np.arange(lead, dtype=np.int32)[None, :]]

    def attend(self, x: np.ndarray):
        """Shares of attention, what was asked and given, what came of them, and the state of each of the last STEP places."""
        ask, give = self.p["ask"].take(x[:, CONTEXT:], axis=0), self.p["give"].take(x, axis=0)
        s = ask[:, :, HALF:] @ give[:, :, HALF:].transpose(0, 2, 1).copy()  # products of small matrices are slow turned
        s += self.p["lag"][self.lag] + self.later
        if s.max(initial=0) > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        s *= 1 / (s @ _ONES[: CONTEXT + STEP] + np.float32(1e-20))[:, :, None]
        got = s @ give[:, :, :HALF]
        return s, ask, give, got, (got + ask[:, :, :HALF]).reshape(-1, HALF)

    def outputs(self, h: np.ndarray, before: np.ndarray, target: np.ndarray):
        """Rows in the order of their targets' groups: that order, their states, the exponentials of the groups' and of
        the own group's members' scores side by side, the flat places of the targets' among these, the groups' stretches,
        and by group the matrix that states are multiplied with."""
        group = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        parts = [(k, slice(edges[k], edges[k + 1])) for k in range(GROUPS) if edges[k] < edges[k + 1]]
        weights = np.zeros((GROUPS, HALF, SCORES), self.p["M"].dtype)
        weights[:, :, :GROUPS], weights[:, :, GROUPS : GROUPS + MEMBERS] = self.p["G"], self.p["M"]
        h, cell, target = h.take(order, axis=0), (before * GROUPS + group).take(order), target.take(order)
        scores = self.logs.reshape(-1, SCORES).take(cell, axis=0)
        for k, part in parts:
            scores[part] += h[part] @ weights[k]
        if scores.max(initial=0) > 60:
            np.minimum(scores, 60, out=scores)
        np.exp(scores, out=scores)
        right = np.arange(0, scores.size, SCORES) + target // MEMBERS, np.arange(GROUPS, scores.size, SCORES) + target % MEMBERS
        return order, h, scores, right, parts, weights

    def log_classes(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the target classes, windows by STEP."""
        order, _, scores, right, _, _ = self.outputs(self.attend(x)[-1], x[:, CONTEXT:].ravel(), target.ravel())
        whole, out = scores @ _BOTH, np.empty(len(order), np.float32)
        got = [np.log(np.maximum(scores.ravel().take(at), _TINY)) - np.log(whole[:, k]) for k, at in enumerate(right)]
        out[order] = got[0] + got[1]
        return out.reshape(target.shape)

    def gradients(self, xb: np.ndarray, target: np.ndarray, scored: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, ask, give, got, h = self.attend(xb)
        order, h, scores, right, parts, weights = self.outputs(h, xb[:, CONTEXT:].ravel(), target.ravel())
        weight = (scored.ravel().take(order) / max(scored.sum(), 1)).astype(np.float32)
        # exponentials become the loss's gradient by scores
        scores *= (weight[:, None] / (scores @ _BOTH)) @ _BOTH.T
        for at in right:
            scores.reshape(-1)[at] -= weight
        back, by_weights, turned = np.empty((len(h), WIDTH), h.dtype), np.zeros_like(weights), weights[:, :WIDTH].transpose(0, 2, 1).copy()
        for k, part in parts:
            np.matmul(h[part].T, scores[part], out=by_weights[k])
            np.matmul(scores[part], turned[k], out=back[part])
        g = {"G": by_weights[:, :, :GROUPS].sum(0), "M": np.ascontiguousarray(by_weights[:, :, GROUPS : GROUPS + MEMBERS])}
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        # a state's gradient, and what the softmax takes off the gradients of its scores, which stands beside a one
        dh = np.empty((len(xb), STEP, HALF), h.dtype)
        dh[:, :, :WIDTH] = back.take(place, axis=0).reshape(len(xb), STEP, WIDTH)
        dh[:, :, WIDTH] = 0
        got *= dh
        dh[:, :, WIDTH] = got @ -_ONES[:HALF]
        turned = np.ones((len(xb), HALF, CONTEXT + STEP), give.dtype)
        turned[:, :WIDTH] = give[:, :, :WIDTH].transpose(0, 2, 1)
        ds = dh @ turned
        ds *= s
        # by input: gradients of its value and key, and, beyond the context, of its embedding and query
        d = np.empty((*xb.shape, 2 * (WIDTH + KEYS)), h.dtype)
        give_d, ask_d = d[:, :, : WIDTH + KEYS], d[:, CONTEXT:, WIDTH + KEYS :]
        d[:, :CONTEXT, WIDTH + KEYS :] = 0
        ask_d[:, :, :WIDTH] = dh[:, :, :WIDTH]
        np.matmul(s.transpose(0, 2, 1), dh[:, :, :WIDTH], out=give_d[:, :, :WIDTH])
        np.matmul(ds, give[:, :, HALF:-1], out=ask_d[:, :, WIDTH:])
        np.matmul(ds.transpose(0, 2, 1), ask[:, :, HALF:-1], out=give_d[:, :, WIDTH:])
        found, rows = _scattered(xb, d)
        for k, part in (("give", rows[:, : WIDTH + KEYS]), ("ask", rows[:, WIDTH + KEYS :])):
            wide = np.zeros((len(found), p[k].shape[1]), p[k].dtype)  # the fixed columns keep 0
            wide[:, :WIDTH], wide[:, HALF:-1] = part[:, :WIDTH], part[:, WIDTH:]
            g[k] = np.zeros_like(p[k])
            g[k][found] = wide
        g["lag"] = np.bincount(self.lag.ravel(), weights=ds.sum(0).ravel(), minlength=CONTEXT + STEP).astype(np.float32)
        return g

    def fit(self, x: np.ndarray, target: np.ndarray, scored: np.ndarray) -> None:
        rng, adam = np.random.default_rng(29), Adam()
        for step in range(STEPS if len(x) else 0):
            rows = rng.integers(0, len(x), BATCH)
            adam.step(self.p, self.gradients(x[rows], target[rows], scored[rows]), RATE * min(1.0, (step + 1) / 20) * (1 - 0.9 * step / STEPS))

    def learn(self, found) -> int:
        """One step for every BATCH of the windows of ``found`` (arrays of windows()), each taken once; how many they were."""
        rng, adam, total, rest = np.random.default_rng(31), Adam(), 0, None

        def step(rows: np.ndarray) -> None:
            target = rows[:, CONTEXT + STEP :]
            rate = self.rate * min(1.0, (adam.steps + 1) / 20) * len(rows) / BATCH
            adam.step(self.p, self.gradients(rows[:, : CONTEXT + STEP], np.maximum(target, 0), (target >= 0).astype(np.float32)), rate)

        for both in found:
            total += len(both)
            both = both[rng.permutation(len(both))]
            both = both if rest is None else np.concatenate([rest, both])
            full = len(both) - len(both) % BATCH
            for lo in range(0, full, BATCH):
                step(both[lo : lo + BATCH])
            rest = both[full:]
        if rest is not None and len(rest):
            step(rest)
        return total

    def windows(self, ids: np.ndarray, at: np.ndarray, skip: np.ndarray | None = None, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Each window's sequence, and its inputs followed by its target classes, -1 beyond the sequence's end. With
        ``every`` one window of so many of each sequence, and one at least, from a place that its number in skip chooses."""
        seq, first, end = windows(at)
        if every > 1:
            begin = skip % np.minimum(every, -(-np.diff(at) // STEP))
            picked = ((first - at[:-1][seq]) // STEP - begin[seq]) % every == 0
            seq, first, end = seq[picked], first[picked], end[picked]
        both = np.empty((len(seq), CONTEXT + 2 * STEP), np.int32)
        both[:, : CONTEXT + STEP] = self.inputs(ids, at, seq, first)
        target = np.append(self.cls[ids], np.full(STEP, -1, np.int32))[first[:, None] + np.arange(STEP, dtype=np.int32)[None, :]]
        target[np.arange(STEP) >= (end - first)[:, None]] = -1
        both[:, CONTEXT + STEP :] = target
        return seq, both

    def packed(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each sequence ids[at[k]:at[k + 1]]."""
        total = np.bincount(np.repeat(np.arange(len(at) - 1), np.diff(at)), weights=self.within[ids], minlength=len(at) - 1)
        seq, both = self.windows(ids, at)
        got = np.empty(len(seq))
        for lo in range(0, len(seq), WINDOWS_AT_ONCE):
            part = slice(lo, lo + WINDOWS_AT_ONCE)
            target = both[part, CONTEXT + STEP :]
            logs = self.log_classes(both[part, : CONTEXT + STEP], np.maximum(target, 0))
            got[part] = np.where(target >= 0, logs, 0).sum(1, dtype=float)
        total += np.bincount(seq, weights=got, minlength=len(total))
        return total / np.log(10)


class Adam:
    """Steps along gradients scaled by their running mean squares, in buffers of its own: sums, of which the means are a
    tenth and a hundredth."""

    def __init__(self):
        self.steps, self.sums, self.squares = 0, {}, {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.steps += 1
        scale = 0.1 / np.sqrt(1 - 0.99**self.steps)  # root of a sum of squares to root of the unbiased mean
        at_sum, least = np.float32(0.1 * rate / (1 - 0.9**self.steps) / scale), np.float32(1e-7 / scale)
        for k, grad in g.items():
            if k not in self.sums:
                self.sums[k], self.squares[k] = np.zeros_like(grad), np.zeros_like(grad)
            sums, squares = self.sums[k], self.squares[k]
            sums *= np.float32(0.9)
            sums += grad
            squares *= np.float32(0.99)
            grad *= grad
            squares += grad
            np.sqrt(squares, out=grad)
            grad += least
            np.divide(sums, grad, out=grad)
            grad *= at_sum
            p[k] -= grad


def _scattered(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices there are, ascending, and the sum of each one's rows: those of lists of at most TOGETHER rows of one
    index first, then those of an index's lists."""
    at, rows = at.ravel(), rows.reshape(-1, rows.shape[-1])
    n = np.bincount(at)
    found = np.flatnonzero(n)
    n = n[found]
    lists, ends = -(-n // TOGETHER), np.cumsum(n)
    first = np.cumsum(lists) - lists
    begin = np.repeat(ends - n - TOGETHER * first, lists) + TOGETHER * np.arange(lists.sum())
    rows = _runs(rows, np.argsort(at.astype(np.uint16), kind="stable"), begin, np.minimum(np.repeat(ends, lists) - begin, TOGETHER))
    several = np.flatnonzero(lists > 1)
    out = rows.take(first, axis=0)
    if len(several):
        out[several] = _runs(rows, np.arange(len(rows)), first[several], lists[several])
    return found, out


def _runs(rows: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of rows[order[begin[i]:begin[i] + size[i]]], the k-th rows of all runs at a time."""
    by_size = np.argsort(size.max() - size, kind="stable")  # the runs that have a k-th row come first
    begin, longer = begin[by_size], (len(size) - np.cumsum(np.bincount(size))).tolist()
    total = rows.take(order.take(begin), axis=0)
    for k in range(1, len(longer) - 1):
        total[: longer[k]] += rows.take(order.take(begin[: longer[k]] + k), axis=0)
    out = np.empty_like(total)
    out[by_size] = total
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", S.id_of(docs).alias("id"), F.hash(F.lit(51), text).alias("th"), (S.crc_mod(F.col("doc_id"), 7) != 2).alias("trains"), text.alias("__text"))


def _sampled(keyed: DataFrame, n: int, seed: int, most: int) -> DataFrame:
    """About ``most`` of n rows by a hash of id and text, with that hash as h: a bounded sample."""
    few = int(min(1.0, 1.3 * most / max(n, 1)) * (1 << 30))
    return keyed.withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), F.lit(1 << 30))).where(F.col("h") <= few)


def frequent_words(keyed: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of the words that most documents of a sample have."""

    def count(batches):
        found = []
        for _, data, offs in K.blocks(batches, "__text"):
            w = K.words(data, offs)
            found.append(K.word_hashes(data, w, K.LOWER))
        h, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keep = times > 1
        yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names=["word", "n"])

    rows = _sampled(keyed, n, 53, FREQUENT_SAMPLE).select("__text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


@dataclass
class Tokens:
    """Documents with the subword ids of their whole texts, worked out once and stored."""

    path: str
    keyed: DataFrame  # doc_id, id, th, trains, __text
    rows: DataFrame  # doc_id, id, th, trains, n_tokens, ids (as KIND), often (places of frequent words, uint16 each)
    frequent: np.ndarray


def tokenised(docs: DataFrame, path: str, frequent: np.ndarray | None = None) -> Tokens:
    """docs: doc_id and text are read. frequent: a model's, where there is one already."""
    S.small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    if frequent is None:
        trains = keyed.where("trains")
        frequent = frequent_words(trains, trains.count())
    send = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        keep_buffers()
        tokens = subwords(path, send.value)
        for rows, data, offs in K.blocks(batches, "__text"):
            w = K.words(data, offs)
            ids, at, place = tokens.sequences(data, w, K.word_hashes(data, w, K.LOWER))
            often = place >= 0
            where = np.concatenate([[0], np.cumsum(often)])[w.at]
            places = place[often].astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:4], pa.array(w.counts + 1), _lists(ids.astype(KIND), at), _lists(places, where)], names=["doc_id", "id", "th", "trains", "n_tokens", "ids", "often"]
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return Tokens(path, keyed, S.cut(keyed.mapInArrow(run, f"doc_id {kind}, id long, th int, trains boolean, n_tokens long, ids binary, often binary")), frequent)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values[at[k]:at[k + 1]] as the bytes of row k."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at * size, np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _sequences(batches):
    """Rows, their ids one after the other and where each row's begin, for about IDS_AT_ONCE ids at a time."""
    size = np.dtype(KIND).itemsize
    for batch in batches:
        col = batch.column(batch.schema.get_field_index("ids"))
        at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) // size if len(col) else np.zeros(1, np.int64)
        raw = np.frombuffer(col.buffers()[2], KIND, count=at[-1]) if len(col) else np.zeros(0, KIND)
        lo = 0
        while lo < len(col):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + IDS_AT_ONCE, "right")) - 1)
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]].astype(np.int32), at[lo : hi + 1] - at[lo]
            lo = hi


def fit(docs: DataFrame, path: str) -> Attention:
    """A model of docs (doc_id, text), all of which it learns from."""
    tokens = tokenised(docs, path)
    tokens.rows = tokens.rows.withColumn("trains", F.lit(True))
    return fit_tokens(tokens)


def fit_tokens(tokens: Tokens) -> Attention:
    """A model of the training documents."""
    spark, rows = tokens.rows.sparkSession, tokens.rows.where("trains")
    table = Subwords(tokens.path)
    n_frequent, size = len(tokens.frequent), table.size

    def count(batches):
        total, often = np.zeros(size, np.int64), np.zeros(n_frequent, np.int64)
        for batch in batches:
            for rows, ids, _ in _sequences([batch]):
                total += np.bincount(ids, minlength=size)
                often += np.bincount(np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint16), minlength=n_frequent)
        yield _cells(np.concatenate([total, often]))  # after the pieces come the frequent words

    counts = _totals(rows.select("ids", "often").mapInArrow(count, "cell long, n long"), size + n_frequent)
    model = Attention(counts[:size], table.starts_word())
    model.frequent, model.frequent_counts = tokens.frequent, counts[size:]
    plain = spark.sparkContext.broadcast(model)

    def follow(batches):
        m, total = plain.value, np.zeros(INPUTS * CLASSES, np.int64)
        for _, ids, at in _sequences(batches):
            total += np.bincount(m.pairs(ids, at), minlength=len(total))
        yield _cells(total)

    model.follow(_totals(rows.select("ids").mapInArrow(follow, "cell long, n long"), INPUTS * CLASSES))

    def sample(batches):
        for rows, ids, at in _sequences(batches):
            seq, both = plain.value.windows(ids, at)
            picked = [both[np.flatnonzero(seq == k)] for k in range(len(at) - 1)]
            picked = [p[:: -(-len(p) // SAMPLE_WINDOWS)] for p in picked]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([p.tobytes() for p in picked], pa.binary())], names=["h", "windows"])

    hashed = _sampled(rows, rows.count(), 52, SAMPLE).select("h", "ids")
    found = hashed.mapInArrow(sample, "h long, windows binary").orderBy("h", "windows").limit(SAMPLE).collect()
    both = np.concatenate([np.frombuffer(r["windows"], np.int32).reshape(-1, CONTEXT + 2 * STEP) for r in found] or [np.zeros((0, CONTEXT + 2 * STEP), np.int32)])
    target = both[:, CONTEXT + STEP :]
    model.fit(both[:, : CONTEXT + STEP], np.maximum(target, 0), (target >= 0).astype(np.float32))
    start = spark.sparkContext.broadcast(model)

    def learn(batches):
        keep_buffers()
        m = copy.copy(start.value)
        m.p = {k: v.copy() for k, v in m.p.items()}

        def found():
            for _, ids, at in _sequences(batches):
                yield m.windows(ids, at)[1]

        n = m.learn(found())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([m.packed().tobytes()], pa.binary())], names=["n", "weights"])

    def added(batches):
        n, total = 0, 0.0
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, total = n + k, total + k * np.frombuffer(raw, np.float32).astype(np.float64)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tobytes()], pa.binary())], names=["n", "weights"])

    learned = S.cut(rows.select("ids").mapInArrow(learn, "n long, weights binary"))
    total = 0.0
    for row in learned.coalesce(8).mapInArrow(added, "n long, weights binary").toLocalIterator():
        model.learned, total = model.learned + row["n"], total + np.frombuffer(row["weights"])
    if model.learned:
        model.unpack(total / model.learned)
    return model


def _cells(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])


def _totals(cells: DataFrame, size: int) -> np.ndarray:
    """Tasks' counts by cell added up; at most ``size`` rows come to the driver."""
    out = np.zeros(size, np.int64)
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def _counted(n_bins: int, sent):
    def run(batches):
        packer = B.Packer(n_bins, np.uint64)
        for rows, data, offs in K.blocks(batches, "__text"):
            w = K.words(data, offs)
            h, doc = K.word_hashes(data, w, K.LOWER), w.doc()
            rare = K.place_in(h, sent.value) < 0
            h, doc = h[rare], doc[rare]
            order = np.argsort(h)
            order = order[np.argsort(doc[order].astype(np.uint16 if len(w.at) <= 1 << 16 else np.int64), kind="stable")]  # 16 bits: by radix
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, int)
            trains = rows.column("trains").to_numpy(zero_copy_only=False).astype(np.int32)
            fps = (rows.column("th").to_numpy() & np.int32(-2)) | trains
            yield from packer.add(rows.column("id").to_numpy(), fps, doc[at], np.diff(np.append(at, len(h))), h[at])
        yield from packer.flush()

    return run


def _added(table: pa.Table) -> pa.Table:
    """A bin's share of every document's score, for each flush, and its number of distinct training words."""
    e = B.unpack(table, np.uint64)
    order = np.argsort(e.hash)
    h, doc, n = e.hash[order], e.doc[order], e.pos[order].astype(np.int64)
    trains = (e.fps & 1)[doc]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    c = np.add.reduceat(n * trains, at)
    every = np.repeat(c, np.diff(np.append(at, len(h))))
    logs = np.bincount(doc, weights=n * np.log10(every + 1.0), minlength=len(e.ids))
    known = np.bincount(doc, weights=n * (every > 0), minlength=len(e.ids)).astype(np.int64)
    distinct = np.zeros(len(e.flush), np.int64)
    distinct[0] = (c > 0).sum()
    packed = lambda values: pa.array([values[x:y].tobytes() for x, y in zip(e.first[:-1], e.first[1:], strict=True)], pa.binary())
    return pa.table({"flush": pa.array(e.flush), "ids": packed(e.ids), "fps": packed(e.fps), "logs": packed(logs), "known": packed(known), "distinct": pa.array(distinct)})


def _summed(table: pa.Table) -> pa.Table:
    """A flush's documents with their sums over all bins."""
    ids, fps, logs, known = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("fps", np.int32), ("logs", np.float64), ("known", np.int64)))
    order = np.lexsort((fps, ids))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(fps[order]) != 0)
    at = np.flatnonzero(new)
    return pa.table({"id": pa.array(ids[order][at]), "fp": pa.array(fps[order][at]), "logs": pa.array(np.add.reduceat(logs[order], at)), "known": pa.array(np.add.reduceat(known[order], at))})


def score(docs: DataFrame, path: str, model: Attention) -> DataFrame:
    """docs: doc_id and text of all documents; model: of those that train. See op5 for the columns."""
    return score_tokens(tokenised(docs, path, model.frequent), model)


def score_tokens(tokens: Tokens, model: Attention) -> DataFrame:
    spark, keyed = tokens.rows.sparkSession, tokens.keyed
    sent, frequent = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(tokens.frequent)

    def run(batches):
        keep_buffers()
        m = sent.value
        for rows, ids, at in _sequences(batches):
            places = [np.frombuffer(x, np.uint16) for x in rows.column(6).to_pylist()]
            of = np.concatenate([[0], np.cumsum([len(x) for x in places])])
            c = m.frequent_counts[np.concatenate(places)]
            logs, known = K.segment_sums(np.log10(c + 1.0), of), K.segment_sums((c > 0).astype(np.int64), of)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:5], pa.array(np.diff(at)), pa.array(m.score(ids, at)), pa.array(logs), pa.array(known)],
                names=["doc_id", "id", "th", "trains", "n_tokens", "n_pieces", "score", "logs_often", "known_often"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    scored = S.cut(tokens.rows.mapInArrow(run, f"doc_id {kind}, id long, th int, trains boolean, n_tokens long, n_pieces long, score double, logs_often double, known_often long"))
    nbytes = keyed.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).first()[0]
    packed = keyed.select("id", "th", "trains", "__text").mapInArrow(_counted(B.bins_for(nbytes // 3), frequent), B.PACKED)
    parts = S.cut(packed.groupBy("bin").applyInArrow(_added, "flush long, ids binary, fps binary, logs binary, known binary, distinct long"))
    base = parts.drop("distinct").groupBy("flush").applyInArrow(_summed, "id long, fp int, logs double, known long")
    base = base.groupBy("id", "fp").agg(F.sum("logs").alias("logs"), F.sum("known").alias("known"))  # rows repeated as they are
    n, docs_in = scored.where("trains").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    v = parts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + int((model.frequent_counts > 0).sum()) + (docs_in > 0)
    times = scored.groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.count(F.lit(1)).alias("times"), F.first("trains").alias("tr"))
    times = times.select("i", "t", "times", F.col("t").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("tr").cast("int")).alias("f"))
    base = times.join(base, (F.col("i") == F.col("id")) & (F.col("f") == F.col("fp")), "left").select("i", "t", (F.coalesce("logs", F.lit(0.0)) / F.col("times")).alias("logs"), (F.coalesce("known", F.lit(0).cast("long")) / F.col("times")).cast("long").alias("known"))
    full = scored.join(base, (F.col("id") == F.col("i")) & (F.col("th") == F.col("t")))
    end = float(np.log10(docs_in + 1.0))
    return full.select(
        "doc_id", (~F.col("trains")).alias("held_out"), "n_tokens", (F.col("known") + F.col("known_often") + F.lit(int(docs_in > 0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("logs_often") + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))).alias("base_score"), "score", "n_pieces",
    )


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = tokenised(docs, path)
    return score_tokens(tokens, fit_tokens(tokens))

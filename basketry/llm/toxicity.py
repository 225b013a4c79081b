"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into words (runs of letters) and the words into overlapping windows. Each word enters
the network with word inputs (a learned vector of its hash, and how much its documents lean to label 1)
and character inputs (the mean of learned vectors of its 4- and 5-letter pieces, and the strongest leaning
among them). Two gated recurrent layers read the window in both directions, attention weighs their
states, and a logistic unit scores the pooled state. A text's score is that of its highest window.

Learning happens on a bounded sample of labelled rows (``PER_LABEL`` rows of label 0 and
of label 1, of at most ``SAMPLE_BYTES`` bytes each, least hash of the id first), on the driver: leanings are signed roots of likelihood
ratios of document counts, taken for each training text without its own fold; the rest is Adam on the
highest window of each text. Every text is scored whole, in Spark tasks, by the broadcast model, whose
size is fixed. Windows of all texts of a block are read at once, one numpy step for each place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import id_bucket
from basketry.llm.words import LOWER, chunks, coded, runs, string_array, text_bytes

#: Rows of each label and their largest size that the model may be fitted on.
PER_LABEL, SAMPLE_BYTES = (2048, 1024), 8192
WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
#: Learned vectors: places (by hash) and size.
WORD_PLACES, WORD_SIZE = 1 << 13, 4
PIECE_PLACES, PIECE_SIZE = 1 << 14, 6
#: Places of the leanings of words and of letter pieces.
WORD_LEANS, PIECE_LEANS = 1 << 18, 1 << 20
PIECES = (4, 5)
INPUTS = 2 + WORD_SIZE + PIECE_SIZE
FOLDS, STEPS, BATCH, RATE = 4, 320, 128, 0.01
#: Weight of all toxic texts together; that of the others is the rest.
TOXIC = 0.3
#: Share of the training windows that see the learned vectors.
VECTORS_KEPT = 0.3
#: Windows scored at a time.
TILE = 8192
EDGE = ord("\n")


def words_of(column) -> tuple[np.ndarray, list, np.ndarray]:
    """(codes, distinct words, number of words of each text): runs of letters, A-Z in lower case."""
    data, offsets = text_bytes(column)
    data = LOWER[data]
    letter = (data >= 97) & (data <= 122) | (data >= 128)
    starts, ends = runs(letter, offsets)
    codes, distinct = coded(string_array(data[letter], ends - starts))
    doc = np.searchsorted(offsets, starts, "right") - 1
    return codes, distinct.to_pylist(), np.bincount(doc, minlength=len(offsets) - 1)


def pieces_of(words: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, word) of all letter pieces, in the order of words, and a digest of each whole word.

    Pieces may begin or end with the word's edge, but don't reach beyond it.
    """
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    points = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = points == EDGE
    word = np.cumsum(edge) - 1
    digest, owner = [], []
    for n in PIECES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        inner = np.zeros(m, bool)
        state = np.full(m, n, np.uint64)
        for k in range(n):
            state = (state ^ points[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
            state ^= state >> np.uint64(29)
            if 0 < k < n - 1:
                inner |= edge[k:k + m]
        at = np.flatnonzero(~inner)
        digest.append(state[at])
        owner.append(word[at])
    digest, owner = np.concatenate(digest), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    # a digest of the whole word from its letters: order matters through the running place
    mixed = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    place = np.arange(len(points)) - np.flatnonzero(edge)[word]
    mixed = (mixed ^ (mixed >> np.uint64(31))) * (2 * place.astype(np.uint64) + np.uint64(1))
    mixed ^= mixed >> np.uint64(27)
    whole = np.add.reduceat(np.where(edge, np.uint64(0), mixed), np.flatnonzero(edge)[:-1])
    whole = whole * np.uint64(0x94D049BB133111EB)
    return digest[order], owner[order], whole ^ (whole >> np.uint64(30))


class Words:
    """Distinct words with the places of their vectors and leanings."""

    def __init__(self, words: list):
        digest, owner, whole = pieces_of(words)
        self.n = len(words)
        self.word, self.word_lean = (whole % WORD_PLACES).astype(np.int64), (whole % WORD_LEANS).astype(np.int64)
        self.piece, self.piece_lean = (digest % PIECE_PLACES).astype(np.int64), (digest % PIECE_LEANS).astype(np.int64)
        self.owner = owner
        self.count = np.bincount(owner, minlength=self.n).astype(np.float32)
        self.first = np.flatnonzero(np.diff(owner, prepend=-1))
        self.having = owner[self.first]

    def leans(self, model: dict) -> np.ndarray:
        """(words + 1, 2): leaning of the word, and the strongest of its pieces; the last row is the end."""
        out = np.zeros((self.n + 1, 2), np.float32)
        out[:-1, 0] = model["word_lean"][self.word_lean]
        if len(self.owner):
            out[self.having, 1] = np.maximum.reduceat(model["piece_lean"][self.piece_lean], self.first)
        return out

    def vectors(self, model: dict) -> np.ndarray:
        """(words + 1, WORD_SIZE + PIECE_SIZE): learned vectors; the end has none."""
        out = np.zeros((self.n + 1, WORD_SIZE + PIECE_SIZE), np.float32)
        out[:-1, :WORD_SIZE] = model["word"][self.word]
        if len(self.owner):
            out[self.having, WORD_SIZE:] = np.add.reduceat(model["piece"][self.piece], self.first, axis=0)
            out[:-1, WORD_SIZE:] /= np.maximum(self.count, 1)[:, None]
        return out


def windows(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows of codes, text of each): WINDOW words, starting every STRIDE; -1 fills the last.

    Each text is followed by one end word, so an empty text has a window too.
    """
    starts = np.cumsum(sizes) - sizes
    count = 1 + np.maximum(0, -(-(sizes + 1 - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(sizes)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = (k * STRIDE)[:, None] + np.arange(WINDOW)
    size = sizes[text][:, None]
    place = np.minimum((starts[text])[:, None] + at, max(0, len(codes) - 1))
    got = codes[place] if len(codes) else np.zeros(at.shape, np.int64)
    return np.where(at < size, got, np.where(at == size, end, -1)).astype(np.int32), text


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def gru(inputs, u, c, mask):
    """States of a gated recurrent layer. inputs: (time, batch, 3 * hidden), already projected; mask:
    (time, batch), 0 keeps the state. Returns (time + 1, batch, hidden) and what the way back needs."""
    steps, batch, wide = inputs.shape
    h = wide // 3
    out = np.zeros((steps + 1, batch, h), np.float32)
    kept = []
    for t in range(steps):
        a = out[t] @ u
        gates = sigmoid(inputs[t, :, :2 * h] + a[:, :2 * h])
        z, r = gates[:, :h], gates[:, h:]
        inner = a[:, 2 * h:] + c
        new = np.tanh(inputs[t, :, 2 * h:] + r * inner)
        out[t + 1] = out[t] + mask[t][:, None] * (1 - z) * (new - out[t])
        kept.append((z, r, inner, new))
    return out, kept


def gru_back(grad, states, kept, u, mask):
    """Gradients of (inputs, u, c) from those of the states."""
    steps, batch, h = grad.shape
    d_in, d_u, d_c = np.empty((steps, batch, 3 * h), np.float32), np.zeros_like(u), np.zeros(h, np.float32)
    d = np.zeros((batch, h), np.float32)
    for t in range(steps - 1, -1, -1):
        z, r, inner, new = kept[t]
        before, m = states[t], mask[t][:, None]
        d = d + grad[t]
        d_new = d * m * (1 - z) * (1 - new * new)
        d_z = d * m * (before - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        back = np.concatenate([d_z, d_r, d_new * r], 1)
        d_in[t] = np.concatenate([d_z, d_r, d_new], 1)
        d_u += before.T @ back
        d_c += (d_new * r).sum(0)
        d = d * (1 - m * (1 - z)) + back @ u.T
    return d_in, d_u, d_c


def forward(model: dict, ahead, behind, mask):
    """Logits of windows from both directions' projected inputs, with what the way back needs."""
    one, kept_one = gru(ahead, model["u_f"], model["c_f"], mask)
    two, kept_two = gru(behind[::-1], model["u_b"], model["c_b"], mask[::-1])
    states = np.concatenate([one[1:], two[1:][::-1]], 2)
    seen = np.tanh(states @ model["a"])
    energy = np.where(mask > 0, seen @ model["v"], -1e9)
    weight = np.exp(energy - energy.max(0)) * mask
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = (weight[:, :, None] * states).sum(0)
    return pooled @ model["w"] + model["b"][0], (one, kept_one, two, kept_two, states, seen, weight, pooled)


def backward(model: dict, d_logit, saved, mask):
    """Gradients of the parameters above the inputs, and of both projected inputs."""
    one, kept_one, two, kept_two, states, seen, weight, pooled = saved
    h = states.shape[2] // 2
    grads = {"w": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * model["w"]
    d_states = weight[:, :, None] * d_pooled
    d_weight = (states * d_pooled).sum(2)
    d_energy = weight * (d_weight - (weight * d_weight).sum(0))
    grads["v"] = np.einsum("tb,tba->a", d_energy, seen)
    d_seen = d_energy[:, :, None] * model["v"] * (1 - seen * seen)
    grads["a"] = np.einsum("tbi,tba->ia", states, d_seen)
    d_states = d_states + d_seen @ model["a"].T
    d_one, grads["u_f"], grads["c_f"] = gru_back(d_states[:, :, :h], one, kept_one, model["u_f"], mask)
    d_two, grads["u_b"], grads["c_b"] = gru_back(d_states[::-1, :, h:], two, kept_two, model["u_b"], mask[::-1])
    return grads, d_one, d_two[::-1]


def new_model(rnd) -> dict:
    def normal(*shape, scale):
        return (rnd.standard_normal(shape) * scale).astype(np.float32)

    h = HIDDEN
    model = {"word": normal(WORD_PLACES, WORD_SIZE, scale=0.1), "piece": normal(PIECE_PLACES, PIECE_SIZE, scale=0.1),
             "a": normal(2 * h, ATTENTION, scale=0.3), "v": normal(ATTENTION, scale=0.3), "w": normal(2 * h, scale=0.3),
             "b": np.zeros(1, np.float32)}
    for d in "fb":
        model |= {f"x_{d}": normal(INPUTS, 3 * h, scale=0.3), f"i_{d}": np.zeros(3 * h, np.float32),
                  f"u_{d}": normal(h, 3 * h, scale=0.3), f"c_{d}": np.zeros(h, np.float32)}
    return model


def scores_of(model: dict, words: Words, rows: np.ndarray) -> np.ndarray:
    """Logits of windows of codes of ``words``: words are projected once each, not once a place."""
    inputs = np.concatenate([words.leans(model), words.vectors(model)], 1)
    ahead, behind = (np.vstack([inputs @ model[f"x_{d}"] + model[f"i_{d}"], np.zeros((1, 3 * HIDDEN), np.float32)])
                     for d in "fb")
    out = np.empty(len(rows), np.float32)
    for at in range(0, len(rows), TILE):
        some = np.ascontiguousarray(rows[at:at + TILE].T)
        mask = (some >= 0).astype(np.float32)
        out[at:at + TILE] = forward(model, ahead[some], behind[some], mask)[0]
    return out


def highest(logits: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Place of the highest window of each text; the windows of a text lie together."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    best = np.maximum.reduceat(logits, first)
    order = np.arange(len(logits))
    order[logits < best[text]] = len(logits)
    return np.minimum.reduceat(order, first)


def leaning(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the likelihood ratio that a place's documents lean to label 1, within -2 and 2."""
    all_, share = toxic + clean, n_toxic / max(1, n_toxic + n_clean)

    def part(seen, expected):
        return seen * np.log(np.where(seen > 0, seen, 1) / np.maximum(expected, 1e-9))

    g = np.maximum(0, part(toxic, all_ * share) + part(clean, all_ * (1 - share)))
    root = np.sqrt(2 * g) * np.sign(toxic - all_ * share)
    return (np.clip(root, -8, 8) / 4).astype(np.float32)


def _leans(sample: list, skip: int | None) -> dict:
    """Leanings of words and pieces by the documents of all folds but ``skip``."""
    counts = {k: [np.zeros(n, np.float32) for _ in range(2)] for k, n in (("word", WORD_LEANS), ("piece", PIECE_LEANS))}
    n = [0, 0]
    for fold, (words, labels, text, codes) in enumerate(sample):
        if fold == skip:
            continue
        for k, place in (("word", words.word_lean), ("piece", words.piece_lean)):
            owner = np.arange(words.n) if k == "word" else words.owner
            first = np.searchsorted(owner, np.arange(words.n))
            size = np.searchsorted(owner, np.arange(words.n), "right") - first
            # places of each document: those of its words, each once
            seen = np.unique(text * words.n + codes)
            doc, word = np.divmod(seen, max(1, words.n))
            reps = size[word]
            at = np.repeat(first[word] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            room = len(counts[k][0])
            both = np.unique(np.repeat(doc, reps) * room + place[at])
            doc, found = np.divmod(both, room)
            for label in (0, 1):
                np.add.at(counts[k][label], found[labels[doc] == label], 1)
        for label in (0, 1):
            n[label] += int((labels == label).sum())
    return {f"{k}_lean": leaning(c[1], c[0], n[1], n[0]) for k, c in counts.items()}


def fit(texts: list, labels: list, seed: int = 5) -> dict:
    """Model from texts and their labels (1: toxic). Both labels must occur."""
    rnd = np.random.default_rng(seed)
    labels = np.asarray(labels)
    # labels are dealt to the folds evenly
    fold_of = np.empty(len(labels), np.int64)
    for label in (0, 1):
        at = np.flatnonzero(labels == label)
        fold_of[at] = np.arange(len(at)) % FOLDS
    sample, rows = [], []
    for fold in range(FOLDS):
        at = np.flatnonzero(fold_of == fold)
        codes, distinct, sizes = words_of(pa.array([texts[i] for i in at], pa.large_string()))
        words = Words(distinct)
        sample.append((words, labels[at], np.repeat(np.arange(len(at)), sizes), codes))
        rows.append(windows(codes, sizes, words.n))
    own = [_leans(sample, fold) for fold in range(FOLDS)]
    model = new_model(rnd)
    leans = [words.leans(o) for (words, *_), o in zip(sample, own, strict=True)]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    step = 0
    while step < STEPS:
        picked = []
        for fold, (words, marks, _, _) in enumerate(sample):
            made, text = rows[fold]
            if not len(text):
                continue
            if step:
                logits = scores_of(model | own[fold], words, made)
            else:  # nothing is learnt yet: the window with most leaning
                value = np.append(np.maximum(0, leans[fold]).sum(1), np.float32(0))
                logits = value[made].sum(1)
            picked += [(fold, i, marks[t]) for t, i in enumerate(highest(logits, text))]
        picked += [(fold, None, 0) for fold in range(FOLDS)]  # a text without words isn't toxic
        share = max(1, sum(m for *_, m in picked)) / len(picked)
        batches = -(-len(picked) // BATCH)
        rounds = [np.array_split(rnd.permutation(len(picked)), batches) for _ in range(max(1, 8 // batches))]
        for at in (at for batch in rounds for at in batch):
            step += 1
            _step(model, moments, step, sample, rows, leans, [picked[i] for i in at], share, rnd.random(len(at)) < VECTORS_KEPT)
    return model | _leans(sample, None)


def _step(model, moments, step, sample, rows, leans, picked, share, kept):
    """One step of Adam on a batch of windows (fold, window, label); label 1 has the weight TOXIC. Windows that aren't
    ``kept`` go without learned vectors, so that these don't learn texts by heart."""
    n = len(picked)
    x = np.zeros((WINDOW, n, INPUTS), np.float32)
    mask = np.zeros((WINDOW, n), np.float32)
    used = []
    for fold, (words, *_) in enumerate(sample):
        col = np.array([j for j, p in enumerate(picked) if p[0] == fold], np.int64)
        if not len(col):
            continue
        empty = np.full(WINDOW, -1, np.int32)
        empty[0] = words.n
        codes = np.stack([empty if picked[j][1] is None else rows[fold][0][picked[j][1]] for j in col])
        distinct, place = np.unique(codes, return_inverse=True)
        vectors = _some_vectors(model, words, distinct)
        inputs = np.concatenate([np.where(distinct[:, None] >= 0, leans[fold][distinct], 0), vectors[0]], 1)
        place = place.reshape(codes.shape).T
        x[:, col] = inputs[place]
        mask[:, col] = codes.T >= 0
        x[:, col, 2:] *= kept[col][:, None]
        used.append((col, distinct, place, vectors[1]))
    ahead, behind = (x @ model[f"x_{d}"] + model[f"i_{d}"] for d in "fb")
    logits, saved = forward(model, ahead, behind, mask)
    label = np.array([p[2] for p in picked], np.float32)
    weight = np.where(label == 1, TOXIC / share, (1 - TOXIC) / (1 - share)).astype(np.float32) / n
    grads, d_ahead, d_behind = backward(model, (sigmoid(logits) - label) * weight, saved, mask)
    flat = x.reshape(-1, INPUTS)
    d_x = np.zeros_like(x)
    for d, g in (("f", d_ahead), ("b", d_behind)):
        grads[f"x_{d}"], grads[f"i_{d}"] = flat.T @ g.reshape(len(flat), -1), g.sum((0, 1))
        d_x += g @ model[f"x_{d}"].T
    d_x[:, :, 2:] *= kept[:, None]
    grads["word"], grads["piece"] = np.zeros_like(model["word"]), np.zeros_like(model["piece"])
    for col, distinct, place, (word, owner, piece, count) in used:
        d_in = np.zeros((len(distinct), INPUTS), np.float32)
        np.add.at(d_in, place, d_x[:, col])
        real = distinct >= 0
        np.add.at(grads["word"], word[real], d_in[real, 2:2 + WORD_SIZE])
        np.add.at(grads["piece"], piece, (d_in[:, 2 + WORD_SIZE:] / np.maximum(count, 1)[:, None])[owner])
    for k, g in grads.items():
        m, v = moments[k]
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        rate = RATE / 10 if k in ("word", "piece") else RATE
        model[k] -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


def _some_vectors(model, words: Words, distinct: np.ndarray):
    """Learned vectors of some codes, and the places they come from."""
    real = (distinct >= 0) & (distinct < words.n)
    word = np.where(real, words.word[np.where(real, distinct, 0)], 0) if words.n else np.zeros(len(distinct), np.int64)
    first = np.searchsorted(words.owner, distinct)
    size = np.where(real, np.searchsorted(words.owner, distinct, "right") - first, 0)
    owner = np.repeat(np.arange(len(distinct)), size)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    piece = words.piece[at]
    out = np.zeros((len(distinct), WORD_SIZE + PIECE_SIZE), np.float32)
    out[real, :WORD_SIZE] = model["word"][word[real]]
    np.add.at(out[:, WORD_SIZE:], owner, model["piece"][piece])
    out[:, WORD_SIZE:] /= np.maximum(size, 1)[:, None]
    # the end word and the filling have no vectors to learn
    word = np.where(real, word, WORD_PLACES - 1)
    return out, (word, owner, piece, size.astype(np.float32))


def text_scores(model: dict, column) -> np.ndarray:
    """Score of every text of an Arrow column."""
    codes, distinct, sizes = words_of(column)
    words = Words(distinct)
    rows, text = windows(codes, sizes, words.n)
    logits = scores_of(model, words, rows)
    first = np.flatnonzero(np.diff(text, prepend=-1))
    return sigmoid(np.maximum.reduceat(logits, first).astype(np.float64)) if len(text) else np.zeros(0)


def training_rows(docs: DataFrame, labels: DataFrame, per_label: tuple = PER_LABEL, most_bytes: int = SAMPLE_BYTES) -> list:
    """(text, label) of the bounded sample: rows outside the held-out fifth with a label, ``per_label`` of
    label 0 and 1 at most. A null text is empty; an id labelled more than once is toxic if any label says so."""
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("mark"))
    fits = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(
        (id_bucket(F.col("doc_id"), 5) != 0) & (F.octet_length("text") <= most_bytes))
    # ids first, texts then: only the ids and labels are shuffled
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).alias("place")  # 53 bits
    ids = fits.select("doc_id").distinct().join(marks, "doc_id").select("doc_id", "mark", place)
    many = {r["mark"]: r["count"] for r in ids.groupBy("mark").count().collect()}
    out = []
    for label in sorted(many.keys() & {0, 1}):
        # about as many as wanted come through this bound, so tasks send few rows
        bound = int(min(1.0, (1.2 * per_label[label] + 50) / many[label]) * (1 << 53))
        picked = ids.filter((F.col("mark") == label) & (F.col("place") <= bound)).orderBy("place", "doc_id").limit(per_label[label])
        picked = docs.sparkSession.createDataFrame(picked.collect(), picked.schema)
        out += fits.join(F.broadcast(picked), "doc_id").orderBy("place", "doc_id", "text").limit(per_label[label]).select(
            "text", "mark").collect()
    return [tuple(r) for r in out]


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` (doc_id, toxic) teach; ids whose crc32 leaves 0 modulo 5 are held out. Labels, languages,
    sources and ids are no inputs. A null text counts as empty; texts without a word have the score of the
    end word alone. Repeated rows get equal scores. Without rows of both labels to learn from, every
    score is the smoothed share of toxic ones. An empty table gives no rows; other columns are not read.
    """
    sample = training_rows(docs, labels)
    marks = [m for _, m in sample]
    kind = docs.schema["doc_id"].dataType
    held_out = (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out")
    if len(set(marks)) < 2:
        scored = docs.select("doc_id", F.lit((sum(marks) + 0.5) / (len(marks) + 2)).alias("score"))
    else:
        model = docs.sparkSession.sparkContext.broadcast(fit([t for t, _ in sample], marks))

        def score(batches):
            for batch in chunks(batches):
                found = text_scores(model.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

        scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind.simpleString()}, score double")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

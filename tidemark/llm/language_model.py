"""Log-likelihood of whole texts under a gated recurrent language model, and a unigram base beside it.

Tokens are words between white space, A-Z lower-cased, and one end per text.  Token counts cover all training texts.  The
model's outputs are the ``VOCABULARY`` most frequent tokens, the end, and buckets of all other tokens (by last character, first byte and
length); they are dealt into classes of equal size by frequency, and the softmax is factored into class and member.
A token of a bucket gets the bucket's probability times its smoothed share of the bucket's count, so every text
has a probability.  In scoring, state is carried through all windows of a text, many texts side by side.

A GRU is trained with truncated backpropagation on all tokens of all training texts, ``EPOCHS`` times.  Texts are numbered once
and dealt by hash to shards of about ``SHARD`` tokens, longer ones in runs of ``RUN`` tokens that know the token before them.  A
pass has up to ``ROUNDS`` rounds; in each, a task per shard trains on from the last parameters, which are then averaged
in Spark, weighted by tokens, so that work and tasks grow with the corpus and the driver holds one set of parameters.  Shards depend
on seed and data, not on the layout of files (equal rows are dealt by their place in a batch; they are the same text).  The
outputs stay ``VOCABULARY`` words at every size: the cost is that the network tells all rarer words apart by bucket only, and
within a bucket by their counts.

Counts of frequent tokens (``KNOWN``, bounded) go to the tasks; rarer tokens of each text meet their counts in one join, so
the table of all tokens is never sent around, and no token that is frequent enough to be a hot key is in that join.

Defined results: null and empty texts are one end; without training texts all counts are 0, base scores follow the formula
and the model knows buckets only; rows that repeat an id are scored each; tokens are told apart by 64-bit hashes; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tables import stage
from tidemark.llm.words import NOT_SPACE, flat, mix, pieces, spans, sum_rows

VOCABULARY = 4000
KNOWN = 65_536
SHARD = 2_000_000
RUN = 65_536
ROUNDS = 4
PART = 8192
HIDDEN = 24
EMBED = 16
CLASS = 64
#: Values whose exponentials a 32-bit softmax can add up as they are.
SAFE = 60.0
BLOCK = 1024
#: Texts that are scored side by side, so that a step's numbers fit the cache.
ABREAST = 512
WINDOW = 32
STREAMS = 512
#: Windows that a stream has at least, so that few tokens are learned in many steps, too.
STEPS = 120
EPOCHS = 1
WARM_UP = 8
RATE = 0.03
ALPHA = 0.1
BUCKETS = 64
#: Top bits of a hash that lead to the known tokens.
LEAD = 16
END = np.uint64(1)


def _parts_of_bucket() -> tuple[np.ndarray, np.ndarray]:
    """What the last and the first byte of a word add to its bucket."""
    last = np.arange(256, dtype=np.uint8)
    ending = np.select([last == ord("."), last == ord(","), last >= 0x80, (last | 0x20 >= ord("a")) & (last | 0x20 <= ord("z"))], [0, 1, 2, 3], 4)
    vowel = np.isin(last | 0x20, np.frombuffer(b"aeiou", np.uint8))
    return (np.where((ending == 3) & vowel, 5, ending) * 10).astype(np.int8), np.where(last >= 0x80, 5, 0).astype(np.int8)


_BY_LAST, _BY_HEAD = _parts_of_bucket()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bucket of each token, the end of each text included, and the first token of each text (``len + 1``)."""
    data, offsets = flat(column)
    hashes, start, size, first = spans(data, offsets, NOT_SPACE)
    n = len(column)
    at = first[1:] + np.arange(n)
    words = np.ones(len(hashes) + n, bool)
    words[at] = False
    out, bucket = np.full(len(words), END), np.full(len(words), -1, np.int8)
    out[words] = np.where(hashes == END, hashes + np.uint64(1), hashes)
    last, head = data[start + size - 1] if len(start) else np.empty(0, np.uint8), data[start] if len(start) else np.empty(0, np.uint8)
    bucket[words] = _BY_LAST[last] + _BY_HEAD[head] + np.minimum(size >> 2, 4).astype(np.int8)
    return out, bucket, first + np.arange(n + 1)


# ---- counts -------------------------------------------------------------------------------------------------------


def token_counts(texts: DataFrame) -> DataFrame:
    """``token, bucket, count`` over all texts, the end included."""

    def count(batches):
        for batch in pieces(batches, 1024):
            hashes, bucket, _ = tokens(batch.column(0))
            value, at, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(bucket[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["token", "bucket", "n"])

    return texts.select(F.col("text").cast("string")).mapInArrow(count, "token long, bucket int, n long").groupBy("token", "bucket").agg(F.sum("n").alias("count"))


# ---- the network --------------------------------------------------------------------------------------------------


def _sigmoid(x):
    x = x * 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def new_parameters(outputs: int, classes: int, rng) -> dict[str, np.ndarray]:
    def normal(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    return {
        "embed": (rng.standard_normal((outputs + 1, EMBED)) * 0.3).astype(np.float32),
        "in": normal(EMBED, 3 * HIDDEN), "rec": normal(HIDDEN, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN, np.float32),
        "to_class": normal(HIDDEN, classes), "class_bias": np.zeros(classes, np.float32),
        "to_member": (rng.standard_normal((classes, HIDDEN, CLASS)) * 0.1).astype(np.float32), "member_bias": np.zeros((classes, CLASS), np.float32),
    }


def step(p: dict[str, np.ndarray], state: np.ndarray, previous: np.ndarray, led: np.ndarray | None = None) -> np.ndarray:
    """The next state of each row; ``led`` holds what each output leads to the gates, if it is known."""
    a = p["embed"][previous] @ p["in"] + p["bias"] if led is None else led[previous]
    b = state @ p["rec"]
    gates = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
    return c + z * (state - c)


def log_members(p: dict[str, np.ndarray], states: np.ndarray, target: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Natural log probability of ``target`` (an output number) for each state."""
    level = _must_level(p)
    order = np.argsort((target // CLASS).astype(np.int16), kind="stable")
    states, of, member = states.take(order, axis=0), target[order] // CLASS, target[order] % CLASS
    found, rows = np.zeros(len(of)), np.arange(2 * BLOCK)

    def add_log_shares(low: int, high: int, weight: np.ndarray, bias: np.ndarray, at: np.ndarray) -> None:
        room = np.empty((min(2 * BLOCK, high - low), weight.shape[1]), np.result_type(states, weight))
        edges = [*range(low, max(high - BLOCK, low) + 1, BLOCK), high]
        for own in map(slice, edges[:-1], edges[1:]):  # rows that fit the cache; the last ones go with those before them
            x = np.matmul(states[own], weight, out=room[: own.stop - own.start])
            x += bias
            if level:
                x -= x.max(1, keepdims=True)
            share = x[rows[: len(x)], at[own]].astype(np.float64)
            np.exp(x, out=x)
            found[own] += share - np.log((x @ _ones(x)).astype(np.float64))

    add_log_shares(0, len(of), p["to_class"], p["class_bias"], of)
    bias, cuts = p["member_bias"] + valid, np.searchsorted(of, np.arange(len(valid) + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        add_log_shares(int(cuts[k]), int(cuts[k + 1]), p["to_member"][k], bias[k], member)
    out = np.empty(len(found))
    out[order] = found
    return out


def fit_network(p: dict[str, np.ndarray], before: np.ndarray, target: np.ndarray, heads: np.ndarray, outputs: int, start: float = 0.0, end: float = 1.0) -> dict[str, np.ndarray]:
    """Truncated backpropagation from ``p`` over one long sequence cut into parallel streams.

    ``heads`` marks tokens that start from an empty state; ``start`` and ``end`` say how far the whole training has come.
    """
    p = {k: v.copy() for k, v in p.items()}
    valid = valid_members(outputs)
    if not len(target):
        return p
    streams = max(1, min(STREAMS, len(target) // (STEPS * WINDOW)))
    length = -(-len(target) // streams)
    before, target, heads = (np.concatenate([x, np.full(streams * length - len(x), fill, x.dtype)]).reshape(streams, length) for x, fill in ((before, outputs), (target, -1), (heads, True)))
    flat_p = np.concatenate([v.ravel() for v in p.values()])
    mean, square, cuts = np.zeros_like(flat_p), np.zeros_like(flat_p), np.cumsum([v.size for v in p.values()])[:-1]
    p = {k: x.reshape(v.shape) for (k, v), x in zip(p.items(), np.split(flat_p, cuts))}  # views
    total, room = -(-length // WINDOW), {}
    state = np.zeros((streams, HIDDEN), np.float32)
    for turn, low in enumerate(range(0, length, WINDOW), 1):
        cut = slice(low, low + WINDOW)
        state, grads = _window(p, state, before[:, cut], target[:, cut], outputs, valid, heads[:, cut], room)
        size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        rate = (RATE * (1 - start - (end - start) * turn / (total + 1)) + 0.0005) * min(1.0, turn / WARM_UP)
        flat_g = np.concatenate([grads[k].ravel() for k in p])
        for at in range(0, len(flat_p), PART):  # numbers that fit the cache
            g, m, v = (x[at : at + PART] for x in (flat_g, mean, square))
            m *= 0.9
            m += (0.1 * scale) * g
            v *= 0.995
            clipped = scale * g
            clipped *= clipped
            clipped *= 0.005
            v += clipped
            change = m / (1 - 0.9**turn)
            change *= rate
            root = np.sqrt(np.divide(v, 1 - 0.995**turn, out=g), out=g)
            root += 1e-8
            change /= root
            flat_p[at : at + PART] -= change
    return p


def valid_members(outputs: int) -> np.ndarray:
    """0 for places of a class that hold an output, a large negative number for the rest."""
    return np.where(np.arange(-(-outputs // CLASS) * CLASS) < outputs, 0, -1e9).astype(np.float32).reshape(-1, CLASS)


def _ones(x: np.ndarray) -> np.ndarray:
    return np.ones(x.shape[1], x.dtype)


def _must_level(p: dict[str, np.ndarray]) -> bool:
    """Whether a softmax must take off the largest value first: states lie within -1 and 1, so weights bound the values."""
    by_class = np.abs(p["to_class"]).sum(0) + np.abs(p["class_bias"])
    by_member = np.abs(p["to_member"]).sum(1) + np.abs(p["member_bias"])
    return not max(by_class.max(initial=0), by_member.max(initial=0)) < SAFE


def _softmax(x: np.ndarray, level: bool = True) -> np.ndarray:
    """Probabilities of each row, in place."""
    if level:
        x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x *= (1 / (x @ _ones(x)))[:, None]
    return x


def _window(p, state, before, target, start, valid, heads=None, room=None):
    """One window forward and back; a text's first token starts from an empty state, and targets below 0 do not count.

    ``room`` keeps the large arrays for the next window.
    """
    room = {} if room is None else room

    def empty(name: str, *shape: int) -> np.ndarray:
        if (name, shape) not in room:
            room[name, shape] = np.empty(shape, kind)
        return room[name, shape]

    streams, length = target.shape
    kind, cut = p["in"].dtype, 2 * HIDDEN
    previous, goal = before.T.ravel(), target.T.ravel()
    fresh = ~(before == start if heads is None else heads).T[:, :, None]
    # what leads to gates and what leads to candidates lies apart, so that a step's arrays are read in one run
    x, leads = p["embed"].take(previous, axis=0), p["embed"] @ p["in"] + p["bias"]
    (lead_gates, lead_c), (rec_gates, rec_c) = ([np.ascontiguousarray(part) for part in np.split(whole, [cut], axis=1)] for whole in (leads, p["rec"]))
    old, states, rec, z, r, gap, c = (empty(name, length, streams, HIDDEN) for name in ("old", "states", "rec", "z", "r", "gap", "c"))
    both = np.empty((streams, cut), kind)
    for t in range(length):
        own = previous[t * streams : (t + 1) * streams]
        np.multiply(state, fresh[t], out=old[t])
        np.matmul(old[t], rec_gates, out=both)
        both += lead_gates.take(own, axis=0)
        both *= 0.5
        np.tanh(both, out=both)
        both *= 0.5
        np.add(both[:, :HIDDEN], 0.5, out=z[t])
        np.add(both[:, HIDDEN:], 0.5, out=r[t])
        np.matmul(old[t], rec_c, out=rec[t])
        np.multiply(r[t], rec[t], out=c[t])
        c[t] += lead_c.take(own, axis=0)
        np.tanh(c[t], out=c[t])
        np.subtract(old[t], c[t], out=gap[t])
        state = np.multiply(z[t], gap[t], out=states[t])
        state += c[t]
    flat_states = states.reshape(-1, HIDDEN)
    weight, level = ((goal >= 0) / streams).astype(kind)[:, None], _must_level(p)
    goal = np.maximum(goal, 0)
    of, member, rows = goal // CLASS, goal % CLASS, np.arange(len(goal))
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    d, d_states, steps = empty("d", length, streams, len(valid)), empty("d_states", length, streams, HIDDEN), (length, streams)
    for x_t, own, at, share, d_t in zip(d, states, of.reshape(steps), weight.reshape(*steps, 1), d_states):  # a step's rows fit the cache
        np.matmul(own, p["to_class"], out=x_t)
        x_t += p["class_bias"]
        _softmax(x_t, level)
        x_t[rows[:streams], at] -= 1
        x_t *= share
        np.matmul(x_t, p["to_class"].T, out=d_t)
    d, d_states = d.reshape(len(rows), -1), d_states.reshape(-1, HIDDEN)
    grads["to_class"], grads["class_bias"] = flat_states.T @ d, np.ones(len(d), kind) @ d
    order = np.argsort(of.astype(np.int16), kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(valid) + 1))
    sorted_states, sorted_member, sorted_weight = flat_states.take(order, axis=0), member[order], weight[order]
    d_sorted, all_e, bias = np.empty_like(sorted_states), empty("e", len(rows), CLASS), p["member_bias"] + valid
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[k], cuts[k + 1])
        e = np.matmul(sorted_states[own], p["to_member"][k], out=all_e[own])
        e += bias[k]
        _softmax(e, level)
        e[rows[: len(e)], sorted_member[own]] -= 1
        e *= sorted_weight[own]
        grads["to_member"][k], grads["member_bias"][k] = sorted_states[own].T @ e, np.ones(len(e), kind) @ e
        np.matmul(e, p["to_member"][k].T, out=d_sorted[own])
    place = np.empty_like(order)
    place[order] = rows
    d_states += d_sorted.take(place, axis=0)
    d_states = d_states.reshape(length, streams, HIDDEN)
    da, db = (empty(name, length, streams, 3 * HIDDEN) for name in ("da", "db"))
    d_next = np.zeros_like(state)
    rest, dc = np.empty_like(state), np.empty_like(state)
    for t in reversed(range(length)):
        dh = d_states[t]
        dh += d_next
        np.subtract(1, z[t], out=rest)
        rest *= dh
        np.multiply(c[t], c[t], out=dc)
        np.subtract(1, dc, out=dc)
        dc *= rest
        rest *= gap[t]
        rest *= z[t]
        da[t, :, :HIDDEN], da[t, :, cut:] = rest, dc
        np.multiply(dc, rec[t], out=rest)
        rest *= r[t]
        rest *= np.subtract(1, r[t], out=gap[t])
        da[t, :, HIDDEN:cut] = rest
        db[t, :, :cut] = da[t, :, :cut]
        np.multiply(dc, r[t], out=db[t, :, cut:])
        np.multiply(dh, z[t], out=d_next)
        d_next += np.matmul(db[t], p["rec"].T, out=rest)
        d_next *= fresh[t]
    da = da.reshape(-1, 3 * HIDDEN)
    grads["in"], grads["bias"] = x.T @ da, np.ones(len(da), kind) @ da
    grads["rec"] = old.reshape(-1, HIDDEN).T @ db.reshape(-1, 3 * HIDDEN)
    grads["embed"] = sum_rows(previous.astype(_kind(len(p["embed"]))), da @ p["in"].T, len(p["embed"]))  # short numbers sort faster
    return state, grads


# ---- the model ----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """``tokens``: sorted hashes of known tokens with ``counts`` and ``outputs`` (-1: by bucket); mass per bucket; totals."""

    tokens: np.ndarray
    counts: np.ndarray
    outputs: np.ndarray
    bucket_output: np.ndarray
    bucket_mass: np.ndarray
    n_outputs: int
    total: int
    distinct: int
    network: dict[str, np.ndarray]

    @property
    def log_total(self) -> float:
        return float(np.log10(self.total + ALPHA * (self.distinct + 1)))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.full(len(hashes), -1)
        # hashes are spread evenly: their top bits lead to the few tokens that share them
        at = self.leads[(hashes >> np.uint64(64 - LEAD)).view(np.int64)]
        out, left = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(left):
            here = self.tokens.take(at, mode="clip")
            same = here == hashes
            out[left[same]] = at[same]
            on = np.flatnonzero((here < hashes) & (at < len(self.tokens) - 1))
            left, at, hashes = left[on], at[on] + 1, hashes[on]
        return out

    @cached_property
    def leads(self) -> np.ndarray:
        """The first known token of each value of a hash's top bits."""
        return np.searchsorted(self.tokens, np.arange(1 << LEAD, dtype=np.uint64) << np.uint64(64 - LEAD)).astype(np.int32)

    def numbers(self, place: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """The output of each token; the end has one of its own."""
        out = np.where(place >= 0, self.outputs[place] if len(self.outputs) else -1, -1)
        return np.where(out >= 0, out, np.where(bucket < 0, 0, self.bucket_output[bucket])).astype(np.int32)


def train(texts: DataFrame, counts: DataFrame, vocabulary: int = VOCABULARY, known: int = KNOWN, epochs: int = EPOCHS,
          shard: int = SHARD, rounds: int = ROUNDS, seed: int = 23) -> Model:
    """A model of ``texts`` (``doc_id, text``) with their ``token_counts``, trained on all of their tokens."""
    whole = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.asc(F.col("bucket") >= 0), F.desc("count"), "token").limit(known).toArrow()
    token, count, bucket = top["token"].to_numpy().view(np.uint64), top["count"].to_numpy(), top["bucket"].to_numpy()
    outputs = np.full(len(token), -1, np.int32)
    listed = np.flatnonzero(bucket >= 0)[:vocabulary].astype(np.int32)
    outputs[listed] = np.arange(len(listed)) + 1
    outputs[bucket < 0] = 0
    mass = np.full(BUCKETS, ALPHA)
    for r in counts.where("bucket >= 0").groupBy("bucket").agg((F.sum("count") + ALPHA * F.count("*")).alias("mass")).collect():  # at most BUCKETS rows
        mass[r["bucket"]] += r["mass"]
    np.subtract.at(mass, bucket[listed], count[listed] + ALPHA)
    n_outputs = 1 + len(listed) + BUCKETS
    order = np.argsort(token)
    model = Model(token[order], count[order], outputs[order], (1 + len(listed) + np.arange(BUCKETS)).astype(np.int32), np.maximum(mass, ALPHA), n_outputs, int(whole["n"]), int(whole["v"]), {})
    model.network = new_parameters(n_outputs, -(-n_outputs // CLASS), np.random.default_rng(seed))
    shards = max(1, -(-model.total // shard))
    runs, rounds = stage(dealt(texts, model, shards, seed), "runs"), min(rounds, shards)
    for turn in range(epochs * rounds):
        own = runs.where(F.pmod("shard", F.lit(rounds)) == turn % rounds)
        model.network = _round(own, model, -(-shards // rounds), rounds, turn / (epochs * rounds), (turn + 1) / (epochs * rounds))
    return model


def _kind(n_outputs: int) -> type:
    return np.uint16 if n_outputs < 1 << 16 else np.int32


def dealt(texts: DataFrame, model: Model, shards: int, seed: int = 23) -> DataFrame:
    """``shard, key, nth, numbers``: all tokens of all texts as outputs, in runs led by the token before (the start: ``n_outputs``)."""
    text = F.col("text").cast("string")
    rows = texts.select(text.alias("text"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("key"))
    kind, start = _kind(model.n_outputs), model.n_outputs
    sent = texts.sparkSession.sparkContext.broadcast((model.tokens, model.outputs, model.bucket_output))

    def read(batches):
        known, outputs, by_bucket = sent.value
        own = Model(known, known, outputs, by_bucket, by_bucket, 0, 0, 0, {})
        for batch in pieces(batches, 256):
            hashes, bucket, first = tokens(batch.column(0))
            numbers = own.numbers(own.places(hashes), bucket).astype(kind)
            of, nth, cells = [], [], []
            for i, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                for k, at in enumerate(range(low, high, RUN)):
                    cell = np.empty(min(RUN, high - at) + 1, kind)
                    cell[0], cell[1:] = numbers[at - 1] if k else start, numbers[at : at + len(cell) - 1]
                    of.append(i)
                    nth.append(k)
                    cells.append(cell.tobytes())
            key, nth = batch.column(1).to_numpy().view(np.uint64)[of], np.array(nth, np.int64)
            order = np.lexsort((nth, key))
            same = np.append(False, (key[order][1:] == key[order][:-1]) & (nth[order][1:] == nth[order][:-1]))
            place = np.arange(len(order))
            copy = np.empty(len(order), np.uint64)
            copy[order] = place - np.maximum.accumulate(np.where(same, 0, place))
            shard = mix(key + mix(nth.astype(np.uint64) * np.uint64(1 << 32) + copy)) % np.uint64(shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(nth), pa.array(cells, pa.binary())], ["shard", "key", "nth", "numbers"])

    return rows.mapInArrow(read, "shard int, key long, nth long, numbers binary")


def _sequence(cells: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token before each token, the token, and whether it heads a run."""
    numbers = np.frombuffer(b"".join(cells), kind).astype(np.int64)
    leads = np.concatenate([[0], np.cumsum([len(c) // np.dtype(kind).itemsize for c in cells])])[:-1].astype(np.int64)
    inner = np.ones(len(numbers), bool)
    inner[leads] = False
    at = np.flatnonzero(inner)
    return numbers[at - 1], numbers[at], ~inner[at - 1]


def _round(runs: DataFrame, model: Model, tasks: int, rounds: int, start: float, end: float) -> dict[str, np.ndarray]:
    """The mean of the parameters that each shard of ``runs`` leads to from the model's."""
    old, outputs, kind = model.network, model.n_outputs, _kind(model.n_outputs)
    size = sum(v.size for v in old.values())
    sent = runs.sparkSession.sparkContext.broadcast(old)

    def fit(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(shard, []).append(row)
        for shard in sorted(held):
            before, target, heads = _sequence([r[2] for r in sorted(held.pop(shard))], kind)
            p = fit_network(sent.value, before, target, heads, outputs, start, end)
            flat_p = np.concatenate([v.ravel() for v in p.values()])
            parts = [flat_p[low : low + PART].tobytes() for low in range(0, size, PART)]
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, len(target))), pa.array(parts, pa.binary())], ["part", "shard", "n", "numbers"])

    def mean(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append(row)
        for part, rows in held.items():
            rows.sort()
            whole = sum(n * np.frombuffer(x, np.float32).astype(np.float64) for _, n, x in rows) / sum(n for _, n, _ in rows)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([whole.astype(np.float32).tobytes()], pa.binary())], ["part", "numbers"])

    fitted = runs.repartitionById(tasks, F.expr(f"shard div {rounds}").cast("int")).mapInArrow(fit, "part int, shard int, n long, numbers binary")
    found = fitted.repartitionById(-(-size // PART), F.col("part")).mapInArrow(mean, "part int, numbers binary").toArrow().sort_by("part")
    if not found.num_rows:
        return old
    new = np.frombuffer(b"".join(found["numbers"].to_pylist()), np.float32)
    cuts = np.cumsum([v.size for v in old.values()])[:-1]
    return {k: x.reshape(v.shape).copy() for (k, v), x in zip(old.items(), np.split(new, cuts))}


#: What sums are multiplied by: a gate is taken as tanh of half its sum.
_HALVES = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)


def _leads(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings led by a one for the bias, and what takes them and states to the gates, turned and with halved sums of gates."""
    embed = np.ones((len(p["embed"]), EMBED + 1), p["embed"].dtype)
    embed[:, :EMBED] = p["embed"]
    lead = np.vstack([p["in"], p["bias"]]) * _HALVES
    return embed, np.ascontiguousarray(lead.T), np.ascontiguousarray((p["rec"] * _HALVES).T)


def _turn(a: np.ndarray, b: np.ndarray, old: np.ndarray, reset: np.ndarray, gap: np.ndarray, out: np.ndarray) -> None:
    """``step`` with a column per row of its states: ``a`` (from outputs) becomes the gates and the candidate, ``b`` comes from ``old``."""
    gates, c = a[: 2 * HIDDEN], a[2 * HIDDEN :]
    gates += b[: 2 * HIDDEN]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    np.multiply(gates[HIDDEN:], b[2 * HIDDEN :], out=reset)
    c += reset
    np.tanh(c, out=c)
    np.subtract(old, c, out=gap)
    np.multiply(gates[:HIDDEN], gap, out=out)
    out += c


def _states_and_scores(model: Model, numbers: np.ndarray, first: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Natural log probability of each token; state runs through each text, ``ABREAST`` texts of like length side by side, longest first.

    Some steps at a time share what needs no state before them; texts that end within these run on idly to the last of them.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    out, valid = np.zeros(len(numbers)), valid_members(model.n_outputs)
    embed, lead, turned = _leads(model.network)
    rec = turned.T.copy()
    waiting, held = [], 0

    def settle() -> None:
        at = np.concatenate([w[0] for w in waiting])
        out[at] = log_members(model.network, np.concatenate([w[1] for w in waiting]), numbers[at], valid)

    for low in range(0, len(order), ABREAST):
        own = order[low : low + ABREAST]
        live, t, longest = len(own), 0, int(sizes[own[0]])
        state = np.zeros((HIDDEN, live), np.float32)
        while t < longest:
            while sizes[own[live - 1]] <= t:
                live -= 1
            steps = min(max(4, 4 * ABREAST // live), longest - t)
            at = np.arange(t, t + steps)[:, None] + first[own[:live]]
            inside = at < first[own[:live] + 1]
            previous = numbers[np.clip(at - 1, 0, len(numbers) - 1)]
            if not t:
                previous[0] = model.n_outputs
            before = embed.take(previous, axis=0)
            gates = np.matmul(lead, before.transpose(0, 2, 1)) if live > 1 else (before[:, 0] @ lead.T)[:, :, None]
            states, (b, reset, gap) = np.empty((steps, HIDDEN, live), np.float32), (np.empty((n * HIDDEN, live), np.float32) for n in (3, 1, 1))
            state = np.ascontiguousarray(state[:, :live])
            for k in range(steps):
                if live > 1:
                    np.matmul(turned, state, out=b)
                else:  # one row is multiplied faster
                    np.matmul(state.T, rec, out=b.T)
                _turn(gates[k], b, state, reset, gap, states[k])
                state = states[k]
            waiting.append((at[inside], states.transpose(0, 2, 1)[inside]))
            held += len(waiting[-1][0])
            t += steps
            if held >= block:
                settle()
                waiting, held = [], 0
    if waiting:
        settle()
    return out


def score_documents(documents: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(tuple(getattr(model, f) for f in Model.__dataclass_fields__))
    schema = "doc_id long, n_tokens long, known long, base double, score double, rare array<struct<token:long,n:long>>"
    rare_type = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int64())]))

    def judge(batches):
        own = Model(*sent.value)
        log_count, log_mass = np.log10(own.counts + ALPHA), np.log10(own.bucket_mass)
        for batch in pieces(batches, 4096):
            hashes, bucket, first = tokens(batch.column(1))
            place = own.places(hashes)
            numbers = own.numbers(place, bucket)
            log_p = _states_and_scores(own, numbers, first) / np.log(10)
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            seen = place >= 0
            share = np.zeros(len(hashes))
            share[seen] = log_count[place[seen]]
            share[~seen & (bucket < 0)] = np.log10(ALPHA)
            by_bucket = numbers > len(own.outputs[own.outputs > 0])
            score = log_p + np.where(by_bucket, share - log_mass[np.maximum(bucket, 0)], 0)
            sums = [np.bincount(of, x, batch.num_rows) for x in (seen, share, score)]
            other = np.flatnonzero(~seen & (bucket >= 0))
            pairs = np.empty((len(other), 2), np.uint64)
            pairs[:, 0], pairs[:, 1] = of[other], hashes[other]
            sort = np.lexsort((pairs[:, 1], pairs[:, 0]))
            pairs = pairs[sort]
            new = np.ones(len(pairs), bool)
            new[1:] = (pairs[1:] != pairs[:-1]).any(1)
            heads = np.flatnonzero(new)
            times = np.diff(np.append(heads, len(pairs)))
            ends = np.searchsorted(pairs[heads, 0].astype(np.int64), np.arange(batch.num_rows + 1)).astype(np.int32)
            cells = pa.StructArray.from_arrays([pa.array(pairs[heads, 1].view(np.int64)), pa.array(times.astype(np.int64))], fields=list(rare_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2]), pa.ListArray.from_arrays(pa.array(ends), cells)],
                ["doc_id", "n_tokens", "known", "base", "score", "rare"],
            )

    judged = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, schema)
    rows = stage(judged.withColumn("row", F.monotonically_increasing_id()), "judged")
    rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.token", "x.n").join(counts.select("token", "count"), "token", "left")
    own = F.coalesce("count", F.lit(0))
    # what the model adds for a token of a bucket is log10 of the same term, so both scores get it
    summed = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(own + F.lit(ALPHA))).alias("rare_log"), F.sum(F.when(own > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    add = F.coalesce("rare_log", F.lit(0.0))
    return rows.drop("rare").join(summed, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + add - F.col("n_tokens") * F.lit(model.log_total)).alias("base_score"),
        (F.col("score") + add).alias("score"),
    )

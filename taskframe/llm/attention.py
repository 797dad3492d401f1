"""A small causal self-attention model over subword ids, in numpy.

The next id is predicted in three steps: its group, its class within the group,
and the id within the class.  The scores of groups and classes are those of the
previous id's successors in the whole training corpus, corrected by a causal
attention layer over the context; ids within a class follow the counts of the
previous id.  One head attends with a learned bias by distance; its output, the
last two ids' embeddings and a rectifier give the correction.  All projections
of an embedding are read from one table per id.
"""

from __future__ import annotations

import numpy as np

# Context of a window, positions it scores, widths, groups, classes of a group.
CONTEXT, STRIDE = 24, 16
EMBED, HEAD, HIDDEN, GROUPS, CLASSES = 32, 16, 32, 16, 16
PRIOR, CLIP = 4.0, 1.0
_NEVER = np.float32(-1e9)
# Rows that `_gathered` adds at once.
BLOCK = 8
# Steps over which the rate rises; it falls with the root of the step after them.
WARM = 32


def classes_of(pairs: np.ndarray, classes: int = GROUPS * CLASSES) -> np.ndarray:
    """A class per id: ids with like neighbours share one, all of like size."""
    size = len(pairs)
    rng = np.random.default_rng(7)
    logs = np.log1p(pairs).astype(np.float32)
    sides = np.hstack([logs, logs.T])
    sides -= sides.mean(axis=0)
    basis = rng.standard_normal((sides.shape[1], 16)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(sides.T @ (sides @ basis))
    places = sides @ basis
    out = np.zeros(size, np.int64)
    parts = [np.arange(size)]
    while len(parts) < classes:
        halves = []
        for part in parts:
            axis = places[part].var(axis=0).argmax()
            order = part[np.argsort(places[part, axis], kind="stable")]
            halves += [order[:len(order) // 2], order[len(order) // 2:]]
        parts = halves
    for n, part in enumerate(parts):
        out[part] = n
    return out


class Tables:
    """What the corpus counts say: scores of groups and of classes by previous id,
    and log probabilities of ids within classes."""

    def __init__(self, pairs: np.ndarray) -> None:
        size, every = len(pairs), GROUPS * CLASSES
        leaf = classes_of(pairs)
        self.group, self.place = leaf // CLASSES, leaf % CLASSES
        onto = np.zeros((size, every))
        onto[np.arange(size), leaf] = 1
        single = pairs.sum(axis=0) + 0.5
        by_leaf = pairs @ onto
        share = (single @ onto) / single.sum()
        smooth = (by_leaf + PRIOR * share) / (by_leaf.sum(axis=1, keepdims=True) + PRIOR)
        self.groups = np.log(smooth.reshape(size, GROUPS, CLASSES).sum(axis=2)).astype(np.float32)
        self.classes = np.log(smooth).astype(np.float32).reshape(size, GROUPS, CLASSES)
        inside = single / (single @ onto)[leaf]
        self.inside = np.log((pairs + PRIOR * inside) / (by_leaf[:, leaf] + PRIOR)).astype(np.float32)


Parameters = dict[str, np.ndarray]
# Columns of the projected table: query, key, value, this id, the id before.
_CUTS = np.cumsum([HEAD, HEAD, HIDDEN, HIDDEN, HIDDEN])


def initial(size: int) -> Parameters:
    rng = np.random.default_rng(11)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": normal(size, EMBED, scale=0.3), "project": normal(EMBED, int(_CUTS[-1]), scale=EMBED ** -0.5),
        "distance": np.zeros(CONTEXT, np.float32), "shift": np.zeros(HIDDEN, np.float32),
        "groups": normal(HIDDEN, GROUPS, scale=0.02), "group_bias": np.zeros(GROUPS, np.float32),
        "classes": normal(GROUPS, HIDDEN, CLASSES, scale=0.02),
        "class_bias": np.zeros((GROUPS, CLASSES), np.float32)}


def table_of(p: Parameters) -> list[np.ndarray]:
    """Per id: query (scaled) and its part, key and value, the part of the id before."""
    embed, (ask, key, value, this, last) = p["embed"], np.split(p["project"], _CUTS[:-1], axis=1)
    mine = embed @ np.hstack([ask * np.float32(HEAD ** -0.5), this])
    mine[:, HEAD:] += p["shift"]
    return [mine, embed @ np.hstack([key, value]), embed @ last]


def _distances() -> np.ndarray:
    """How far back key j lies from query i of a window, negative if ahead."""
    return (np.arange(STRIDE)[:, None] + CONTEXT - STRIDE) - np.arange(CONTEXT)[None, :]


_BACK = _distances()


# Shares are quotients of plain exponentials while these stay in range.
_LARGE, _SMALL = 60.0, 1e-30
_KEYS = np.ones(CONTEXT, np.float32)
_SEEN = (_BACK >= 0).astype(np.float32)


class Forward:
    """One batch of windows: ids (n, CONTEXT + 1), the first one before the context.

    `ahead` tells how many keys at the start of each window are padding.
    """

    def __init__(self, table: list[np.ndarray], p: Parameters, tables: Tables, ids: np.ndarray, ahead: np.ndarray,
                 targets: np.ndarray) -> None:
        n = len(ids)
        keys, asks = ids[:, 1:], ids[:, 1 + CONTEXT - STRIDE:]
        before = ids[:, CONTEXT - STRIDE:CONTEXT]
        mine, seen, last = table
        mine, seen = mine.take(asks, 0), seen.take(keys, 0)
        self.q, self.k, self.v = mine[:, :, :HEAD], seen[:, :, :HEAD], seen[:, :, HEAD:]
        self.p, self.total = self._attention(p["distance"], ahead)
        # What is left of the quotient, by query.
        self.inverse = 1 / self.total[:, None]
        self.mean = (self.p @ self.v).reshape(-1, HIDDEN)
        self.mean *= self.inverse
        hidden = last.take(before, 0).reshape(-1, HIDDEN)
        hidden += mine[:, :, HEAD:].reshape(-1, HIDDEN)
        hidden += self.mean
        np.maximum(hidden, 0, out=hidden)
        # Queries in order of their target's group, so each group is one product.
        goal = targets.ravel()
        group = tables.group.take(goal)
        self.order = np.argsort(group.astype(np.int16), kind="stable")
        self.bounds = np.r_[0, np.cumsum(np.bincount(group, minlength=GROUPS))].tolist()
        self.hidden, self.goal, self.group = hidden.take(self.order, 0), goal.take(self.order), group.take(self.order)
        self.place = tables.place.take(self.goal)
        prev = asks.ravel().take(self.order)
        scores = self.hidden @ p["groups"]
        scores += (tables.groups + p["group_bias"]).take(prev, 0)
        self.of_group, self.group_total, log_group = _shares(scores, self.group)
        scores = np.empty((n * STRIDE, CLASSES), np.float32)
        for g, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            np.matmul(self.hidden[lo:hi], p["classes"][g], out=scores[lo:hi])
        scores += tables.classes.reshape(-1, CLASSES).take(prev * GROUPS + self.group, 0)
        scores += p["class_bias"].take(self.group, 0)
        self.of_class, self.class_total, log_class = _shares(scores, self.place)
        self.logs = log_group + log_class
        self.logs += tables.inside.ravel().take(prev * np.int64(len(tables.inside)) + self.goal)
        self.ids = ids

    def _attention(self, distance: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of the scores, 0 where a key is not seen, and their sums by query."""
        s = self.q @ self.k.transpose(0, 2, 1)
        s += distance[np.maximum(_BACK, 0)]
        padded = np.flatnonzero(ahead)
        unseen = np.arange(CONTEXT) < ahead[padded, None]
        if s.max(initial=0) < _LARGE:
            made = np.exp(s)
            made *= _SEEN
            if len(padded):
                made[padded] *= ~unseen[:, None, :]
            total = made.reshape(-1, CONTEXT) @ _KEYS
            if total.min(initial=1) > _SMALL:
                return made, total
        s += np.where(_BACK >= 0, np.float32(0), _NEVER)
        s[padded] += np.where(unseen, _NEVER, np.float32(0))[:, None, :]
        # Every query sees itself, so each row has a greatest score.
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        return s, s.reshape(-1, CONTEXT) @ _KEYS

    def log_probability(self) -> np.ndarray:
        """Natural logarithm of each target, (n, STRIDE)."""
        out = np.empty(len(self.goal), np.float32)
        out[self.order] = self.logs
        return out.reshape(-1, STRIDE)

    def gradients(self, p: Parameters, weight: np.ndarray) -> Parameters:
        """Of the mean negative log probability over weighted queries."""
        c = _CUTS
        at = np.arange(len(self.goal)) * GROUPS
        each = weight.ravel().take(self.order) / max(weight.sum(), 1)
        of_group, of_class = self.of_group, self.of_class
        of_group *= (each / self.group_total)[:, None]
        of_group.ravel()[at + self.group] -= each
        of_class *= (each / self.class_total)[:, None]
        of_class.ravel()[at // GROUPS * CLASSES + self.place] -= each
        one = np.ones(len(of_group), np.float32)
        out = {"groups": self.hidden.T @ of_group, "group_bias": one @ of_group,
               "classes": np.empty_like(p["classes"]), "class_bias": np.empty_like(p["class_bias"])}
        back, other = of_group @ p["groups"].T, np.empty_like(self.hidden)
        for g, (lo, hi) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            np.matmul(self.hidden[lo:hi].T, of_class[lo:hi], out=out["classes"][g])
            np.matmul(one[lo:hi], of_class[lo:hi], out=out["class_bias"][g])
            np.matmul(of_class[lo:hi], p["classes"][g].T, out=other[lo:hi])
        back += other
        back *= self.hidden > 0
        dh = other
        dh[self.order] = back
        out["shift"] = one @ dh
        # The shares are quotients: their divisor is taken once, by query.
        part = dh * self.inverse
        less = np.einsum("ij,ij->i", part, self.mean).reshape(-1, STRIDE, 1)
        dh, part = dh.reshape(-1, STRIDE, HIDDEN), part.reshape(-1, STRIDE, HIDDEN)
        ds = part @ self.v.transpose(0, 2, 1)
        ds -= less
        ds *= self.p
        out["distance"] = np.bincount(
            np.maximum(_BACK, 0).ravel(), ds.sum(axis=0).ravel(), CONTEXT).astype(np.float32)
        # By place of the window: what each id's projections are to move by; the last row stays zero.
        n, own = len(self.ids), CONTEXT - STRIDE
        flat = np.empty((n * (CONTEXT + 1) + 1, int(c[-1])), np.float32)
        flat[-1] = 0
        moves = flat[:-1].reshape(n, CONTEXT + 1, -1)
        moves[:, :own + 1, :c[0]] = 0
        moves[:, own + 1:, :c[0]] = ds @ self.k
        moves[:, 0, c[0]:c[2]] = 0
        moves[:, 1:, c[0]:c[1]] = ds.transpose(0, 2, 1) @ self.q
        moves[:, 1:, c[1]:c[2]] = self.p.transpose(0, 2, 1) @ part
        moves[:, :own + 1, c[2]:c[3]] = 0
        moves[:, own + 1:, c[2]:c[3]] = dh
        moves[:, :own, c[3]:] = moves[:, CONTEXT:, c[3]:] = 0
        moves[:, own:CONTEXT, c[3]:] = dh
        made = _gathered(self.ids.ravel(), flat, len(p["embed"]))
        made[:, :HEAD] *= np.float32(HEAD ** -0.5)
        out["embed"], out["project"] = made @ p["project"].T, p["embed"].T @ made
        return out


def _shares(x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row numbers in proportion to its shares, their sum, and the logarithm of
    the share at its goal."""
    at = np.arange(len(x)) * x.shape[1] + goal
    at_goal = x.ravel().take(at)
    if x.max(initial=0) < _LARGE:
        made = np.exp(x)
        total = made @ np.ones(x.shape[1], np.float32)
        if total.min(initial=1) > _SMALL:
            return made, total, at_goal - np.log(total)
    share, log = _softmax(x, goal)
    return share, np.ones(len(x), np.float32), log


def _softmax(x: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's shares, and the logarithm of the share at its goal."""
    x -= x.max(axis=1, keepdims=True)
    at_goal = x[np.arange(len(x)), goal]
    np.exp(x, out=x)
    total = x @ np.ones((x.shape[1], 1), np.float32)
    x /= total
    return x, at_goal - np.log(total[:, 0])


def _gathered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """The sum of rows by index.  A last row, of zeros, has no index."""
    counts = np.bincount(at, minlength=size)
    order = np.argsort(at.astype(np.int16 if size <= 1 << 15 else np.int64), kind="stable")
    out = np.zeros((size, rows.shape[1]), np.float32)
    found = np.flatnonzero(counts)
    out[found] = _summed(order, counts.take(found), rows)
    return out


def _summed(order: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the first counts[0] of the ordered rows, the next counts[1] and so on.

    Rows of a sum are added in blocks of BLOCK, all first rows of blocks at once, all
    second ones and so on, then the blocks in the same way.  The last row is zero.
    """
    blocks = (counts + (BLOCK - 1)) // BLOCK
    ends, total = np.cumsum(blocks), int(blocks.sum())
    first = np.repeat(np.cumsum(counts) - counts, counts)
    rank = np.arange(len(order)) - first
    place = np.repeat(ends - blocks, counts) + rank // BLOCK
    taken = np.full(BLOCK * total, len(rows) - 1)
    taken[rank % BLOCK * total + place] = order
    taken = taken.reshape(BLOCK, total)
    sums = rows.take(taken[0], 0)
    for plane in taken[1:]:
        sums += rows.take(plane, 0)
    more = blocks > 1
    if not more.any():
        return sums
    out = sums.take(ends - blocks, 0)
    part = np.flatnonzero(np.repeat(more, blocks))
    kept = np.concatenate([sums.take(part, 0), np.zeros((1, sums.shape[1]), np.float32)])
    out[more] = _summed(np.arange(len(part)), blocks[more], kept)
    return out


class Adam:
    def __init__(self, p: Parameters, rate: float) -> None:
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: Parameters, g: Parameters) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())))
        if not np.isfinite(norm):
            raise FloatingPointError(f"gradient is not finite at step {self.n}")
        rate = self.rate * min(self.n / WARM, (WARM / self.n) ** 0.5)
        cut = min(1.0, CLIP / max(norm, 1e-12))
        # Both means as they stand after n steps from zero; the roots' factor joins the rate.
        root = (1 - 0.99 ** self.n) ** 0.5
        rate, least = np.float32(rate * root / (1 - 0.9 ** self.n)), np.float32(1e-7 * root)
        for k, x in g.items():
            m, s = self.m[k], self.s[k]
            m *= np.float32(0.9)
            m += x * np.float32(0.1 * cut)
            s *= np.float32(0.99)
            x = x * np.float32(0.1 * cut)
            x *= x
            s += x
            x = np.sqrt(s, out=x)
            x += least
            np.divide(m, x, out=x)
            x *= rate
            p[k] -= x


Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def windows(texts: list[np.ndarray], end: int) -> Windows:
    """Overlapping windows of texts (ids, each ending with `end`): every id is the
    target of exactly one query.

    Returns ids (n, CONTEXT + 1), padding keys per window, targets and weights
    (n, STRIDE), and the text of each window.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-sizes // STRIDE)
    lead = CONTEXT - STRIDE + 1
    starts = np.r_[0, np.cumsum(blocks * STRIDE + lead)[:-1]]
    total = int((blocks * STRIDE + lead).sum())
    flat = np.concatenate(texts) if texts else np.empty(0, np.int64)
    within = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(sizes)[:-1]], sizes)
    place = np.repeat(starts + lead, sizes) + within
    seen = np.full(total, end, np.int32)
    goal = np.full(total, end, np.int32)
    real = np.zeros(total, np.float32)
    goal[place], real[place] = flat, 1
    # The id before each target is what the model sees at its place.
    later = within > 0
    seen[place[later]] = flat[np.flatnonzero(later) - 1]
    owner = np.repeat(np.arange(len(texts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    first = np.repeat(starts, blocks) + number * STRIDE
    ids = seen[first[:, None] + np.arange(CONTEXT + 1)]
    at = first[:, None] + lead + np.arange(STRIDE)
    ahead = np.maximum(0, CONTEXT - STRIDE - number * STRIDE)
    return ids, ahead, goal[at], real[at], owner


def runs(flat: np.ndarray, sizes: np.ndarray, end: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of texts that stand one after another, up to `length` of a text in a row.

    A row (int16) has the padding keys and the ids of its first window, then the targets of
    all, -1 after the text's end.  Also returns how many windows each row has.
    """
    wide, lead = length * STRIDE, CONTEXT - STRIDE + 2
    blocks = -(-sizes // wide)
    starts = np.cumsum(blocks * wide + lead) - (blocks * wide + lead)
    seen = np.full(int((blocks * wide + lead).sum()), -1, np.int16)
    seen[(starts[:, None] + np.arange(lead)).ravel()] = end
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen[np.repeat(starts + lead, sizes) + within] = flat
    number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    rows = np.empty((len(number), 2 + CONTEXT + wide), "<i2")
    body = seen[(np.repeat(starts, blocks) + number * wide)[:, None] + np.arange(lead + wide)]
    rows[:, 0] = np.where(number == 0, CONTEXT - STRIDE, 0)
    rows[:, 1:2 + CONTEXT] = np.where(body[:, :CONTEXT + 1] < 0, end, body[:, :CONTEXT + 1])
    rows[:, 2 + CONTEXT:] = body[:, lead:]
    return rows, -(-np.minimum(np.repeat(sizes, blocks) - number * wide, wide) // STRIDE)


def of_runs(rows: np.ndarray, deal: np.ndarray, turn: int, turns: int, end: int) -> tuple[np.ndarray, ...]:
    """Ids, padding keys, targets and weights of the windows in rows of `runs` that are dealt
    to a turn; `deal` is that of each row's first window."""
    lead = CONTEXT - STRIDE + 2
    body = np.hstack([rows[:, 1:1 + lead], rows[:, 2 + CONTEXT:]])
    each = np.lib.stride_tricks.sliding_window_view(body, lead + STRIDE, axis=1)[:, ::STRIDE]
    number = np.arange(each.shape[1])
    taken = ((deal[:, None] + number) % turns == turn) & (each[:, :, lead] >= 0)
    ahead = np.where(number == 0, rows[:, :1], 0)[taken]
    found = each[taken].astype(np.int32)
    ids, goal = found[:, :CONTEXT + 1], found[:, lead:]
    return np.where(ids < 0, end, ids), ahead, np.maximum(goal, 0), (goal >= 0).astype(np.float32)


def log_probabilities(p: Parameters, table: list[np.ndarray], tables: Tables, texts: list[np.ndarray], end: int,
                      batch: int = 192) -> np.ndarray:
    """The log10 probability of each text, every id scored once."""
    out = np.zeros(len(texts))
    ids, ahead, targets, weight, owner = windows(texts, end)
    for at in range(0, len(ids), batch):
        part = slice(at, at + batch)
        f = Forward(table, p, tables, ids[part], ahead[part], targets[part])
        logs = (f.log_probability() * weight[part]).sum(axis=1, dtype=np.float64)
        out += np.bincount(owner[part], logs, len(texts))
    return out / np.log(10)


def train(p: Parameters, tables: Tables, batches, rate: float) -> int:
    """Adam over batches of windows (ids, ahead, targets, weights); the number of windows."""
    adam, n = Adam(p, rate), 0
    for ids, ahead, targets, weight in batches:
        f = Forward(table_of(p), p, tables, ids, ahead, targets)
        adam.step(p, f.gradients(p, weight))
        n += len(ids)
    return n

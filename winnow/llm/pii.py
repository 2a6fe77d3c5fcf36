"""Personal data and secrets: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Characters are ASCII or "beyond ASCII". The network reads windows of WINDOW characters in both directions and scores each
character's tag (outside; begin or inside of one of KINDS); a linear-chain CRF adds transition scores, is trained by its
exact gradient and decoded by Viterbi. Training text is made here: pseudo-words and ordinary numbers as background, and
entities of many written forms at known places (labelled(), seeded).

Documents are covered whole by windows that overlap by half. Each window's spans are then reconciled over the document:
spans cut off at a window's edge are joined with what overlaps them in the next window, equal spans from several windows add
their votes, and of spans that still overlap the set with the greatest total of votes times length is kept. Each kind
holds a digit or an "@" by definition; spans without are dropped, so windows without cannot give a span and are not decoded.

Defined results: a null or empty text has no span. Offsets count characters from 0, end is exclusive. Rows are scanned one by
one: repeated rows give repeated spans. Rows without doc_id are left out; empty input gives no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from winnow.llm import vec
from winnow.llm.common import texts

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "SSN", "IBAN")
TAGS = 1 + 2 * len(KINDS)
WINDOW, HIDDEN, EMBED, SYMBOLS, SEED = 192, 24, 12, 130, 42
_WIDE, _PAD = 128, 129
STEPS, BATCH, LENGTH, RATE = 450, 64, 96, 0.015


# labelled spans


_SYLLABLES = "an er th on in re nd ou st en of es ti ha le la de el que ci ar os ez ich sch ver ung heit ein über é è ção ñ ß ment tion eau aux a o is it that zu der die".split()
_JUNK = ("###", "%%%", "&&&", "***", "$$$", "!!", "|")


def _digits(r: np.random.Generator, n: int) -> str:
    return "".join(map(str, r.integers(0, 10, n)))


def _chars(r: np.random.Generator, n: int, of: str) -> str:
    return "".join(of[i] for i in r.integers(0, len(of), n))


def _word(r: np.random.Generator) -> str:
    w = "".join(_SYLLABLES[i] for i in r.integers(0, len(_SYLLABLES), r.integers(1, 5)))
    k = r.integers(0, 12)
    return w.upper() if k == 0 else w.capitalize() if k < 3 else w


def _entity(r: np.random.Generator) -> tuple[str, str, str, str]:
    """(kind, text before, span, text after)."""
    kind = KINDS[r.choice(len(KINDS), p=[0.2, 0.18, 0.16, 0.16, 0.16, 0.07, 0.07])]
    k = int(r.integers(0, 8))
    if kind == "EMAIL":
        local = "".join(_SYLLABLES[i] for i in r.integers(0, 30, r.integers(1, 5)))
        local += ("", _digits(r, 2), "." + _digits(r, 2), "_" + _word(r).lower(), "-" + _word(r).lower(), "." + _word(r).lower(), "+" + _digits(r, 1), "." + _digits(r, 2))[k]
        host = ("mail" + _digits(r, 1) + ".example", "example", _word(r).lower(), "mail" + _digits(r, 1) + ".example", "mx." + _word(r).lower())[int(r.integers(0, 5))]
        span = f"{local}@{host}.{('com', 'org', 'net', 'de', 'io', 'co.uk')[int(r.integers(0, 6))]}"
        span = span.upper() if r.integers(0, 12) == 0 else span
    elif kind == "PHONE":
        a, b, c = _digits(r, 3), _digits(r, 3), _digits(r, 4)
        span = (f"+1 ({a}) {b}-{c}", f"+1 ({a}) 555-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{_digits(r, 2)} {a} {b}{c}", f"+1-{a}-{b}-{c}", f"+{_digits(r, 2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}")[k]
    elif kind == "IP":
        span = ".".join(str(x) for x in r.integers(0, 256, 4))
    elif kind == "CARD":
        d = _digits(r, 16)
        sep = ("", "", "", "", "", "-", " ", "")[k]
        span = sep.join(d[i : i + 4] for i in range(0, 16, 4)) if k < 7 else _digits(r, int(r.choice([13, 14, 15, 19])))
    elif kind == "SSN":
        span = f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}"
    elif kind == "IBAN":
        d = ("DE", "FR", "ES", "GB")[k % 4] + _digits(r, 20)
        span = d if k < 4 else " ".join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        name = ("token", "api_key", "secret", "password", "key", "access_token")[int(r.integers(0, 6))]
        name = "token" if r.integers(0, 3) == 0 else name
        eq = (" = ", "=", ": ", " = ")[int(r.integers(0, 4))]
        quote = ('"', "'", "", '"')[int(r.integers(0, 4))]
        hexa = _chars(r, int(r.choice([32, 40, 40, 64])), "0123456789abcdef")
        mixed = string.ascii_letters + string.digits
        if k < 4:
            return kind, f"{name}{eq}{quote}", hexa, quote
        if k == 4 and r.integers(0, 2):
            return kind, f"{name}{eq}{quote}", _chars(r, int(r.integers(16, 40)), mixed) + _digits(r, 1), quote
        if k == 4:
            value = _chars(r, int(r.integers(10, 40)), string.ascii_letters) if r.integers(0, 2) else "".join(_SYLLABLES[i] for i in r.integers(0, 30, r.integers(5, 10)))
            return kind, f"{name}{eq}{quote}", value, quote
        span = (f"AKIA{_chars(r, 15, string.ascii_uppercase + string.digits)}{_digits(r, 1)}", f"ghp_{_chars(r, 35, mixed)}{_digits(r, 1)}", f"sk-{_chars(r, 30, mixed)}{_digits(r, 1)}")[k - 5]
    return kind, "", span, ""


def _number(r: np.random.Generator) -> str:
    k = int(r.integers(0, 12))
    y, m, d = int(r.integers(1900, 2100)), int(r.integers(1, 13)), int(r.integers(1, 29))
    return (str(y), "2.0", "4.0.", "3.", f"{y}-{m:02d}-{d:02d}", f"{d}/{m}/{y}", f"{_digits(r, 2)}:{_digits(r, 2)}", f"${_digits(r, 3)}.{_digits(r, 2)}", f"v{m}.{d}.{k}", _digits(r, int(r.integers(1, 9))), f"{_digits(r, 2)}%", f"{d}.{m}.{y}", )[k]


def labelled(n: int, seed: int = SEED, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[str], list[list[tuple[int, int, str]]]]:
    """(symbols, tags, texts, spans) of n windows with labelled spans."""
    r = np.random.default_rng(seed)
    all_text, all_spans = [], []
    for _ in range(n):
        out, spans, at = [], [], 0
        junk = r.integers(0, 8) == 0
        rate = 0.02 if r.integers(0, 4) == 0 else 0.14
        while at < length + 40:
            u = r.random()
            before, span, after, kind = "", "", "", ""
            if u < rate:
                kind, before, span, after = _entity(r)
            elif u < rate + 0.08:
                before = _number(r)
            elif u < rate + 0.11:  # assignments of what is no secret
                before = _word(r) + (" = ", "=", ": ", ":")[int(r.integers(0, 4))] + ('"', "'", "", "")[int(r.integers(0, 4))] + _word(r)
            else:
                before = _word(r)
            if junk:
                after += _JUNK[int(r.integers(0, len(_JUNK)))]
            elif r.integers(0, 7) == 0:
                after += ",.;:)?"[int(r.integers(0, 6))]
            if kind:
                spans.append((at + len(before), at + len(before) + len(span), kind))
            piece = before + span + after + ("\n" if r.integers(0, 15) == 0 else " ")
            out.append(piece)
            at += len(piece)
        cut = int(r.integers(0, 40)) if r.integers(0, 2) else 0
        text = "".join(out)[cut : cut + length]
        all_text.append(text)
        all_spans.append([(max(0, a - cut), min(length, b - cut), k) for a, b, k in spans if b > cut and a < cut + length])
    syms, tags = np.full((n, length), _PAD, np.uint8), np.zeros((n, length), np.int64)
    for i, (t, ss) in enumerate(zip(all_text, all_spans)):
        s = np.array([min(ord(c), _WIDE) for c in t], np.uint8)
        syms[i, : len(s)] = s
        for a, b, k in ss:
            tags[i, a:b] = 2 + 2 * KINDS.index(k)
            tags[i, a] -= 1
    return syms, tags, all_text, all_spans


# the network


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * z) + np.float32(0.5)


class Tagger:
    """Parameters and passes; arrays are (direction, window, unit), float32."""

    def __init__(self, seed: int = SEED):
        r, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s, k: r.normal(0, k**-0.5, s).astype(np.float32)
        self.p = {"E": f(SYMBOLS, EMBED, k=EMBED), "Wx": f(2, EMBED, 4 * h, k=EMBED), "Wh": f(2, h, 4 * h, k=h), "b": np.zeros((2, 4 * h), np.float32), "Wo": f(2 * h, TAGS, k=2 * h), "bo": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
        self.p["b"][:, h : 2 * h] = 1
        inside = np.arange(2, TAGS, 2)
        self.barred = np.zeros((TAGS, TAGS), bool)  # an inside tag follows its own begin or inside only
        for t in inside:
            self.barred[:, t] = True
            self.barred[[t - 1, t], t] = False

    def _transitions(self) -> np.ndarray:
        return np.where(self.barred, np.float32(-1e4), self.p["A"])

    def run(self, sym: np.ndarray, keep: bool = False):
        """Emission scores (place, window, tag); with keep also what the gradient needs."""
        p, h, (n, length) = self.p, HIDDEN, sym.shape
        table = np.einsum("se,dez->dsz", p["E"], p["Wx"]) + p["b"][:, None]
        both = np.stack([sym, sym[:, ::-1]])
        hid, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        hs, past = np.empty((length, 2, n, h), np.float32), []
        for t in range(length):
            z = np.stack([table[0][both[0, :, t]], table[1][both[1, :, t]]])
            z += hid @ p["Wh"]
            s = _sigmoid(z[..., : 3 * h])
            g = np.tanh(z[..., 3 * h :])
            old_h, old_c = hid, cell
            cell = s[..., h : 2 * h] * cell + s[..., :h] * g
            tc = np.tanh(cell)
            hid = s[..., 2 * h :] * tc
            hs[t] = hid
            if keep:
                past.append((s, g, tc, old_h, old_c))
        out = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
        scores = out @ p["Wo"] + p["bo"]
        return (scores, out, past, both, table) if keep else scores

    def gradients(self, sym: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, h, (n, length) = self.p, HIDDEN, sym.shape
        em, out, past, both, _ = self.run(sym, True)
        a = self._transitions()
        alpha = np.empty_like(em)
        alpha[0] = em[0] + p["first"]
        for t in range(1, length):
            x = alpha[t - 1][:, :, None] + a
            m = x.max(1)
            alpha[t] = em[t] + m + np.log(np.exp(x - m[:, None]).sum(1))
        m = alpha[-1].max(1)
        logz = m + np.log(np.exp(alpha[-1] - m[:, None]).sum(1))
        beta = np.zeros_like(em)
        da = np.zeros_like(a)
        for t in range(length - 2, -1, -1):
            x = a + (em[t + 1] + beta[t + 1])[:, None, :]
            m = x.max(2)
            e = np.exp(x - m[..., None])
            beta[t] = m + np.log(e.sum(2))
            da += np.exp(alpha[t][:, :, None] + x - logz[:, None, None]).sum(0)
        dem = np.exp(alpha + beta - logz[:, None])
        i, place = np.arange(n), tags.T
        gold = em[np.arange(length)[:, None], i, place].sum(0) + p["first"][place[0]] + a[place[:-1], place[1:]].sum(0)
        dem[np.arange(length)[:, None], i, place] -= 1
        np.add.at(da, (place[:-1], place[1:]), -1)
        g = {"A": np.where(self.barred, 0, da), "first": dem[0].sum(0), "bo": dem.sum((0, 1)), "Wo": out.reshape(-1, 2 * h).T @ dem.reshape(-1, TAGS)}
        dout = dem @ p["Wo"].T
        dhs = np.stack([dout[..., :h], dout[::-1, :, h:]], 1)
        dwh, dzs = np.zeros_like(p["Wh"]), np.empty((length, 2, n, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        back = p["Wh"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            s, gg, tc, old_h, old_c = past[t]
            dh = dh + dhs[t]
            dc = dc + dh * s[..., 2 * h :] * (1 - tc * tc)
            dz = dzs[t]
            dz[..., :h], dz[..., h : 2 * h], dz[..., 2 * h : 3 * h] = dc * gg, dc * old_c, dh * tc
            dz[..., : 3 * h] *= s * (1 - s)
            dz[..., 3 * h :] = dc * s[..., :h] * (1 - gg * gg)
            dwh += old_h.transpose(0, 2, 1) @ dz
            dc = dc * s[..., h : 2 * h]
            dh = dz @ back
        dtable = np.zeros((2, SYMBOLS, 4 * h), np.float32)
        for d in range(2):
            one = np.zeros((SYMBOLS, length * n), np.float32)
            one[both[d].T.ravel(), np.arange(length * n)] = 1
            dtable[d] = one @ dzs[:, d].reshape(-1, 4 * h)
        g |= {"Wh": dwh, "b": dtable.sum(1), "Wx": np.einsum("se,dsz->dez", p["E"], dtable), "E": np.einsum("dsz,dez->se", dtable, p["Wx"])}
        return float((logz - gold).mean()), {k: v / n for k, v in g.items()}

    def fit(self, steps: int = STEPS, seed: int = SEED) -> Tagger:
        sym, tags, _, _ = labelled(BATCH * 100, seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        r = np.random.default_rng(seed + 1)
        for step in range(1, steps + 1):
            if (step - 1) % 100 == 0:
                order = r.permutation(len(sym))
            pick = order[(step - 1) % 100 * BATCH :][:BATCH]
            _, g = self.gradients(sym[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps)) * (1 - 0.1**step)
            for k, x in g.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, sym: np.ndarray) -> np.ndarray:
        """The best tags of each window."""
        em, a = self.run(sym), self._transitions()
        length, n, _ = em.shape
        best, back = em[0] + self.p["first"], np.empty((length, n, TAGS), np.uint8)
        into = np.ascontiguousarray(a.T)
        for t in range(1, length):
            x = best[:, None, :] + into
            back[t] = x.argmax(2)
            best = np.take_along_axis(x, back[t][..., None].astype(np.int64), 2)[..., 0] + em[t]
        tags = np.empty((n, length), np.uint8)
        tags[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t][np.arange(n), tags[:, t]]
        return tags


# whole documents


def spans_of(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, end, kind) of the spans in rows of tags."""
    n, length = tags.shape
    kind = (tags.astype(np.int64) + 1) // 2
    prev = np.concatenate([np.zeros((n, 1), np.int64), kind[:, :-1]], 1)
    opens = (kind > 0) & ((tags % 2 == 1) | (kind != prev))
    w, s = np.nonzero(opens)
    stop = np.concatenate([opens | (kind == 0), np.ones((n, 1), bool)], 1)
    ends = np.flatnonzero(stop.ravel())
    at = w * (length + 1) + s
    e = ends[np.searchsorted(ends, at, "right")] - w * (length + 1)
    return w, s, e, kind[w, s] - 1


def reconcile(found: list[tuple[int, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) from the windows' (start, end, kind, cut off at an edge) of one document."""
    joined: list[list] = []
    for s, e, k, cut in sorted(x for x in found if x[3]):
        if joined and joined[-1][2] == k and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e, k])
    votes: dict[tuple[int, int, int], int] = {}
    for s, e, k, cut in found:
        if not cut:
            votes[s, e, k] = votes.get((s, e, k), 0) + 2
    for s, e, k in joined:
        votes[s, e, k] = votes.get((s, e, k), 0) + 1
    spans = sorted(votes, key=lambda x: (x[1], x[0], x[2]))
    ends, best, pick = [x[1] for x in spans], [0], []
    for i, (s, e, k) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], s, "right"))
        gain = best[j] + votes[s, e, k] * (e - s)
        pick.append(j if gain > best[i] else -1)
        best.append(max(gain, best[i]))
    out, i = [], len(spans)
    while i:
        if pick[i - 1] >= 0:
            out.append(spans[i - 1])
            i = pick[i - 1]
        else:
            i -= 1
    return out[::-1]


_SIGN, _ASSIGN, _NEAR = np.zeros(256, bool), np.zeros(256, bool), 4
_SIGN[[*range(48, 58), 64]] = True
_ASSIGN[[58, 61]] = True
_ABREAST = 512  # windows decoded together: their states stay in the cache


def find(tagger: Tagger, b: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) in a chunk; places count characters."""
    lead = np.flatnonzero((b & 0xC0) != 0x80)
    sym = np.minimum(b[lead], _WIDE).astype(np.uint8)
    edge = np.searchsorted(lead, offs)
    sign = np.flatnonzero(_SIGN[sym] | _ASSIGN[sym])
    if not len(sign):
        return []
    row = np.searchsorted(edge, sign, "right") - 1
    step = WINDOW // 2
    k = (sign - edge[row]) // step
    size = edge[1:] - edge[:-1]
    last = np.maximum(0, -(-(size - WINDOW) // step))  # the window that reaches the row's end
    pairs = np.unique(np.concatenate([np.stack([row, np.minimum(k, last[row])], 1), np.stack([row, np.minimum(np.maximum(k - 1, 0), last[row])], 1)]), axis=0)
    spans: dict[int, list] = {}
    seen, assigned = np.append(0, np.cumsum(_SIGN[sym])), np.append(0, np.cumsum(_ASSIGN[sym]))
    for i in range(0, len(pairs), _ABREAST):
        r, w = pairs[i : i + _ABREAST].T
        at = edge[r] + w * step
        place = at[:, None] + np.arange(WINDOW)
        window = np.where(place < edge[r + 1][:, None], sym[np.minimum(place, len(sym) - 1)], _PAD).astype(np.uint8)
        x, s, e, kind = spans_of(tagger.decode(window))
        s, e = at[x] + s, np.minimum(at[x] + e, edge[r[x] + 1])
        before = np.maximum(s - _NEAR, edge[r[x]])
        ok = (e > s) & ((seen[np.maximum(e, s)] > seen[s]) | (assigned[s] > assigned[before]))
        cut = (s == at[x]) & (w[x] > 0) | (e == at[x] + WINDOW) & (e < edge[r[x] + 1])
        for a, z, kd, c, q in zip(s[ok].tolist(), e[ok].tolist(), kind[ok].tolist(), cut[ok].tolist(), r[x[ok]].tolist()):
            spans.setdefault(q, []).append((a - int(edge[q]), z - int(edge[q]), kd, c))
    return [(q, *s) for q in sorted(spans) for s in reconcile(spans[q])]


_TRAINED: dict[tuple[int, int], Tagger] = {}


def trained(steps: int = STEPS, seed: int = SEED) -> Tagger:
    """The tagger for these parameters; fitted once per process, the same wherever it is fitted."""
    if (steps, seed) not in _TRAINED:
        _TRAINED[steps, seed] = Tagger(seed).fit(steps, seed)
    return _TRAINED[steps, seed]


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, kind, start, end) of each span."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b, offs in vec.chunks(batch.column(1)):
                found = find(shared.value, b, offs)
                if found:
                    r, s, e, k = zip(*found)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i + x for x in r])), pa.array([KINDS[x] for x in k]), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["doc_id", "kind", "start", "end"])

    return texts(docs).mapInArrow(run, "doc_id bigint, kind string, start bigint, end bigint")

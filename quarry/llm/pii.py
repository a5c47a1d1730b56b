"""Operator 1: personal data by patterns, and by a linear-chain conditional random field over word shapes.

The base patterns find emails, IP addresses, card and phone numbers anywhere. The field adds what no pattern of
these names: contacts (addresses written out, local phone numbers) and credentials (keys, tokens and passwords
with their names). It is trained on a small labelled table, made here from a rule, and decoded by Viterbi over all
words of a text, in overlapping windows.

Null text: empty. Empty table: no rows. Repeated rows: each is searched. Very long texts: searched whole, in time that
grows with their length; a batch of texts is held at a time. Base spans stay; an added span never overlaps one. Columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Fixed values of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: From the start of a run of digits only: it finds the same, without a new try at each of a long run's digits.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

ADDED = ("contact", "credential")
LABELS = ("O", *(f"{p}-{k}" for k in (*KINDS, *ADDED) for p in "BI"))
FEATURES = 1 << 12
#: Words at each end of a window that are decoded for their neighbours' sake only, if the text goes on there.
OVERLAP = 32
_WORD = re.compile(r"[^\x20\t-\r]+")
#: No contact is without one of these: three digits in a row, an at sign, or an at and a dot written out.
_CONTACT = re.compile(r"[0-9]{3}|@|[\[(]at[\])]|\bat\b[^a-z]+[\s\S]*(\bdot\b|\.[a-z])", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The contract's pattern, searched from its at signs: each run of letters before one is walked over once."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AT_DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, b, "email") for a, b in emails(text)]
    if "." in text:
        out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape(word: str) -> str:
    """Runs of lower-case, upper-case letters and digits as a, A, 0; other characters as they are."""
    out = []
    for c in word:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k or k not in "0Aa":
            out.append(k)
    return "".join(out)


@lru_cache(1 << 17)
def _id(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


def spelling(w: str) -> str | None:
    """What of a word may be a feature as it is spelt: short ones, and names before an equals sign or with brackets."""
    return w.lower().split("=")[0] if len(w) <= 8 and w.isalpha() or _OPENS.search(w) else None


def spellings(table: list[tuple[list[str], list[str]]]) -> frozenset[str]:
    """The spellings of a labelled table. Others are no features: nothing was learnt of them."""
    words = {w for sentence, _ in table for w in sentence}
    return frozenset({spelling(w) for w in words} | {w.lower() for w in words if len(w) <= 8} - {None})


def own_features(w: str, form: str, spelt: frozenset[str]) -> list[int]:
    plain = w.isalpha()
    digits = 0 if plain else sum(c.isdigit() for c in w)
    letters = len(w) if plain else sum(c.isalpha() for c in w)
    here = [_id("s:" + form), _id(f"n:{min(len(w), 40) // 4}"), _id(f"d:{min(digits, 20)}"), _id(f"l:{min(letters, 20) // 3}"), _id("p:" + w[:1]), _id("e:" + w[-1:]), _id(f"mix:{digits > 3 and letters > 3}")]
    if (name := spelling(w)) in spelt:
        here.append(_id(f"w:{name}"))
    if len(w) >= 12:
        here.append(_id("q:" + w[:4]))
    return here


def near_features(name: str, near: str, form: str, spelt: frozenset[str]) -> list[int]:
    return [_id(name + form), _id(name + "w" + near.lower())] if len(near) <= 8 and near.lower() in spelt else [_id(name + form)]


#: Places of the neighbours that a word's features name, and beyond the ends of a window EDGE.
PLACES, EDGE = ((-1, "b"), (1, "a"), (-2, "bb")), "\n"


def word_features(words: list[str], i: int, spelt: frozenset[str]) -> list[int]:
    near = [(name, words[i + k] if 0 <= i + k < len(words) else EDGE) for k, name in PLACES]
    return own_features(words[i], shape(words[i]), spelt) + [x for name, w in near for x in near_features(name, w, shape(w), spelt)]


def labelled_table(spark: SparkSession, rows: int = 600, seed: int = 7) -> DataFrame:
    """words, labels: sentences of invented words with marked personal data and look-alikes, made by rule."""
    return spark.createDataFrame(_labelled(rows, seed), "words array<string>, labels array<string>")


def _labelled(rows: int, seed: int) -> list[tuple[list[str], list[str]]]:
    rng = np.random.default_rng(seed)
    parts = "an ion ed the th ing er ha on ti re or ea st es ou nt sh le ble de la que en er ung sch lich men vi ci ado ra".split()

    def pick(*x):
        return x[int(rng.integers(len(x)))]

    def word():
        return "".join(pick(*parts) for _ in range(int(rng.integers(1, 4))))

    def prose():
        w = "".join(pick(*parts) for _ in range(int(rng.integers(1, 7))))
        w = pick(w, w, w, w, w.title(), w.title(), w.upper())
        return w + pick("", "", "", "", "", ",", ".", pick("!!", ":", ";", ")", "'s", "-" + word(), "?"))

    def digits(n):
        return "".join(str(d) for d in rng.integers(0, 10, n))

    def text(alphabet, n):
        return "".join(pick(*alphabet) for _ in range(n))

    hexa, caps = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    makers = {
        "email": lambda: f"{word()}{pick('.', '_', '')}{digits(2)}@{word()}.{pick('example.com', 'org', 'net', 'co.uk')}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(1, 256, 4)),
        "card": lambda: pick(" ", "-", "").join(digits(4) for _ in range(4)),
        "phone": lambda: pick(f"+{pick(1, 44, 49)} ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(7)}"),
        "contact": lambda: pick(f"{word()} at {word()} dot {pick('com', 'org', 'net')}", f"{word()} {pick('at', '[at]', '(at)')} {word()}{pick(digits(1), '')} {pick('dot', '[dot]', '(dot)')} {pick('com', 'org', 'net')}", f"{word()}[at]{word()}.com", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"),
        "credential": lambda: pick(f"password={text(hexa, 18)}", f'token = "{text(hexa, 40)}"', f"AKIA{text(caps, 16)}", f"AKIA{text(caps[:26], 9)}{digits(1)}{text(caps[:26], 6)}", f"api_key={text(caps + hexa, 24)}", f"secret: {text(hexa, 32)}", f"{pick('password', 'api_key')}={text('abcdefghijklmnopqrstuvwxyz', int(rng.integers(8, 25)))}"),
    }
    plain = [lambda: digits(int(rng.integers(1, 7))), lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: f"${digits(2)}.{digits(2)}", lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"({digits(2)})", lambda: f"{word()}{digits(1)}", lambda: f"CC BY-NC {digits(1)}.0", lambda: f"{digits(1)}: {word()}", lambda: f"https://{word()}.com/{digits(4)}", lambda: f"at {word()}", lambda: f"{word()} at {prose()} {word()}", lambda: f"= {word()}", lambda: f"{word()} | {digits(2)} |", lambda: digits(int(rng.integers(10, 20)))]
    out = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            filler = [pick(word, prose)() for _ in range(int(rng.integers(1, 6)))]
            words += filler
            labels += ["O"] * len(filler)
            if rng.random() < 0.65:
                kind = pick(*makers, *ADDED, *ADDED)
                got = makers[kind]().split(" ")
                labels += [f"B-{kind}", *[f"I-{kind}"] * (len(got) - 1)]
                if rng.random() < 0.3 and kind != "credential":
                    got[-1] += pick(".", ",")
            else:
                got = pick(*plain)().split(" ")
                labels += ["O"] * len(got)
            words += got
        filler = [pick(word, prose, prose)() for _ in range(int(rng.integers(0, 12)))]
        out.append((words + filler, labels + ["O"] * len(filler)))
    return out


def alike(w: str, spelt: frozenset[str]) -> str:
    """A word with the very same features: of words whose spelling is none, lower-case letters in the middle count only
    by their number (from the fifth letter on in words of twelve or more)."""
    n = len(w)
    if 3 <= n <= 40 and not _OPENS.search(w) and (n > 8 or w.lower() not in spelt):
        head = 4 if n >= 12 else 1
        for tail in (1, 2, 4):
            middle = w[head : n - tail]
            if middle.isalpha() and middle.islower():
                for letter in "aqxz":
                    v = w[:head] + letter * len(middle) + w[n - tail :]
                    if n > 8 or v.lower() not in spelt:
                        return v
    return w


_OPENS = re.compile(r"[\[(=]")
#: Words whose scores a field holds before it starts anew.
WORDS = 400_000


class ChainField:
    """State weights by feature and label, transitions between labels, and the spellings that are features."""

    def __init__(self, state: np.ndarray, move: np.ndarray, spelt: frozenset[str] = frozenset()):
        self.state, self.move, self.spelt = state.astype(np.float32), move.astype(np.float32), spelt
        self.known, self.by_word = {}, np.empty((0, 1 + len(PLACES), state.shape[1]), np.float32)

    def __getstate__(self) -> dict:
        return {"state": self.state, "move": self.move, "spelt": self.spelt}

    def __setstate__(self, held: dict) -> None:
        self.__init__(**held)

    def look_up(self, words: set[str]) -> None:
        """Fills ``by_word``: its own score by label, and what it adds to that of the words it is a neighbour of, by PLACES."""
        if len(self.known) > WORDS:
            self.known, self.by_word = {}, self.by_word[:0]
        like = {w: alike(w, self.spelt) for w in words if w not in self.known}
        new = [*([] if self.known else [EDGE]), *(set(like.values()) - self.known.keys())]
        if new:
            flat, at = [], []
            for w in new:
                form = shape(w)
                for f in (own_features(w, form, self.spelt), *(near_features(name, w, form, self.spelt) for _, name in PLACES)):
                    at.append(len(flat))
                    flat += f
            found = np.add.reduceat(self.state[flat], at).reshape(len(new), 1 + len(PLACES), -1)
            self.known.update(zip(new, range(len(self.by_word), len(self.by_word) + len(new)), strict=True))
            self.by_word = np.concatenate([self.by_word, found])
        known = self.known
        known.update([(w, known[v]) for w, v in like.items()])

    def scores(self, windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by window, place and label, padded; and the windows' lengths. Each distinct word is looked up once."""
        lengths = np.array([len(w) for w in windows])
        self.look_up(set().union(*windows) - {EDGE})
        ids = np.full((len(windows), lengths.max() + 3), self.known[EDGE])
        for x, w in enumerate(windows):
            ids[x, 2 : 2 + len(w)] = list(map(self.known.__getitem__, w))
        end = ids.shape[1] - 1
        out = self.by_word[ids[:, 2:end], 0]
        for at, (k, _) in enumerate(PLACES, 1):
            out += self.by_word[ids[:, 2 + k : end + k], at]
        return out, lengths

    def decode(self, windows: list[list[str]]) -> list[list[int]]:
        """The best label sequence of each window: Viterbi over the whole batch at once."""
        scores, lengths = self.scores(windows)
        n, longest, k = scores.shape
        best, back = scores[:, 0], np.zeros((n, longest, k), np.int8)
        to = np.ascontiguousarray(self.move.T)
        for t in range(1, longest):
            step = best[:, None, :] + to
            back[:, t] = at = step.argmax(axis=2)
            best = np.where((t < lengths)[:, None], np.take_along_axis(step, at[:, :, None], 2)[:, :, 0] + scores[:, t], best)
        last, out = best.argmax(axis=1), np.zeros((n, longest), int)
        for t in range(longest - 1, -1, -1):
            out[:, t] = last
            last = np.where((t < lengths) & (t > 0), back[np.arange(n), t, last], last)
        return [o[:m].tolist() for o, m in zip(out, lengths, strict=True)]


def _padded(state: np.ndarray, feats: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(f) for f in feats])
    scores = np.zeros((len(feats), lengths.max(), state.shape[1]), np.float32)
    for x, f in enumerate(feats):
        for t, at in enumerate(f):
            scores[x, t] = state[at].sum(axis=0)
    return scores, lengths


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[str]]], rounds: int = 25, batch: int = 50, rate: float = 0.25, seed: int = 1) -> ChainField:
    """Maximum likelihood by AdaGrad on forward-backward gradients."""
    k = len(LABELS)
    names = {n: i for i, n in enumerate(LABELS)}
    spelt = spellings(table)
    feats = [[word_features(w, i, spelt) for i in range(len(w))] for w, _ in table]
    gold = [[names[x] for x in y] for _, y in table]
    state, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    state2, move2 = np.full_like(state, 1e-6), np.full_like(move, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(table))
        for a in range(0, len(table), batch):
            some = order[a : a + batch]
            f = [feats[i] for i in some]
            s, lengths = _padded(state, f)
            s = s.astype(float)
            n, longest, _ = s.shape
            ahead, behind = np.zeros_like(s), np.zeros_like(s)
            ahead[:, 0] = s[:, 0]
            for t in range(1, longest):
                new = _log_sum(ahead[:, t - 1][:, :, None] + move, 1) + s[:, t]
                ahead[:, t] = np.where((t < lengths)[:, None], new, ahead[:, t - 1])
            total = _log_sum(ahead[:, -1], 1)
            for t in range(longest - 2, -1, -1):
                new = _log_sum(move + (s[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where((t + 1 < lengths)[:, None], new, 0)
            p = np.exp(ahead + behind - total[:, None, None])
            g_state, g_move = np.zeros_like(state), np.zeros_like(move)
            for x, i in enumerate(some):
                for t, at in enumerate(f[x]):
                    d = p[x, t].copy()
                    d[gold[i][t]] -= 1
                    g_state[at] += d
                    if t:
                        g_move[gold[i][t - 1], gold[i][t]] -= 1
            for t in range(1, longest):
                live = t < lengths
                pair = ahead[live, t - 1][:, :, None] + move + (s[live, t] + behind[live, t])[:, None, :] - total[live][:, None, None]
                g_move += np.exp(pair).sum(axis=0)
            g_state = g_state / len(some) + 1e-4 * state
            g_move = g_move / len(some) + 1e-4 * move
            state2 += g_state**2
            move2 += g_move**2
            state -= rate * g_state / np.sqrt(state2)
            move -= rate * g_move / np.sqrt(move2)
    return ChainField(state, move, spelt)


def windows_of(n: int, longest: int) -> list[tuple[int, int, int, int]]:
    """start, end of windows over n words, and from where to where each one's labels hold: these parts meet without gaps."""
    if n <= longest:
        return [(0, n, 0, n)] if n else []
    starts = range(0, n - 2 * OVERLAP, longest - 2 * OVERLAP)
    return [(a, min(a + longest, n), a + OVERLAP * (a > 0), a + longest - OVERLAP if a + longest < n else n) for a in starts if not a or a + OVERLAP < n]


def labels_of(texts: list[list[str]], field: ChainField, longest: int = 256) -> list[list[int]]:
    """A label for every word of each text. Windows are decoded in batches of like length."""
    out = [[0] * len(t) for t in texts]
    jobs = sorted(((b - a, x, a, b, low, high) for x, t in enumerate(texts) for a, b, low, high in windows_of(len(t), longest)))
    for at in range(0, len(jobs), 512):
        some = jobs[at : at + 512]
        for (_, x, a, _, low, high), labels in zip(some, field.decode([texts[x][a:b] for _, x, a, b, *_ in some]), strict=True):
            out[x][low:high] = labels[low - a : high - a]
    return out


def added_spans(texts: list[str], bases: list[list[tuple[int, int, str]]], field: ChainField, longest: int = 256) -> list[list[tuple[int, int, str]]]:
    """What the field adds to each text."""
    found = labels_of([_WORD.findall(t) for t in texts], field, longest)
    out: list[list] = [[] for _ in texts]
    for x, labels in enumerate(found):
        if not any(labels):
            continue
        spans = [m.span() for m in _WORD.finditer(texts[x])]
        start = None
        for i, y in enumerate([*labels, 0]):
            name = LABELS[y]
            if start is not None and not (name[0] == "I" and name[2:] == kind):
                text = texts[x][spans[start][0] : spans[i - 1][1]].rstrip(".,;")
                if kind != "contact" or _CONTACT.search(text):
                    out[x].append((spans[start][0], spans[start][0] + len(text), kind))
                start = None
            if name[0] in "BI" and start is None and name[2:] in ADDED:
                start, kind = i, name[2:]
    return [sorted(s for s in found if not any(s[0] < e and b < s[1] for b, e, _ in base)) for found, base in zip(out, bases, strict=True)]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, rows: int = 600) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), n_added, base_sha256, spans; one row per row of ``docs``.
    ``rows`` bounds the labelled table that is collected to train on."""
    spark = docs.sparkSession
    table = [(r["words"], r["labels"]) for r in labelled_table(spark, rows).limit(rows).collect()]
    shared = spark.sparkContext.broadcast(train(table))
    order = {k: i for i, k in enumerate((*KINDS, *ADDED))}

    def batches(batch: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batch:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = [t or "" for t in b.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                added = added_spans(texts, bases, shared.value)
                counts = [pa.array([sum(k == kind for *_, k in s) for s in bases], pa.int64()) for kind in KINDS]
                spans = [sorted(x + y, key=lambda s: (s[0], order[s[2]])) for x, y in zip(bases, added, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array([len(x) for x in added], pa.int64()), pa.array([hashlib.sha256(listed(s).encode()).hexdigest() for s in bases]), pa.array([listed(s) for s in spans])], ["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")

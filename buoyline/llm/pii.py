"""Personal data: exact base rules, and a semi-Markov CRF that adds spans they miss.

Base spans are the leftmost non-overlapping matches of four fixed rules (email,
ip, card, phone) that pass their checks. The semi-Markov conditional random
field works on islands: short stretches of a text that could hold personal data
in another spelling ("call 663-555-0199", "ann (at) example (dot) org"). Whole
candidate segments are scored by features of the segment - digit count,
grouping, separators, check digit, octets, the words before it - and dynamic
programming over segments of at most MAX_TOKENS tokens chooses boundaries and
types jointly. A decoded segment is added if its marginal probability is
CONFIDENT or more and it touches no base span. Base spans always stay.

The model is trained with numpy on the driver: on a fixed, seeded set of
labelled examples, and on islands from a bounded sample of the documents that
the base rules cover or that have the shape of no personal data. Other spellings
in the documents are never negative examples.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from buoyline.llm import common

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 24
CONFIDENT = 0.9
CONTEXT = 24  # characters before a segment that its features may look at
SAMPLE_ISLANDS = 1500  # islands of the documents that the model is trained on
EPOCHS = 12

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ANY = re.compile(r"[0-9@]|[(\[{ ]at[)\]} ]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the base rules, sorted by start and then kind as listed.

    Addresses are found from their '@' outwards and numbers from where a run of
    digits begins, which gives the rules' leftmost matches in linear time.
    """
    out = []
    done = at = text.find("@")
    done = 0
    while at >= 0:
        host = _HOST.match(text, at + 1)
        if host:
            start = at
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                out.append((0, start, host.end()))
                done = host.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 2 * 19:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((3, *m.span()))
    return [(KINDS[k], a, b) for a, k, b in sorted((a, k, b) for k, a, b in out)]


# Islands ---------------------------------------------------------------------------------------------------------

_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20().\[\]/-]{0,3}[0-9])+")
_AT = re.compile(r"@|[(\[{ ]at[)\]} ]", re.I)
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64}(?:[ (\[{]{1,2}dot[ )\]}]{1,2}[A-Za-z0-9._%+-]{1,64}){0,2} {0,2}\Z", re.I)
_SPELLED = r" {0,2}[A-Za-z0-9-]{1,63}(?:[(\[{ ]{1,2}dot[ )\]}]{1,2}[A-Za-z0-9-]{1,63}){1,4}"
_RIGHT = re.compile(_SPELLED + r"| {0,2}[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}", re.I)
_RIGHT_OF_WORD = re.compile(_SPELLED, re.I)  # a bare "at" is too common a word to go with a plain dot
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
_OCTETS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[\[(]?\.[\])]?[0-9]{1,3}){3}(?![0-9])")
SPAN = 160  # characters of a candidate segment at most
MAX_DIGITS = 19  # of a candidate segment without letters: no kind has more


def islands(text: str) -> list[tuple[int, int]]:
    """Character ranges that could hold personal data: number groups of 7 digits or more or of four octets, and address-like text.

    A run of many numbers is one island of any length: decoding is linear in its tokens.
    """
    out = [m.span() for m in _NUMBERS.finditer(text) if m.end() - m.start() >= 7 and (len(_digits(m[0])) >= 7 or _OCTETS.search(m[0]))]
    for m in _AT.finditer(text):
        right = (_RIGHT_OF_WORD if m[0][0] == " " else _RIGHT).match(text, m.end())
        left = _LEFT.search(text[max(0, m.start() - 140):m.start()]) if right else None
        if left and left[0].strip():
            out.append((m.start() - len(left[0]), right.end()))
    return sorted(out)


_CUES = {  # fixed words that come before personal data, and before numbers that are none
    "phone": ("phone", "tel", "telephone", "mobile", "cell", "call", "fax", "dial", "ring", "whatsapp"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "cc"),
    "ip": ("ip", "host", "addr", "server", "gateway", "ping", "dns"),
    "email": ("mail", "email", "contact", "reach", "write", "from", "to"),
    "none": ("order", "invoice", "no", "id", "ref", "isbn", "version", "year", "eur", "usd", "page", "ticket", "serial", "sku", "part"),
}
_CUE = {w: k for k, ws in _CUES.items() for w in ws}


def _shape(part: str) -> str:
    groups = [str(min(len(g), 9)) for g in re.findall(r"[0-9]+", part)]
    return "-".join(groups) if len(groups) <= 5 else f"{len(groups)}groups"


def features(text: str, a: int, b: int, island: tuple[int, int]) -> list[str]:
    """Features of the whole span text[a:b]; each is weighed per kind."""
    part = text[a:b]
    digits = _digits(part)
    n = len(digits)
    f = ["bias", f"digits{n if n < 20 else 20}", f"shape{_shape(part)}"]
    f.append("separators" + "".join(sorted({c for c in part if not c.isalnum()})))
    if part[0] == "+":
        f.append("plus")
    if "@" in part:
        f.append("at")
    if re.search(r"(?i)[(\[{ ]at[)\]} ]", part):
        f.append("spelled-at")
        f.append("spelled-dot" if re.search(r"(?i)[(\[{ ]dot[)\]} ]", part) else "plain-dot" if "." in part else "no-dot")
    if re.search(r"[A-Za-z]{2,8}\Z", part):
        f.append("ends-in-name")
    if 12 <= n <= 19:
        f.append("luhn" if luhn(digits) else "no-luhn")
        f.append(f"first{digits[0]}")
    octets = re.findall(r"[0-9]+", part)
    if len(octets) == 4:
        f.append("octets" if all(len(o) <= 3 and int(o) <= 255 for o in octets) else "no-octets")
    if a == island[0] and b == island[1]:
        f.append("whole")
    # The words before a run of numbers go for each of them.
    at = a if re.search(r"[A-Za-z]", text[max(island[0], a - CONTEXT):a]) else island[0]
    before = re.findall(r"[A-Za-z]+", text[max(0, at - CONTEXT):at].lower())[-2:]
    f.append("cue-" + next((_CUE[w] for w in reversed(before) if w in _CUE), "unknown"))
    f.append("left-" + (_class(text[a - 1]) if a else "edge"))
    f.append("right-" + (_class(text[b]) if b < len(text) else "edge"))
    return f


def _class(c: str) -> str:
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else "mark"


def segments(text: str, island: tuple[int, int]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Number of tokens, and candidate segments (first token, last token + 1, start, end)."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, *island)]
    spelled = re.compile(r"[A-Za-z@]").search(text, *island)  # address-like text, which is short
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            b = tokens[j - 1][1]
            if b - a > SPAN and spelled is None:
                break
            if not text[b - 1].isalnum():
                continue
            part = text[a:b]
            n = len(_digits(part))
            if spelled is None and n > MAX_DIGITS:
                break
            if n >= 7 or _OCTETS.fullmatch(part) or spelled and ("@" in part or re.search(r"(?i)[(\[{ ]at[)\]} ]", part)):
                out.append((i, j, a, b))
    return len(tokens), out


# The model -------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # features x kinds

    def scores(self, text: str, island: tuple[int, int], segs: list[tuple[int, int, int, int]]) -> np.ndarray:
        rows = [[self.index[f] for f in features(text, a, b, island) if f in self.index] for _, _, a, b in segs]
        return np.array([self.weights[r].sum(0) for r in rows]).reshape(len(segs), len(KINDS))


def _forward_backward(n: int, segs, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Marginal probability of every (segment, kind), and the log of the partition sum; other tokens score 0."""
    best = np.logaddexp.reduce(scores, axis=1) if len(segs) else np.zeros(0)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    ends, starts = {}, {}
    for s, (i, j, _, _) in enumerate(segs):
        ends.setdefault(j, []).append((i, best[s]))
        starts.setdefault(i, []).append((j, best[s]))
    for t in range(1, n + 1):
        ahead[t] = np.logaddexp.reduce([ahead[t - 1], *[ahead[i] + x for i, x in ends.get(t, ())]])
    for t in range(n - 1, -1, -1):
        back[t] = np.logaddexp.reduce([back[t + 1], *[back[j] + x for j, x in starts.get(t, ())]])
    inside = np.array([ahead[i] + back[j] for i, j, _, _ in segs]).reshape(-1, 1)
    return np.exp(scores + inside - ahead[n]) if len(segs) else scores, float(ahead[n])


def decode(model: Model, text: str, island: tuple[int, int]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, marginal) of the best segmentation of an island."""
    n, segs = segments(text, island)
    if not segs:
        return []
    scores = model.scores(text, island, segs)
    marginal, _ = _forward_backward(n, segs, scores)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    ends = {}
    for s, (_, j, _, _) in enumerate(segs):
        ends.setdefault(j, []).append(s)
    for t in range(1, n + 1):
        best[t] = best[t - 1]
        for s in ends.get(t, ()):
            k = int(scores[s].argmax())
            if best[segs[s][0]] + scores[s, k] > best[t]:
                best[t], back[t] = best[segs[s][0]] + scores[s, k], (s, k)
    out, t = [], n
    while t > 0:
        if back[t] is None:
            t -= 1
        else:
            s, k = back[t]
            out.append((KINDS[k], segs[s][2], segs[s][3], float(marginal[s, k])))
            t = segs[s][0]
    return out[::-1]


def train(examples: list[tuple[str, tuple[int, int], list[tuple[str, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Adagrad on the negative log-likelihood of the labelled segmentations of islands."""
    index: dict[str, int] = {}
    data = []
    for text, island, gold in examples:
        n, segs = segments(text, island)
        if not segs:
            continue
        rows = [np.array([index.setdefault(f, len(index)) for f in features(text, a, b, island)]) for _, _, a, b in segs]
        truth = np.zeros((len(segs), len(KINDS)))
        for s, (_, _, a, b) in enumerate(segs):
            for kind, x, y in gold:
                if (a, b) == (x, y):
                    truth[s, KINDS.index(kind)] = 1
        data.append((n, segs, rows, truth))
    w, seen = np.zeros((len(index), len(KINDS))), np.full((len(index), len(KINDS)), 1e-2)
    w[index["bias"]] = -2.0 if "bias" in index else 0.0
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for d in order.permutation(len(data)):
            n, segs, rows, truth = data[d]
            marginal, _ = _forward_backward(n, segs, np.array([w[r].sum(0) for r in rows]))
            gap = truth - marginal
            for s in np.flatnonzero(np.abs(gap).max(1) > 1e-3):
                g = gap[s] - decay * w[rows[s]]
                seen[rows[s]] += g * g
                w[rows[s]] += rate * g / np.sqrt(seen[rows[s]])
    return Model(index, w)


def made_examples(n: int = 500, seed: int = 3) -> list[tuple[str, tuple[int, int], list[tuple[str, int, int]]]]:
    """Seeded labelled islands: personal data in spellings the base rules know or miss, and numbers that are none."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    name = lambda: "".join(pick(*"abdeghilmnorstu") for _ in range(int(rng.integers(3, 9))))

    def card():
        d = pick("4", "5", "37") + num(13)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def phone():
        a, b, c = str(rng.integers(2, 10)) + num(2), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 ({a}) {b}-{c}", f"+49 {a} {b}{c}")

    def cards():
        d = card()
        return pick(d, " ".join(re.findall(".{1,4}", d)), "-".join(re.findall(".{1,4}", d)), ".".join(re.findall(".{1,4}", d)))

    def mail():
        host, top = name(), pick("com", "org", "net", "de")
        return pick(f"{name()}@{host}.{top}", f"{name()} (at) {host} (dot) {top}", f"{name()} [at] {host} [dot] {top}",
                    f"{name()}(at){host}.{top}", f"{name()} at {host} dot {top}")

    def ip():
        p = [str(x) for x in rng.integers(1, 256, 4)]
        return pick(".".join(p), "[.]".join(p))

    none = [lambda: f"{pick('19', '20')}{num(2)}-0{pick(*'123456789')}-1{num(1)}", lambda: f"{num(8)}", lambda: f"{num(11)}", lambda: f"{num(16)}",
            lambda: f"{num(4)}-{num(4)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}",
            lambda: f"978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: num(20),
            lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}"]
    out = []
    while len(out) < n:
        kind = pick("email", "ip", "card", "phone", "none", "none", "none")
        part = {"email": mail, "ip": ip, "card": cards, "phone": phone}.get(kind, pick(*none))()
        bare = kind == "phone" and part[0] != "+"  # without a cue such a number stays unlabelled
        cue = pick(*_CUES[kind]) + pick(" ", ": ") if kind != "none" and (bare or rng.random() < 0.5) else pick("", pick(*_CUES["none"]) + " ", name() + " ", name() + " ")
        left = f"{name()} {name()} " + cue
        if kind == "none" and luhn(_digits(part)) and 12 <= len(_digits(part)) <= 19:
            continue
        text = left + part + pick("", ".", ",", " " + name(), " " + name() + " " + name())
        a, b = len(left), len(left) + len(part)
        gold = [(kind, a, b)] if kind != "none" else []
        for island in islands(text):
            out.append((text, island, [g for g in gold if island[0] <= g[1] and g[2] <= island[1]]))
    return out


def made_lists(n: int = 120, seed: int = 4) -> list[tuple[str, tuple[int, int], list[tuple[str, int, int]]]]:
    """Seeded labelled islands of several numbers: phones and defanged addresses behind one cue, and numbers that are none."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    out = []
    while len(out) < n:
        kind, mark, gap = pick("phone", "phone", "ip", "none"), pick("-", "."), pick(" / ", " ", " - ", "/")
        text, gold = pick(*_CUES[kind]) + pick(" ", ": "), []
        for i in range(int(rng.integers(2, 7))):
            part = "[.]".join(str(x) for x in rng.integers(1, 256, 4)) if kind == "ip" else mark.join((str(rng.integers(2, 10)) + num(2), num(3), num(4)))
            text += gap if i else ""
            gold += [(kind, len(text), len(text) + len(part))] if kind != "none" else []
            text += part
        if not base_spans(text):
            out += [(text, island, [g for g in gold if island[0] <= g[1] and g[2] <= island[1]]) for island in islands(text)]
    return out


# Numbers that are no personal data in any spelling: dates, book numbers, and plain digits of another length than a phone's.
_OTHER = re.compile(
    r"(?:19|20)[0-9]{2}([-/. ])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?: [0-9]{1,2})?"
    r"|(?:0[1-9]|[12][0-9]|3[01])([-/. ])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2}(?: [0-9]{1,2})?"
    r"|97[89][- ]?(?:[0-9][- ]?){9}[0-9]|[0-9]{8}|[0-9]{16,}")


def tells(text: str, island: tuple[int, int], base: list[tuple[str, int, int]]) -> bool:
    """Whether the base rules know an island's label: they cover it, or it is of a shape that no spelling has.

    What they leave of another shape may be personal data that they cannot
    express, so it is no negative example.
    """
    a, b = island
    if any(x <= a and b <= y for _, x, y in base):
        return True
    return not any(x < b and a < y for _, x, y in base) and bool(_OTHER.fullmatch(text, a, b)) and not (b - a >= 12 and luhn(_digits(text[a:b])))


def fit(docs: DataFrame | None, text: str = "text", sample: int = SAMPLE_ISLANDS) -> Model:
    """Train on made examples and, of `docs`, on at most `sample` islands whose label the base rules know (hash-chosen rows)."""
    examples = made_examples() + made_lists()
    if docs is not None:
        rows = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))

        def cut(batches):
            for batch in batches:
                seen = []
                for t in batch.column("text").to_pylist():
                    base = base_spans(t)
                    for a, b in [i for i in islands(t) if i[1] - i[0] <= SPAN and tells(t, i, base)][:4]:  # a training sample: some short islands of a row are enough
                        seen.append(t[max(0, a - 40):b + 20])
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], ["text"])

        few = rows.where(F.pmod(F.xxhash64("text"), F.lit(16)) == 0)
        parts = few.mapInArrow(cut, "text string").distinct().orderBy(F.xxhash64("text"), "text").limit(sample).collect()
        for (part,) in parts:
            gold = base_spans(part)
            examples += [(part, i, [g for g in gold if i[0] <= g[1] and g[2] <= i[1]]) for i in islands(part) if tells(part, i, gold)]
    return train(examples)


def find(model: Model | None, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans) of a whole text, each sorted by start and then kind."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    if model is None:
        return base, []
    added, taken = [], sorted((a, b) for _, a, b in base)
    at = 0
    for island in islands(text):
        while at < len(taken) and taken[at][1] <= island[0] - SPAN * 2:
            at += 1
        near = [t for t in _until(taken, at, island[1])]
        if any(a <= island[0] and island[1] <= b for a, b in near):
            continue  # a base span covers it: nothing to add
        first = 0
        for kind, a, b, sure in decode(model, text, island):
            while first < len(near) and near[first][1] + SPAN * 2 <= a:
                first += 1
            if sure >= CONFIDENT and not any(a < y and x < b for x, y in _until(near, first, b)) and not (added and added[-1][2] > a):
                added.append((kind, a, b))
    return base, added


def _until(spans: list[tuple[int, int]], at: int, stop: int):
    while at < len(spans) and spans[at][0] < stop:
        yield spans[at]
        at += 1


def spell(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


COUNTS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's base counts, digest of base spans, and all spans; a null text is empty.

    Counts and digest are of base spans; `spans` also has the `n_added` spans
    of the model. Positions are code points, ends exclusive. Extra columns are
    left out; repeated rows are scanned each.
    """
    rows = docs.select(common.column(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = rows.select("key").schema
    for part in COUNTS.split(", "):
        out = out.add(*part.split())

    def run(batches):
        for batch in batches:
            got = [find(model, t) for t in batch.column("text").to_pylist()]
            cols = [batch.column("key")]
            for kind in KINDS:
                cols.append(pa.array([sum(k == kind for k, _, _ in base) for base, _ in got], pa.int64()))
            cols.append(pa.array([hashlib.sha256(spell(base).encode()).hexdigest() for base, _ in got], pa.string()))
            cols.append(pa.array([spell(base + added) for base, added in got], pa.string()))
            cols.append(pa.array([len(added) for _, added in got], pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, out.fieldNames())

    return rows.mapInArrow(run, out).withColumnRenamed("key", common.name(key))

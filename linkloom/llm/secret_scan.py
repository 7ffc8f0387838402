"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags tokens (runs of letters, digits and ``_-+/.~``) as beginning a
secret, inside one or outside, from their shape, the neighbouring words and
bytes, and features of the whole text, and is decoded by Viterbi. A token whose
score as outside beats its others by more than any change of transitions could
make up is outside in every best tagging, so texts fall apart at such tokens and
only the short stretches between them need decoding: exact, and fast.

The field is trained on windows of a bounded sample of documents (``SAMPLE``
about, chosen by a hash): the patterns' spans in them, and secrets of known forms
and hard negatives that a seeded generator puts into other windows.

Spans of the patterns stay as they are; the field adds spans of kind ``crf``
that overlap none of them. Places are code points, the end exclusive.

Defined cases: a null text is an empty one and has no spans. Repeated rows each
get their row; other columns of the input are never looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .runtime import bounded, unit

#: The patterns and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "crf")
#: Texts that this doesn't match have no span of the patterns.
_MAY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""

#: The bound of the learning sample, in rows, and in bytes of each text that may be in it.
SAMPLE, SAMPLE_BYTES = 300, 1 << 18
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


# --- features -------------------------------------------------------------

_CLASS = np.zeros(256, np.uint8)  # 0 apart, 1 lower, 2 upper, 3 digit, 4 symbol, 5 beyond ASCII
for _c, _set in ((1, string.ascii_lowercase), (2, string.ascii_uppercase), (3, string.digits), (4, "_-+/.~")):
    _CLASS[[ord(x) for x in _set]] = _c
_CLASS[128:] = 5
_APART = _CLASS == 0
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[ord(x) for x in "0123456789abcdefABCDEF"]] = True
_LENGTHS = np.array([2, 4, 7, 10, 16, 24, 32, 40, 64])
_SIZES = (10, 5, 4, 4, 2, 2, 4)  # length, digits, capitals, symbols, beyond ASCII, hex, changes of class
_SHAPES = int(np.prod(_SIZES))
_WORD_BITS = 11
_FILES = 12
#: Rows of the weights: shape parts, a joint of length, digits and changes, previous and next word, byte before and after, the file.
_PARTS = np.cumsum([0, sum(_SIZES), 200, 1 << _WORD_BITS, 1 << _WORD_BITS, 256, 256, _FILES])


def tokens(b: K.Block) -> dict[str, np.ndarray]:
    """For each token of a block: codes of its shape, its neighbours, the bytes around it, and its file."""
    b.find_words(_APART)
    cls = _CLASS[b.data]
    s, e = b.starts, b.ends
    n = e - s

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(mask.size + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[e] - total[s]

    digits, upper, symbols, beyond, hexes = (count(m) for m in (cls == 3, cls == 2, cls == 4, cls == 5, _HEX_BYTE[b.data]))
    changed = np.zeros(cls.size, bool)
    changed[1:] = cls[1:] != cls[:-1]
    changes = np.maximum(0, count(changed) - 1)
    share = lambda k: np.where(k == 0, 0, np.where(k == n, 4, np.where(5 * k < n, 1, np.where(2 * k < n, 2, 3))))
    bucket = lambda k: np.where(k == 0, 0, np.where(k == 1, 1, np.where(k < 4, 2, 3)))
    parts = [np.searchsorted(_LENGTHS, n, "right"), share(digits), np.minimum(share(upper), 3), bucket(symbols), beyond > 0, hexes == n, np.searchsorted([2, 4, 8], changes, "right")]
    shape = np.zeros(n.size, np.int32)
    for size, part in zip(_SIZES, parts, strict=True):
        shape = shape * size + part
    words = (b.hashes(s, e, lower=True) >> np.uint64(64 - _WORD_BITS)).astype(np.int32)
    of = np.repeat(np.arange(b.n), b.n_words)
    prev, nxt = np.zeros(n.size, np.int32), np.zeros(n.size, np.int32)
    if n.size > 1:
        same = of[1:] == of[:-1]
        prev[1:][same] = words[:-1][same]
        nxt[:-1][same] = words[1:][same]
    size = np.maximum(1, b.ends_of - b.starts_of)
    bounds = np.append(b.starts_of, b.data.size)
    per = lambda mask, low, high: (lambda x: (x * low > size).astype(int) + (x * high > size))(K.sums_of(mask, bounds))
    file = per(cls == 3, 50, 5) * 4 + per((b.data == 61) | (b.data == 58), 200, 40) + (size < 200)
    return {"shape": shape, "prev": prev, "next": nxt, "before": np.where(s > 0, b.data[np.maximum(s - 1, 0)], 10).astype(np.int32), "after": b.data[e].astype(np.int32), "file": np.minimum(file, _FILES - 1)[of], "of": of}


def _shape_parts(shape: np.ndarray) -> np.ndarray:
    """Places of a shape code's parts among the weights, and of the joint."""
    out, left, at = [], shape.copy(), sum(_SIZES)
    values = []
    for size in reversed(_SIZES):
        values.append(left % size)
        at -= size
        out.append(values[-1] + at)
        left = left // size
    changes, _, _, _, _, digits, length = values
    out.append(_PARTS[1] + (length * 5 + digits) * 4 + changes)
    return np.stack(out, 1)


class Field:
    """The conditional random field: weights by feature and label, transitions between labels."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray):
        self.transitions = transitions
        self.shape = weights[_shape_parts(np.arange(_SHAPES, dtype=np.int64))].sum(1).astype(np.float32)
        self.prev, self.next, self.before, self.after, self.file = (weights[_PARTS[i] : _PARTS[i + 1]].astype(np.float32) for i in range(2, 7))
        #: By so much may transitions change if one token's label changes (two of them).
        self.most = 2 * float(transitions.max() - transitions.min())

    def scores(self, t: dict[str, np.ndarray]) -> np.ndarray:
        return self.shape[t["shape"]] + self.prev[t["prev"]] + self.next[t["next"]] + self.before[t["before"]] + self.after[t["after"]] + self.file[t["file"]]

    def tag(self, t: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        """(first, last) token of each secret in the best tagging of each text."""
        e = self.scores(t)
        open_ = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.most)
        out = []
        if not open_.size:
            return out
        # stretches of such tokens within one text, with the outside token on either side
        apart = np.flatnonzero((np.diff(open_) > 1) | (np.diff(t["of"][open_]) != 0)) + 1
        for part in np.split(open_, apart):
            a, z = int(part[0]), int(part[-1])
            left = a > 0 and t["of"][a - 1] == t["of"][a]
            right = z + 1 < len(e) and t["of"][z + 1] == t["of"][a]
            labels = self.viterbi(e[a : z + 1].astype(float), left, right)
            i = 0
            while i < len(labels):
                if labels[i] != OUTSIDE:
                    j = i
                    while j + 1 < len(labels) and labels[j + 1] == INSIDE:
                        j += 1
                    out.append((a + i, a + j))
                    i = j
                i += 1
        return out

    def viterbi(self, e: np.ndarray, left: bool, right: bool) -> list[int]:
        """The best labels between outside tokens (or the text's ends, which cost nothing)."""
        tr = self.transitions
        best = e[0] + (tr[OUTSIDE] if left else 0)
        back = []
        for x in e[1:]:
            both = best[:, None] + tr
            back.append(both.argmax(0))
            best = both.max(0) + x
        if right:
            best = best + tr[:, OUTSIDE]
        label = int(best.argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


# --- training -------------------------------------------------------------

_WORDS = ["password", "passwd", "pwd", "secret", "token", "api key", "apikey", "api_key", "access key", "auth token", "bearer", "credential", "private key", "client_secret", "SECRET_KEY", "Authorization"]
_LINKS = [" = ", "=", ": ", ":", ' = "', '="', ': "', " = '", " is ", " "]


def _made_secret(r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, url = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_"
    return r.choice(
        [
            lambda: pick("0123456789abcdef", r.choice([32, 40, 64])),
            lambda: pick(alnum + "+/", r.randint(24, 60)),
            lambda: r.choice(["ghp_", "gho_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-"]) + pick(alnum, r.randint(24, 44)),
            lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            lambda: "eyJ" + pick(url, r.randint(12, 30)) + "." + pick(url, r.randint(20, 50)) + "." + pick(url, 43),
            lambda: "AIza" + pick(url, 35),
            lambda: "-".join(pick(string.ascii_uppercase + string.digits, 5) for _ in range(r.randint(4, 5))),
            lambda: " ".join(pick(string.ascii_uppercase + string.digits, 8) for _ in range(r.randint(3, 5))),
            lambda: pick(alnum, r.randint(12, 24)),
        ]
    )()


def _made_other(r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low = string.ascii_lowercase
    return r.choice(
        [
            lambda: pick(string.digits, r.randint(3, 19)),
            lambda: f"{pick(low, 5)}.{pick(string.digits, 2)}@mail{r.randint(0, 9)}.example.com",
            lambda: f"https://www.{pick(low, 8)}.org/{pick(low, 6)}/{pick(string.digits, 4)}",
            lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}",
            lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000, 9999)}-{r.randint(100, 999)}",
            lambda: pick(low, r.randint(16, 40)),
            lambda: pick(low, r.randint(3, 9)).capitalize() + "%%%" + pick(low, 4) + "###",
            lambda: f"{pick(low, 6)}_{pick(low, 5)}.{r.choice(['py', 'txt', 'html'])}",
            lambda: f"{r.choice(_WORDS)}{r.choice(_LINKS)}{pick(low, r.randint(2, 9))}",
            lambda: f"key {pick(low, 4)}" + "." * r.randint(1, 3),
            lambda: pick(low, 6).upper() + "-" + pick(string.digits, 3),
        ]
    )()


def training_windows(texts: list[str], seed: int = 7, per_text: int = 8, width: int = 90) -> list[tuple[str, list[tuple[int, int]]]]:
    """Short texts and the places of the secrets in them."""
    r = random.Random(seed)
    out = []
    for text in texts or ["and so it goes on with the words of a text that has no secret at all"]:
        spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
        for a, z in spans[:3]:
            lo = max(0, a - width // 2)
            out.append((text[lo : z + width // 2], [(a - lo, z - lo)]))
        for k in range(per_text):
            at = r.randrange(max(1, len(text) - width))
            piece = text[at : at + width]
            if base_spans(piece):
                continue
            words = piece.split(" ")
            cut = len(" ".join(words[: len(words) // 2]))
            kind = k % 4
            if kind == 0:
                head = piece[:cut] + " " + (r.choice(_WORDS) + r.choice(_LINKS) if r.random() < 0.8 else "")
                secret = _made_secret(r)
                close = '"' if head.endswith('"') else "'" if head.endswith("'") else ""
                out.append((head + secret + close + r.choice(["", ".", "\n"]) + piece[cut:], [(len(head), len(head) + len(secret))]))
            elif kind < 3:
                out.append((piece[:cut] + " " + _made_other(r) + " " + piece[cut:], []))
            else:
                out.append((piece, []))
    return out


def fit(texts: list[str], rounds: int = 70, rate: float = 0.15, decay: float = 2e-4) -> Field:
    """Maximum likelihood by Adam with exact gradients (forward-backward over all windows at once)."""
    windows = training_windows(texts)
    b = K.Block([t.encode("utf-8", "surrogatepass") for t, _ in windows])
    t = tokens(b)
    longest = int(b.n_words.max())
    n = b.n
    place = np.arange(len(t["of"])) - b.words[t["of"]]
    gold = np.zeros((n, longest), np.int64)
    mask = np.arange(longest) < b.n_words[:, None]
    for i, (text, spans) in enumerate(windows):
        for a, z in spans:
            lo = b.starts_of[i] + len(text[:a].encode("utf-8", "surrogatepass"))
            hi = b.starts_of[i] + len(text[:z].encode("utf-8", "surrogatepass"))
            own = np.flatnonzero((b.starts[b.words[i] : b.words[i + 1]] >= lo) & (b.starts[b.words[i] : b.words[i + 1]] < hi))
            gold[i, own] = INSIDE
            gold[i, own[:1]] = BEGIN
    feats = np.concatenate([_shape_parts(t["shape"].astype(np.int64)), *((t[k] + _PARTS[i])[:, None] for i, k in ((2, "prev"), (3, "next"), (4, "before"), (5, "after"), (6, "file")))], 1)
    flat = feats.ravel()
    times = feats.shape[1]
    at = (t["of"], place)
    w, tr = np.zeros((_PARTS[-1], 3)), np.zeros((3, 3))
    m, v = np.zeros(w.size + 9), np.zeros(w.size + 9)
    hot = np.eye(3)[gold]
    for k in range(1, rounds + 1):
        e = np.zeros((n, longest, 3))
        e[at] = w[feats].sum(1)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        lse = lambda x, axis: (lambda top: np.log(np.exp(x - top).sum(axis, keepdims=True)) + top)(x.max(axis, keepdims=True)).squeeze(axis)
        for i in range(1, longest):
            step = lse(alpha[:, i - 1, :, None] + tr, 1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        z = lse(alpha[:, -1], 1)
        gt = np.zeros((3, 3))
        for i in range(longest - 2, -1, -1):
            live = mask[:, i + 1, None]
            onward = e[:, i + 1] + beta[:, i + 1]
            beta[:, i] = np.where(live, lse(tr + onward[:, None, :], 2), beta[:, i + 1])
            pair = np.exp(alpha[:, i, :, None] + tr + onward[:, None, :] - z[:, None, None]) - hot[:, i, :, None] * hot[:, i + 1, None, :]
            gt += (pair * live[:, :, None]).sum(0)
        diff = (np.exp(alpha + beta - z[:, None, None]) - hot)[at]
        g = np.stack([np.bincount(flat, np.repeat(diff[:, y], times), len(w)) for y in range(3)], 1)
        g = np.concatenate([g.ravel(), gt.ravel()]) / n + decay * np.concatenate([w.ravel(), tr.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w -= step[: w.size].reshape(w.shape)
        tr -= step[w.size :].reshape(3, 3)
    return Field(w, tr)


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on about ``sample`` documents, chosen by a hash."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text").filter(unit(F.concat_ws("\n", F.col("doc_id").cast("string"), F.md5("text"), F.lit("field"))) < share).limit(4 * sample).toArrow()
    return fit(rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).column("text").to_pylist())


# --- scanning -------------------------------------------------------------


def scan_texts(text: pa.Array, field: Field | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, in order."""
    may = pc.fill_null(pc.match_substring_regex(text, _MAY), False).to_pylist()
    texts = text.to_pylist()
    out = [base_spans(t) if m else [] for t, m in zip(texts, may, strict=True)]
    if field is None:
        return out
    for first, b in K.blocks(texts):
        t = tokens(b)
        for a, z in field.tag(t):
            i = int(t["of"][a])
            raw, s, e = b.raws[i], int(b.starts[a] - b.starts_of[i]), int(b.ends[z] - b.starts_of[i])
            while e > s + 1 and raw[e - 1 : e] in (b".", b"-", b"/", b"~"):  # a sentence's end is no part of it
                e -= 1
            start = len(raw[:s].decode("utf-8", "surrogatepass"))
            end = start + len(raw[s:e].decode("utf-8", "surrogatepass"))
            spans = out[first + i]
            if all(end <= x[0] or x[2] <= start for x in spans if x[1] != 3):
                spans.append((start, 3, end))
    return [sorted(x) for x in out]


def written_spans(spans: list[tuple[int, int, int]], kinds: int = 4) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < kinds)


SPANS_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs``: counts by kind, a digest of the patterns' spans, and all spans as text."""
    field = field or train(docs)

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            found = scan_texts(batch.column(1), field)
            count = lambda k: pa.array([sum(x[1] == k for x in s) for s in found], pa.int64())
            base = [hashlib.sha256(written_spans(s, 3).encode()).hexdigest() for s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), count(0), count(1), count(2), pa.array(base, pa.string()), pa.array([written_spans(s) for s in found], pa.string()), count(3)], names=[f.split()[0] for f in SPANS_SCHEMA.split(", ")])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, SPANS_SCHEMA)


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    """``text`` with each stretch that spans cover replaced by ``mark``; stretches that touch are one."""
    out, at = [], 0
    for s, _, e in spans:
        if s > at or not out:
            out.append(text[at:s])
            out.append(mark)
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with the spans in ``text`` replaced and ``n_chars`` (if there) made to fit; other columns stay."""
    field = field or train(docs)
    schema = docs.schema
    names = schema.names

    def run(batches):
        for batch in K.small_batches(batches, "text"):
            at = names.index("text")
            text = batch.column(at)
            new = [redact_text(t, s) if s else t for t, s in zip(text.to_pylist(), scan_texts(text, field), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(new, text.type)
            if "n_chars" in names:
                place = names.index("n_chars")
                columns[place] = pa.array([n if t is None else len(t) for n, t in zip(columns[place].to_pylist(), new, strict=True)], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return bounded(docs).mapInArrow(run, schema)

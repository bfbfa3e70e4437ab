"""Personal data in texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate spans: their shape, digits, checksums and the words before them, and the kinds of
neighbouring segments. Around every token that could belong to an entity (it has a digit or an at sign, or follows a key
word and a sign) a stretch of text is decoded by dynamic programming over segments of at most MAX_TOKENS tokens, which
chooses boundaries and types together. Its weights are learnt here, by gradient steps on the conditional likelihood of at
most SAMPLE stretches of at most TRAINED tokens, dealt evenly over the kinds of their labels and taken by a hash from all
places of all documents; labels are the patterns' matches and quoted credentials after a key word. Only these stretches go
to the driver. A span that the field finds is added where it meets none of the patterns' spans.

Defined results: null counts as empty; any length of text is read whole, and so is any length of stretch; repeated rows
give repeated results; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_slices, texts

KINDS = ("email", "ip", "card", "phone", "secret")
OUTSIDE, START = "O", "^"
MAX_TOKENS = 5
SAMPLE, TRAINED, ROUNDS = 1500, 40, 6  # stretches and tokens of a stretch in training, and passes over them
RATE, DECAY = 0.5, 1e-3  # of the gradient steps

# Fixed patterns. The guards and possessive quantifiers change no match, only the time on long runs.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
CREDENTIAL = re.compile(r"\b(?:token|key|secret|password|passwd|pwd|passphrase|credential)\s*[=:]\s*[\"']([^\"'\s]{8,})[\"']", re.I)

Span = tuple[int, int, str]  # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        right = DOMAIN.match(text, at + 1) if start < at else None
        if right:
            done = right.end()
            out.append((start, done, "email"))
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The patterns' matches, by start and then kind."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=order)


def order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


TOKEN = re.compile(r"[^\s|\"'<>,;]+")
MARK = re.compile(r"[0-9@]")
BREAK = re.compile(r"[\s\"']")
KEYWORD = re.compile(r"(?:token|key|secret|password|passwd|pwd|passphrase|credential)$", re.I)
SOME_KEY = re.compile(r"""(?:token|key|secret|password|passwd|pwd|passphrase|credential)[\s|"'<>,;]*[=:]""", re.I)


def telling(text: str) -> bool:
    """Whether a text has a stretch: a digit, an at sign, or a key word and a sign."""
    return any(c in text for c in "0123456789@") or ("=" in text or ":" in text) and bool(SOME_KEY.search(text))


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of tokens around those with a digit or an at sign and those after a key word and a sign, with two tokens more on the left."""
    out: list[list[tuple[int, int]]] = []
    if not telling(text):
        return out
    before: list[tuple[int, int]] = []
    now: list[tuple[int, int]] = []
    quiet, sign = 0, False
    for m in TOKEN.finditer(text):
        where, piece = m.span(), m[0]
        # Only a token that ends in a sign can make the next one stand after a key word.
        marked = not piece.isalpha() and MARK.search(piece) or sign and keyword(text, left := now or before, len(left)) == "key"
        sign = piece[-1] in "=:"
        if marked:
            if not now:
                now = before[-2:]
            now.append(where)
            quiet = 0
        elif now:
            quiet += 1
            if quiet > 1:
                out.append(now)
                now, before = [], [now[-1], where]
            else:
                now.append(where)
        else:
            before = [*before[-1:], where]
    if now:
        out.append(now)
    return out


def shape(piece: str) -> str:
    piece = re.sub(r"[0-9]+", "0", piece[:80])
    return re.sub(r"[^\W\d_]+", "a", piece)[:24]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while end > start and text[end - 1] in ".,;:!?)]}*#$%&":
        end -= 1
    while start < end and text[start] in "([{*#$%&":
        start += 1
    return start, end


def quoted(text: str, start: int, end: int) -> bool:
    return text[start - 1 : start] in ("'", '"') and text[end : end + 1] in ("'", '"')


def span_features(text: str, start: int, end: int, left: str, count: int) -> list[str]:
    """Features of a whole candidate span; each is paired with the candidate's kind."""
    piece = text[start:end]
    digits = sum(c in "0123456789" for c in piece)
    out = [f"shape={shape(piece)}", f"tokens={count}", f"digits={min(digits, 20)}", f"left={left}", "plus" if piece[:1] == "+" else "no plus"]
    if "@" in piece:
        m = emails(piece)
        out.append("email" if m and m[0][:2] == (0, len(piece)) else "broken email")
    if digits:
        if (m := CARD.fullmatch(piece)) and 12 <= digits <= 19:
            out.append("luhn" if luhn(re.sub("[ -]", "", m[0])) else "no luhn")
        if IP.fullmatch(piece):
            out.append("ip" if all(map(small, piece.split("."))) else "no ip")
        if PHONE.fullmatch(piece):
            out.append("phone" if 9 <= digits <= 15 else "no phone")
        if count == 1 and len(piece) >= 8 and piece.isalnum() and piece.isascii():
            out.append(f"mixed run {min(len(piece) // 8, 5)}" if digits < len(piece) else "digit run")
    elif "@" not in piece:
        out += [f"{left} {'quoted' if quoted(text, start, end) else 'bare'} word", f"word length {min(len(piece) // 4, 5)}"]
    return out


def keyword(text: str, tokens: list[tuple[int, int]], i: int) -> str:
    """What stands before a span: a key word with a sign, a sign, or something else."""
    a = text[tokens[i - 1][0] : tokens[i - 1][1]] if i else ""
    b = text[tokens[i - 2][0] : tokens[i - 2][1]] if i > 1 else ""
    if a.rstrip("=:") != a and KEYWORD.search(a.rstrip("=:")) or a in ("=", ":") and KEYWORD.search(b):
        return "key"
    return "sign" if a in ("=", ":") else "start" if not a else "word"


def outside_features(piece: str) -> list[str]:
    return [f"O {shape(piece)}", "O digit" if DIGIT.search(piece) else "O plain"]


def candidates(text: str, tokens: list[tuple[int, int]], i: int):
    """Segments that start at token i and begin and end with a marked token (or a plus sign); after a key word and a sign, any token, and any run of tokens without white space or quotes."""
    key = keyword(text, tokens, i) == "key"
    for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
        first, last = text[tokens[i][0] : tokens[i][1]], text[tokens[j - 1][0] : tokens[j - 1][1]]
        if j > i + 1 and tokens[j - 1][0] - tokens[j - 2][1] > 3:
            return
        if MARK.search(first) and MARK.search(last) or key and not BREAK.search(text, tokens[i][0], tokens[j - 1][1]):
            start, end = tokens[i][0], tokens[j - 1][1]
            if not (key and quoted(text, start, end)):
                start, end = trimmed(text, start, end)
            if start < end:
                yield j, start, end


Arc = tuple[int, int, str, list[str], "Span | None"]  # from token, to token, label, features, span


def arcs_of(text: str, tokens: list[tuple[int, int]]) -> list[list[Arc]]:
    """By their first token, all segments that the tokens allow: each token by itself as nothing, and each candidate as every kind."""
    out: list[list[Arc]] = []
    for i, (low, high) in enumerate(tokens):
        here: list[Arc] = [(i, i + 1, OUTSIDE, outside_features(text[low:high]), None)]
        left = None
        for j, start, end in candidates(text, tokens, i):
            left = keyword(text, tokens, i) if left is None else left
            features = span_features(text, start, end, left, j - i)
            here += [(i, j, kind, [f"{kind} {f}" for f in features], (start, end, kind)) for kind in KINDS]
        out.append(here)
    return out


def weigh(weights: dict[str, float], features: list[str]) -> float:
    return sum(weights.get(f, 0.0) for f in features)


def decode(text: str, tokens: list[tuple[int, int]], weights: dict[str, float], margin: float = 0.0) -> list[tuple[int, int, Span | None]]:
    """The best segmentation: (from token, to token, span or None), by dynamic programming over segments and the kind before. A span must beat "none" by ``margin``."""
    n = len(tokens)
    best: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][START] = (0.0, None)
    for here in arcs_of(text, tokens):
        i = here[0][0]
        for _, j, label, features, span in here:
            own = weigh(weights, features) - (margin if span else 0.0)
            value, before = max((v + weights.get(f"{last}>{label}", 0.0), last) for last, (v, _) in best[i].items())
            if label not in best[j] or value + own > best[j][label][0]:
                best[j][label] = (value + own, (i, before, span))
    out, j = [], n
    label = max(best[n], key=lambda k: (best[n][k][0], k))
    while j > 0:
        i, before, span = best[j][label][1]
        out.append((i, j, span))
        j, label = i, before
    return out[::-1]


def add_log(a: float | None, b: float) -> float:
    if a is None:
        return b
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a))


def expected(arcs: list[list[Arc]], weights: dict[str, float]) -> tuple[float, dict[str, float]]:
    """The logarithm of the sum over all segmentations, and how often each feature is expected, by the forward-backward algorithm."""
    n = len(arcs)
    scored = [[(j, label, features, weigh(weights, features)) for _, j, label, features, _ in here] for here in arcs]
    forth: list[dict[str, float]] = [{} for _ in range(n + 1)]
    forth[0][START] = 0.0
    for i, here in enumerate(scored):
        for j, label, _, own in here:
            for last, v in forth[i].items():
                forth[j][label] = add_log(forth[j].get(label), v + own + weights.get(f"{last}>{label}", 0.0))
    back: list[dict[str, float]] = [{} for _ in range(n + 1)]
    back[n] = dict.fromkeys(forth[n], 0.0)
    for i in range(n - 1, -1, -1):
        for j, label, _, own in scored[i]:
            for last in forth[i]:
                back[i][last] = add_log(back[i].get(last), own + weights.get(f"{last}>{label}", 0.0) + back[j][label])
    total = back[0][START]
    out: dict[str, float] = defaultdict(float)
    for i, here in enumerate(scored):
        for j, label, features, own in here:
            mass = 0.0
            for last, v in forth[i].items():
                step = f"{last}>{label}"
                p = math.exp(v + own + weights.get(step, 0.0) + back[j][label] - total)
                out[step] += p
                mass += p
            for f in features:
                out[f] += mass
    return total, out


def observed(arcs: list[list[Arc]], path: list) -> dict[str, float]:
    """How often each feature stands in the labelled segmentation."""
    out: dict[str, float] = defaultdict(float)
    last = START
    for i, j, span in path:
        label = span[2] if span else OUTSIDE
        features = next(f for _, to, k, f, _ in arcs[i] if (to, k) == (j, label))
        out[f"{last}>{label}"] += 1
        for f in features:
            out[f] += 1
        last = label
    return out


def labelled(text: str, tokens: list[tuple[int, int]], spans: list[Span]) -> list | None:
    """The segmentation that the labels ask for; None where a label doesn't fit the tokens."""
    low, high = tokens[0][0], tokens[-1][1]
    want = {s[:2]: s for s in spans if low <= s[0] < high}
    path, i = [], 0
    while i < len(tokens):
        for j, start, end in candidates(text, tokens, i):
            if (start, end) in want:
                path.append((i, j, want.pop((start, end))))
                i = j
                break
        else:
            path.append((i, i + 1, None))
            i += 1
    return None if want else path


def labels(text: str) -> list[Span]:
    return base_spans(text) + [(m.start(1), m.end(1), "secret") for m in CREDENTIAL.finditer(text)]


Example = tuple[str, list[tuple[int, int]], list]  # text, tokens, segmentation


def examples(text: str) -> list[Example]:
    """The labelled stretches of a text, each cut out with a character on either side. Those of more than TRAINED tokens teach nothing."""
    out: list[Example] = []
    found = stretches(text)
    spans = labels(text) if found else []
    for tokens in found:
        if len(tokens) <= TRAINED and (path := labelled(text, tokens, spans)) is not None:
            at = max(0, tokens[0][0] - 1)
            move = lambda span: (span[0] - at, span[1] - at, span[2]) if span else None
            out.append((text[at : tokens[-1][1] + 1], [(a - at, b - at) for a, b in tokens], [(i, j, move(s)) for i, j, s in path]))
    return out


def train(data: list[Example], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of the field: steps up the gradient of the conditional log-likelihood, each feature's by its own history."""
    weights: dict[str, float] = defaultdict(float)
    history: dict[str, float] = defaultdict(float)
    ready = [(arcs, observed(arcs, path)) for text, tokens, path in data for arcs in [arcs_of(text, tokens)]]
    for _ in range(rounds):
        for arcs, seen in ready:
            _, wanted = expected(arcs, weights)
            for f, p in wanted.items():
                slope = seen.get(f, 0.0) - p - DECAY * weights[f]
                history[f] += slope * slope
                weights[f] += RATE * slope / math.sqrt(1e-6 + history[f])
    return dict(weights)


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Train on at most ``sample`` different stretches: by kind of label, those of least hash. They are found in Spark tasks."""

    def make():
        def do(batch: pa.RecordBatch):
            rows = []
            for text in batch.column(0).to_pylist():
                for example in examples(text or ""):
                    kinds = sorted({s[2] for _, _, s in example[2] if s}) or ["none"]
                    rows.append((kinds[0], json.dumps(example)))
            if not rows:
                return None
            return pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["kind", "example"])

        return do

    some = map_slices(docs.select("text"), make, "kind string, example string").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("example"), "example"))
    rows = some.withColumn("place", place).filter(F.col("place") <= max(1, sample // (len(KINDS) + 1))).select("example").collect()
    as_span = lambda s: tuple(s) if s else None
    data = [(t, [tuple(x) for x in tokens], [(i, j, as_span(s)) for i, j, s in path]) for t, tokens, path in map(json.loads, sorted(r["example"] for r in rows))]
    by_hash = lambda e: hashlib.blake2b(e[0].encode(), digest_size=8).digest()
    return train(sorted(data, key=by_hash))


def added_spans(text: str, base: list[Span], weights: dict[str, float], margin: float = 1.0) -> list[Span]:
    """What the field finds apart from the patterns' spans; a span must beat "none" by ``margin``."""
    out = []
    for tokens in stretches(text):
        for _, _, span in decode(text, tokens, weights, margin):
            if span and not any(span[0] < b[1] and b[0] < span[1] for b in base):
                out.append(span)
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in sorted(spans, key=order))


def redact(text: str, spans: list[Span]) -> str:
    """Each run of overlapping spans gives way to the kind of its first."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=order):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; with ``redacted`` also the text without them."""
    docs = texts(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs) if weights is None else weights)

    def make():
        known = sent.value

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, digest, spans, clean = [[] for _ in range(4)], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                every = base + added_spans(text, base, known)
                for k in range(4):
                    counts[k].append(sum(s[2] == KINDS[k] for s in base))
                digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
                if redacted:
                    clean.append(redact(text, every) if every else text)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())]
            fields = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            return pa.record_batch([*arrays, pa.array(clean, pa.string())] if redacted else arrays, [*fields, "redacted"] if redacted else fields)

        return do

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", redacted string" * redacted
    return map_slices(docs, make, schema)


def cleaned(docs: DataFrame, weights: dict[str, float] | None = None, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All columns of the documents, personal data in the text replaced by the name of their kind, and its size anew. Null text stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs.select(F.col(text_col).alias("text"))) if weights is None else weights)
    at = docs.columns.index(text_col)

    def make():
        known = sent.value

        def do(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    every = base + added_spans(text, base, known)
                    text = redact(text, every) if every else text
                out.append(text)
            return pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], schema=batch.schema)

        return do

    out = map_slices(docs, make, docs.schema)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out

"""Personal data: fixed patterns, and a semi-Markov conditional random field beside them.

The field labels whole segments of words (up to MAX_SEGMENT each) as one kind or as
other. A segment is scored by features of the whole span (its digits, separators,
parts, check digit, at and dot words) plus the step between labels, and dynamic
programming over a run of words chooses boundaries and kinds jointly. Only runs around a
digit, an at sign or a spelled-out address are decoded: the shapes of numbers ask for a
digit, the shape of an address for its at and host, in any of the spellings that feature
knows; a word near none of them has no shape of any kind and stays other. Weights maximise the likelihood of runs labelled by the fixed
patterns, and of copies of them written evasively ("name at host dot com", a number
without its plus), so spans the patterns miss are found. Spans of the field that touch a
pattern's span are left out; pattern spans always stay.

Training takes at most TRAIN_RUNS runs of the corpus, the distinct ones of lowest hash; it
is a bounded sample by documented parameter. All texts are read whole, the field decodes
words up to AROUND characters from a sign or spelling and AROUND_DIGIT from a number, and
gives no label to several words over MAX_SPAN characters; the patterns know no such bounds.

Defined results: a null or empty text has no spans; equal rows have equal spans and all
return; an address part may have any number of digits; an empty table returns no rows; without a run to train on the field adds nothing; other columns pass through `redact`
untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Kinds in their order.
KINDS = ("email", "ip", "card", "phone")
# The base patterns. Possessive repeats match the same and never go back.
AT_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
NOT_LETTER = re.compile(r"[^A-Za-z]+")

MAX_SEGMENT = 8
TRAIN_RUNS = 200
TRAIN_WORDS = 14
STEPS = 80

LABELS = ("other", *KINDS)


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def _part(digits: str) -> int:
    """The value of an address part, 1000 for any larger: a part may have thousands of zeros."""
    digits = digits.lstrip("0")
    return int(digits or "0") if len(digits) <= 3 else 1000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: per kind leftmost, non-overlapping; by start, then kind."""
    found: list[tuple[int, int, str, int]] = []
    if "@" in text:
        last = 0
        for m in AT_HOST.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                last = m.end()
                found.append((start, 0, "email", last))
    for m in IP.finditer(text):
        if all(_part(p) <= 255 for p in m.groups()):
            found.append((m.start(), 1, "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 14:
            continue
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


# ---- runs of words the field decodes ------------------------------------------------

LIVE = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
# the parts of an address; the feature and the gate before it are made of the same ones
SPELLED_AT = r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)"
HOST = r"[A-Za-z0-9-]+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+"
# an address from its at on: [\[(\x20]at[\])\x20] holds wherever SPELLED_AT does
SPELLED = re.compile(r"[\[(\x20]at(?:(?<=[\[(]at)[\])]\x20?|(?<=\x20at)\x20)" + HOST, re.I)
SIGNED = re.compile("@" + HOST, re.I)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = frozenset(" \t\n\x0b\x0c\r")
#: characters on either side of a live word that its run may take words from, for words of
#: a sign or spelling and for those that begin with a digit, and of the longest added span
AROUND, AROUND_DIGIT, MAX_SPAN = 40, 4, 254


def _line_words(text: str, start: int, end: int) -> tuple[int, int]:
    """The span grown to whole words."""
    while start > 0 and text[start - 1] not in BLANK:
        start -= 1
    while end < len(text) and text[end] not in BLANK:
        end += 1
    return start, end


def runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of word spans around live words; runs that touch are one."""
    live = [m.span() for m in LIVE.finditer(text)]
    spelled = [m.span() for m in SPELLED.finditer(text)]
    if "@" in text:
        spelled += [m.span() for m in SIGNED.finditer(text)]
    if spelled:
        live = sorted(live + spelled)
    out: list[list[int]] = []
    for start, end in live:
        wide = AROUND if not text[start].isdigit() else AROUND_DIGIT
        start, end = _line_words(text, max(0, start - wide), min(len(text), end + wide))
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [[m.span() for m in WORD.finditer(text, a, b)] for a, b in out]


# ---- whole-span features ------------------------------------------------------------

TRIM = ".,;:!?\"'<>|"
DIGIT_BINS = (0, 1, 4, 7, 10, 14, 20)
PHONE_ONLY = re.compile(r"[+0-9(][\x20().0-9-]*[0-9]")
CARD_ONLY = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PARTS = re.compile(r"([0-9]{1,3})(?:\.|\[\.\]|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)([0-9]{1,3})(?:\.|\[\.\]|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)([0-9]{1,3})(?:\.|\[\.\]|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)([0-9]{1,3})", re.I)
ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]+(?:@|{SPELLED_AT}){HOST}", re.I)
DASHED = re.compile(r"(?:00[0-9]{1,3}[\x20-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
NAMES = (
    "bias", "one_word", "many_words", *(f"digits_{b}" for b in DIGIT_BINS), "letters", "at", "spelled",
    "plus", "phone_shape", "phone_length", "dashed", "card_shape", "check_digit", "parts", "parts_fit", "address", "inner_stop",
)
INDEX = {n: i for i, n in enumerate(NAMES)}


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start] in TRIM:
        start += 1
    while end > start and text[end - 1] in TRIM:
        end -= 1
    return start, end


def features(span: str, words: int) -> tuple[int, ...]:
    """Indices of the features that hold for a whole span."""
    digits = NOT_DIGIT.sub("", span)
    on = ["bias", "one_word" if words == 1 else "many_words"]
    on.append(f"digits_{max(b for b in DIGIT_BINS if b <= len(digits))}")
    if not span.isascii() or span.lower() != span.upper():
        on.append("letters")
    if "@" in span:
        on.append("at")
    if span.startswith("+"):
        on.append("plus")
    if PHONE_ONLY.fullmatch(span):
        on.append("phone_shape")
        if 10 <= len(digits) <= 15:
            on.append("phone_length")
        if DASHED.fullmatch(span):
            on.append("dashed")
    if CARD_ONLY.fullmatch(span):
        on.append("card_shape")
        if 14 <= len(digits) <= 19 and luhn(digits):
            on.append("check_digit")
    if m := PARTS.fullmatch(span):
        on.append("parts")
        if all(int(p) <= 255 for p in m.groups()):
            on.append("parts_fit")
    if len(span) <= MAX_SPAN and ADDRESS.fullmatch(span):
        on.append("address")
        if "@" not in span:
            on.append("spelled")
    if re.search(r"[,;:!?][\x20\x09-\x0D]", span):
        on.append("inner_stop")
    return tuple(INDEX[n] for n in on)


class Field:
    """Weights of features by label and of steps between labels; decodes runs of words."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps.tolist()
        self.scored: dict[tuple[int, ...], list[float]] = {}

    def score(self, text: str, start: int, end: int, words: int) -> list[float]:
        on = features(text[start:end], words)
        if on not in self.scored:
            self.scored[on] = self.weights[list(on)].sum(0).tolist()
        return self.scored[on]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for words in runs(text):
            out += self.decode(text, words)
        return out

    def decode(self, text: str, words: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation of one run: best[j][y] over segments that end at word j."""
        n, size = len(words), len(LABELS)
        best = [[0.0] + [-np.inf] * (size - 1)]
        back: list[list[tuple[int, int]]] = [[]]
        for j in range(1, n + 1):
            top, link = [-np.inf] * size, [(0, 0)] * size
            for length in range(1, min(MAX_SEGMENT, j) + 1):
                start, end = trimmed(text, words[j - length][0], words[j - 1][1])
                if length > 1 and ("\n" in text[start:end] or end - start > MAX_SPAN):
                    break
                own = self.score(text, start, end, length)
                before = best[j - length]
                for y in range(0 if length == 1 else 1, size):
                    for x in range(size):
                        value = before[x] + self.steps[x][y] + own[y]
                        if value > top[y]:
                            top[y], link[y] = value, (length, x)
            best.append(top)
            back.append(link)
        out, j, y = [], n, max(range(size), key=lambda k: best[n][k])
        while j:
            length, x = back[j][y]
            if y:
                out.append((LABELS[y], *trimmed(text, words[j - length][0], words[j - 1][1])))
            j, y = j - length, x
        return out[::-1]


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, base and added spans), each by start, then kind, then end."""
    base = base_spans(text)
    if not base:
        added = field.spans(text)
    else:
        added = [
            (kind, a, b) for kind, a, b in field.spans(text) if not any(a < e and s < b for _, s, e in base)
        ]
    order = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (s[1], order[s[0]], s[2]))


# ---- training -----------------------------------------------------------------------


def evasive(line: str, spans: list[tuple[str, int, int]], turn: int) -> tuple[str, list[tuple[str, int, int]]]:
    """The line with its first span written another way, and the span there."""
    kind, start, end = spans[0]
    own = line[start:end]
    if kind == "email":
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "))[turn % 4]
        name, _, host = own.partition("@")
        own = name + at + host.replace(".", dot)
    elif kind == "phone":
        digits = NOT_DIGIT.sub("", own)[-10:]
        own = (f"({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"{digits[:3]}-{digits[3:6]}-{digits[6:]}")[turn % 2]
    elif kind == "ip":
        own = own.replace(".", "[.]")
    return line[:start] + own + line[end:], [(kind, start, start + len(own))]


def _gold(words: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[int, int, int]] | None:
    """(first word, words, label) of a run's spans; None where one can't be a segment."""
    out, taken = [], -1
    for kind, start, end in spans:
        inside = [i for i, (a, b) in enumerate(words) if a < end and start < b]
        if not inside or len(inside) > MAX_SEGMENT or inside[0] <= taken:
            return None
        taken = inside[-1]
        out.append((inside[0], len(inside), LABELS.index(kind)))
    return out


def _segments(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
    """(end word, words, features) of every segment of a run."""
    for j in range(1, len(words) + 1):
        for length in range(1, min(MAX_SEGMENT, j) + 1):
            start, end = trimmed(text, words[j - length][0], words[j - 1][1])
            yield j, length, features(text[start:end], length)


def train(lines: list[str]) -> Field:
    """Likelihood ascent over all runs at once, on arrays padded to TRAIN_WORDS words."""
    size, width = len(LABELS), len(NAMES)
    examples: dict[tuple, float] = {}  # runs of one shape are one example, counted
    for turn, line in enumerate(lines):
        spans = base_spans(line)
        todo = [(line, spans)]
        if len(spans) == 1 and spans[0][0] != "card":
            todo.append(evasive(line, spans, turn))
            words = WORD.findall(NOT_LETTER.sub(" ", line)) or ["a"]
            # the same words with at and dot where they make no address
            todo.append((f"{words[0]} at 1 {words[-1]} and dot {words[0]}", []))
        for text, own in todo:
            for words in runs(text):
                here = [s for s in own if words[0][0] < s[2] and s[1] < words[-1][1]]
                gold = _gold(words, here) if len(words) <= TRAIN_WORDS else None
                if gold is not None:
                    shape = (len(words), tuple(_segments(text, words)), tuple(gold))
                    examples[shape] = examples.get(shape, 0.0) + 1.0
    weights, steps = np.zeros((width, size)), np.zeros((size, size))
    if not examples:
        weights[INDEX["bias"], 1:] = -1.0
        return Field(weights, steps)
    count, n = len(examples), TRAIN_WORDS
    phi_rows: list[np.ndarray] = []  # features of each segment
    place: list[tuple[int, int, int]] = []  # its run, end word and length
    sizes = np.array([shape[0] for shape in examples])
    times = np.array(list(examples.values()))
    seen, passed = np.zeros((width, size)), np.zeros((size, size))
    for r, ((length_of_run, segments, gold), many) in enumerate(examples.items()):
        single = np.zeros((length_of_run + 1, width))
        for j, length, on in segments:
            row = np.zeros(width)
            row[list(on)] = 1
            phi_rows.append(row)
            place.append((r, j, length))
            if length == 1:
                single[j] = row
            for first, size_, label in gold:
                if (first + size_, size_) == (j, length):
                    seen[:, label] += many * row
        at, last = 0, 0
        for first, length, label in [*gold, (length_of_run, 0, 0)]:
            for j in range(at, first):
                seen[:, 0] += many * single[j + 1]
                passed[last, 0] += many
                last = 0
            if length:
                passed[last, label] += many
                at, last = first + length, label
    phi = np.array(phi_rows)
    at_run, at_end, at_length = np.array(place).T
    gone = np.float64(-1e30)
    m_w, v_w, m_s, v_s = np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)
    for step in range(1, STEPS + 1):
        scores = np.full((count, n + 1, MAX_SEGMENT + 1, size), gone)
        scores[at_run, at_end, at_length] = phi @ weights
        scores[:, :, 2:, 0] = gone
        alpha = np.full((count, n + 1, size), gone)
        alpha[:, 0, 0] = 0.0
        for j in range(1, n + 1):
            into = [
                np.logaddexp.reduce(alpha[:, j - k, :, None] + steps, axis=1) + scores[:, j, k]
                for k in range(1, min(MAX_SEGMENT, j) + 1)
            ]
            alpha[:, j] = np.logaddexp.reduce(into, axis=0)
        beta = np.full((count, n + 1, size), gone)
        beta[np.arange(count), sizes] = 0.0
        total = np.logaddexp.reduce(alpha[np.arange(count), sizes], axis=1)
        want_s, share = np.zeros_like(steps), np.zeros_like(scores)
        for j in range(n, 0, -1):
            for k in range(1, min(MAX_SEGMENT, j) + 1):
                out = scores[:, j, k] + beta[:, j]  # by label of the segment
                pair = np.exp(np.minimum(alpha[:, j - k, :, None] + steps + out[:, None] - total[:, None, None], 0.0))
                pair *= times[:, None, None]
                want_s += pair.sum(0)
                share[:, j, k] = pair.sum(1)
                beta[:, j - k] = np.logaddexp(
                    beta[:, j - k], np.logaddexp.reduce(steps + out[:, None, :], axis=2)
                )
        want_w = phi.T @ share[at_run, at_end, at_length]
        rate = 0.15
        for value, grad, m, v in (
            (weights, (seen - want_w) / times.sum() - 1e-3 * weights, m_w, v_w),
            (steps, (passed - want_s) / times.sum() - 1e-3 * steps, m_s, v_s),
        ):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(weights, steps)


def _training_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            for words in runs(text or ""):
                line = text[words[0][0] : words[-1][1]]
                # the patterns can't label a spelled address: as "other" it would teach the field to miss it
                if len(words) <= TRAIN_WORDS and not SPELLED.search(line):
                    out.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(set(out)), pa.string())], ["line"])


def fit(docs: DataFrame, text: str = "text", max_runs: int = TRAIN_RUNS) -> Field:
    """A field trained on at most `max_runs` runs, the distinct ones of lowest hash."""
    lines = docs.select(F.col(text).alias("text")).mapInArrow(_training_lines, "line string").distinct()
    chosen = lines.orderBy(F.xxhash64("line"), "line").limit(max_runs).collect()  # bounded: short runs
    return train([r["line"] for r in chosen])


# ---- the operators ------------------------------------------------------------------

SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_spans(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, spans): pattern spans and all spans of every text, in code points."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", field) for t in batch.column(1).to_pylist()]
            rows = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[i]] for f in found], kind) for i in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["doc_id", "base", "spans"])

    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    id_type = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(scan, f"doc_id {id_type}, base {SPAN}, spans {SPAN}")


def pii_report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the pattern spans by kind, their digest, and all spans as text."""
    found = find_spans(docs, fit(docs, text), key, text)

    def joined(name: str):
        one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(name, one), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(kind) for kind in KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, or run of spans that overlap, replaced by its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced; `length`, where it is a column, follows."""
    field = fit(docs, text)
    names = docs.columns
    has_length = length in names and isinstance(docs.schema[length].dataType, T.IntegralType)

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            at = names.index(text)
            new = [None if t is None else redacted(t, all_spans(t, field)[1]) for t in columns[at].to_pylist()]
            columns[at] = pa.array(new, columns[at].type)
            if has_length:
                k = names.index(length)
                old = columns[k].to_pylist()
                columns[k] = pa.array([None if o is None or t is None else len(t) for o, t in zip(old, new)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(change, docs.schema)


def span_digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()

"""Secret scans (5): key patterns, and high-entropy stretches found by a sliding window.

Candidate strings are long runs of token characters. A window slides over each and keeps the Shannon entropy of its
characters, and how many are of each kind, by counting one in and one out. Each window is judged by the narrowest class
that holds its own characters, whatever is joined to them; a second, longer window is for small alphabets. Windows at
or above their class's threshold join to a span, unless they overlap a string that the allow-list knows or the span adds nothing to
a span found by pattern. Pattern spans always stay.

Positions are code points, ends exclusive. Defined results: a null or empty text has no spans; repeated rows are each
answered; columns other than those named pass through ``redact`` as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhouse.llm.tasks import bounded, ship, texts

KINDS = ("assign", "access", "hex", "entropy")

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

#: One of these stands in every text with an assignment, in some case.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Digits vary little: shorter strings of them are not told from numbers. Longer windows of letters vary more.
LONG_WINDOW = 32
#: For the classes of a window: the entropy in bits at which it is suspicious, below what nearly all random strings of the
#: class and the window's length reach. Joints are what stands between words, [+/_=-].
THRESHOLDS = {
    WINDOW: {
        "hex": 3.0,
        "one case": 3.3,  # first letters may be large
        "letters": 3.65,
        "one case, digits": 3.5,
        "letters, digits": 3.6,
        "joints, hex": 3.2,
        "joints, one case": 3.6,
        "joints, letters": 3.8,
        "joints, one case, digits": 3.8,
        "joints, letters, digits": 3.65,
    },
    LONG_WINDOW: {"digits": 2.8, "one case": 3.75},
}
#: Kinds of characters, and where each is counted.
DIGIT, SMALL_HEX, SMALL, LARGE_HEX, LARGE, JOINT = range(6)
_KIND = {c: kind for kind, chars in enumerate(("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")) for c in chars}
# Pairs of letters that are frequent in English, German, French and Spanish words.
FREQUENT = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li "
    "ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol "
    "rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op sa ay ke fr oo av "
    "ag if ap gr do sp uc bu ei ov by rm ep tt oc ef au ck ft sc ff ue".split()
)
#: A window of so many letters beside letters, of which so many percent are frequent pairs, reads like words: random letters
#: have about 23 %, words 60 and more. With digits between them there are fewer pairs, so more of them have to be frequent.
LEAST_PAIRS, WORDLIKE_PERCENT, WORDLIKE_PERCENT_WITH_DIGITS = 6, 44, 50
#: Words as they are joined to names and paths: of one case, or with humps.
_WORD = r"(?:[A-Z]?[a-z]{1,15}(?:[A-Z][a-z]{1,15})*|[A-Z]{1,15})"
#: Strings that look random and are no secrets. A window that overlaps one is not suspicious; others of the candidate are judged.
ALLOWED = (
    re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9a-fA-F])"),  # UUID
    # Marks of examples, with as many of the directly adjoining characters as a window has.
    re.compile(r"(?i)[a-z0-9]{0,20}(?:example|placeholder|changeme|redacted|dummy)[a-z0-9]{0,20}", re.ASCII),
    # Words joined to a name or path, no shorter than a window.
    re.compile(rf"(?<![A-Za-z0-9+])(?=[A-Za-z/_-]{{20}}){_WORD}(?:[-_/]+{_WORD})+(?![A-Za-z0-9+])[-_/]*"),
    re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9-]+"),  # times
    re.compile(r"(?i)0123456789ab(?:cdef(?:ghijklmnopqrstuvwxyz)?)?|abcdefghijkl(?:mnopqrstuvwxyz)?(?:0123456789)?", re.ASCII),  # alphabets
)

_GAINS = {window: [0.0, 0.0] + [c * log2(c) for c in range(2, window + 1)] for window in THRESHOLDS}


def suspicious(candidate: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches of a candidate that are covered by windows of at least the threshold's entropy."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    least = (log2(window) - threshold) * window + 1e-9
    gain = _GAINS.get(window) or [0.0, 0.0] + [c * log2(c) for c in range(2, window + 1)]
    for at, char in enumerate(candidate):
        if at >= window:
            old = candidate[at - window]
            n = counts[old]
            counts[old] = n - 1
            total += gain[n - 1] - gain[n]
        n = counts.get(char, 0)
        counts[char] = n + 1
        total += gain[n + 1] - gain[n]
        if at >= window - 1 and total <= least:
            start = at - window + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


def class_of(kinds: list[int]) -> str:
    """The narrowest class of a window, from how many characters of each kind it has."""
    small, large = kinds[SMALL_HEX] + kinds[SMALL], kinds[LARGE_HEX] + kinds[LARGE]
    joints = "joints, " if kinds[JOINT] else ""
    if not small + large:
        return joints + "digits"
    if kinds[DIGIT] and not kinds[SMALL] + kinds[LARGE] or not joints and not kinds[SMALL] + kinds[LARGE]:
        return joints + "hex"
    case = "one case" if large <= 1 or not small else "letters"
    return joints + case + (", digits" if kinds[DIGIT] else "")


def judged(candidate: str, window: int, quiet: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches of a candidate that are covered by windows of at least the entropy of their own class.

    Windows that overlap one of the ``quiet`` stretches, which are sorted and apart, are left out, and so are those that
    read like words: as an allow-list of pairs of letters, counted as the window moves.
    """
    small = candidate.lower()
    letters = [a.isalpha() and b.isalpha() for a, b in zip(small, small[1:])]
    frequent = [a + b in FREQUENT for a, b in zip(small, small[1:])]
    pairs = usual = 0
    gain = _GAINS[window]
    least = {name: (log2(window) - bits) * window + 1e-9 for name, bits in THRESHOLDS[window].items()}
    most = max(least.values())
    counts: dict[str, int] = dict.fromkeys(candidate, 0)
    kinds, total, spans = [0] * 6, 0.0, []
    ahead = iter([*quiet, (len(candidate), len(candidate))])
    quiet_from, quiet_to = next(ahead)
    for at, char in enumerate(candidate):
        if at >= window:
            old = candidate[at - window]
            n = counts[old]
            counts[old] = n - 1
            kinds[_KIND[old]] -= 1
            total += gain[n - 1] - gain[n]
            pairs -= letters[at - window]
            usual -= frequent[at - window]
        if at:
            pairs += letters[at - 1]
            usual += frequent[at - 1]
        n = counts[char]
        counts[char] = n + 1
        kinds[_KIND[char]] += 1
        total += gain[n + 1] - gain[n]
        if at >= window - 1 and total <= most and total <= least.get(kind := class_of(kinds), -1.0):
            enough = WORDLIKE_PERCENT_WITH_DIGITS if kinds[DIGIT] else WORDLIKE_PERCENT
            if pairs >= LEAST_PAIRS and 100 * usual >= enough * pairs and not kind.endswith("hex"):
                continue
            start = at - window + 1
            while quiet_to <= start:
                quiet_from, quiet_to = next(ahead)
            if quiet_from <= at:
                continue
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


def joined(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def stretches(candidate: str, allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[tuple[int, int]]:
    """The suspicious stretches of a candidate by windows of all lengths."""
    quiet = joined(m.span() for pattern in allowed for m in pattern.finditer(candidate) if m[0])
    return joined(s for window in THRESHOLDS if len(candidate) >= window for s in judged(candidate, window, quiet))


def find_spans(text: str, allowed: tuple[re.Pattern, ...] = ALLOWED) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then in the order of ``KINDS``."""
    longest = max(map(len, text.split()), default=0)
    spans = []
    if ":" in text or "=" in text:
        small = text.lower()
        if any(word in small for word in ASSIGN_WORDS):
            spans += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    # None of what follows holds white space, so a text without a long word has none of it.
    if longest >= LEAST_ACCESS and "AKIA" in text:
        spans += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if longest >= LEAST_HEX:
        spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if longest >= WINDOW:
        base = sorted(spans)
        starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
        for m in CANDIDATE.finditer(text):
            for start, end in stretches(m[0], allowed):
                start, end = start + m.start(), end + m.start()
                before = bisect_right(starts, start)
                if not before or reach[before - 1] < end:  # no base span holds it
                    spans.append((start, end, "entropy"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``, each with kind, start and end."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in bounded(batches, "text"):
            found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_spans(text)] for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>"
    )


def masked(text: str, mask: str) -> str:
    """The text with every span, or stretch of overlapping spans, replaced."""
    out, upto = [], 0
    for start, end, _ in find_spans(text):
        if end <= upto:
            continue
        if start >= upto:
            out += [text[upto:start], mask]
        upto = end
    return "".join([*out, text[upto:]]) if out else text


def redact(docs: DataFrame, mask: str = "<SECRET>") -> DataFrame:
    """The same rows and columns with secrets masked in ``text``; ``n_chars``, if there, follows the text."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "text"):
            columns, names = list(batch.columns), batch.schema.names
            old = batch.column("text").to_pylist()
            new = [text and masked(text, mask) for text in old]
            columns[names.index("text")] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in names:
                at = names.index("n_chars")
                lengths = [
                    n if a == b else len(b) for n, a, b in zip(batch.column("n_chars").to_pylist(), old, new)
                ]
                columns[at] = pa.array(lengths, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)

"""Secrets in whole texts: known forms, and strings whose characters are too evenly mixed.

Known forms are three patterns (assignments, access keys, long hexadecimal strings). Any other
candidate string, a run of the characters of encoded data, is measured by the Shannon entropy
of a window that slides over it, with counts kept incrementally, against a threshold for its
class of characters, which 99 of 100 random strings of the class reach. Strings on the allow-list
(UUIDs, repeats of one pattern, sample keys) and strings whose pairs of letters are those of words
are no secrets. Of a candidate that holds a known form the rest is measured; entropy spans touch no
span of a known form.

Null texts are empty and have no spans. Every row is scanned for itself, ties and repeats
included. Positions count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyvine.llm.common import map_batches, slices

# The kinds in order of listing, and their patterns.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20

# Where an assignment may begin, in lower-cased text. "secret" may share its end with "token".
_KEYWORD = re.compile(r"password|passwd|secre(?=t)|token|api_?key")
#: A candidate has at least so many characters; the window is as long.
WINDOW = 20
# "=" stands before a value or pads its end.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Bits per character that some window must reach, by class of characters: what 99 % of random strings of 20 reach.
THRESHOLDS = {"digits": 2.5, "hex": 2.88, "letters": 3.2, "mixed": 3.58, "lower": 3.4, "alphanumeric": 3.64, "encoded": 3.64}
_UUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
_PERIODIC = re.compile(r"(.{1,8}?)\1{2,}.{0,8}")
#: Words, and short numbers, with separators between.
_WORDS = re.compile(r"(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})?(?:[-_/+]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})?)*")
#: Pairs of letters that are common in English, German, French and Spanish, and the share of them that words have at least.
_PAIRS = frozenset(
    """
    aa ab ac ad ae af ah ai al am an ao ap ar as at au aw be bi bl bo by ca ch ci co ct da db de dh di dl dn do dr ds dt
    dw ea eb ec ed ee ef eg eh ei el em en eo ep eq er es et eu ev ew ez fa fe fi fo fr ft ga ge gh gi go gr gs gt ha hb
    he hh hi hl hn ho hr hs ht hw ia ic id ie ig ii il im in io ir is it iv ja ke la le li ll lo ly ma me mi mo na nb nc
    nd ne ng nh ni nl nm nn no np nq nr ns nt nu nv nw oa ob oc od of og oi ol om on op or os ou ov pa pe pf pi po pr qu
    ra rb rc re rh ri rl rn ro rr rs rt ru rw sa sc se sh si sl sn so sr ss st su ta tb te th ti tl tn to tr ts tt tu tw
    tz ua ue uh ui ul um un uo up ur us ut ux va ve vi vo wa wh wi ya ye yo yt zu
    """.split()
)
_LEAST_COMMON = 0.7
#: Public sample keys and markers of test data, in lower case.
ALLOWED = ("example", "placeholder", "your_", "xxxx", "changeme")


def character_class(text: str) -> str:
    if text.isdigit():
        return "digits"
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    one_case = text in (text.lower(), text.upper())
    if text.isalpha():
        return "letters" if one_case else "mixed"
    return ("lower" if one_case else "alphanumeric") if text.isalnum() else "encoded"


def highest_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits per character, of any window of the text.

    With counts c that sum to w the entropy is log2(w) - sum(c log2 c) / w; sliding by one
    changes two counts.
    """
    size = min(window, len(text))
    if not size:
        return 0.0
    weight = [0.0] + [c * log2(c) for c in range(1, size + 1)]
    counts = Counter(text[:size])
    total = sum(weight[c] for c in counts.values())
    least = total
    for gone, come in zip(text, text[size:], strict=False):
        if gone == come:
            continue
        total -= weight[counts[gone]] - weight[counts[gone] - 1]
        counts[gone] -= 1
        total += weight[counts[come] + 1] - weight[counts[come]]
        counts[come] += 1
        least = min(least, total)
    return log2(size) - least / size


def wordlike(text: str) -> bool:
    """Whether a candidate is made of words: most of its pairs of letters are common ones."""
    if not _WORDS.fullmatch(text):
        return False
    lowered = text.lower()
    pairs = [a + b for a, b in zip(lowered, lowered[1:], strict=False) if a.isalpha() and b.isalpha()]
    return 2 * len(pairs) >= len(text) and sum(pair in _PAIRS for pair in pairs) >= _LEAST_COMMON * len(pairs)


def allowed(text: str) -> bool:
    """Whether a candidate is known to be none: on the allow-list, periodic, or made of words."""
    lowered = text.lower()
    return bool(_UUID.fullmatch(text) or _PERIODIC.fullmatch(text)) or any(mark in lowered for mark in ALLOWED) or wordlike(text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, in order; kinds as positions in ``KINDS``."""
    found, end = [], 0
    # Lower-casing keeps positions but for one letter, which is longer in lower case.
    for hint in _KEYWORD.finditer(text.replace("İ", "I").lower()):
        if hint.start() >= end and (match := ASSIGN.match(text, hint.start())):
            end = match.end()
            if len(match[2]) >= LEAST_ASSIGNED:
                found.append((match.start(), 0, end))
    for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, 0)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return sorted(found)


def _mixed(text: str) -> bool:
    bare = text.strip("=+/_-")
    return len(text.rstrip("=")) >= WINDOW and not allowed(text) and highest_entropy(text.rstrip("=")) >= THRESHOLDS[character_class(bare)]


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found = []
    for match in _CANDIDATE.finditer(text):
        at, end = match.span()
        rest = []
        for a, _, b in sorted(known):
            if a < end and at < b:
                rest += [(at, a)] if a > at else []
                at = b
        rest += [(at, end)] if at < end else []
        # What is too short to be measured alone is measured together.
        short = [(a, b) for a, b in rest if b - a < WINDOW]
        for group in (short, *([x] for x in rest if x not in short)):
            if _mixed("".join(text[a:b] for a, b in group)):
                found += [(a, 3, b) for a, b in group]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span, overlapping ones together, replaced by a mark."""
    parts, at = [], 0
    for start, _, end in sorted(spans):
        if start >= at and (start or not at):
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _scan(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                kinds = [kind for _, kind, _ in base]
                spans = sorted(base + entropy_spans(text or "", base))
                rows.append((*[kinds.count(k) for k in range(3)], joined(base), joined(spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            arrays = [pa.array(x, field.type) for x, field in zip(columns, list(schema)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    return run


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base and spans (``kind:start:end``, comma-joined)."""
    slim = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    schema = T.StructType(
        [
            slim.schema[id_column],
            *(T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS[:3]),
            T.StructField("base", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )
    return map_batches(slim, _scan(to_arrow_schema(schema)), schema)


def _redact(text_at: int, length_at: int, mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_at).to_pylist()
            found = [(base := base_spans(x)) + entropy_spans(x, base) if x else [] for x in texts]
            texts = [redact(x, spans, mark) if spans else x for x, spans in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if length_at >= 0:
                old = columns[length_at].to_pylist()
                new = [len(x) if s else n for x, s, n in zip(texts, found, old, strict=True)]
                columns[length_at] = pa.array(new, columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def redact_secrets(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns; secrets are replaced, and the length column, if there is one, follows."""
    text_at = docs.columns.index(text_column)
    length_at = docs.columns.index(length_column) if length_column in docs.columns else -1
    return map_batches(docs, _redact(text_at, length_at, mark), docs.schema)

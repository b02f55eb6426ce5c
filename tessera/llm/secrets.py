"""Operator 8, secret scans with a token-efficiency test.

Three base patterns (assignments, access keys, long hex runs) are searched in every whole text.
The method adds strings that a tiktoken vocabulary splits into many short tokens: text of a
language, however odd, takes two to five characters a token, random strings fewer. A run of
letters, digits and + is judged by its parts between `/`, `_`, `=` and `-`, so that paths, slugs
and time stamps are judged word by word; a span reaches from the first random part of a run to
the last. Strings that are no secrets though random are left out before: UUIDs, hex digests of
the usual lengths, and those that a base span covers. Numbers are none either.

Limits, measured by the tests on strings made at random: see RATIO.

One pass, no shuffle. A vectorised pre-filter (RE2 over the Arrow column) drops texts in which
none of the patterns can match, so that the Python patterns see few texts.
"""

from __future__ import annotations

import base64
import bisect
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies cut texts before merging (a fixed value of those vocabularies).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fewer characters a token than this is random, in a part of LEAST characters or more.
RATIO, LEAST = 2.0, 16
#: Shorter parts, from SHORT characters on, that mix digits with letters or cases and have fewer characters a token than
#: this count if those of a run add up to TOGETHER characters: random strings that hold separators.
SHORT_RATIO, SHORT, TOGETHER = 2.0, 6, 11
#: A part of fewer different characters, such as a DNA sequence, is none.
DIFFERENT = 6
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(rf"[A-Za-z0-9+]{{{SHORT},}}")
#: Taken out of a run before its parts are judged.
KNOWN = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|(?:[0-9a-f]+|[0-9A-F]+)(?![0-9A-Za-z]))")
ANY_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}"""
KINDS = ("assign", "access", "hex", "random")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def _known(m: re.Match) -> str:
    """Blanks for a UUID, a digest or an identifier of 16 hex digits, else the match itself."""
    return " " * len(m[0]) if "-" in m[0] or len(m[0]) == 16 or len(m[0]) in DIGEST_LENGTHS else m[0]


def is_random(part: str, encode) -> bool:
    """Whether a part has few characters a token. Numbers aren't, nor are short hex strings, short words and repetitions of a few letters."""
    digits, letters = sum(map(str.isdigit, part)), sum(map(str.isalpha, part))
    if not letters or len(set(part.lower())) < DIFFERENT:
        return False
    if len(part) >= LEAST:
        return len(part) < RATIO * len(encode(part))
    mixed = digits > 0 or not (part[1:].islower() or part.isupper())
    return mixed and not ANY_HEX.fullmatch(part) and len(part) < SHORT_RATIO * len(encode(part))


def random_spans(text: str, covered: list[tuple[int, int, int]], encode) -> list[tuple[int, int, int]]:
    out, starts, reach = [], [], []
    for a, _, b in covered:  # ends so far, so that one look-up tells whether anything reaches into a run
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    for m in RUN.finditer(text):
        run = KNOWN.sub(_known, m[0])
        found = [p.span() for p in PART.finditer(run) if is_random(p[0], encode)]
        if not any(b - a >= LEAST for a, b in found) and sum(b - a for a, b in found) < TOGETHER:
            continue
        a, b = m.start() + found[0][0], m.start() + found[-1][1]
        before = bisect.bisect_left(starts, b)
        if not (before and reach[before - 1] > a):
            out.append((a, 3, b))
    return out


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_spans, spans.

    Spans are kind:start:end in code points, by start. Null texts count as empty; repeated rows
    are scanned each; an empty table gives no rows; columns besides doc_id and text are not
    read. The vocabulary is read on the driver and sent with the task (under 2 MB).
    """
    with open(vocabulary, "rb") as f:
        raw = f.read()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = None
        for x in batches:
            texts = x.column(1).fill_null("")
            hit = pc.match_substring_regex(texts, MAYBE).to_pylist()
            rows = []
            for i, h in enumerate(hit):
                spans, more = [], []
                if h:
                    encode = encode or encoder(raw)
                    text = texts[i].as_py()
                    spans = base_spans(text)
                    more = random_spans(text, spans, encode)
                rows.append(([sum(k == n for _, k, _ in spans + more) for n in range(4)], _named(spans), _named(spans + more)))
            counts = [pa.array([r[0][n] for r in rows], pa.int64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays([x.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_spans string, spans string")


def secret_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return scan_secrets(docs, vocabulary).select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


"""Secret scans.

Three fixed patterns find secrets by their shape. The method adds to them: a candidate, an
unbroken run of token characters in a sensitive context, is measured by its novelty, the bytes that it
adds to a zstandard frame primed with the text around it and a dictionary of code and identifier words.
What the surroundings or the dictionary explain adds next to nothing; a key or a password that the
rest of the text doesn't contain costs nearly its own length. Candidates that stay incompressible
are reported as kind ``novel``. A long word of prose that occurs once is incompressible too, so a candidate also has to
mix its characters as no word does.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, text_or_empty

#: The base patterns, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs either way
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_HEX_BYTES, _HEX_RUN = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256)), b"x" * 24
KINDS = ("assign", "access", "hex", "novel")

#: What makes a context sensitive, and the identifiers that prime the dictionary.
SENSITIVE = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "bearer", "authorization", "auth_", "client_id", "client_secret", "connection_string", "signature", "-----begin")
IDENTIFIERS = (
    "abstract access account action active address admin agent alias allow amount api_key apikey app application args array assert async attribute auth author authorization await base64 "
    "bearer begin block body bool boolean break browser bucket buffer build byte cache call callback catch certificate change char check class client client_id client_secret cloud code collection "
    "column command comment commit config configuration connect connection const constant constructor container content context continue controller cookie copy count create credential currency current customer "
    "data database date datetime debug decode default define delete description destination device dictionary directory disable document domain double driver dynamic element else email enable encode encrypt end endpoint "
    "entity enum environment error event example exception execute expire export extends external false feature field file filter final first float folder for format from function generate get global group handler hash "
    "header height hidden host html http https identifier image implements import include index info init input insert instance int integer interface internal invalid item javascript json key label language last layout length level library "
    "license limit line link list load local location lock log logger login logout long main manager map max member memory message meta method min mode model modified module name namespace native network new next node none null number "
    "object offset open operator option order output override owner package page parameter parent parse parser password path pattern payload permission phone pointer policy position post prefix price private private_key process "
    "product profile project property protected protocol provider proxy public python query queue random range read record redirect reference refresh region register release remote remove render replace request require reset resource response "
    "result return role root route row sample save schema scope script search secret section select send sequence server service session set setting short signature size socket sort source sql start state static status stop storage store stream string "
    "struct style subject submit super switch symbol sync system table tag target task template temp test text this throw time timeout timestamp title token total transaction transform true try type union unique unsigned update upload uri url use user username "
    "utf-8 uuid valid validate value variable vector version view virtual void warning web where while widget width window worker workspace write xml yaml zone 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~!@#$%^&*-]{12,}", re.ASCII)
_RUN = re.compile(_CANDIDATE.pattern.replace("{12,}", "*"), re.ASCII)
_PARTS = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.ASCII)
_ONE_SOUND = re.compile("sch|[cpst]h|ck", re.IGNORECASE)
_CONSONANTS = re.compile("[bcdfghjklmnpqrstvwxz]{6}", re.IGNORECASE | re.ASCII)
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)), re.ASCII | re.IGNORECASE)


@dataclass(frozen=True)
class Novelty:
    """``before``: characters before a candidate that make its context. ``around``: characters on each
    side that prime the compressor. ``ratio``: least marginal bytes over the candidate's bytes.
    ``longest``: a longer run is measured in pieces of so many characters, and told if one is incompressible."""

    before: int = 48
    around: int = 1024
    ratio: float = 0.7
    longest: int = 512


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """The compressed bytes that the candidate adds to a frame whose dictionary is the identifier
    words and the text around it; over 0 as a frame has a constant part, which is taken off."""
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + " " + after + " " + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    squeeze = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)
    return len(squeeze.compress(candidate.encode())) - len(squeeze.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost and without overlap in each kind.

    What a pattern can't do without is looked for first, by plain substring search.
    """
    found, low = [], text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pieces(a: int, b: int, longest: int) -> list[tuple[int, int]]:
    """The run in consecutive pieces; a rest too short for a candidate belongs to the piece before it."""
    cuts = [x for x in range(a, b, longest) if x == a or b - x >= 12] + [b]
    return list(zip(cuts, cuts[1:]))


def _irregular(body: str) -> bool:
    """Whether the characters are mixed as in no word: letters with digits; letters alone whose parts, as camel case
    has them within a word, have fewer than four letters on average, or six consonants in a row, those written for one sound as one."""
    parts = _PARTS.findall(body)
    if not parts:
        return False
    if re.search("[0-9]", body):
        return True
    inner = sum(m.start() > 0 and body[m.start() - 1].isalpha() for m in _PARTS.finditer(body))
    return 4 * (inner + 1) > sum(map(len, parts)) or any(_CONSONANTS.search(_ONE_SOUND.sub("c", x)) for x in parts)


def _is_novel(text: str, a: int, b: int, end: int, how: Novelty) -> bool:
    """Whether the piece, of a run up to ``end``, is mixed as in no word and incompressible."""
    body = text[a:b]
    if not _irregular(body):
        return False
    return marginal_bytes(body, text[max(0, a - how.around) : a], text[end : end + how.around]) >= how.ratio * len(body)


def novel_spans(text: str, base: list[tuple[int, int, int]], how: Novelty = Novelty()) -> list[tuple[int, int, int]]:
    """(start, 3, end) of the incompressible candidates in sensitive contexts that no base span touches."""
    out, low = [], text.lower()
    if not any(w in low for w in SENSITIVE):
        return out
    start, end, judged, ends, told = 0, -1, set(), set(), set()
    for word in _SENSITIVE.finditer(text):
        for m in _CANDIDATE.finditer(text, word.start(), min(len(text), word.end() + how.before + 64)):
            a = m.start()
            if a > word.end() + how.before:
                break
            if not start <= a < end:
                start, end = a, _RUN.match(text, a).end()
            b = end
            # A word in the run's own name (client_secret_key) is context, not a secret.
            if a <= word.start() < b:
                a = max(a, word.end())
                while a < b and text[a] in "=_-*&+/":
                    a += 1
                if b - a < 12:
                    continue
            # A run is told once, and judged again only from another start.
            if b in told or (a, b) in judged:
                continue
            # What follows the first piece has been measured if the run was judged from an earlier start.
            whole = b not in ends
            ends.add(b)
            judged.add((a, b))
            if any(s < b and a < e for s, _, e in base):
                continue
            if any(_is_novel(text, x, y, b, how) for x, y in (_pieces(a, b, how.longest) if whole else [(a, min(b, a + how.longest))])):
                out.append((a, 3, b))
                told.add(b)
    return sorted(set(out))


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Novelty = Novelty()) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) for every document; a null or empty
    text has no spans. Spans are kind:start:end in code points, ordered by start, then kind."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text)
            novel = novel_spans(text, base, how)
            counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*counts, hashlib.sha256(_said(base).encode()).hexdigest(), _said(sorted(base + novel)), len(novel)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return map_arrow(docs.select(F.col(id_col), text_or_empty(text_col).alias("t")), each, schema)


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", how: Novelty = Novelty()) -> DataFrame:
    """The same rows and columns with every span replaced; of an assignment only its value goes. A null
    text stays null."""
    columns = docs.columns
    at = columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else _masked(t, mask, how) for t in batch.column(at).to_pylist()]
        arrays = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(columns))]
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    return map_arrow(docs, each, docs.schema)


def _masked(text: str, mask: str, how: Novelty) -> str:
    base = base_spans(text)
    spans = base + novel_spans(text, base, how)
    if not spans:
        return text
    values = []
    for a, k, b in spans:
        m = ASSIGN.match(text, a) if k == 0 else None
        values.append((m.start(2), m.end(2)) if m else (a, b))
    out, at = [], 0
    for a, b in sorted(values):
        if b > at:
            out += [text[at : max(a, at)], mask if a >= at else ""]
            at = b
    return "".join(out) + text[at:]

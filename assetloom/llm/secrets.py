"""Secret scans: fixed patterns, and high entropy in sliding windows over candidate strings.

Candidates are maximal runs of token characters. A window slides over each candidate; the counts of
its characters are kept by adding the one that enters and taking away the one that leaves, so each
step costs the same whatever the window's length. Windows whose Shannon entropy reaches the limit
of a character class are joined into one span; each limit is what 995 of 1000 random windows of the
class's own alphabet reach. Long words reach them too, so spans whose letters mostly follow each
other as in words are left out. The allow list holds for the parts of a candidate between its
joiners, not for all of it. Spans found by the fixed patterns always stay.

Defined results: a null or empty text has no spans; places count code points, ends are exclusive;
of equal starts the kinds come in the order of ``KINDS``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetloom.llm.common import per_text, table

KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper", "entropy_letters"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 6
#: Runs shorter than this hold neither an access key, nor a hex key, nor a full window.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Of each character class: its runs, the window, the least entropy in bits a character, and the
#: entropy from which a span needs no test for words.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.62, 3.9),
    "entropy_lower": (re.compile(r"[a-z0-9]{20,}"), 20, 3.34, 5.0),
    "entropy_upper": (re.compile(r"[A-Z0-9]{20,}"), 20, 3.28, 5.0),
    "entropy_letters": (re.compile(r"[A-Za-z]{20,}"), 20, 3.14, 5.0),
}
#: What stands between the joiners of a candidate.
PART = re.compile(r"[A-Za-z0-9]+")
#: Lengths of the parts of an identifier in UUID form, joined by dashes.
UUID, HEXES = (8, 4, 4, 4, 12), re.compile(r"[0-9a-fA-F]+")
#: Parts that hold one of these are no secrets.
PLACEHOLDERS = ("example", "placeholder", "xxxx", "0123456789", "abcdefgh")
LETTER, PAIR = re.compile(r"[A-Za-z]"), re.compile(r"(?=([A-Za-z]{2}))")
#: Pairs of letters that are frequent in English, German, French or Spanish, by the first letter.
FREQUENT = frozenset(
    first + second
    for first, _, more in (x.partition(":") for x in """a:abcdeilmnprstu b:ejloy c:aehiklot d:aeiou e:abcdefilmnopqrstuvxz f:aioru g:aeu h:abehinost i:acdefglmnorstv j:ae k:e l:aefilostuy m:aeiop
    n:abcdeghilmnorstuv o:abcdefilmnprstuw p:aeflort q:u r:abeghimnorstu s:acehimoprstu t:aehilorstuyz u:aeilmnoprstx v:aeio w:hi x:aeot z:u""".split())
    for second in more
)
#: The share of frequent pairs from which letters make words; some 3 in 10 are frequent by chance.
WORDLIKE = 0.6


def no_secret(span: str, sure: bool) -> bool:
    """Whether a span has no letters, or its letters make words; ``sure`` leaves out the latter,
    except for a span of letters and joiners only."""
    if not LETTER.search(span):
        return True
    if sure and any("0" <= c <= "9" for c in span):
        return False
    pairs = [p.lower() in FREQUENT for p in PAIR.findall(span)]
    return sum(pairs) > WORDLIKE * len(pairs)


def is_uuid(run: str, parts: list[re.Match]) -> bool:
    """Whether parts of a run make an identifier in UUID form."""
    dashes = all(run[a.end() : b.start()] == "-" for a, b in pairwise(parts))
    return dashes and all(len(p.group()) == n and HEXES.fullmatch(p.group()) for p, n in zip(parts, UUID, strict=True))


def candidates(run: str) -> list[tuple[int, str]]:
    """What the allow list leaves of a run, with the places. Each part is looked at once, so a run costs as much
    as it is long."""
    low = run.lower()
    if run.count("-") < 4 and not any(w in low for w in PLACEHOLDERS):
        return [(0, run)]
    out, at = [], 0
    parts, k = list(PART.finditer(run)), 0
    while k < len(parts):
        part = parts[k]
        size = len(UUID) if part.end() - part.start() == UUID[0] and k + len(UUID) <= len(parts) and is_uuid(run, parts[k : k + len(UUID)]) else 1
        if size > 1 or any(w in low[part.start() : part.end()] for w in PLACEHOLDERS):
            out.append((at, run[at : part.start()]))
            at = parts[k + size - 1].end()
        k += size
    return [*out, (at, run[at:])]


def window_spans(run: str, width: int, least: float, plogs: list[float]) -> list[tuple[int, int]]:
    """Joined windows of a run whose entropy is at least ``least``; plogs[c] is c * log2(c)."""
    counts: dict[str, int] = {}
    total, out = 0.0, []  # total: the sum of plogs over the window's counts
    limit = width * (math.log2(width) - least) + 1e-9  # entropy = log2(width) - total / width
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += plogs[n + 1] - plogs[n]
        if i >= width:
            old = run[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += plogs[n - 1] - plogs[n]
        if i >= width - 1 and total <= limit:
            if out and out[-1][1] >= i - width + 1:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i - width + 1, i + 1))
    return out


PLOGS = [0.0] + [c * math.log2(c) for c in range(1, 65)]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and all spans."""
    base: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        base += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    more: list[tuple[str, int, int]] = []
    for r in RUN.finditer(text):
        run, at = r.group(), r.start()
        base += [(kind, at + m.start(), at + m.end()) for kind, find in (("access", ACCESS), ("hex", HEX)) for m in find.finditer(run)]
        for offset, part in candidates(run):
            for kind, (find, width, least, sure) in CLASSES.items():
                for m in find.finditer(part):
                    for a, b in window_spans(m.group(), width, least, PLOGS):
                        span = m.group()[a:b]
                        if not no_secret(span, bool(window_spans(span, width, sure, PLOGS))):
                            more.append((kind, at + offset + m.start() + a, at + offset + m.start() + b))
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base.sort(key=order)
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    inside = lambda s: (k := bisect_right(starts, s[1])) > 0 and reach[k - 1] >= s[2]  # noqa: E731  of a base span
    new = [s for s in more if not inside(s)]
    return base, sorted(base + new, key=order)


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("base", SPAN), T.StructField("spans", SPAN)])
MASK = "[SECRET]"


@lru_cache(maxsize=1)
def _finder():
    def run(text: str) -> dict:
        base, spans = scan(text)
        return {"base": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in base], "spans": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans]}

    return run


@lru_cache(maxsize=1)
def _masker():
    def run(text: str) -> str:
        out, at = [], 0
        for _, a, b in scan(text)[1]:
            if b <= at:
                continue
            if a >= at:
                out += [text[at:a], MASK]
            at = b
        return "".join(out) + text[at:] if out else text

    return run


def find_secrets(text: Column) -> Column:
    """struct(base, spans), each an array of struct(kind, start, end)."""
    return per_text(_finder, FOUND)(text)


def mask_secrets(text: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced; null stays null."""
    return F.when(text.isNotNull(), per_text(_masker, T.StringType())(text))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark, sf_dir):
    """The secrets of every document: counts by base kind, a digest of the base spans, all spans."""
    found = table(spark, sf_dir, "documents").select("doc_id", find_secrets(F.col("text")).alias("f"))
    count = lambda kind: F.size(F.filter("f.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("f.base"), 256).alias("base_sha256"), _joined("f.spans").alias("spans"))

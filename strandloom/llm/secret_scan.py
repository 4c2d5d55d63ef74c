"""Secret scan: fixed patterns, and automata inferred from labelled credentials.

Base spans come from three patterns. Further spans come from probabilistic automata: strings of labelled credentials form
a prefix tree over character classes, states whose symbol and stop frequencies are compatible (Hoeffding bound) are
merged, and the automaton that is left gives any candidate a likelihood. An automaton of ordinary long tokens gives the
likelihood of the other hypothesis, together with automata of strings that look random and are harmless (``harmless``); lengths
have a likelihood of their own. A candidate whose log ratio exceeds a threshold is a secret; the threshold is fitted on harmless
strings kept from training. Candidates are ASCII runs of any length from the shortest label on and their parts between ``=``, ``/`` and ``.``.

Labels are the base spans in a bounded, documented sample of documents (``SAMPLE_DOCS``, of which ``SAMPLE_STRINGS`` per
kind are used) and examples generated from published credential formats. The scan itself covers every whole text.

Defined cases: a null text is empty; equal rows are scanned alike; other columns of the input, whatever their names, are not
read (``redact`` passes them on); an empty table trains on the published formats and gives no rows; work on a text grows with
its length; of equal scores the first candidate in the text wins; ids may be null or of any type.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialised, type_of

# The base patterns. Letters of the first are matched in either case, ASCII only.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex")

#: Runs in which the automata's candidates lie: the signs of all learned strings, whose shortest has ASSIGN_LENGTH. Any other
#: character ends a run, also a letter outside ASCII.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % ASSIGN_LENGTH)
ORDINARY = CANDIDATE
_PART = re.compile(r"[^=/]+")
_DOTTED = re.compile(r"[^=/.]+")
_VALUE = re.compile(r"=(?=[^=/.])")

# Published credential formats as (name, prefix, alphabet, length after the prefix).
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
FORMATS = (
    ("ghp", "ghp_", _ALNUM, 36),
    ("slack", "xoxb-", "0123456789", 24),
    ("live", "sk_live_", _ALNUM, 24),
    ("maps", "AIza", _ALNUM + "_-", 35),
    ("base64", "", _ALNUM + "+/", 40),
    ("npm", "npm_", _ALNUM, 36),
    ("gitlab", "glpat-", _ALNUM + "_-", 20),
    ("sk", "sk-", _ALNUM, 48),
    ("vault", "hvs.", _ALNUM + "_-", 24),
    ("oauth", "ya29.", _ALNUM + "_-", 60),
)
#: Prefix and lengths of the three parts of a signed token.
SIGNED = ("eyJ", (17, 40), (40, 120), (43, 43))

SAMPLE_DOCS = 20_000
SAMPLE_STRINGS = 400
ALPHA = 0.05
#: How many harmless strings in a thousand, of those kept from training, may be called secrets, and the least log ratio in nats.
FALSE_PER_MILLE, LEAST = 2, 6.0
#: One string in so many is kept from training to fit the threshold.
KEPT = 4
#: Parts between slashes that are tried together: base64 has slashes of its own.
PARTS = 4
#: Scores that a task keeps, and how long their class strings are at most.
_KNOWN, _KNOWN_LENGTH = 200_000, 64
_SMOOTH = 0.01
_SYMBOLS = 16
#: Longer strings count as equally long; a run of this length that is encoded data as a whole has no candidates inside.
_LONG = 64
_BLOB = "encoded"
_ENCODED = re.compile(r"[A-Za-z0-9+/]{%d,}=*" % _LONG)

_CLASS = {c: "x" for c in "abcdef"} | {c: "l" for c in "ghijklmnopqrstuvwxyz"} | {c: "X" for c in "ABCDEF"}
_CLASS |= {c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"} | {c: "d" for c in "0123456789"}

_CLASSES = str.maketrans(_CLASS)
_SEPARATOR = re.compile(r"[=/.]")


def classes(s: str) -> str:
    """Symbols of the automata: hex letters, other letters by case, digits, and each sign as it is."""
    return s.translate(_CLASSES)


class Automaton:
    """A deterministic probabilistic automaton: per state, counts of symbols (with targets) and of stops."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.stop: list[int] = [0]

    def _new(self) -> int:
        self.next.append({})
        self.count.append(defaultdict(int))
        self.stop.append(0)
        return len(self.next) - 1

    def total(self, q: int) -> int:
        return self.stop[q] + sum(self.count[q].values())

    @classmethod
    def prefix_tree(cls, strings: list[str]) -> Automaton:
        a = cls()
        for s in strings:
            q = 0
            for c in s:
                if c not in a.next[q]:
                    a.next[q][c] = a._new()
                a.count[q][c] += 1
                q = a.next[q][c]
            a.stop[q] += 1
        return a

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
        return abs(f1 / n1 - f2 / n2) > bound

    def compatible(self, a: int, b: int) -> bool:
        """Whether the two states and all that follows them have compatible frequencies."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n1, n2 = self.total(p), self.total(q)
            if not n1 or not n2:
                continue
            if self._differ(self.stop[p], n1, self.stop[q], n2):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), n1, self.count[q].get(c, 0), n2):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to a state and what follows it."""
        todo = [(into, tree)]
        while todo:
            p, q = todo.pop()
            self.stop[p] += self.stop[q]
            for c, n in self.count[q].items():
                self.count[p][c] += n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    @classmethod
    def inferred(cls, strings: list[str]) -> Automaton:
        """Merge states of the prefix tree, nearest to the root first, until no two kept states are compatible."""
        a = cls.prefix_tree(strings)
        kept = [0]
        while True:
            border = [(q, c, t) for q in kept for c, t in sorted(a.next[q].items()) if t not in kept]
            if not border:
                return a
            q, c, t = border[0]
            for r in kept:
                if a.compatible(r, t):
                    a.next[q][c] = r
                    a.fold(r, t)
                    break
            else:
                kept.append(t)

    def table(self) -> dict[tuple[int, str], tuple[float, int]]:
        """(state, symbol) to log probability and next state, for the reachable part; -1 stands for unseen symbols."""
        out: dict = {}
        seen, todo = {0}, [0]
        while todo:
            q = todo.pop()
            n = self.total(q) + _SMOOTH * _SYMBOLS
            out[q, ""] = (math.log(_SMOOTH / n), 0)
            for c, t in self.next[q].items():
                out[q, c] = (math.log((self.count[q][c] + _SMOOTH) / n), t)
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return out


def harmless(n: int = SAMPLE_STRINGS, seed: int = 23) -> dict[str, list[str]]:
    """Made-up strings of kinds that look random and are no secrets."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(low, high)))

    def uuid() -> str:
        text = "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))
        return text.upper() if rng.random() < 0.3 else text

    def identifier() -> str:
        words = [some(letters, 2, 9) for _ in range(rng.randint(2, 5))]
        style = rng.randrange(4)
        if style < 2:
            return words[0].capitalize() * (style == 1) + words[0] * (style == 0) + "".join(w.capitalize() for w in words[1:]) + str(rng.randrange(100)) * rng.randrange(2)
        return "_".join(words).upper() if style == 2 else rng.choice("_-.").join(words)

    def encoded() -> str:
        return some(_ALNUM + "+/", _LONG, 2 * _LONG) + "=" * rng.randrange(3)

    kinds = {
        "uuid": uuid, "id": lambda: some(_ALNUM + "-_", 6, 16), "number": lambda: some("0123456789", 6, 40), "identifier": identifier, _BLOB: encoded,
        "version": lambda: ".".join(some("0123456789", 1, 4) for _ in range(rng.randint(3, 5))) + rng.choice(["", "-" + some(letters, 2, 6), "-" + some("0123456789", 3, 8)]),
    }
    return {k: [make() for _ in range(n // 4 if k == _BLOB else n)] for k, make in kinds.items()}


def log_likelihood(table: dict, symbols: str) -> float:
    """Of a string's symbols; an unseen symbol costs its smoothed probability and leads back to the start."""
    q, total = 0, 0.0
    for c in symbols:
        p, q = table.get((q, c)) or table[q, ""]
        total += p
    return total


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in order; kinds are positions in KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= ASSIGN_LENGTH]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for s, _, e in spans:
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def touches(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether one of the disjoint stretches overlaps start..end."""
    i = bisect.bisect_left(covered[0], end) - 1
    return i >= 0 and covered[1][i] > start


def labelled_strings(docs: DataFrame) -> dict[str, list[str]]:
    """Training strings by label, from a sample of documents and from the formats; ``ordinary`` has the others."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))

    def strings(_, text):
        text = text or ""
        spans = base_spans(text)
        for s, k, e in spans:
            m = ASSIGN.match(text, s) if k == 0 else None
            yield KINDS[k], m.group(1) if m else text[s:e]
        covered = merged(spans)
        plain = [m for m in ORDINARY.finditer(text) if not touches(covered, m.start(), m.end())]
        for m in plain[:: max(1, len(plain) // 4)]:
            yield "ordinary", m.group()

    found = map_rows(chosen, ["doc_id", "text"], strings, "kind string, s string").distinct()
    found = materialised(found)
    # Every task keeps the first SAMPLE_STRINGS of a kind, and the driver takes the first of those.
    out: dict[str, list[str]] = {
        k: [r["s"] for r in found.where(F.col("kind") == k).orderBy(F.xxhash64("kind", "s"), "s").limit(SAMPLE_STRINGS).collect()]
        for k in (*KINDS, "ordinary")
    }
    rng = random.Random(17)
    return out | published(SAMPLE_STRINGS // 4, rng)


def published(n: int, rng: random.Random) -> dict[str, list[str]]:
    """Made-up credentials of the published formats."""

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choices(alphabet, k=rng.randint(low, high)))

    out = {name: [prefix + some(alphabet, length, length) for _ in range(n)] for name, prefix, alphabet, length in FORMATS}
    head, *sizes = SIGNED
    out["signed"] = [".".join(p + some(_ALNUM + "_-", *k) for p, k in zip((head, head, ""), sizes, strict=True)) for _ in range(n // 2)]
    return out


def _sizes(strings: list[str]) -> list[float]:
    """Log probabilities of lengths; short ones are known by themselves, long ones together."""
    n = [_SMOOTH] * (_LONG + 1)
    for x in strings:
        n[min(len(x), _LONG)] += 1
    whole = math.log(sum(n))
    return [math.log(x) - whole for x in n]


def train(strings: dict[str, list[str]]) -> dict:
    """An automaton and the lengths of each label that has strings, for credentials and for what is none, and the threshold.

    The threshold is fitted on harmless strings that are kept from training: no more than ``FALSE_PER_MILLE`` of them exceed it.
    """
    # Strings with a published prefix are no ordinary ones, though no base pattern finds them.
    prefixed = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(re.escape(p) for _, p, _, _ in FORMATS if p) + ")")
    plain = [x for x in strings.get("ordinary") or [] if not prefixed.search(x)]
    # Plain words and ruled lines exist in any corpus, sampled or not.
    letters = ["".join(random.Random(i).choices("abcghijkl", k=12)) for i in range(50)]
    ruled = [c * 24 for c in "=-_/+" for _ in range(10)]
    # So do numbers: cards, telephones, dates, addresses of machines.
    shapes = ["9" * 16, "9" * 10, "999-9999", "999-999-9999", "9999-99-99", "999.999.999.999", "99.99.999.999", "9999-9999-9999-9999", "9.999999"]
    numbers = [x for x in shapes for _ in range(5)]
    # And names and paths, of which the signs between words are learned.
    names = [p for a, b in zip(letters, letters[1:]) for p in (f"{a[:5]}/{b[:3]}/{a[5:]}", f"/{a[:4]}/{b[:6]}", f"{a[:7]}.{b[:3]}", f"MAX_NO={b[:6]}")]
    kept, learned = [], {}
    for label, found in {"ordinary": plain, **harmless()}.items():
        kept += found[::KEPT]
        learned[label] = [x for i, x in enumerate(found) if i % KEPT]
    learned["ordinary"] += letters + [x.upper() for x in letters] + ruled + numbers + names

    def tables(kinds: dict[str, list[str]]) -> dict:
        return {k: (Automaton.inferred([classes(x) for x in v]).table(), _sizes(v)) for k, v in kinds.items() if v}

    model = {"secret": tables({k: v for k, v in strings.items() if k != "ordinary"}), "harmless": tables(learned), "threshold": 0.0}
    totals = sorted(score(model, x) for x in kept)
    model["threshold"] = max(LEAST, totals[-1 - len(totals) * FALSE_PER_MILLE // 1000] + 1e-6)
    return model


def _best(tables: dict, c: str) -> float:
    return max((log_likelihood(t, c) + sizes[min(len(c), _LONG)] for t, sizes in tables.values()), default=-math.inf)


def score(model: dict, s: str) -> float:
    """Log ratio of the best credential automaton and length against the best harmless ones."""
    return _score(model, classes(s))


def _score(model: dict, c: str) -> float:
    return _best(model["secret"], c) - _best(model["harmless"], c)


def accepted(model: dict, s: str) -> bool:
    return score(model, s) > model["threshold"]


def _is_blob(model: dict, run: str, c: str) -> bool:
    """Whether a long run, of symbols c, is encoded data as a whole: then pieces of it look like keys by chance only."""
    if not _ENCODED.fullmatch(run):
        return False
    one = {_BLOB: model["harmless"][_BLOB]}
    rest = {k: v for k, v in model["harmless"].items() if k != _BLOB}
    return _best(one, c) > max(_best(rest, c), _best(model["secret"], c))


def candidates(run: str) -> set[tuple[int, int]]:
    """(start, end) in a run: the whole, what follows its first and its last ``=``, and the parts between ``=``, ``/`` and ``.``, of
    those between slashes up to PARTS together; names, paths and full stops around a credential are in some of them only. Their
    sizes together grow in proportion to that of the run."""
    end = len(run.rstrip("."))
    begin = len(run) - len(run.lstrip("."))
    out = {(begin, end)}
    values = [m.end() for m in _VALUE.finditer(run)]
    out |= {(at, end) for at in values[:1] + values[-1:]}
    out |= {(m.start(), m.end()) for m in _DOTTED.finditer(run)}
    parts = [(m.start(), m.end()) for m in _PART.finditer(run)]
    out |= {(s, e) for i, (s, _) in enumerate(parts) for _, e in parts[i : i + PARTS] if "=" not in run[s:e]}
    return {(s, e) for s, e in out if e - s >= ASSIGN_LENGTH}


def format_spans(model: dict, text: str, base: list[tuple[int, int, int]], known: dict[str, float]) -> list[tuple[int, int, int]]:
    """The candidates that the automata accept and no base span touches; of those that overlap, the one whose log ratio exceeds
    the threshold by most in total. ``known`` keeps that excess by class string."""
    out = []
    covered = merged(base)
    for m in CANDIDATE.finditer(text):
        run = m.group()
        symbols = classes(run)
        word = symbols.strip(".")
        if not _SEPARATOR.search(word) and known.get(word, math.inf) <= 0:
            continue
        if _is_blob(model, run, symbols):
            continue
        good = []
        for s, e in candidates(run):
            c = symbols[s:e]
            excess = known.get(c)
            if excess is None:
                if len(known) >= _KNOWN:
                    known.clear()
                excess = max(0.0, _score(model, c) - model["threshold"])
                if len(c) <= _KNOWN_LENGTH:
                    known[c] = excess
            if excess > 0:
                good.append((-excess, s + m.start(), e + m.start()))
        if good:
            good = [g for g in good if not touches(covered, g[1], g[2])]
        taken: list[tuple[int, int, int]] = []
        for _, s, e in sorted(good):
            at = bisect.bisect(taken, (s, 3, e))
            if (at == 0 or taken[at - 1][2] <= s) and (at == len(taken) or e <= taken[at][0]):
                taken.insert(at, (s, 3, e))
        out += taken
    return out


def all_spans(model: dict, text: str, known: dict[str, float] | None = None) -> list[tuple[int, int, int]]:
    """Base spans, and those of the automata (kind 3, ``format``)."""
    base = base_spans(text)
    return sorted(base + format_spans(model, text, base, {} if known is None else known))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{(*KINDS, 'format')[k]}:{s}:{e}" for s, k, e in spans)


def likely(model: dict, text: str, base: list[tuple[int, int, int]]) -> int:
    """How many base spans hold strings that the automata accept too."""
    strings = [ASSIGN.match(text, s).group(1) if k == 0 else text[s:e] for s, k, e in base]
    return sum(accepted(model, x) for x in strings)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_likely`` for every row of ``docs``.

    ``n_likely`` counts the base spans whose strings the automata accept as well.
    """
    model, known = train(labelled_strings(docs)), {}

    def one(doc_id, text):
        spans = all_spans(model, text or "", known)
        base = [x for x in spans if x[1] < 3]
        n = [sum(x[1] == k for x in spans) for k in range(4)]
        yield doc_id, *n[:3], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), n[3], likely(model, text or "", base)

    schema = f"doc_id {type_of(docs, 'doc_id')}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint, n_likely bigint"
    return map_rows(docs, ["doc_id", "text"], one, schema)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of texts masked and n_chars counted anew; all other columns stay."""
    model, known = train(labelled_strings(docs)), {}
    names = docs.columns
    at = names.index("text")

    def one(*values):
        row = list(values)
        if row[at]:
            row[at] = mask(row[at], all_spans(model, row[at], known))
            if "n_chars" in names:
                row[names.index("n_chars")] = len(row[at])
        yield tuple(row)

    return map_rows(docs, names, one, docs.schema)

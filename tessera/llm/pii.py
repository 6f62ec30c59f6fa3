"""Personal data by generated candidates and boosted trees (operator 7). DataFrame functions only.

Method. Base spans are found by fixed patterns with checks (part values, Luhn sum, digit counts) and
always stay. Beside them, high-recall generators propose overlapping candidates: spelt-out
addresses, numbers grouped in other ways, telephone numbers without a plus, hexadecimal addresses.
Each candidate gets format and context features; gradient-boosted trees score it, and a threshold
for each kind, calibrated on a held-out half of the training spans, selects what is redacted. A
selected candidate never overlaps a base span, and of overlapping candidates the best score stays.

The trees are trained once per process on ``TRAINING_TEXTS`` written examples, whose features are
computed by the very expressions that run on the corpus; the fitted trees are then one expression of
nested conditions. So the corpus passes through built-in functions alone, in one scan, without a
shuffle; a task holds one row's candidates. The work on a text grows with its length and its hits:
running sums and maxima go block by block (``_scan``), spans and candidates meet in one order by
place, and what stands around a candidate is read from pieces of the text.

The patterns of the base are written so that scanning is linear in the text: possessive where
nothing can follow by backtracking, and anchored to the start of a run, which finds the same
leftmost matches as the plain pattern. What stands before a run is asked after its first character,
so that most places of a text are passed over by one comparison.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive;
repeated rows give repeated results; null ids stay null; other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import math
import random
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TRAINING_TEXTS = 3_000
TREES, DEPTH, RATE = 40, 3, 0.3
#: Precision that a kind's threshold must reach on the held-out training spans, and its least value.
PRECISION = 0.99
LEAST_LOGIT = 1.5
CONTEXT = 28

# Base patterns. Each finds the leftmost non-overlapping matches of the plain pattern beside it.
_BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 to 19 digits: whole chains of digits, so shorter and longer ones are passed over
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Generators of candidates, by kind.
_PROPOSED = {
    "email": [r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ {0,2}(?:\(at\)|\[at\]|\{at\}|<at>| at |@) {0,2}[A-Za-z0-9-]++(?:(?:\.| {0,2}(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot ) {0,2})[A-Za-z0-9-]++)++"],
    "ip": [r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){3,7}+[0-9a-f]{1,4}(?![0-9a-f:])", r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}){3}(?![0-9])"],
    "card": [r"(?<![0-9])(?<![0-9][ ./_-])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}+(?![ ./_-]?[0-9])"],
    "phone": [r"(?<![0-9+])(?<![0-9][ .-])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])(?![ .-][0-9])", r"(?<![0-9A-Za-z.+-])0[0-9]{8,13}(?![0-9A-Za-z])"],
}
_CUES = {
    "email": r"(?i)e-?mail|contact|write|reach|correo|courriel|schreib|address|adresse",
    "ip": r"(?i)\bip\b|ipv6|host|server|address|addr|client|login from|adresse",
    "card": r"(?i)card|visa|master|amex|credit|debit|karte|carte|tarjeta|\bcc\b|payment|pay",
    "phone": r"(?i)\btel|phone|call|fax|mobil|cell|whatsapp|telefon|tél|llam|anruf|ring|sms|hotline",
}
_ANTI = r"(?i)order|invoice|isbn|issn|ref|version|\bv\.?$|serial|\bid\b|\bno\b|part|article|build|page|score|price|total|€|\$|£|tracking|account|code|sum|result|section|chapter|lat|lon|date|time|since|between|from"

_NONE = "cast(array() as array<struct<start:int,end:int,hit:string>>)"
#: Values of a block of a running sum, and characters of a piece of text.
_BLOCK, _PIECE = 256, 512

# Expressions are SQL text: as columns, tens of thousands of calls into the JVM took 15 to 20 s for each plan.
_names = itertools.count()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with(use, n: int = 1) -> str:
    """A lambda of ``n`` arguments with names of its own."""
    names = [f"v{next(_names)}" for _ in range(n)]
    return f"({', '.join(names)}) -> {use(*names)}" if n > 1 else f"{names[0]} -> {use(*names)}"


def _each(values: str, use, n: int = 1) -> str:
    return f"transform({values}, {_with(use, n)})"


def _where(values: str, use, n: int = 1) -> str:
    return f"filter({values}, {_with(use, n)})"


def _zip(a: str, b: str, use) -> str:
    return f"zip_with({a}, {b}, {_with(use, 2)})"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _let(value: str, use) -> str:
    """``use`` of a value that is computed once, however often ``use`` reads it."""
    return f"{_each(f'array({value})', use)}[0]"


def _scan(values: str, add, start: str) -> str:
    """Running results of ``add`` over an array of ints, in blocks, so that no long array is built element by element."""

    def run(some: str, first: str) -> str:
        step = _with(lambda s, x: _let(add(f"{s}.at", x), lambda y: _struct(at=y, out=f"concat({s}.out, array({y}))")), 2)
        return f"aggregate({some}, {_struct(at=first, out='cast(array() as array<int>)')}, {step}, {_with(lambda s: f'{s}.out')})"

    def long(v: str) -> str:
        blocks = _each(f"sequence(0, cast(floor((size({v}) - 1) / {_BLOCK}) as int))", lambda b: f"slice({v}, {b} * {_BLOCK} + 1, {_BLOCK})")
        # each block's own run, then what comes before each block
        done = _each(blocks, lambda some: run(some, start))
        before = lambda d: f"concat(array({start}), {run(_each(d, lambda r: f'element_at({r}, -1)'), start)})"
        return _let(done, lambda d: f"flatten({_zip(d, f'slice({before(d)}, 1, size({d}))', lambda r, first: _each(r, lambda x: add(first, x)))})")

    return _let(values, lambda v: f"if(size({v}) <= {_BLOCK}, {run(v, start)}, {long(v)})")


def _plus(a: str, b: str) -> str:
    return f"{a} + {b}"


def _greatest(a: str, b: str) -> str:
    return f"greatest({a}, {b})"


def _least(a: str, b: str) -> str:
    return f"least({a}, {b})"


def matches(text: str, pattern: str) -> str:
    """Every match of a pattern that cannot be empty, in order, with its place in code points."""
    pattern = _quoted(pattern)

    def placed(h: str) -> str:
        gaps = f"slice(split({text}, {pattern}, -1), 1, size({h}))"
        ends = _scan(_zip(h, gaps, lambda x, gap: f"length({gap}) + length({x})"), _plus, "0")
        return _zip(h, ends, lambda x, end: _struct(start=f"{end} - length({x})", end=end, hit=x))

    return _let(f"regexp_extract_all({text}, {pattern}, 0)", lambda h: f"if(size({h}) = 0, {_NONE}, {placed(h)})")


def pieces_of(text: str) -> str:
    """A text in pieces of as many code points each, but for the last."""
    return f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)"


def part_of(pieces: str, start: str, length: str) -> str:
    """The part of a text, given in pieces, from a place on, of any length from 0."""
    first, last = f"cast(floor(({start}) / {_PIECE}) as int)", f"cast(floor((({start}) + {length}) / {_PIECE}) as int)"
    return f"substr(array_join(slice({pieces}, {first} + 1, {last} - {first} + 1), ''), {start} - {first} * {_PIECE} + 1, {length})"


def _digits(hit: str) -> str:
    return f"regexp_replace({hit}, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits, read often, passes the Luhn check."""

    def add(total: str, i: str) -> str:
        return _let(f"cast(substr({digits}, {i}, 1) as int)", lambda v: f"{total} + if((length({digits}) - {i}) % 2 = 1, {v} * 2 - if({v} > 4, 9, 0), {v})")

    return f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, {_with(add, 2)}) % 10 = 0"


def _valid(kind: str, hit: str) -> str:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return f"rlike({hit}, {_quoted(rf'^{part}\.{part}\.{part}\.{part}$')})"
    if kind == "card":
        return _let(_digits(hit), luhn)
    if kind == "phone":
        return f"length({_digits(hit)}) between 9 and 15"
    return "true"


def _marked(kind: str) -> tuple[str, str]:
    """A character that every match of a kind has, and the kind's base pattern."""
    return {"email": "@", "ip": ".", "phone": "+"}.get(kind, ""), _BASE[kind]


def base_spans(text: str, kind: str) -> str:
    """The base spans of one kind in a text that is not null."""
    mark, pattern = _marked(kind)
    found = _where(matches(text, pattern), lambda x: _valid(kind, f"{x}.hit"))
    return f"if(contains({text}, '{mark}'), {found}, {_NONE})" if mark else found


FEATURES = ("length", "digits", "letters", "luhn", "separators", "separator_kinds", "bracket", "quads", "date", "cue", "anti", "before", "after", "suffix", "lead", "even", "groups")


def _features(kind: str, pieces: str, x: str) -> str:
    """The features of a candidate as an array, in the order of FEATURES."""

    def listed(v: str) -> str:
        hit, digits, separators, before, after = (f"{v}.{name}" for name in ("hit", "digits", "separators", "before", "after"))
        flag = lambda c: f"cast(coalesce({c}, false) as double)"
        like = lambda c, pattern: flag(f"rlike({c}, {_quoted(pattern)})")
        size = lambda c: f"cast(length({c}) as double)"
        kinds = " + ".join(["0.0D", *(flag(f"contains({separators}, '{c}')") for c in " ./_:-")])
        values = [
            size(hit), size(digits), size(f"regexp_replace({hit}, '[^A-Za-z]', '')"), flag(f"(length({digits}) > 1 and {luhn(digits)})"), size(separators), kinds,
            like(hit, r"[(\[{<]"), like(hit, r"^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"),
            like(hit, r"^(?:19|20)[0-9]{2}[ ./-][01]?[0-9][ ./-][0-3]?[0-9]\b|^[0-3]?[0-9][ ./-][0-3]?[0-9][ ./-](?:19|20)[0-9]{2}\b|^[0-9]{2}:[0-9]{2}:[0-9]{2}"),
            like(before, _CUES[kind]), like(before, _ANTI), like(before, r"[A-Za-z0-9$€£#=/_.,+-]$"), like(after, r"^(?:[A-Za-z0-9%€£/_=-]|[.,][0-9])"),
            like(hit, r"(?i)(?:\.|dot[)\]}> ]) {0,2}(?:com|org|net|edu|gov|io|info|co|de|fr|es|uk|eu|biz|dev)$"),
            f"coalesce(try_cast(substr({digits}, 1, 1) as double), -1.0D)", like(digits, r"^(\d)\1+$"), f"cast(size(split(regexp_replace({hit}, '[^0-9A-Za-z]+', ' '), ' ', -1)) as double)",
        ]
        return f"array({', '.join(values)})"

    before = part_of(pieces, f"greatest({x}.start - {CONTEXT}, 0)", f"least({x}.start, {CONTEXT})")
    read = _struct(hit=f"{x}.hit", digits=_digits(f"{x}.hit"), separators=f"regexp_replace({x}.hit, '[^ ./_:-]', '')", before=before, after=part_of(pieces, f"{x}.`end`", "2"))
    return _let(read, listed)


def _free(spans: str) -> str:
    """Of spans (start, end, base, hit) in order, those that are no base spans and overlap none, each once."""
    far = str(2**31 - 1)
    ends = _scan(_each(spans, lambda s: f"if({s}.base, {s}.`end`, 0)"), _greatest, "0")
    starts = f"reverse({_scan(f'reverse({_each(spans, lambda s: f"if({s}.base, {s}.start, {far})")})', _least, far)})"
    around = _zip(ends, starts, lambda e, s: _struct(e=e, s=s))
    marked = _zip(spans, around, lambda x, a: _struct(start=f"{x}.start", end=f"{x}.`end`", hit=f"{x}.hit", free=f"(not {x}.base and {a}.e <= {x}.start and {a}.s >= {x}.`end`)"))
    return _let(_where(marked, lambda x: f"{x}.free"), lambda v: _where(v, lambda x, i: f"({i} = 0 or get({v}, greatest({i} - 1, 0)) != {x})", 2))


def candidates(text: str, kind: str, base: str) -> str:
    """Proposed spans of a kind that overlap no span of ``base``, with their features as array x."""

    def marked(spans: str, own: str) -> str:
        return _each(spans, lambda s: _struct(start=f"{s}.start", end=f"{s}.`end`", base=own, hit=f"{s}.hit"))

    def described(found: str) -> str:
        return _let(pieces_of(text), lambda p: _each(found, lambda c: _struct(start=f"{c}.start", end=f"{c}.`end`", x=_features(kind, p, c))))

    none = "cast(array() as array<struct<start:int,end:int,x:array<double>>>)"
    proposed = f"concat({', '.join(matches(text, p) for p in _PROPOSED[kind])})"
    free = lambda p: _let(f"array_sort(concat({marked(p, 'false')}, {marked(base, 'true')}))", _free)
    return _let(proposed, lambda p: f"if(size({p}) = 0, {none}, {_let(free(p), lambda found: f'if(size({found}) = 0, {none}, {described(found)})')})")


# Training spans. A text is a list of parts; a marked part is a span and whether it is personal data.


def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _luhn_number(rng: random.Random, n: int = 16) -> str:
    body = rng.choice("3456") + _number(rng, n - 2)
    for check in "0123456789":
        total = 0
        for i, c in enumerate(reversed(body + check)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        if total % 10 == 0:
            return body + check
    raise AssertionError


def training_texts(n: int = TRAINING_TEXTS, seed: int = 11) -> list[dict]:
    """Written examples: text, kind, and the start and end of its one labelled span, with its label."""
    rng = random.Random(seed)
    names = "anna.berg j.smith info sales marie-claire k_lopez team42 office the.one support".split()
    hosts = "example mail4 acme-corp uni-stadt shop blog.site ministerio".split()
    ends = "com org net de fr es io co.uk".split()
    filler = "the report of this team was sent to all members on friday and nobody answered until monday der bericht kam spät el informe llegó tarde le rapport est arrivé".split()

    def words(k: int) -> str:
        return " ".join(rng.choice(filler) for _ in range(k))

    def grouped(digits: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(digits[at : at + s])
            at += s
        return sep.join(x for x in [*out, digits[at:]] if x)

    rows = []
    for _ in range(n):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        cue, tail = "", ""
        if kind == "email":
            at, dot = rng.choice([" at ", " (at) ", "(at)", "[at]", " [at] ", "@ "]), rng.choice([" dot ", "[dot]", "(dot)", "."])
            if good:
                hit = rng.choice(names) + at + rng.choice(hosts).replace(".", dot) + dot + rng.choice(ends).replace(".", dot)
                cue = rng.choice(["mail me: ", "email ", "contact ", "", "write to ", "reach us at "])
            else:
                hit = rng.choice([f"{rng.choice(filler)} at {rng.choice(filler)}.{rng.choice(filler)}", f"{rng.choice(filler)} at {rng.choice(filler)}. {rng.choice(filler)}", f"{rng.choice(filler)} at noon. {rng.choice(filler).capitalize()}", f"meet at {rng.choice(hosts).split('.')[0]}. {rng.choice(['The', 'It', 'We'])}", f"@ {rng.choice(filler)}. {rng.choice(filler)}", f"{rng.choice(filler)} at {rng.choice(filler)}.{rng.choice('es de it co en fr is in'.split())}"])
        elif kind == "ip":
            if good:
                hit = rng.choice([":".join(f"{rng.randrange(65536):x}" for _ in range(8)), rng.choice(["[.]", "(.)", "[dot]"]).join(str(rng.randrange(256)) for _ in range(4))])
                cue = rng.choice(["host ", "ip ", "", "login from ", "server ", "client "])
            else:
                hit = rng.choice([":".join(_number(rng, 2) for _ in range(rng.randint(4, 6))), ":".join(_number(rng, rng.randint(1, 2)) for _ in range(4)), ":".join(rng.choice(["a", "be", "ad", "fee", "bad"]) for _ in range(4))])
                cue = rng.choice(["at ", "time ", "score ", "ratio ", "", "section "])
        elif kind == "card":
            if good:
                d = _luhn_number(rng, rng.choice([16, 16, 16, 15]))
                hit = grouped(d, [4, 4, 4] if len(d) == 16 else [4, 6], rng.choice([".", "/", "_", "  ", " - "[:2]]))
                cue = rng.choice(["card ", "visa: ", "credit card no ", "", "pay with ", "cc "])
            else:
                d = _number(rng, rng.randint(13, 19))
                hit = rng.choice([grouped(d, [rng.randint(1, 6) for _ in range(5)], rng.choice([".", "/", "_", "."])), ".".join(_number(rng, rng.randint(1, 3)) for _ in range(rng.randint(7, 9))), f"{_number(rng, 8)}.{_number(rng, rng.randint(5, 8))}", "/".join([_number(rng, 4), _number(rng, 2), _number(rng, 2), _number(rng, 6)])])
                cue = rng.choice(["order ", "ref ", "serial ", "", "version ", "tracking code ", "article "])
        else:
            if good:
                area, a, b = _number(rng, rng.randint(3, 4)), _number(rng, 3), _number(rng, 4)
                hit = rng.choice([f"({area[:3]}) {a}-{b}", f"{area[:3]}-{a}-{b}", f"{area[:3]}.{a}.{b}", f"0{area} {a} {b}", f"0049 {area} {a} {b}", f"0{_number(rng, 9)}", f"0{area[0]} {_number(rng, 2)} {_number(rng, 2)} {_number(rng, 2)} {_number(rng, 2)}"])
                cue = rng.choice(["tel ", "phone: ", "call ", "fax ", "Telefon ", "tél. ", "mobile ", "ring me on ", "llame al "])
            else:
                hit = rng.choice([f"{rng.choice(['19', '20'])}{_number(rng, 2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{_number(rng, 2)}", f"{_number(rng, 2)} {_number(rng, 3)} {_number(rng, 3)}", f"{_number(rng, 4)} {_number(rng, 4)} {_number(rng, 4)}", f"{_number(rng, 2)}.{_number(rng, 2)}.{_number(rng, 2)}", f"{_number(rng, 3)}-{_number(rng, 2)}-{_number(rng, 4)}", f"{_number(rng, 3)}-{_number(rng, 3)}-{_number(rng, 4)}", f"{_number(rng, 3)} {_number(rng, 3)} {_number(rng, 3)}", f"0{_number(rng, 9)}"])
                cue = rng.choice(["on ", "order ", "isbn ", "", "", "total ", "between ", "score ", "pages ", "ref ", "section ", "since "])
                tail = rng.choice(["", "", "%", " €", ",50", "."])
        lead = words(rng.randint(0, 6))
        lead = f"{lead} {cue}" if lead else cue
        text = lead + hit + tail + rng.choice([" ", ". ", ", ", "\n"]) + words(rng.randint(0, 5))
        rows.append({"text": text, "kind": kind, "start": len(lead), "end": len(lead) + len(hit), "label": int(good)})
    return rows


class Trees:
    """Boosted regression trees for a binary label; a tree is (feature, threshold, left, right) or a number."""

    def __init__(self, trees: list, start: float):
        self.trees, self.start = trees, start

    def logit(self, x: np.ndarray) -> np.ndarray:
        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        total = np.full(len(x), self.start)
        for tree in self.trees:  # one by one, as ``sql`` adds them, so that thresholds hold to the last bit
            total = total + np.array([walk(tree, row) for row in x])
        return total

    def sql(self, x: str) -> str:
        """The logit as an expression of the array named ``x``; as text, because building it call by call takes seconds."""

        def node(tree) -> str:
            if not isinstance(tree, tuple):
                return f"{tree!r}D"
            return f"if({x}[{tree[0]}] <= {tree[1]!r}D, {node(tree[2])}, {node(tree[3])})"

        return " + ".join([f"{self.start!r}D", *map(node, self.trees)])


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, least: int = 8) -> Trees:
    """Gradient boosting with logistic loss and Newton leaves."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(math.log(share / (1 - share)))
    logit = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
        best = (1e-6, None, None)
        total = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        if left:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in ((values[:-1] + values[1:]) / 2)[:: max(1, len(values) // 16)]:
                    a = rows[x[rows, f] <= cut]
                    if least <= len(a) <= len(rows) - least:
                        ga, ha = g[a].sum(), h[a].sum()
                        gain = ga**2 / (ha + 1) + (g[rows].sum() - ga) ** 2 / (h[rows].sum() - ha + 1) - total
                        if gain > best[0]:
                            best = (gain, f, float(cut))
        if best[1] is None:
            return leaf
        side = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[side], g, h, left - 1), grow(rows[~side], g, h, left - 1))

    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        grown.append(tree)
        logit += Trees([tree], 0.0).logit(x)
    return Trees(grown, start)


class Detector:
    """Trees and a threshold on their logit for each kind."""

    def __init__(self, trees: dict[str, Trees], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds


def calibrated(logits: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The least threshold from which on the selected examples reach the precision; none selects nothing."""
    order = np.argsort(-logits, kind="stable")
    good = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    ends = np.append(logits[order][:-1] != logits[order][1:], True)  # ties are selected together
    ok = np.flatnonzero((good >= precision) & ends)
    return float(logits[order][ok[-1]]) if len(ok) else math.inf


@lru_cache(maxsize=1)
def _fitted(rows: tuple) -> Detector:
    trees, thresholds = {}, {}
    for kind in KINDS:
        x = np.array([r[1] for r in rows if r[0] == kind], float)
        y = np.array([r[2] for r in rows if r[0] == kind], float)
        if not len(y) or y.min() == y.max():
            trees[kind], thresholds[kind] = Trees([], -9.0), 1e9
            continue
        half = np.arange(len(y)) % 2 == 0
        trees[kind] = boost(x[half], y[half])
        thresholds[kind] = min(1e9, max(LEAST_LOGIT, calibrated(trees[kind].logit(x[~half]), y[~half])))
    return Detector(trees, thresholds)


_detectors: dict[tuple[int, int], Detector] = {}


def detector(spark: SparkSession, texts: int = TRAINING_TEXTS, seed: int = 11) -> Detector:
    """The detector trained on written examples, once per process."""
    if (texts, seed) not in _detectors:
        given = training_texts(texts, seed)
        rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(given)), "array<struct<text:string,kind:string,start:int,end:int,label:int>>")).alias("r")).select("r.*")
        found = []
        for kind in KINDS:  # one job for all kinds
            each = rows.where(F.col("kind") == kind).select("start", "end", "label", F.explode(F.expr(candidates("text", kind, _NONE))).alias("c"))
            hits = (F.col("c.start") < F.col("end")) & (F.col("start") < F.col("c.end"))
            whole = (F.col("c.start") <= F.col("start") + 1) & (F.col("c.end") >= F.col("end") - 1)
            found.append(each.where(hits).select(F.lit(kind), "c.x", (whole & (F.col("label") == 1)).cast("int")))
        _detectors[(texts, seed)] = _fitted(tuple((kind, tuple(x), int(y)) for kind, x, y in reduce(DataFrame.union, found).collect()))
    return _detectors[(texts, seed)]


def _fresh(df: DataFrame, prefix: str) -> str:
    """A prefix that no column of ``df`` begins with."""
    while any(c.lower().startswith(f"{prefix}_".lower()) for c in df.columns):
        prefix += "_"
    return prefix


def _chosen(scored: str) -> str:
    """Of candidates (start, end, rank, over), those that no better overlapping one beats, in order."""
    place = lambda s: f"struct({s}.start, {s}.`end`, {s}.rank)"
    better = lambda a, b: f"({a}.over > {b}.over or ({a}.over = {b}.over and {place(a)} < {place(b)}))"

    def among(v: str) -> str:
        # overlapping spans follow each other: a group ends where the next span begins at or after all ends before it
        def grouped(r: str) -> str:
            fresh = _each(v, lambda s, i: f"if({i} = 0 or coalesce(get({r}, {i} - 1), 0) <= {s}.start, {i}, 0)", 2)
            last = _each(v, lambda s, i: f"if(coalesce(get({v}, {i} + 1).start >= get({r}, {i}), true), {i}, size({v}))", 2)
            near = _zip(_scan(fresh, _greatest, "0"), f"reverse({_scan(f'reverse({last})', _least, str(2**31 - 1))})", lambda a, b: _struct(a=a, b=b))
            beats = lambda s: _with(lambda o: f"({o}.start < {s}.`end` and {s}.start < {o}.`end` and {better(o, s)})")
            beaten = lambda s, n: f"({n}.a < {n}.b and exists(slice({v}, {n}.a + 1, {n}.b - {n}.a + 1), {beats(s)}))"
            marked = _zip(v, near, lambda s, n: _struct(s=s, beaten=beaten(s, n)))
            return _each(_where(marked, lambda m: f"not {m}.beaten"), lambda m: f"{m}.s")

        return _let(_scan(_each(v, lambda s: f"{s}.`end`"), _greatest, "0"), grouped)

    return f"if(size({scored}) < 2, {scored}, {_let(scored, among)})"


def detect(docs: DataFrame, *, text_col: str = "text", model: Detector | None = None, prefix: str = "pii") -> DataFrame:
    """``docs`` with <prefix>_<kind>, the base spans of each kind, and <prefix>_added, the selected candidates.

    No column of ``docs`` may begin with the prefix and an underscore.
    """
    model = model or detector(docs.sparkSession)
    text = f"coalesce(cast(`{text_col}` as string), '')"
    out = docs.select("*", *(F.expr(base_spans(text, kind)).alias(f"{prefix}_{kind}") for kind in KINDS))
    base = f"concat({', '.join(f'`{prefix}_{k}`' for k in KINDS)})"
    none = "cast(array() as array<struct<start:int,end:int,x:array<double>>>)"
    needs = {"email": r"[@ (\[{<](?:(?<=@)|[aA][tT][ )\]}>])", "ip": r"[:\[(](?:(?<=[0-9A-Fa-f]:)|(?<=[0-9][\[(])|(?<=[0-9] [\[(]))", "card": r"[0-9][ ./_-]{0,2}[0-9]", "phone": r"[0-9]{2}"}
    out = out.select("*", *(F.expr(f"if(rlike({text}, {_quoted(needs[kind])}), {candidates(text, kind, base)}, {none})").alias(f"{prefix}_of_{kind}") for kind in KINDS))
    scored = []
    for rank, kind in enumerate(KINDS):
        over = f"{model.trees[kind].sql('c.x')} - {model.thresholds[kind]!r}D"
        scored.append(f"filter(transform(`{prefix}_of_{kind}`, c -> named_struct('start', c.start, 'end', c.end, 'rank', {rank}, 'over', {over})), c -> c.over >= 0)")
    out = out.select("*", F.expr(f"array_sort(concat({', '.join(scored)}))").alias(f"{prefix}_scored")).drop(*(f"{prefix}_of_{k}" for k in KINDS))
    added = _each(_chosen(f"`{prefix}_scored`"), lambda c: _struct(rank=f"{c}.rank", start=f"{c}.start", end=f"{c}.`end`"))
    return out.withColumn(f"{prefix}_added", F.expr(added)).drop(f"{prefix}_scored")


def _ranked(prefix: str) -> list[Column]:
    def of(rank: int):
        return lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"))

    return [F.transform(F.col(f"{prefix}_{k}"), of(r)) for r, k in enumerate(KINDS)]


def _listed(spans: Column) -> Column:
    """kind:start:end of spans in order of kind and start, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Detector | None = None) -> DataFrame:
    """Per row: doc_id, the number of base spans of each kind, base_sha256 and spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = detect(rows, model=model)
    base = F.concat(*_ranked("pii"))
    counts = [F.size(f"pii_{k}").cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.concat(base, F.col("pii_added"))).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text", model: Detector | None = None, recount: str | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; other columns as they are.

    ``recount`` names a column that holds the text's length, to be set again where a text changed.
    """
    prefix = _fresh(docs, "pii")
    found = detect(docs, text_col=text_col, model=model, prefix=prefix)
    spans = F.array_sort(F.transform(F.concat(*_ranked(prefix), F.col(f"{prefix}_added")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    text = f"cast(`{text_col}` as string)"
    tags = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"

    def written(spans: str, pieces: str) -> str:
        """The text with tags for spans: each span puts what stands between it and all ends before it, and its tag."""
        ends = _scan(_each(spans, lambda s: f"{s}.`end`"), _greatest, "0")

        def joined(e: str) -> str:
            def put(s: str, i: str) -> str:
                at = f"if({i} = 0, 0, get({e}, greatest({i} - 1, 0)))"
                part = lambda a: part_of(pieces, a, f"greatest({s}.start - {a}, 0)")
                return _let(at, lambda a: f"if({s}.start >= {a}, concat({part(a)}, element_at({tags}, {s}.rank + 1)), '')")

            rest = _let(f"element_at({e}, -1)", lambda end: part_of(pieces, end, f"(length({text}) - {end})"))
            return f"concat(array_join({_each(spans, put, 2)}, ''), {rest})"

        return _let(ends, joined)

    found = found.withColumn(f"{prefix}_spans", spans)
    done = _let(_struct(s=f"`{prefix}_spans`", p=pieces_of(text)), lambda x: written(f"{x}.s", f"{x}.p"))
    found = found.withColumn(f"{prefix}_text", F.expr(f"if(size(`{prefix}_spans`) > 0, {done}, {text})"))
    columns = [F.col(f"{prefix}_text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if recount is not None and recount in docs.columns:
        changed = F.when(F.size(f"{prefix}_spans") > 0, F.length(f"{prefix}_text").cast(dict(docs.dtypes)[recount])).otherwise(F.col(f"`{recount}`"))
        columns[docs.columns.index(recount)] = changed.alias(recount)
    return found.select(*columns)
